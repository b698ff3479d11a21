"""Encoding, packing, scores and formats against plain versions on small fixtures."""

from __future__ import annotations

import base64
import math
import zlib

import public_tokenizers
import tiktoken

from vigilake.llm import byte_bpe, language_id, lattice_lm, packing, toxicity, url_filter

ODD = [(1, None), (2, ""), (3, "a" * 3000), (4, "Ünïcode 你好 \x00 don't we're  \n\n x" * 40), (5, "   "), (6, "word " * 9000), (7, "same"), (8, "same"), (9, "<|endoftext|> ok")]


def documents(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string")


def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_bpe_matches_the_library_and_round_trips(spark):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    for size, overlap in ((16_384, 256), (64, 16)):
        out = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(documents(spark), chunk_chars=size, overlap=overlap)).collect()}
        assert len(out) == len(ODD)
        for i, text in ODD:
            ids = plain.encode_ordinary(text or "")
            assert bytes(out[i].ids) == b"".join(x.to_bytes(4, "little") for x in ids)
            assert bytes(out[i].bytes).decode() == (text or "")


def test_packing_places_each_id_once_without_gaps(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    pieces = [r.asDict() for r in packing.digests(packing.pack(documents(spark))).collect()]
    for i, text in ODD:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own, at = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"]), 0
        for p in own:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += p["length"]
        assert at == len(ids)
    for s in {p["sequence_id"] for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p["sequence_id"] == s), key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.COM/en/7x?q#f", "https://example.net/de/81", "x.org/es/", None, "ftp://my.org/es/a", "http://com/en/", "HTTP://e.com#/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r for r in url_filter.judge(pages, url_filter.RULES).collect()}
    assert [out[i].rule for i in range(7)] == ["example.com/en/7", "example.net/de/8", None, None, "org/es/", "com/en/", None]
    assert (out[0].host, out[0].path) == ("a.example.com", "/en/7x") and (out[2].host, out[3].path) == ("", "") and out[6].path == ""
    assert out[0].verdict == "allow" and out[1].verdict == "block"
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0


def test_url_models_tell_kinds_apart(spark):
    words = ["garden", "recipe", "travel", "casino", "pills", "poker"]
    rows = [(f"http://h{i}.net/{words[k]}/{i * 7919}", k < 3) for i in range(300) for k in (i % 6,)]
    model = url_filter.fit(spark.createDataFrame(rows, "url string, accepted boolean"))
    scores = model.score([u.replace("h", "k").encode() for u, _ in rows])
    assert sum((s >= model.threshold) == ok for s, (_, ok) in zip(scores, rows, strict=True)) > 0.95 * len(rows)


def test_toxicity_locates_the_sentence(spark):
    bad, good = "you vile wretch get lost", "the meadow lay quiet under snow"
    rows = [(i, f"{good}. {bad if i % 4 == 0 else good}! {good} {i}.") for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark, rows), labels)
    out = {r.doc_id: r for r in toxicity.score(documents(spark, [*rows, (900, None), (901, "")]), model).collect()}
    assert all((out[i].score >= 0.5) == (i % 4 == 0) for i, _ in rows)
    start, end, _ = out[0].offending[0]
    assert "vile wretch" in rows[0][1][start:end] and out[900].score == out[901].score == 0


def test_language_of_held_out_rows_and_odd_texts(spark):
    words = {"aa": ["takata", "rakama", "sapata"], "bb": ["whidth", "crysthm", "flychs"]}
    rows = [(i, " ".join(words[l][(i + k) % 3] for k in range(12)), l) for i in range(240) for l in (["aa", "bb"][i % 2],)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(docs.filter("doc_id < 200"))
    out = language_id.identify(docs.filter("doc_id >= 200").select("doc_id", "text", "lang"), net, ("doc_id", "lang")).collect()
    assert all(r.lang == r.lang_pred for r in out) and len(out) == 40
    odd = language_id.identify(documents(spark, [(1, None), (2, "12 34"), (3, "")]), net).collect()
    assert {r.lang_pred for r in odd} == {"und"}


def test_lattice_base_score_by_hand(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "A  b b", None, "", "zzz q"] * 6)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    docs = documents(spark, rows)
    model = lattice_lm.fit(documents(spark, [r for r in rows if not held(r[0])]))
    out = {r.doc_id: r for r in lattice_lm.score(docs, model).collect()}
    seen = [w for i, t in rows if not held(i) for w in [*(t or "").lower().split(), None]]
    total, distinct = len(seen), len(set(seen))
    for i, t in rows:
        tokens = [*(t or "").lower().split(), None]
        assert math.isclose(out[i].base_score, sum(math.log10((seen.count(w) + 1) / (total + 1 * (distinct + 1))) for w in tokens), rel_tol=1e-9)
        assert out[i].n_tokens == len(tokens) and out[i].score <= 0
