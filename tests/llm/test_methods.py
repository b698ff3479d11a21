"""The methods' cores against plain versions: models, bounds, formats, ties, empty tables, the pipeline's stages."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from vigilake.llm import ann, byte_bpe, chat, language_id, lattice_lm, ngram_join, packing, topk, toxicity, url_filter
from vigilake.llm.common import stored
from vigilake.llm.components import connected

DOC = "doc_id long, text string"


def test_bpe_of_random_texts_at_several_chunk_sizes(spark):
    rnd = random.Random(7)
    signs = list("ab1'stdre  \n\n\t\r.,!é中🙂　\xa0\x1c\x85")
    encoding = byte_bpe._encoding(byte_bpe.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for size, overlap, count, length in ((16, 12, 300, 120), (64, 32, 200, 400), (16_384, 256, 3, 30_000)):
        texts = ["".join(rnd.choice(signs) * rnd.choice((1, 1, 2, 5)) for _ in range(length)) for _ in range(count)]
        texts.append(("word " * 4000)[:16_382] + "\n\n" + "Word and more. " * 50)
        got = {r.doc_id: bytes(r.ids) for r in byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), DOC), chunk_chars=size, overlap=overlap).collect()}
        for i, t in enumerate(texts):
            assert got[i] == np.array(encoding.encode_ordinary(t), "<u4").tobytes(), (size, i)


def segmentations(text: str, pieces: set[str]):
    if not text:
        yield ()
    for k in range(1, len(text) + 1):
        if text[:k] in pieces:
            for rest in segmentations(text[k:], pieces):
                yield (text[:k], *rest)


@pytest.mark.parametrize("cells", [2_000_000, 8])
def test_lattice_sums_all_segmentations(monkeypatch, cells):
    names = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"]
    pieces = lattice_lm.Pieces.of(names, [-float(i) for i in range(len(names))], {})
    p = np.exp(pieces.start_logp)
    monkeypatch.setattr(lattice_lm, "CELLS", cells)
    lattice = lattice_lm.Lattice(pieces, pieces.start_logp)
    words = [b"a", b"aba", b"babab", b"abababab"]
    uses = np.zeros(len(names))
    for w, n in zip(words, (1, 2, 3, 4), strict=True):
        ways = list(segmentations("▁" + w.decode(), set(names)))
        weight = [math.prod(p[names.index(x)] for x in way) for way in ways]
        assert lattice.log_probability([w])[0] == pytest.approx(math.log(sum(weight)))
        for way, x in zip(ways, weight, strict=True):
            for piece in way:
                uses[names.index(piece)] += n * x / sum(weight)
    assert lattice.expected(words, np.array([1.0, 2, 3, 4])) == pytest.approx(uses)


def test_markov_likelihood_is_the_plain_recursion():
    urls = [b"http://a.b/c", b"http://a.b/d", b"x", b""]
    order, strength = 3, 4.0
    model = url_filter.Markov.fit(urls, order=order, bits=20, strength=strength)
    seen, after = Counter(), Counter()
    walk = lambda u: [(("\0" * order).encode() + u + b"\0", i) for i in range(order, order + len(u) + 1)]
    for text, i in itertools.chain.from_iterable(map(walk, urls)):
        for k in range(order + 1):
            seen[text[i - k : i]] += 1
            after[text[i - k : i], text[i]] += 1
    for u, got in zip([*urls, b"http://z"], model.log_likelihood([*urls, b"http://z"]), strict=True):
        want = 0.0
        for text, i in walk(u):
            p = 1 / 256
            for k in range(order + 1):
                p = (after[text[i - k : i], text[i]] + strength * p) / (seen[text[i - k : i]] + strength)
            want += math.log(p)
        assert got == pytest.approx(want, rel=1e-5)


def test_url_filter_separates_urls_it_has_not_seen():
    good = [f"https://shop{i}.example/books/{i * 7919 % 1000}".encode() for i in range(400)]
    bad = [f"http://{i * 7919 % 99991:x}.win/?id={i * 31}&x=casino".encode() for i in range(400)]
    model = url_filter.RatioFilter(url_filter.Markov.fit(good[:300]), url_filter.Markov.fit(bad[:300]), 0.0)
    assert (model.score(good[300:]) > 0).mean() > 0.98 and (model.score(bad[300:]) < 0).mean() > 0.98


def test_noisy_or_and_its_sentences():
    model = toxicity.SentenceModel({"=scum": 5.0, "^scum": 1.0}, -3.0)
    s = lambda x: 1 / (1 + math.exp(-x))
    for text, scores in (("Fine day. You scum! Well", [s(-3), s(3), s(-3)]), ("fine.Scum", [s(-3), s(3)]), ("All well", [s(-3)]), ("", [])):
        got, found = model.document(text)
        assert got == pytest.approx(1 - math.prod(1 - x for x in scores))
        assert [text[a:b].strip().lower() for a, b, _ in found] == [x for x in ("you scum", "scum") if x in text.lower()][:1]


def test_toxicity_learns_from_document_labels_which_sentence_offends():
    rnd = random.Random(1)
    plain = lambda: " ".join(rnd.choice("sun rain tree road house river bread stone".split()) for _ in range(8))
    texts = [". ".join([plain() for _ in range(4)] + (["you vile wretch"] if i % 2 else [])) for i in range(200)]
    model = toxicity.train(texts, [i % 2 for i in range(200)])
    score, found = model.document(plain() + ". What a vile wretch he is. " + plain())
    assert score > 0.5 and len(found) == 1 and model.document(plain())[0] < 0.5


def test_network_forward_and_gradient():
    net = language_id.Network.random(["a", "b", "c"], 4)
    rng = np.random.default_rng(0)
    codes, target = rng.integers(97, 105, (6, 3)).astype(np.intp), np.array([0, 2, 1])
    # forward by hand for one text
    states = []
    for way, steps in ((0, range(6)), (1, range(5, -1, -1))):
        h, own = np.zeros(4), {}
        for t in steps:
            g = net.recur[way] @ h + net.embed[way][codes[t, 1]]
            z, n = 1 / (1 + np.exp(g[:4])), np.tanh(g[4:] / 2)
            h = own[t] = z * h + (1 - z) * n
        states.append(own)
    for t in range(6):
        x = net.out @ np.concatenate([states[0][t], states[1][t]]) + net.bias
        assert net.positions(codes)[t, :, 1] == pytest.approx(np.exp(x) / np.exp(x).sum(), abs=1e-5)
    grads: dict = {}
    net.step(codes, target, grads)
    for name, value in net.parameters().items():
        for at in [tuple(rng.integers(0, d) for d in value.shape) for _ in range(6)] + ([(97, 0), (99, 5)] if name.startswith("embed") else []):
            kept, sides = value[at], []
            for step in (1e-2, -1e-2):
                value[at] = kept + step
                sides.append(net.step(codes, target, {}))
            value[at] = kept
            assert grads[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-2, abs=1e-3), (name, at)


TALKS = [
    (1, 1, "user", "hi"), (1, 2, "assistant", "<|turn|>assistant<|says|> a \\ b"), (1, 3, "user", "<|ov"), (1, 4, "assistant", "er|> \\\\</s> [INST"), (1, 5, "user", None),
    (2, 1, "user", "alone"), (3, None, "assistant", "first"), (3, 1, "assistant", ""), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (3, 1, None, "no role"),
    (None, 1, "user", "x"), (None, 2, "assistant", "<\\</s>"), (4, 1, "as|says|>sistant", "<|says|>"), (4, 2, "assistant", "[/INST]\n<<SYS>>"),
]


def test_chat_reads_back_what_was_formatted(spark):
    table = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string")
    examples = chat.expand(table.selectExpr("*", "'x' AS context", "'y' AS reply"))
    for r in examples.collect():
        assert r.text.startswith(r.context) and (r.target is not None) == r.text[len(r.context) :].endswith(chat.END)
        for control in chat.CONTROL:
            assert r.reply.count(control) == 0
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    talks: dict = {}
    for c, turn, role, text in TALKS:
        talks.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns = sorted(turns)
        assert got[c].turns == [f"{role}\n{text}\n" for _, role, text in turns]
        assert got[c].loss == "".join(text for _, role, text in turns if role == "assistant")
    assert chat.expand(table.limit(0)).count() == 0


def brute(sets: dict[int, frozenset], percent: int) -> dict[int, int]:
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    return label


def shingled(text: str) -> frozenset:
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def test_join_at_exact_ties_and_in_families_larger_than_a_group(spark):
    rnd = random.Random(2)
    word = lambda: f"w{rnd.randrange(10**6)}"
    a, b = [word() for _ in range(14)], [word() for _ in range(18)]
    docs = {1: " ".join(a), 2: " ".join(a[:12]), 3: " ".join(b), 4: " ".join(b[:15])}
    assert brute({i: shingled(t) for i, t in docs.items()}, 80) == {1: 1, 2: 1, 3: 3, 4: 4}
    family = [word() for _ in range(60)]
    for i in range(10, 130):
        own = list(family)
        own[rnd.randrange(60)] = word()
        docs[i] = " ".join(own)
    for i in range(200, 260):
        docs[i] = " ".join(word() for _ in range(30))
    want = brute({i: shingled(t) for i, t in docs.items()}, 80)
    table = spark.createDataFrame(list(docs.items()), DOC)
    assert {r.doc_id: r.component_id for r in ngram_join.join_components(table).collect()} == want
    order = ngram_join.frequent_tokens(table, 5)
    signed = stored(ngram_join.signatures(table, order, 5, 80))
    own = {r.row: r.doc_id for r in signed.collect()}
    class_of = {r.sig: r.node for r in ngram_join.text_classes(signed).collect()}
    for most in (300, 2000):
        found = {r.node: r.component for r in connected(ngram_join.links(signed, table, 5, 80, group_tokens=most)).collect()}
        label = {own[r.row]: found.get(class_of[r.sig], class_of[r.sig]) for r in signed.collect()}
        least = {x: min(i for i in docs if label[i] == x) for x in label.values()}
        assert {i: least[label[i]] for i in docs} == want


def test_one_row_stays_of_each_component_and_doc_id(spark):
    long = "one two three four five six seven eight"
    rows = [(1, long), (2, long), (2, "quite another text of seven words here"), (3, None), (3, ""), (None, long), (None, "x")]
    kept = sorted(map(repr, ((r.doc_id, r.text) for r in ngram_join.keep_one(spark.createDataFrame(rows, DOC)).collect())))
    assert kept == sorted(map(repr, [(1, long), (2, rows[2][1]), (3, ""), (3, None), (None, long), (None, "x")]))


def test_packing_wastes_little_and_repeats(spark):
    rnd = random.Random(4)
    table = spark.createDataFrame([(i, " ".join(["word"] * rnd.choice((3, 50, 700, 5000)))) for i in range(400)] + [(None, "null id"), (1, "again")], DOC)
    first, second = ([tuple(r) for r in packing.digests(packing.pack(table.repartition(1))).collect()] for _ in range(2))
    assert sorted(first, key=repr) == sorted(second, key=repr)
    filled: Counter = Counter()
    for r in packing.pack(table.repartition(1)).collect():
        filled[r.sequence_id] += r.length
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in filled.values())  # a power of two needs none
    assert max(filled.values()) <= 4096 and padding <= 0.01 * sum(filled.values())


def test_lists_are_read_no_farther_than_needed():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (1500, 24))
    q, own = x[:40], np.arange(40)
    scores = (q @ x.T).astype(float)
    scores[own, own] = -np.inf
    want = np.sort(scores, axis=1)[:, -10:]
    for known in (np.full(40, -np.inf), want[:, 0]):
        lists = topk.SortedLists(np.arange(1500), x)
        for i, at, s in lists.search(q, own, known, 10):
            assert sorted(s.tolist()) == want[i].tolist() and scores[i, at].tolist() == s.tolist()
        assert lists.multiplied < 40 * x.size
    lists = topk.SortedLists(np.arange(1500), x)
    assert all(not len(at) for _, at, _ in lists.search(q, own, np.full(40, 1e9), 10)) and lists.lists is None  # no list is opened


def test_walk_stops_by_the_test_and_finds_the_nearest():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([c + 0.2 * rng.normal(size=(60, 32)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = ann.grow(x, rng.normal(size=(33, 24)), 1.0, 3)
    ids, q = np.arange(len(x)), x[::20]
    verified = found = 0
    for i, at, _, n in ann.search_leaf(tree, ids, x, tree.project(x), q, ids[::20], np.full(len(q), -np.inf), 20, ann.chi_square_quantile(0.85, 24)):
        s = q[i] @ x.T
        s[20 * i] = -9
        verified += n
        found += len(set(at.tolist()) & set(np.argsort(-s)[:20].tolist()))
    assert found >= 0.9 * 20 * len(q) and verified < 0.5 * len(q) * len(x)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC + ", lang string")
    assert byte_bpe.decode(byte_bpe.encode(docs)).count() == 0
    assert packing.digests(packing.pack(docs)).count() == 0
    assert ngram_join.join_components(docs).count() == 0 and ngram_join.keep_one(docs).count() == 0
    assert language_id.fit(docs) is None and language_id.identify(docs, None).count() == 0 and language_id.keep_identified(docs).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
    assert lattice_lm.score(docs, lattice_lm.fit(docs)).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), url_filter.RULES).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(vectors, vectors).count() == 0 and topk.search(vectors, vectors).count() == 0


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline

    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    rows = docs.collect()
    from vigilake.llm.common import held_out
    from pyspark.sql import functions as F

    net = language_id.fit(docs.filter(~held_out(F.col("doc_id"), 3, 1)))
    letters = lambda t: t is not None and any(map(str.isalpha, t))
    spoken = {r.doc_id for r in rows if letters(r.text) and net.pooled([r.text.encode()]).max() >= 0.4}
    got = corpus_pipeline.language(spark, docs, root)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == spoken
    labels = spark.read.parquet(f"{root}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(toxicity.training_rows(F.col("doc_id"))))
    assert {r.doc_id for r in corpus_pipeline.toxic(spark, docs, root).collect()} == {r.doc_id for r in rows if model.document(r.text or "")[0] < 0.5}
    want = brute({r.doc_id: shingled(r.text or "") for r in rows}, 80)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, root).collect()} == {i for i, c in want.items() if i == c}
    packed = corpus_pipeline.pack(spark, docs, root).collect()
    held = Counter()
    for r in packed:
        held[r.doc_id] += r.length
    assert all(held[r.doc_id] == r.doc_tokens for r in packed) and set(held) == {r.doc_id for r in rows}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "packing"]
