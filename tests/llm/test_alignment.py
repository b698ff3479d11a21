from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from vigilake.llm import alignment
from vigilake.llm.common import vocabulary

TEXTS = [
    None, "", " ", "a", "  a  b ", "it's  I'LL don't, 1234 x", "ﬁ ½ \xa0x", "a\nb\n\n c", "the \n the", "\x00a", "<s> </s> <unk> <|endoftext|>", "日本語 テスト 😀", "has ▁ mark",
    "x" * 500, " " * 60, "plain words repeat plain words repeat", "plain words repeat plain words repeat", "tokenizers align " * 700,
]


def brute(texts):
    """Per text: (n_a, n_b, groups, links by pair) by the libraries alone, nothing for texts without tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    chars = alignment.byte_chars()
    out = []
    for text in texts:
        want = (" " + text).encode() if text else b""
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        parts = [[bytes(chars[c] for c in a.id_to_token(i)) for i in ids[0]]]
        parts.append([bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]])
        if not text or any(b"".join(p) != want for p in parts):
            out.append(None)
            continue
        spans = [[(end - len(x), end) for x, end in zip(p, np.cumsum([len(x) for x in p]).tolist())] for p in parts]
        links = Counter((i, j) for i, (s, e) in zip(ids[0], spans[0]) for j, (t, f) in zip(ids[1], spans[1]) if s < f and t < e)
        groups, at = [], [0, 0]
        for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            sides = []
            for k in (0, 1):
                begin = at[k]
                while at[k] < len(ids[k]) and spans[k][at[k]][1] <= cut:
                    at[k] += 1
                sides.append(",".join(map(str, ids[k][begin : at[k]])))
            groups.append("|".join(sides))
        out.append((len(ids[0]), len(ids[1]), groups, links))
    return out


@pytest.mark.parametrize("slice_pairs", [4_000_000, 300])
def test_equals_the_libraries_and_all_pairs(spark, slice_pairs):
    """Slices of any size, rows that share or lack a doc_id, repeated rows and a clashing extra column."""
    ids = [None if i == 4 else i // 2 for i in range(len(TEXTS))]
    docs = spark.createDataFrame(list(zip(ids, TEXTS, ["x"] * len(TEXTS))), "doc_id long, text string, n_a string").repartition(3)
    found = brute(TEXTS)
    held = Counter(p for f in found if f for p in f[3])
    most = defaultdict(int)
    for (i, _), c in held.items():
        most[i] = max(most[i], c)
    want = []
    for doc, f in zip(ids, found):
        if f is None:
            want.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            digest = hashlib.sha256(";".join(f[2]).encode()).hexdigest()
            want.append((doc, f[0], f[1], len(f[2]), sum(f[3].values()), sum(n for p, n in f[3].items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in f[3].items()), digest))
    got = [tuple(r) for r in alignment.align(docs, slice_pairs=slice_pairs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_gallop_finds_what_a_plain_search_finds():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        short = np.unique(rng.integers(1, rng.integers(2, 400), rng.integers(0, 200)))
        long = np.unique(rng.integers(1, rng.integers(2, 400) ** int(rng.integers(1, 3)), rng.integers(0, 300)))
        assert (alignment.gallop(short, long, int(rng.integers(2, 20))) == np.searchsorted(long, short)).all()


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
