from __future__ import annotations

import random

import pytest

from vigilake.llm import ngram_join
from vigilake.llm.common import stored


def shingle_set(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute(rows, percent=80):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(sets[a][0]), root(sets[b][0])))
                parent[q] = p
    return sorted((i, len(s), root(i)) for i, s in sets)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def variants(seed, families=12, each=9):
    rng, rows = random.Random(seed), []
    for _ in range(families):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 5, 8, 40, 90]))]
        for _ in range(each):
            own = list(words)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(400)}"
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = variants(seed)
    assert got(ngram_join.join_components(documents(spark, rows))) == brute(rows)


def test_groups_cut_by_size_lose_no_link(spark):
    rows = variants(5, families=4, each=30)
    docs = documents(spark, rows)
    order = ngram_join.frequent_tokens(docs, 5)
    signed = ngram_join.stored(ngram_join.signatures(docs, order, 5, 80))
    links = ngram_join.links(signed, docs, 5, 80, group_tokens=200)
    parent = {r.node: r.node for r in ngram_join.text_classes(signed).collect()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links.collect():
        p, q = sorted((root(r.a), root(r.b)))
        parent[q] = p
    nodes = {r.sig: (r.node, r.doc) for r in ngram_join.text_classes(signed).collect()}
    least = {}
    for node, doc in nodes.values():
        least[root(node)] = min(doc, least.get(root(node), doc))
    mine = sorted((r.doc_id, r.n_shingles, least[root(nodes[r.sig][0])] if r.sig is not None else r.doc_id) for r in signed.collect())
    assert mine == brute(rows)


def test_null_empty_and_repeated_rows(spark):
    same = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \t"), (4, same), (4, same), (5, same.upper()), (None, same), (6, "one two"), (7, "ONE two")]
    out = sorted(ngram_join.join_components(documents(spark, rows)).collect(), key=str)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by == {1: [(0, 1)], 2: [(0, 2)], 3: [(0, 3)], 4: [(3, 4), (3, 4)], 5: [(3, 4)], None: [(3, None)], 6: [(1, 6)], 7: [(1, 6)]}


def test_empty_table_and_clashing_columns(spark):
    empty = documents(spark, [])
    assert ngram_join.join_components(empty).count() == 0
    docs = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f")]).selectExpr("*", "1 as node", "2 as sig", "3 as component_id")
    assert got(ngram_join.join_components(docs)) == [(1, 2, 1), (2, 2, 1)]
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


A = " ".join(f"a{i}" for i in range(30))
B = " ".join(f"b{i}" for i in range(30))
A2, B2 = A + " more", B + " more"


def brute_rows(rows):
    """(doc_id, component_id) of each row and the components as lists of rows, by links between rows, not ids."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    members = {}
    for (doc, _), x in zip(rows, label):
        members.setdefault(x, []).append(doc)
    return sorted((doc, min(members[x])) for (doc, _), x in zip(rows, label)), label


SHARED = [
    [(5, A), (5, B)],
    [(5, A), (5, B), (3, A2), (9, B)],
    [(5, A), (5, B), (3, A2), (9, B), (2, A)],
    [(5, A), (5, B), (3, A2), (9, B), (2, B2)],
    [(5, A), (5, B), (3, B2), (9, A2), (2, A2), (1, B)],
    [(5, A), (5, A), (5, A2), (5, B), (5, B2), (7, ""), (7, ""), (7, "  "), (8, None)],
]


@pytest.mark.parametrize("rows", SHARED)
def test_rows_that_share_a_doc_id_are_rows_of_their_own(spark, rows):
    """Components by links between rows; one row of each component stays and nothing else goes."""
    docs = documents(spark, rows)
    want, label = brute_rows(rows)
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.join_components(docs).collect()) == want
    kept = sorted((r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect())
    sets = {i: frozenset(shingle_set(t)) for i, (_, t) in enumerate(rows)}
    expected = sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label))
    assert sorted(d for d, _ in kept) == expected
    places = [{label[i] for i in range(len(rows)) if rows[i] == row} for row in kept if shingle_set(row[1])]
    assert all(len(p) == 1 for p in places) and len(set().union(*places)) == len({x for i, x in enumerate(label) if sets[i]})
