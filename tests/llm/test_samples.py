"""Fitting samples keep their share on tables of any size, and results do not depend on columns with clashing names."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from vigilake.llm import byte_bpe, language_id, packing, toxicity, url_filter
from vigilake.llm.common import below_share, bounded_sample, held_out

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("n", "total"), [(5_000, 10**10), (100_000, 10**11), (12_000, 10**10)])
def test_a_share_of_less_than_a_millionth_is_kept(spark, n, total):
    rows = spark.range(40_000_000)
    want = 40_000_000 * n / total
    assert abs(bounded_sample(rows, n, F.col("id"), total=total).count() - want) < 5 * want**0.5 + 1


def test_all_rows_below_the_bound_and_at_a_share_of_one(spark):
    rows = spark.range(1000)
    assert bounded_sample(rows, 1000, F.col("id")).count() == 1000
    assert rows.filter(below_share(1.0, "id")).count() == 1000 and rows.filter(below_share(7.0, "id")).count() == 1000
    assert bounded_sample(rows, 10, F.col("id")).count() < 40


def test_a_label_of_one_repeated_text_is_learned(spark):
    """A hot text fills its label: the share is that of different texts, so the label does not vanish."""
    rows = [("der die und das ist nicht", "de")] * 3000 + [(f"the and of it {i}", "en") for i in range(300)]
    net = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), sample_docs=200)
    assert set(net.labels) == {"de", "en"}


def test_held_out_toxicity(spark):
    """Figures stated in the README."""
    root = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{root}/labels.parquet").filter(held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = toxicity.op4_toxicity(spark, root).filter("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.sum("predicted").alias("hits"), F.count("*").alias("n")).collect()
    hits = {r.toxic: (r.hits, r.n) for r in got}
    assert hits[1][1] == 97 and hits[1][0] >= 84 and hits[0][0] <= 10


def test_columns_with_clashing_names_change_nothing(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    more = docs.selectExpr("*", "'x' as ids", "2 as row", "3 as score", "4 as n", "5 as idx", "6 as token", "7 as part", "'y' as word", "8 as sequence_id", "9 as start")
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    for call in (byte_bpe.encode, lambda d: packing.digests(packing.pack(d.repartition(1))), lambda d: toxicity.keep_clean(d, labels).select("doc_id"), lambda d: language_id.keep_identified(d).select("doc_id")):
        assert sorted(map(repr, call(docs.repartition(1)).collect())) == sorted(map(repr, call(more.repartition(1)).collect()))
    with pytest.raises(ValueError, match="score"):
        toxicity.score(more, toxicity.SentenceModel({}, -9.0), ("doc_id", "score"))
    with pytest.raises(ValueError, match="score"):
        language_id.identify(more, None, ("doc_id", "score"))


def test_urls_repeat_and_may_be_very_long(spark):
    urls = ["http://a.example.com/en/7"] * 3 + ["http://b.example.org/" + "x" * 200_000, None, "", "no scheme", "HTTP://A.Example.COM/en/71?x"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages, [("allow", "example.com/en/7"), ("block", "example.org/")]).collect()}
    assert len(got) == len(urls) and all((got[i].host, got[i].path, got[i].verdict) == ("a.example.com", "/en/7", "allow") for i in range(3))
    assert got[3].rule == "example.org/" and len(got[3].path) == 200_001
    assert [(got[i].host, got[i].path, got[i].rule) for i in (4, 5, 6)] == [("", "", None)] * 3
    assert (got[7].host, got[7].path, got[7].rule) == ("a.example.com", "/en/71", "example.com/en/7")


def test_url_models_count_all_urls_and_the_threshold_is_the_best_of_all(spark):
    """More URLs of a kind than any sample held."""
    n = 26_000
    rows = spark.range(2 * n).select(F.concat(F.when(F.col("id") < n, "http://a.example/").otherwise("http://b.example/"), F.hex((F.col("id") * 7919 % 100_003).cast("long"))).alias("url"), (F.col("id") < n).alias("accepted"))
    rows = rows.union(rows.limit(500))  # copies count once
    model = url_filter.fit(rows, bits=12)
    known = rows.distinct().withColumn("held", url_filter.held_url(F.col("url"))).collect()
    for kind, own in ((True, model.accepted), (False, model.rejected)):
        want = url_filter.Markov.fit([r.url.encode() for r in known if r.accepted == kind and not r.held], bits=12)
        assert (own.context == want.context).all() and (own.following == want.following).all()
    held = [r for r in known if r.held]
    scores = model.score([r.url.encode() for r in held])
    good, bad = (np.sort(scores[[r.accepted == k for r in held]]) for k in (True, False))
    wrong = lambda cut: np.searchsorted(good, cut) / len(good) + 1 - np.searchsorted(bad, cut) / len(bad)
    assert wrong(model.threshold) <= wrong(np.unique(scores)).min() + 1e-12


def test_the_cut_is_exact_over_buckets(spark):
    rng = np.random.default_rng(4)
    for spread in (3.0, 0.0001):
        rows = [(float(round(rng.normal(k * spread, spread) * 50 / spread) / 50 * spread), bool(k)) for k in (0, 1) for _ in range(400)]
        cut = url_filter.best_cut(spark.createDataFrame(rows, "score double, accepted boolean").repartition(3))
        wrong = lambda c: sum(x < c for x, k in rows if k) + sum(x >= c for x, k in rows if not k)
        assert wrong(cut) == min(wrong(c) for c in {x for x, _ in rows} | {1e9})
