"""Null ids, repeated rows, empty texts, very long texts and clashing column names; the pipeline against plain versions."""

import random

import pytest
from test_operators import components, tokens
from test_tiling import expected

import corpus_pipeline
from hazeline.llm import common, decontaminate, exact_dedup, minhash, packing, quality, substring

CLASH = "doc_id long, text string, doc string, tag int, content int, n int, h string, bucket string, key long, z int, rows int, slot int, lang string, source string, n_chars long"
TEXTS = [None, "", " \n", "a b", "a b", "word " * 50_000, "the river rose slowly through the night and by morning it had reached the lower fields " * 3]


def odd(spark):
    """Each text twice under one id, once without an id, and once under another."""
    rows = [(i, t) for k, t in enumerate(TEXTS) for i in (k, k, None, 100 + k)]
    return rows, spark.createDataFrame([(i, t, "d", 1, 2, 3, "h", "b", 4, 5, 6, 7, "en", "s", 8) for i, t in rows], CLASH).repartition(3)


def test_every_operator_takes_odd_rows(spark):
    rows, d = odd(spark)
    bench = spark.createDataFrame([(1, "reached the lower fields", 2, "x"), (None, None, 2, "x"), (2, "", 2, "x")], "item_id long, text string, item int, seed string")
    labels = spark.createDataFrame([(100 + k, k % 2) for k in range(7)], "doc_id long, quality int")
    ids = sorted((i for i, _ in rows), key=str)
    for out in (exact_dedup.exact_groups(d), minhash.near_groups(d), substring.repeated_windows(d), packing.packed(d), quality.scored(d, quality.train(d, labels))):
        assert sorted((r.doc_id for r in out.collect()), key=str) == ids
    assert {(r.doc_id, r.item_id, r.covered_words) for r in decontaminate.leaks(d, bench).collect()} == {(6, 1, 4), (106, 1, 4), (None, 1, 4)}
    near = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(d, 4).where("doc_id IS NOT NULL").collect()}
    assert near == {k: (n, c, k == c) for k, (n, c) in components([r for r in rows if r[0] is not None], 4, 80).items()}
    for drop in (exact_dedup.drop_copies, minhash.drop_near_copies):
        assert drop(d).columns == d.columns


def test_stages_tell_rows_apart(spark):
    """One id on two texts, the same row twice, and rows without an id: each counts for itself."""
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(1, long), (1, "other words"), (1, "other words"), (2, long), (None, long), (None, "alone"), (None, "alone"), (3, None), (None, ""), (4, long + " more"), (None, long + " less")]
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, _row int, component string").repartition(3)
    exact = exact_dedup.drop_copies(d)
    assert exact.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in exact.collect()), key=str) == sorted([(1, long), (1, "other words"), (None, "alone"), (3, None), (4, long + " more"), (None, long + " less")], key=str)
    near = sorted(((r.doc_id, r.text) for r in minhash.drop_near_copies(d).collect()), key=str)
    assert near == sorted([(1, long), (1, "other words"), (None, "alone"), (3, None), (None, "")], key=str)
    assert exact_dedup.drop_copies(d.limit(0)).collect() == minhash.drop_near_copies(d.limit(0)).collect() == []


def test_classes_come_by_broadcast_or_shuffle(spark, monkeypatch):
    rows = [(k if k % 5 else None, f"t{k % 7 if k % 3 else 0}") for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(map(str, exact_dedup.exact_groups(d).collect()))
    monkeypatch.setattr(common.with_facts, "__defaults__", (4, 0))
    assert sorted(map(str, exact_dedup.exact_groups(d).collect())) == want


def test_rows_of_one_length_without_id(spark):
    """100,000 of them, in shards of a few thousand."""
    d = spark.range(100_000).selectExpr("CAST(NULL AS long) AS doc_id", "'' AS text")
    out = packing.packed(d, token_budget=1000)
    assert out.select("batch", "slot").distinct().count() == 100_000
    deepest = out.groupBy("batch").count().agg({"count": "max"}).first()[0]
    assert deepest == 1000


def test_sessions_are_left_alone(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    d = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    exact_dedup.exact_groups(d).collect()
    minhash.near_groups(d).collect()
    assert spark.conf.get(key) == before


def test_common_keys_are_dealt(spark, monkeypatch):
    x = spark.range(4000).selectExpr("id AS doc", "if(id % 3 = 0, 7, id) AS k").repartition(4)
    facts = x.groupBy("k").count().withColumnRenamed("count", "rows").selectExpr("k", "rows", "rows * 2 AS twice").cache()
    want = sorted(map(tuple, x.join(facts.drop("rows"), "k").select("doc", "twice").collect()))
    for small in (0, 100_000):
        assert sorted(map(tuple, common.with_facts(x, facts, ["k"], 4000, small=small).select("doc", "twice").collect())) == want
    edges = spark.createDataFrame([(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(500, 530)] + [(700, 700)], "u long, v long")
    for small in (0, 100_000):
        monkeypatch.setattr(common.with_facts, "__defaults__", (4, small))
        got = {r.node: r.component for r in common.connected_components(edges).collect()}
        assert got == {**dict.fromkeys(range(300), 0), **dict.fromkeys(range(500, 531), 500)}


def test_windows_in_many_partitions(spark):
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join([f"w{rng.randrange(500)}" for _ in range(60)] + passage * (k % 3 == 0) + [f"w{rng.randrange(500)}" for _ in range(60)])) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = {(r.doc_id, r.n_removed, r.kept_sha256) for r in substring.repeated_windows(d).collect()}
    assert {(r.doc_id, r.n_removed, r.kept_sha256) for r in substring.repeated_windows(d, bucket_bytes=500, partition_bytes=2000, limit=4000).collect()} == out
    assert {i for i, n, _ in out if n >= 60} == {k for k in range(3, 60, 3)}


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    good = [say(80) for _ in range(40)]
    texts = good + ["".join(g.split(" ", 1)) for g in good[:5]] + [g + " extra" for g in good[5:12]] + ["$$$ !!! buy ### now " * 20 for _ in range(20)] + [None, "", " "]
    items = [(k, " ".join(good[12 + k].split()[10:50])) for k in range(4)] + [(9, None), (10, "no such words anywhere at all")]
    rng.shuffle(texts)
    labels = [(k, int(t is not None and t[:1] == "w")) for k, t in enumerate(texts)]
    spark.createDataFrame([(k, t, "en", "s", len(t or ""), "clash") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, q, 0) for k, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), list(enumerate(texts)), items


def test_pipeline_is_that_of_the_plain_versions(spark, folder):
    where, rows, items = folder
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.scored(docs, quality.train(docs, labels)).where("predicted = 1").collect()}
    rows = [r for r in rows if r[0] in kept]
    best = {}
    for i, t in rows:
        norm = "".join(tokens(t))
        if norm not in best or (-len(t or ""), i) < (-len(best[norm][1] or ""), best[norm][0]):
            best[norm] = (i, t)
    rows = sorted(best.values())
    comp = components(rows, 5, 80)
    rows = [r for r in rows if comp[r[0]][1] == r[0]]
    leaked = {r[0] for r in expected(rows, items)}
    want = {i: len(tokens(t)) for i, t in rows if i not in leaked}
    got = corpus_pipeline.run(spark, where).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    assert len(leaked) == 4 and 25 < len(want) < 45


def test_pipeline_of_nothing(spark, folder, tmp_path):
    where, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
