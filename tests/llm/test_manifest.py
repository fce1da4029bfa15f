"""The manifest against a plain tree, and against SQL on the tables."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from hazeline.llm import manifest, queries


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, fan):
    """Root, and for each leaf the pairs of what stands left and right on its way."""
    paths, under, now = [[] for _ in leaves], [[k] for k in range(len(leaves))], leaves
    while len(now) > 1:
        up, above = [], []
        for a in range(0, len(now), fan):
            run = now[a : a + fan]
            for j in range(len(run)):
                for k in under[a + j]:
                    paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H(*run))
            above.append(sum(under[a : a + fan], []))
        now, under = up, above
    return now[0], paths


def plain(rows, fan):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], H(field(r[0]), field(r[2]))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([leaf for _, leaf in groups[g]], fan)
    root, top = tree([trees[g][0] for g in names], fan)
    return [(i, leaf, trees[g][0], root, p + way) for g, way in zip(names, top) for (i, leaf), p in zip(groups[g], trees[g][1])]


@pytest.mark.parametrize("fan, n, langs", [(8, 150, [None, "de", "en", "é", ""]), (2, 61, ["a"]), (3, 40, [f"g{k}" for k in range(12)]), (8, 1, [None])])
def test_plain_tree(spark, fan, n, langs):
    rng = random.Random(fan)
    rows = [(rng.choice([None, k, k // 2, 7]), rng.choice(langs), rng.choice([None, "", "a", "b" * 2000])) for k in range(n)]
    d = spark.createDataFrame([(*r, "t", 1, "h", "x") for r in rows], "doc_id long, lang string, text string, tree string, n int, h string, leaf string").repartition(5)
    out = manifest.manifest(d, manifest.leaf_of([F.col("doc_id"), F.col("text")]), "lang", "doc_id", fan, {"was": F.upper("lang")})
    out = out.withColumns({"again": manifest.folded(F.col("leaf"), F.col("path")), "proof": manifest.proof_of(F.col("path"))})
    got = out.collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got), key=str) == sorted(plain(rows, fan), key=str)
    assert all(r.again == r.root and r.proof == H(*(s.left + s.right for s in r.path)) for r in got)
    assert {r.was for r in got} <= {g and g.upper() for g in langs}
    wrong = out.select(manifest.folded(F.reverse("leaf"), F.col("path")).alias("f"), "root").where("f = root").count()
    assert wrong == 0


def test_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert manifest.manifest(d, manifest.leaf_of([F.col("text")]), "lang", "doc_id").collect() == []


def test_common_ancestors_are_dealt(spark, monkeypatch):
    """With few broadcast rows allowed, the ways come by shuffle and are the same."""
    d = spark.range(300).selectExpr("id AS doc_id", "if(id < 200, 'a', 'b') AS lang", "string(id) AS text")
    want = sorted(map(str, manifest.manifest(d, manifest.leaf_of([F.col("text")]), "lang", "doc_id", 2).collect()))
    dealt = manifest.with_facts
    monkeypatch.setattr(manifest, "with_facts", lambda x, facts, on, total, small=0: dealt(x, facts, on, total, most=16, small=0))
    assert sorted(map(str, manifest.manifest(d, manifest.leaf_of([F.col("text")]), "lang", "doc_id", 2).collect())) == want


@pytest.mark.parametrize("name, tables", [("op12_merkle_manifest", ["documents"]), ("op13_prefix_trie", ["conversations"])])
def test_same_rows_as_sql(spark, name, tables):
    con, where = duckdb.connect(), "/root/testdata/sf0.001"
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    got = queries.queries()[name](spark, where)
    columns = ", ".join(got.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()))
