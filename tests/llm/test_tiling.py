"""Decontamination against greedy string tiling written plainly, over all pairs of documents and items."""

import random
import re
import time

import numpy as np

from hazeline.llm import decontaminate


def words(t):
    return [w.strip(".,;:!?\"'()[]{}<>") for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))]


def plain_tiles(a, b, k):
    """Longest common run of unmarked words first; ties by item, then document position."""
    out, ma, mb = [], [False] * len(a), [False] * len(b)
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n >= k and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return out
        n, i, j = best
        ma[i : i + n] = [True] * n
        mb[j : j + n] = [True] * n
        out.append(best)


def test_tiles_are_those_of_the_plain_version():
    rng = random.Random(1)
    for _ in range(400):
        alphabet = "abcd"[: rng.randrange(1, 5)]
        a, b = ([rng.choice(alphabet) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        k = rng.randrange(1, 6)
        assert decontaminate.tiles(a, b, k) == plain_tiles(a, b, k), (a, b, k)


def test_equal_hashes_of_different_words_are_no_match(monkeypatch):
    monkeypatch.setattr(decontaminate, "mix", lambda x: np.ones_like(x))
    assert decontaminate.tiles(list("abcdef"), list("fedcba"), 2) == []


def test_repeated_words_and_long_texts_are_quick():
    t = time.perf_counter()
    for n in range(40, 60):
        assert decontaminate.tiles(["x"] * n, ["x"] * 2000, 5) == [(n, 0, 0)]
    a = [f"w{k % 7}" for k in range(2000)]
    assert sum(n for n, _, _ in decontaminate.tiles(a, a[1000:] + ["y"] + a[:1000] * 20, 5)) == 2000
    assert time.perf_counter() - t < 10


def corpus(rng):
    vocabulary = [f"q{k}" for k in range(80)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.randrange(3, 45)))) for k in range(25)] + [(30, "the the the the the the the the"), (31, "tiny item"), (32, None), (None, "no id here at all but words"), (33, ""), (7, "another text of item seven here")]
    texts = [None, "", "The, the. the the the the the the the the", "a tiny, Item! here", "x" * 100_000, "no id here at all but WORDS and more"]
    for _ in range(60):
        own = []
        for _ in range(rng.randrange(4)):
            source = rng.choice(items)[1] or ""
            w = source.split()
            cut = rng.randrange(len(w) + 1)
            own += say(rng.randrange(8)) + w[cut:] + (["z"] if rng.random() < 0.5 else []) + w[:cut]
        texts.append(" ".join(own))
    texts.append(" ".join(" ".join(i[1] or "" for i in items) + " " + " ".join(say(3)) for _ in range(300)))
    rows = list(enumerate(texts)) + [(3, "a tiny, Item! here"), (None, texts[6]), (5, texts[7])]
    return rows, items


def found(spark, rows, items, **kw):
    d = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], "doc_id long, text string, tag int, item string, k int").repartition(4)
    b = spark.createDataFrame([(i, t, 1, "s") for i, t in items], "item_id long, text string, m int, seed string").repartition(2)
    return sorted(((r.doc_id, r.item_id, r.item_words, r.covered_words, r.tiles) for r in decontaminate.leaks(d, b, **kw).collect()), key=str)


def expected(rows, items):
    out = []
    for i, t in set(rows):
        if len(t or "") > 50_000:
            continue
        for j, u in items:
            a = words(u)
            tiles = plain_tiles(a, words(t), min(5, len(a))) if a else []
            covered = sum(n for n, _, _ in tiles)
            if a and covered >= 0.5 * len(a):
                out.append((i, j, len(a), covered, len(tiles)))
    return sorted(out, key=str)


def test_leaks_are_those_of_all_pairs(spark, monkeypatch):
    rows, items = corpus(random.Random(3))
    long = len(rows) - 4
    assert rows[long][0] == long and len(rows[long][1]) > 50_000
    want = expected(rows, items)
    got = found(spark, rows, items)
    assert [r for r in got if r[0] != long] == want and len(want) > 40
    # the long document holds every item whole
    assert {r[1] for r in got if r[0] == long} >= {j for j, u in items if u}
    # a full map, shuffled item texts, dealt seeds and documents change nothing
    monkeypatch.setattr(decontaminate.candidates, "__defaults__", (3,))
    monkeypatch.setattr(decontaminate.tiled, "__defaults__", (0, 2))
    assert found(spark, rows, items, filter_bits=1 << 16) == got


def test_rows_to_drop(spark):
    d = spark.createDataFrame([(None, "tiny item"), (1, "tiny item"), (1, "clean"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "tiny item")], "item_id long, text string")
    assert sorted((r.doc_id, r.text) for r in decontaminate.drop_leaks(d, b).collect()) == [(1, "clean"), (2, None)]
    assert decontaminate.leaks(d.limit(0), b).collect() == [] and decontaminate.leaks(d, b.limit(0)).collect() == []
