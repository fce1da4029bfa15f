"""The trie against a plain one, its queue against sorting, and hashes of long lists of ids."""

import hashlib
import random
import re
import zlib

from hazeline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, n int, conv string, depth int"


def plain(rows):
    """Nodes of (conv_id, turn, role, text) rows without turns of one number but other words."""
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    seq = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, kids = {}, {}
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    total = {}
    for s in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        below = [total[k] for k in kids.get(s, [])]
        total[s] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[s]) - 1) * words)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        ((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids.get(s, [])), *total[s], sha(c for c in m if len(seq[c]) == len(s))) for s, m in members.items()), key=str
    )


def shown(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "c", 2) for r in rows], SCHEMA).repartition(5)


def test_plain_trie(spark):
    rng = random.Random(3)
    say = lambda: (rng.choice(["u", None]), rng.choice(["a b", "c", "", None, " d\te "]))
    rows = [(c, t or None, *say()) for c in range(90) for t in range(rng.randrange(1, 7))]
    rows += [(c, t, "u", "same words") for c in range(200, 260) for t in range(4)]
    rows += [(None, 1, "u", "lost"), (1000, 5, "u", "x " * 30_000)] + [(1001, t, "u", "on") for t in range(700)]
    want = plain(rows)
    d = frame(spark, rows)
    assert shown(prefix_trie.prefix_trie(d)) == want
    # a queue that spills all the time, and a top tree of many nodes
    assert shown(prefix_trie.prefix_trie(d, queue=2)) == want


def test_top_tree(spark, monkeypatch):
    """Nodes with many members are settled after the shards."""
    rows = [(c, t, "u", "hello" if t < 3 else f"w{c % (2 if t < 5 else 1500)}") for c in range(20, 2600) for t in range(6)]
    assert shown(prefix_trie.prefix_trie(frame(spark, rows))) == plain(rows)


def test_repeated_turns_and_nothing(spark):
    rows = [(20, 0, "u", "a"), (20, 0, "u", "a"), (21, 1, "u", "b")]
    assert shown(prefix_trie.prefix_trie(frame(spark, rows))) == plain(rows)
    assert prefix_trie.prefix_trie(frame(spark, rows).limit(0)).collect() == []
    alone = [(21, 0, "u", "a")]  # all its turns are replaced by those of a conversation that isn't there, or it keeps its own
    assert shown(prefix_trie.prefix_trie(frame(spark, alone))) == plain(alone)


def test_queue():
    rng = random.Random(5)
    for limit in (1, 3, 1000):
        q, held, out = prefix_trie.SpillingQueue(limit), [], []
        for _ in range(400):
            if held and rng.random() < 0.4:
                assert q.least() == min(held)
                out.append(q.pop())
                held.remove(out[-1])
            else:
                held.append((rng.randrange(9), str(rng.random())))
                q.push(held[-1])
        while held:
            assert q.pop() == min(held)
            held.remove(min(held))
        assert q.least() is None


def test_long_lists_of_ids(spark):
    d = spark.range(5003).selectExpr("if(id % 3 = 0, 'b', concat('k', id)) AS key", "id * 7 AS conv").repartition(4)
    got = {r.key: r.ends for r in prefix_trie.ends_of(d, block=10).collect()}
    ids = ",".join(str(k * 7) for k in range(0, 5003, 3))
    assert got["b"] == hashlib.sha256(ids.encode()).hexdigest() and got["k4"] == hashlib.sha256(b"28").hexdigest()
    assert len(got) == 1 + sum(1 for k in range(5003) if k % 3)
