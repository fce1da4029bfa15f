"""Affinities have the bits that the SQL of linking has, since equal ones are told apart by place."""

import random

import duckdb

from hazeline.plans.catalog import _affinity_sql
from hazeline.streaming import tracks


def test_same_bits_as_sql():
    rng, sides = random.Random(1), ("x1", "y1", "x2", "y2")

    def box():
        x, y, half = 200.0 + rng.randrange(160), 540.0 + rng.randrange(60), (40.0 + rng.randrange(1, 12_000) / 100 * 0.5) / 2
        return x - half, y - half, x + half, y + half

    pairs = [(box(), box()) for _ in range(3000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE p (n INT, " + ", ".join(f"{t}{s} DOUBLE" for t in "ab" for s in sides) + ")")
    con.executemany("INSERT INTO p VALUES (" + ", ".join("?" * 9) + ")", [(n, *a, *b) for n, (a, b) in enumerate(pairs)])
    struct = lambda t: f"struct_pack({', '.join(f'{s} := {t}{s}' for s in sides)}) AS {t}"
    want = con.execute(f"SELECT {_affinity_sql('a', 'b')} FROM (SELECT n, {struct('a')}, {struct('b')} FROM p) ORDER BY n").fetchall()
    got = [tracks.affinity(a, b) for a, b in pairs]
    assert sum(0 < g < 1 for g in got) > 300 and got == [w for (w,) in want]
