"""Disguised identifiers planted in clean text come back at their own places; any text takes time in proportion to its length."""

import random
import time

import pytest

from hazeline.llm import pii

DOTS = [" dot ", " (dot) ", "[.]", "(dot)", "{ punkt }", "\ndot "]
ATS = [" (at) ", "[at]", " {at} ", "<@>"]
DIGITS = {d: [w for w, v in pii.SPELLED.items() if v == d] for d in range(10)}
CLEAN = "the river rose slowly and nobody was hurt they met again near bridge six".split()


def planted(rng):
    kind = rng.choice(pii.KINDS)
    if kind == "email":
        name, host = rng.choice(["jane", "jane.doe", "j_d+x", "ab%c"]), rng.choice([("example", "org"), ("mail", "example", "net")])
        if rng.random() < 0.3:
            return kind, name.replace("a", "а") + "@" + ".".join(host).replace("e", "е")
        if rng.random() < 0.3:
            return kind, f"{name} at {rng.choice(DOTS).join(host)}"
        return kind, name + rng.choice(ATS) + rng.choice(DOTS).join(host)
    if kind == "ip":
        return kind, rng.choice([" dot ", "(dot)", "[.]"]).join(str(rng.randrange(256)) for _ in range(4))
    if kind == "phone":
        return kind, "plus " + " ".join(rng.choice(DIGITS[rng.randrange(10)]) for _ in range(rng.randrange(8, 16)))
    digits = [rng.randrange(10) for _ in range(15)]
    last = next(d for d in range(10) if pii.luhn("".join(map(str, [*digits, d]))))
    return kind, " ".join(rng.choice(DIGITS[d]) for d in [*digits, last])


def test_planted_spans_come_back():
    rng = random.Random(21)
    for _ in range(1500):
        text, expected = "", {k: [] for k in pii.KINDS}
        for _ in range(rng.randrange(1, 4)):
            text += " ".join(rng.choice(CLEAN) for _ in range(rng.randrange(1, 6))) + ": "
            kind, hidden = planted(rng)
            expected[kind].append((len(text), len(text) + len(hidden)))
            text += hidden + "; "
        base, full = pii.spans(text)
        added = {k: [s for s in full[k] if s not in base[k]] for k in pii.KINDS}
        assert added == expected, text


@pytest.mark.parametrize("text", ["We met at noon dot then left", "Look at this dot it moves", "at dot at dot", "He was at home dot com was new to all", "meet me at ten dot no more"])
def test_sentences_are_no_addresses(text):
    found = [text[a:b] for own in pii.spans(text)[1].values() for a, b in own]
    assert found in ([], ["was at home dot com"])


N = 300_000


@pytest.mark.parametrize("text", [
    "a" * N + " dot b", "a.a." * (N // 4) + "(at)", " " * N + "at b dot com", "a (at) b" * (N // 8), "x dot " * (N // 6), "(" * N + " dot x", "1 dot " * (N // 6), "one " + " " * N + "two",
    "plus " + " " * N + "one two three", "@" * N + " dot x", "+1(" * (N // 3) + " dot x", "(" + " " * N + "at", "one." * (N // 4), "1.1." * (N // 4) + " dot x",
])
def test_long_disguised_texts_take_linear_time(text):
    t = time.perf_counter()
    pii.spans(text)
    assert time.perf_counter() - t < 5


def test_null_ids_and_repeated_rows(spark):
    d = spark.createDataFrame([(None, "a@b.co"), (1, None), (2, "x (at) y.de"), (2, "x (at) y.de")], "doc_id long, text string").selectExpr("*", "1 AS n_email", "'s' AS spans", "2 AS content")
    got = sorted(((r.doc_id, r.n_email, r.n_added_email, r.n_spans) for r in pii.personal_data(d).collect()), key=str)
    assert got == sorted([(None, 1, 0, 1), (1, 0, 0, 0), (2, 0, 1, 1), (2, 0, 1, 1)], key=str)
