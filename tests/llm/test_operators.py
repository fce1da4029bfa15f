"""Each operator on small tables with nulls, empty and long texts, ties, repeats and clashing column names, and against plain versions."""

import hashlib
import random
import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from hazeline.llm import decontaminate, exact_dedup, html, langid, minhash, packing, pii, quality, queries, substring, urls

SF = "/root/testdata/sf0.001"
WORDS = [f"w{k}" for k in range(60)]
DOCS = "doc_id long, text string, bucket string, key long, doc string"


def corpus(spark, extra=()):
    """Random texts with copies, near copies, shared passages, blanks and a very long text."""
    rng = random.Random(11)
    say = lambda n: [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]
    texts: list = [None, "", " \t\n", "one", "One two  three", "x" * 50_000]
    base, passage = say(200), say(45)
    texts += [" ".join(base), "\n".join(base), " ".join(base).upper()]
    for _ in range(12):
        own = list(base)
        for _ in range(rng.randrange(12)):
            own[rng.randrange(len(own))] = "edit" + str(rng.randrange(10**6))
        texts.append(" ".join(own))
    texts += [" ".join(say(rng.randrange(60)) + passage + say(rng.randrange(60))) for _ in range(6)]
    texts.append(" ".join(passage + say(5) + passage + passage))
    texts.append(" ".join(say(25_000)))
    texts += list(extra)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t) for i, t in zip(ids, texts, strict=True)]
    return rows, spark.createDataFrame([(i, t, "b", 1, "d") for i, t in rows], DOCS).repartition(5)


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def test_exact_groups(spark):
    rows, d = corpus(spark)
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    text = {i: t or "" for i, t in rows}
    for combine, bucket in ((32 << 20, 64 << 20), (1, 1)):
        got = exact_dedup.exact_groups(d, combine, bucket).collect()
        assert len(got) == len(rows)
        for r in got:
            group = [i for i in norm if norm[i] == norm[r.doc_id]]
            keep = min(group, key=lambda i: (-len(text[i]), i))
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(group), keep == r.doc_id, hashlib.sha256(norm[r.doc_id].encode()).hexdigest())
    assert exact_dedup.exact_groups(empty(spark)).collect() == []
    repeated = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a ")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(repeated).collect()} == {(None, 1, 3), (1, 1, 3)}


def components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in tokens(t)]
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_groups(spark, k):
    rows, d = corpus(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(d, k).collect()}
    assert got == components(rows, k, 80)
    assert minhash.near_groups(empty(spark)).collect() == []


def test_open_components_in_small_blocks(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(80)]
    texts = []
    for n in range(90):
        own = list(base)
        for p in rng.sample(range(80), rng.choice([0, 2, 3, 6, 9])):
            own[p] = f"e{n}_{p}"
        texts.append((n, " ".join(own)))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(d, 4).collect()}
    assert got == components(texts, 4, 80)


def removed(rows, window):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = tokens(t)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if key in seen:
                gone[a : a + window] = [True] * window
            seen.setdefault(key, (i, a))
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_repeated_windows(spark):
    rows, d = corpus(spark)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeated_windows(d).collect()}
    assert got == removed(rows, 20)
    assert substring.repeated_windows(empty(spark)).collect() == []


def test_small_blocks_and_spilled_buckets(spark):
    rows, _ = corpus(spark)
    d = [(i, (t or "").encode()) for i, t in rows]
    for entries, limit, buckets in ((300, 20_000, 3), (2000, 100_000, 1)):
        got = in_memory(d, entries, limit, buckets)
        want = removed(rows, 20)
        assert {i: n for i, n in got.items() if n} == {i: w[1] for i, w in want.items() if w[1]}


def in_memory(docs, entries, limit, buckets):
    """The two rounds of the operator with Spark's exchanges as sorts."""
    texts = dict(docs)

    def exchange(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        return [pa.RecordBatch.from_pylist(sorted(rows, key=lambda r: r["bucket"]), schema=pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("body", pa.binary())]))]

    def answers(asked, later):
        found = exchange(substring._match(later, buckets, limit)(iter(exchange(asked))))
        return {r["doc"]: r["body"] for b in substring._gather(iter(found)) for r in b.to_pylist()}

    block = lambda later: substring.Block(buckets, later, entries)
    anchors, cache, other = block(False), substring.WordHashes(), substring.OtherHashes()
    asked = []
    for i, t in docs:
        h = substring.hash_words(t.split(), cache)
        if len(h) >= 20:
            at = np.flatnonzero(substring._COVERED[np.arange(len(h) - 7) % substring.PERIOD])
            asked += anchors.add(i, 0, at, substring.rolling(h, 8)[at])
    asked += anchors.flush()
    assert len(asked) > 1 or entries > 1000
    places, windows, asked = answers(asked, False), block(True), []
    for i, body in places.items():
        w = texts[i].split()
        at = np.frombuffer(body, np.int32)
        starts = np.unique([s for a in at.tolist() for s in range(max(0, a - 12), min(a, len(w) - 20) + 1)]).astype(np.int64)
        if len(starts):
            asked += windows.add(i, 0, starts, substring.rolling(substring.hash_words(w, cache), 20)[starts], substring.rolling(substring.hash_words(w, other), 20)[starts])
    asked += windows.flush()
    return {i: len({p + k for p in np.frombuffer(body, np.int32).tolist() for k in range(20)}) for i, body in answers(asked, True).items()}


def test_equal_first_halves_of_hashes_are_no_match(spark, monkeypatch):
    rows, _ = corpus(spark)
    rolling, calls = substring.rolling, []

    def forged(h, k):
        calls.append(k)
        first = k == 20 and calls.count(20) % 2 == 1
        return np.full(max(0, len(h) - k + 1), 7, np.uint64) if first else rolling(h, k)

    monkeypatch.setattr(substring, "rolling", forged)
    got = in_memory([(i, (t or "").encode()) for i, t in rows], 500, 20_000, 3)
    assert {i: n for i, n in got.items() if n} == {i: w[1] for i, w in removed(rows, 20).items() if w[1]}


def test_cover_reaches_every_pair_of_alignments():
    cover = set(substring.COVER.tolist())
    for a in range(substring.PERIOD):
        for b in range(substring.PERIOD):
            assert any((a + t) % substring.PERIOD in cover and (b + t) % substring.PERIOD in cover for t in range(substring.PERIOD))


def test_leaks(spark):
    rng = random.Random(2)
    items = [(k, " ".join(f"q{rng.randrange(500)}" for _ in range(40))) for k in range(5)] + [(9, "tiny item"), (10, None)]
    a, b = items[0][1].split(), items[1][1].split()
    moved = a[20:] + ["x"] * 3 + a[:20]
    texts = [(0, " ".join(["z"] * 30 + a)), (1, " ".join(moved).upper() + "."), (2, " ".join(b[:15])), (3, None), (4, "a tiny item here"), (5, "tiny, Item."), (6, "nothing of it")]
    got = {(r.doc_id, r.item_id): r.covered_words for r in decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 0): 40, (1, 0): 40, (4, 9): 2, (5, 9): 2}
    assert decontaminate.leaks(empty(spark), empty(spark, "item_id long, text string")).collect() == []


def least_padding(hist, buckets):
    top = hist[-1][0]
    best = None
    for n in range(min(buckets, len(hist))):
        for cut in combinations([h[0] for h in hist[:-1]], n):
            ends = [*cut, top]
            cost = sum((min(e for e in ends if e >= h[0]) - h[0]) * h[1] for h in hist)
            best = cost if best is None else min(best, cost)
    return best


def padding(hist, ends):
    return sum((min(e for e in ends if e >= x) - x) * c for x, c in hist)


def test_boundaries_are_optimal():
    rng = random.Random(4)
    for top in (12, 200, 50_000):
        for _ in range(30):
            hist = [(x, rng.randrange(1, 30)) for x in sorted(rng.sample(range(top), 9))]
            for k in (1, 2, 3, 4, 9, 12):
                ends = packing.boundaries(hist, k)
                assert len(ends) <= k and padding(hist, ends) == least_padding(hist, k)
    assert packing.boundaries([], 4) == [] and packing.boundaries([(0, 5)], 4) == [0]


def test_boundaries_of_many_lengths_are_optimal_and_quick():
    rng = np.random.default_rng(0)
    lengths, counts = np.unique(rng.lognormal(6, 1.5, 3000).astype(int), return_counts=True)
    hist = list(zip(lengths.tolist(), counts.tolist(), strict=True))
    # the same programme, cost by cost
    best = [0] + [10**18] * len(hist)
    for _ in range(8):
        new = best[:]
        for j in range(1, len(hist) + 1):
            pad = 0
            for i in range(j - 1, max(-1, j - 900), -1):
                pad += (hist[j - 1][0] - hist[i][0]) * hist[i][1]
                if pad >= new[j]:
                    break
                new[j] = min(new[j], best[i] + pad)
        best = new
    assert padding(hist, packing.boundaries(hist, 8)) == best[-1]
    t = time.perf_counter()
    packing.boundaries([(k, 1 + k % 7) for k in range(200_000)], 8)
    assert time.perf_counter() - t < 20


def test_packed(spark):
    rows, d = corpus(spark)
    got = packing.packed(d, buckets=3, token_budget=1000, shard_rows=4).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(tokens(t)) for i, t in rows}
    batches = {}
    for r in got:
        assert r.n_tokens <= r.bucket_len
        batches.setdefault((r.bucket, r.bucket_len, r.batch), []).append(r.slot)
    for (_, size, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == 1 or len(slots) * size <= 1000)
    for bucket in {b for b, _, _ in batches}:
        own = sorted((n, len(s), size) for (b, size, n), s in batches.items() if b == bucket)
        assert all(count == max(1, 1000 // max(1, size)) for _, count, size in own[:-1])
    assert packing.packed(empty(spark)).collect() == []


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15
            if ok:
                out[kind].append(m.span())
    return out


def test_base_spans_are_the_plain_ones():
    rng = random.Random(8)
    pieces = ["a.b@c.de", "@", "x@y", "x@y.z@w.v", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "+1 (415) 555-0100", "+12", "4111 1111 1111 1111", "4111111111111112", "+", "-", " ", "é", ".", "00012.1.1.1", "%", "12-34", "("]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        assert pii.detect(text) == base_spans(text), text


@pytest.mark.parametrize(("text", "kind", "hidden"), [
    ("mail jane (at) example (dot) org now", "email", "jane (at) example (dot) org"),
    ("mail jane.doe [at] example.org now", "email", "jane.doe [at] example.org"),
    ("mail jane at example dot org now", "email", "jane at example dot org"),
    ("mail jоhn@exаmple.com now", "email", "jоhn@exаmple.com"),
    ("call plus one four one five five five five zero one zero zero now", "phone", "plus one four one five five five five zero one zero zero"),
    ("call ＋１ 415 555 ０１００ now", "phone", "＋１ 415 555 ０１００"),
    ("host 10 dot 0 dot 0 dot 7 is up", "ip", "10 dot 0 dot 0 dot 7"),
    ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
])
def test_disguises(text, kind, hidden):
    base, full = pii.spans(text)
    assert base == base_spans(text)
    assert [text[a:b] for a, b in full[kind]] == [hidden]


@pytest.mark.parametrize("hidden", [
    *(f"jane{a}{gap}{w}{gap}{b}example.org" for a, b in ("[]", "()", "{}", "<>") for gap in ("", " ", "\n") for w in ("at", "@")),
    *(f"jane@example{a}{gap}{w}{gap}{b}org" for a, b in ("[]", "()", "{}", "<>") for gap in ("", " ", "\n") for w in ("dot", ".", "punkt", "point", "punto")),
    "jane at example\ndot\norg", "jane at example\tdot  org", "JANE AT EXAMPLE DOT\nORG", "192(point)168(point)1(point)7", "10\ndot\n0\ndot\n0\ndot\n7",
])
def test_a_disguise_is_found_alone(hidden):
    base, full = pii.spans(f"to {hidden} now")
    assert not any(base.values()) and [f"to {hidden} now"[a:b] for own in full.values() for a, b in own] == [hidden]


@pytest.mark.parametrize(("text", "kind", "fragment", "whole"), [
    ("to jоhn@example.com now", "email", "hn@example.com", "jоhn@example.com"),
    ("to john@example.cоm now", "email", "john@example.c", "john@example.cоm"),
    ("to john@example.co (dot) uk now", "email", "john@example.co", "john@example.co (dot) uk"),
    ("to +49 170 1234 ５６７８ now", "phone", "+49 170 1234", "+49 170 1234 ５６７８"),
    ("to ４.1.2.3.4@example.com now", "email", ".1.2.3.4@example.com", "４.1.2.3.4@example.com"),
])
def test_partly_disguised(spark, text, kind, fragment, whole):
    base, full = pii.spans(text)
    assert base == base_spans(text) and fragment in [text[a:b] for a, b in base[kind]]
    assert {fragment, whole} <= {text[a:b] for a, b in full[kind]} and all(set(base[k]) <= set(full[k]) for k in base)
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.text for r in pii.masked(d).collect()] == [f"to <{kind}> now"]
    r = pii.personal_data(d).collect()[0]
    assert (r[f"n_{kind}"], r[f"n_added_{kind}"]) == (1, 1) and r.base_sha256 == hashlib.sha256(pii._listed(base).encode()).hexdigest()


def test_texts_that_skip_the_transducers_have_nothing_to_rewrite():
    rng = random.Random(3)
    pieces = ["jane", "@", " at ", "(", ")", "{", "]", "<", ">", "at", "AT", "dot", "DOT", ".", "point", "punkt", "punto", " ", "\n", "ex", "org", "10", "7", "one", "nine", "plus", "о", "\u200b"]
    for _ in range(20000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert pii.disguised(text) or pii.deobfuscated(text) in (pii.detect(text), {k: [] for k in pii.KINDS}), text


def test_clean_text_has_no_spans():
    for text in ("", "He was at home and made one, two, three stops.", "look at dot and spot", "version 1.2.3 of 2024", "привет мир"):
        assert not any(pii.spans(text)[1].values()), text


def test_personal_data(spark):
    rows, d = corpus(spark, ["a@b.co 1.2.3.4 a@b.co"])
    got = {r.doc_id: r for r in pii.personal_data(d).collect()}
    for i, t in rows:
        base = base_spans(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in base[k])
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and got[i].n_email == len(base["email"])
    assert pii.personal_data(empty(spark)).collect() == []
    assert [r.text for r in pii.masked(spark.createDataFrame([(1, "to a@b.co!")], "doc_id long, text string")).collect()] == ["to <email>!"]


def test_rules(spark):
    cases = {
        "http://a.com": ("a.com", "", None, "allow"), "https://A.Com/x?y#z": ("a.com", "/x", "com/", "allow"), "http://example.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"), "http://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "http://x.net/fr/1": ("x.net", "/fr/1", "net/fr/", "block"),
        "http://x.net/de/1": ("x.net", "/de/1", None, "allow"), "nothing": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    }
    d = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(d, queries.RULES).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judged(d.limit(0), queries.RULES).collect() == []


def test_templates_and_purity(spark):
    rows = [("s.org", f"/ads/{k}", "block" if k < 30 else None) for k in range(60)] + [("s.org", f"/blog/post-{chr(97 + k % 26)}{k}", "allow" if k < 30 else None) for k in range(60)]
    d = spark.createDataFrame(rows, "host string, path string, said string")
    t = urls.templates(d, d.count())
    assert {tuple(r.template) for r in t.collect()} == {("ads", "{n}"), ("blog", "{*}")}
    rules = [("s.org", f"/ads/{k}", "block") for k in range(10, 40)]
    pages = spark.createDataFrame([(i, f"http://s.org/ads/{i}") for i in range(100, 130)] + [(k, f"http://s.org/ads/{k}") for k in range(10, 40)] + [(999, "http://s.org/blog/a")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judged(pages, rules).collect()}
    assert got[125] == "block" and got[999] == "allow"


def test_labels_reach_open_branches(spark):
    rules = [("s.org", "/es/", "block"), ("s.org", "/old/", "allow"), ("t.org", "/a/", "block"), ("t.org", "/b/", "allow"), *(("v.org", f"/c{k}/", "block") for k in range(12))]
    said = [f"s.org/es/{k}" for k in range(20)] + [f"s.org/old/x{k % 2}/y" for k in range(20)] + [f"t.org/{b}/{k}" for b in "ab" for k in range(20)]
    said += [f"v.org/c{b}/k{b}/{k}" for b in range(12) for k in range(5)]
    asked = {"s.org/en/7": "block", "s.org/de/8": "block", "s.org/old2/x0/y": "allow", "s.org/other/page/one": "allow", "t.org/c/9": "allow", "u.org/en/7": "allow", "v.org/new/page": "block", "v.org": "block"}
    deep = [f"w.org/{'/'.join('abcde')}/{s}/{k}" for s in ("bad", "good") for k in range(30)]
    rules += [("w.org", "/a/b/c/d/e/bad/1", "block"), ("w.org", "/a/b/c/d/e/bad/2", "block"), ("w.org", "/a/b/c/d/e/good", "allow")]
    asked |= {"w.org/a/b/c/d/e/bad/3": "block"}
    every = [*said, *deep, *asked]
    d = spark.createDataFrame([(k, "http://" + u) for k, u in enumerate(every)], "page_id long, url string")
    got = {every[r.page_id]: (r.rule, r.verdict, r.share) for r in urls.judged(d, rules).collect()}
    assert len(got) == len(set(every)) and got["u.org/en/7"][2] < 0.8
    assert {u: got[u][1] for u in asked} == asked
    assert got["w.org/a/b/c/d/e/bad/3"][0] is None


def test_main_text(spark):
    m = html.train([])
    say = "The committee met on Tuesday to discuss the budget for the coming year, and members agreed on most points."
    page = f'<html><body><div class="menu"><a href=x>Home</a></div><div class="post"><h1>A&amp;B</h1><p>{say}<p>x&nbsp;&lt;y&gt;\n z<script>var t="</p>"</script></div><div class="sidebar"><p>{say}</p></div><div class="comments"><p>{say}</p></div><form><p>{say}</p></form><footer>{say}</footer>'
    want = f"A&B\n\n{say}\n\nx <y> z"
    assert html.main_text(page, m) == want
    d = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (None, "u", "", "t"), (3, "u", "<<<>< <p", "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html.main_texts(d, m).collect()}
    assert got[1] == ("u", want, len(want)) and got[2] == (None, "", 0) and got[None] == ("u", "", 0)
    assert html.main_texts(d.limit(0), m).collect() == []


def test_marginals_are_those_of_enumeration():
    m = html.Model(np.random.default_rng(0).normal(0, 1, html.WIDTH), np.log([[[0.9, 0.1], [0.2, 0.8]], [[0.7, 0.3], [0.6, 0.4]]]).tolist())
    nodes = html.parse("<div><p>one two</p><div class=ad><p>three</p></div><ul><li>x</li></ul></div>")
    odds = [sum(m.weights[k] * v for k, v in f) for f in html.evidence(nodes)]
    kind = html.kinds(nodes)
    assert set(kind) == {0, 1}
    total, one = 0.0, np.zeros(len(nodes))
    for bits in range(2 ** len(nodes)):
        y = [bits >> i & 1 for i in range(len(nodes))]
        p = np.exp(sum(o for o, b in zip(odds, y, strict=True) if b) + sum(m.edge[kind[i]][y[n.parent]][y[i]] for i, n in enumerate(nodes) if n.parent >= 0))
        total += p
        one += p * np.array(y)
    assert m.marginals(nodes) == pytest.approx((one / total).tolist())


def test_machine_equals_pairwise_sum():
    m = quality.Machine()
    rng = np.random.default_rng(1)
    m.w, m.v, m.w0 = rng.normal(size=quality.DIM), rng.normal(size=(quality.DIM, quality.RANK)), 0.3
    idx, val = np.array([3, 7, 11, 200]), np.array([0.5, 1.0, -2.0, 0.1])
    want = 0.3 + m.w[idx] @ val + sum((m.v[a] @ m.v[b]) * x * y for (a, x), (b, y) in combinations(list(zip(idx, val, strict=True)), 2))
    assert m.logit(idx, val) == pytest.approx(want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op6_quality(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.97
    docs = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    rows = quality.scored(docs, quality.train(docs, labels.limit(0))).collect()
    assert [(r.score, r.held_out) for r in rows if r.doc_id is None] == [(0.5, False)]


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, "x"), (None, "", "", "x")], "page_id long, url string, html string, lang string")
    assert langid.languages_of(odd, docs).count() == 2
    assert [r.lang for r in langid.languages_of(odd, docs.limit(0)).collect()] == [None, None]
    assert langid.languages_of(odd.limit(0), docs).collect() == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        assert kept.count() <= before.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows}) == len(rows)
    comp = components(rows, 5, 80)
    assert all(c == i for i, (_, c) in comp.items())
    assert corpus_pipeline.run(spark, SF).count() == len(rows)
