"""Languages of texts whose pages declare nothing, and the fusion against a plain version."""

import math
import re
import time
from collections import Counter

import numpy as np
import pytest

from hazeline.llm import langid

SF = "/root/testdata/sf0.001"
#: what is no text, in one pattern that takes quadratic time on broken pages
_TAG = re.compile(rb"(?is)<(script|style|title)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;")


def test_languages_of_texts_that_declare_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 AND size(split(text, ' ')) >= 30 AND lang IS NOT NULL")
    pages = held.selectExpr("doc_id AS page_id", "concat('http://host', doc_id, '.example/') AS url", "concat('<p>', text) AS html", "lang AS truth")
    got = {r.page_id: r.lang for r in langid.languages_of(pages, train).collect()}
    truth = {r.page_id: r.truth for r in pages.collect()}
    assert len(set(truth.values())) == 4
    assert sum(got[k] == v for k, v in truth.items()) / len(truth) > 0.95


def plainly(pages, names, table, strength=10.0, temper=1.0):
    rows = []
    for page_id, url, html in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        declared = (re.search(r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", html or "") or ["", ""])[1].lower()
        code = (re.match(r"^/([a-z]{2})(?:[/-]|$)", path) or ["", ""])[1]
        cells = langid.trigrams(_TAG.sub(b" ", (html or "").encode()))
        ll = table[:, cells].sum(axis=1, dtype=np.float64) * temper / math.sqrt(len(cells)) if len(cells) else None
        rows.append((page_id, host, host.split(".")[-1], declared, code, ll, None if ll is None else int(np.argmax(ll))))
    out = {}
    for k, (page_id, host, tld, declared, code, ll, _) in enumerate(rows):
        others = [r for i, r in enumerate(rows) if i != k and r[6] is not None]
        count = lambda p, i, others=others: sum(p(r) and r[6] == i for r in others)
        size = lambda p, others=others: sum(bool(p(r)) for r in others)
        kinds = [max(1, len({r[c] for r in rows if r[6] is not None})) for c in (3, 4)]
        lp = []
        for i in range(len(names)):
            every = count(lambda r: True, i)
            p = (every + 1) / (size(lambda r: True) + len(names))
            p = (count(lambda r, t=tld: r[2] == t, i) + strength * p) / (size(lambda r, t=tld: r[2] == t) + strength)
            p = (count(lambda r, h=host: r[1] == h, i) + strength * p) / (size(lambda r, h=host: r[1] == h) + strength)
            said = [math.log((count(lambda r, c=c, v=v: r[c] == v, i) + 0.5) / (every + 0.5 * n)) for c, v, n in ((3, declared, kinds[0]), (4, code, kinds[1]))]
            lp.append((0 if ll is None else ll[i]) + math.log(p) + sum(said))
        out[page_id] = (names[int(np.argmax(lp))], 1 / sum(math.exp(x - max(lp)) for x in lp))
    return out


def test_fusion_is_that_of_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect()]
    rows += [(1001, None, None), (1002, "http://x.example/fr/", ""), (1003, "http://x.example/de-de/1", "<html lang=xx>"), (1004, rows[0][1], "<html lang='de'><p>der die das und nicht " * 20)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, lang string, code int").repartition(4)
    names, table = langid.text_models(docs)
    want = plainly(rows, names, table)
    got = {r.page_id: (r.lang, r.posterior) for r in langid.languages_of(frame, docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], rel=1e-6) for k in want)
    assert len(Counter(v[0] for v in got.values())) > 1


def test_more_languages_than_a_few(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = [(k, " ".join([letters[k % 26] * 3 + letters[k // 26] * 2] * 50), f"l{k:02d}") for k in range(40)]
    pages = spark.createDataFrame([(k, "http://h.org/", t) for k, t, _ in docs], "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in langid.languages_of(pages, spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert sum(got[k] == name for k, _, name in docs) >= 38


def test_repeats_and_long_pages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pages = spark.createDataFrame([(1, "http://h.org/", "the of and " * 200_000), (1, "http://h.org/", "the of and"), (1, "http://h.org/", "the of and"), (None, None, "der die das")], "page_id long, url string, html string")
    assert langid.languages_of(pages, docs).count() == 4


def test_tags_are_cut_as_by_the_plain_pattern(spark):
    pages = [(r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages += [b"a<!-- b > c -->d", b"x<SCRIPT>if (a < b) y</Script >z", b"a < b &amp; c", b"<p>1</p", b"<!-->x-->y", b"a<title>b</titles></title>c", b"", b"&lt;&#33;&x"]
    for page in pages:
        assert list(langid.trigrams(langid.spoken(page))) == list(langid.trigrams(_TAG.sub(b" ", page))), page


@pytest.mark.parametrize("bit", [b"<script>", b"<style>", b"<title>", b"<!--", b"<", b"</script ", b"<script>x</script", b"<!-->", b"&a"])
@pytest.mark.parametrize("tail", [b"", b">"])
def test_broken_pages_take_linear_time(bit, tail):
    t = time.perf_counter()
    langid.spoken(bit * 20_000 + tail)
    assert time.perf_counter() - t < 1


def test_broken_pages_in_spark(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bits = ["<script>", "<style>", "<title>", "<!--", "<html ", "<html lang"]
    pages = spark.createDataFrame([(k, "http://a.example/", b * 20_000) for k, b in enumerate(bits)], "page_id long, url string, html string")
    t = time.perf_counter()
    assert len(langid.languages_of(pages, docs).collect()) == len(bits)
    assert time.perf_counter() - t < 60
