"""Language identification by Bayesian evidence fusion.

log P(language | page) = log host prior + tempered log text likelihood + log P(declared language | language)
+ log P(path's language code | language), normalised over the languages.

Text likelihoods are byte-trigram models of labelled documents. The tables for declared language and code, and the host
priors (host, smoothed to its domain suffix, smoothed to all pages), come from grouped counts of what the texts alone say,
over all pages; each page's own count is taken out before they judge it, so no page confirms itself. The domain suffix
speaks through the host prior, the code in the path through its own table: nothing counts twice.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import NO_ID, batches_of, utf8, with_facts
from hazeline.llm.urls import host_of, path_of
from hazeline.session import materialize

CELLS = 1 << 14
_MARK = re.compile(rb"(?i)<!--|<(script|style|title)\b|<[^>]*>|&[#\w]+;")
_ENTITY = re.compile(rb"&[#\w]+;")
_CLOSER = {k: re.compile(rb"(?i)</%s\s*>" % k) for k in (b"script", b"style", b"title")}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def spoken(page: bytes) -> bytes:
    """The page without tags, comments, character references, and what stands in script, style and title elements. One scan
    forward, linear on any input: what is opened and never closed goes on to the end of the page."""
    out, p, last = [], 0, page.rfind(b">") + 1  # no tag begins after the last >, so none is looked for there
    while m := _MARK.search(page, p, last):
        out.append(page[p : m.start()])
        p = m.end()
        if m[0] == b"<!--":
            p = page.find(b"-->", p) + 3
            if p < 3:
                return b" ".join(out)
        elif m[1]:
            end = _CLOSER[m[1].lower()].search(page, p)
            if not end:
                return b" ".join(out)
            p = end.end()
    out.append(_ENTITY.sub(b" ", page[p:].partition(b"<!--")[0]))
    return b" ".join(out)


def trigrams(text: bytes) -> np.ndarray:
    """Cells of the byte trigrams of letters, lower-cased, runs of others as one space."""
    raw = np.frombuffer(text.lower(), np.uint8)
    letter = _LETTER[raw]
    keep = letter | np.append(True, letter[:-1])[: len(raw)]
    b = np.where(letter, raw, 32)[keep].astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    return (((b[:-2] * 961 + b[1:-1]) * 961 + b[2:]) * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)


def _count(batches):
    """Trigram counts of a task's documents, for the languages and cells that it has."""
    total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CELLS, np.int64))
    for langs, texts in batches_of(batches, ["lang", "content"]):
        for k, text in zip(langs, texts, strict=True):
            total[k] += np.bincount(trigrams(text), minlength=CELLS)
    for k, v in total.items():
        at = np.flatnonzero(v)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at)), pa.array(at), pa.array(v[at])], ["lang", "cell", "n"])


def text_models(docs: DataFrame, sample: int = 4000) -> tuple[list[str], np.ndarray]:
    """All languages that documents declare and log P(trigram cell | language), from about sample labelled documents a
    language, those with the smallest hashes. A model is 64 KB, and the driver gets one row a language."""
    d = docs.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc"), utf8("text").alias("content"))
    sizes = d.groupBy("lang").agg(F.count("*").alias("size"))
    # The share of hashes that holds about the sample: one filter, no ranking of a language's documents.
    draw = F.pmod(F.xxhash64("doc", "content"), F.lit(1 << 20)) < F.least(F.lit(1.0), sample / F.col("size")) * (1 << 20)
    chosen = d.join(F.broadcast(sizes), "lang").where(draw).select("lang", "content")
    counted = chosen.mapInArrow(_count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("lang").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("n"))
    found = {r["lang"]: r for r in sizes.join(rows, "lang", "left").toLocalIterator()}
    names = sorted(found)
    counts = np.full((len(names), CELLS), 0.05)
    for i, k in enumerate(names):
        if found[k]["cells"]:
            counts[i, found[k]["cells"]] += found[k]["n"]
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihood(model, temper: float):
    def run(batches):
        table = model.value
        for ids, pages in batches_of(batches, ["page", "content"]):
            ll = []
            for html in pages:
                cells = trigrams(spoken(html))
                # trigrams of a text are far from independent: evidence grows with the root of their number
                ll.append((table[:, cells].sum(axis=1, dtype=np.float64) * temper / np.sqrt(len(cells))).tolist() if len(cells) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ll, pa.list_(pa.float64()))], ["page", "ll"])

    return run


def languages_of(pages: DataFrame, docs: DataFrame, sample: int = 4000, temper: float = 1.0, strength: float = 10.0) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, host, declared, suffix, lang, posterior.

    docs(doc_id, text, lang) gives the languages and their text models. declared is the markup's lang attribute; suffix is
    the last label of the host and the first path segment where that is a language code. A page without text, markup or
    address (nulls too) falls back on what is left, at last on the shares of all pages; ties go to the language first in
    the alphabet. Without any labelled document lang is null. A null page_id comes back as null; rows that repeat are
    judged each. Other columns are left out whatever their names; an empty table gives no rows.
    """
    spark = pages.sparkSession
    names, table = text_models(docs, sample)
    tag = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*", 0)
    declared = F.lower(F.regexp_extract(tag, r"(?i)\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    code = F.regexp_extract(path_of(F.col("url")), r"^/([a-z]{2})(?:[/-]|$)", 1)
    suffix = F.concat_ws("/", F.substring_index("host", ".", -1), "code").alias("suffix")
    if not names:
        empty = pages.select("page_id", host_of(F.col("url")).alias("host"), declared.alias("declared"), code.alias("code"))
        return empty.select("page_id", "host", "declared", suffix, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"))

    model = spark.sparkContext.broadcast(table)
    keyed = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page"), "url", "html")
    # What is known of a page rides in the one Python pass beside its text, so no join on page ids is needed.
    known = keyed.select("page", utf8("html").alias("content"), host_of(F.col("url")).alias("host"), declared.alias("declared"), code.alias("code"))

    def run(batches):
        ll = _likelihood(model, temper)
        for b in batches:
            for out in ll([b]):
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("page", "host", "declared", "code")), out.column(1)], ["page", "host", "declared", "code", "ll"])

    seen = materialize(known.mapInArrow(run, "page long, host string, declared string, code string, ll array<double>"), "langid")
    k = len(names)
    # what the text alone says; null where there is no text, and then it counts nowhere
    guess = seen.withColumn("g", F.array_position("ll", F.array_max("ll")).cast("int") - 1)
    voices = guess.where("g IS NOT NULL")
    whole = [0] * k
    for r in voices.groupBy("g").count().collect():  # a row a language
        whole[r["g"]] = r["count"]
    n = sum(whole)

    def tally(counts: DataFrame, key: str, name: str) -> DataFrame:
        """(key, name: map of language to count, name_n: their sum) of counts(key, g, n)."""
        return counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("g", "n"))).alias(name), F.sum("n").alias(f"{name}_n"))

    per_host = materialize(guess.groupBy("host", "g").agg(F.count("*").alias("n")), "langid-hosts")
    hosts = per_host.groupBy("host").agg(F.sum("n").alias("urls")).withColumn("tld", F.substring_index("host", ".", -1))
    per_domain = per_host.where("g IS NOT NULL").groupBy(F.substring_index("host", ".", -1).alias("tld"), "g").agg(F.sum("n").alias("n"))
    hosts = materialize(hosts, "langid-hosts")
    domains = tally(per_domain, "tld", "t").join(hosts.groupBy("tld").agg(F.count("*").alias("rows")), "tld")
    hosts = with_facts(hosts, materialize(domains, "langid-domains"), ["tld"], hosts.count()).withColumnRenamed("urls", "rows").drop("tld")
    hosts = hosts.join(tally(per_host.where("g IS NOT NULL"), "host", "h"), "host", "left")
    x = with_facts(guess, materialize(hosts, "langid-hosts"), ["host"], guess.count(), small=20_000)
    # two or three letters: at most 18,954 declared values and 677 codes, with a map of at most k counts each
    for key, name in (("declared", "d"), ("code", "c")):
        table_ = tally(voices.groupBy(key, "g").agg(F.count("*").alias("n")), key, name)
        x = x.join(F.broadcast(table_), key, "left")
    kinds = {key: max(1, voices.select(key).distinct().count()) for key in ("declared", "code")}

    own_n = F.col("g").isNotNull().cast("int")
    all_ = F.array(*map(F.lit, whole))

    def fused(ll, i):
        own = F.coalesce((F.col("g") == i).cast("int"), F.lit(0))
        at = lambda m: F.coalesce(F.try_element_at(F.col(m), i), F.lit(0)) - own
        size = lambda m: F.coalesce(F.col(f"{m}_n"), F.lit(0)) - own_n
        every = F.get(all_, i) - own
        p = (every + 1.0) / (F.lit(n) - own_n + k)
        p = (at("t") + strength * p) / (size("t") + strength)
        p = (at("h") + strength * p) / (size("h") + strength)
        said = lambda m, v: F.log((at(m) + 0.5) / (every + 0.5 * v))
        return ll + F.log(p) + said("d", kinds["declared"]) + said("c", kinds["code"])

    ll = F.coalesce("ll", F.array_repeat(F.lit(0.0), k))
    x = x.withColumn("lp", F.transform(ll, fused)).withColumn("top", F.array_max("lp"))
    x = x.withColumn("posterior", 1 / F.aggregate("lp", F.lit(0.0), lambda s, y: s + F.exp(y - F.col("top"))))
    lang = F.element_at(F.array(*map(F.lit, names)), F.array_position("lp", F.col("top")).cast("int"))
    return x.select(F.when(F.col("page") != NO_ID, F.col("page")).alias("page_id"), "host", "declared", suffix, lang.alias("lang"), "posterior")
