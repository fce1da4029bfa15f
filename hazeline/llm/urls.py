"""URL filter: rules first, then a path-template tree, all in DataFrame functions.

Each host has a tree of path segments. A segment whose shape is variable (numbers, hashes, dates), or that stands under a
parent whose children are nearly all different, becomes a wildcard. Sibling branches with alike counts of children form a
group, labelled or not, and pool their labels; branches with the same template pool them over all hosts. A template is
rejected when its smoothed share of bad labels reaches a bound: all labels, then those of the domain, of the first segment
and of the template over all hosts, and then of the host and its own branches, each smoothed to the one before.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import with_facts
from hazeline.session import materialize

#: (host, path, verdict)
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule as written, its verdict) of the longest rule that fits, else nulls. Rules are configuration: at most 256."""
    if len(rules) > 256:
        raise ValueError("rules are tested one after the other; give at most 256")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """A wildcard for numbers, dates, hashes and slugs with numbers; the segment itself otherwise."""
    return (
        F.when(segment.rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$"), "{n}")
        .when(segment.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(segment.rlike(r"^[0-9a-fA-F-]{16,}$"), "{hash}")
        .when(segment.rlike(r"[0-9]{3,}"), "{slug}")
        .otherwise(segment)
    )


def templates(urls: DataFrame, total: int, least: int = 20, variety: float = 0.5) -> DataFrame:
    """urls(host, path, ...), of total rows, with the column template: an array of all segments, generalised level by level.

    A child segment becomes {*} where its parent has at least `least` urls and more than `variety` different children a
    url. Counts of (parent, segment) are made before they are counted by parent, so a hot host is summed in every task.
    Rows whose parent has fewer than `least` urls end there: below it no parent has more, and shapes say all.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    x = urls.withColumn("_seg", segments).withColumn("template", F.array().cast("array<string>"))
    finished, level = [], 0
    while True:
        at = x.withColumn("_s", F.when(F.size("_seg") > level, shape(F.get("_seg", F.lit(level)))))
        children = at.where("_s IS NOT NULL").groupBy("host", "template", "_s").agg(F.count("*").alias("n"))
        parents = children.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
        wide = (F.col("n") >= least) & (F.col("kinds") > variety * F.col("n"))
        parents = materialize(parents.where(F.col("n") >= least).select("host", "template", F.col("n").alias("rows"), wide.alias("_wide")), "url-parents")
        rest = F.transform(F.slice("_seg", level + 1, 1 << 30), shape)
        if parents.isEmpty():
            finished.append(x.withColumn("template", F.concat("template", rest)).drop("_seg"))
            return reduce(DataFrame.unionByName, finished)
        # Only rows under a large parent go on to the next level: a few very deep paths don't make all rows pass again.
        x = with_facts(at, parents, ["host", "template"], total)
        x = x.withColumn("_on", F.col("_wide").isNotNull() & F.col("_s").isNotNull())
        step = F.concat("template", F.array(F.when(F.col("_wide"), "{*}").otherwise(F.col("_s"))))
        x = x.withColumn("template", F.when(F.col("_on"), step).otherwise(F.concat("template", rest)))
        x = materialize(x.drop("_wide", "_s"), "url-levels")
        finished.append(x.where("NOT _on").drop("_seg", "_on"))
        x = x.where("_on").drop("_on")
        level += 1


def branches(counts: DataFrame, total: int, likeness: float = 0.9) -> DataFrame:
    """(host, prefix, rows, n, bad, group, pn, pb): every branch of counts(host, template, rows, n, bad), its group of
    siblings, and the labels of the whole group.

    Siblings with the same most frequent child are compared with the largest of them, labelled or not: those whose counts
    of children have a cosine of at least likeness with its counts join its group. Leaves have no children and stay alone.
    """
    cells = counts.select("*", F.posexplode("template").alias("_k", "_s")).select("host", F.slice("template", 1, F.col("_k") + 1).alias("prefix"), F.get("template", F.col("_k") + 1).alias("child"), "rows", "n", "bad")
    cells = materialize(cells.groupBy("host", "prefix", "child").agg(*(F.sum(c).alias(c) for c in ("rows", "n", "bad"))), "url-cells")
    inner = F.when(F.col("child").isNotNull(), F.col("rows"))
    b = cells.groupBy("host", "prefix").agg(*(F.sum(c).alias(c) for c in ("rows", "n", "bad")), F.sqrt(F.sum(inner * inner.cast("double"))).alias("norm"), F.max_by("child", F.struct(inner, "child")).alias("top"))
    b = materialize(b.withColumn("parent", F.slice("prefix", 1, F.size("prefix") - 1)), "url-branches")
    first = F.struct("rows", "prefix")
    leads = b.where("top IS NOT NULL").groupBy("host", "parent", "top").agg(F.max_by("prefix", first).alias("lead"), F.max_by("norm", first).alias("lead_norm"), F.sum("rows").alias("rows"))
    led = materialize(with_facts(b, materialize(leads, "url-leads"), ["host", "parent", "top"], total), "url-led")
    own = cells.where("child IS NOT NULL").select("host", "prefix", "child", F.col("rows").alias("c"))
    x = with_facts(own, led.select("host", "prefix", "lead", "rows"), ["host", "prefix"], total)
    shared = x.groupBy("host", "lead", "child").agg(F.sum("c").alias("rows"))
    theirs = shared.join(own.select("host", F.col("prefix").alias("lead"), "child", F.col("c").alias("lead_c")), ["host", "lead", "child"])
    x = with_facts(x, materialize(theirs, "url-shared"), ["host", "lead", "child"], total)
    dots = x.groupBy("host", "prefix").agg(F.sum(F.col("c").cast("double") * F.col("lead_c")).alias("dot"))
    g = led.join(dots, ["host", "prefix"], "left")
    alike = F.col("dot") >= likeness * F.col("norm") * F.col("lead_norm")
    g = materialize(g.select("host", "prefix", "rows", "n", "bad", F.when(alike, F.col("lead")).otherwise(F.col("prefix")).alias("group")), "url-groups")
    pools = g.groupBy("host", "group").agg(F.sum("rows").alias("rows"), F.sum("n").alias("pn"), F.sum("bad").alias("pb"))
    return with_facts(g, materialize(pools, "url-pools"), ["host", "group"], total)


def pooled(counts: DataFrame, total: int, weight: float, prior: float) -> DataFrame:
    """counts(host, template, rows, n, bad) with over_all, the smoothed share of bad labels of each template over all hosts,
    and level, the narrowest of these pools that has a label (null if none has any). Each host's template is one voice, by
    its share, however many urls it has."""
    x = counts.withColumn("voice", F.col("bad") / F.nullif("n", F.lit(0)))
    n, bad = x.agg(F.count("voice"), F.coalesce(F.sum("voice"), F.lit(0.0))).first()
    x = x.withColumns({"domain": F.substring_index("host", ".", -2), "first": F.coalesce(F.get("template", F.lit(0)), F.lit(""))})
    share, level = F.lit((bad + weight * prior) / (n + weight)), F.when(F.lit(n > 0), "all")
    for key in ("domain", "first", "template"):
        facts = x.groupBy(key).agg(F.count("*").alias("rows"), F.count("voice").alias(f"n_{key}"), F.coalesce(F.sum("voice"), F.lit(0.0)).alias(f"bad_{key}"))
        x = with_facts(x.withColumnRenamed("rows", "_rows"), materialize(facts, "url-pool"), [key], total).withColumnRenamed("_rows", "rows")
        share = (F.col(f"bad_{key}") + weight * share) / (F.col(f"n_{key}") + weight)
        level = F.when(F.col(f"n_{key}") > 0, key).otherwise(level)
    return x.select(*counts.columns, share.alias("over_all"), level.alias("level"))


def shares(counts: DataFrame, total: int, weight: float = 4.0, prior: float = 0.5) -> DataFrame:
    """(host, template, rows, share, level) of counts(host, template, rows, n, bad): the url counts of each template, among
    them those with a label and the bad ones. share is null only if there is no label at all; level says which labels are
    the nearest: host, template, first (segment), domain or all.

    From the pools over all hosts to the host and down its branches, each share is smoothed to the one before. A branch
    counts the labels of its whole group, unless its own share differs from the group's by more than two standard errors;
    then it counts its own. A host counts each labelled group of first segments once, by its share: urls of one branch say
    little of unlike ones.
    """
    b = materialize(branches(counts, total), "url-pooled")
    p = F.col("pb") / F.nullif("pn", F.lit(0))
    error = F.sqrt(p * (1 - p) * (1 / F.nullif("n", F.lit(0)) + 1 / F.nullif("pn", F.lit(0))))
    apart = F.coalesce(F.abs(F.col("bad") / F.nullif("n", F.lit(0)) - p) > 2 * error, F.lit(False))
    b = b.withColumn("said", F.struct(F.when(apart, F.col("n")).otherwise(F.col("pn")).cast("double").alias("n"), F.when(apart, F.col("bad")).otherwise(F.col("pb")).cast("double").alias("bad")))
    b = materialize(b.select("host", "prefix", "group", "rows", "said"), "url-said")
    kinds = b.where((F.size("prefix") == 1) & (F.col("said.n") > 0)).groupBy("host", "group", "said").agg(F.lit(1).alias("one"))
    hosts = kinds.groupBy("host").agg(F.count("*").alias("hn"), F.sum(F.col("said.bad") / F.col("said.n")).alias("hb"))
    labels = counts.groupBy("host").agg(F.count("*").alias("rows"), F.sum("n").alias("labels"))
    hosts = labels.join(hosts, "host", "left").select("host", "rows", "labels", F.coalesce("hb", F.lit(0.0)).alias("hb"), F.coalesce("hn", F.lit(0)).alias("hn"))
    steps = counts.select("host", "template", F.posexplode("template").alias("_k", "_s")).withColumn("prefix", F.slice("template", 1, F.col("_k") + 1))
    steps = with_facts(steps, b.select("host", "prefix", "rows", "said"), ["host", "prefix"], total)
    chains = steps.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("_k", "said"))).alias("chain"))
    x = pooled(counts, total, weight, prior).withColumnRenamed("rows", "urls")
    x = with_facts(x, materialize(hosts, "url-hosts"), ["host"], total).join(chains, ["host", "template"], "left")
    chain = F.coalesce("chain", F.array().cast("array<struct<_k:int,said:struct<n:double,bad:double>>>"))
    base = (F.col("hb") + weight * F.col("over_all")) / (F.col("hn") + weight)
    share = F.aggregate(chain, base, lambda up, s: (s.said.bad + weight * up) / (s.said.n + weight))
    return x.select("host", "template", F.col("urls").alias("rows"), F.when(F.col("level").isNotNull(), share).alias("share"), F.when(F.col("labels") > 0, "host").otherwise(F.col("level")).alias("level"))


def judged(pages: DataFrame, rules: list[Rule], bound: float = 0.8, id_col: str = "page_id") -> DataFrame:
    """One row per row of pages(page_id, url): page_id, host, path, rule, verdict, template, share, level.

    The longest rule that fits decides. Urls that rules decide are the labels of the tree; any other url gets block when
    the smoothed bad share of its template reaches bound, and allow otherwise. level names the labels nearest to it (see
    shares). Without any label in the table all are allowed, with null share and level. A null url, or one without ://, has
    empty host and path and is judged like any other. Rows that repeat are judged each; a null page_id stays null. Other
    columns are left out whatever their names; an empty table gives no rows.
    """
    u = pages.select(F.col(id_col).alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    total = pages.count()
    t = templates(u.withColumn("rule", name).withColumn("_said", verdict), total)
    counts = t.groupBy("host", "template").agg(F.count("*").alias("rows"), F.count("_said").alias("n"), F.count_if(F.col("_said") == "block").alias("bad"))
    own = materialize(shares(materialize(counts, "url-counts"), total), "url-shares")
    x = with_facts(t, own, ["host", "template"], total)
    method = F.when(F.col("share") >= bound, "block").otherwise("allow")
    return x.select("page_id", "host", "path", "rule", F.coalesce("_said", method).alias("verdict"), F.concat(F.lit("/"), F.concat_ws("/", "template")).alias("template"), "share", "level")
