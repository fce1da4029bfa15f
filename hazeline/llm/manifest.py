"""Merkle manifest of a table, with a proof for every row by pointer jumping.

Rows of a group are leaves in order of their id; each run of `fan` nodes becomes the hash of theirs, until one is left, and the
groups' roots are hashed likewise to the root. Every node then holds the siblings on the way to an ancestor, its parent at first.
A self-join on the ancestor puts the ancestor's own way behind the node's and doubles the distance, so all inner nodes hold the
whole way to the root after log2(height) joins. Leaves, of which there are `fan` - 1 times as many, make their jump last, from
their parent to the root, since their segments would only be carried along before.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import carried, parted, with_facts
from hazeline.session import materialize

#: Name of the tree over the groups' roots; a group's own tree is named '' (null) or '=' and the group.
_TOP = "^"
_SIDES = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it goes into a leaf: its bytes of UTF-8, a colon and the value; a lone hyphen for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Iterable[Column]) -> Column:
    return digest(*(field(v) for v in values))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof_of(path: Column) -> Column:
    """One hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _id(tree: Column, level: Column | int, nth: Column) -> Column:
    return F.concat_ws("/", tree, (level if isinstance(level, Column) else F.lit(level)).cast("string"), nth.cast("string"))


def _sides(kids: Column, at: Column) -> Column:
    """What stands left and right of place `at` (from 0) in a run."""
    return F.struct(F.array_join(F.slice(kids, 1, at), "").alias("left"), F.array_join(F.slice(kids, at + 2, F.size(kids)), "").alias("right"))


def _grown(level: DataFrame, fan: int, name: str) -> DataFrame:
    """The inner nodes over level(tree, nth, h, n), n being the number of nodes of the tree at that level: (tree, level, nth,
    kids, h, n). Each level is written before the next; a run is one group of at most `fan` rows."""
    spark = level.sparkSession
    most, k, all_levels = level.agg(F.max("n")).first()[0] or 0, 0, spark.createDataFrame([], "tree string, level int, nth long, kids array<string>, h string, n long")
    while most > 1:
        k += 1
        runs = level.where("n > 1").groupBy("tree", F.expr(f"nth DIV {fan}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("nth", "h"))).alias("k"), F.first("n").alias("n"))
        level = materialize(runs.select("tree", F.lit(k).alias("level"), F.col("up").alias("nth"), F.col("k.h").alias("kids"), F.sha2(F.array_join("k.h", ""), 256).alias("h"), F.expr(f"(n + {fan} - 1) DIV {fan}").alias("n")), f"{name}-{k}")
        all_levels = all_levels.union(level)
        most = -(-most // fan)
    return all_levels


def _jumped(ways: DataFrame) -> DataFrame:
    """ways(id, up, path) with each path led on to the node that has no `up`, by doubling."""
    done, still = ways.where("up IS NULL"), ways.where("up IS NOT NULL")
    while n := still.count():
        rest = done.union(still).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("rest"))
        uses = materialize(still.groupBy("up").agg(F.count("*").alias("rows")).join(rest, "up"), "ancestors")
        far = with_facts(still, uses, ["up"], n, small=2000).select("id", F.col("next").alias("up"), F.concat("path", "rest").alias("path"))
        far = materialize(far, "jump")
        done, still = done.union(far.where("up IS NULL")), far.where("up IS NOT NULL")
    return done


def manifest(docs: DataFrame, leaf: Column, group: str, ident: str, fan: int = 8, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row a row of docs: its ident and carry columns, leaf, subroot, root and path (array of siblings' hex left and right
    of the way's node, from the leaf up). Leaves of a group ascend by ident, null first; rows with one ident ascend by leaf, so
    repeated rows are leaves of their own. A null group is a group and comes first, the others by their bytes. An empty table
    gives no rows; other columns are left out. A group of any share of the rows is numbered in ranges, runs are groups of `fan`
    nodes at most, and ancestors with many pointers come by broadcast (fewer than 256, or a count has shown few)."""
    carry = carry or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(F.col(ident).alias("_ident"), tree.alias("tree"), leaf.alias("h"), F.monotonically_increasing_id().alias("row"), *(c.alias(f"_{k}") for k, c in carry.items()))
    order = ["_ident", "h", "row"]
    rows = parted(materialize(rows, "leaves"), ["tree"], order, "leaf-ranges")
    sizes = materialize(rows.groupBy("tree").agg(F.count("*").alias("rows")).withColumn("n", F.col("rows")), "tree-sizes")
    total = rows.count()
    rows = carried(rows, ["tree"], order, {"nth": F.lit(1)}, "leaf-spans").withColumn("nth", F.col("nth") - 1).drop("_part", "row")
    leaves = materialize(with_facts(rows, sizes, ["tree"], total), "leaf-order")
    inner = _grown(leaves.select("tree", "nth", "h", "n"), fan, "runs")

    # the roots of the groups' trees are the leaves of the top tree
    roots = leaves.where("n = 1").select("tree", "h")
    roots = materialize(roots.union(inner.where("n = 1").select("tree", "h")).withColumn("top", F.lit(_TOP)), "subroots")
    groups = roots.count()
    ranks = carried(parted(roots, ["top"], ["tree"], "subroot-ranges"), ["top"], ["tree"], {"rank": F.lit(1)}, "subroot-spans")
    ranks = materialize(ranks.select("tree", F.col("h").alias("subroot"), (F.col("rank") - 1).alias("rank")).join(sizes.select("tree", "rows"), "tree"), "subroot-order")
    top = _grown(ranks.select(F.lit(_TOP).alias("tree"), F.col("rank").alias("nth"), F.col("subroot").alias("h"), F.lit(groups).alias("n")), fan, "top")
    one = (top.where("n = 1").select("h") if groups > 1 else roots.select("h")).first()

    def up(of: DataFrame, level: Column) -> DataFrame:
        """The run that a node goes into (null at the root), and its place there; of has rank where n is 1."""
        above = F.when(F.col("n") > 1, _id(F.col("tree"), level + 1, F.expr(f"nth DIV {fan}")))
        if groups > 1:
            above = above.when(F.col("tree") != _TOP, _id(F.lit(_TOP), F.lit(1), F.expr(f"rank DIV {fan}")))
        at = F.when(F.col("n") > 1, F.col("nth")).otherwise(F.col("rank")) % fan
        return of.withColumns({"up": above, "at": at.cast("int")})

    nodes = inner.union(top)
    runs = nodes.select(_id(F.col("tree"), F.col("level"), F.col("nth")).alias("id"), "kids", "level")
    ends = nodes.where("n = 1").join(ranks.select("tree", "rank"), "tree", "left")
    ways = up(nodes.where("n > 1").withColumn("rank", F.lit(None).cast("long")).union(ends.select(*nodes.columns, "rank")), F.col("level"))
    ways = ways.select(_id(F.col("tree"), F.col("level"), F.col("nth")).alias("id"), "up", "at").join(runs.select(F.col("id").alias("up"), "kids"), "up", "left")
    ways = ways.select("id", "up", F.when(F.col("up").isNull(), F.array().cast(_SIDES)).otherwise(F.array(_sides(F.col("kids"), F.col("at")))).alias("path"))
    ways = _jumped(materialize(ways, "ways"))

    last = runs.where("level = 1").join(ways.select("id", "path"), "id").select(F.col("id").alias("up"), "kids", "path")
    leaves = up(with_facts(leaves, ranks, ["tree"], total), F.lit(0)).join(last, "up", "left")
    path = F.when(F.col("up").isNull(), F.array().cast(_SIDES)).otherwise(F.concat(F.array(_sides(F.col("kids"), F.col("at"))), "path"))
    return leaves.select(F.col("_ident").alias(ident), F.col("h").alias("leaf"), "subroot", F.lit(one and one[0]).alias("root"), path.alias("path"), *(F.col(f"_{k}").alias(k) for k in carry))
