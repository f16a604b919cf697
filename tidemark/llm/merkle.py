"""Merkle manifest of a table: digests of rows, of runs of rows, of groups and of the whole table.

A node is labelled with the interval of leaf ranks that it covers, so the ancestors of a node are the nodes
whose intervals contain its own, and its siblings are what is left of its parent's interval without it. Nodes
of a level start at multiples of a power of the run length, which makes containment an equi-join on that bucket.
Everything is built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import broadcast_if_small, stored

RUN = 16
#: Segments (a group's rows in a partition), some 60 bytes each, that may be broadcast.
BROADCAST_SEGMENTS = 250_000
_ROW_BITS = 33  # of monotonically_increasing_id


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def row_digest(values: list[Column]) -> Column:
    """Digest of a row: every value as its UTF-8 byte count, a colon and the value; NULL is a hyphen."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


@dataclass(frozen=True)
class Tree:
    """``levels[k]`` has the nodes that cover up to ``RUN ** (k + 1)`` leaves of a group.

    Columns: gid, grp, n (leaves of the group), lo, hi, digest, and kids, the array of (lo, hi, digest) below the
    node; kids of ``levels[0]`` are the leaves and hold their ``row`` too.
    """

    levels: list[DataFrame]

    def tops(self, level: int) -> DataFrame:
        """Nodes of a level that cover their whole group."""
        nodes, span = self.levels[level], RUN ** (level + 1)
        return nodes.where((F.col("n") <= span) & ((F.col("n") > span // RUN) | F.lit(level == 0)))

    def roots(self) -> DataFrame:
        """(gid, grp, digest) of every group."""
        out = self.tops(0)
        for level in range(1, len(self.levels)):
            out = out.select("gid", "grp", "digest").unionByName(self.tops(level).select("gid", "grp", "digest"))
        return out.select("gid", "grp", "digest")


def _ranked(leaves: DataFrame) -> DataFrame:
    """Stored ``leaves`` with gid, n, and lo = hi = the rank in their group.

    Rows are sorted over range partitions, where a large group takes several of them; a rank is the place in
    the partition and the rows of the group in earlier ones. Equal rows are kept apart by their place in the table.
    """
    keys = ["grp", "ord", "digest", "at"]
    placed = leaves.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", _ROW_BITS)), "leaves")
    before, whole = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("grp")
    segments = placed.groupBy("grp", "part").agg(F.count("*").alias("rows"), F.min("at").alias("start"))
    segments = stored(
        segments.select(
            F.col("grp").alias("segment_grp"), F.col("part").alias("segment_part"), "start", F.min("start").over(whole).alias("gid"),
            F.sum("rows").over(whole).alias("n"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"),
        ),
        "segments",
    )
    joined = placed.join(
        broadcast_if_small(segments, BROADCAST_SEGMENTS), (F.col("part") == F.col("segment_part")) & F.col("grp").eqNullSafe(F.col("segment_grp"))
    )
    rank = F.col("at") - F.col("start") + F.col("earlier")
    return joined.select("gid", "grp", "n", rank.alias("lo"), rank.alias("hi"), "digest", "row")


def build(leaves: DataFrame) -> Tree:
    """Trees over the groups of ``leaves``, a stored table (grp, ord, digest, row).

    In a group, ordered by ord (NULL first, equal ones by digest), every ``RUN`` consecutive nodes become their
    digest until one is left; a lone leaf stays itself.
    """
    ranked, levels, span = _ranked(leaves), [], RUN
    nodes, kid, tallest = ranked, ["lo", "hi", "digest", "row"], RUN
    while not levels or tallest > span // RUN:
        runs = nodes.groupBy("gid", "grp", "n", F.floor(F.col("lo") / span).alias("bucket")).agg(F.sort_array(F.collect_list(F.struct(*kid))).alias("kids"))
        together = digest(F.array_join(F.col("kids.digest"), ""))
        runs = runs.select(
            "gid", "grp", "n", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"),
            F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(together).alias("digest"), "kids",
        )
        levels.append(stored(runs, "level"))
        tallest = levels[0].agg(F.max("n")).first()[0] or 0 if len(levels) == 1 else tallest
        nodes, kid = levels[-1].where(F.col("n") > span), ["lo", "hi", "digest"]
        span *= RUN
    return Tree(levels)


def _siblings(kids: str, lo: Column, hi: Column) -> Column:
    """What is left of a parent's interval without [lo, hi]: digests on the left and on the right."""
    left, right = F.filter(kids, lambda k: k["hi"] < lo), F.filter(kids, lambda k: k["lo"] > hi)
    return F.struct(F.array_join(left["digest"], "").alias("left"), F.array_join(right["digest"], "").alias("right"))


def _with_paths(tree: Tree, inherited: DataFrame) -> DataFrame:
    """Lowest nodes with the path from their digest upwards.

    ``inherited`` has one row per group: gid, subroot, root, and the path that starts at the group's own digest.
    """
    above = None
    for level in range(len(tree.levels) - 1, -1, -1):
        rows = tree.tops(level).join(inherited, "gid")
        if above is not None:
            span = RUN ** (level + 2)
            parents = above.select(
                "gid", F.floor(F.col("lo") / span).alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("kids").alias("around"), "path", "subroot", "root"
            )
            inside = tree.levels[level].where(F.col("n") > span // RUN).withColumn("bucket", F.floor(F.col("lo") / span))
            inside = inside.join(parents, ["gid", "bucket"]).where("from <= lo AND hi <= to")
            inside = inside.withColumn("path", F.concat(F.array(_siblings("around", F.col("lo"), F.col("hi"))), "path"))
            rows = rows.unionByName(inside.select(*rows.columns))
        above = rows
    return above


_PATH = "array<struct<left:string,right:string>>"


def prove(leaves: DataFrame) -> DataFrame:
    """(row, leaf, subroot, root, path) of every row of ``leaves`` (grp, ord, digest, row).

    ``path`` lists, from the leaf up to the root of all groups, the digests left and right of the way; levels that a
    small group does not have are not in it. Groups are the leaves of one more tree, NULL first, then by UTF-8 bytes.
    Repeated rows are leaves of their own, an empty table has no rows.
    """
    tree = build(stored(leaves, "digests"))
    subroots = stored(tree.roots().select(F.lit(0).alias("grp"), F.col("grp").alias("ord"), "digest", F.struct("gid", F.col("digest").alias("subroot")).alias("row")), "subroots")
    whole = build(subroots)
    start = whole.roots().select("gid", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
    tops = _leaves(_with_paths(whole, start)).select("row.gid", "row.subroot", "root", "path")
    return _leaves(_with_paths(tree, stored(tops, "tops"))).select("row", F.col("digest").alias("leaf"), "subroot", "root", "path")


def _leaves(runs: DataFrame) -> DataFrame:
    """Rows of the leaves below the lowest nodes, with their own siblings in front of the path."""
    kids = runs.select("n", "subroot", "root", "path", F.col("kids").alias("around"), F.inline("kids"))
    own = F.concat(F.array(_siblings("around", F.col("lo"), F.col("hi"))), "path")
    return kids.withColumn("path", F.when(F.col("n") == 1, F.col("path")).otherwise(own))


def proof_digest(path: str) -> Column:
    """Digest of all siblings on a path, from left to right and level by level."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def fold(path: str, leaf: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda below, p: digest(p["left"], below, p["right"]))
