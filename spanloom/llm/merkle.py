"""A Merkle manifest of a dataset, as a persistent tree with versions by path copying.

Leaves are numbered in ranges and fall into aligned blocks whose subtrees are
built in one task each. A changed leaf is a version: it shares every node of the
tree but its ancestors, which are copied inside its block. The blocks' tops are
the leaves of a smaller tree, built the same way, and a version goes on above
its block from its own top and the siblings of the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, cut, table

FANOUT = 2
#: Levels of a block: 2 ** 12 leaves.
BLOCK_LEVELS = 12
_STEP = "struct<before: string, after: string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def fold(path: Column, first: Column) -> Column:
    """What ``first`` becomes with the siblings of ``path`` (array of before, after), from the lowest."""
    return F.aggregate(path, first, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def copies(path: Column, first: Column) -> Column:
    """The ancestors that a version starting from ``first`` copies, from the lowest."""
    start = F.array(first)
    grown = F.aggregate(path, start, lambda nodes, step: F.concat(nodes, F.array(F.sha2(F.concat(step["before"], F.element_at(nodes, -1), step["after"]), 256))))
    return F.slice(grown, 2, F.greatest(F.size(grown) - 1, F.lit(0)))


def numbered(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with their index in the group and the group's size, without a task for a whole group.

    Rows are range-partitioned by group and order; a partition's rows count on
    from those of the group in the partitions before. Rows alike in both are
    dealt out by their place in the input.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("_tie")]
    placed = scratch.save(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min("_place").alias("_least"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn("n", F.sum("_rows").over(Window.partitionBy("_group")))
    same = F.col(group).eqNullSafe(F.col("_group")) & (part == F.col("_part"))
    return placed.join(counts, same).withColumn("index", F.col("_place") - F.col("_least") + F.col("_before")).drop("_place", "_group", "_part", "_least", "_rows", "_before")


def _above(nodes: list[str], fanout: int, levels: int) -> tuple[list[list[tuple[str, str]]], str]:
    """Paths of the nodes over so many levels (or to a single node, if none are given), and the top."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
    at, level = list(range(len(nodes))), 0
    while len(nodes) > 1 or level < levels:
        steps, parents = [], []
        for i in range(0, len(nodes), fanout):
            run = nodes[i : i + fanout]
            parents.append(digest("".join(run)))
            steps += [("".join(run[:j]), "".join(run[j + 1 :])) for j in range(len(run))]
        for path, i in zip(paths, at, strict=True):
            path.append(steps[i])
        at, nodes, level = [i // fanout for i in at], parents, level + 1
    return paths, nodes[0]


def _block(fanout: int, levels: int) -> Callable[[pa.Table], pa.Table]:
    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        several = rows["n"][0].as_py() > fanout**levels
        paths, top = _above(rows["hash"].to_pylist(), fanout, levels if several else 0)
        path = pa.array([[{"before": b, "after": a} for b, a in p] for p in paths], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
        return pa.table([rows["group"], rows["index"], rows["n"], path, pa.array([top] * rows.num_rows)], names=["group", "index", "n", "path", "top"])

    return build


def climb(nodes: DataFrame, scratch: Scratch, name: str, fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(group, index, path, top) of each node of (group, index, n, hash): its siblings up to the group's top.

    Every group is a tree over its ``n`` nodes. A turn builds blocks of
    ``fanout ** levels`` nodes and the tree above them is built of their tops.
    """
    size = fanout**levels
    block = F.floor(F.col("index") / size).cast("long")
    kind = dict(nodes.dtypes)["group"]
    built = nodes.select("group", "index", "n", "hash").withColumn("block", block).groupBy("group", "block").applyInArrow(_block(fanout, levels), f"group {kind}, index long, n long, path array<{_STEP}>, top string")
    built = scratch.save(built, name)
    tops = built.filter(F.col("n") > size).select("group", block.alias("index"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("top").alias("hash")).distinct()
    low = built.filter(F.col("n") <= size).drop("n")
    if tops.isEmpty():
        return low
    above = climb(tops, scratch, f"{name}-up", fanout, levels).select(F.col("group").alias("_group"), F.col("index").alias("_block"), F.col("path").alias("_path"), F.col("top").alias("_top"))
    high = built.filter(F.col("n") > size).drop("n").join(above, F.col("group").eqNullSafe(F.col("_group")) & (block == F.col("_block")))
    return low.unionByName(high.select("group", "index", F.concat("path", "_path").alias("path"), F.col("_top").alias("top")))


def manifest(leaves: DataFrame, scratch: Scratch, fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The tree over ``leaves`` (group, id, hash, changed): their columns, index, path, subroot, root, folded, copied.

    A group's leaves ascend by id (null first, ties by hash); groups ascend by
    name (null first) and their tops are the leaves of the last tree. ``path``
    holds the original siblings up to the root. ``changed`` is the hash of the
    leaf's own version, null if it has none; ``copied`` are the ancestors that
    this version copies, and all other nodes are shared with the first tree.
    ``folded`` is the root of the version, or that refolded from the leaf.
    """
    rows = scratch.save(numbered(leaves, "group", ["id", "hash"], scratch, "leaves-placed"), "leaves-numbered")
    trees = climb(rows, scratch, "trees", fanout, levels)
    tops = scratch.save(trees.select(F.col("group").alias("name"), F.col("top").alias("hash")).distinct().withColumn("group", F.lit(0)), "tops")
    crowns = scratch.save(numbered(tops, "group", ["name"], scratch, "tops-placed"), "tops-numbered")
    crown = climb(crowns, scratch, "crown", fanout, levels).select("index", F.col("path").alias("_path"), F.col("top").alias("root"))
    crown = scratch.save(crowns.select("index", F.col("name").alias("_name"), F.col("hash").alias("subroot")).join(crown, "index").drop("index"), "crowns")
    trees = trees.select(F.col("group").alias("_group"), F.col("index").alias("_index"), "path")
    found = rows.join(trees, F.col("group").eqNullSafe(F.col("_group")) & (F.col("index") == F.col("_index"))).join(crown, F.col("group").eqNullSafe(F.col("_name")))
    found = found.withColumn("path", F.concat("path", "_path")).drop("_group", "_index", "_name", "_path", "n")
    copied = F.when(F.col("changed").isNotNull(), copies(F.col("path"), F.col("changed")))
    return found.withColumn("copied", copied).withColumn("folded", F.coalesce(F.element_at("copied", -1), fold(F.col("path"), F.coalesce("changed", "hash"))))


def proof(path: Column) -> Column:
    """The siblings of a path, lowest first and left to right, as one text."""
    return F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"])))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and the verdict on a tampered copy, for each document.

    Null fields have a mark of their own; a null id comes first and is not
    tampered with; documents that share an id are ordered by their leaves. An
    empty table gives no rows, other columns take no part.
    """
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    fields = lambda n: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    leaves = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), fields(F.col("n_chars")).alias("hash"), F.when(tampered, fields(F.col("n_chars") + 1)).alias("changed"))
    with Scratch(spark) as scratch:
        found = manifest(scratch.save(leaves, "leaves"), scratch)
        result = found.select(F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
        return cut(result)


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(octet_length(CAST(CAST({0} AS VARCHAR) AS BLOB)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
_TEXT = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0} END"
_LEAF = lambda n: "sha256(" + " || ".join([_FIELD.format("doc_id"), _TEXT.format("source"), _TEXT.format("lang"), _FIELD.format(n), _TEXT.format("text")]) + ")"
#: CRC-32 of the decimal digits, bit by bit.
_CRC = "xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT))"
_UP = """SELECT grp, level + 1 AS level, i // 2 AS i, (n + 1) // 2 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {0} WHERE n > 1 GROUP BY grp, level, n, i // 2"""
ORACLE = {
    "op12_merkle_manifest": f"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, {_LEAF("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF("n_chars + 1")} END AS changed FROM documents),
o AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (SELECT grp, 0 AS level, i, n, leaf AS h FROM o UNION ALL {_UP.format("t")}),
s AS (SELECT grp, level AS height, h AS subroot FROM t WHERE n = 1),
u AS (
  SELECT 0 AS grp, 0 AS level, grp AS i, (SELECT count(*) FROM s) AS n, subroot AS h FROM s
  UNION ALL {_UP.format("u")}),
nodes AS (SELECT grp AS own, level, i, h FROM t UNION ALL SELECT -1, level, i, h FROM u),
steps AS (
  SELECT o.doc_id, o.leaf, o.grp AS own, 0 AS part, r.level, o.i >> r.level AS at FROM o JOIN s USING (grp) JOIN (SELECT unnest(range(64)) AS level) r ON r.level < s.height
  UNION ALL
  SELECT o.doc_id, o.leaf, -1, 1, r.level, o.grp >> r.level FROM o JOIN (SELECT unnest(range(64)) AS level) r ON r.level < (SELECT max(level) FROM u)),
sided AS (
  SELECT p.doc_id, p.leaf, p.part, p.level, CASE WHEN n.h IS NULL THEN 'N' WHEN p.at % 2 = 0 THEN 'R' || n.h ELSE 'L' || n.h END AS step
  FROM steps p LEFT JOIN nodes n ON n.own = p.own AND n.level = p.level AND n.i = xor(p.at, 1)),
paths AS (SELECT doc_id, leaf, list(step ORDER BY part, level) AS path FROM sided GROUP BY doc_id, leaf),
folded AS (
  SELECT o.doc_id, o.leaf, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(path, []) AS path,
    list_reduce([coalesce(changed, o.leaf)] || coalesce(path, []), lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a WHEN x[1] = 'R' THEN a || x[2:] ELSE a END)) AS folded_root
  FROM o JOIN s USING (grp) LEFT JOIN paths p ON p.doc_id = o.doc_id AND p.leaf = o.leaf)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded""",
}
