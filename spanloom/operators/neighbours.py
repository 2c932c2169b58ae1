"""Exact nearest references by cosine distance, with a pivot index.

References are filed under their nearest pivot and in rings by their distance
to it. Cosine distance d of unit vectors is half the square of their Euclidean
distance, which is a metric: what a ring holds is no nearer to a query than the
triangle inequality says, so a query visits its most promising shard first and
then only shards whose bound reaches the distance of its kth neighbour. Shards
lie in a few groups. Queries are packed in blocks and groups in packs, and a task
reads a block and one pack after the other where they lie, so that neither is
sent again and a query has k rows at most, however many shards it visits.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.sources.scratch import kept

#: Rows of a shard of references. Queries meet references in slices.
SHARD_ROWS, SLICE_ROWS = 8_192, 256
#: Pivots and shards at most: both go to every task. With more references shards grow.
PIVOTS, SHARDS = 512, 64
#: Groups of shards and blocks of queries. Each group is packed once, each query once a round, and blocks and packs are read where
#: they meet. So what is sent grows with the rows, not with visits, groups or blocks.
GROUPS, BLOCKS = 8, 32
#: Rows of a block that is worth a task of its own, and most rows of a group or a block: what meets in a task. More rows make more of both.
LEAST_ROWS, TASK_ROWS = 512, 131_072
#: Rings of a cell: at most so many.
_RINGS = 64
#: Slack of a bound against rounding.
_SLACK = 1e-6
#: Pairs whose distances are computed at once in double precision.
_PAIRS = 65_536
_FOUND = "query_id long, ref_id long, ref_label string, distance double"


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1e-10, norms)


_NEAR = pa.schema([("query_id", pa.int64()), ("ref_id", pa.int64()), ("ref_label", pa.string()), ("distance", pa.float64())])


def _codes(names: pa.Array | pa.ChunkedArray, codes: dict) -> np.ndarray:
    """Numbers of names in ``codes``; -1 for names that are not in it and for null."""
    return np.array([-1 if x is None else codes.get(x, -1) for x in names.to_pylist()], np.int64)


def _wanted(column: pa.ChunkedArray, codes: dict) -> np.ndarray | None:
    """The numbers of each query's labels, each once, a column for each place (-2: none); None where any label will do."""
    lists = [None if x is None else list(dict.fromkeys(x)) for x in column.to_pylist()]
    if all(x is None for x in lists):
        return None
    out = np.full((len(lists), max((len(x or ()) for x in lists), default=0)), -2, np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x or ())] = [codes.get(name, -2) for name in x or ()]
    return out


class Visits(NamedTuple):
    """Which shards of a group the queries of a slice still have to visit: their first ones only, or all but those."""

    pivots: np.ndarray
    shards: Shards
    home: bool

    def parts(self, refs: pa.Table) -> list[tuple[int, slice]]:
        """Shards of references in order of shard, and where their rows are."""
        found, starts = np.unique(refs["shard"].to_numpy(), return_index=True)
        return [(int(x), slice(int(i), int(j))) for x, i, j in zip(found, starts, [*starts[1:], refs.num_rows], strict=True)]

    def bounds(self, unit: np.ndarray, of: list[int]) -> np.ndarray:
        return np.zeros((len(unit), len(of))) if self.home else Shards(*(x[of] for x in self.shards)).bounds(unit, self.pivots)


def _radius(distance: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors at a cosine distance, with slack."""
    return np.sqrt(2 * np.clip(distance, 0.0, 2.0)) + _SLACK


def _slices(asked: pa.Table, refs: pa.Table, reach: np.ndarray, visits: Visits | None):
    """(rows of the queries, their unit vectors, shards in order of promise), a slice at a time.

    A shard is a function that gives, by what ``reach`` is by then, the places of the slice's
    queries that have to visit it, and where its references are. Without ``visits`` all references are one shard.
    """
    if visits:
        parts = visits.parts(refs)
        of, first = [x for x, _ in parts], asked["first"].to_numpy()
    for at in range(0, asked.num_rows, SLICE_ROWS):
        part = slice(at, min(at + SLICE_ROWS, asked.num_rows))
        unit = unit_rows(asked["v"].slice(at, SLICE_ROWS))
        if not visits:
            yield part, unit, [lambda n=len(unit): (np.arange(n), slice(0, refs.num_rows))]
            continue
        bound = visits.bounds(unit, of)

        def visit(i: int, part=part, bound=bound):
            own = first[part] == of[i]
            return np.flatnonzero(own if visits.home else ~own & (bound[:, i] <= _radius(reach[part]))), parts[i][1]

        yield part, unit, [partial(visit, int(i)) for i in np.argsort(bound.mean(axis=0), kind="stable")]


def _distances_of(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine distances of pairs of unit rows."""
    parts = [slice(at, at + _PAIRS) for at in range(0, len(i), _PAIRS)]
    return np.clip(1 - np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", a[i[x]], b[j[x]]) for x in parts)]), 0.0, 2.0)


def _in_order(asked: pa.Table, refs: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Queries of one first shard together, so that they meet it at once; references by shard and id."""
    if "first" in asked.column_names:
        asked = asked.sort_by("first")
    return asked, refs.sort_by([(x, "ascending") for x in ("shard", "ref_id") if x in refs.column_names])


def meet(k: int, exclude_self: bool, visits: Visits | None = None):
    """The k best of a part of the references for each query of a block, for each wanted label; no farther than ``kth`` where queries have it.

    Products in single precision leave out pairs that are too far by more than
    their error; the distances of the others are computed in double precision.
    """

    def best_of(asked: pa.Table, refs: pa.Table) -> pa.Table:
        if not asked.num_rows or not refs.num_rows:
            return _NEAR.empty_table()
        asked, refs = _in_order(asked, refs)
        r, own, ids = unit_rows(refs["ref_v"]), asked["id"].to_numpy(), refs["ref_id"].to_numpy()
        codes = {x: i for i, x in enumerate(refs["ref_label"].unique().to_pylist())}
        labels, wanted = _codes(refs["ref_label"], codes), _wanted(asked["wanted"], codes)
        reach = asked["kth"].to_numpy() + _SLACK if "kth" in asked.column_names else np.full(len(own), 3.0)
        kinds = 1 if wanted is None else wanted.shape[1]
        single, error = r.astype(np.float32), 1.2e-7 * (r.shape[1] + 4)
        queries, places, distances = [], [], []
        for part, unit, shards in _slices(asked, refs, reach, visits):
            key, place, distance = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for shard in shards:
                some, there = shard()
                if not len(some):
                    continue
                near = -unit[some].astype(np.float32) @ single[there].T  # the distance less 1
                if exclude_self:
                    low, high = (np.searchsorted(ids[there], own[part][some], side) for side in ("left", "right"))
                    for i in np.flatnonzero(high > low):
                        near[i, low[i] : high[i]] = np.inf
                for kind in range(kinds):
                    row = near if wanted is None else np.where(wanted[part][some, kind, None] == labels[None, there], near, np.inf)
                    limit = reach[part][some]
                    most = (limit - 1 + error).astype(np.float32)
                    fits = row <= most[:, None]
                    wide = np.flatnonzero(np.count_nonzero(fits, axis=1) > 4 * k)  # all that tie with the kth stay
                    if len(wide):
                        kth = np.partition(row[wide], k - 1, axis=1)[:, k - 1]
                        fits[wide] = row[wide] <= np.minimum(kth + np.float32(2 * error), most[wide])[:, None]
                    q, j = np.nonzero(fits)
                    found = _distances_of(unit, r, some[q], j + there.start)
                    close = found <= limit[q]
                    key = np.r_[key, (some[q] * kinds + kind)[close]]
                    place = np.r_[place, j[close] + there.start]
                    distance = np.r_[distance, found[close]]
                order = np.lexsort((ids[place], distance, key))
                rank = np.arange(len(key)) - np.searchsorted(key[order], key[order])
                order = order[rank < k]
                key, place, distance = key[order], place[order], distance[order]
                if wanted is None:
                    full = order[:0] if k < 1 else np.flatnonzero(rank[rank < k] == k - 1)
                    reach[part][key[full]] = np.minimum(reach[part][key[full]], distance[full] + _SLACK)
            queries.append(own[part][key // kinds] if len(key) else own[:0])
            places.append(place)
            distances.append(distance)
        j = pa.array(np.concatenate(places))
        return pa.table([pa.array(np.concatenate(queries)), refs["ref_id"].take(j), refs["ref_label"].take(j), pa.array(np.concatenate(distances))], schema=_NEAR)

    return best_of


def first_near(distance: float, before: bool, visits: Visits | None = None):
    """The least reference id of the query's label within ``distance``, for each query of a block that has one; with ``before`` below its own id."""

    def least(asked: pa.Table, refs: pa.Table) -> pa.Table:
        if not asked.num_rows or not refs.num_rows:
            return _NEAR.empty_table()
        asked, refs = _in_order(asked, refs)
        r, ids, labels = unit_rows(refs["ref_v"]), refs["ref_id"].to_numpy(), np.array(refs["ref_label"].to_pylist(), object)
        own, wanted = asked["id"].to_numpy(), np.array([w[0] for w in asked["wanted"].to_pylist()], object)
        found = []
        for part, unit, shards in _slices(asked, refs, np.full(len(own), distance), visits):
            for shard in shards:
                some, there = shard()
                if not len(some):
                    continue
                near = np.clip(1 - unit[some] @ r[there].T, 0.0, 2.0)
                fits = (near <= distance) & (wanted[part][some, None] == labels[None, there])
                if before:
                    fits &= ids[None, there] < own[part][some, None]
                has = np.flatnonzero(fits.any(axis=1))
                at = fits[has].argmax(axis=1)  # ids ascend in a shard
                found.append((own[part][some[has]], ids[there][at], wanted[part][some[has]], near[has, at]))
        if not found:
            return _NEAR.empty_table()
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.table([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.string()), pa.array(columns[3])], schema=_NEAR)

    return least


def best(found: DataFrame, k: int, by_class: bool) -> DataFrame:
    key = ["query_id", "ref_label"] if by_class else ["query_id"]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("distance", "ref_id"))).filter(F.col("rank") <= k)


def _distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit rows to the pivots; rows of zeros are at cosine distance 1 of all."""
    return np.sqrt(2 * np.clip(1 - unit @ pivots.T, 0.0, 2.0))


class Shards(NamedTuple):
    """Cell and least and greatest distance to the cell's pivot, of each shard."""

    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """For each query what no reference of each shard is nearer than.

        A reference of cell i is nearer to pivot i than to the query's own
        pivot j, so it is at least half of d(q, i) - d(q, j) away. Cell -1 holds
        the zero vectors, at the distance that belongs to cosine distance 1.
        """
        if not len(unit):
            return np.empty((0, len(self.cell)))
        d = _distances(unit, pivots)
        own = d[:, np.maximum(self.cell, 0)]
        found = np.maximum(np.maximum(own - self.high, self.low - own), (own - d.min(axis=1, keepdims=True)) / 2)
        found = np.where(self.cell < 0, np.sqrt(2.0), np.maximum(found, 0.0))
        return np.where((unit == 0).all(axis=1, keepdims=True), np.sqrt(2.0), found)


def _filed(pivots: np.ndarray):
    """References with their cell and their distance to its pivot."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(batch.column("ref_v"))
            d = _distances(unit, pivots)
            cell = np.where((unit == 0).all(axis=1), -1, d.argmin(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.where(cell < 0, 0.0, d.min(axis=1)))], names=[*batch.schema.names, "cell", "d"])

    return run


def _routed(pivots: np.ndarray, shards: Shards, home: bool):
    """Queries that have shards to visit with the most promising one ``first`` and their number ``n``: that one, or the others whose bound reaches the kth distance."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bound = shards.bounds(unit_rows(batch.column("v")), pivots)
            first = bound.argmin(axis=1)
            if home:
                n = np.ones(len(first), np.int64)
            else:
                visit = bound <= _radius(batch.column("kth").to_numpy(zero_copy_only=False))[:, None]
                visit[np.arange(len(first)), first] = False
                n = np.count_nonzero(visit, axis=1)
            at = np.flatnonzero(n)
            rows = batch.select(["id", "v", "wanted", "kth"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x[at].astype(np.int32)) for x in (first, n))], names=["id", "v", "wanted", "kth", "first", "n"])

    return run


_PACKED = "packed binary, rows long, visits long"


def _packed(batches):
    """The rows of a partition as one row, an Arrow stream, with their number and the sum of ``n`` if they have it; none for an empty partition."""
    full = [x for x in batches if x.num_rows]
    if full:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, full[0].schema) as stream:
            for x in full:
                stream.write_batch(x)
        visits = sum(int(x.column("n").to_numpy().sum()) for x in full if "n" in x.schema.names)
        yield pa.RecordBatch.from_pydict({"packed": pa.array([out.getvalue().to_pybytes()], pa.binary()), "rows": [sum(x.num_rows for x in full)], "visits": [visits]})


def _unpacked(packed: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all()


def _k_of_each(found: pa.Table, k: int, by_class: bool) -> tuple[pa.Table, np.ndarray]:
    """The k best of each query, and with ``by_class`` of each label; their places in that order."""
    query, distance, ids = (found[x].to_numpy() for x in ("query_id", "distance", "ref_id"))
    label = _codes(found["ref_label"], {x: i for i, x in enumerate(found["ref_label"].unique().to_pylist())}) if by_class else np.zeros(len(query), np.int64)
    order = np.lexsort((ids, distance, label, query))
    new = np.r_[True, (np.diff(query[order]) != 0) | (np.diff(label[order]) != 0)][: len(order)]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return found.take(pa.array(order[rank < k])), rank[rank < k]


def _nearer(asked: pa.Table, found: pa.Table, rank: np.ndarray, k: int) -> pa.Table:
    """Queries with ``kth`` lowered to the distance of the last of k found."""
    full = found.filter(pa.array(rank == k - 1))
    order = np.argsort(asked["id"].to_numpy(), kind="stable")
    ids, kth, query = asked["id"].to_numpy()[order], asked["kth"].to_numpy()[order].copy(), full["query_id"].to_numpy()
    at, n = np.searchsorted(query, ids), len(query)
    has = (at < n) & (query[np.minimum(at, n - 1)] == ids) if n else np.zeros(len(ids), bool)
    kth[has] = np.minimum(kth[has], full["distance"].to_numpy()[at[has]])
    back = np.empty(len(order))
    back[order] = kth
    return asked.set_column(asked.column_names.index("kth"), "kth", pa.array(back))


def _met(best_of, home: bool, k: int, by_class: bool):
    """What ``best_of`` finds for packed queries ``asked`` of a ``block`` and packs of references ``refs``; with ``home`` for queries whose first shard is among these.

    Packs that follow each other for one block add to the same k best (all that is found, if k is 0).
    """

    def run(batches):
        block, asked, found = None, None, _NEAR.empty_table()
        for batch in batches:
            for number, queries, refs in zip(batch.column("block").to_pylist(), batch.column("asked"), batch.column("refs"), strict=True):
                if number != block:
                    yield from found.to_batches(max_chunksize=_PAIRS)
                    block, asked, found = number, _unpacked(queries), _NEAR.empty_table()
                refs = _unpacked(refs)
                some = asked.filter(pc.is_in(asked["first"], value_set=refs["shard"].unique())) if home else asked
                found = pa.concat_tables([found, best_of(some, refs)]).combine_chunks()
                if k:
                    found, rank = _k_of_each(found, k, by_class)
                    if not by_class:
                        asked = _nearer(asked, found, rank, k)
        yield from found.to_batches(max_chunksize=_PAIRS)

    return run


class PivotIndex:
    """References (id, label, v) in shards around pivots, for searches of at most ``k`` neighbours.

    Pivots are the references of least hash, a bounded sample; every reference
    is filed. Of equal vectors of one label only the k + 1 least ids are kept,
    as no others can be among a query's k nearest (null vectors take no part), so that a vector that a third
    of the references share fills no shards. The worst case, vectors without
    structure or queries that are zero vectors, visits every shard, as a search
    without an index does.
    """

    def __init__(self, refs: DataFrame, k: int, rows: int = SHARD_ROWS, pivots: int = PIVOTS):
        self.k = k
        refs = refs.select(F.col("id").alias("ref_id"), F.col("label").cast("string").alias("ref_label"), F.col("v").alias("ref_v")).filter("ref_v is not null")
        place = F.row_number().over(Window.partitionBy("ref_v", "ref_label").orderBy("ref_id"))
        refs = kept(refs.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place"))
        n = refs.count()
        rows = max(rows, -(-2 * n // SHARDS))
        sample = refs.filter(F.exists("ref_v", lambda x: x != 0)).select("ref_v", F.xxhash64("ref_id").alias("h")).orderBy("h").limit(min(pivots, max(1, 2 * n // rows)))
        found = [r["ref_v"] for r in sample.collect()]
        width = len(found[0]) if found else len((refs.select("ref_v").first() or [[0.0]])[0])
        unit = np.array(found, np.float64).reshape(len(found), width)
        self.pivots = unit / np.linalg.norm(unit, axis=1, keepdims=True) if len(found) else np.eye(1, width)
        filed = kept(refs.mapInArrow(_filed(self.pivots), "ref_id long, ref_label string, ref_v " + refs.schema["ref_v"].dataType.simpleString() + ", cell int, d double"))
        edges = filed.groupBy("cell").agg(F.count("*").alias("c"), F.percentile_approx("d", [i / _RINGS for i in range(1, _RINGS)], 1000).alias("edges"))
        rings = F.least(F.lit(_RINGS), F.ceil(F.col("c") / rows))
        place = F.size(F.filter("edges", lambda x: x < F.col("d")))
        ringed = filed.join(F.broadcast(edges), "cell").withColumn("ring", F.floor(place * rings / _RINGS)).drop("c", "edges")
        parts = F.broadcast(ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / rows).alias("parts")))
        ringed = ringed.join(parts, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("ref_id"), "parts")).drop("parts")
        made = sorted(tuple(r) for r in ringed.groupBy("cell", "ring", "part").agg(F.min("d"), F.max("d"), F.count("*")).collect())
        self.shards = Shards(*(np.array([r[i] for r in made], kind) for i, kind in ((0, np.int64), (3, np.float64), (4, np.float64))))
        # Shards of near cells are neighbours, so a query that visits few shards visits few groups.
        before = np.cumsum([0, *(r[5] for r in made)])
        self.group = (before[:-1] * max(GROUPS, -(-n // TASK_ROWS)) // max(n, 1)).astype(np.int64)
        numbers = refs.sparkSession.createDataFrame([(*map(int, r[:3]), i, int(g)) for i, (r, g) in enumerate(zip(made, self.group, strict=True))], "cell int, ring long, part long, shard int, group int")
        refs = ringed.join(F.broadcast(numbers), ["cell", "ring", "part"]).select("group", "shard", "ref_id", "ref_label", "ref_v")
        groups = int(self.group[-1]) + 1 if len(self.group) else 1
        self.packs = kept(refs.repartitionById(groups, F.col("group")).drop("group").mapInArrow(_packed, _PACKED)).select(F.col("packed").alias("refs"))
        self.met = self.sent = 0

    def _visit(self, asked: DataFrame, n: int, home: bool, meeting, k: int = 0, by_class: bool = False) -> DataFrame:
        """What ``meeting`` finds in the first shards of the ``n`` queries (id, v, wanted, kth), or in the others that they have to visit.

        A task reads a block and all packs in turn; the hint keeps Spark from sending either through the driver.
        """
        kind = asked.schema["v"].dataType.simpleString()
        visits = asked.mapInArrow(_routed(self.pivots, self.shards, home), f"id long, v {kind}, wanted array<string>, kth double, first int, n int")
        blocks = max(1, min(BLOCKS, -(-n // LEAST_ROWS)), -(-n // TASK_ROWS))
        left = visits.repartitionById(blocks, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).mapInArrow(_packed, _PACKED)
        left = kept(left.withColumn("block", F.spark_partition_id()))
        sent, met = left.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("rows", "visits"))).first()
        self.met, self.sent = self.met + met, self.sent + sent
        pairs = left.select("block", F.col("packed").alias("asked")).crossJoin(self.packs.hint("shuffle_replicate_nl")).coalesce(blocks)
        return pairs.mapInArrow(_met(meeting(Visits(self.pivots, self.shards, home)), home, k, by_class), _FOUND)

    def near(self, queries: DataFrame, distance: float, before: bool = False) -> DataFrame:
        """(query_id, ref_id): the least reference of a query's label within ``distance``, for queries (id, label, v) that have one.

        Only existence is asked: a shard returns one row for a query, however many are near.
        """
        if not len(self.shards.cell):
            return queries.sparkSession.createDataFrame([], "query_id long, ref_id long")
        asked = queries.filter("v is not null").select("id", "v", F.array(F.col("label").cast("string")).alias("wanted"), F.lit(float(distance)).alias("kth"))
        meeting = lambda visits: first_near(distance, before, visits)
        n = asked.count()
        found = self._visit(asked, n, True, meeting)
        if len(self.shards.cell) > 1:
            found = found.unionByName(self._visit(asked, n, False, meeting))
        return found.groupBy("query_id").agg(F.min("ref_id").alias("ref_id"))

    def search(self, queries: DataFrame, exclude_self: bool = False, by_class: bool = False) -> DataFrame:
        """query_id, rank, ref_id, ref_label, distance for queries (id, v, and with ``by_class`` wanted).

        ``met`` is the number of visits of a query to a shard since the index was made, ``sent`` how often a query was packed.
        """
        if not len(self.shards.cell):
            return best(queries.sparkSession.createDataFrame([], _FOUND), self.k, by_class)
        wanted = F.col("wanted") if by_class else F.lit(None).cast("array<string>")
        asked = queries.filter("v is not null").select("id", "v", wanted.alias("wanted"))
        n = asked.count()
        meeting = lambda visits: meet(self.k, exclude_self, visits)
        found = kept(best(self._visit(asked.withColumn("kth", F.lit(2.0)), n, True, meeting, self.k, by_class), self.k, by_class).drop("rank"))
        if len(self.shards.cell) > 1:
            groups = found.groupBy(F.col("query_id").alias("_id"), *(["ref_label"] if by_class else [])).agg(F.when(F.count("*") >= self.k, F.max("distance")).alias("kth"))
            if by_class:
                groups = groups.groupBy("_id").agg(F.when(F.count("*") == F.count("kth"), F.max("kth")).alias("kth"), F.count("*").alias("labels"))
            far = F.when(F.size(F.array_distinct("wanted")) == F.col("labels"), F.col("kth")) if by_class else F.col("kth")
            waiting = asked.join(groups, F.col("id") == F.col("_id"), "left").select("id", "v", "wanted", F.coalesce(far, F.lit(2.0)).alias("kth"))
            found = kept(best(found.unionByName(self._visit(waiting, n, False, meeting, self.k, by_class)), self.k, by_class).drop("rank"))
        return best(found, self.k, by_class)


def _in_turn(distance: float):
    """The greedy choice within one label: a row is accepted if no accepted one before it is near."""

    def choose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        unit, ids, kept_at, twin = unit_rows(rows["v"]), rows["id"].to_numpy(), [], []
        for i in range(len(ids)):
            near = np.flatnonzero(np.clip(1 - unit[kept_at] @ unit[i], 0.0, 2.0) <= distance)
            twin.append(int(ids[kept_at[near[0]]]) if len(near) else None)
            if twin[-1] is None:
                kept_at.append(i)
        return pa.table([rows["id"], pa.array(twin, pa.int64())], names=["id", "twin"])

    return choose


def first_independent(rows: DataFrame, distance: float, at_once: int = SHARD_ROWS) -> DataFrame:
    """(id, twin) for rows (id, label, v): the lexicographically first set of rows of which no two of a label are within ``distance``.

    ``twin`` is null for its members; for others it is the least member near
    them. Taking rows in order of id, a row is accepted unless an accepted one
    is near. So many rows as fit a task are taken in turn there. More go in
    rounds: every open row without an earlier open row near it is accepted, then
    all open rows near an accepted one are settled. Both questions go to a pivot
    index and return a row at most for each row asked. A chain of rows, each near
    the next only, takes as many rounds as it has members.
    """
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "v")
    if rows.count() <= at_once:
        return rows.groupBy("label").applyInArrow(_in_turn(distance), "id long, twin long")
    waiting, found = kept(rows), None
    while not waiting.isEmpty():
        late = PivotIndex(waiting, 0, at_once).near(waiting, distance, before=True)
        accepted = kept(waiting.join(late.select(F.col("query_id").alias("id")), "id", "left_anti"))
        settled = PivotIndex(accepted, 0, at_once).near(waiting, distance).select(F.col("query_id").alias("id"), F.col("ref_id").alias("twin"))
        settled = kept(accepted.select("id", F.lit(None).cast("long").alias("twin")).unionByName(settled.join(accepted, "id", "left_anti")))
        waiting = kept(waiting.join(settled, "id", "left_anti"))
        found = settled if found is None else found.unionByName(settled)
    return found
