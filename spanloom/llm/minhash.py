"""MinHash near-duplicates by min-max hashing.

Every permutation gives two signature values, the minimum and the maximum of a
document's shingle hashes, so half the hash evaluations fill the same bands.
Bands only propose pairs; each link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, Scratch, apart, bounded, cache_of, cut, per_batch, table, utf8, with_row_key, words

SHINGLE_WORDS = 5
#: A link needs 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: 100 permutations give 200 values: 40 bands of 5. A pair at 0.75 shares no band with probability 2e-5.
PERMUTATIONS, BANDS = 100, 40
#: Permutations of the sketch that tells apart the few nodes left unsettled (two bytes each), and its slack in standard deviations.
SKETCH_PERMUTATIONS, SKETCH_SLACK = 512, 5.0
#: Nodes of a bucket that meet in one task, on either side.
MEETING = 4_096
#: A bucket of more than LARGE entries and a LARGE_SHARE of all of them is cut into parts, each with a pivot of its own.
LARGE, LARGE_SHARE = 512, 1e-4
_ODD = np.random.default_rng(7).integers(1, 2**63, size=4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Word -> 64-bit hash, emptied when it has grown to ``most`` words."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(tokens: list[bytes], hashes: _WordHashes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``size`` make one shingle."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, n)
    k = min(n, size)
    h = np.full(n - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        h = h * _MIX + w[j : n - k + 1 + j]
        h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(shingles: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Minimum and maximum under each permutation, interleaved."""
    low = np.full(permutations, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(permutations, np.uint64)
    for at in range(0, len(shingles), 8192):
        under = np.multiply.outer(_ODD[:permutations], shingles[at : at + 8192])
        np.minimum(low, under.min(axis=1), out=low)
        np.maximum(high, under.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of the key."""
    rows = values.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64) * _MIX
    for column in rows.T:
        key = (key ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(batches, size, permutations, bands):
    cache_of("minhash")
    hashes = _WordHashes()
    for batch in batches:
        counts, first, second, keys = [], [], [], []
        for text in utf8(batch.column(1)):
            found = shingle_hashes(words(text), hashes, size)
            counts.append(len(found))
            whole = xxhash.xxh3_128_intdigest(found.tobytes())
            first.append((whole >> 64) - 2**63)
            second.append((whole & (2**64 - 1)) - 2**63)
            keys.append(band_keys(signature(found, permutations), bands) if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=_SIGNED_ARROW)


def sign(docs: DataFrame, size: int = SHINGLE_WORDS, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """Set size, a 128-bit digest of the whole set and the band keys of each row of (doc_id, text)."""
    return docs.mapInArrow(lambda batches: _sign(batches, size, permutations, bands), _SIGNED)


def _confirm(batches, size, similarity):
    """Pairs whose whole shingle sets are similar enough."""
    sets: dict[tuple[int, bytes], frozenset] = {}

    def of(doc: int, text: bytes) -> frozenset:
        key = (doc, xxhash.xxh3_128_digest(text))
        if (found := sets.get(key)) is None:
            if len(sets) >= 64:
                sets.clear()
            tokens = words(text)
            k = min(len(tokens), size)
            found = sets[key] = frozenset(zip(*(tokens[j : len(tokens) - k + 1 + j] for j in range(k)), strict=True)) if k else frozenset()
        return found

    for batch in batches:
        left, right = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = []
        for a, b, s, t in zip(left, right, utf8(batch.column("a_text")), utf8(batch.column("b_text")), strict=True):
            x, y = of(a, s), of(b, t)
            both = len(x & y)
            keep.append(100 * both >= similarity * (len(x) + len(y) - both) and both > 0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b): the smallest node reachable.

    Alternating large-star and small-star steps. Each forms a node's minimum
    before it shuffles; a hub's links are joined to it as rows that may spill or
    be split, never held as a group.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _with_pivots(entries: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """Entries (node, n, bucket) of buckets that several nodes share, with the least node as pivot.

    Large buckets (at most 1 / LARGE_SHARE, so they are broadcast) are cut by
    node into a power of two of parts. An entry's pivot is its part's, and a
    part's pivot has one more row with that of the whole bucket, so no task
    and no pivot gets a whole large bucket.
    """
    least = (F.min_by("n", "node").alias("pivot_n"), F.min("node").alias("pivot"), F.max("node").alias("last"))
    pivots = scratch.save(entries.groupBy("bucket").agg(*least, F.count("*").alias("c")).filter("pivot <> last").drop("last"), "pivots")
    at_most = max(LARGE, int(LARGE_SHARE * total))
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.col("c") / at_most))).cast("long")
    large = F.broadcast(pivots.filter(F.col("c") > at_most).select("bucket", parts.alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("node"), "parts"), F.lit(0))
    in_parts = entries.join(large, "bucket").withColumn("part", part).groupBy("bucket", "part").agg(*least[:2])
    in_parts = scratch.save(in_parts, "part-pivots")
    of_bucket = pivots.filter(F.col("c") <= at_most).select("bucket", F.lit(0).cast("long").alias("part"), "pivot_n", "pivot")
    shared = entries.join(large, "bucket", "left").withColumn("part", part).join(of_bucket.unionByName(in_parts), ["bucket", "part"]).select("bucket", "node", "n", "pivot_n", "pivot")
    bridges = in_parts.select("bucket", F.col("pivot").alias("node"), F.col("pivot_n").alias("n")).join(pivots.select("bucket", "pivot_n", "pivot"), "bucket")
    return shared.unionByName(bridges)


def _sketch(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    hashes = _WordHashes()
    sets = [shingle_hashes(words(t), hashes, size) for t in utf8(batch.column(1))]
    sketches = [((signature(x, SKETCH_PERMUTATIONS) * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes() for x in sets]
    return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["node", "n", "shingles", "sketch"])


def _rare_shingles(sets: DataFrame, similarity: int) -> DataFrame:
    """Entries (node, n, bucket) for each node's rarest shingles among ``sets`` (node, n, shingles).

    Sets of the required similarity share at least ceil(similarity * n / 100) of
    either one's n shingles, so in any common order they share one of the first
    n minus that plus 1. The order is by frequency; shingles of one node only
    fill places but need no bucket.
    """
    sets = sets.select("node", "n", F.explode("shingles").alias("bucket"))
    several = sets.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
    ranked = sets.join(several, "bucket").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "bucket"))).alias("found"))
    places = F.expr(f"n - ceil({similarity} * n / 100) + 1 - (n - size(found))").cast("int")
    return ranked.select("node", "n", F.explode(F.slice("found", 1, F.greatest(F.lit(0), places))).alias("x")).select("node", "n", F.col("x.bucket").alias("bucket"))


def _meet(similarity: int, slack: float):
    """Pairs of a bucket whose sketches don't rule the similarity out; of the buckets that two nodes share the least one counts."""
    values = 2 * SKETCH_PERMUTATIONS
    t = similarity / 100
    least = values * (t + (1 - t) / 256 - slack * (t * (1 - t) / values) ** 0.5)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            bucket = right["bucket"][0].as_py()
            sketches = np.frombuffer(b"".join(right["sketch"].to_pylist()), np.uint8).reshape(right.num_rows, values)
            nodes, sizes, groups, buckets = right["node"].to_numpy(), right["n"].to_numpy(), right["component"].to_numpy(), right["buckets"]
            for node, n, group, sketch, own in zip(*(left[x].to_pylist() for x in ("out_node", "out_n", "out_component", "out_sketch", "out_buckets")), strict=True):
                fits = (groups != group) & (100 * np.minimum(sizes, n) >= similarity * np.maximum(sizes, n))
                at = np.flatnonzero(fits)
                alike = at[(sketches[at] == np.frombuffer(sketch, np.uint8)).sum(axis=1) >= least]
                mine = set(own)
                out += [(min(node, int(nodes[i])), max(node, int(nodes[i]))) for i in alike.tolist() if min(mine.intersection(buckets[i].as_py())) == bucket]
        return pa.table([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return meet


def _remaining(rare: DataFrame, sketched: DataFrame, groups: DataFrame, similarity: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of different components that a bucket of rare shingles holds and the sketches allow.

    In each bucket the nodes outside its largest component meet all others. A
    large bucket is dealt out: parts of either side meet in tasks of bounded size.
    """
    inside = _components_of(rare, groups)
    sizes = inside.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.sum("c").alias("m"), F.count("*").alias("several"), F.max("c").alias("most")).filter("several > 1")
    parts = lambda n: F.ceil(n / F.lit(float(MEETING))).cast("int")
    mixed = mixed.select("bucket", "largest", parts(F.col("m") - F.col("most")).alias("outs"), parts(F.col("m")).alias("alls"))
    inside = scratch.save(inside.join(mixed, "bucket"), "mixed")
    own = inside.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))
    inside = scratch.save(inside.join(own, "node").join(sketched.select("node", "sketch"), "node"), "meeting")
    part = lambda n: F.pmod(F.xxhash64("node"), n.cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    right = inside.withColumn("all_part", part(F.col("alls"))).withColumn("out_part", each(F.col("outs")))
    left = inside.filter("component <> largest").withColumn("out_part", part(F.col("outs"))).withColumn("all_part", each(F.col("alls")))
    left = left.select(F.col("bucket").alias("at"), "out_part", "all_part", *(F.col(c).alias(f"out_{c}") for c in ("node", "n", "component", "sketch", "buckets")))
    left = left.select(*(F.col(c).alias(c) for c in ("at", "all_part")), F.col("out_part").alias("part"), *(f"out_{c}" for c in ("node", "n", "component", "sketch", "buckets")))
    right = right.select("bucket", "out_part", "all_part", "node", "n", "component", "sketch", "buckets")
    return left.groupBy("at", "part", "all_part").cogroup(right.groupBy("bucket", "out_part", "all_part")).applyInArrow(_meet(similarity, SKETCH_SLACK), "a long, b long").distinct()


def _components_of(entries: DataFrame, groups: DataFrame) -> DataFrame:
    return entries.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, similarity: int) -> DataFrame:
    return (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
        .select("a", "b", "a_text", "b_text")
        .mapInArrow(lambda batches: _confirm(batches, size, similarity), "a long, b long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, similarity: int = SIMILARITY, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Rows with equal shingle sets are one node. In each bucket of a band, or part
    of a large one, a pivot is compared with every other node of similar size. Nodes of buckets that
    still hold several components are dealt again by their rarest shingles (an
    exact prefix filter: similar sets must share one), so that documents which
    merely share a passage part. In these buckets all pairs of different
    components are compared by sketches of 1024 values, inside the tasks, and
    those that may be similar are confirmed on the full sets.
    No pair between members of one component is formed.

    Null or empty texts have 0 shingles and stand alone. A null id keeps its
    row, with a null component, and links nothing. Rows that share an id are one
    document. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    fits = f"100 * least(n, pivot_n) >= {similarity} * greatest(n, pivot_n)"
    pair = (F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.save(sign(docs, size, permutations, bands), "signed")
        nodes = scratch.save(signed.filter("doc_id is not null and n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")
        shared = scratch.save(_with_pivots(nodes.select("node", "n", F.explode("bands").alias("bucket")), nodes.count() * bands, scratch), "shared")
        wanted = scratch.save(shared.filter(f"node <> pivot and {fits}").select(*pair).distinct(), "pairs-0")
        texts = scratch.save(docs.join(shared.select(F.col("node").alias("doc_id")).distinct(), "doc_id").dropDuplicates(["doc_id", "text"]), "texts")
        tested = wanted
        links = scratch.save(_confirmed(wanted, texts, size, similarity), "links-0")
        groups = cut(components(links))
        mixed = _components_of(shared, groups).groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
        unsettled = scratch.save(shared.join(mixed, "bucket", "left_semi").select(F.col("node").alias("doc_id")).distinct(), "unsettled")
        sketched = scratch.save(texts.join(unsettled, "doc_id").mapInArrow(per_batch(_sketch, size), "node long, n long, shingles array<long>, sketch binary"), "sketched")
        sketched = sketched.filter("n > 0")
        rare = scratch.save(_rare_shingles(sketched, similarity), "rare")
        wanted = scratch.save(_remaining(rare, sketched, groups, similarity, scratch), "pairs-1")
        more = scratch.save(_confirmed(wanted.join(tested, ["a", "b"], "left_anti"), texts, size, similarity), "links-1")
        if not more.isEmpty():
            groups = cut(components(links.unionByName(more)))
        by_set = signed.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"))
        by_set = by_set.join(groups, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component_id"))
        found = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(by_set, ["set_a", "set_b"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
        return cut(found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def op10_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@apart
def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate component stays, that of the least id.

    Each text is judged for itself, also where ids are null (they come last) or
    shared. Rows with neither an id nor a word stay; repeated rows become one;
    an empty table stays empty; all columns are kept.
    """
    bounded(spark)
    rows = with_row_key(docs)
    found = near_duplicates(rows, id_col=ROW_KEY).select(F.col("doc_id").alias(ROW_KEY), "n_shingles", "component_id").distinct()
    ids = rows.select(ROW_KEY, F.col("doc_id").alias("id")).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(ROW_KEY).alias("key")))
    kept = found.join(ids, ROW_KEY).groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias(ROW_KEY))
    blank = found.filter("n_shingles = 0").join(ids.filter("id is null"), ROW_KEY, "left_semi").select(ROW_KEY)
    one = rows.join(kept.join(blank, ROW_KEY, "left_anti"), ROW_KEY, "left_semi").dropDuplicates(["doc_id", ROW_KEY])
    return one.unionByName(rows.join(blank, ROW_KEY, "left_semi")).select(docs.columns)


QUERIES = {"op10_minmax_near_dedup": op10_minmax_near_dedup}
ORACLE: dict[str, str] = {}
