"""Removal of word sequences that an earlier document holds, by level-wise doubling.

A window of 50 words that repeats holds windows of 25 and of 13 that do. The
first level looks at one window of 13 words for each window of 50, the one of
least hash, which copies choose alike. Those that several documents share are
extended to both sides to 25 words, those that survive to all windows of 50
around them, whose 128-bit hashes decide. A level shuffles hashes and ids only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, apart, bounded, cache_of, cut, join_hot, table, utf8
from .minhash import _WordHashes

WINDOW = 50
#: Bases of the two window hashes (odd) and of their last mixing.
_BASE, _OTHER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xFF51AFD7ED558CCD)
#: A null id counts as the largest.
_LAST = 2**63 - 1


def lengths(window: int) -> tuple[int, int]:
    """Lengths of the first two levels: each level's is at most twice the one before it."""
    half = -(-window // 2)
    return -(-half // 2), half


def window_hashes(words: np.ndarray, length: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A hash of the ``length`` words from each position on, made by doubling; empty if there are fewer words."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    h, m = words, 1
    for bit in f"{length:b}"[1:]:
        h, m = h[:-m] * np.uint64(pow(int(base), m, 2**64)) + h[m:], 2 * m
        if bit == "1":
            h, m = h[:-1] * base + words[m:], m + 1
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(32))


def _sliding(of: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``of`` over each ``width`` neighbours."""
    if len(x) < width:
        return x[:0]
    m = 1
    while 2 * m <= width:
        x, m = of(x[:-m], x[m:]), 2 * m
    rest = width - m
    return of(x[:-rest], x[rest:]) if rest else x


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, half): hashes of the least first-level window of every window, and of its extensions to either side; each pair once."""
    first, half = lengths(window)
    h, longer = window_hashes(words, first), window_hashes(words, half)
    width = window - first + 1
    least = _sliding(np.minimum, h, width)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, least, edge]), width) == h)
    right, left = at[at < len(longer)], at[at >= half - first]
    pairs = np.concatenate([h[right], h[left]]), np.concatenate([longer[right], longer[left - (half - first)]])
    _, once = np.unique(pairs[0] * _OTHER ^ pairs[1], return_index=True)
    return pairs[0][once], pairs[1][once]


class _Hashes:
    """Words of texts as 64-bit hashes."""

    def __init__(self):
        cache_of("substrings")
        self.of = _WordHashes()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.of.__getitem__, words), np.uint64, len(words))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_PARSED = "doc_id long, doc long, key long, n_words long, digest binary, first array<long>, half array<long>"


def _parse(batches, window):
    hashes = _Hashes()
    for batch in batches:
        counts, digests, first, half = [], [], [], []
        for text in utf8(batch.column("text")):
            words = text.split()
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).digest())
            a, b = anchors(hashes(words), window) if len(words) >= window else (None, None)
            first.append(None if a is None else _signed(a))
            half.append(None if b is None else _signed(b))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "doc", "key")), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(first, longs), pa.array(half, longs)], names=["doc_id", "doc", "key", "n_words", "digest", "first", "half"])


def _windows(batches, window):
    """Whole windows around the second-level windows that are left, each once for a document: doc, key, a, b."""
    hashes, (_, half) = _Hashes(), lengths(window)
    for batch in batches:
        for doc, key, text, left in zip(batch.column("doc").to_pylist(), batch.column("key").to_pylist(), utf8(batch.column("text")), batch.column("halves"), strict=True):
            words = hashes(text.split())
            found = np.isin(_signed(window_hashes(words, half)), left.values.to_numpy(zero_copy_only=False))
            at = np.flatnonzero(_sliding(np.maximum, found, window - half + 1))
            a, b = window_hashes(words, window)[at], window_hashes(words, window, _OTHER)[at]
            a, once = np.unique(a, return_index=True)
            for i in range(0, len(a), 1 << 17):
                part = a[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), doc)), pa.array(np.full(len(part), key)), pa.array(_signed(part)), pa.array(_signed(b[once[i : i + len(part)]]))], names=["doc", "key", "a", "b"])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _cut(batches, window):
    """What is left of a document without the given windows: removed word ranges and the digest of the words kept."""
    hashes = _Hashes()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        removed, digests = [], []
        for text, gone in zip(utf8(batch.column("text")), batch.column("gone"), strict=True):
            words = text.split()
            flags = np.isin(_signed(window_hashes(hashes(words), window)), gone.values.to_numpy(zero_copy_only=False)).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(flags), np.full(window - 1, flags.sum())])
            covered = total[1:] > np.concatenate([np.zeros(window, np.int64), total])[1 : len(words) + 1]
            starts, ends = runs(covered)
            removed.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
            digests.append(hashlib.sha256(b" ".join([w for w, x in zip(words, covered.tolist(), strict=True) if not x])).digest())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(removed, span), pa.array(digests, pa.binary())], names=["doc", "key", "removed", "kept"])


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that rows of several documents hold, with the least of their ids."""
    return rows.groupBy(*keys).agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner < last").select(*keys, "owner")


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_words, removed (ranges of words, ends exclusive), kept_sha256 for each row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts in a
    document of smaller id. Documents of equal words as one of smaller id go
    whole without being searched. Null and empty texts have no words; a null id
    counts as the largest; rows that share an id do not remove each other's
    windows; repeated rows get equal results. An empty table gives no rows;
    other columns are ignored.
    """
    key = ["doc", "key"]
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(docs[text_col]).alias("key"), docs[text_col].alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        parsed = scratch.save(texts.mapInArrow(lambda batches: _parse(batches, window), _PARSED), "parsed")
        full = parsed.filter(F.col("n_words") >= window).select(*key, "digest")
        copies = scratch.save(join_hot(full, scratch.save(_shared(full, "digest"), "digests"), "digest").filter("doc > owner").select(*key).distinct(), "copies")
        rows = parsed.filter("first is not null").join(copies, key, "left_anti").select(*key, F.explode(F.arrays_zip("first", "half")).alias("x")).select(*key, "x.first", "x.half")
        rows = scratch.save(rows, "level-1")
        rows = rows.join(scratch.save(_shared(rows, "first"), "shared-1"), "first").select(*key, "half").distinct()
        rows = scratch.save(rows, "level-2")
        left = rows.join(scratch.save(_shared(rows, "half"), "shared-2"), "half").groupBy(*key).agg(F.collect_set("half").alias("halves"))
        rows = scratch.save(texts.join(left, key).select(*key, "text", "halves").mapInArrow(lambda batches: _windows(batches, window), "doc long, key long, a long, b long"), "level-3")
        gone = rows.join(scratch.save(_shared(rows, "a", "b"), "shared-3"), ["a", "b"]).filter("doc > owner").groupBy(*key).agg(F.collect_set("a").alias("gone"))
        some = texts.join(gone, key).select(*key, "text", "gone").mapInArrow(lambda batches: _cut(batches, window), "doc long, key long, removed array<struct<start: long, end: long>>, kept binary")
        some = scratch.save(some.dropDuplicates(key), "cut")
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
        found = parsed.drop("first", "half").join(some, key, "left").join(copies.withColumn("copy", F.lit(True)), key, "left")
        removed = F.when(F.col("copy"), whole).otherwise(F.coalesce("removed", F.array().cast("array<struct<start: long, end: long>>")))
        kept = F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex(F.coalesce("kept", "digest"))))
        return cut(found.select("doc_id", F.col("key").alias("text_key"), "n_words", removed.alias("removed"), kept.alias("kept_sha256")))


def without(text: F.Column, removed: F.Column) -> F.Column:
    """The words of ``text`` outside the ranges ``removed``, joined by one space."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.concat_ws(" ", F.filter(words, lambda w, i: ~F.exists(removed, lambda r: (r["start"] <= i) & (i < r["end"]))))


def op11_doubling_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_substrings(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), "kept_sha256")


@apart
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with the kept words of each text; a null text stays null, all columns are kept, whatever their names."""
    bounded(spark)
    key = F.struct("doc_id", F.xxhash64("text").alias("text_key"))
    found = repeated_substrings(docs).select(F.struct("doc_id", "text_key").alias("_found_key"), F.col("removed").alias("_removed")).dropDuplicates(["_found_key"])
    joined = docs.withColumn("_docs_key", key).join(found, F.col("_docs_key").eqNullSafe(F.col("_found_key")), "left")
    return joined.withColumn("text", F.when(F.col("text").isNotNull(), without(F.col("text"), F.col("_removed")))).select(*docs.columns)

QUERIES = {"op11_doubling_substring_dedup": op11_doubling_substring_dedup}
ORACLE = {
    "op11_doubling_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, p, sha256(array_to_string(list_slice(w, p, p + 49), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
gone AS (SELECT doc_id, p FROM win JOIN (SELECT h, min(doc_id) AS owner FROM win GROUP BY h) USING (h) WHERE doc_id > owner),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
flag AS (
  SELECT doc_id, p, word,
    sum(CASE WHEN g.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS covered
  FROM word LEFT JOIN gone g USING (doc_id, p)),
out AS (
  SELECT doc_id, count(*) FILTER (covered) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT covered) AS kept FROM flag GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN out USING (doc_id)""",
}
