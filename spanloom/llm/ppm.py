"""Language-model scoring by prediction by partial matching over bytes.

A context trie of byte counts, with escape estimates (half a count for each
distinct symbol of a context) and exclusion of symbols that longer contexts have
seen, gives every document's code length. Shorter contexts count a symbol once
for each longer context that it followed, not for each occurrence. The trie is
pretrained on the training documents and never whole in one place: it is dealt
out by the last two bytes of the context, and each block of documents gets the
probabilities of its own byte strings back. Word counts for the unigram base
travel the same way.

Blocks hold about BLOCK_BYTES of text and the number of buckets is fixed, so
messages grow in proportion to the text. A bucket of more than BUCKET_BYTES is
cut into parts by block: each part adds up its own counts, the sums form the
bucket's trie, and every part meets a copy of it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut, held_out, table, utf8, words

#: Bytes of context. A string of ORDER + 1 bytes is packed in an integer, the symbol last.
ORDER = 5
#: Bytes that UTF-8 never holds stand for what precedes a text and for its end.
BEFORE, END = 0xFE, 0xFF
SYMBOLS = 256
#: Text bytes in a block of documents, on average: a block, its strings and words are in memory at once.
BLOCK_BYTES = 1 << 22
#: Text bytes handled at once inside a block.
CHUNK_BYTES = 1 << 21
#: Buckets of strings and of words, and the packed bytes of a bucket that one task takes.
BUCKETS, BUCKET_BYTES = 256, 1 << 23
#: Parts of the set of byte trigrams, by their first bits.
TRIGRAM_PARTS = 16


def strings(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed strings (context and symbol) at every position of the texts and ends, and the text each is of."""
    padded = np.frombuffer(b"".join(bytes([BEFORE] * order) + t + bytes([END]) for t in texts), np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    packed = np.zeros(max(0, len(padded) - order), np.uint64)
    for j in range(order + 1):
        packed = (packed << np.uint64(8)) | padded[j : len(padded) - order + j]
    # In the join the strings that start in one text and end in the next one's padding are left out.
    starts = np.cumsum(lengths + order) - lengths - order
    at = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return packed[at], np.repeat(np.arange(len(texts)), lengths)


def _chunks(texts: list[bytes]):
    """Runs of texts of about CHUNK_BYTES; a longer text is a run of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs."""
    values = np.sort(values)
    starts = _runs(values)
    return values[starts], np.diff(np.r_[starts, len(values)])


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums the counts of equal values."""
    values, counts = np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    starts = _runs(values)
    return values[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def block_strings(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of the texts and their counts, added up chunk by chunk."""
    total = (np.empty(0, np.uint64), np.empty(0, np.int64))
    for a, b in _chunks(texts):
        total = _add([total, counted(strings(texts[a:b], order)[0])])
    return total


def bucket_of_strings(values: np.ndarray, buckets: int) -> np.ndarray:
    """By the last two bytes of the context, so that a bucket holds all nodes of order 2 and more that it needs."""
    suffix = (values >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((suffix * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def by_bucket(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values in order of their buckets, and where each of the BUCKETS begins and the last ends."""
    of = bucket_of_strings(values, BUCKETS).astype(np.uint8)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(BUCKETS + 1))


def dealt_words(found, buckets: int) -> list[list[bytes]]:
    """Distinct words in order, dealt into buckets by hash."""
    dealt: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in sorted(found):
        dealt[xxhash.xxh3_64_intdigest(w) % buckets].append(w)
    return dealt


_SENT = "block int, kind string, bucket int, keys binary, counts binary"
_SENT_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def packed(values: np.ndarray) -> bytes:
    """Integers as bytes, most significant ones together, compressed: sorted strings share their first bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    columns = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(columns.T).view(">u8").ravel().astype(np.uint64)


def _frame(out: list[tuple]) -> pa.Table:
    columns = zip(*out, strict=True) if out else [()] * len(_SENT_ARROW)
    return pa.table([pa.array(x, f.type) for x, f in zip(columns, _SENT_ARROW, strict=True)], schema=_SENT_ARROW)


def _gather(rows: pa.Table, longest: int) -> pa.Table:
    """A block's distinct strings and words, each with its training count (0 if only held-out documents have it)."""
    block, texts = rows["block"][0].as_py(), utf8(rows["text"].combine_chunks())
    held = rows["held_out"].to_pylist()
    train, other = ([t for t, h in zip(texts, held, strict=True) if h is x] for x in (False, True))
    out: list[tuple] = []
    known, counts = block_strings(train, longest)
    trigrams = counted(known & np.uint64(0xFFFFFF))[0]
    for part in np.unique(trigrams >> np.uint64(20)).tolist():
        out.append((block, "trigram", part, packed(trigrams[trigrams >> np.uint64(20) == part]), None))
    unseen, none = block_strings(other, longest)
    own, full = _add([(known, counts), (unseen, np.zeros_like(none))])
    del known, counts, unseen, none
    order, starts = by_bucket(own)
    for b in np.flatnonzero(np.diff(starts)).tolist():
        at = order[starts[b] : starts[b + 1]]
        out.append((block, "string", b, packed(own[at]), packed(full[at])))
    del own, full, order
    learnt: Counter = Counter()
    for t in train:
        learnt.update(words(t))
    met = {w for t in other for w in words(t)}
    for b, mine in enumerate(dealt_words(met.union(learnt), BUCKETS)):
        if mine:
            out.append((block, "word", b, b"\n".join(mine), packed(np.array([learnt.get(w, 0) for w in mine], np.int64))))
    out.append((block, "end", 0, b"", packed(np.array([len(train)]))))
    return _frame(out)


def _union(rows: pa.Table) -> pa.Table:
    """The distinct values of a part."""
    values = counted(np.concatenate([unpacked(x) for x in rows["keys"].to_pylist()]))[0]
    return pa.table([pa.array([packed(values)], pa.binary())], names=["keys"])


def pair_counts(trigrams: np.ndarray) -> np.ndarray:
    """Symbol counts after each byte, 256 x 256: once for each byte that stood before the two."""
    pairs = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    np.add.at(pairs, ((trigrams >> np.uint64(8)).astype(np.int64) & 255, trigrams.astype(np.int64) & 255), 1)
    return pairs


def _found(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted value in sorted ``values``, and whether it is there."""
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


class Trie:
    """Counts of symbols after the contexts of one bucket, for orders 2 and up, over the counts of orders 1 and 0.

    A symbol that followed a context also followed its shorter ones, so the
    symbols to exclude at an order are those of the next longer context, and
    sums over them are taken once for each context.
    """

    def __init__(self, values: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int):
        """values, counts: strings seen in training. pairs: symbol counts after each byte, 256 x 256."""
        self.order = order
        symbols = (pairs > 0).sum(axis=0)
        #: For each order: strings with their counts; contexts with sum and number of their symbols, and the sum of
        #: those symbols' counts one order down.
        self.levels: list[tuple[np.ndarray, ...]] = []
        keys, n = values, counts
        for k in range(order, -1, -1):
            if k == 1:
                b, s = np.nonzero(pairs)
                keys, n = (b.astype(np.uint64) << np.uint64(8)) | s.astype(np.uint64), pairs[b, s]
            elif k == 0:
                keys = np.flatnonzero(symbols).astype(np.uint64)
                n = symbols[keys.astype(np.int64)]
            elif k < order:
                keys, n = _add([(keys & np.uint64((1 << 8 * (k + 1)) - 1), np.ones_like(n))])
            starts = _runs(keys >> np.uint64(8))
            if self.levels:
                above, _, above_starts, *_ = self.levels[-1]
                below = n[np.searchsorted(keys, above & np.uint64((1 << 8 * (k + 1)) - 1))] if len(above) else np.empty(0, np.int64)
                self.levels[-1] = (*self.levels[-1], np.add.reduceat(below, above_starts) if len(above) else below)
            sums = np.add.reduceat(n, starts) if len(n) else np.empty(0, np.int64)
            self.levels.append((keys, n, starts, (keys >> np.uint64(8))[starts], sums, np.diff(np.r_[starts, len(keys)])))

    def log10(self, values: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of each string after its context: escapes of method D, exclusion of symbols seen higher up."""
        left, out, open_ = np.zeros(len(values)), np.zeros(len(values)), np.ones(len(values), bool)
        shut_sum, shut = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        for k, (keys, n, _, contexts, sums, distinct, *below) in zip(range(self.order, -1, -1), self.levels, strict=True):
            at, there = _found(contexts, (values >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1))
            if not len(contexts):
                continue
            total, fresh = 2 * (sums[at] - shut_sum), distinct[at] - shut
            active = open_ & there & (fresh > 0)
            place, hit = _found(keys, values & np.uint64((1 << 8 * (k + 1)) - 1))
            hit &= active
            out[hit] = left[hit] + np.log10((2 * n[place[hit]] - 1) / total[hit])
            open_ &= ~hit
            miss = active & ~hit
            left[miss] += np.log10(fresh[miss] / total[miss])
            shut = np.where(there, distinct[at], 0)
            shut_sum = np.where(there, below[0][at], 0) if below else shut
        if open_.any():
            out[open_] = left[open_] - np.log10(SYMBOLS - shut[open_])
        return out


def _strings_of(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _add([(unpacked(k), unpacked(c).astype(np.int64)) for k, c in zip(keys, counts, strict=True)])


def _words_of(keys: list[bytes], counts: list[bytes]) -> dict[bytes, int]:
    total: dict[bytes, int] = {}
    for mine, n in zip(keys, counts, strict=True):
        for w, c in zip(mine.split(b"\n"), unpacked(n).tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    return total


def _sum_part(rows: pa.Table) -> pa.Table:
    """One row with the training counts of a bucket's part, or of the parts' sums."""
    kind, bucket, keys, counts = rows["kind"][0].as_py(), rows["bucket"][0].as_py(), rows["keys"].to_pylist(), rows["counts"].to_pylist()
    if kind == "string":
        values, n = _strings_of(keys, counts)
        return _frame([(-1, kind, bucket, packed(values[n > 0]), packed(n[n > 0]))])
    total = {w: c for w, c in _words_of(keys, counts).items() if c}
    return _frame([(-1, kind, bucket, b"\n".join(total), packed(np.fromiter(total.values(), np.int64, len(total))))] if total else [])


def _answers(asked: pa.Table, known: pa.Table, pairs: np.ndarray, order: int) -> list[tuple]:
    """What each block asked of a bucket, by the counts in ``known``."""
    kind, bucket = asked["kind"][0].as_py(), asked["bucket"][0].as_py()
    keys, counts = known["keys"].to_pylist(), known["counts"].to_pylist()
    out = []
    if kind == "word":
        total = _words_of(keys, counts)
        for block, mine in zip(asked["block"].to_pylist(), asked["keys"].to_pylist(), strict=True):
            mine = mine.split(b"\n")
            out.append((block, kind, bucket, packed(np.fromiter((total.get(w, 0) for w in mine), np.int64, len(mine))), None))
        return out
    values, n = _strings_of(keys, counts) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
    trie = Trie(values[n > 0], n[n > 0], pairs, order)
    del n, keys, counts
    wanted = counted(np.concatenate([unpacked(mine) for mine in asked["keys"].to_pylist()]))[0]
    log = trie.log10(wanted).astype(np.float32)
    for block, mine in zip(asked["block"].to_pylist(), asked["keys"].to_pylist(), strict=True):
        out.append((block, kind, bucket, log[np.searchsorted(wanted, unpacked(mine))].tobytes(), None))
    return out


def _sums(known: pa.Table) -> tuple:
    """Tokens and distinct words of a bucket of words."""
    total = _words_of(known["keys"].to_pylist(), known["counts"].to_pylist())
    return (-1, "sums", known["bucket"][0].as_py(), packed(np.array([sum(total.values()), sum(c > 0 for c in total.values())])), None)


def _answer(pairs: np.ndarray, order: int):
    """A whole bucket: its counts and its answers at once."""

    def answer(rows: pa.Table) -> pa.Table:
        return _frame([*_answers(rows, rows, pairs, order), *([_sums(rows)] if rows["kind"][0].as_py() == "word" else [])])

    return answer


def _answer_part(pairs: np.ndarray, order: int):
    """A part of a bucket that meets the bucket's counts; the first part tells the sums."""

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        first = known.num_rows and known["part"][0].as_py() == 0 and known["kind"][0].as_py() == "word"
        return _frame([*(_answers(asked, known, pairs, order) if asked.num_rows else []), *([_sums(known)] if first else [])])

    return answer


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, word_log double, score double"


def _score(order: int, ends: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = utf8(docs["text"].combine_chunks()) if docs.num_rows else []
        parts = []
        for a, b in _chunks(texts):
            values, text = strings(texts[a:b], order)
            distinct, at = np.unique(values, return_inverse=True)
            parts.append((a, b, distinct, at.astype(np.int32), text.astype(np.int32)))
            del values, text, at
        own = counted(np.concatenate([np.empty(0, np.uint64), *(x[2] for x in parts)]))[0]
        (of, begin), log = by_bucket(own), np.zeros(len(own), np.float32)
        tokens_of = [words(t) for t in texts]
        dealt = dealt_words(set().union(*tokens_of), BUCKETS)
        counts: dict[bytes, int] = {}
        for kind, b, keys in zip(*(answers[x].to_pylist() for x in ("kind", "bucket", "keys")), strict=True):
            if kind == "string":
                log[of[begin[b] : begin[b + 1]]] = np.frombuffer(keys, np.float32)
            else:
                counts.update(zip(dealt[b], unpacked(keys).tolist(), strict=True))
        del dealt, of
        scores = np.zeros(len(texts))
        for a, b, distinct, at, text in parts:
            scores[a:b] = np.bincount(text, log[np.searchsorted(own, distinct)][at], b - a)
        del parts
        n_tokens, n_known, word_log = [], [], []
        for tokens in tokens_of:
            c = np.fromiter(map(counts.__getitem__, tokens), np.int64, len(tokens))
            n_tokens.append(len(c) + 1)
            n_known.append(int((c > 0).sum()) + (ends > 0))
            word_log.append(float(np.log10(c + 1.0).sum()) + float(np.log10(ends + 1.0)))
        return pa.table([docs["doc_id"], docs["held_out"], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(word_log, pa.float64()), pa.array(scores)], names=["doc_id", "held_out", "n_tokens", "n_known", "word_log", "score"])

    return score


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str | None = None, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Learns from the rows whose ``held_col`` is not true (all, without one).
    score is the log10 probability of the text and its end under the trie;
    base_score that of its words and end under add-one unigrams.

    Documents are dealt into blocks by a hash of id and text. Null and empty
    texts are an end alone. Repeated rows are scored each; null ids stay. ``order``
    is 2 to 7.
    Without training rows the trie is uniform; an empty table gives an empty
    result. A text longer than a block is a block's whole work, in chunks.
    """
    spark = docs.sparkSession
    held = F.coalesce(docs[held_col].cast("boolean"), F.lit(False)) if held_col else F.lit(False)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), held.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // BLOCK_BYTES)))).cast("int"))
    with Scratch(spark) as scratch:
        sent = scratch.save(rows.groupBy("block").applyInArrow(lambda t: _gather(t, order), _SENT), "sent")
        # At most 2**24 trigrams, whatever the input: their union is formed in executors, each part once.
        trigrams = [unpacked(x) for (x,) in sent.filter("kind = 'trigram'").groupBy("bucket").applyInArrow(_union, "keys binary").collect()]
        pairs = pair_counts(np.concatenate([np.empty(0, np.uint64), *trigrams]))
        ends = sum(int(unpacked(x)[0]) for (x,) in sent.filter("kind = 'end'").groupBy((F.col("block") % 64).alias("part")).applyInArrow(_add_ends, "ends binary").collect())
        asked = sent.filter("kind in ('string', 'word')")
        parts = asked.groupBy("kind", "bucket").agg(F.ceil(F.sum(F.length("keys") + F.length("counts")) / F.lit(float(BUCKET_BYTES))).alias("parts"))
        large = {(r["kind"], r["bucket"]): r["parts"] for r in parts.filter("parts > 1").collect()}  # at most 2 * BUCKETS
        if large:
            of = F.create_map(*(F.lit(x) for (kind, bucket), n in large.items() for x in (f"{kind}{bucket}", n)))
            asked = asked.withColumn("parts", F.coalesce(of[F.concat("kind", F.col("bucket").cast("string"))], F.lit(1)))
            cut_up = asked.filter("parts > 1").withColumn("part", F.pmod(F.xxhash64("block"), "parts").cast("int"))
            asked = asked.filter("parts = 1")
            summed = cut_up.groupBy("kind", "bucket", "part").applyInArrow(_sum_part, _SENT).groupBy("kind", "bucket").applyInArrow(_sum_part, _SENT)
            summed = scratch.save(summed, "summed").withColumn("part", F.explode(F.sequence(F.lit(0), of[F.concat("kind", F.col("bucket").cast("string"))].cast("int") - 1)))
            in_parts = cut_up.groupBy("kind", "bucket", "part").cogroup(summed.groupBy("kind", "bucket", "part")).applyInArrow(_answer_part(pairs, order), _SENT)
        answers = asked.select(*sent.columns).groupBy("kind", "bucket").applyInArrow(_answer(pairs, order), _SENT)
        answers = scratch.save(answers.unionByName(in_parts) if large else answers, "answers")
        scratch.drop("sent")
        tokens, distinct = ends, int(ends > 0)
        for (x,) in answers.filter("kind = 'sums'").select("keys").collect():  # at most BUCKETS
            n, v = unpacked(x).tolist()
            tokens, distinct = tokens + n, distinct + v
        scored = rows.groupBy("block").cogroup(answers.filter("kind <> 'sums'").groupBy("block")).applyInArrow(_score(order, ends), _SCORED)
        base = F.col("word_log") - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))
        return cut(scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score"))


def _add_ends(rows: pa.Table) -> pa.Table:
    return pa.table([pa.array([packed(np.array([sum(int(unpacked(x)[0]) for x in rows["counts"].to_pylist())]))], pa.binary())], names=["ends"])


def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.withColumn("held", held_out(docs["doc_id"], 7, 2)), held_col="held")


QUERIES = {"op2_ppm_scores": op2_ppm_scores}
ORACLE: dict[str, str] = {}
