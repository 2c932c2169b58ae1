"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the benchmark's terms. A distributed randomised
SVD of all passages gives a latent space; passages whose cosine with a benchmark
item is high enough become candidates, and so do passages that share enough word
pairs with an item. A longest common subsequence and an answer check confirm
them, so paraphrases with inserted or changed words are found.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, Scratch, apart, cache_of, cut, table, utf8, with_row_key

#: A passage is BLOCK_WORDS * a power of two words long, LEAST_SPAN blocks at least, and starts at every block of its
#: document; an item is sought in passages of the least span that is as long as it.
BLOCK_WORDS, LEAST_SPAN = 16, 2
#: Least rank, and items for each further dimension of a larger benchmark.
RANK, ITEMS_A_RANK, OVERSAMPLE = 96, 2, 12
#: A term's weight follows its distinct surroundings (NEIGHBOURS words on either side), counted in so many registers;
#: copies of a passage count once. No weight is less than LEAST_WEIGHT.
NEIGHBOURS, REGISTERS, LEAST_WEIGHT = 2, 256, 0.01
#: Least share of an item's word pairs in a passage that shares them, and the least count (or all, where an item has fewer).
PAIRS, LEAST_PAIRS = 0.25, 4
#: Terms of a row of partial results; passages whose counts are a matrix at once.
SKETCH_TERMS, SKETCH_PASSAGES = 256, 256
#: Words of documents that are handled at once.
LOT_WORDS = 16_384
#: Least cosine of a candidate; least share of the item in the common subsequence, and of its answer terms in the passage.
COSINE, SUBSEQUENCE, ANSWER = 0.5, 0.6, 0.5
#: Benchmark items in one search; a larger benchmark is searched in several.
ITEMS_AT_ONCE = 1_000
#: ASCII in lower case, its marks as spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) else c for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


@dataclass
class Items:
    """Benchmark items in term numbers; answers: the terms of an item's answer."""

    ids: list[int]
    terms: list[list[int]]
    answers: list[list[int]]
    numbers: dict[bytes, int]


def read_items(rows: list[tuple[int, str, str | None]]) -> Items:
    """Numbers the terms. Where there is no answer, the item's last sentence stands for it."""
    numbers: dict[bytes, int] = {}
    clean = lambda text: plain_words(text.encode())
    ids, terms, answers = [], [], []
    for item, text, answer in rows:
        found = [numbers.setdefault(w, len(numbers)) for w in clean(text)]
        if not found:
            continue
        last = answer or next((s for s in reversed(text.replace("!", ".").replace("?", ".").split(".")) if s.strip()), "")
        ids.append(item)
        terms.append(found)
        answers.append(sorted({numbers[w] for w in clean(last) if w in numbers}))
    return Items(ids, terms, answers, numbers)


def rank_of(n_items: int) -> int:
    return max(RANK, -(-n_items // ITEMS_A_RANK))


def spans_of(items: Items) -> np.ndarray:
    """Blocks of the passages in which each item is sought."""
    return np.array([max(LEAST_SPAN, 1 << (-(-len(t) // BLOCK_WORDS) - 1).bit_length()) for t in items.terms])


def common_subsequence(item: list[int], passage: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    at: dict[int, int] = {}
    for i, t in enumerate(item):
        at[t] = at.get(t, 0) | 1 << i
    full, row = (1 << len(item)) - 1, (1 << len(item)) - 1
    for t in passage:
        if matched := row & at.get(t, 0):
            row = ((row + matched) | (row - matched)) & full
    return len(item) - row.bit_count()


def _width(n_terms: int) -> type:
    return np.int16 if n_terms < 2**15 else np.int32


class _Numbers(dict):
    """Term numbers; any other word gets a negative number by its checksum, so that surroundings differ."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        number = ~(crc32(word) % 0x7FFF + 1)
        if len(self) < self.most:
            self[word] = number
        return number


def _number(batches, numbers: dict[bytes, int]):
    """Documents as term numbers, packed as integers of the least width."""
    cache_of("decontamination")
    number, width = _Numbers(numbers).__getitem__, _width(len(numbers))
    for batch in batches:
        coded = [np.fromiter(map(number, plain_words(t)), width).tobytes() for t in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.binary())], names=["doc_id", "terms"])


@dataclass
class Lot:
    """Some documents end to end. Each starts at a block and ends with a padding of -1; ``starts`` are their first blocks."""

    rows: list[int]
    starts: np.ndarray
    words: np.ndarray

    @property
    def known(self) -> np.ndarray:
        return np.flatnonzero(self.words >= 0)


def _lots(column: pa.Array, width: type):
    """Lots of about LOT_WORDS; a longer document is a lot of its own."""

    def lot() -> Lot:
        starts = np.cumsum([0, *(len(t) // BLOCK_WORDS + 1 for t in held)])
        words = np.full(starts[-1] * BLOCK_WORDS, -1, np.int64)
        for t, at in zip(held, starts[:-1] * BLOCK_WORDS, strict=True):
            words[at : at + len(t)] = t
        return Lot(rows, starts, words)

    rows, held, size = [], [], 0
    for i, row in enumerate(column.to_pylist()):
        terms = np.frombuffer(row, width)
        if held and size + len(terms) > LOT_WORDS:
            yield lot()
            rows, held, size = [], [], 0
        rows.append(i)
        held.append(terms)
        size += len(terms)
    if held:
        yield lot()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _surroundings(batches, n_terms: int):
    """Registers of each term's distinct surroundings; those of the last number are of all words'. One row for each SKETCH_TERMS terms."""
    most = np.zeros((n_terms + 1) * REGISTERS, np.uint8)
    for batch in batches:
        for lot in _lots(batch.column(0), _width(n_terms)):
            padded = np.r_[np.full(NEIGHBOURS, -1), lot.words, np.full(NEIGHBOURS, -1)].astype(np.uint64)
            key = np.zeros(len(lot.words), np.uint64)
            for j in range(2 * NEIGHBOURS + 1):
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + padded[j : j + len(key)] + np.uint64(j))
            at = (key % np.uint64(REGISTERS)).astype(np.int64)
            zeros = (65 - np.frexp((key // np.uint64(REGISTERS)).astype(np.float64))[1] - 8).astype(np.uint8)
            there = lot.known
            np.maximum.at(most, lot.words[there] * REGISTERS + at[there], zeros[there])
            held = np.flatnonzero(lot.words != -1)
            np.maximum.at(most, n_terms * REGISTERS + at[held], zeros[held])
    if most.any():
        for low in range(0, n_terms + 1, SKETCH_TERMS):
            part = most[low * REGISTERS : (low + SKETCH_TERMS) * REGISTERS]
            yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])


def _most(rows: pa.Table) -> pa.Table:
    most = np.maximum.reduce([np.frombuffer(x, np.uint8) for x in rows["part"].to_pylist()])
    return pa.table([pa.array([rows["at"][0].as_py()], pa.int64()), pa.array([most.tobytes()], pa.binary())], names=["at", "part"])


def distinct(registers: np.ndarray) -> np.ndarray:
    """Distinct keys that each row of registers has seen (HyperLogLog; linear counting while registers are empty)."""
    m = registers.shape[1]
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.ldexp(1.0, -registers.astype(np.int64)).sum(axis=1)
    empty = (registers == 0).sum(axis=1)
    return np.where((raw <= 2.5 * m) & (empty > 0), m * np.log(m / np.maximum(empty, 1)), raw)


def term_weights(counts: np.ndarray, total: float) -> np.ndarray:
    """Inverse frequencies: minus the log of the share of blocks that would hold the term, if it were dealt evenly; never 0."""
    share = np.minimum((1 + counts) / (2 + total), 1.0)
    return np.maximum(-np.log(np.maximum(-np.expm1(BLOCK_WORDS * np.log1p(-np.minimum(share, 1 - 1e-9))), 1e-300)), LEAST_WEIGHT)


def _rows_of(lot: Lot, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms with the number of their passage: non-overlapping passages of ``span`` blocks, from the start of each document."""
    known = lot.known
    block = known // BLOCK_WORDS
    doc = np.searchsorted(lot.starts, block, side="right") - 1
    firsts = np.cumsum(np.r_[0, -(-np.diff(lot.starts) // span)])
    return firsts[doc] + (block - lot.starts[doc]) // span, lot.words[known]


def _sketch(batches, weights: np.ndarray, omega: np.ndarray, span: int):
    """This partition's share of A'(A omega) for unit rows A; one row for each SKETCH_TERMS terms."""
    total = np.zeros(omega.shape, np.float64)
    weighted = (omega * weights[:, None]).astype(np.float32)
    for lot in (x for batch in batches for x in _lots(batch.column(0), _width(len(weights)))):
        passage, term = _rows_of(lot, span)
        for low in range(0, passage[-1] + 1 if len(term) else 0, SKETCH_PASSAGES):
            part = slice(*np.searchsorted(passage, [low, low + SKETCH_PASSAGES]))
            which, at = np.unique(term[part], return_inverse=True)
            counts = np.bincount((passage[part] - low) * len(which) + at, minlength=SKETCH_PASSAGES * len(which)).reshape(SKETCH_PASSAGES, len(which))
            counts = counts[counts.any(axis=1)].astype(np.float32)
            y = counts @ weighted[which]
            y /= (counts @ weights[which] ** 2)[:, None]  # both rows of the product have the passage's norm
            total[which] += (counts.T @ y) * weights[which][:, None]
    for at in range(0, len(total), SKETCH_TERMS):
        part = total[at : at + SKETCH_TERMS]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])


def _add_sketch(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in rows["part"].to_pylist())
    return pa.table([pa.array([rows["at"][0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["at", "part"])


def right_vectors(sketch: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of A from (A'A) omega, by the Nystrom formula."""
    core = omega.T @ sketch
    core = (core + core.T) / 2
    shift = 1e-9 * max(np.trace(core), 1e-12)
    try:
        root = np.linalg.cholesky(core + shift * np.eye(len(core)))
        low = np.linalg.solve(root, sketch.T).T
    except np.linalg.LinAlgError:
        low = np.linalg.qr(sketch)[0]
    return np.linalg.svd(low, full_matrices=False)[0][:, :rank]


class Pairs:
    """Word pairs of the items, sorted, with the items that hold each; an item of one word has that word alone."""

    def __init__(self, items: Items, spans: np.ndarray):
        self.n = n = len(items.numbers)
        own = [sorted({a * n + b for a, b in zip(t, t[1:])} or {n * n + t[0]}) for t in items.terms]  # noqa: B905
        codes, which = np.concatenate([np.array(x, np.int64) for x in own]), np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(codes, kind="stable")
        self.items = which[order]
        self.codes, self.firsts, self.counts = np.unique(codes[order], return_index=True, return_counts=True)
        self.singles = bool(self.codes[-1] >= n * n)
        self.least = np.array([max(math.ceil(PAIRS * len(x)), min(len(x), LEAST_PAIRS)) for x in own])
        self.steps = spans * BLOCK_WORDS

    def shared(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start): passages of twice the item's step that hold enough of its pairs."""
        at = np.flatnonzero((words[:-1] >= 0) & (words[1:] >= 0))
        code = words[at] * self.n + words[at + 1]
        if self.singles:
            alone = np.flatnonzero(words >= 0)
            at, code = np.r_[at, alone], np.r_[code, self.n * self.n + words[alone]]
        found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[found] == code)
        at, found = at[hit], found[hit]
        n = self.counts[found]
        item = self.items[np.repeat(self.firsts[found] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        wide = len(words) + 2
        key, count = np.unique(item * wide + np.repeat(at, n) // self.steps[item] + 1, return_counts=True)
        starts = np.unique(np.r_[key, key - 1])
        total = np.zeros(len(starts), np.int64)
        total[np.searchsorted(starts, key)] += count
        total[np.searchsorted(starts, key - 1)] += count
        item = starts // wide
        enough = total >= self.least[item]
        item, start = item[enough], starts[enough] % wide - 1
        return item, start * self.steps[item]


def _longer(rows: np.ndarray, left: np.ndarray, by: int, join) -> np.ndarray:
    """Rows joined with those ``by`` blocks on in the same document; ``left``: blocks from each to its document's end."""
    out, at = rows.copy(), np.flatnonzero(left > by)
    out[at] = join(rows[at], rows[at + by])
    return out


def _near(lot: Lot, latent: np.ndarray, sought: list, cosine: float, filled: dict[int, np.ndarray], least: np.ndarray, lengths: np.ndarray):
    """(item, first and last block of a passage, cosine) by the latent space; the items of each span at once.

    ``filled``: for each span its items' terms, those of most weight first, filled up with the number after
    the last one; ``least``: how many of them a passage and a span on either
    side of it must hold, as the subsequence can't be longer. The others of an item's
    ``lengths`` may be missing, so the first half of the terms tells most passages.
    """
    known = lot.known
    if not len(known):
        return
    numbers = np.where(lot.words >= 0, lot.words, len(latent)).reshape(-1, BLOCK_WORDS)
    latent = np.vstack([latent, np.zeros_like(latent[:1])])
    rows = latent[numbers[:, 0]]
    for j in range(1, BLOCK_WORDS):
        rows += latent[numbers[:, j]]
    there = np.zeros((len(rows), len(latent)), bool)
    there[known // BLOCK_WORDS, lot.words[known]] = True
    there = np.packbits(there, axis=1, bitorder="little")
    left, span = np.repeat(lot.starts[1:], np.diff(lot.starts)) - np.arange(lot.starts[-1]), 1
    begin = np.repeat(lot.starts[:-1], np.diff(lot.starts))
    missing = np.floor(lengths - least + 1e-9)
    for wanted, which, mine in sought:
        while span < wanted:
            rows, there = _longer(rows, left, span, np.add), _longer(there, left, span, np.bitwise_or)
            span *= 2
        block = np.arange(len(rows))
        around = there | there[np.maximum(block - span, begin)] | there[np.minimum(block + span, block + left - 1)]
        width, around = around.shape[1], around.ravel()
        half = filled[wanted].shape[1] // 2

        def held(block: np.ndarray, own: np.ndarray, width=width, around=around) -> np.ndarray:
            return (around.take((block * width)[:, None] + (own >> 3)) >> (own & 7).astype(np.uint8) & 1).sum(axis=1)

        size = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        some = np.flatnonzero(size > 0)
        for low in range(0, len(some), 2_048):
            at = some[low : low + 2_048]
            i, k = np.nonzero((rows[at] @ mine) >= cosine * size[at, None])
            for low_i in range(0, len(i), 8_192):
                block, j = at[i[low_i : low_i + 8_192]], k[low_i : low_i + 8_192]
                item = which[j]
                # not more than ``missing`` of the first half, or of all terms of an item that is no longer, may be missing
                enough = held(block, filled[wanted][item, :half]) >= np.minimum(lengths[item], half) - missing[item]
                block, item, j = block[enough], item[enough], j[enough]
                enough = held(block, filled[wanted][item]) >= least[item]
                block, item, j = block[enough], item[enough], j[enough]
                yield item, block, block + span, np.einsum("ij,ij->i", rows[block], mine.T[j]) / size[block]


def _search(batches, items: Items, weights: np.ndarray, vectors: np.ndarray, cosine: float, subsequence: float, answer: float):
    latent = (vectors * weights[:, None]).astype(np.float32)
    targets = np.stack([latent[t].sum(axis=0) for t in items.terms])
    norms = np.linalg.norm(targets, axis=1)
    targets = (targets / np.where(norms > 0, norms, 1)[:, None]).T.astype(np.float32)
    lengths, span_of = np.array([len(t) for t in items.terms]), spans_of(items)
    sought = [(int(span), np.flatnonzero(span_of == span), np.ascontiguousarray(targets[:, span_of == span])) for span in np.unique(span_of)]
    pairs = Pairs(items, span_of)
    filled = {}
    for span, which, _ in sought:
        filled[span] = np.full((len(items.ids), lengths[which].max()), len(weights))
        for k in which:
            filled[span][k, : lengths[k]] = sorted(items.terms[k], key=lambda t: -weights[t])
    least = subsequence * lengths
    cosine_of = lambda passage, k: float(latent[passage].sum(axis=0) @ targets[:, k] / max(np.linalg.norm(latent[passage].sum(axis=0)), 1e-12)) if len(passage) else 0.0
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for lot in _lots(batch.column("terms"), _width(len(weights))):
            words, bounds = lot.words.tolist(), (lot.starts * BLOCK_WORDS).tolist()

            def confirm(k: int, doc: int, first: int, last: int, near: float | None) -> None:
                item = items.terms[k]
                passage = words[max(first, bounds[doc]) : min(last, bounds[doc + 1])]
                there = set(passage)
                if sum(map(there.__contains__, item)) < subsequence * len(item):
                    return  # the subsequence can't be longer
                share = common_subsequence(item, passage) / len(item)
                if share >= subsequence:
                    wanted = items.answers[k]
                    told = sum(t in there for t in wanted) / len(wanted) if wanted else 1.0
                    if told >= answer:
                        near = cosine_of([t for t in passage if t >= 0], k) if near is None else near
                        key = (lot.rows[doc], k)
                        best[key] = max(best.get(key, (0.0, 0.0, -1.0)), (share, told, near))

            for k, first, last, near in _near(lot, latent, sought, cosine, filled, least, lengths):
                doc = np.searchsorted(lot.starts, first, side="right") - 1
                first, last, n = first * BLOCK_WORDS, last * BLOCK_WORDS, lengths[k]
                for x in zip(k.tolist(), doc.tolist(), (first - n).tolist(), (last + n).tolist(), near.tolist(), strict=True):
                    confirm(*x)
            k, first = pairs.shared(lot.words)
            last = first + 2 * pairs.steps[k]
            for k, first, last in zip(k.tolist(), first.tolist(), last.tolist(), strict=True):
                # a passage may reach over several documents
                for doc in range(max(bisect_right(bounds, first) - 1, 0), bisect_left(bounds, last)):
                    if doc < len(lot.rows):
                        confirm(k, doc, first, last, None)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in best], pa.int64()), pa.array([items.ids[k] for _, k in best], pa.int64()), *(pa.array([x[j] for x in best.values()], pa.float64()) for j in (2, 0, 1))], names=["doc_id", "item_id", "cosine", "subsequence", "answer"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, rank: int | None = None, cosine: float = COSINE, subsequence: float = SUBSEQUENCE, answer: float = ANSWER, seed: int = 5) -> DataFrame:
    """doc_id, item_id, cosine, subsequence, answer: the confirmed pairs, the best passage of each.

    Items come to the driver ``ITEMS_AT_ONCE`` at a time. Term counts and the SVD
    cover every passage of every document, and each is searched. No term is left
    out, however common: its weight is low, and an exact join on the items' word
    pairs adds the passages that hold enough of them (all, of an item with few
    pairs), to be confirmed as the others. Items and documents without text have
    no pairs. Repeated rows give repeated pairs; null document ids stay null;
    null item ids are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    text = benchmark[item_text_col]
    answers = benchmark[answer_col] if answer_col else F.lit(None).cast("string")
    benchmark = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), text.alias("text"), answers.alias("answer")).filter("item_id is not null and length(text) > 0")
    searches = -(-benchmark.count() // ITEMS_AT_ONCE)
    found = None
    for turn in range(searches):
        mine = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(searches)) == turn)
        items = read_items(sorted(map(tuple, mine.collect()), key=lambda x: x[:2]))
        if not items.ids:
            continue
        with Scratch(spark) as scratch:
            coded = scratch.save(docs.mapInArrow(partial(_number, numbers=items.numbers), "doc_id long, terms binary"), "coded")
            only = coded.select("terms")
            n = len(items.numbers)
            registers = np.zeros((n + 1, REGISTERS), np.uint8)
            for at, part in only.mapInArrow(partial(_surroundings, n_terms=n), "at long, part binary").groupBy("at").applyInArrow(_most, "at long, part binary").collect():
                rows = np.frombuffer(part, np.uint8).reshape(-1, REGISTERS)
                registers[at : at + len(rows)] = rows
            counts = distinct(registers)
            weights = term_weights(counts[:n], counts[n])
            dimensions = rank or rank_of(len(items.ids))
            omega = np.random.default_rng(seed).standard_normal((n, min(n, dimensions + OVERSAMPLE)))
            sketch = np.zeros(omega.shape)
            for at, part in only.mapInArrow(partial(_sketch, weights=weights, omega=omega, span=int(np.median(spans_of(items)))), "at long, part binary").groupBy("at").applyInArrow(_add_sketch, "at long, part binary").collect():
                rows = np.frombuffer(part, np.float64).reshape(-1, omega.shape[1])
                sketch[at : at + len(rows)] = rows
            # The items are passages of the corpus too.
            for terms in items.terms:
                which, times = np.unique(terms, return_counts=True)
                own = weights[which] * times
                own /= np.linalg.norm(own)
                sketch[which] += np.outer(own, own @ omega[which])
            vectors = right_vectors(sketch, omega, dimensions)
            pairs = coded.mapInArrow(partial(_search, items=items, weights=weights, vectors=vectors, cosine=cosine, subsequence=subsequence, answer=answer), "doc_id long, item_id long, cosine double, subsequence double, answer double")
            pairs = cut(pairs)
        found = pairs if found is None else found.unionByName(pairs)
    return found if found is not None else spark.createDataFrame([], "doc_id long, item_id long, cosine double, subsequence double, answer double")


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@apart
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a confirmed benchmark passage stay, with all columns.

    Rows are judged by id and text, so null and shared ids are safe; null and
    empty texts stay, repeated rows share a verdict, empty tables stay empty.
    """
    rows = with_row_key(docs)
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=ROW_KEY).select(F.col("doc_id").alias(ROW_KEY)).distinct()
    return rows.join(found, ROW_KEY, "left_anti").select(docs.columns)


QUERIES = {"op7_latent_decontamination": op7_latent_decontamination}
ORACLE: dict[str, str] = {}
