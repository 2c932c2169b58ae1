"""Alignment of two tokenizers' tokens over the same bytes, by galloping intersection.

Where tokens of both end, the text is cut into groups: each end of the shorter
list gallops into the longer one. Inside a group the differences of ranks give
the tokens that overlap. Neither tokenizer joins text across a single space, so
the words of a text are aligned once for each block of documents; texts with
other white space around a space are aligned whole. A block sends its distinct
id pairs with their counts and gets the counts of the whole corpus back.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cache_of, cut, table
from .packing import _RARE, PRETOKENS, _byte_letters

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block, and words that a worker keeps aligned.
BLOCK_BYTES, KEPT_WORDS = 2 << 20, 150_000
#: An id pair is one number: the first id times this plus the second.
_SECOND_IDS = 1 << 31
_MARK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_ADJOINING = re.compile(r" \s|\s ")


def gallop(values: np.ndarray, ends: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each value its rank among the ascending ``ends``, searched from position ``low`` on: steps that double, then halves.

    No value is above the last end.
    """
    high, step = low.copy(), 1
    while (behind := ends[high] < values).any():
        low = np.where(behind, high + 1, low)
        high = np.where(behind, np.minimum(high + step, len(ends) - 1), high)
        step *= 2
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        less = ends[middle] < values
        low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
    return low


class Aligned(NamedTuple):
    """Pieces of text under both tokenizers: numbers and links of each, all links' id pairs in turn, groups as text (None: bytes differ)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    groups: list[bytes | None]


def joined(parts: list[Aligned]) -> Aligned:
    return Aligned(*(np.concatenate(x) for x in zip(*(p[:5] for p in parts), strict=True)), [g for p in parts for g in p.groups])


_NONE = Aligned(*(np.zeros(1, np.int64) for _ in range(4)), np.empty(0, np.int64), [None])


def matched(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the tokens that end a group, and of both tokens of each link; the shorter list of ends gallops through the longer.

    The search for a token's end starts where its piece of text does, which ``stops`` ends.
    """
    swapped = len(a_ends) > len(b_ends)
    short, long = (b_ends, a_ends) if swapped else (a_ends, b_ends)
    firsts = np.searchsorted(long, np.concatenate([[0], stops[:-1]]), "right")
    rank = gallop(short, long, firsts[np.searchsorted(stops, short)])
    both = long[rank] == short
    since = np.concatenate([[0], (rank + both)[:-1]])
    times = rank - since + 1
    own = np.repeat(np.arange(len(short)), times)
    other = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(since, times)
    cuts = np.flatnonzero(both), rank[both]
    return (cuts[1], cuts[0], other, own) if swapped else (*cuts, own, other)


class Aligner:
    """Both tokenizers with the bytes of their tokens, and the words aligned so far."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(public_tokenizers.path(first))
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second))
        byte_of = {letter: bytes([i]) for i, letter in enumerate(_byte_letters())}
        vocabulary = {i: token for token, i in self.first.get_vocab().items()}
        self.first_bytes = [b"".join(byte_of.get(c, c.encode()) for c in vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)]
        self.second_bytes = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            byte = _BYTE.fullmatch(piece) if self.second.is_byte(i) else None
            self.second_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace(_MARK, " ").encode())
        self.first_length, self.second_length = (np.array([len(x) for x in table], np.int64) for table in (self.first_bytes, self.second_bytes))
        n, m = len(self.first_bytes), len(self.second_bytes)
        self.written = [f"{i}{sep}" for last, count in ((",|", n), (",;", m)) for i in range(count) for sep in last]
        self.written_length = np.array([len(x) for x in self.written], np.int64)
        self.ranked = self._ranked(vocabulary)
        self.clear()

    def _ranked(self, vocabulary: dict[int, str]):
        """A faster encoder by ranks for texts without rare characters, or None where it might give other ids.

        Merges are applied in the order of the ids they make. If every token
        comes out of its own bytes, two neighbours that make up its bytes when
        its turn comes are the two of its merge, so ranks decide as merges do.
        """
        import tiktoken

        model = json.loads(self.first.to_str())
        before, merges = model["pre_tokenizer"] or {}, [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["model"].get("merges", [])]
        if model["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model["model"]["type"] != "BPE":
            return None
        ids = {token: i for i, token in vocabulary.items()}
        if len(set(merges)) + 256 > len(vocabulary) or any(ids.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)):
            return None
        if any([t.id for t in self.first.model.tokenize(vocabulary[i])] != [i] for i in range(256 + len(merges))):
            return None
        return tiktoken.Encoding("ranks", pat_str=PRETOKENS.pattern, mergeable_ranks={self.first_bytes[i]: i for i in range(256 + len(merges))}, special_tokens={})

    def first_ids(self, text: str) -> list[int]:
        return self.first.encode(text, add_special_tokens=False).ids if self.ranked is None or _RARE.search(text) else self.ranked.encode_ordinary(text)

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.table = joined([_NONE])
        self.starts = np.zeros(2, np.int64)

    def align(self, texts: list[str]) -> Aligned:
        """Each text after a space; several must be parts that a single space may join."""
        text = " ".join(texts)
        whole = (" " + text).encode()
        ids = self.first_ids(" " + text), self.second.encode(text)
        alike = b"".join(map(self.first_bytes.__getitem__, ids[0])) == whole == b"".join(map(self.second_bytes.__getitem__, ids[1]))
        if not alike:
            if len(texts) == 1:
                return _NONE
            half = len(texts) // 2
            return joined([self.align(texts[:half]), self.align(texts[half:])])
        a, b = (np.array(x, np.int64) for x in ids)
        a_ends, b_ends = np.cumsum(self.first_length[a]), np.cumsum(self.second_length[b])
        stops = np.cumsum([1 + len(t.encode()) for t in texts])
        a_cuts, b_cuts, own, other = matched(a, b, a_ends, b_ends, stops)
        groups = np.arange(len(a_cuts))
        a_group, b_group = (np.repeat(groups, np.diff(cuts, prepend=-1)) for cuts in (a_cuts, b_cuts))
        place_a = np.arange(len(a)) + np.concatenate([[0], b_cuts + 1])[a_group]
        place_b = np.arange(len(b)) + a_cuts[b_group] + 1
        written = np.empty(len(a) + len(b), np.int64)
        written[place_a] = 2 * a
        written[place_b] = 2 * (b + len(self.first_bytes))
        written[place_a[a_cuts]] += 1
        written[place_b[b_cuts]] += 1
        a_of, b_of = np.searchsorted(stops, a_ends), np.searchsorted(stops, b_ends)
        n = len(texts)
        n_a, n_b = np.bincount(a_of, minlength=n), np.bincount(b_of, minlength=n)
        line = "".join(map(self.written.__getitem__, written.tolist())).encode()
        edges = np.concatenate([[0], np.cumsum(self.written_length[written])[np.cumsum(n_a + n_b) - 1]]).tolist()
        pieces = [line[i : j - 1] for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return Aligned(n_a, n_b, np.bincount(a_of[a_cuts], minlength=n), np.bincount(a_of[own], minlength=n), a[own] * _SECOND_IDS + b[other], pieces)

    def learn(self, words: set[str]) -> None:
        """Aligns the words that are not known yet."""
        new = sorted(words.difference(self.words), key=lambda w: _RARE.search(w) is not None)
        if new:
            base = len(self.table.groups)
            self.table = joined([self.table, *(self.align(new[i : i + 4096]) for i in range(0, len(new), 4096))])
            self.words.update(zip(new, range(base, base + len(new)), strict=True))
            self.starts = np.concatenate([[0], np.cumsum(self.table.n_links)])


def regular(text: str) -> bool:
    """Whether every space of the text stands between two other characters that are no white space."""
    if text.endswith(" ") or text[:1].isspace():
        return False
    return not (("  " in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text)) and _ADJOINING.search(text))


def _aligner(first: str, second: str) -> Aligner:
    held = cache_of("alignment")
    if (first, second) not in held:
        held[first, second] = Aligner(first, second)
    return held[first, second]


_LONGS = pa.list_(pa.int64())
#: Blocks in a row group of Parquet, of which a task holds one.
GROUP_BLOCKS = 8
#: Results of a block's documents; then, packed: distinct entries of each document and their times, pairs of each entry.
_RESULTS, _PACKED = ("n_a", "n_b", "n_groups", "n_links"), ("entries_of", "entry", "times", "pairs_of", "pair")
_BLOCK = pa.schema([("block", pa.int64()), ("doc_id", _LONGS), *((c, _LONGS) for c in _RESULTS), ("groups_sha256", pa.list_(pa.string())), *((c, pa.binary()) for c in _PACKED), ("pairs", _LONGS), ("counts", _LONGS)])
_BLOCK_DDL = ", ".join(["block long", "doc_id array<long>", *(f"{c} array<long>" for c in _RESULTS), "groups_sha256 array<string>", *(f"{c} binary" for c in _PACKED), "pairs array<long>", "counts array<long>"])


def _packed(x: np.ndarray) -> bytes:
    """Numbers below 2^31: how many, then their 32-bit differences, byte by byte and compressed; ascending runs take one or two bytes a number."""
    planes = np.diff(x, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(x).to_bytes(4, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpacked(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:4], "little")
    planes = np.frombuffer(pa.decompress(x[4:], 4 * n, "zstd", asbytes=True) if n else b"", np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int64)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all ranges in turn."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _block(number: int, ids: list, texts: list[str], aligner: Aligner) -> pa.RecordBatch:
    """A block's documents, the distinct entries (words or whole texts) of each, the pairs of each entry, and the pairs' counts."""
    if len(aligner.words) > KEPT_WORDS:
        aligner.clear()
    parts = [t.split(" ") if t and regular(t) else None for t in texts]
    aligner.learn(set().union(*(p for p in parts if p)))
    words, groups = aligner.words, aligner.table.groups
    shas, docs, used, others = [], [], [], []
    for d, (text, part) in enumerate(zip(texts, parts, strict=True)):
        at = np.fromiter(map(words.__getitem__, part), np.int64, len(part)) if part else None
        lines = [groups[k] for k in at.tolist()] if at is not None else [None]
        if text and None in lines:
            other = aligner.align([text])
            lines, at = other.groups, np.array([len(groups) + len(others)])
            others.append(other)
        if not text or None in lines:
            shas.append("")
            continue
        shas.append(hashlib.sha256(b";".join(lines)).hexdigest())
        used.append(at)
        docs.append(np.full(len(at), d, np.int64))
    table, starts = aligner.table, aligner.starts
    if others:
        table = joined([table, *others])
        starts = np.concatenate([[0], np.cumsum(table.n_links)])
    m = len(table.groups)
    seen, times = np.unique(np.concatenate([*docs, np.empty(0, np.int64)]) * m + np.concatenate([*used, np.empty(0, np.int64)]), return_counts=True)
    doc = seen // m
    entries, entry = np.unique(seen % m, return_inverse=True)
    sizes = table.n_links[entries]
    pairs, of_pair = np.unique(table.pairs[_spread(starts[entries], sizes)], return_inverse=True)
    of_entry = np.repeat(np.arange(len(entries)), sizes)
    total = np.zeros(len(entries), np.int64)
    np.add.at(total, entry, times)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, of_pair, total[of_entry])
    sums = []
    for values in table[:4]:
        out = np.zeros(len(ids), np.int64)
        np.add.at(out, doc, times * values[entries][entry])
        sums.append(out)
    packed = map(_packed, (np.bincount(doc, minlength=len(ids)), entry, times, sizes, of_pair))
    columns = [[number], [ids], *([x] for x in sums), [shas], *([x] for x in packed), [pairs], [counts]]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _BLOCK, strict=True)], schema=_BLOCK)


def _blocks(batches, first, second):
    aligner, base, number, ids, texts, held = _aligner(first, second), TaskContext.get().partitionId() << 32, 0, [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc)
            texts.append(text or "")
            held += len(texts[-1])
            if held >= BLOCK_BYTES or len(ids) >= 50_000:
                yield _block(base + number, ids, texts, aligner)
                number, ids, texts, held = number + 1, [], [], 0
    if ids:
        yield _block(base + number, ids, texts, aligner)
    aligner.clear()  # the worker outlives the task
    pa.default_memory_pool().release_unused()


_FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _weighed(blocks: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of a block, with the corpus-wide counts of its pairs."""
    cache_of("alignment-weights")  # the tokenizers and words of the stage before go
    of = lambda name: blocks[name].combine_chunks()[0]
    entries_of, entry, times, pairs_of, pair = (_unpacked(of(c).as_py()) for c in _PACKED)
    ids = of("doc_id").values
    doc = np.repeat(np.arange(len(ids)), entries_of)
    of_entry = np.repeat(np.arange(len(pairs_of)), pairs_of)
    at = pairs["place"].to_numpy()
    out = [ids, *(of(c).values for c in _RESULTS)]
    for name in ("best", "total"):
        value = np.zeros(len(at), np.int64)
        value[at] = pairs[name].to_numpy()
        by_entry, by_doc = np.zeros(len(pairs_of), np.int64), np.zeros(len(ids), np.int64)
        np.add.at(by_entry, of_entry, value[pair])
        np.add.at(by_doc, doc, times * by_entry[entry])
        out.append(pa.array(by_doc))
    return pa.table([*out, of("groups_sha256").values], names=[x.split()[0] for x in _FOUND.split(", ")])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str = FIRST, second: str = SECOND) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs``.

    Texts that are null, empty or not given back by both tokenizers' bytes have
    zeros and an empty digest. Repeated rows count each; ids may be null; an
    empty table gives no rows; other columns are ignored. A very long text is a
    block of its own.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        blocks = scratch.save(rows.mapInArrow(lambda batches: _blocks(batches, first, second), _BLOCK_DDL), "blocks", **{"parquet.block.row.count.limit": GROUP_BLOCKS})
        pairs = scratch.save(blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("count")), "pairs")
        totals = scratch.save(pairs.groupBy("pair").agg(F.sum("count").alias("total")).withColumn("b", F.col("pair") % _SECOND_IDS), "totals")
        highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
        weights = scratch.save(totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best")), "weights")
        weighed = scratch.save(pairs.join(weights, "pair").select("block", "place", "total", "best"), "weighed")
        told = blocks.drop("pairs", "counts")
        return cut(told.groupBy("block").cogroup(weighed.groupBy("block")).applyInArrow(_weighed, _FOUND))


def op13_galloping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op13_galloping_alignment": op13_galloping_alignment}
ORACLE: dict[str, str] = {}
