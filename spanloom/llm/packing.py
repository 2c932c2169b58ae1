"""Best-fit packing by hierarchical residual rounds.

Each partition packs its own pieces best fit (longest first) and emits nearly
full bins; underfull bins become items of the next round, merged in fewer and
fewer groups of bounded size until one group is left or a round merges nothing.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, cache_of, cut, table

CAPACITY = 2048
#: A bin with at most this much room is emitted at once.
NEARLY_FULL = 4
#: Items of a best-fit problem in one task.
GROUP_ITEMS = 100_000
TOKENIZER = "byte_bpe_50k.json"

#: The vocabulary's own pre-token pattern, whose boundaries never lie inside a run it matches.
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ADJOINING = re.compile(r" \s|\s ")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_RARE = re.compile(r"[\x1c-\x1f\x85ɐ-\U0010ffff]|<\|")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_LETTERS = dict(enumerate(_byte_letters()))


class _Ids(dict):
    """Piece of text -> its ids as little-endian uint32 bytes; emptied when it has grown to ``most``."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[piece] = self.encode(piece)
        return ids


class Encoder:
    """Whole texts to ids, through caches of space-delimited chunks and pre-tokens.

    A single space between two non-space characters starts a pre-token, so the
    ids of a text are those of its chunks in turn. Texts in which a space
    adjoins other white space are cut at pre-tokens; chunks with rare characters
    or special-token marks are encoded whole. A vocabulary file with other steps
    before its model than PRETOKENS stands for encodes all texts whole.
    """

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        steps = json.loads(self.tokenizer.to_str())
        before = steps["pre_tokenizer"] or {}
        if steps["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or steps["model"]["type"] != "BPE":
            self.encode = self.whole  # type: ignore[method-assign]
        self.pretokens = _Ids(self.pretoken, 50_000)
        self.first = _Ids(self.chunk, 20_000)
        self.later = _Ids(self.later_chunk, 900_000)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pretoken(self, piece: str) -> bytes:
        found = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))]
        return struct.pack(f"<{len(found)}I", *found)

    def chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if _RARE.search(chunk):
            return self.whole(chunk)
        return b"".join(map(self.pretokens.__getitem__, PRETOKENS.findall(chunk)))

    def later_chunk(self, chunk: str) -> bytes:
        """A chunk after its space; letters alone are one pre-token, a mark after letters another."""
        if chunk.isalpha() and not _RARE.search(chunk):
            return self.pretoken(" " + chunk)
        if chunk[-1:] in {".", ","} and chunk[:-1].isalpha():
            return self.later[chunk[:-1]] + self.pretokens[chunk[-1]]
        return self.chunk(" " + chunk)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if ("  " in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text)) and _ADJOINING.search(text):
            return self.whole(text) if _RARE.search(text) else self.chunk(text)
        head, *rest = text.split(" ")
        return b"".join([self.first[head], *map(self.later.__getitem__, rest)])


def encoder(name: str) -> Encoder:
    encoders = cache_of("packing")
    if name not in encoders:
        encoders[name] = Encoder(name)
    return encoders[name]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin: best fit, longest first, ties in row order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, fills = 0, []  # free: bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fitting := free >> n:
            room = n + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                free ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, capacity - room
        fills[b] += n
        if left := room - n:
            rooms[left].append(b)
            free |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
_PLACED = pa.schema([*_PIECE, ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])
_PLACED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def _pieces(batch: pa.RecordBatch, encode, capacity: int) -> pa.Table:
    ids, piece, start, length, crc = [], [], [], [], []
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        codes = encode(text or "") + b"\0\0\0\0"
        n = len(codes) // 4
        head = n if n <= capacity else n % capacity or capacity
        at, k = 0, 0
        while at < n:
            size = head if not k else capacity
            ids.append(doc)
            piece.append(k)
            start.append(at)
            length.append(size)
            crc.append(zlib.crc32(codes[4 * at : 4 * (at + size)]))
            at, k = at + size, k + 1
    return pa.table([pa.array(x, t) for x, (_, t) in zip((ids, piece, start, length, crc), _PIECE, strict=True)], schema=pa.schema(_PIECE))


def _place(pieces: pa.Table, capacity: int, first_bin: int) -> pa.Table:
    bins, offsets, fills = best_fit(pieces["length"].to_numpy(), capacity)
    return pa.table([*pieces.columns, pa.array(bins + first_bin), pa.array(offsets), pa.array(fills[bins])], schema=_PLACED)


def _first_round(batches, tokenizer: str, capacity: int, most: int):
    encode = encoder(tokenizer).encode
    held, count, turn, base = [], 0, 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        held.append(_pieces(batch, encode, capacity))
        count += held[-1].num_rows
        if count >= most:
            yield from _place(pa.concat_tables(held), capacity, base + turn).to_batches()
            turn, held, count = turn + count, [], 0
    if count:
        yield from _place(pa.concat_tables(held), capacity, base + turn).to_batches()


def _merge_round(rows: pa.Table, capacity: int, turn: int) -> pa.Table:
    """Packs the group's bins as items; the pieces keep their order inside a bin."""
    of, first, inverse = np.unique(rows["bin"].to_numpy(), return_index=True, return_inverse=True)
    bins, shift, fills = best_fit(rows["fill"].to_numpy()[first], capacity)
    base = (turn << 56) + (int(rows["group"][0].as_py()) << 28)
    columns = [rows[name] for name, _ in _PIECE]
    offset = rows["offset"].to_numpy() + shift[inverse]
    return pa.table([*columns, pa.array(bins[inverse] + base), pa.array(offset), pa.array(fills[bins][inverse])], schema=_PLACED)


def _merging(capacity: int, turn: int):
    return lambda rows: _merge_round(rows, capacity, turn)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, nearly_full: int = NEARLY_FULL, group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text has the end id alone. Repeated rows are packed each.
    Ids may be null; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    emitted = f"fill >= {capacity - nearly_full}"
    with Scratch(spark) as scratch:
        rows = scratch.save(docs.mapInArrow(lambda batches: _first_round(batches, tokenizer, capacity, group_items), _PLACED_DDL), "round-0")
        done, turn = rows.filter(emitted), 0
        waiting = rows.filter(f"not {emitted}")
        items, bins = waiting.agg(F.count("*"), F.countDistinct("bin")).first()
        while items:
            turn += 1
            groups = -(-items // group_items)
            merged = waiting.withColumn("group", F.pmod(F.xxhash64("bin"), F.lit(groups))).groupBy("group").applyInArrow(_merging(capacity, turn), _PLACED_DDL)
            rows = scratch.save(merged, f"round-{turn}")
            left = rows.agg(F.countDistinct("bin")).first()[0]
            if groups == 1 or left == bins:
                done = done.unionByName(rows)
                break
            done = done.unionByName(rows.filter(emitted))
            waiting = rows.filter(f"not {emitted}")
            items, bins = waiting.agg(F.count("*"), F.countDistinct("bin")).first()
        return cut(done.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"))


def op6_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents that are left, as packed pieces; null and empty texts as their end id alone, repeated rows each."""
    bounded(spark)
    return pack(docs)


QUERIES = {"op6_residual_packing": op6_residual_packing}
ORACLE: dict[str, str] = {}
