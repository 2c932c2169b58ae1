"""Language identification by compression.

Each language has a zstandard raw-content dictionary; a text belongs to the
language whose dictionary compresses it to the fewest bytes.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, per_batch, table

#: Bytes of training text that make up a language's dictionary, and characters of one document in it: a window from anywhere in the text.
DICTIONARY_BYTES, WINDOW_CHARS = 64_000, 1_000
#: A text is compressed in blocks of so many bytes, so that the dictionary and not the text's own past decides.
BLOCK_BYTES = 8_192
#: A margin below this share of the smallest size is narrow: the prediction is marked as rejected.
NARROW = 0.01
LEVEL = 5
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case, other ASCII as spaces; the bytes of other characters stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """The text as bytes without case, digits, punctuation and layout of ASCII."""
    return b" ".join(text.encode().translate(_PLAIN).split())


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES, window: int = WINDOW_CHARS) -> dict[str, bytes]:
    """A raw-content dictionary for each language of ``docs``.

    A bounded sample: for each language distinct texts in hash order, of each a
    window of at most ``window`` characters at a place that the hash chooses, up
    to ``dictionary_bytes``. A first pass sizes each language's distinct texts,
    which sets the hash range that the second reads. Null languages and null or
    empty texts teach nothing, null ids do; repeated texts count once; an empty
    table gives no dictionary.
    """
    rows = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang")).filter("lang is not null and length(text) > 0")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    first = F.pmod(F.xxhash64("hash"), F.greatest(F.lit(1), F.length("text") - window + 1).cast("long")).cast("int") + 1
    rows = rows.select("lang", F.substring("text", first, F.lit(window)).alias("text"), "hash", F.pmod("hash", F.lit(1 << 30)).alias("at"))
    sizes = dict(rows.groupBy("lang", "hash").agg(F.max(F.octet_length("text")).alias("n")).groupBy("lang").agg(F.sum("n")).collect())
    if not sizes:
        return {}
    shares = F.create_map(*(F.lit(x) for lang, size in sizes.items() for x in (lang, min(1.0, 3.0 * dictionary_bytes / size))))
    sample = rows.filter(F.col("at") < shares[F.col("lang")] * (1 << 30)).groupBy("lang", "at", "hash").agg(F.min("text").alias("text"))
    parts: dict[str, list[tuple[int, int, bytes]]] = defaultdict(list)
    for lang, at, key, text in sample.collect():
        parts[lang].append((at, key, plain(text)))
    return {lang: b" ".join(t for *_, t in sorted(found))[:dictionary_bytes] for lang, found in sorted(parts.items())}


def _classify(batch: pa.RecordBatch, dictionaries: dict[str, bytes], narrow: float, block: int) -> pa.RecordBatch:
    names = list(dictionaries)
    packers = [_packer(dictionaries[x]) for x in names]
    lang, score, rejected = [], [], []
    for text in batch.column(1).to_pylist():
        if not text or not packers or not _LETTER.search(text):
            lang.append("und")
            score.append(0.0)
            rejected.append(True)
            continue
        data = plain(text)
        sizes = np.array([sum(len(pack(data[at : at + block])) for at in range(0, len(data), block)) for pack in packers], float)
        best = int(sizes.argmin())
        others = np.delete(sizes, best)
        margin = float((others.min() - sizes[best]) / others.min()) if len(others) else 1.0
        lang.append(names[best])
        # Bytes saved against each other language, as odds over a text of this length.
        odds = np.exp2(np.clip((sizes[best] - sizes) / 2, -60, 0))
        score.append(float(1 / odds.sum()))
        rejected.append(margin < narrow)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])


_packers: dict[bytes, object] = {}


def _packer(content: bytes):
    if content not in _packers:
        if len(_packers) > 64:
            _packers.clear()
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        _packers[content] = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return _packers[content]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", narrow: float = NARROW, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row.

    ``und``, score 0 and rejected: null texts, texts without a letter, or no
    dictionary at all. Ties go to the first language by name. ``rejected`` marks
    margins below ``narrow``. Null ids and repeated rows are kept as they are; an
    empty table gives an empty result. Texts of any length are packed whole, block
    by block; other columns are ignored.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(per_batch(_classify, dictionaries, narrow, block), "doc_id long, lang_pred string, score double, rejected boolean")


def op9_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = learn(docs.filter(~held_out(docs["doc_id"], 4, 2)))
    found = identify(docs, dictionaries)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op9_compression_language_id": op9_compression_language_id}
ORACLE: dict[str, str] = {}
