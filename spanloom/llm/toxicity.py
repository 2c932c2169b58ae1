"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are lexicon densities, closeness of lexicon words to the second
person, capitals, punctuation and obfuscation rates. The lexicons are learned
from the training labels; trees and calibration are Spark ML models.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import Scratch, apart, cache_of, held_out, per_batch, table
from .minhash import _WordHashes, shingle_hashes

#: Labelled rows to fit on, at most: the first in hash order.
TRAINING_ROWS = 20_000
#: How many toxic texts a unit of the lexicon needs at least.
LEXICON_TEXTS = 5
#: Least log-odds of a unit in toxic against other texts.
LEXICON_ODDS = 2.5
PREFIXES = (4, 6)
#: Words between a lexicon word and a second-person word that still count as close; words of the densest window.
NEAR_WORDS, WINDOW_WORDS = 5, 64
CALIBRATION_SHARE = 0.3

#: Second-person words in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os su".split())
#: Characters that stand for letters in obfuscated words.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})

NAMES = ["hits", "hit_rate", "distinct_hits", "prefix4_rate", "prefix6_rate", "densest", "near_second_person", "second_person_rate", "capitals", "capital_words", "exclamations", "questions", "punctuation", "obfuscation", "obfuscated_hits", "elongation", "words"]
_EDGES = ".,;:!?\"'()[]{}<>«»„“”…"
_MIXED = re.compile(r"[^\W\d_][\d@$!*._-]+[^\W\d_]")
_LONG = re.compile(r"(.)\1\1")
_WORD, _PREFIX4, _PREFIX6, _SECOND, _CAPITALS, _OBFUSCATED, _UNVEILED, _ELONGATED = (1 << i for i in range(8))
#: Marks a token too long for the packed counts, which are then taken from the token itself.
_GREAT, GREAT = 1 << 40, 31
#: Where the packed counts start, five bits each.
_AT = (8, 13, 18, 23, 28)


def units(token: str) -> tuple[str, str, str]:
    """The lexicon units of a lower-case word: itself, and its prefixes where it is longer than they are."""
    return (token, *(f"{k}:{token[:k]}" if len(token) > k else "" for k in PREFIXES))


def counts_of(token: str) -> tuple[int, int, int, int, int]:
    """Exclamation and question marks, all marks, capitals and letters of a token."""
    letters, upper = sum(map(str.isalpha, token)), sum(map(str.isupper, token))
    return token.count("!"), token.count("?"), len(token) - letters - sum(map(str.isdigit, token)), upper, letters


class _Codes(dict):
    """Token as written -> its flags and counts, packed in an integer."""

    most = 300_000

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        word = token.lower().strip(_EDGES)
        code = sum(flag for flag, unit in zip((_WORD, _PREFIX4, _PREFIX6), units(word), strict=True) if unit and unit in self.lexicon)
        code |= _SECOND * (word in SECOND_PERSON) | _CAPITALS * (len(word) > 1 and token.isupper()) | _ELONGATED * bool(_LONG.search(word))
        if _MIXED.search(word):
            code |= _OBFUSCATED | _UNVEILED * (word.translate(STANDS_FOR) in self.lexicon)
        if len(token) > GREAT:
            code |= _GREAT
        else:
            for at, n in zip(_AT, counts_of(token), strict=True):
                code |= n << at
        self[token] = code
        return code


def features(text: str, codes: _Codes) -> np.ndarray:
    """The dense features of a whole text; all 0 for an empty one."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return np.zeros(len(NAMES))
    code = np.fromiter(map(codes.__getitem__, tokens), np.int64, n)
    flag = lambda bit: (code & bit) != 0
    great = [counts_of(tokens[i]) for i in np.flatnonzero(flag(_GREAT)).tolist()]
    exclamations, questions, marks, upper, letters = (float(((code >> at) & 31).sum()) + sum(x[j] for x in great) for j, at in enumerate(_AT))
    hit = flag(_WORD | _UNVEILED)
    at, second = np.flatnonzero(hit), np.flatnonzero(flag(_SECOND))
    near, densest = 0.0, float(len(at))
    if len(at):
        if len(second):
            right = np.searchsorted(second, at)
            gap = np.minimum(np.abs(second[np.minimum(right, len(second) - 1)] - at), np.abs(second[np.maximum(right - 1, 0)] - at))
            near = float((gap <= NEAR_WORDS).mean())
        densest = float((np.searchsorted(at, at + WINDOW_WORDS) - np.arange(len(at))).max())
    return np.array([
        np.log1p(len(at)), len(at) / n, np.log1p(len({tokens[i].lower().strip(_EDGES) for i in at.tolist()})), flag(_PREFIX4).mean(), flag(_PREFIX6).mean(),
        np.log1p(densest), near, len(second) / n, upper / max(1.0, letters), flag(_CAPITALS).mean(), exclamations / n, questions / n, marks / n,
        flag(_OBFUSCATED).mean(), flag(_UNVEILED).mean(), flag(_ELONGATED).mean(), np.log1p(n),
    ])


@dataclass
class ToxicityModel:
    """lexicon: learned units. trees and calibration: Spark ML models, None if the labels had one class only. prior: the toxic share."""

    lexicon: frozenset[str]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float


def _count_units(batches):
    counts: dict[str, list[int]] = {}

    def out():
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([x[0] for x in counts.values()], pa.int64()), pa.array([x[1] for x in counts.values()], pa.int64())], names=["unit", "toxic", "other"])

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen = {unit for token in set((text or "").lower().split()) for unit in units(token.strip(_EDGES)) if unit}
            for unit in seen:
                counts.setdefault(unit, [0, 0])[not toxic] += 1
        if len(counts) > 300_000:
            yield from out()
            counts.clear()
    if counts:
        yield from out()


def _whole_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Adds a 128-bit digest of the whole shingle set of each text: rows of equal sets are copies."""
    hashes = _WordHashes()
    found = [xxhash.xxh3_128_digest(shingle_hashes((t or "").encode().lower().split(), hashes).tobytes()) for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "copy"])


def _featurise(batch: pa.RecordBatch, lexicon: frozenset[str]) -> pa.RecordBatch:
    codes = _codes(lexicon)
    rows = [features(t or "", codes) for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([*(batch.column(x) for x in batch.schema.names if x != "text"), pa.array([x.tolist() for x in rows], pa.list_(pa.float64()))], names=[*(x for x in batch.schema.names if x != "text"), "features"])


def _codes(lexicon: frozenset[str]) -> _Codes:
    """One cache of codes for each lexicon in a worker."""
    kept, key = cache_of("toxicity"), hash(lexicon)
    if key not in kept or kept[key][0] != lexicon:
        kept.clear()
        kept[key] = (lexicon, _Codes(lexicon))
    return kept[key][1]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", training_rows: int = TRAINING_ROWS, seed: int = 11) -> ToxicityModel:
    """Learns from at most ``training_rows`` labelled documents.

    The ids of the sample are bounded, so they are broadcast to the texts. Of
    copies (equal whole shingle sets and labels) one is kept. A share of the rows is kept
    from the trees and calibrates them. Null labels are left out; of repeated
    labels the largest counts. Whole texts are read, however long. Empty tables,
    or labels of one class, give a model that scores all with the share of toxic ones.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    labels = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    with Scratch(spark) as scratch:
        sample = scratch.save(sample, "labels")
        rows = docs.join(F.broadcast(sample), "doc_id")
        marked = rows.mapInArrow(per_batch(_whole_sets), "doc_id long, text string, toxic int, copy binary")
        rows = scratch.save(marked.groupBy("copy", "toxic").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("row")).select("row.*", "toxic"), "training")
        n, toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
        if not n or not toxic or toxic == n:
            return ToxicityModel(frozenset(), None, None, float(toxic or 0) / max(n, 1))
        counts = rows.select("toxic", "text").mapInArrow(_count_units, "unit string, toxic long, other long").groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
        odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("o") + 0.5) / (n - toxic + 1.0))
        chosen = counts.filter(F.col("t") >= LEXICON_TEXTS).withColumn("odds", odds).filter(F.col("odds") >= LEXICON_ODDS)
        lexicon = frozenset(x[0] for x in chosen.select("unit").collect())
        rows = scratch.save(rows.mapInArrow(per_batch(_featurise, lexicon), "doc_id long, toxic int, features array<double>"), "features")
        rows = rows.select("doc_id", F.col("toxic").cast("double").alias("label"), array_to_vector("features").alias("features"))
        split = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1000)) < int(1000 * CALIBRATION_SHARE)
        trees = GBTClassifier(maxIter=16, maxDepth=4, maxBins=32, stepSize=0.2, minInstancesPerNode=5, seed=seed).fit(rows.filter(~split).coalesce(4))
        held = trees.transform(rows.filter(split)).select("label", vector_to_array("probability")[1].alias("p"))
        if held.agg(F.countDistinct("label")).first()[0] < 2:
            held = trees.transform(rows).select("label", vector_to_array("probability")[1].alias("p"))
        calibration = IsotonicRegression(featuresCol="p").fit(held.coalesce(1))
        return ToxicityModel(lexicon, trees, calibration, toxic / n)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row: whole texts, null as empty; ids may be null or repeated.

    The score is the calibrated probability; a hundredth of the trees' own
    probability is mixed in to order equal steps. Without a fitted model it is
    the prior.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    if model.trees is None:
        return rows.select("doc_id", F.lit(model.prior).alias("score"), F.lit(int(model.prior >= 0.5)).alias("predicted"))
    dense = rows.mapInArrow(per_batch(_featurise, model.lexicon), "doc_id long, features array<double>").select("doc_id", array_to_vector("features").alias("features"))
    raw = model.trees.transform(dense).select("doc_id", vector_to_array("probability")[1].alias("p"))
    found = model.calibration.setPredictionCol("calibrated").transform(raw)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.99 * F.col("calibrated") + 0.01 * F.col("p")))
    return found.select("doc_id", value.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    labels = table(spark, sf_dir, "labels")
    return fit(docs, labels.filter(~held_out(labels["doc_id"], 5, 0)))


def op5_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, _model(spark, docs, sf_dir))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


@apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score is below 0.5 stay, with the columns of ``docs``.

    Null and empty texts are scored as empty, repeated rows each, null ids stay;
    an empty table stays empty. Without labels of both classes the share of
    toxic labels decides for all.
    """
    model = _model(spark, docs, sf_dir)
    if model.trees is None:
        return docs if model.prior < 0.5 else docs.limit(0)
    schema = StructType([*docs.schema, StructField("features", ArrayType(DoubleType()))])
    dense = docs.mapInArrow(per_batch(_with_features, model.lexicon), schema).withColumn("features", array_to_vector("features"))
    raw = model.trees.transform(dense).withColumn("p", vector_to_array("probability")[1])
    return model.calibration.setPredictionCol("calibrated").transform(raw).filter("0.99 * calibrated + 0.01 * p < 0.5").select(docs.columns)


def _with_features(batch: pa.RecordBatch, lexicon: frozenset[str]) -> pa.RecordBatch:
    codes = _codes(lexicon)
    rows = [features(t or "", codes).tolist() for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names, "features"])


QUERIES = {"op5_boosted_toxicity": op5_boosted_toxicity}
ORACLE: dict[str, str] = {}
