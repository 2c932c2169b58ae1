"""A training-corpus pipeline: toxicity, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import Scratch, cut, table
from spanloom.llm.decontamination import drop_contaminated
from spanloom.llm.minhash import keep_one
from spanloom.llm.packing import pack_stage
from spanloom.llm.pii import redact_stage
from spanloom.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_stage),
    ("packing", pack_stage),
]

#: The stages learn, sign and retrieve; SQL has no form for them. The tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written to the shared folder and read again; a result is a checkpoint, the folder goes.

    Nulls, empty texts, repeated rows and shared ids are handled by each stage
    as its docstring says; an empty table gives no pieces.
    """
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for i, (name, stage) in enumerate(STAGES):
            docs = scratch.save(stage(spark, docs, sf_dir), f"{i}-{name}")
            if i > 1:
                scratch.drop(f"{i - 2}-{STAGES[i - 2][0]}")
        return cut(docs)
