"""Bad records set apart: every line is read once, and good and bad ones are written apart with the reason and counted on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .annotations import standoff

_SPAN = r"^\d+ \d+(;\d+ \d+)*$"


def _first(*reasons: tuple[Column, Column | str]) -> Column:
    """The name of the first condition that holds; null where none does."""
    found = F.lit(None).cast("string")
    for holds, name in reversed(reasons):
        found = F.when(F.coalesce(holds, F.lit(False)), name if isinstance(name, Column) else F.lit(name)).otherwise(found)
    return found


def standoff_records(lines: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(doc_id, line_no, line, reason) of standoff lines (doc_id, line_no, line), blank ones left out.

    A reason is null for a good line. Bad are lines of no known kind, entities
    without three cells, with unreadable or empty offsets, of a type that is not
    in ``labels``, or with an id that an earlier line of the document has, and
    attributes without a target. Notes, relations and normalisations are good.
    """
    rows = lines.filter(F.trim("line") != "")
    cells = F.split("line", "\t", 3)
    kind, ent_id = F.substring("line", 1, 1), F.get(cells, F.lit(0))
    head = F.split(F.get(cells, F.lit(1)), " ", 2)
    offsets = F.get(head, F.lit(1))
    pairs = F.transform(F.split(offsets, ";"), lambda x: F.split(x, " "))
    is_entity = kind == "T"
    rows = rows.withColumn("_id", F.when(is_entity, ent_id))
    again = F.row_number().over(Window.partitionBy("doc_id", "_id").orderBy("line_no")) > 1
    reason = _first(
        (~kind.isin("T", "A", "M", "R", "E", "N", "#", "*"), "unknown kind of line"),
        (is_entity & (F.size(cells) < 3), "an entity needs three cells"),
        (is_entity & ~F.coalesce(offsets.rlike(_SPAN), F.lit(False)), "unreadable offsets"),
        (is_entity & F.exists(F.when(offsets.rlike(_SPAN), pairs), lambda x: x[0].try_cast("long") >= x[1].try_cast("long")), "an empty span"),
        (is_entity & (~F.get(head, F.lit(0)).isin(labels) if labels is not None else F.lit(False)), F.concat(F.lit("unknown type "), F.get(head, F.lit(0)))),
        (is_entity & again, F.concat(F.lit("second entity "), ent_id)),
        (kind.isin("A", "M") & (F.size(F.split(F.get(cells, F.lit(1)), " ")) < 2), "an attribute needs a target"),
    )
    return rows.withColumn("reason", reason).select("doc_id", "line_no", "line", "reason")


def column_records(lines: DataFrame, separator: str = r"\s+", boundary: str = "", width: int | None = None) -> DataFrame:
    """(doc_id, line_no, line, reason) of column lines: bad are those whose number of cells is not ``width``, or that of the document's first line."""
    stop = (F.trim("line") == "") | (F.trim("line") == boundary)
    rows = lines.filter(~stop).withColumn("_n", F.size(F.split(F.trim("line"), separator)))
    wanted = F.lit(width) if width is not None else F.first("_n").over(Window.partitionBy("doc_id").orderBy("line_no"))
    rows = rows.withColumn("_wanted", wanted)
    return rows.withColumn("reason", F.when(F.col("_n") != F.col("_wanted"), F.format_string("%d cells, not %d", "_n", "_wanted"))).select("doc_id", "line_no", "line", "reason")


def json_records(lines: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """(doc_id, line_no, line, reason, record) of JSON lines, PERMISSIVE with a corrupt-record column: bad are unreadable lines and records without a required field."""
    record = F.from_json("line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.filter(F.trim("line") != "").withColumn("record", record)
    missing = F.array_compact(F.array(*(F.when(F.col(f"record.{c}").isNull(), F.lit(c)) for c in required))) if required else F.array().cast("array<string>")
    reason = _first((F.col("record").isNull() | F.col("record._corrupt_record").isNotNull(), "unreadable"), (F.size(missing) > 0, F.concat(F.lit("no "), F.array_join(missing, ", "))))
    return rows.withColumn("reason", reason).select("doc_id", "line_no", "line", "reason", F.col("record").dropFields("_corrupt_record").alias("record"))


def answer_records(answers: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, reason) of raw answers (doc_id, raw): bad are those from which no entity can be read, whole or salvaged."""
    from spanloom.operators.prompts import parsed

    some = parsed(answers).select("doc_id").distinct().withColumn("_some", F.lit(True))
    rows = answers.join(some, "doc_id", "left")
    reason = _first((F.coalesce(F.trim("raw"), F.lit("")) == "", "no answer"), (F.col("_some").isNull(), "no entity can be read"))
    return rows.select("doc_id", F.lit(0).alias("line_no"), F.col("raw").alias("line"), reason.alias("reason"))


def set_apart(records: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(good, bad, counts): the records written once under ``path``, good and bad in folders of their own.

    Counts are observed while writing: rows, good and bad; no second pass counts them.
    """
    seen = Observation()
    bad = F.col("reason").isNotNull()
    watched = records.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"))
    watched.withColumn("state", F.when(bad, "bad").otherwise("good")).write.mode("overwrite").partitionBy("state").parquet(path)
    back = records.sparkSession.read.schema(records.withColumn("state", F.lit("")).schema).parquet(path)
    return back.filter("state = 'good'").drop("state", "reason"), back.filter("state = 'bad'").drop("state"), dict(seen.get)


def good_entities(good: DataFrame) -> DataFrame:
    """The entities of good standoff lines."""
    return standoff(good.select("doc_id", "line"))


def stripped(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, lines) of column lines (doc_id, line_no, line): the first tab-separated cell, null for a blank line, and what follows it."""
    blank = F.trim("line") == ""
    first = F.when(~blank, F.substring_index("line", "\t", 1))
    rest = F.when(blank, F.col("line")).otherwise(F.expr("if(locate('\t', line) > 0, substring(line, locate('\t', line) + 1), '')"))
    return lines.select("doc_id", "line_no", first.alias("label")), lines.select("doc_id", "line_no", rest.alias("line"))


def attached(labels: DataFrame, lines: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(lines with their labels before them, documents that do not fit) for labels (doc_id, line_no, label) and lines (doc_id, line_no, line).

    A document fits if both sides have equally many lines, and blank lines
    where there is no label and only there. One that does not is left out and
    named with both numbers and its first bad line; with ``strict`` reading the
    attached lines raises with the same words instead.
    """
    l = labels.select("doc_id", "line_no", "label", F.lit(1).alias("_l"))  # noqa: E741
    r = lines.select("doc_id", "line_no", "line", F.lit(1).alias("_r"))
    both = l.join(r, ["doc_id", "line_no"], "full_outer")
    blank = F.trim("line") == ""
    odd = F.col("_l").isNull() | F.col("_r").isNull() | (F.col("label").isNull() != blank)
    found = both.groupBy("doc_id").agg(F.count("_l").alias("n_labels"), F.count("_r").alias("n_lines"), F.min(F.when(odd, F.col("line_no"))).alias("first_bad"))
    bad = found.filter("first_bad is not null")
    rows = both.join(bad, "doc_id", "left")
    whole = F.when(F.col("label").isNull(), F.col("line")).otherwise(F.concat_ws("\t", "label", "line"))
    if strict:
        told = F.format_string("document %s: %d labels for %d lines, first at line %d", F.col("doc_id").cast("string"), "n_labels", "n_lines", "first_bad")
        whole = F.when(F.col("first_bad").isNotNull(), F.raise_error(told).cast("string")).otherwise(whole)
    else:
        rows = rows.filter("first_bad is null")
    return rows.select("doc_id", "line_no", whole.alias("line")), bad


def numbered_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, line) of whole text files, lines from 1."""
    from .annotations import numbered

    return numbered(spark, path).withColumn("line_no", F.col("line_no") + 1)
