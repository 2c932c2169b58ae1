"""Writing results: standoff and column lines, training tables, run metrics and snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.text import eliminate_overlaps, line_texts, tagged_texts


def standoff_lines(entities: DataFrame) -> DataFrame:
    """(doc_id, n, line): T lines with running ids in each document. entities: (doc_id, start, end, label, text)."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "label"))
    return entities.withColumn("n", n).select("doc_id", "n", F.format_string("T%d\t%s %d %d\t%s", "n", "label", "start", "end", "text").alias("line"))


def column_lines(tokens: DataFrame, offsets: bool = True) -> DataFrame:
    """(doc_id, sent_id, pos, line): tag, with offsets, and token, tab-separated."""
    cells = ["tag", "start", "end", "token"] if offsets else ["tag", "token"]
    return tokens.select("doc_id", "sent_id", "pos", F.concat_ws("\t", *(F.col(c).cast("string") for c in cells)).alias("line"))


def write_by_document(lines: DataFrame, path: str, order: str = "n") -> None:
    """Lines under ``path``, a folder for each document, in order."""
    lines.repartition("doc_id").sortWithinPartitions("doc_id", order).select("doc_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def training_tables(records: DataFrame, path: str) -> None:
    """Combined and per-prompt training tables as CSV with a head and as JSON lines."""
    for name, prefix in (("combined", ""), ("v1", "v2_"), ("v2", "v1_")):
        kept = [c for c in records.columns if not prefix or not c.startswith(prefix)]
        records.select(kept).write.mode("overwrite").csv(f"{path}/{name}_csv", header=True)
        records.select(kept).write.mode("overwrite").json(f"{path}/{name}_json")


def write_runs(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON, a folder for each run; runs that are not in ``metrics`` stay, and a repeated write changes nothing. See runs.RunStore for versions."""
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)


def upserted(index: DataFrame, runs: DataFrame, key: str = "run_id", version: str = "seq") -> DataFrame:
    """The latest row of each run of both tables."""
    rows = index.unionByName(runs, allowMissingColumns=True)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), version).alias("row")).select(key, "row.*")


def snapshot(rules: DataFrame, path: str, label: str) -> None:
    """A labelled snapshot; one of the same label is replaced, so a repeated job does not double it."""
    rules.withColumn("snapshot", F.lit(label)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(path)


def rules_markdown(rules: DataFrame) -> DataFrame:
    """(section, bullet_id, line): a Markdown list, a row to a line; a section's heading has an empty id, and lines sort by section and id."""
    head = rules.select("section").distinct().select("section", F.lit("").alias("bullet_id"), F.concat(F.lit("## "), "section").alias("line"))
    line = F.format_string("- [%s] %s (helpful %d, harmful %d)", "bullet_id", "content", "helpful", "harmful")
    return head.unionByName(rules.select("section", "bullet_id", line.alias("line")))


def vector_table(entities: DataFrame, prefix: str) -> DataFrame:
    """Rows with ids <doc>_<prefix>_<i>, for a table of vectors."""
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end")) - 1
    return entities.withColumn("id", F.concat_ws("_", F.col("doc_id").cast("string"), F.lit(prefix), i.cast("string")))


#: Characters of JSON in a store's file, but for a larger item.
STORE_CHARS = 4 << 20


def _stores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[str]] = {}
    keys: dict[str, set[str]] = {}
    size: dict[str, int] = {}

    def whole(layout: str) -> pa.RecordBatch:
        size.pop(layout)
        marks = "{}" if keys.pop(layout) else "[]"
        return pa.RecordBatch.from_pydict({"value": [marks[0] + ", ".join(held.pop(layout)) + marks[1]]})

    for batch in batches:
        for layout, key, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if layout in held and (size[layout] >= STORE_CHARS or key in keys[layout]):
                yield whole(layout)
            if key is not None:
                keys.setdefault(layout, set()).add(key)
                item = f"{json.dumps(key)}: {item}"
            keys.setdefault(layout, set())
            held.setdefault(layout, []).append(item)
            size[layout] = size.get(layout, 0) + len(item)
    for layout in list(held):
        yield whole(layout)


def json_stores(items: DataFrame) -> DataFrame:
    """(value): the JSON of whole stores from rows (layout, key, item); items of a layout share stores of about 4 MB, in the task that reads them.

    Items with keys are an object, those without a list; a key that its store holds
    already opens another, null items are left out. The number of stores, which the driver
    lists as files, grows with bytes and tasks, not with rows.
    """
    return items.filter("item is not null").select("layout", F.col("key").cast("string"), "item").mapInArrow(_stores, "value string")


def pair_lines(zipped: DataFrame) -> DataFrame:
    """(doc_id, n, line): token, gold and predicted tag of each token, tab-separated, for write_by_document."""
    return zipped.select("doc_id", F.col("pos").alias("n"), F.concat_ws("\t", F.coalesce("token", F.lit("<UNK>")), "gold_tag", "pred_tag").alias("line"))


def rules_flat(rules: DataFrame) -> DataFrame:
    """(section, bullet_id, line): a rule to a line, as [id] section: content."""
    return rules.select("section", "bullet_id", F.format_string("[%s] %s: %s", "bullet_id", "section", "content").alias("line"))


def rules_csv(rules: DataFrame, path: str) -> None:
    """Rules as CSV with a head; histories become one cell, a line for each entry."""
    rows = rules.withColumn("content_history", F.array_join("content_history", "\n")) if "content_history" in rules.columns else rules
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def curator_markdown(rules: DataFrame, similar: DataFrame) -> DataFrame:
    """(section, bullet_id, line): the curator's list; only rules in ``similar`` (bullet_id) show counters and history."""
    rows = rules.join(similar.select("bullet_id").distinct().withColumn("alike", F.lit(True)), "bullet_id", "left")
    detail = F.concat(F.format_string(" (helpful %d, harmful %d, used %d)", "helpful", "harmful", "usage_count"), F.when(F.size("content_history") > 0, F.concat(F.lit("\n  - before: "), F.array_join("content_history", "; "))).otherwise(""))
    return rows.select("section", "bullet_id", F.concat(F.format_string("- [%s] %s", "bullet_id", "content"), F.when(F.col("alike"), detail).otherwise("")).alias("line"))


def write_subsets(texts: DataFrame, subsets: DataFrame, path: str) -> None:
    """The documents of each subset (doc_id, subset) under a folder of its own."""
    texts.join(subsets.select("doc_id", "subset"), "doc_id").write.mode("overwrite").partitionBy("subset").parquet(path)


def write_sweeps(metrics: DataFrame, best: DataFrame, path: str) -> None:
    """Sweep tables as CSV, a folder for each sweep, the best settings and a summary (runs, best and mean F1) as JSON."""
    metrics.write.mode("overwrite").partitionBy("sweep").csv(f"{path}/sweeps", header=True)
    best.write.mode("overwrite").json(f"{path}/best")
    metrics.groupBy("sweep").agg(F.count("*").alias("runs"), F.max("macro_f1").alias("best_f1"), F.round(F.avg("macro_f1"), 6).alias("mean_f1")).write.mode("overwrite").json(f"{path}/summary")


def corpus_lines(docs: DataFrame, spans: DataFrame, offsets: bool = True) -> DataFrame:
    """(doc_id, sent_id, pos, line) of a corpus: texts cut into tokens, overlapping spans dropped, the others as tags."""
    return column_lines(tagged_texts(docs, eliminate_overlaps(spans)), offsets)


def corpus_texts(docs: DataFrame, spans: DataFrame, offsets: bool = True, parted: bool = False) -> DataFrame:
    """(doc_id, text): the lines of corpus_lines as one text for each document, with a blank line between sentences if ``parted``."""
    return line_texts(docs, eliminate_overlaps(spans), offsets, parted)


def audit_rows(audited: DataFrame, path: str) -> None:
    """Rows of an audit (run_id, doc_id, candidate, labels, outcome, category) as Parquet, a folder for each run; other runs stay."""
    audited.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
