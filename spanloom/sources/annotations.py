"""Reading annotated corpora: standoff files, column files, JSON documents and tables of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.labels import canonical
from spanloom.operators.curate import first_of
from spanloom.operators.text import in_parts
from spanloom.operators.vectors import sampled_key


def _file_id(column: Column) -> Column:
    return F.regexp_extract(column, r"([^/]+?)(\.[^./]*)?$", 1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line) of text files; the id is that of the folder ``doc_id=...``, else the file's name without its ending."""
    rows = spark.read.text(path)
    doc_id = F.col("doc_id").cast("string") if "doc_id" in rows.columns else _file_id(F.col("_metadata.file_name"))
    return rows.select(doc_id.alias("doc_id"), F.col("value").alias("line"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(_file_id(F.col("_metadata.file_name")).alias("doc_id"), F.col("value").alias("text"))


def standoff(lines: DataFrame) -> DataFrame:
    """(doc_id, ent_id, label, text, fragments, bad) of T lines; a line that can't be read is marked, not dropped."""
    cells = F.split("line", "\t", 3)
    head = F.split(F.get(cells, F.lit(1)), " ", 2)
    spans = F.transform(F.split(F.get(head, F.lit(1)), ";"), lambda x: F.struct(F.split(x, " ")[0].try_cast("int").alias("start"), F.get(F.split(x, " "), F.lit(1)).try_cast("int").alias("end")))
    rows = lines.filter(F.col("line").rlike("^T")).select("doc_id", F.get(cells, F.lit(0)).alias("ent_id"), F.get(head, F.lit(0)).alias("label"), F.get(cells, F.lit(2)).alias("text"), spans.alias("fragments"), "line")
    bad = F.col("text").isNull() | F.coalesce(F.exists("fragments", lambda f: f.start.isNull() | f.end.isNull() | (f.start >= f.end)), F.lit(True))
    return rows.withColumn("bad", bad)


def spans(entities: DataFrame, policy: str = "hull", labels: list[str] | None = None) -> DataFrame:
    """(doc_id, ent_id, label, start, end, text): hull (first to last offset), fragments (a row each), or last fragment."""
    rows = entities.filter("not bad")
    rows = rows.filter(F.col("label").isin(labels)) if labels is not None else rows
    if policy == "fragments":
        return rows.withColumn("f", F.explode("fragments")).select("doc_id", "ent_id", "label", "f.start", "f.end", "text")
    first = F.element_at("fragments", 1 if policy == "hull" else -1)
    return rows.select("doc_id", "ent_id", "label", first["start"].alias("start"), F.element_at("fragments", -1)["end"].alias("end"), "text")


def flags(lines: DataFrame) -> DataFrame:
    """(doc_id, ent_id, flag) of attribute lines."""
    cells = F.split(F.get(F.split("line", "\t"), F.lit(1)), " ")
    return lines.filter(F.col("line").rlike("^A")).select("doc_id", F.get(cells, F.lit(1)).alias("ent_id"), F.get(cells, F.lit(0)).alias("flag"))


def duplicate_ids(entities: DataFrame) -> DataFrame:
    return entities.groupBy("doc_id", "ent_id").agg(F.count("*").alias("n")).filter("n > 1")


def corpus(texts: DataFrame, entities: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, text, entities, missing): both sides kept, with the side that is missing named; the first ``limit`` by id."""
    listed = entities.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "ent_id"))).alias("entities"))
    missing = F.when(F.col("text").isNull(), "text").when(F.col("entities").isNull(), "annotations")
    rows = texts.join(listed, "doc_id", "full_outer").withColumn("missing", missing)
    return rows if limit is None else rows.orderBy("doc_id").limit(limit)


def read_corpus(spark: SparkSession, name: str, aliases: dict[str, str] | None = None, labels: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The corpus of .txt and .ann files in a folder, given by its path or an alias of it."""
    path = (aliases or {}).get(name, name)
    return corpus(read_texts(spark, f"{path}/*.txt"), spans(standoff(read_lines(spark, f"{path}/*.ann")), labels=labels), limit)


_SPAN = "struct<start_char:int,start:int,end_char:int,end:int,label:string,type:string,span_text:string,text:string>"
_DOCUMENT = f"array<struct<doc_id:string,text:string,tokens:array<string>,entities:array<{_SPAN}>,ground_truth:array<{_SPAN}>>>"


def json_documents(spark: SparkSession, path: str, split: str = "val") -> DataFrame:
    """(doc_id, text, entities) of processed JSON files: a list of documents, or an object with a list for each split.

    Fields go by either of their names; a text that is absent is its tokens
    joined by spaces, an id that is absent ``doc_<place in the file>``.
    """
    raw = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("raw"))
    items = F.when(F.col("raw").startswith("["), F.from_json("raw", _DOCUMENT)).otherwise(F.from_json("raw", f"map<string,{_DOCUMENT}>")[split])
    rows = raw.select(F.posexplode(items).alias("i", "d"))
    entities = F.transform(F.coalesce("d.entities", "d.ground_truth", F.array().cast(f"array<{_SPAN}>")), lambda e: F.struct(F.coalesce(e.start_char, e.start, F.lit(0)).alias("start"), F.coalesce(e.end_char, e.end, F.lit(0)).alias("end"), canonical(F.coalesce(e.label, e.type, F.lit("O"))).alias("label"), F.coalesce(e.span_text, e.text, F.lit("")).alias("text")))
    text = F.coalesce(F.nullif("d.text", F.lit("")), F.array_join("d.tokens", " "), F.lit(""))
    return rows.select(F.coalesce("d.doc_id", F.concat(F.lit("doc_"), F.col("i").cast("string"))).alias("doc_id"), text.alias("text"), entities.alias("entities"))


def paired(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, pos, token, gold_tag, pred_tag) of two sets of column lines (doc_id, line_no, line) by document and place.

    A line's first cell is the token, its last the tag; blank lines don't count.
    The shorter side is padded with O, and a token comes from the gold side
    first. Documents that only one side has are kept.
    """

    def side(lines: DataFrame, tag: str, token: str) -> DataFrame:
        cells = F.split(F.trim("line"), r"\s+")
        rows = lines.withColumn("cells", cells).filter(F.size("cells") >= 2)
        pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
        return rows.select("doc_id", pos.alias("pos"), F.col("cells")[0].alias(token), F.element_at("cells", -1).alias(tag))

    both = side(gold, "gold_tag", "token").join(side(predicted, "pred_tag", "other"), ["doc_id", "pos"], "full_outer")
    return both.select("doc_id", "pos", F.coalesce("token", "other").alias("token"), F.coalesce("gold_tag", F.lit("O")).alias("gold_tag"), F.coalesce("pred_tag", F.lit("O")).alias("pred_tag"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, line) of whole text files."""
    rows = read_texts(spark, path)
    return rows.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


def columns(lines: DataFrame, separator: str = r"\s+", boundary: str = "", width: int | None = None) -> DataFrame:
    """(doc_id, sent_id, line_no, cells, bad) of column files (doc_id, line_no, line); blank or ``boundary`` lines part sentences."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    stop = (F.trim("line") == "") | (F.trim("line") == boundary)
    rows = lines.withColumn("stop", stop).withColumn("sent_id", F.sum(stop.cast("int")).over(w)).filter("not stop")
    cells = F.split(F.trim("line"), separator)
    n = F.size(cells)
    bad = n != width if width is not None else n != F.first(n).over(w)
    return rows.select("doc_id", "sent_id", "line_no", cells.alias("cells"), bad.alias("bad"))


def _read_columns(batches: Iterator[pa.RecordBatch], boundary: str) -> Iterator[pa.RecordBatch]:
    for part in in_parts(batches):
        lines = pc.split_pattern(part.column(1).fill_null(" "), "\n")
        size = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
        doc, first = np.repeat(np.arange(part.num_rows), size), np.concatenate([[0], np.cumsum(size)])
        line = pc.utf8_trim(lines.flatten(), " ")
        stop = pc.or_(pc.equal(line, ""), pc.equal(line, boundary)).to_numpy(zero_copy_only=False)
        stops = np.concatenate([[0], np.cumsum(stop)])
        kept = np.flatnonzero(~stop)
        if not len(kept):
            continue
        own = doc[kept]
        head = kept[np.searchsorted(own, np.arange(part.num_rows))[own]]
        small = lambda x: pa.array(x.astype(np.int32))
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), small(stops[kept] - stops[first[own]]), small(kept - first[own]), line.take(pa.array(kept)), line.take(pa.array(head))], names=["doc_id", "sent_id", "line_no", "line", "head"])


def column_texts(texts: DataFrame, separator: str = r"\s+", boundary: str = "", width: int | None = None) -> DataFrame:
    """``columns`` of whole column files (doc_id, text), each read in its own row: no line is shuffled."""
    rows = texts.select("doc_id", "text")
    read = rows.mapInArrow(lambda batches: _read_columns(batches, boundary), f"doc_id {dict(rows.dtypes)['doc_id']}, sent_id int, line_no int, line string, head string")
    cells = F.split("line", separator)
    n = F.size(cells)
    return read.select("doc_id", "sent_id", "line_no", cells.alias("cells"), (n != (F.lit(width) if width is not None else F.size(F.split("head", separator)))).alias("bad"))


def ontology_of(path: str, entities: DataFrame, new_only: list[str]) -> str:
    """Names the ontology by the path, else by whether any label is new."""
    lowered = path.lower()
    for name in ("new", "legacy"):
        if f"/{name}/" in f"{lowered}/":
            return name
    if "relabeled" in lowered:
        return "new"
    seen = entities.agg(F.max(F.col("label").isin(new_only))).first()[0]
    return "new" if seen else "legacy"


_RECORD = "struct<text:string,label:string,confidence:double,embedding:array<float>>"


def vector_records(spark: SparkSession, path: str, allowed: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """(abstract_id, source, i, text, label, embedding) of a JSON vector store; a dictionary by abstract, a list of records, or rows of numbers.

    Only abstracts in ``allowed`` (abstract_id) of a dictionary stay. With
    ``size``, the vectors' length, of vectors with one sampled key the first is kept.
    """
    raw = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("raw"))
    part = f"struct<ground_truth:array<{_RECORD}>,predicted:array<{_RECORD}>>"
    by_abstract = raw.filter(F.col("raw").startswith("{")).select(F.explode(F.from_json("raw", f"map<string,{part}>")).alias("abstract_id", "d"))
    one = lambda name: by_abstract.select("abstract_id", F.lit(name).alias("source"), F.posexplode(f"d.{name}").alias("i", "e"))
    keyed = one("ground_truth").unionByName(one("predicted"))
    vectors = raw.filter(F.col("raw").startswith("{")).select(F.explode(F.from_json("raw", "map<string,array<float>>")).alias("abstract_id", "v")).filter("v is not null")
    keyed = keyed.select("abstract_id", "source", "i", "e.text", "e.label", "e.embedding").unionByName(vectors.select("abstract_id", F.lit("vector").alias("source"), F.lit(0).alias("i"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("label"), F.col("v").alias("embedding")))
    keyed = keyed.join(allowed.select(F.col("abstract_id").cast("string")).distinct(), "abstract_id", "left_semi") if allowed is not None else keyed
    listed = raw.filter(F.col("raw").rlike(r"^\[\s*\{")).select(F.posexplode(F.from_json("raw", f"array<{_RECORD}>")).alias("i", "e")).select(F.lit(None).cast("string").alias("abstract_id"), F.lit("list").alias("source"), "i", "e.text", "e.label", "e.embedding")
    array = raw.filter(F.col("raw").rlike(r"^\[\s*\[")).select(F.posexplode(F.from_json("raw", "array<array<float>>")).alias("i", "embedding")).select(F.lit(None).cast("string").alias("abstract_id"), F.lit("array").alias("source"), "i", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("label"), "embedding")
    found = keyed.unionByName(listed).unionByName(array).filter("embedding is not null")
    return first_of(found, [sampled_key(F.col("embedding"), size)], [F.col("abstract_id"), F.col("source"), F.col("i")]) if size else found


_BULLET = "struct<id:string,content:string,helpful:long,harmful:long,usage_count:long,modification_count:long,content_history:array<string>>"


def guideline_rules(spark: SparkSession, path: str, root: str = "sections") -> DataFrame:
    """(grp, section, place, bullet_id, content, helpful, harmful, usage_count, modification_count, content_history) of a guideline file.

    The file maps ``root`` to groups, these to sections and these to rules; counters
    and histories that are absent are 0 and empty, rules without content are left
    out.
    """
    raw = spark.read.text(path, wholetext=True)
    groups = raw.select(F.explode(F.from_json("value", f"map<string,map<string,map<string,array<{_BULLET}>>>>")[root]).alias("grp", "sections"))
    return flattened(groups)


def flattened(groups: DataFrame) -> DataFrame:
    """One row for each rule of (grp, sections: a map from section to an array of rules), with defaults for what is absent."""
    rows = groups.select("grp", F.explode("sections").alias("section", "bullets")).select("grp", "section", F.posexplode("bullets").alias("place", "b")).filter("b.content is not null")
    return rows.select("grp", "section", "place", F.col("b.id").alias("bullet_id"), "b.content", *(F.coalesce(f"b.{c}", F.lit(0)).cast("long").alias(c) for c in ("helpful", "harmful", "usage_count", "modification_count")), F.coalesce("b.content_history", F.array().cast("array<string>")).alias("content_history"))


def statistics_files(spark: SparkSession, path: str, texts: DataFrame) -> DataFrame:
    """(doc_id, n_chars, majority_class, majority_count, density) of side-car JSON files with counts by class, for documents with a text.

    density: majority entities for each character, 0 for an empty text.
    """
    files = spark.read.text(path, wholetext=True)
    doc_id = F.col("doc_id") if "doc_id" in files.columns else _file_id(F.col("_metadata.file_name"))
    raw = files.select(doc_id.alias("doc_id"), F.from_json("value", "struct<majority_voted_class:string,entity_frequency_per_class:map<string,long>>").alias("d"))
    count = F.coalesce(F.col("d.entity_frequency_per_class")[F.col("d.majority_voted_class")], F.lit(0))
    rows = raw.select("doc_id", F.coalesce("d.majority_voted_class", F.lit("None")).alias("majority_class"), count.alias("majority_count"))
    n = F.length("text")
    return rows.join(texts, "doc_id").select("doc_id", n.cast("long").alias("n_chars"), "majority_class", "majority_count", F.when(n > 0, F.col("majority_count") / n).otherwise(0.0).alias("density"))


def decision_cache(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """A table of earlier decisions, one row for each key (the last written, by ``seq``); empty if the folder has none."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "seq").alias("row")).select(*keys, "row.*")


def split_corpora(parts: dict[str, DataFrame]) -> DataFrame:
    """The union of predefined splits, with their name in ``split``; a document of several splits stays in the first only."""
    ranked = [rows.withColumn("split", F.lit(name)).withColumn("_rank", F.lit(i)) for i, (name, rows) in enumerate(parts.items())]
    rows = ranked[0]
    for other in ranked[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    first = rows.groupBy("doc_id").agg(F.min("_rank").alias("_rank"))
    return rows.join(first, ["doc_id", "_rank"], "left_semi").drop("_rank")


def reference_vectors(rows: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(abstract_id, source, text, label, embedding) of rows with ground_truth and predicted arrays; only allowed abstracts."""
    one = lambda name: rows.select("abstract_id", F.lit(name).alias("source"), F.explode(name).alias("e")).select("abstract_id", "source", "e.text", "e.label", "e.embedding")
    found = one("ground_truth").unionByName(one("predicted"))
    return found.join(allowed, "abstract_id", "left_semi") if allowed is not None else found
