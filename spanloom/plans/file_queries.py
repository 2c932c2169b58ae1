"""Queries that write files in the formats of annotated corpora and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import places as PL
from spanloom.operators import prompts as P
from spanloom.operators import sweep as X
from spanloom.operators import text as T
from spanloom.sources import annotations as A
from spanloom.sources import quarantine as Q
from spanloom.sources import sinks as K
from spanloom.sources.runs import RunStore
from spanloom.sources.scratch import through_files

from .curate_queries import _RULES, counted_rules, rules
from .derived import CANDIDATES_SQL, candidates, table
from .score_queries import _ALL, _CATEGORY, _GATED, _OUTCOME, _sweep_sql, audited, features
from .text_queries import MENTIONS_SQL, mentions

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


#: Tokens and mentions of the benchmark's texts.
_ITEMS = MENTIONS_SQL.replace("SELECT doc_id, regexp_extract_all(text", "SELECT item_id AS doc_id, regexp_extract_all(text").replace("FROM documents)", "FROM benchmark)")


def item_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(T.tokens(benchmark(spark, sf_dir)))


def _one_a_file(rows: DataFrame, path: str) -> None:
    """A text file for each row of one string column."""
    rows.write.option("maxRecordsPerFile", 1).option("lineSep", "\x00").text(path)


@query(f"""WITH {_ITEMS}, e AS (SELECT doc_id, gold_id, start, "end", label FROM gold), f AS (SELECT doc_id, 'T' || (gold_id + 1) AS ent_id, label, start, "end" FROM e UNION ALL SELECT doc_id, 'T' || (gold_id + 1), label, "end" + 2, "end" + 5 FROM e WHERE gold_id % 3 = 0)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, ent_id, label, start, "end" FROM f""")
def s_fragment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of one or two fragments through .ann files, a row for each fragment; lines of other kinds are passed over."""
    i = F.col("gold_id")
    second = F.when(i % 3 == 0, F.format_string(";%d %d", F.col("end") + 2, F.col("end") + 5)).otherwise("")
    entities = item_mentions(spark, sf_dir).select("doc_id", (i + 1).alias("n"), F.concat(F.format_string("T%d\t%s %d %d", i + 1, "label", "start", "end"), second, F.lit("\t"), "text").alias("line"))
    notes = entities.select("doc_id", "n", F.format_string("#%d\tNote T%d\tseen", "n", "n").alias("line"))

    def steps(folder: str) -> DataFrame:
        K.write_by_document(entities.unionByName(notes), folder)
        return A.spans(A.standoff(A.read_lines(spark, folder)), "fragments").drop("text")

    return through_files(spark, steps)


@query(f"""WITH {_ITEMS}, e AS (SELECT doc_id, 'T' || (gold_id % 50) AS ent_id, gold_id FROM gold), d AS (SELECT doc_id, ent_id, count(*) AS n FROM e GROUP BY ALL)
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.ent_id, d.n > 1 AS duplicate, f.flags FROM d JOIN (SELECT doc_id, ent_id, count(*) FILTER (gold_id % 2 = 0) AS flags FROM e GROUP BY ALL) f USING (doc_id, ent_id)""")
def s_flag_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute lines and ids given twice, through .ann files."""
    i = F.col("gold_id")
    rows = item_mentions(spark, sf_dir)
    entity = rows.select("doc_id", i.alias("n"), F.format_string("T%d\t%s %d %d\t%s", i % 50, "label", "start", "end", "text").alias("line"))
    flag = rows.filter(i % 2 == 0).select("doc_id", i.alias("n"), F.format_string("A%d\tNegated T%d", i, i % 50).alias("line"))

    def steps(folder: str) -> DataFrame:
        K.write_by_document(entity.unionByName(flag), folder)
        lines = A.read_lines(spark, folder)
        entities = A.standoff(lines)
        twice = A.duplicate_ids(entities).select("doc_id", "ent_id", F.lit(True).alias("duplicate"))
        flags = A.flags(lines).filter("flag = 'Negated'").groupBy("doc_id", "ent_id").agg(F.count("*").alias("flags"))
        found = entities.select("doc_id", "ent_id").distinct().join(twice, ["doc_id", "ent_id"], "left").join(flags, ["doc_id", "ent_id"], "left")
        return found.select("doc_id", "ent_id", F.coalesce("duplicate", F.lit(False)).alias("duplicate"), F.coalesce("flags", F.lit(0)).alias("flags"))

    return through_files(spark, steps)


@query(f"""WITH {_ITEMS}, n AS (SELECT doc_id, count(*) AS entities FROM gold WHERE label <> 'C0' AND doc_id % 5 <> 0 GROUP BY ALL), b AS (SELECT item_id AS doc_id, text FROM benchmark WHERE item_id % 7 <> 0)
SELECT CAST(coalesce(b.doc_id, n.doc_id) AS VARCHAR) AS doc_id, coalesce(length(text), -1) AS n_chars, coalesce(entities, 0) AS entities, CASE WHEN b.doc_id IS NULL THEN 'text' WHEN n.doc_id IS NULL THEN 'annotations' ELSE 'none' END AS missing FROM b FULL JOIN n ON b.doc_id = n.doc_id""")
def s_corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of texts and annotations under an alias, some files of either kind missing; classes by an allow-list."""
    texts = benchmark(spark, sf_dir).filter("doc_id % 7 <> 0")
    lines = K.standoff_lines(item_mentions(spark, sf_dir).filter("doc_id % 5 <> 0"))

    def steps(folder: str) -> DataFrame:
        texts.write.option("maxRecordsPerFile", 1).option("lineSep", "\x00").partitionBy("doc_id").text(f"{folder}/texts")
        K.write_by_document(lines, f"{folder}/annotations")
        read = spark.read.text(f"{folder}/texts", lineSep="\x00").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("value").alias("text"))
        entities = A.spans(A.standoff(A.read_lines(spark, f"{folder}/annotations")), labels=[f"C{i}" for i in range(1, 9)])
        return A.corpus(read, entities).select("doc_id", F.coalesce(F.length("text"), F.lit(-1)).alias("n_chars"), F.coalesce(F.size("entities"), F.lit(0)).alias("entities"), F.coalesce("missing", F.lit("none")).alias("missing"))

    return through_files(spark, steps)


@query("""SELECT CASE WHEN item_id % 3 = 0 THEN 'doc_0' ELSE CAST(item_id AS VARCHAR) END AS doc_id, length(CASE WHEN item_id % 2 = 0 THEN text ELSE regexp_replace(text, ' +', ' ', 'g') END) AS n_chars, item_id % 4 AS start, item_id % 4 + 5 AS "end",
CASE item_id % 3 WHEN 0 THEN 'Substance_use' WHEN 1 THEN 'Sleep' ELSE 'Physical_activities' END AS label FROM benchmark""")
def s_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file for each item: lists and splits, texts and tokens, spans under either of their names."""
    i = F.col("doc_id")
    label = F.when(i % 3 == 0, "Drugs").when(i % 3 == 1, "sleep").otherwise("Physical_activity")
    spans = F.when(i % 2 == 0, F.to_json(F.array(F.struct((i % 4).alias("start_char"), (i % 4 + 5).alias("end_char"), label.alias("label"))))).otherwise(F.to_json(F.array(F.struct((i % 4).alias("start"), (i % 4 + 5).alias("end"), label.alias("type")))))
    tokens = F.to_json(F.struct(F.split("text", " +").alias("tokens")))
    head = F.when(i % 3 == 0, "").otherwise(F.format_string('"doc_id": "%d", ', i))
    body = F.concat(F.lit("{"), head, F.when(i % 2 == 0, '"entities": ').otherwise('"ground_truth": '), spans, F.lit(", "), F.expr("substring(t, 2)"))
    rows = benchmark(spark, sf_dir).withColumn("t", F.when(i % 2 == 0, F.to_json(F.struct("text"))).otherwise(tokens))
    rows = rows.select(F.when(i % 2 == 0, F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.concat(F.lit('{"train": [], "val": ['), body, F.lit("]}"))).alias("value"))

    def steps(folder: str) -> DataFrame:
        _one_a_file(rows, folder)
        return A.json_documents(spark, folder).select("doc_id", F.length("text").alias("n_chars"), F.explode("entities").alias("e")).select("doc_id", "n_chars", "e.start", "e.end", "e.label")

    return through_files(spark, steps)


_STORE = """SELECT CASE vec_id % 4 WHEN 3 THEN 'array' WHEN 2 THEN 'list' WHEN 1 THEN 'predicted' ELSE 'ground_truth' END AS source, count(*) AS n, count(DISTINCT label) AS labels, round(sum(embedding[1]), 2) AS first FROM embeddings"""


@query(f"{_STORE} WHERE NOT (vec_id % 4 < 2 AND vec_id % 5 = 0) GROUP BY source".replace("count(DISTINCT label) AS labels", "CASE WHEN any_value(vec_id % 4) = 3 THEN 0 ELSE count(DISTINCT label) END AS labels"))
def s_vector_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in stores of three layouts; of the dictionaries only the allowed abstracts stay."""
    i = F.col("vec_id")
    record = F.to_json(F.struct(F.lit("x").alias("text"), F.col("label").cast("string").alias("label"), F.col("embedding")))
    keyed = F.concat(F.format_string('{"%s": [', F.when(i % 4 == 1, "predicted").otherwise("ground_truth")), record, F.lit("]}"))
    layout = F.when(i % 4 == 3, "array").when(i % 4 == 2, "list").otherwise("dictionary")
    item = F.when(i % 4 == 3, F.to_json("embedding")).when(i % 4 == 2, record).otherwise(keyed)
    vectors = table(spark, sf_dir, "embeddings")
    rows = K.json_stores(vectors.select(layout.alias("layout"), F.when(layout == "dictionary", F.coalesce(i.cast("string"), F.lit("null"))).alias("key"), item.alias("item")))

    def steps(folder: str) -> DataFrame:
        _one_a_file(rows, folder)
        found = A.vector_records(spark, folder, vectors.filter("vec_id % 5 <> 0").select(i.cast("string").alias("abstract_id")))
        return found.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"), F.round(F.sum(F.col("embedding")[0].cast("double")), 2).alias("first"))

    return through_files(spark, steps)


@query(f"""WITH {_RULES} SELECT CASE WHEN section IN ('Nutrition', 'Sleep') THEN 'behaviour' ELSE 'exposure' END AS grp, section, bullet_id, content, helpful, CAST(0 AS BIGINT) AS harmful FROM cr WHERE rule_no % 9 <> 0""")
def s_guideline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as guideline files, with counters and contents left out here and there."""
    stored = counted_rules(spark, sf_dir)
    from spanloom.operators.rules import SECTIONS

    group = F.create_map(*(F.lit(x) for s, _, g in SECTIONS for x in (s, g)))[F.col("section")]
    bullet = F.to_json(F.struct(F.col("bullet_id").alias("id"), F.when(F.col("rule_no") % 9 != 0, F.col("content")).alias("content"), F.when(F.col("helpful") > 0, F.col("helpful")).alias("helpful")))
    rows = stored.select(F.concat(F.lit('{"sections": {"'), group, F.lit('": {"'), "section", F.lit('": ['), bullet, F.lit("]}}}")).alias("value"))

    def steps(folder: str) -> DataFrame:
        _one_a_file(rows, folder)
        return A.guideline_rules(spark, folder).select("grp", "section", "bullet_id", "content", "helpful", "harmful")

    return through_files(spark, steps)


@query("""SELECT item_id AS doc_id, length(text) AS n_chars, CASE WHEN item_id % 6 = 0 THEN 'None' ELSE 'C' || (item_id % 3) END AS majority_class, CASE WHEN item_id % 6 = 0 THEN 0 ELSE item_id % 10 + 1 END AS majority_count,
round(CASE WHEN item_id % 6 = 0 THEN 0 ELSE (item_id % 10 + 1) / length(text) END, 6) AS density FROM benchmark""")
def s_statistics_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by class in a side-car file for each document, joined to the texts."""
    i = F.col("doc_id")
    counts = F.format_string('"entity_frequency_per_class": {"C%d": %d, "C9": 1}', i % 3, i % 10 + 1)
    head = F.when(i % 6 == 0, "").otherwise(F.format_string('"majority_voted_class": "C%d", ', i % 3))
    docs = benchmark(spark, sf_dir)

    def steps(folder: str) -> DataFrame:
        docs.select("doc_id", F.concat(F.lit("{"), head, counts, F.lit("}")).alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).partitionBy("doc_id").text(folder)
        return A.statistics_files(spark, folder, docs).withColumn("density", F.round("density", 6))

    return through_files(spark, steps)


@query(f"""WITH {CANDIDATES_SQL}, c AS (SELECT doc_id, local, second, arg_max(answer, cand_id) AS answer, max(cand_id) AS seq FROM cand GROUP BY ALL) SELECT * FROM c""")
def s_decision_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions appended in two runs, read as the last one of each key."""
    rows = candidates(spark, sf_dir).select("doc_id", "local", "second", "answer", F.col("cand_id").alias("seq"))

    def steps(folder: str) -> DataFrame:
        rows.filter("seq % 2 = 0").write.mode("append").parquet(folder)
        rows.filter("seq % 2 = 1").write.mode("append").parquet(folder)
        return A.decision_cache(spark, folder, ["doc_id", "local", "second"])

    return through_files(spark, steps)


@query(f"""WITH {_ITEMS}, g AS (SELECT doc_id, pos, token, 'B-' || (pos % 3) AS gold_tag FROM tok), p AS (SELECT doc_id, pos, token, CASE WHEN pos % 4 = 0 THEN 'O' ELSE 'B-' || (pos % 3) END AS pred_tag FROM tok WHERE pos < 30 OR doc_id % 2 = 0),
z AS (SELECT g.doc_id, g.pos, g.token, gold_tag, coalesce(pred_tag, 'O') AS pred_tag FROM g LEFT JOIN p USING (doc_id, pos))
SELECT doc_id, count(*) AS n, md5(string_agg(token || chr(9) || gold_tag || chr(9) || pred_tag, chr(10) ORDER BY pos)) AS digest FROM z GROUP BY doc_id""")
def s_paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted column files, of which some end early, side by side in three-column files."""
    rows = T.tokens(benchmark(spark, sf_dir))
    tag = F.concat(F.lit("B-"), (F.col("pos") % 3).cast("string"))
    lines = lambda rows, tag: rows.select("doc_id", F.col("pos").alias("n"), F.concat_ws("\t", F.col("pos").cast("string"), "token", tag).alias("line"))

    def numbered(path: str) -> DataFrame:
        read = spark.read.text(path).select("doc_id", F.col("value").alias("line"))
        return read.select("doc_id", F.substring_index("line", "\t", 1).cast("int").alias("line_no"), F.expr("substring(line, locate('\t', line) + 1)").alias("line"))

    def steps(folder: str) -> DataFrame:
        K.write_by_document(lines(rows, tag), f"{folder}/gold")
        K.write_by_document(lines(rows.filter("pos < 30 or doc_id % 2 = 0"), F.when(F.col("pos") % 4 == 0, "O").otherwise(tag)), f"{folder}/predicted")
        both = A.paired(numbered(f"{folder}/gold"), numbered(f"{folder}/predicted"))
        told = K.pair_lines(both)
        return told.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x.line), "\n")).alias("digest"))

    return through_files(spark, steps)


@query(f"""WITH {MENTIONS_SQL}, d AS (SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM documents)
SELECT split, count(DISTINCT d.doc_id) AS docs, count(gold_id) AS spans, CAST(coalesce(sum(gold_id), 0) AS BIGINT) AS places FROM d LEFT JOIN gold USING (doc_id) GROUP BY split""")
def w_predefined_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits that share documents; each keeps the split that comes first, and spans become token spans in their split."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = F.col("doc_id") % 10
    parts = A.split_corpora({"train": docs.filter(at < 7), "val": docs.filter((at >= 6) & (at < 8)), "test": docs.filter(at >= 7)})
    rows = T.tokens(parts)
    aligned = T.align_to_tokens(mentions(rows).withColumnRenamed("gold_id", "span_id"), rows)
    counted = parts.select("doc_id", "split").join(aligned, "doc_id", "left")
    return counted.groupBy("split").agg(F.countDistinct("doc_id").alias("docs"), F.count("first").alias("spans"), F.coalesce(F.sum("first"), F.lit(0)).alias("places"))


@query(f"""WITH {_RULES} SELECT bullet_id, section, '[' || bullet_id || '] ' || section || ': ' || content AS flat, '- [' || bullet_id || '] ' || content || CASE WHEN rule_no % 3 = 0 THEN ' (helpful ' || helpful || ', harmful ' || harmful || ', used ' || used || ')' ELSE '' END AS curator FROM cr""")
def k_rule_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules through CSV, as flat lines and as the curator's list with detail for some."""
    stored = counted_rules(spark, sf_dir)

    def steps(folder: str) -> DataFrame:
        K.rules_csv(stored.select("bullet_id", "section", "content", "content_history"), folder)
        read = spark.read.csv(folder, header=True, quote='"', escape='"', multiLine=True)
        flat = K.rules_flat(read).select("bullet_id", F.col("line").alias("flat"))
        curator = K.curator_markdown(stored, stored.filter("rule_no % 3 = 0")).select("bullet_id", "section", F.col("line").alias("curator"))
        return curator.join(flat, "bullet_id").select("bullet_id", "section", "flat", "curator")

    return through_files(spark, steps)


@query(_sweep_sql(_ALL, "SELECT sweep, count(*) AS runs, CAST(max(macro_f1) AS VARCHAR) AS best_f1, CAST(sum(tp) AS BIGINT) AS tp, arg_max(run_id, macro_f1 * 1000000 - CAST(right(run_id, 2) AS DOUBLE) / 1000) AS best_run FROM metrics GROUP BY sweep").replace("CAST(max(macro_f1) AS VARCHAR)", "round(max(macro_f1), 6)"))
def k_sweep_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep tables, best settings and summary through CSV and JSON."""
    metrics = X.sweep(features(spark, sf_dir), _ALL)

    def steps(folder: str) -> DataFrame:
        K.write_sweeps(metrics, X.best(metrics), folder)
        tables = spark.read.csv(f"{folder}/sweeps", header=True).groupBy("sweep").agg(F.sum(F.col("tp").cast("long")).alias("tp"))
        summary = spark.read.json(f"{folder}/summary").select("sweep", "runs", F.round("best_f1", 6).alias("best_f1"))
        best = spark.read.json(f"{folder}/best").select("sweep", F.col("run_id").alias("best_run"))
        return summary.join(tables, "sweep").join(best, "sweep").select("sweep", "runs", "best_f1", "tp", "best_run")

    return through_files(spark, steps)


@query(f"{_GATED}, a AS (SELECT doc_id, cand_id, {_OUTCOME} AS outcome, {_CATEGORY} AS category FROM gated) SELECT CAST(doc_id % 3 AS INTEGER) AS run_id, outcome, category, count(*) AS n FROM a GROUP BY ALL")
def k_audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of three runs through Parquet."""
    rows = audited(spark, sf_dir).select((F.col("doc_id") % 3).cast("int").alias("run_id"), "doc_id", "cand_id", "gold", "local", "answer", "final", "outcome", "category")

    def steps(folder: str) -> DataFrame:
        K.audit_rows(rows, folder)
        return spark.read.parquet(folder).groupBy("run_id", "outcome", "category").agg(F.count("*").alias("n"))

    return through_files(spark, steps)


@query("SELECT CAST(doc_id % 4 AS INTEGER) AS subset, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents WHERE doc_id % 4 <> 3 GROUP BY ALL")
def k_subset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def steps(folder: str) -> DataFrame:
        K.write_subsets(docs, docs.filter("doc_id % 4 <> 3").select("doc_id", (F.col("doc_id") % 4).cast("int").alias("subset")), folder)
        return spark.read.parquet(folder).groupBy("subset").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("n_chars"))

    return through_files(spark, steps)


@query(f"WITH {CANDIDATES_SQL} SELECT t.name, t.n, x.rows_, x.total FROM (VALUES ('combined', 5), ('v1', 4), ('v2', 4)) t(name, n), (SELECT count(*) AS rows_, CAST(sum(cand_id) AS BIGINT) AS total FROM cand) x".replace("rows_", "records"))
def k_training_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined and the two single-prompt training tables, read back from CSV and JSON."""
    records = candidates(spark, sf_dir).select("cand_id", "gold", "local", F.col("answer").alias("v1_answer"), F.col("second").alias("v2_answer"))

    def steps(folder: str) -> DataFrame:
        K.training_tables(records, folder)
        rows = None
        for name in ("combined", "v1", "v2"):
            read, other = spark.read.csv(f"{folder}/{name}_csv", header=True), spark.read.json(f"{folder}/{name}_json")
            now = read.agg(F.count("*").alias("records")).join(other.agg(F.sum("cand_id").alias("total")), F.lit(True)).select(F.lit(name).alias("name"), F.lit(len(read.columns)).alias("n"), "records", "total")
            rows = now if rows is None else rows.unionByName(now)
        return rows

    return through_files(spark, steps)


@query("SELECT CAST(user_id % 20 AS INTEGER) AS run_id, count(*) AS n, max(event_id) AS last, 'before' AS snapshot FROM events GROUP BY ALL UNION ALL SELECT CAST(user_id % 20 AS INTEGER), count(*), max(event_id), 'after' FROM events WHERE event_id % 2 = 0 GROUP BY ALL")
def k_run_and_snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metrics as JSON by run, and two labelled snapshots of them."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).cast("int").alias("run_id"), "event_id")
    metrics = lambda rows: rows.groupBy("run_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))

    def steps(folder: str) -> DataFrame:
        K.write_runs(metrics(rows), f"{folder}/runs")
        K.snapshot(spark.read.json(f"{folder}/runs"), f"{folder}/snapshots", "before")
        K.snapshot(metrics(rows.filter("event_id % 2 = 0")), f"{folder}/snapshots", "after")
        return spark.read.parquet(f"{folder}/snapshots").select(F.col("run_id").cast("int").alias("run_id"), "n", "last", "snapshot")

    return through_files(spark, steps)


_LINES = f"""{_ITEMS}, ln AS (SELECT doc_id, gold_id, gold_id + 1 AS line_no, CASE gold_id % 9 WHEN 0 THEN 'unknown kind of line' WHEN 1 THEN 'an entity needs three cells' WHEN 2 THEN 'unreadable offsets' WHEN 3 THEN 'an empty span' WHEN 4 THEN 'unknown type Odd' ELSE NULL END AS reason FROM gold)"""


@query(f"""WITH {_LINES} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(line_no AS INTEGER) AS line_no, reason, (SELECT count(*) FROM ln) AS n_rows, (SELECT count(*) FROM ln WHERE reason IS NOT NULL) AS n_bad FROM ln WHERE reason IS NOT NULL""")
def s_quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standoff lines of which many are broken, through files: the bad ones with file, line and reason, and the counts observed while writing."""
    i = F.col("gold_id")
    good = F.format_string("T%d\t%s %d %d\t%s", i, "label", "start", "end", "text")
    line = (
        F.when(i % 9 == 0, F.concat(F.lit("?"), good))
        .when(i % 9 == 1, F.format_string("T%d\t%s %d %d", i, "label", "start", "end"))
        .when(i % 9 == 2, F.format_string("T%d\t%s %d x\t%s", i, "label", "start", "text"))
        .when(i % 9 == 3, F.format_string("T%d\t%s %d %d\t%s", i, "label", "end", "start", "text"))
        .when(i % 9 == 4, F.format_string("T%d\tOdd %d %d\t%s", i, "start", "end", "text"))
        .otherwise(good)
    )
    rows = item_mentions(spark, sf_dir).select("doc_id", i.alias("n"), F.concat((i + 1).cast("string"), F.lit("\x01"), line).alias("line"))

    def steps(folder: str) -> DataFrame:
        K.write_by_document(rows, f"{folder}/lines")
        read = A.read_lines(spark, f"{folder}/lines")
        lines = read.select("doc_id", F.substring_index("line", "\x01", 1).cast("int").alias("line_no"), F.substring_index("line", "\x01", -1).alias("line"))
        kept, bad, counts = Q.set_apart(Q.standoff_records(lines, [f"C{k}" for k in range(9)]), f"{folder}/records")
        assert counts["good"] == Q.good_entities(kept).filter("not bad").count()
        return bad.select("doc_id", "line_no", "reason", F.lit(counts["rows"]).alias("n_rows"), F.lit(counts["bad"]).alias("n_bad"))

    return through_files(spark, steps)


@query(f"""WITH {_ITEMS}, n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id), b AS (SELECT doc_id, n, CASE WHEN doc_id % 4 = 0 THEN n - 1 ELSE n END AS labels FROM n)
SELECT doc_id, n AS n_lines, labels AS n_labels, CASE WHEN labels = n THEN md5((SELECT string_agg('B-' || (pos % 3) || chr(9) || token, chr(10) ORDER BY pos) FROM tok t WHERE t.doc_id = b.doc_id)) ELSE '' END AS digest FROM b WHERE labels > 0""")
def p_attached_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label column taken off and put back; documents whose labels are one short are named and left out."""
    rows = T.tokens(benchmark(spark, sf_dir))
    lines = rows.select("doc_id", F.col("pos").alias("line_no"), F.concat_ws("\t", F.concat(F.lit("B-"), (F.col("pos") % 3).cast("string")), "token").alias("line"))
    labels, bare = Q.stripped(lines)
    labels = labels.filter("not (doc_id % 4 = 0 and line_no = 0)")
    again, bad = Q.attached(labels, bare, strict=False)
    digest = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"))
    good = again.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("*").alias("n_labels"), digest.alias("digest"))
    return good.unionByName(bad.filter("n_labels > 0").select("doc_id", "n_lines", "n_labels", F.lit("").alias("digest")))


@query("""WITH b AS (SELECT CAST(user_id % 20 AS VARCHAR) AS run_id, user_id % 20 AS r, event_id FROM events)
SELECT run_id, count(*) AS n, max(event_id) AS last, CAST(CASE WHEN r % 4 = 0 THEN 4 WHEN r % 2 = 1 THEN 3 ELSE 1 END AS BIGINT) AS seq FROM b WHERE r % 4 <> 0 OR event_id % 3 = 0 GROUP BY run_id, r""")
def k_run_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even runs, then odd ones, these again as a repeated job would, then new rows for some; read as current, with their commits."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run_id"), "event_id")

    def steps(folder: str) -> DataFrame:
        store, r = RunStore(spark, f"{folder}/runs"), F.col("run_id")
        store.write(rows.filter(r % 2 == 0))
        store.write(rows.filter(r % 2 == 1))
        store.write(rows.filter(r % 2 == 1))
        store.write(rows.filter((r % 4 == 0) & (F.col("event_id") % 3 == 0)))
        store.clean()
        found = store.read().groupBy("run_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
        return found.join(store.manifest().select("run_id", "seq"), "run_id")

    return through_files(spark, steps)


@query(f"""WITH {_ITEMS}, h AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, "end") - 1 AS INTEGER) AS place, text AS entity, 'in class ' || label AS hint, CASE WHEN doc_id % 3 = 0 AND gold_id % 3 = 0 THEN label || ', O' ELSE '' END AS competing FROM gold),
b AS (SELECT doc_id, md5(string_agg('- Hint ' || (place + 1) || ' for ''' || entity || '''' || CASE WHEN competing <> '' THEN ' [Competing: ' || competing || ']' ELSE '' END || ': ' || hint, chr(10) ORDER BY place)) AS block FROM h GROUP BY doc_id)
SELECT doc_id, place, entity, hint, competing, block FROM h JOIN b USING (doc_id)""")
def t_hint_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hint for each mention, in answers of either field names and of every wrapping."""
    i, hint = F.col("doc_id"), F.concat(F.lit("in class "), "label")
    new = i % 3 == 0
    item = F.struct(F.when(new, F.col("text")).alias("target_entity"), F.when(~new, F.col("text")).alias("entity"), F.when(new, hint).alias("resolution_hint"), F.when(~new, hint).alias("hint"), F.when(new & (F.col("gold_id") % 3 == 0), F.array("label", F.lit("O"))).alias("competing_categories"))
    told = item_mentions(spark, sf_dir).groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", item.alias("item")))), lambda x: x.item)).alias("items"))
    raw = F.when(i % 4 == 0, F.col("items")).when(i % 4 == 1, F.concat(F.lit('{"hints": '), "items", F.lit("}"))).when(i % 4 == 2, F.concat(F.lit('```json\n{"new_hints": '), "items", F.lit("}\n```"))).otherwise(F.concat(F.lit("```\n"), "items", F.lit("\n```")))
    hints = P.parsed_hints(told.select("doc_id", raw.alias("raw")))
    return hints.join(P.hint_block(hints), "doc_id").select("doc_id", "place", "entity", "hint", F.array_join("competing", ", ").alias("competing"), F.md5("block").alias("block"))


@query(f"""WITH {CANDIDATES_SQL} SELECT cand_id, '- Entity: ''' || local || '''' || CASE WHEN cand_id % 2 = 0 THEN ' | Challenge Type: X' ELSE '' END || ' | Predicted Tag: ' || second || CASE WHEN cand_id % 3 = 0 THEN ' | Novelty: 1' ELSE '' END AS line FROM cand""")
def t_evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("cand_id")
    return candidates(spark, sf_dir).select("cand_id", P.evidence_line(F.col("local"), Challenge_Type=F.when(i % 2 == 0, "X").otherwise(""), Predicted_Tag=F.col("second"), Novelty=F.when(i % 3 == 0, 1)).alias("line"))


@query(f"""WITH {_ITEMS}, c AS (SELECT doc_id, start, '{{"entity":"' || text || '","predicted_label":"' || label || '","second_best_label":"O","uncertainty":' || CASE WHEN gold_id % 2 = 0 THEN '0.3333' ELSE '0.5' END || ',"novelty_score":0.125,"margin":0.6667}}' AS item FROM gold)
SELECT doc_id, md5('[' || string_agg(item, ',' ORDER BY start) || ']') AS digest FROM c GROUP BY doc_id""")
def t_candidate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = item_mentions(spark, sf_dir).select("doc_id", "start", "end", "text", "label", F.lit("O").alias("second"), F.when(F.col("gold_id") % 2 == 0, 1 / F.lit(3.0)).otherwise(0.5).alias("uncertainty"), F.lit(0.125).alias("novelty_score"), (2 / F.lit(3.0)).alias("margin"))
    return P.candidate_block(rows).select("doc_id", F.md5("block").alias("digest"))


_DEFINITIONS = "- **Sleep**:' || chr(10) || '  - *Definition*: rest' || chr(10) || '  - *Includes*: naps' || chr(10) || '  - *Excludes*: beds' || chr(10) || chr(10) || '- **Nutrition**:' || chr(10) || '  - *Definition*: food' || chr(10) || '  - *Includes*: diets' || chr(10) || '  - *Excludes*: drugs"


@query(f"""WITH {_ITEMS}, l AS (SELECT doc_id, string_agg(CAST(r AS VARCHAR) || '. "' || text || '" (Local suggestion: ' || label || ')', chr(10) ORDER BY r) AS m FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end") AS r FROM gold) GROUP BY doc_id)
SELECT doc_id, md5('{_DEFINITIONS}' || chr(10) || 'Ex' || chr(10) || b.text || chr(10) || m) AS digest FROM l JOIN benchmark b ON b.item_id = doc_id""")
def t_mention_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.createDataFrame([(1, "Nutrition", "food", "diets", "drugs"), (0, "Sleep", "rest", "naps", "beds")], "place int, label string, definition string, includes string, excludes string")
    rows = P.mention_prompts(benchmark(spark, sf_dir), P.mention_list(item_mentions(spark, sf_dir)), P.definitions_block(told), "Ex", "{definitions}\n{examples}\n{text}\n{mentions}")
    return rows.select("doc_id", F.md5("prompt").alias("digest"))


@query(f"""WITH {_ITEMS}, n AS (SELECT doc_id, label, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, "end") AS INTEGER) AS number, ['NUT', 'SLE', 'SUB', 'ENV'][gold_id % 4 + 1] || '-' || lpad(CAST(gold_id % 50 AS VARCHAR), 4, '0') AS rule FROM gold),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule ORDER BY number) AS time FROM n),
d AS (SELECT doc_id, string_agg(rule, ',' ORDER BY number) AS ids FROM c WHERE doc_id % 2 = 1 OR time = 1 GROUP BY doc_id)
SELECT doc_id, number, CASE WHEN number % 3 = 1 THEN 'b' ELSE '' END AS part, CASE WHEN number % 3 = 2 THEN 'O' ELSE label END AS label, ids FROM n JOIN d USING (doc_id)""")
def t_numbered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer line for each mention by number, and the rule ids that the answer cites: a JSON list in odd documents, anywhere in the text in even ones."""
    i, r = F.col("gold_id"), F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end"))
    rule = F.concat(F.get(F.array(*(F.lit(x) for x in ("NUT", "SLE", "SUB", "ENV"))), (i % 4).cast("int")), F.lit("-"), F.lpad((i % 50).cast("string"), 4, "0"))
    numbered = item_mentions(spark, sf_dir).withColumns({"r": r, "rule": rule})
    line = F.when(F.col("r") % 3 == 0, F.concat("r", F.lit(". "), "label")).when(F.col("r") % 3 == 1, F.concat(F.lit(" "), "r", F.lit("b) it is "), F.lower("label"), F.lit(" as "), "text")).otherwise(F.concat("r", F.lit(": none")))
    told = numbered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("r", line.alias("line"), "rule"))).alias("x"))
    cited = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("see "), F.array_join("x.rule", " and "))).otherwise(F.concat(F.lit("```json\n"), F.to_json("x.rule"), F.lit("\n```")))
    rows = told.select("doc_id", F.concat(F.lit("Answers:\n"), F.array_join("x.line", "\n"), F.lit("\n"), cited).alias("raw"))
    ids = rows.select("doc_id", F.array_join(P.cited_ids(F.col("raw")), ",").alias("ids"))
    return P.numbered_lines(rows, [f"C{k}" for k in range(9)]).join(ids, "doc_id")


_WORDS = "w AS (SELECT item_id AS doc_id, text, regexp_extract(text, '([A-Za-z]{6,})', 1) AS word FROM benchmark)"


@query(f"""WITH {_WORDS}, p AS (SELECT doc_id, word, strpos(lower(text), lower(word)) - 1 AS s, text FROM w WHERE word <> '')
SELECT doc_id, upper(word) AS entity, CAST(CASE WHEN doc_id % 2 = 0 THEN s ELSE CASE WHEN strpos(lower(substr(text, s + 1 + length(word))), lower(word)) > 0 THEN s + length(word) + strpos(lower(substr(text, s + 1 + length(word))), lower(word)) - 1 END END AS INTEGER) AS start FROM p
WHERE doc_id % 2 = 0 OR strpos(lower(substr(text, s + 1 + length(word))), lower(word)) > 0""")
def t_located_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of a word written in capitals; in odd documents the first place is taken already."""
    docs = benchmark(spark, sf_dir)
    rows = docs.withColumn("word", F.regexp_extract("text", "([A-Za-z]{6,})", 1)).filter("word <> ''")
    taken = rows.filter("doc_id % 2 = 1").select("doc_id", F.expr("locate(lower(word), lower(text)) - 1").alias("start"), F.expr("locate(lower(word), lower(text)) - 1 + length(word)").alias("end"))
    return P.located(rows.select("doc_id", F.upper("word").alias("entity")), docs, taken).select("doc_id", "entity", "start")


@query(f"""WITH {_WORDS}, s AS (SELECT item_id AS doc_id, unnest(string_split(text, '. ')) AS sentence, generate_subscripts(string_split(text, '. '), 1) AS i FROM benchmark),
h AS (SELECT w.doc_id, word, arg_min(sentence, CASE WHEN list_contains(regexp_split_to_array(lower(sentence), '[^\\p{{L}}\\p{{N}}_]+'), lower(word)) THEN 0 ELSE 1000000 END + i) AS sentence FROM w JOIN s ON s.doc_id = w.doc_id AND contains(lower(sentence), lower(word)) WHERE word <> '' GROUP BY ALL)
SELECT doc_id, word AS token, 'FN' AS error_type, md5(sentence) AS digest FROM h""")
def t_error_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens from a Markdown table of errors and the sentence that holds each."""
    docs = benchmark(spark, sf_dir)
    rows = docs.withColumn("word", F.regexp_extract("text", "([A-Za-z]{6,})", 1)).filter("word <> ''")
    told = rows.select("doc_id", F.concat(F.lit("Errors:\n| Token | Type |\n|---|---|\n| "), "word", F.lit(" | FN |\n")).alias("raw"))
    sentences = docs.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("sent_id", "text"))
    return P.containing_sentence(P.error_table(told), sentences).select("doc_id", "token", "error_type", F.md5("sentence").alias("digest"))


@query(r"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z]{6,}')) AS words, text FROM documents), d AS (SELECT doc_id, text, unnest(words) AS word FROM w),
n AS (SELECT DISTINCT doc_id, text, lower(word) AS word FROM d WHERE (ascii(word) + length(word)) % 7 = 0),
f AS (SELECT doc_id, word, strpos(lower(text), word) - 1 AS s, text FROM n)
SELECT doc_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(s + length(word)) AS BIGINT) AS ends FROM f GROUP BY doc_id""")
def t_entities_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First places of many words of each document, in one scan a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), 0))).alias("word"))
    names = words.filter((F.ascii("word") + F.length("word")) % 7 == 0).select("doc_id", F.lower("word").alias("entity")).distinct()
    found = PL.occurrences(names, docs)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


@query(f"""WITH {MENTIONS_SQL}, m AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS number, start, "end", text, label FROM gold),
p AS (SELECT doc_id, number, 0 AS place, start, start + 4 AS "end", substr(text, 1, 4) AS text, 'Sleep' AS label, 'a' AS part FROM m WHERE number % 3 = 0 UNION ALL
  SELECT doc_id, number, 1, start + strpos(text, substr(text, 5)) - 1, start + strpos(text, substr(text, 5)) - 1 + length(text) - 4, substr(text, 5), 'Nutrition', 'b' FROM m WHERE number % 3 = 0 UNION ALL
  SELECT doc_id, number, 0, start, "end", text, CASE number % 2 WHEN 0 THEN 'Nutrition' ELSE 'O' END, '' FROM m WHERE number % 3 = 1 UNION ALL SELECT doc_id, number, 0, start, "end", text, 'O', '' FROM m WHERE number % 3 = 2)
SELECT doc_id, label, part, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum("end") AS BIGINT) AS ends, CAST(sum(length(text)) AS BIGINT) AS chars FROM p GROUP BY ALL""")
def t_parts_of_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered answers over each document's mentions: a third in two quoted parts, a third whole, a third without a line."""
    rows = mentions(T.tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))
    rows = rows.select("doc_id", number.alias("number"), "start", "end", "text")
    n = F.col("number")
    quoted = F.format_string("%da. \"%s\" is sleep\n%db: '%s' - nutrition", n, F.substring("text", 1, 4), n, F.expr("substring(text, 5)"))
    line = F.when(n % 3 == 0, quoted).when((n % 3 == 1) & (n % 2 == 0), F.format_string("%d. \"not there\" NUTRITION", n)).when(n % 3 == 1, F.format_string("%d none", n))
    raw = rows.filter(line.isNotNull()).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))), lambda x: x["line"]), "\n").alias("raw"))
    found = PL.resolved_parts(rows, raw, ["Sleep", "Nutrition"])
    return found.groupBy("doc_id", "label", "part").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH {MENTIONS_SQL}, a AS (SELECT doc_id, gold_id AS place, CASE WHEN gold_id % 2 = 0 THEN upper(text) ELSE 'the ' || text || ' itself' END AS name, label FROM gold WHERE gold_id % 5 < 3),
m AS (SELECT g.doc_id, g.gold_id, arg_min(a.label, a.place) AS answer FROM gold g JOIN a ON a.doc_id = g.doc_id AND contains(lower(a.name), lower(g.text)) GROUP BY ALL)
SELECT label, source, count(*) AS n FROM (SELECT coalesce(answer, 'P') AS label, CASE WHEN answer IS NULL THEN 'proposed' ELSE 'answer' END AS source FROM gold g LEFT JOIN m ON m.doc_id = g.doc_id AND m.gold_id = g.gold_id) GROUP BY ALL""")
def t_aligned_or_proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by equal text or a name that holds the span's, else what was proposed."""
    rows = mentions(T.tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
    i = F.col("gold_id")
    answers = rows.filter(i % 5 < 3).select("doc_id", i.alias("place"), F.when(i % 2 == 0, F.upper("text")).otherwise(F.concat(F.lit("the "), "text", F.lit(" itself"))).alias("entity"), F.col("label").alias("final_label"))
    found = PL.aligned_or_proposed(rows.select("doc_id", i.alias("span_id"), "text", F.lit("P").alias("proposed")), answers)
    return found.groupBy("label", "source").agg(F.count("*").alias("n"))


@query(f"""WITH {_ITEMS} SELECT doc_id, gold_id AS span_id, md5('D' || chr(10) || text || ' {{text}} ' || bt) AS digest FROM gold JOIN (SELECT item_id AS doc_id, text AS bt FROM benchmark) USING (doc_id)""".replace("{{", "{").replace("}}", "}"))
def t_single_mention_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each mention; what stands in braces inside a field stays."""
    told = spark.createDataFrame([("D",)], "definitions string")
    spans = item_mentions(spark, sf_dir).select("doc_id", F.col("gold_id").alias("span_id"), "start", "end", F.concat("text", F.lit(" {text}")).alias("text"))
    return P.single_mention_prompts(benchmark(spark, sf_dir), spans, told, "{definitions}\n{candidate} {text}").select("doc_id", "span_id", F.md5("prompt").alias("digest"))


@query(f"""WITH {_ITEMS} SELECT 'data/new/a' AS path, 'new' AS ontology UNION ALL SELECT 'data/legacy/a', 'legacy' UNION ALL SELECT 'data/relabeled_a', 'new'
UNION ALL SELECT 'data/a', CASE WHEN max(CASE WHEN label IN ('C7', 'C8') THEN 1 ELSE 0 END) = 1 THEN 'new' ELSE 'legacy' END FROM gold UNION ALL SELECT 'data/b', CASE WHEN max(CASE WHEN label = 'none' THEN 1 ELSE 0 END) = 1 THEN 'new' ELSE 'legacy' END FROM gold""")
def s_ontology_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ontology of a corpus by its path, else by the labels that its entities have."""
    entities = item_mentions(spark, sf_dir)
    paths = [("data/new/a", ["none"]), ("data/legacy/a", ["C7"]), ("data/relabeled_a", ["none"]), ("data/a", ["C7", "C8"]), ("data/b", ["none"])]
    return spark.createDataFrame([(path, A.ontology_of(path, entities, only)) for path, only in paths], "path string, ontology string")
