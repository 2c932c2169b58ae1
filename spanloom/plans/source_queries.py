"""Round trips through the line formats, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import text as T
from spanloom.sources import annotations as A
from spanloom.sources import sinks as K

from .curate_queries import rules
from .derived import table
from .text_queries import _WINDOWS, MENTION, MENTIONS_SQL, mentions, token_rows
from .text_queries import _windows as windows

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f'WITH {MENTIONS_SQL} SELECT doc_id, label, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum("end") AS BIGINT) AS ends FROM gold GROUP BY ALL')
def s_standoff_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = K.standoff_lines(mentions(token_rows(spark, sf_dir, MENTION)))
    return A.spans(A.standoff(lines)).groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


@query("""SELECT user_id AS doc_id, count(*) FILTER (event_id % 4 <> 3) AS entities, count(*) FILTER (event_id % 4 = 3) AS bad, CAST(coalesce(sum(CASE WHEN event_id % 4 <> 3 THEN event_id % 50 + 20 - event_id % 50 END), 0) AS BIGINT) AS hull,
CAST(coalesce(sum(CASE WHEN event_id % 4 <> 3 THEN 9 END), 0) AS BIGINT) AS last FROM events GROUP BY user_id""")
def s_discontinuous_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fragments to an entity, every fourth line faulty: hull and last fragment of those that can be read."""
    i, at = F.col("event_id"), F.col("event_id") % 50
    good = F.format_string("T%d\tC1 %d %d;%d %d\tx", i, at, at + 5, at + 11, at + 20)
    lines = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.when(i % 4 == 3, F.format_string("T%d\tC1 none", i)).otherwise(good).alias("line"))
    entities = A.standoff(lines)
    size = F.element_at("fragments", -1)["end"] - F.element_at("fragments", 1)["start"]
    last = F.element_at("fragments", -1)["end"] - F.element_at("fragments", -1)["start"]
    return entities.groupBy("doc_id").agg(F.count_if(~F.col("bad")).alias("entities"), F.count_if("bad").alias("bad"), F.coalesce(F.sum(F.when(~F.col("bad"), size)), F.lit(0)).alias("hull"), F.coalesce(F.sum(F.when(~F.col("bad"), last)), F.lit(0)).alias("last"))


@query(f"""WITH {MENTIONS_SQL}, x AS (SELECT doc_id, sent_id, count(*) AS n FROM tok GROUP BY ALL), m AS (SELECT doc_id, count(*) AS tagged FROM gold GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS sentences, any_value(coalesce(tagged, 0)) AS tagged FROM x LEFT JOIN m USING (doc_id) GROUP BY doc_id""")
def s_column_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = T.line_texts(docs, mentions(T.tokens(docs, like=MENTION)).withColumnRenamed("gold_id", "span_id"), parted=True)
    read = A.column_texts(files, separator="\t", width=4)
    return read.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.countDistinct("sent_id").alias("sentences"), F.count_if(F.col("cells")[0] != "O").alias("tagged"))


@query(f"""WITH {MENTIONS_SQL}, {_WINDOWS}, kept AS (SELECT * FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.doc_id = a.doc_id AND b.span_id <> a.span_id AND a.start < b."end" AND b.start < a."end" AND a."end" - a.start <= b."end" - b.start)),
x AS (SELECT tok.*, k.label FROM tok LEFT JOIN (SELECT kept.*, gold.label FROM kept JOIN gold ON gold.doc_id = kept.doc_id AND gold.gold_id = kept.span_id) k ON k.doc_id = tok.doc_id AND tok.start < k."end" AND k.start < tok."end"),
y AS (SELECT *, lag(label) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS before FROM x), t AS (SELECT *, CASE WHEN label IS NULL THEN 'O' WHEN label IS NOT DISTINCT FROM before THEN 'I-' || label ELSE 'B-' || label END AS tag FROM y)
SELECT doc_id, md5(string_agg(tag || chr(9) || start || chr(9) || "end" || chr(9) || token, chr(10) ORDER BY pos)) AS digest FROM t GROUP BY doc_id""")
def s_corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and overlapping spans as column lines, one digest for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = windows(mentions(token_rows(spark, sf_dir, MENTION)), "label")
    return K.corpus_texts(docs, spans).select("doc_id", F.md5("text").alias("digest"))


@query("""WITH r AS (SELECT item_id, ['NUT', 'SLE', 'SUB', 'ENV'][item_id % 4 + 1] || '-' || lpad(CAST(item_id // 4 AS VARCHAR), 4, '0') AS b, ['Nutrition', 'Sleep', 'Substance_use', 'Environmental_exposures'][item_id % 4 + 1] AS section, text FROM benchmark)
SELECT section, b AS bullet_id, '- [' || b || '] ' || text || ' (helpful 0, harmful 0)' AS line FROM r UNION ALL SELECT DISTINCT section, '', '## ' || section FROM r""")
def k_rules_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rules_markdown(rules(spark, sf_dir))


@query("SELECT user_id AS run_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def k_index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "event_type")
    return K.upserted(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"))


@query(f"WITH {MENTIONS_SQL} SELECT doc_id || '_gt_' || (row_number() OVER (PARTITION BY doc_id ORDER BY start, \"end\") - 1) AS id, label, text FROM gold")
def k_vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.vector_table(mentions(token_rows(spark, sf_dir, MENTION)), "gt").select("id", "label", "text")
