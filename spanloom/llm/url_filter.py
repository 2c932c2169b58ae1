"""URL filters: allow and block rules, and naive Bayes over segmented names for the rest.

Unigram Viterbi splits concatenated host and path names into words, with word
counts from the pages themselves; multinomial naive Bayes scores the words.
Pages whose words include a seed word are the block class it learns from.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut, join_hot, per_batch, table, utf8

#: (rule, verdict): a host and a path prefix.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Words that mark unwanted sites.
SEEDS = frozenset("adult porn xxx sex nude escort casino casinos poker bet bets betting gambling jackpot slots pill pills viagra cialis pharmacy spam malware phishing warez torrent crack keygen ads adserver popunder tracker track loan loans replica hacked".split())
#: Longest word of a segmentation; a seed word counts as seen this often.
LONGEST, SEED_COUNT = 20, 50
_WORDS = re.compile(rb"[a-z]+")


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host (ASCII lower case) and path of each row."""
    url = F.coalesce(pages[url_col], F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return pages.select(pages[id_col].cast("long").alias("page_id"), lower.alias("host"), path.alias("path"))


def rule_of(host, path, rules: list[tuple[str, str]]) -> F.Column:
    """The longest rule that fits, or null: its host is the url's or a parent domain, and its path a prefix."""
    chosen = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda x: len(x[0])):
        domain, slash, prefix = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def visible(html: bytes) -> bytes:
    """Lower-case text between tags, without scripts and styles; linear in the page. What is never closed hides the rest."""
    html, out, at = html.lower(), [], 0
    while (tag := html.find(b"<", at)) >= 0:
        out.append(html[at:tag])
        close = next((b"</" + x for x in (b"script", b"style") if html.startswith(x, tag + 1)), b"")
        end = html.find(close, tag) if close else tag
        end = html.find(b">", end) if end >= 0 else -1
        if end < 0:
            return b" ".join(out)
        at = end + 1
    return b" ".join([*out, html[at:]])


def _count_words(batches, longest: int):
    counts: Counter = Counter()
    for batch in batches:
        for html in utf8(batch.column(0)):
            counts.update(w for w in _WORDS.findall(visible(html)) if len(w) <= longest)
        if len(counts) > 300_000:
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def viterbi(name: str, counts: dict[str, int], total: int, longest: int = LONGEST) -> list[str]:
    """The likeliest split of ``name``: known words by their share, an unknown one 10 / (total * 10**length)."""
    base = math.log10(max(total, 1))
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            word = name[start:end]
            n = counts.get(word)
            options.append((best[start] + (math.log10(n) - base if n else 1 - base - len(word)), -start))
        value, start = max(options)
        best.append(value)
        back.append(-start)
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def _segment(batch: pa.RecordBatch, total: int, longest: int) -> pa.RecordBatch:
    split = [viterbi(name, dict(zip(known or [], n or [], strict=True)), total, longest) for name, known, n in zip(*(batch.column(x).to_pylist() for x in ("name", "known", "n")), strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("name"), pa.array(split, pa.list_(pa.string()))], names=["name", "words"])


def segmented(names: DataFrame, counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(name, words) for distinct ``names``: each one's parts are joined to the word counts, then split by Viterbi."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    starts = F.sequence(F.lit(1), F.length("name"))
    parts = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("name") - i + 1)), lambda n: F.substring(F.col("name"), i, n)))))
    found = names.select("name", F.explode(parts).alias("word"))
    found = join_hot(found, counts, "word").groupBy("name").agg(F.collect_list("word").alias("known"), F.collect_list("n").alias("n"))
    return names.join(found, "name", "left").mapInArrow(per_batch(_segment, total, longest), "name string, words array<string>")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seeds: frozenset[str] = SEEDS, longest: int = LONGEST) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row.

    score: the log-odds of block against allow by naive Bayes; it decides where
    no rule fits. Names are the runs of letters in host and path. Null urls and
    urls without ``://`` have empty host and path, no names, and are allowed;
    repeated rows and null ids are kept, equal rules' lengths can't tie on one
    url, other columns are ignored, an empty table gives an empty result. Pages
    of any length are read in linear time. Without a page of the block class
    every score is 0 or below.
    """
    spark = pages.sparkSession
    with Scratch(spark) as scratch:
        counts = pages.select(pages[html_col]).mapInArrow(lambda batches: _count_words(batches, longest), "word string, n long")
        known = spark.createDataFrame([(w, SEED_COUNT) for w in sorted(seeds)], "word string, n long")
        counts = scratch.save(counts.unionByName(known).groupBy("word").agg(F.sum("n").alias("n")), "words")
        rows = scratch.save(parsed(pages, id_col, url_col).withColumn("row", F.monotonically_increasing_id()), "rows")
        names = F.filter(F.split(F.lower(F.concat_ws("/", "host", "path")), "[^a-z]+"), lambda x: x != "")
        tokens = scratch.save(rows.select("row", F.explode(names).alias("name")).groupBy("row", "name").agg(F.count("*").alias("n")), "named")
        split = scratch.save(segmented(tokens.select("name").distinct(), counts, longest), "names")
        split = split.withColumn("seed", F.exists("words", lambda w: w.isin(sorted(seeds))))
        tokens = scratch.save(join_hot(tokens, split.select("name", "seed"), "name"), "tokens")
        classes = tokens.groupBy("row").agg(F.max("seed").alias("block"))
        by_name = tokens.join(classes, "row").groupBy("name").agg(F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("block"), 0).otherwise(F.col("n"))).alias("a"))
        by_word = scratch.save(by_name.join(split, "name").select(F.explode("words").alias("word"), "b", "a").groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "classes")
        size, b_total, a_total = by_word.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
        n_rows, n_block = rows.count(), classes.filter("block").count()
        prior = math.log((n_block + 1) / (n_rows - n_block + 1))
        odds = F.log((F.col("b") + 1) / F.lit(float(b_total + size))) - F.log((F.col("a") + 1) / F.lit(float(a_total + size))) if size else F.lit(0.0)
        by_name = split.select("name", F.explode("words").alias("word")).join(by_word.select("word", odds.alias("odds")), "word").groupBy("name").agg(F.sum("odds").alias("odds"))
        scores = join_hot(tokens, by_name, "name").groupBy("row").agg(F.sum(F.col("n") * F.col("odds")).alias("score"))
        rule = rule_of(F.col("host"), F.col("path"), rules)
        judged = rows.join(scores, "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0)) + prior).withColumn("rule", rule)
        verdicts = F.create_map(*(F.lit(x) for pair in rules for x in pair)) if rules else F.create_map().cast("map<string,string>")
        verdict = F.coalesce(verdicts[F.col("rule")], F.when(F.col("score") > 0, "block").otherwise("allow"))
        return cut(judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op1_url_filters": op1_url_filters}
ORACLE: dict[str, str] = {}
