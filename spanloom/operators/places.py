"""Placing answers in texts: all names of a document sought in one scan by a dictionary automaton, and parts inside their mention."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.labels import normal_text


def folded(text: str) -> str:
    """Without case, character by character, so that offsets stay those of the text."""
    lower = text.lower()
    return lower if len(lower) == len(text) and "İ" not in text else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Automaton:
    """Finds all occurrences of many names in one pass over a text: a trie with links to the longest suffix that is a prefix of a name."""

    def __init__(self, names: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for i, name in enumerate(names):
            node = 0
            for c in name:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                node = self.next[node][c]
            self.ends[node] = i
        self.lengths = [len(x) for x in names]
        self.fail, self.out = [0] * len(self.next), [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                back = self.fail[node]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(c, 0) if node else 0
                queue.append(child)
            suffix = self.fail[node]
            self.out[node] = suffix if self.ends[suffix] >= 0 else self.out[suffix]

    def found(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(name, start, end) of every occurrence, in order of end."""
        node = 0
        for at, c in enumerate(text):
            while node and c not in self.next[node]:
                node = self.fail[node]
            node = self.next[node].get(c, 0)
            hit = node if self.ends[node] >= 0 else self.out[node]
            while hit:
                i = self.ends[hit]
                yield i, at + 1 - self.lengths[i], at + 1
                hit = self.out[hit]


def leftmost_longest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Occurrences that do not overlap: from the left, of those that start together the longest."""
    out, end = [], 0
    for x in sorted(found, key=lambda x: (x[1], -x[2])):
        if x[1] >= end:
            out.append(x)
            end = x[2]
    return out


def first_free(found: list[tuple[int, int, int]], taken: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Of each name the first occurrence that is no span already; occurrences of one name do not overlap each other."""
    done: set[int] = set()
    after: dict[int, int] = {}
    out = []
    for x in sorted(found, key=lambda x: (x[1], x[2])):
        if x[0] in done or x[1] < after.get(x[0], 0):
            continue
        after[x[0]] = x[2]
        if x[1:] not in taken:
            done.add(x[0])
            out.append(x)
    return out


def _scan(batches: Iterator[pa.RecordBatch], choice: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, names, starts, ends = [], [], [], []
        for doc, text, wanted, taken in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "names", "taken")), strict=True):
            keys: dict[str, list[str]] = {}
            for name in wanted:
                keys.setdefault(folded(name), []).append(name)
            listed = list(keys)
            found = list(Automaton(listed).found(folded(text or "")))
            chosen = first_free(found, {(x["start"], x["end"]) for x in taken or []}) if choice == "first" else leftmost_longest(found)
            for i, start, end in chosen:
                for name in keys[listed[i]]:
                    docs.append(doc)
                    names.append(name)
                    starts.append(start)
                    ends.append(end)
        yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field("doc_id").type), pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "entity", "start", "end"])


def occurrences(names: DataFrame, docs: DataFrame, taken: DataFrame | None = None, choice: str = "first") -> DataFrame:
    """(doc_id, entity, start, end) of the names (doc_id, entity) in their documents, without case.

    choice: ``first`` gives each name's first occurrence that is no span of
    ``taken`` (doc_id, start, end); ``all`` gives all occurrences that do not
    overlap, from the left and the longest first, so that a name inside another
    is not found there. A document is scanned once for all its names, in time
    linear in the text, the names and what is found. Names that are empty or
    not in the text are left out; a null text holds none.
    """
    wanted = names.filter("entity <> ''").groupBy("doc_id").agg(F.collect_set("entity").alias("names"))
    rows = wanted.join(docs.select("doc_id", "text"), "doc_id")
    if taken is None:
        rows = rows.withColumn("taken", F.array().cast("array<struct<start:int,end:int>>"))
    else:
        spans = taken.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("taken"))
        rows = rows.join(spans, "doc_id", "left")
    return rows.select("doc_id", "text", "names", "taken").mapInArrow(lambda batches: _scan(batches, choice), f"doc_id {dict(rows.dtypes)['doc_id']}, entity string, start int, end int")


def numbered_parts(answers: DataFrame) -> DataFrame:
    """(doc_id, number, part, place, quoted, rest) of answer lines such as ``2b. "part": label``: number, letter, and the first quoted text."""
    lines = answers.select("doc_id", F.posexplode(F.split("raw", "\n")).alias("place", "line")).withColumn("line", F.trim("line"))
    head = r"(?i)^(\d+)([a-z])?[.:\-]?\s*(.*)$"
    rest = F.regexp_extract("line", head, 3)
    quoted = F.regexp_extract(rest, "[\"']([^\"']+)[\"']", 1)
    return lines.filter(F.col("line").rlike(head)).select("doc_id", F.regexp_extract("line", head, 1).try_cast("int").alias("number"), F.lower(F.regexp_extract("line", head, 2)).alias("part"), "place", F.nullif(quoted, F.lit("")).alias("quoted"), rest.alias("rest"))


def named_label(line: Column, labels: list[str]) -> Column:
    """The first of ``labels`` that the line names, without case, else O."""
    return F.coalesce(*(F.when(F.contains(F.lower(line), F.lit(x.lower())), F.lit(x)) for x in labels), F.lit("O"))


def resolved_parts(mentions: DataFrame, answers: DataFrame, labels: list[str]) -> DataFrame:
    """(doc_id, number, place, start, end, text, label, part) of numbered mentions (doc_id, number, start, end, text) after their answers (doc_id, raw).

    A line that quotes a text inside its mention gives the first place of that
    text there; any other line gives the whole mention, so one mention may give
    several spans. A mention without a line is O. Where an answer has no numbered
    line at all, ``none of the above`` or ``o`` means O for all its mentions, and
    a label named anywhere in it is that of all.
    """
    parts = numbered_parts(answers)
    whole = answers.join(parts.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lower(F.trim("raw")).alias("said"))
    none = F.contains(F.col("said"), F.lit("none of the above")) | (F.col("said") == "o")
    whole = whole.select("doc_id", F.when(none, "O").otherwise(named_label(F.col("said"), labels)).alias("of_all"))
    rows = mentions.join(parts, ["doc_id", "number"], "left").join(whole, "doc_id", "left")
    at = F.expr("coalesce(locate(quoted, text), 0)")
    inside = at > 0
    start = F.when(inside, F.col("start") + at - 1).otherwise(F.col("start"))
    label = F.when(F.col("rest").isNotNull(), named_label(F.col("rest"), labels)).otherwise(F.coalesce("of_all", F.lit("O")))
    return rows.select("doc_id", "number", F.coalesce("place", F.lit(-1)).alias("place"), start.cast("int").alias("start"), F.when(inside, start + F.length("quoted")).otherwise(F.col("end")).cast("int").alias("end"), F.when(inside, F.col("quoted")).otherwise(F.col("text")).alias("text"), label.alias("label"), F.coalesce("part", F.lit("")).alias("part"))


def aligned_or_proposed(spans: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, span_id, label, source) of spans (doc_id, span_id, text, proposed): the first answer (doc_id, place, entity, final_label) whose name is the span's text or holds it, else the proposed label.

    Equal texts are found by an equi-join; names that only contain a span's
    text are sought among the answers of its document.
    """
    s = spans.select("doc_id", "span_id", "proposed", normal_text(F.col("text")).alias("norm"))
    a = answers.select("doc_id", "place", "final_label", normal_text(F.col("entity")).alias("name"))
    equal = s.join(a.withColumnRenamed("name", "norm"), ["doc_id", "norm"]).select("doc_id", "span_id", "place", "final_label")
    listed = a.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "name", "final_label"))).alias("names"))
    holds = s.filter("norm <> ''").join(listed, "doc_id").select("doc_id", "span_id", F.get(F.filter("names", lambda x: F.contains(x["name"], F.col("norm"))), F.lit(0)).alias("x")).filter("x is not null").select("doc_id", "span_id", "x.place", "x.final_label")
    first = equal.unionByName(holds).groupBy("doc_id", "span_id").agg(F.min_by("final_label", "place").alias("answer"))
    rows = s.join(first, ["doc_id", "span_id"], "left")
    return rows.select("doc_id", "span_id", F.coalesce("answer", "proposed", F.lit("O")).alias("label"), F.when(F.col("answer").isNotNull(), "answer").otherwise("proposed").alias("source"))
