"""Personal data by bootstrapped contextual extraction.

Plain rules give the seed entities. Their neighbouring words are lexical
patterns; a graph of patterns and instances is scored in rounds on Spark, and
patterns that prove reliable take further identifiers which the rules miss:
tokens and number runs of any form that could be of the pattern's kind. Beside
the four kinds of the rules there are secrets (keys, tokens), whose seeds are
long mixed strings that a text assigns to something.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, Scratch, apart, bounded, cut, per_batch, table, with_row_key

KINDS = ("email", "ip", "card", "phone")
#: All kinds, in the order of spans that start together.
ALL_KINDS = (*KINDS, "secret")
#: Rounds of scoring; least distinct seed instances and least score of a reliable pattern; least confidence of an instance.
ROUNDS, SUPPORT, RELIABLE, CONFIDENT = 3, 5, 0.8, 0.75
#: Least score in the query and the pipeline: most instances of a pattern are of the kind; below a score of 0.75 only several
#: patterns together make an instance confident.
MAJORITY = 0.5
#: Characters on either side of a span in which its neighbouring words are sought.
CONTEXT_CHARS = 80

#: The rules of the seed entities.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A long string that is assigned to something: the seeds of secrets, if letters and digits mix in it.
_ASSIGNED = re.compile(r"[=:][ \t]?[\"']?([A-Za-z0-9+/_-]{32,}+)")
#: Shapes of identifiers of several words: spelt-out or split addresses, and numbers in groups.
_EMAIL_LIKE = re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+ ?(?:\[at\]|\(at\)|@) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++")
_NUMBER_LIKE = re.compile(r"(?<![\w+.-])(?:\([0-9]++\) ?)?[0-9]++(?:[ .()-]{1,2}[0-9]++)++")
#: A token with a digit; its quotes and brackets are stripped.
_TOKEN = re.compile(r"[^\s\"'<>()\[\]{},;=«»]++")
_EDGES = ".,;:!?\"'()[]{}<>=«»"
_HEX_GROUPS = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost e-mail addresses: from each @ back over the local part, then on over the domain; linear in the text."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the rules, by start and then kind."""
    found = [("email", *span) for span in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(y) <= 3 and int(y or "0") <= 255 for y in (x.lstrip("0") for x in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def secrets(text: str) -> list[tuple[int, int]]:
    """Seeds of secrets: long strings of letters and digits that follow an equals sign or colon."""
    return [m.span(1) for m in _ASSIGNED.finditer(text) if _mixed(m[1])]


def _mixed(token: str) -> bool:
    return any("0" <= c <= "9" for c in token) and any(c.isalpha() for c in token)


def instance(value: str) -> str:
    """The key under which forms of one identifier meet."""
    plain = re.sub(r" ?(?:\[at\]|\(at\)) ?", "@", value)
    if "@" in plain:
        return re.sub(r" ?(?:\[dot\]|\(dot\)) ?", ".", plain).replace(" ", "").lower()
    return value if any(c.isalpha() for c in value) or value.count(".") == 3 else _digits(value)


def kinds_of(value: str) -> list[str]:
    """The kinds that a candidate could be of, by its characters."""
    digits = len(_digits(value))
    found = ["email"] if "@" in value or "(at)" in value or "[at]" in value else []
    if not any(c.isalpha() for c in value):
        found += ["ip"] if len(re.findall("[0-9]+", value)) == 4 and digits <= 12 else []
        found += ["card"] if 12 <= digits <= 19 else []
        found += ["phone"] if 7 <= digits <= 15 else []
    elif not found:
        found += ["ip"] if _HEX_GROUPS.fullmatch(value) else []
        found += ["secret"] if len(value) >= 8 and digits else []
    return found


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before it, one on either side, two after it."""
    before = [w for x in text[max(0, start - CONTEXT_CHARS) : start].rstrip("\"'([{<« ").lower().split()[-2:] if (w := x.strip(".,;:!?\"'()[]{}<>«»"))]
    after = [w for x in text[end : end + CONTEXT_CHARS].lstrip("\"')]}>» ").lower().split()[:2] if (w := x.strip(_EDGES))]
    found = []
    if len(before) == 2:
        found.append(f"{before[0]} {before[1]} _")
    if before and after:
        found.append(f"{before[-1]} _ {after[0]}")
    if len(after) == 2:
        found.append(f"_ {after[0]} {after[1]}")
    return found


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[list[str], int, int]]:
    """(kinds, start, end) of what could be an identifier and overlaps nothing the rules matched, kept or dropped, nor another candidate; linear in the text."""
    tried = [(s, e) for _, s, e in base] + [m.span() for rule in (_IP, _PHONE) for m in rule.finditer(text)]
    tried += [m.span() for m in _CARD.finditer(text) if len(_digits(m[0])) >= 12]
    found = [m.span() for m in _EMAIL_LIKE.finditer(text)] if "@" in text or "(at)" in text or "[at]" in text else []
    found += [m.span() for m in _NUMBER_LIKE.finditer(text) if not (text[m.end() : m.end() + 1].isalnum() or text[m.end() : m.end() + 1] in ("_", "-"))]
    for m in _TOKEN.finditer(text):
        token = m[0].strip(_EDGES)
        if len(token) >= 5 and not token.isalpha() and (_digits(token) or "@" in token):
            at = m.start() + m[0].index(token)
            found.append((at, at + len(token)))
    out: list[tuple[list[str], int, int]] = []
    taken = _merged(tried)
    ends = [e for _, e in taken]
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        i = bisect_left(ends, s + 1)
        if (i == len(taken) or taken[i][0] >= e) and (not out or out[-1][2] <= s) and (kinds := kinds_of(text[s:e])):
            out.append((kinds, s, e))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as disjoint runs in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SEEN = pa.struct([("kinds", pa.list_(pa.string())), ("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
_SCANNED = "doc_id long, base array<struct<kind:string,start:long,end:long>>, seen array<struct<kinds:array<string>,start:long,end:long,seed:boolean,value:string,patterns:array<string>>>"


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    spans, seen = [], []
    for text in batch.column(1).to_pylist():
        text = text or ""
        base = base_spans(text)
        spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
        seeds = [*base, *(("secret", *x) for x in secrets(text))]
        met = [([k], s, e, True) for k, s, e in seeds] + [(*x, False) for x in candidates(text, seeds)]
        seen.append([{"kinds": k, "start": s, "end": e, "seed": seed, "value": instance(text[s:e]), "patterns": patterns(text, s, e)} for k, s, e, seed in met])
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN))], names=["doc_id", "base", "seen"])


def reliable(edges: DataFrame, seeds: DataFrame, allowed: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, least: float = RELIABLE) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, score) and (value, kind, confidence) after ``rounds``.

    edges (pattern, value), seeds and allowed (value, kind). A pattern's score
    for a kind is the mean confidence of its distinct values; a value that is no
    seed and may be of the kind has one minus the product of its patterns'
    doubts. Both are sums over distinct edges, so a common pattern or value is
    combined before it is shuffled.
    """
    edges = cut(edges.select("pattern", "value").distinct())
    degree = edges.groupBy("pattern").agg(F.count("*").alias("degree"))
    seeds = cut(seeds.select("value", "kind", F.lit(1.0).alias("confidence")).distinct())
    allowed = cut(allowed.select("value", "kind").distinct().join(seeds.select("value"), "value", "left_anti"))
    confidence = seeds
    for _ in range(rounds):
        sums = edges.join(confidence, "value").groupBy("pattern", "kind").agg(F.sum("confidence").alias("total"), F.count("*").alias("n"))
        scored = cut(sums.filter(F.col("n") >= support).join(degree, "pattern").select("pattern", "kind", (F.col("total") / F.col("degree")).alias("score")).filter(F.col("score") >= least))
        doubt = F.exp(F.sum(F.log(1 - 0.99 * F.col("score"))))
        new = edges.join(scored, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("confidence")).join(allowed, ["value", "kind"], "left_semi")
        confidence = cut(seeds.unionByName(new))
    return scored, confidence


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confident: float = CONFIDENT, **scoring) -> DataFrame:
    """Each row's doc_id, base and spans (kind, start, end): what the rules find, and that with what the patterns add; and secrets (start, end).

    Secrets' seeds and what the patterns add to them are no kind of personal
    data and have a column of their own.

    Offsets are code points, ends exclusive, ordered by start and then kind. A
    candidate of several sure kinds gets the likeliest, of equal ones the first.
    Null and empty texts have no spans; repeated rows and null ids keep their
    rows. An empty table gives an empty result. Texts are scanned whole, in time
    linear in their length; a neighbouring word counts with the characters of
    it that lie within CONTEXT_CHARS of the span.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        scanned = scratch.save(rows.mapInArrow(per_batch(_scan), _SCANNED).withColumn("row", F.monotonically_increasing_id()), "scanned")
        seen = scanned.filter("size(seen) > 0").select("row", F.explode("seen").alias("x")).select("row", "x.*")
        edges = seen.select(F.explode("patterns").alias("pattern"), "value")
        kinds = seen.select("seed", "value", F.explode("kinds").alias("kind"))
        scores, confidence = reliable(edges, kinds.filter("seed"), kinds.filter("not seed"), **scoring)
        sure = confidence.filter(F.col("confidence") >= confident)
        order = F.create_map(*(F.lit(x) for i, k in enumerate(ALL_KINDS) for x in (k, i)))
        likeliest = F.max_by("kind", F.struct("confidence", -order[F.col("kind")]))
        # Only places with a reliable pattern: a value is not an identifier wherever it stands.
        sure_places = seen.filter("not seed").select("row", "start", "end", "value", "kinds", F.explode("patterns").alias("pattern")).join(scores.select("pattern", "kind"), "pattern")
        sure_places = sure_places.filter(F.array_contains("kinds", F.col("kind"))).select("row", "start", "end", "value", "kind").distinct()
        found = sure_places.join(sure, ["value", "kind"]).groupBy("row", "start", "end").agg(likeliest.alias("kind"))
        found = found.unionByName(seen.filter("seed and kinds[0] = 'secret'").select("row", "start", "end", F.lit("secret").alias("kind")))
        personal = F.when(F.col("kind") != "secret", F.struct("kind", "start", "end"))
        secret = F.when(F.col("kind") == "secret", F.struct("start", "end"))
        added = found.groupBy("row").agg(F.collect_set(personal).alias("added"), F.array_sort(F.collect_set(secret)).alias("secrets"))
        both = F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:long,end:long>>")))
        keyed = F.array_sort(F.transform(both, lambda s: F.struct(s.start.alias("start"), order[s.kind].alias("rank"), s.end.alias("end"), s.kind.alias("kind"))))
        spans = F.transform(keyed, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
        return cut(scanned.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", spans.alias("spans"), F.coalesce("secrets", F.array().cast("array<struct<start:long,end:long>>")).alias("secrets")))


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _of(kind: str):
    return lambda span: span.kind == kind


def op8_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), least=MAJORITY)
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("secrets").cast("long").alias("n_secret"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first, drawn out to cover all."""
    out, at, end = [], 0, 0
    for kind, s, e in spans:
        if s >= end:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = end = max(end, e)
    return "".join([*out, text[at:]])


def _redact(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [t if t is None or not s else redact(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True)]
    names = [x for x in batch.schema.names if x != "_spans"]
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if x == "text" else batch.column(x) for x in names], names=names)


@apart
def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its personal data and secrets replaced; n_chars follows the new text.

    Spans go to rows by id and text, so null or shared ids are safe. Null and
    empty texts stay as they are, repeated rows stay repeated, an empty table
    stays empty; all columns are kept.
    """
    bounded(spark)
    rows = with_row_key(docs)
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(ALL_KINDS) for x in (k, i)))
    listed = lambda column, kind: F.transform(column, lambda x: F.struct(x.start.alias("start"), rank[kind(x)].alias("rank"), x.end.alias("end"), kind(x).alias("kind")))
    spans = F.array_sort(F.concat(listed("spans", lambda x: x.kind), listed("secrets", lambda _: F.lit("secret"))))
    found = find(rows, id_col=ROW_KEY, least=MAJORITY).select(F.col("doc_id").alias(ROW_KEY), spans.alias("_spans")).filter("size(_spans) > 0").groupBy(ROW_KEY).agg(F.first("_spans").alias("_spans"))
    joined = rows.join(found, ROW_KEY, "left").select(*docs.columns, "_spans")
    done = joined.mapInArrow(per_batch(_redact), docs.schema)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else done


QUERIES = {"op8_bootstrapped_pii": op8_bootstrapped_pii}
ORACLE: dict[str, str] = {}
