"""Tokens, tags and places made in the document's own row; agreement without pairs; siblings as an option."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from against_sql import differences
from spanloom.operators import match as M
from spanloom.operators import prompts as P
from spanloom.operators import rules as R
from spanloom.operators import text as T
from spanloom.operators.folds import _AT_ONCE, whole_documents
from spanloom.plans.registry import ORACLE, QUERIES
from spanloom.sources import annotations as A
from spanloom.sources import sinks as K

SMALL = "/root/testdata/sf0.001"

_PIECE = re.compile("[0-9a-zA-Z]+|\n|[^0-9a-zA-Z \t\n\x0b\f\r]")


def _one_by_one(text):
    n, at = 0, 0
    for m in _PIECE.finditer(text or ""):
        if m[0] == "\n":
            at += 1
            continue
        yield n, *m.span(), m[0], at
        n += 1
        if m[0] in ".!?" and text[m.end() : m.end() + 1] in " \t\n\x0b\f\r":
            at += 1


def test_cut_against_one_by_one():
    random.seed(1)
    for _ in range(100):
        texts = [None if random.random() < 0.1 else "".join(random.choice("ab1Z .!?\n\té漢😀\x0b-") for _ in range(random.choice([0, 1, 5, 40]))) for _ in range(6)]
        c = T.cut(pa.array(["x", *texts], pa.string()).slice(1))
        got = list(zip(c.doc.tolist(), c.pos.tolist(), c.start.tolist(), c.end.tolist(), c.token.to_pylist(), c.sent_id.tolist(), strict=True))
        assert got == [(i, *x) for i, t in enumerate(texts) for x in _one_by_one(t)]


def _docs(spark, n=40):
    random.seed(2)
    rows = [(i, "".join(random.choice("abc é. \n!x") for _ in range(random.choice([0, 3, 60])))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None)], "doc_id long, text string")


def test_tokens_like_a_pattern_and_tags_in_the_text_s_row(spark):
    docs = _docs(spark)
    rows = T.tokens(docs)
    assert sorted(T.tokens(docs, like="^[a-c]{2,}$").collect()) == sorted(rows.filter(F.col("token").rlike("^[a-c]{2,}$")).collect())
    random.seed(3)
    made = [(d, i, s, s + random.choice([0, 1, 2, 5, 9]), random.choice(["A", "B", None])) for d in range(41) for i, s in enumerate(random.sample(range(-1, 60), 8))]
    spans = spark.createDataFrame(made, "doc_id long, span_id long, start int, end int, label string")
    told = T.spans_to_tags(rows, spans)
    got = T.tagged_texts(docs, spans)
    assert sorted(got.select(told.columns).collect()) == sorted(told.collect())
    assert [f.dataType for f in got.schema] == [f.dataType for f in told.select(got.columns).schema]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and plan.count("MapInArrow") == 1  # no token is shuffled
    spread = lambda x: sorted((r["doc_id"], r["start"], r["end"], r["label"]) for r in x.collect())
    assert spread(T.tags_to_spans(told, 1, dense=True)) == spread(T.tags_to_spans(told, 1))


def test_whole_documents():
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i // 70_000] * 1_000, "n": list(range(i, i + 1_000))}) for i in range(0, 500_000, 1_000)]
    parts = list(whole_documents(iter(batches)))
    assert len(parts) > 1 and min(p.num_rows for p in parts[:-1]) <= _AT_ONCE + 70_000
    assert [x for p in parts for x in p.column("n").to_pylist()] == list(range(500_000))
    assert len({d for p in parts for d in set(p.column("doc_id").to_pylist())}) == sum(len(set(p.column("doc_id").to_pylist())) for p in parts)


def test_agreement_of_any_mode_against_all_pairs_and_without_pairs(spark):
    random.seed(4)
    kind = "doc_id long, {} long, start int, end int, label string, text string"
    span = lambda i: (random.randrange(4), i, s := random.choice([None, *range(12)]), (s or 0) + random.randrange(5), random.choice(["A", "B", None]), "")
    g, t = [span(i) for i in range(60)], [span(i) for i in range(60)]
    gold, test = spark.createDataFrame(g, kind.format("gold_id")), spark.createDataFrame(t, kind.format("pred_id"))
    rules = {"exact": lambda p, q: p[2:4] == q[2:4], "left": lambda p, q: p[2] == q[2], "right": lambda p, q: p[3] == q[3], "overlap": lambda p, q: p[2] < q[3] and q[2] < p[3]}
    needs = {"exact": (2, 3), "left": (2,), "right": (3,), "overlap": (2, 3)}
    for mode, rule in rules.items():
        for loose in (False, True):
            fits = lambda p, q: p[0] == q[0] and None not in [x[i] for x in (p, q) for i in needs[mode]] and rule(p, q) and (loose or p[4] == q[4] is not None)  # noqa: B023, E731
            found = M.agreement(gold, test, mode, loose)
            want = sorted((d, sum(x[0] == d for x in g), sum(x[0] == d and any(fits(x, y) for y in t) for x in g), sum(x[0] == d for x in t), sum(x[0] == d and any(fits(x, y) for y in g) for x in t)) for d in range(4))
            assert sorted(tuple(r)[:5] for r in found.collect()) == want, (mode, loose)
            assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_counted_as_their_operator_cuts_them(spark):
    random.seed(5)
    tags = ["O", "B-A", "I-A", "B-B", "I-B", "odd", "B-"]
    rows = spark.createDataFrame([(d, p, "t", random.choice(tags), random.choice(tags)) for d in range(30) for p in range(random.randrange(25))], "doc_id long, pos int, token string, gold_tag string, pred_tag string")
    for mode in ("exact", "overlap"):
        side = lambda c: [tuple(r) for r in T.chunks(rows.select("doc_id", "pos", F.col(c).alias("tag")), orphans=mode == "exact").select("doc_id", "first", "last", "label").collect()]  # noqa: B023, E731
        g, p = side("gold_tag"), side("pred_tag")
        fits = lambda a, b: a[0] == b[0] and a[3] == b[3] and (a == b if mode == "exact" else a[1] <= b[2] and b[1] <= a[2])  # noqa: B023, E731
        want = {k: (sum(x[3] == k for x in g), sum(x[3] == k for x in p), sum(x[3] == k and any(fits(x, y) for y in p) for x in g), sum(x[3] == k and any(fits(x, y) for y in g) for x in p)) for k in {x[3] for x in g + p}}
        found = M.chunk_scores(rows, mode)
        assert {r["label"]: tuple(r)[1:5] for r in found.collect() if r["label"] is not None} == want
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_additions_without_siblings(spark):
    added = spark.createDataFrame([(1, "S", [1.0, 0.0]), (2, "S", [1.0, 0.01]), (3, "S", [0.0, 1.0])], "seq long, section string, v array<double>")
    rules = spark.createDataFrame([(9, "S", [0.0, 2.0])], "rule_no long, section string, v array<double>")
    told = lambda siblings: [sorted(r["seq"] for r in x.collect()) for x in R.near_duplicates(added, rules, siblings=siblings)]
    assert told(True) == [[1], [2, 3]]
    assert told(False) == [[1, 2], [3]]


def test_tokens_beside_their_text_are_placed_without_a_shuffle(spark):
    docs = _docs(spark)
    random.seed(6)
    tagged = spark.createDataFrame([(d, p, random.choice(["ab", "c", "é.", "x", " ", None, "a b"]), "O") for d in range(41) for p in range(random.randrange(6))], "doc_id long, pos int, token string, tag string")
    told = T.placed(tagged, docs)
    beside = docs.join(tagged.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "token", "tag")).alias("said")), "doc_id", "left")
    got = T.placed_beside(beside)
    assert sorted(map(str, got.collect())) == sorted(map(str, told.collect())) and got.schema == told.schema


def test_foreign_tokens_stay_in_their_row(spark):
    found = QUERIES["t_foreign_tokens"](spark, SMALL)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "collect_list" not in plan
    assert differences(spark, QUERIES["t_foreign_tokens"], ORACLE["t_foreign_tokens"], SMALL) == []


def _marks(spark):
    random.seed(7)
    rows = [(d, i, s, s + random.choice([1, 2, 5, 9]), random.choice(["A", "B"])) for d in range(41) for i, s in enumerate(random.sample(range(60), 6))]
    return spark.createDataFrame(rows, "doc_id long, span_id long, start int, end int, label string")


def test_lines_of_a_corpus_are_those_of_its_rows_and_no_token_is_shuffled(spark):
    docs, spans = _docs(spark), _marks(spark)
    for offsets in (True, False):
        rows = sorted(tuple(r) for r in K.column_lines(T.spans_to_tags(T.tokens(docs), T.eliminate_overlaps(spans)), offsets).select("doc_id", "pos", "sent_id", "line").collect())
        assert rows == sorted(tuple(r) for r in K.corpus_lines(docs, spans, offsets).select("doc_id", "pos", "sent_id", "line").collect())
        for parted in (False, True):
            want = {}
            for d, _, sent, line in rows:
                last, text = want.get(d, (sent, None))
                want[d] = sent, line if text is None else text + ("\n\n" if parted and sent != last else "\n") + line
            found = K.corpus_texts(docs, spans, offsets, parted)
            assert {r["doc_id"]: r["text"] for r in found.collect()} == {d: t for d, (_, t) in want.items()}
    plan = QUERIES["s_corpus_lines"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan  # tokens were dealt out by document before
    assert differences(spark, QUERIES["s_corpus_lines"], ORACLE["s_corpus_lines"], SMALL) == []


def test_column_files_are_read_as_their_lines_are(spark):
    random.seed(8)
    texts = [(d, "\n".join(random.choice(["", " ", "a b", " a  b ", "x", "-DOCSTART-", "\t", "é\ty z", " -DOCSTART- "]) for _ in range(random.randrange(9)))) for d in range(40)]
    docs = spark.createDataFrame([*texts, (40, None)], "doc_id long, text string")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    for more in ({}, {"separator": "\t", "width": 1}, {"boundary": "-DOCSTART-"}, {"boundary": "-DOCSTART-", "separator": " ", "width": 2}):
        told, got = A.columns(lines, **more), A.column_texts(docs, **more)
        want = [(*r[:1], r["sent_id"], *r[2:]) for r in told.collect()]
        assert sorted(want) == sorted(tuple(r) for r in got.collect()) and len(want) > 50


def test_column_round_trip_shuffles_no_token(spark):
    plan = QUERIES["s_column_round_trip"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Window" not in plan
    assert differences(spark, QUERIES["s_column_round_trip"], ORACLE["s_column_round_trip"], SMALL) == []


def _anchored(text, target, anchors):
    """One target's sentence, from a scan of all characters; marks are set from the right."""
    white = " \t\n\x0b\f\r"
    own, i = [], 0  # sentences without the white space after them
    for m in re.finditer(f"(?<=[.!?])[{white}]+", text):
        own.append((i, m.start()))
        i = m.end()
    met = [(a, b) for a, b in [*own, (i, len(text))] if a < target[1] and target[0] < b]
    if not met:
        return None
    a, b = met[0][0], met[-1][1]
    marks = [(*target[:2], f"[TARGET: {target[2]}]"), *((s, e, f"[ANCHOR: {t} ({x})]") for s, e, t, x in anchors if s >= a and a < e <= b and s < b and (s, e) != target[:2])]
    out = text[a:b]
    for s, e, by in sorted(marks, reverse=True):
        out = out[: max(s - a, 0)] + by + out[e - a :]
    return out.strip(" ")


def test_anchored_sentences_are_made_in_the_text_s_row(spark):
    random.seed(9)
    docs = _docs(spark)
    targets = [(d, i, s, s + random.choice([0, 1, 3, 9]), f"t{i}") for d in range(42) for i, s in enumerate(random.sample(range(60), 5))]
    anchors = [(d, s, s + random.choice([0, 1, 3]), f"a{i}", "X") for d in range(42) for i, s in enumerate(random.sample(range(60), 9))]
    found = P.anchored_sentences(docs, spark.createDataFrame(targets, "doc_id long, span_id int, start int, end int, text string"), spark.createDataFrame(anchors, "doc_id long, start int, end int, text string, label string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"]}
    want = {(d, i): _anchored(texts[d], x, [a[1:] for a in anchors if a[0] == d]) for d, i, *x in ((t[0], t[1], *t[2:]) for t in targets) if d in texts for x in [tuple(x)]}
    assert {(r["doc_id"], r["span_id"]): r["sentence"] for r in found.collect()} == {k: x for k, x in want.items() if x is not None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1 and "bucket" not in plan
    assert differences(spark, QUERIES["t_anchored_sentences"], ORACLE["t_anchored_sentences"], SMALL) == []
