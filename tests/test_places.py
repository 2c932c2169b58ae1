"""Answer placing against plain searches: the automaton, first free and leftmost occurrences, parts, and templates."""

import random

from spanloom.operators import places as PL
from spanloom.operators import prompts as P


def test_automaton_finds_every_occurrence():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("ab", k=rng.randrange(30)))
        names = list({"".join(rng.choices("ab", k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 7))})
        want = sorted((i, s, s + len(n)) for i, n in enumerate(names) for s in range(len(text)) if text.startswith(n, s))
        assert sorted(PL.Automaton(names).found(text)) == want


def plain(text, names, taken, choice):
    low = PL.folded(text or "")
    out = []
    if choice == "first":
        for name in names:
            key, at = PL.folded(name), 0
            while (at := low.find(key, at)) >= 0:
                if (at, at + len(key)) not in taken:
                    out.append((name, at, at + len(key)))
                    break
                at += len(key)
        return sorted(out)
    at = 0
    while at < len(low):
        best = max((len(n) for n in names if low.startswith(PL.folded(n), at)), default=0)
        out += [(n, at, at + best) for n in names if best and len(n) == best and low.startswith(PL.folded(n), at)]
        at += best or 1
    return sorted(out)


def test_occurrences_of_documents(spark):
    rng = random.Random(2)
    docs, names, taken, per = [], [], [], {}
    for d in range(60):
        text = "".join(rng.choices("aAbÄä İ.", k=rng.randrange(40)))
        own = {"".join(rng.choices("abÄ.İ", k=rng.randrange(1, 4))) for _ in range(4)}
        spans = {(s, s + rng.randrange(1, 4)) for s in range(0, 40, 3)} if d % 2 else set()
        docs.append((d, text))
        names += [(d, n) for n in own]
        taken += [(d, s, e) for s, e in spans]
        per[d] = (text, own, spans)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    docs = frame([*docs, (99, None)], "doc_id long, text string")
    names = frame([*names, (99, "a"), (98, "a"), (0, ""), (0, None)], "doc_id long, entity string")
    for choice in ("first", "all"):
        got = {}
        for r in PL.occurrences(names, docs, frame(taken, "doc_id long, start int, end int"), choice).collect():
            got.setdefault(r["doc_id"], []).append((r["entity"], r["start"], r["end"]))
        want = {d: plain(text, own, spans, choice) for d, (text, own, spans) in per.items()}
        assert {d: sorted(x) for d, x in got.items()} == {d: x for d, x in want.items() if x}


def test_a_long_text_with_many_names(spark):
    names = [f"name{i}x" for i in range(2000)]
    docs = spark.createDataFrame([(1, "no " * 100_000 + " ".join(names))], "doc_id long, text string")
    assert PL.occurrences(spark.createDataFrame([(1, n.upper()) for n in names], "doc_id long, entity string"), docs).count() == 2000


def test_parts_of_numbered_answers(spark):
    mentions = spark.createDataFrame([(1, 1, 10, 31, "sleep and diet quality"), (1, 2, 40, 43, "nap"), (1, 3, 50, 53, "rum"), (2, 1, 0, 3, "nap"), (3, 1, 0, 3, "nap"), (4, 1, 0, 3, "nap")], "doc_id long, number int, start int, end int, text string")
    raw = '1a. "sleep": Sleep\n1b. \'diet\' is nutrition\n1c) "absent" Sleep\nwords\n2. none\n'
    answers = spark.createDataFrame([(1, raw), (2, "None of the above"), (3, " all of it is SLEEP"), (5, "1. Sleep")], "doc_id long, raw string")
    got = sorted((r["doc_id"], r["number"], r["part"], r["start"], r["end"], r["text"], r["label"]) for r in PL.resolved_parts(mentions, answers, ["Sleep", "Nutrition"]).collect())
    assert got == [
        (1, 1, "a", 10, 15, "sleep", "Sleep"),
        (1, 1, "b", 20, 24, "diet", "Nutrition"),
        (1, 1, "c", 10, 31, "sleep and diet quality", "Sleep"),
        (1, 2, "", 40, 43, "nap", "O"),
        (1, 3, "", 50, 53, "rum", "O"),
        (2, 1, "", 0, 3, "nap", "O"),
        (3, 1, "", 0, 3, "nap", "Sleep"),
        (4, 1, "", 0, 3, "nap", "O"),
    ]


def test_fields_inside_fields_are_text(spark):
    docs = spark.createDataFrame([(1, "see {evidence} and {text}"), (2, None)], "doc_id long, text string")
    blocks = spark.createDataFrame([(1, "BLOCK {text}")], "doc_id long, block string")
    got = {r["doc_id"]: r["prompt"] for r in P.prompts(docs, blocks, "<{text}|{evidence}|{other}>").collect()}
    assert got == {1: "<see {evidence} and {text}|BLOCK {text}|{other}>", 2: "<||{other}>"}


def test_prompts_of_single_mentions_and_blind_evidence(spark):
    docs = spark.createDataFrame([(1, "First one. A nap helps! Last.")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 13, 16, "nap", "Sleep"), (1, 1, 0, 5, "First", "O"), (2, 2, 0, 1, "x", "O")], "doc_id long, span_id long, start int, end int, text string, label string")
    told = spark.createDataFrame([("D",)], "definitions string")
    got = {r["span_id"]: r["prompt"] for r in P.single_mention_prompts(docs, spans, told, "{definitions}|{candidate}|{context}").collect()}
    assert got == {0: "D|nap|A nap helps!", 1: "D|First|First one.", 2: "D|x|"}
    assert {r["doc_id"]: r["block"] for r in P.evidence(spans, blind=True).collect()}[1] == '1. "First" [0:5]\n2. "nap" [13:16]'
    assert {r["doc_id"]: r["block"] for r in P.evidence(spans).collect()}[2] == '1. "x" [0:1] -> O'


def test_lines_explanations_and_candidates(spark):
    from pyspark.sql import functions as F

    from spanloom.functions import labels as L
    from spanloom.functions import scores as S
    from spanloom.operators import text as T

    docs = spark.createDataFrame([(1, "One. Two! 3.5 x?\tY."), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in T.with_lines(docs).collect()} == {1: "One.\nTwo!\n3.5 x?\nY.", 2: None}
    name, _, told = S.AUDIT[0]
    row = spark.range(1).select(S.explanation(F.lit("A"), F.lit("B"), F.lit("A"), F.lit("A"), F.lit(name)).alias("x")).first()
    assert row["x"] == f"proposed A, answered B, kept A, gold A: {told}"
    rows = spark.createDataFrame([(0, 0.9), (0, 0.1), (3, 0.0)], "c int, u double").select(L.kept(F.col("c"), F.col("u"), 0.8).alias("k"))
    assert [r["k"] for r in rows.collect()] == [True, False, True]
