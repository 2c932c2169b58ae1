"""Substring dedup, Merkle manifest and tokenizer alignment against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.llm import alignment, merkle, substrings
from spanloom.llm.common import Scratch

CLASHES = ("doc", "key", "n_words", "removed", "block", "path", "group", "_docs_key", "n_a")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHES})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(rows, window):
    words = [(text or "").encode().split() for _, text in rows]
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    least = {}
    for i, w in zip(ids, words):
        for p in range(len(w) - window + 1):
            at = tuple(w[p : p + window])
            least[at] = min(least.get(at, i), i)
    out = []
    for (doc, _), i, w in zip(rows, ids, words):
        gone = {p + k for p in range(len(w) - window + 1) if least[tuple(w[p : p + window])] < i for k in range(window)}
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def some_texts(rng, n, passage):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(80))
        if rng.random() < 0.6:
            a = rng.randrange(30)
            text[len(text) // 2 : len(text) // 2] = passage[a : a + rng.randrange(5, 40)]
        rows.append((i * 3 % 1000, " ".join(text)))
    return rows


@pytest.mark.parametrize("window", [1, 2, 3, 8, 13])
def test_repeats_against_all_windows(spark, window):
    rng = random.Random(window)
    rows = some_texts(rng, 60, [f"p{i}" for i in range(60)])
    rows += [(500, rows[3][1]), (501, rows[3][1].replace(" ", "\n\t")), (502, None), (503, ""), (504, " \x0b "), (505, "x " * 3000), (506, "x " * 2000 + "y"), (507, "é b " * 40), (None, rows[4][1]), (None, "x " * 30), (7, rows[5][1]), (7, rows[5][1]), (7, rows[5][1] + " z")]
    got = substrings.repeated_substrings(docs_of(spark, rows), window=window).collect()
    assert sorted(((r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["removed"]), r["kept_sha256"]) for r in got), key=str) == repeats(rows, window)


def test_repeats_of_long_passages(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(300)]
    rows = [(i, " ".join([f"a{i}-{k}" for k in range(rng.randrange(60))] + passage[rng.randrange(200) :][: rng.randrange(40, 120)] + [f"b{i}-{k}" for k in range(30)])) for i in range(40)]
    got = substrings.repeated_substrings(docs_of(spark, rows)).collect()
    want = repeats(rows, substrings.WINDOW)
    assert sorted(((r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["removed"]), r["kept_sha256"]) for r in got), key=str) == want
    assert any(x[2] for x in want)


def test_repeats_of_nothing_and_kept_texts(spark):
    assert substrings.repeated_substrings(docs_of(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    docs = docs_of(spark, [(1, text), (2, "a  b " + text + " c"), (3, None), (2, "other")])
    got = substrings.drop_repeats(spark, docs, "")
    assert got.columns == docs.columns and all(r[c] == "x" for r in got.collect() for c in CLASHES)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, text), (2, "a b c"), (3, None), (2, "other")], key=str)


def tree_of(hashes, fanout):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


@pytest.mark.parametrize(("fanout", "levels"), [(2, 12), (2, 1), (3, 2), (2, 3)])
def test_manifest_against_whole_trees(spark, fanout, levels):
    rng = random.Random(fanout + levels)
    rows = [(rng.choice(["a", "b", "b", "b", None, "é"]), rng.choice([None, *range(90)]), sha(str(i // 2)), sha(f"new{i}") if rng.random() < 0.3 else None) for i in range(150)] + [("one", 1, sha("z"), None)]
    with Scratch(spark) as scratch:
        got = [r.asDict(recursive=True) for r in merkle.manifest(spark.createDataFrame(rows, "group string, id long, hash string, changed string"), scratch, fanout, levels).collect()]
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    tops = [tree_of([r[2] for r in sorted(groups[n], key=order)], fanout)[-1][0] for n in names]
    crown = tree_of(tops, fanout)
    assert len(got) == len(rows)
    for r in got:
        leaves = sorted(groups[r["group"]], key=order)
        assert leaves[r["index"]][:3] == (r["group"], r["id"], r["hash"])
        base = tree_of([x[2] for x in leaves], fanout)
        where = names.index(r["group"])
        assert (r["subroot"], r["root"]) == (base[-1][0], crown[-1][0])
        new = [x[2] for x in leaves]
        new[r["index"]] = r["changed"] or r["hash"]
        version = tree_of(new, fanout)
        above = tree_of([*tops[:where], version[-1][0], *tops[where + 1 :]], fanout)
        assert r["folded"] == above[-1][0]
        at, steps, copied = r["index"], [], []
        for tree, i, fresh in ((base, r["index"], version), (crown, where, above)):
            for k, level in enumerate(tree[:-1]):
                run = level[i - i % fanout :][:fanout]
                steps.append({"before": "".join(run[: i % fanout]), "after": "".join(run[i % fanout + 1 :])})
                i //= fanout
                copied.append(fresh[k + 1][i])
        assert r["path"] == steps
        assert r["copied"] == (copied if r["changed"] else None)


def test_manifest_shares_all_other_nodes(spark):
    """A version's nodes are the first tree's but for its copies."""
    rows = [("g", i, sha(str(i)), sha("x") if i == 37 else None) for i in range(100)]
    with Scratch(spark) as scratch:
        r = merkle.manifest(spark.createDataFrame(rows, "group string, id long, hash string, changed string"), scratch, 2, 3).filter("changed is not null").first()
    base, new = tree_of([x[2] for x in rows], 2), tree_of([x[3] or x[2] for x in rows], 2)
    differing = [b for x, y in zip(base, new) for a, b in zip(x, y) if a != b]
    assert [r["changed"], *r["copied"]] == differing


def test_manifest_query(spark, tmp_path):
    rows = [(i, f"t{i} é", ["en", "de", None][i % 3], None if i % 4 else "s", None if i % 5 == 0 else i, "y") for i in range(40)] + [(None, None, None, None, None, "y"), (3, "t3 é", "en", None, 3, "y"), (3, "t3 é", "en", None, 3, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string").write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    import zlib

    chars = {r[0]: r[4] for r in rows}
    for r in got:
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and chars[r["doc_id"]] is not None
        assert r["verified"] == (not tampered)
    assert len(got) == len(rows) and len({r["root"] for r in got}) == 1
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    assert Counter(r["leaf"] for r in got) == Counter(sha("".join(map(field, (r[0], r[3], r[2], r[4], r[1])))) for r in rows)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert merkle.op12_merkle_manifest(spark, str(tmp_path / "none")).count() == 0


def aligned(rows):
    """Counts and digests from all pairs of byte ranges."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path(alignment.FIRST))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SECOND))
    known = alignment.Aligner(alignment.FIRST, alignment.SECOND)
    found, counts = [], Counter()
    for doc, text in rows:
        a, b = first.encode(" " + (text or ""), add_special_tokens=False).ids, second.encode(text or "")
        a_bytes, b_bytes = [known.first_bytes[i] for i in a], [known.second_bytes[i] for i in b]
        if not text or not (b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode()):
            found.append((doc, 0, 0, [], [], ""))
            continue
        ranges = []
        for pieces in (a_bytes, b_bytes):
            at, spans = 0, []
            for x in pieces:
                spans.append((at, at + len(x)))
                at += len(x)
            ranges.append(spans)
        ends, low, groups = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]}), 0, []
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s in zip(ids, spans) if low <= s[0] < end) for ids, spans in zip((a, b), ranges)))
            low = end
        links = [(i, j) for i, s in zip(a, ranges[0]) for j, t in zip(b, ranges[1]) if s[0] < t[1] and t[0] < s[1]]
        counts.update(links)
        found.append((doc, len(a), len(b), groups, links, sha(";".join(groups))))
    highest = Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    return sorted(((doc, n, m, len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), digest) for doc, n, m, groups, links, digest in found), key=str)


def test_alignment_against_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choices(["the", "un", "break", "able", "é", "ß", "X", "12", ",", ".", "\n", "ion", "日"], k=rng.randrange(1, 5))) for _ in range(rng.randrange(60)))) for i in range(80)]
    odd = [None, "", " ", "a", " a", "a ", "a  b", "a\nb \n c", "x<|endoftext|> y", "▁ u", "word ▁in word", "日本 語 é ﬁ x", "<s> <0x41> <unk>", "é ́x", "😀 hi", "tab\tb c", "don't 1234 --- ..", "\x00 a\x1cb c \x85 d", "x" * 3000, " ".join(["again"] * 500)]
    rows += [(1000 + i, t) for i, t in enumerate(odd)] + [(None, "a b"), (5, "a b"), (5, "a b")]
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    got = alignment.align(docs_of(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == aligned(rows)
    assert alignment.align(docs_of(spark, [])).count() == 0


def test_galloping_finds_what_sets_do():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(np.concatenate([rng.integers(1, 400, rng.integers(1, 120)), [400]])) for _ in range(2))
        a_cuts, b_cuts, own, other = alignment.matched(a, b, a, b, np.array([400]))
        assert a[a_cuts].tolist() == b[b_cuts].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        starts = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
        assert sorted(zip(own.tolist(), other.tolist())) == [(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]]


def test_ranks_decide_as_merges_do():
    import public_tokenizers
    from tokenizers import Tokenizer

    known, rng = alignment.Aligner(alignment.FIRST, alignment.SECOND), random.Random(1)
    assert known.ranked is not None
    first = Tokenizer.from_file(public_tokenizers.path(alignment.FIRST))
    letters = "abcdefghijklmnopqrstuvwxyzéèöüßABC0123.,'-\n"
    text = " ".join("".join(rng.choices(letters, k=rng.randrange(1, 14))) for _ in range(20_000))
    assert known.first_ids(" " + text) == first.encode(" " + text, add_special_tokens=False).ids


def test_blocks_are_small(spark, monkeypatch):
    from pathlib import Path

    import numpy as np
    import pyarrow.parquet as pq

    rng = np.random.default_rng(4)
    entries = np.concatenate([np.unique(rng.integers(0, 20_000, 400)) for _ in range(500)])
    for x in (entries, entries[::-1], np.zeros(0, np.int64), np.array([2**31 - 1, 0, 2**31 - 1]), rng.integers(1, 4, 1000)):
        assert alignment._unpacked(alignment._packed(x)).tolist() == x.tolist()
    assert len(alignment._packed(entries)) < 2 * len(entries)  # 4 before
    rows = spark.range(10).selectExpr("id as doc_id", "concat(repeat(concat('word', id, ' '), 360000), 'x') as text").coalesce(1)
    saved = []

    class Kept(alignment.Scratch):
        def drop(self, name=""):
            saved.append(self.root.removeprefix("file://"))

    monkeypatch.setattr(alignment, "Scratch", Kept)
    assert alignment.align(rows).count() == 10
    found = [pq.ParquetFile(f).metadata for f in Path(saved[0], "blocks").glob("*.parquet")]
    groups = [m.row_group(i).num_rows for m in found for i in range(m.num_row_groups)]
    assert sum(groups) == 10 and max(groups) <= alignment.GROUP_BLOCKS
