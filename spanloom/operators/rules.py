"""A scored table of rules that grows and is pruned in batches: one snapshot in, one out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.sources.scratch import kept

from .neighbours import first_independent
from .vectors import nearest

#: Sections, their abbreviation and group.
SECTIONS = [("Nutrition", "NUT", "behaviour"), ("Sleep", "SLE", "behaviour"), ("Substance_use", "SUB", "exposure"), ("Environmental_exposures", "ENV", "exposure")]


#: Values of ``seq`` that are numbered in one task.
SEQ_RANGE = 10_000


def next_ids(rules: DataFrame, added: DataFrame) -> DataFrame:
    """Gives rows of ``added`` (abbr, seq, ...) the ids after the last of their section, as NUT-0007.

    Rows are numbered inside ranges of ``seq``; what stands before a range is a
    running sum of the ranges' counts, so no section is sorted in one task.
    """
    last = rules.groupBy(F.substring_index("bullet_id", "-", 1).alias("abbr")).agg(F.max(F.substring_index("bullet_id", "-", -1).cast("int")).alias("last"))
    ranged = added.withColumn("_range", F.floor(F.col("seq") / SEQ_RANGE))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("abbr").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranged.groupBy("abbr", "_range").agg(F.count("*").alias("_n")).select("abbr", "_range", before.alias("_before"))
    n = F.coalesce("last", F.lit(0)) + F.col("_before") + F.row_number().over(Window.partitionBy("abbr", "_range").orderBy("seq"))
    rows = ranged.join(ranges, ["abbr", "_range"]).join(last, "abbr", "left")
    return rows.withColumn("bullet_id", F.concat("abbr", F.lit("-"), F.lpad(n.cast("string"), F.greatest(F.lit(4), F.length(n.cast("string"))), F.lit("0")))).drop("last", "_range", "_before")


def counted(rules: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds the tags' counts (helpful, harmful, usage) to the counters of their rules."""
    deltas = tags.groupBy("bullet_id").agg(F.count_if(F.col("tag") == "helpful").alias("h"), F.count_if(F.col("tag") == "harmful").alias("x"), F.count("*").alias("u"))
    rows = rules.join(deltas, "bullet_id", "left")
    return rows.withColumns({c: F.col(c) + F.coalesce(d, F.lit(0)) for c, d in (("helpful", "h"), ("harmful", "x"), ("usage_count", "u"))}).drop("h", "x", "u")


def due(additions_before: int, additions_now: int, every: int = 50) -> bool:
    """Whether pruning runs of itself: each time that so many more rules have been added."""
    return additions_before // every < (additions_before + additions_now) // every


def pruned(rules: DataFrame, margin: int = 5, section: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): a rule goes whose harm outweighs its help by ``margin``."""
    bad = F.col("harmful") - F.col("helpful") >= margin
    bad = bad & (F.col("section") == section) if section else bad
    return rules.filter(~bad), rules.filter(bad)


def checked(operations: DataFrame) -> DataFrame:
    """Adds the reason why an operation can't be run, null if it can."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    known = F.col("section").isin([s for s, _, _ in SECTIONS])
    reason = (
        F.when(~F.coalesce(F.col("type").isin("ADD", "MODIFY"), F.lit(False)), "unknown type")
        .when(blank("content"), "no content")
        .when((F.col("type") == "ADD") & ~F.coalesce(known, F.lit(False)), "unknown section")
        .when((F.col("type") == "MODIFY") & blank("bullet_id"), "no rule named")
    )
    return operations.withColumn("reason", reason)


def near_duplicates(added: DataFrame, rules: DataFrame, threshold: float = 0.8, siblings: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) additions (seq, section, v, ...), in order of seq; all their columns are kept.

    Rejected with ``rule_no``: a stored rule of the section is as similar as
    ``threshold``. Rejected with ``twin``: an accepted addition of the same batch
    and section is, so of siblings alike the first is added; without ``siblings``
    additions are compared with stored rules only. Without a vector an
    addition is accepted.
    """
    vectors = added.filter("v is not null")
    asked = vectors.select(F.col("seq").alias("id"), "v", F.array("section").alias("wanted"))
    refs = rules.filter("v is not null").select(F.col("rule_no").alias("id"), F.col("section").alias("label"), "v")
    near = kept(nearest(asked, refs, 1, by_class=True).filter(1 - F.col("distance") >= threshold).select(F.col("query_id").alias("seq"), F.col("ref_id").alias("rule_no")))
    if not siblings:
        out = near.withColumn("twin", F.lit(None).cast("long"))
        return added.join(out, "seq", "left_anti"), added.join(out, "seq")
    new = vectors.join(near, "seq", "left_anti").select(F.col("seq").alias("id"), F.col("section").alias("label"), "v")
    twins = first_independent(new, 1 - threshold).filter("twin is not null").select(F.col("id").alias("seq"), "twin")
    out = kept(near.unionByName(twins, allowMissingColumns=True))
    return added.join(out, "seq", "left_anti"), added.join(out, "seq")


def modified(rules: DataFrame, operations: DataFrame) -> DataFrame:
    """Replaces contents by the operations of a batch in order; what they replace goes to content_history."""
    w = Window.partitionBy("bullet_id")
    steps = operations.withColumn("last", F.max("seq").over(w)).groupBy("bullet_id").agg(F.max_by("content", "seq").alias("new"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x.content).alias("all"))
    rows = rules.join(steps, "bullet_id", "left")
    before = F.concat(F.array("content"), F.slice("all", 1, F.size("all") - 1))
    rows = rows.withColumn("content_history", F.when(F.col("new").isNull(), F.col("content_history")).otherwise(F.concat("content_history", before)))
    rows = rows.withColumn("modification_count", F.col("modification_count") + F.coalesce(F.size("all"), F.lit(0)))
    return rows.withColumn("content", F.coalesce("new", "content")).drop("new", "all")


def capped_examples(examples: DataFrame, most: int = 4) -> DataFrame:
    """At most ``most`` examples of a rule: one of a sentence (the newest), first the newest of each error type, then by age."""
    one = examples.withColumn("r", F.row_number().over(Window.partitionBy("bullet_id", "sentence").orderBy(F.desc("seq")))).filter("r = 1").drop("r")
    kind = F.row_number().over(Window.partitionBy("bullet_id", "error_type").orderBy(F.desc("seq")))
    ranked = one.withColumn("of_type", (kind > 1).cast("int"))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("bullet_id").orderBy("of_type", F.desc("seq")))).filter(F.col("place") <= most).drop("of_type")


def merged_examples(stored: DataFrame, operations: DataFrame, most: int = 4) -> DataFrame:
    """The examples of each rule after a batch: the stored ones (bullet_id, error_type, sentence, seq) and those of its MODIFY operations, capped.

    operations: (bullet_id, seq, examples: array of struct(error_type, sentence)).
    An operation's examples are newer than all stored ones and than those of
    operations before it; inside an operation the later counts as newer. Of one
    sentence the newest stays. Rules that no operation names keep theirs as they are.
    """
    newest = stored.groupBy("bullet_id").agg(F.max("seq").alias("newest"))
    new = operations.select("bullet_id", F.col("seq").alias("op"), F.posexplode("examples").alias("place", "x")).select("bullet_id", "op", "place", "x.error_type", "x.sentence")
    number = F.row_number().over(Window.partitionBy("bullet_id").orderBy("op", "place"))
    new = new.join(newest, "bullet_id", "left").select("bullet_id", "error_type", "sentence", (F.coalesce("newest", F.lit(0)) + number).alias("seq"))
    named = operations.select("bullet_id").distinct()
    changed = capped_examples(stored.join(named, "bullet_id", "left_semi").unionByName(new), most).drop("place")
    return stored.join(named, "bullet_id", "left_anti").unionByName(changed.select(stored.columns))


def report(told: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """(what, grp, section, n) of one batch: operations by type, invalid ones by reason, rejected additions by cause, and new rules by super-category and section with totals.

    ``grp`` holds the type, reason or cause, or the super-category; nulls in the
    counts of new rules are totals.
    """
    group = F.create_map(*(F.lit(x) for s, _, g in SECTIONS for x in (s, g)))
    one = lambda rows, what, by: rows.groupBy(by.alias("grp")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.coalesce("grp", F.lit("none")).alias("grp"), F.lit(None).cast("string").alias("section"), "n")
    by_type = one(told, "operations", F.col("type"))
    invalid = one(told.filter("reason is not null"), "invalid", F.col("reason"))
    cause = one(rejected, "rejected", F.when(F.col("twin").isNotNull(), "sibling").otherwise("stored rule"))
    new = accepted.withColumn("grp", group[F.col("section")]).rollup("grp", "section").agg(F.count("*").alias("n")).select(F.lit("new rules").alias("what"), "grp", "section", "n")
    return by_type.unionByName(invalid).unionByName(cause).unionByName(new)


def resolved(answers: DataFrame, rules: DataFrame) -> DataFrame:
    """The text of each rule that an answer cites; unknown ids stay as they are. answers: (doc_id, ids array)."""
    cited = answers.select("doc_id", F.posexplode("ids").alias("place", "bullet_id"))
    return cited.join(rules.select("bullet_id", "content"), "bullet_id", "left").select("doc_id", "place", F.coalesce("content", "bullet_id").alias("rule"))


def reconciled(stored: DataFrame, index: DataFrame, key: str = "bullet_id") -> DataFrame:
    """Ids that only one of rule table and index has: missing or stale."""
    missing = stored.select(key).join(index.select(key), key, "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(index.select(key).join(stored.select(key), key, "left_anti").withColumn("state", F.lit("stale")))


def curated(rules: DataFrame, tags: DataFrame, operations: DataFrame, margin: int = 5, siblings: bool = True) -> tuple[DataFrame, DataFrame]:
    """(snapshot, report) of one batch: counters, checks, changes, additions without near duplicates, pruning.

    Batches are synchronous: rules learned from a document act from the next batch on.
    ``siblings``: see near_duplicates.
    """
    rules = counted(rules, tags)
    told = checked(operations)
    rules = modified(rules, told.filter("reason is null and type = 'MODIFY'").select("bullet_id", "seq", "content"))
    accepted, rejected = near_duplicates(told.filter("reason is null and type = 'ADD'"), rules, siblings=siblings)
    abbr = F.create_map(*(F.lit(x) for s, a, _ in SECTIONS for x in (s, a)))
    new = next_ids(rules, accepted.drop("bullet_id").withColumn("abbr", abbr[F.col("section")]))
    zero = {c: F.lit(0).cast("long") for c in ("helpful", "harmful", "usage_count", "modification_count")}
    new = new.withColumns(zero | {"content_history": F.array().cast("array<string>"), "rule_no": -F.col("seq")})
    kept, removed = pruned(rules.unionByName(new.select(rules.columns)), margin)
    state = lambda rows, name: rows.select(F.lit(name).alias("state")).groupBy("state").agg(F.count("*").alias("n"))
    report = state(told.filter("reason is not null"), "invalid").unionByName(state(accepted, "added")).unionByName(state(rejected, "rejected")).unionByName(state(removed, "removed"))
    return kept, report


def statistics(rules: DataFrame) -> DataFrame:
    """Rules, help, harm and use by group and section, with totals."""
    group = F.create_map(*(F.lit(x) for s, _, g in SECTIONS for x in (s, g)))
    sums = rules.withColumn("grp", group[F.col("section")]).rollup("grp", "section")
    return sums.agg(F.count("*").alias("n"), F.sum("helpful").alias("helpful"), F.sum("harmful").alias("harmful"), F.sum("usage_count").alias("used"))
