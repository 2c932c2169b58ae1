"""Label algebra: two ontologies, their maps and canonical spellings, as small tables and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (legacy label, new label) of the ontology.
LABELS = [
    ("Beauty_and_Cleaning", "Personal_care_products_and_cosmetic_procedures"),
    ("Drugs", "Substance_use"),
    ("Environmental_exposures", "Environmental_exposures"),
    ("Lifestyle_factor", "Lifestyle_factor"),
    ("Mental_health_practices", "Mental_health_practices"),
    ("Non_physical_leisure_time_activities", "Non_physical_leisure_time_activities"),
    ("Nutrition", "Nutrition"),
    ("Physical_activity", "Physical_activities"),
    ("Sleep", "Sleep"),
    ("Socioeconomic_factors", "Socioeconomic_factors"),
]
#: The root class that the consolidated label sets leave out.
ROOT = "Lifestyle_factor"
#: Answers that name no class.
NO_CLASS = ["", "o", "non_lsf", "non-lsf", "none", "none of the above", "lifestyle_factor", "lsf_out_of_context"]
#: Categories that count as one under another name.
SYNONYMS = [("drugs", "substance_use"), ("beauty_and_cleaning", "personal_care"), ("personal_care_products_and_cosmetic_procedures", "personal_care"), ("physical_activity", "physical_activities")]
#: Labels that mark nothing to score.
INACTIVE = ["o", "lifestyle_factor", "lsf_out_of_context", "non_lsf"]
NEW_NAMES, OLD_NAMES = ("new", "relabeled", "v2", "true"), ("old", "legacy", "v1", "false")


def label_table(spark: SparkSession) -> DataFrame:
    """(old, new, class_id); class 0 is O."""
    return spark.createDataFrame([(old, new, i + 1) for i, (old, new) in enumerate(LABELS)], "old string, new string, class_id int")


def codec(classes: int) -> list[str]:
    """Labels in the order of their ids: 10 (O and the new classes without the root), 11 (O and all new classes) or 21 (O, then B and I of each of the 10)."""
    if classes == 10:
        return ["O", *(new for _, new in LABELS if new != ROOT)]
    if classes == 11:
        return ["O", *(new for _, new in LABELS)]
    if classes == 21:
        return ["O", *(f"{p}-{new}" for _, new in LABELS for p in "BI")]
    raise ValueError("codecs have 10, 11 or 21 classes")


def label_id(label: Column, classes: int) -> Column:
    """The id of a label in a codec, null if it has none."""
    return F.create_map(*(F.lit(x) for i, name in enumerate(codec(classes)) for x in (name, i)))[label]


def label_name(number: Column, classes: int) -> Column:
    """The label of an id, null if there is none."""
    return F.create_map(*(F.lit(x) for i, name in enumerate(codec(classes)) for x in (i, name)))[number]


def _mapped(label: Column, pairs: list[tuple[str, str]]) -> Column:
    """Maps the label part of a trimmed label and keeps a B- or I- prefix; empty becomes O, unknown labels stay."""
    plain = F.trim(label)
    prefix, bare = F.regexp_extract(plain, "^([BI]-)?", 0), F.regexp_replace(plain, "^[BI]-", "")
    table = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    return F.when(label.isNull() | (plain == ""), "O").otherwise(F.concat(prefix, F.coalesce(table[bare], bare)))


def to_new(label: Column) -> Column:
    return _mapped(label, LABELS)


def to_old(label: Column) -> Column:
    return _mapped(label, [(new, old) for old, new in LABELS])


def map_label(label: Column, schema: str) -> Column:
    """By the name of the target ontology; other names leave labels alone."""
    return to_new(label) if schema.lower() in NEW_NAMES else to_old(label) if schema.lower() in OLD_NAMES else label


def canonical(label: Column, use_new: bool = True) -> Column:
    """The target ontology's spelling: exact, through the other ontology, without case, else as it is but trimmed; empty is O."""
    target = [new if use_new else old for old, new in LABELS]
    other = {(old if use_new else new): (new if use_new else old) for old, new in LABELS}
    lower = {x.lower(): y for x, y in [*other.items(), *((t, t) for t in target), ("O", "O")]}
    look = lambda table, key: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]
    plain = F.trim(label)
    return F.coalesce(F.when(plain == "", "O"), F.when(plain.isin(target), plain), look(other, plain), look(lower, F.lower(plain)), plain, F.lit("O"))


def map_columns(rows: DataFrame, columns: list[str], schema: str) -> DataFrame:
    """Maps every label column; answers that carry an error mark are left alone."""
    return rows.withColumns({c: F.when(F.col(c).startswith("❌"), F.col(c)).otherwise(map_label(F.col(c), schema)) for c in columns})


def active(label: Column) -> Column:
    return ~F.lower(F.trim(label)).isin(INACTIVE)


def normal_text(text: Column) -> Column:
    return F.lower(F.trim(text))


def tolerant_double(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(value).try_cast("double"), F.lit(default))


def tag_parts(tag: Column) -> tuple[Column, Column]:
    """(prefix, type) of a tag; O has an empty type."""
    dashed = tag.contains("-")
    return F.when(dashed, F.regexp_extract(tag, "^([^-]*)-", 1)).otherwise(tag), F.when(dashed, F.regexp_extract(tag, "^[^-]*-(.*)$", 1)).otherwise("")


def answered_label(raw: Column, use_new: bool = True) -> Column:
    """A free answer as a label: none of the classes is O, then the canonical label, then the first label of either ontology within it, else the answer itself."""
    plain = F.regexp_replace(F.trim(raw), "^['\"`]+|['\"`]+$", "")
    names = [x for pair in LABELS for x in dict.fromkeys(pair)]
    exact = canonical(plain, use_new)
    within = F.coalesce(*(F.when(F.lower(plain).contains(x.lower()), canonical(F.lit(x), use_new)) for x in names))
    known = [new if use_new else old for old, new in LABELS]
    return F.when(raw.isNull() | F.lower(plain).isin(NO_CLASS), "O").when(exact.isin(known), exact).otherwise(F.coalesce(within, plain))


def category_key(label: Column) -> Column:
    """Categories compared without case and separators, synonyms as one; null is empty."""
    plain = F.translate(F.lower(F.trim(F.coalesce(label, F.lit("")))), "- ", "__")
    return F.coalesce(F.create_map(*(F.lit(x) for pair in SYNONYMS for x in pair))[plain], plain)


def resolved_section(name: Column, sections: list[tuple[str, str]]) -> Column:
    """The section that a name, an abbreviation or the prefix of a rule's id (NUT-0007) means, else null. sections: (name, abbreviation)."""
    by = {k.lower(): full for full, short in sections for k in (full, short)}
    plain = F.lower(F.trim(name))
    return F.create_map(*(F.lit(x) for pair in by.items() for x in pair))[F.coalesce(F.nullif(F.regexp_extract(plain, "^([a-z]+)-[0-9]+$", 1), F.lit("")), F.translate(plain, " ", "_"))]


def column_list(text: str) -> list[int]:
    """Column numbers of a list such as ``6,8-11``: single ones, and ranges whose end is left out."""
    out: list[int] = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        first, dash, last = part.partition("-")
        out += range(int(first), int(last)) if dash else [int(first)]
    return out


def kept(predicted: Column, uncertainty: Column, threshold: Column | float) -> Column:
    """Candidates to go on with: those of a class, and background ones of which the model is unsure."""
    return (predicted != 0) | (uncertainty >= threshold)


def single_class(tag: Column, name: str = "ENT") -> Column:
    """Collapses the class of a tag."""
    return F.regexp_replace(tag, "^([BI])-.*$", f"$1-{name}")
