"""Speaker labels and stage directions: roles and the climate of the room, as ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, title_name

#: Honorifics before a name.
HONORIFIC = r"^(el|la|los|las|o|a|the)?\s*(senor|senora|senores|senhor|senhora|sr|sra|srta|don|dona|mr|mrs|ms|dr|dra)\.?\s+"

#: (pattern on the folded label, role), the first that fits holds.
ROLES = (
    (r"^(sumario|summary)$", "summary"),
    (r"^(comentarios|remarks)$", "remark"),
    (r"(presidente|presidenta) del (gobierno|consejo)|primer ministro|prime minister", "head_of_government"),
    (r"(presidente|presidenta) de la (republica|nacion)|^(rey|reina)\b|head of state", "head_of_state"),
    (r"president[ea] de edad|de mayor edad", "chair_age"),
    (r"minist", "minister"),
    (r"^secretar", "secretary"),
    (r"^vice", "vicechair"),
    (r"^president", "chair"),
)

#: (pattern on the folded direction, class, label), the first that fits holds.
DIRECTIONS = (
    (r"(?s)^(?=.*(president[ea]|chair))(?=.*(campana|timbre|orden|silencio|agita))|toca el timbre|campanilla|rings the bell", "order", "call to order"),
    (r"muy bien|bravo|hear, hear", "applause", "approval"),
    (r"protest|rumor|tumult|gritos|abuche|pateo|interrup|escandalo|uproar", "conflict", "protest"),
    (r"\brisas\b|laughter", "neutral", "laughter"),
    (r"aplau|ovacion|palmas|applause", "applause", "applause"),
    (r"asiente|niega|gesto|pausa|gestur|pause|nods", "neutral", "gesture"),
)


def bare_label(raw: Column) -> Column:
    """Folded label without honorific and final mark."""
    return F.regexp_replace(F.regexp_replace(F.btrim(fold(F.coalesce(raw, F.lit("")))), HONORIFIC, ""), r"[\s.:]+$", "")


def role(raw: Column) -> Column:
    body = bare_label(raw)
    first = F.split_part(body, F.lit(" "), F.lit(1))
    out = F.when(F.lit(False), "")
    for pattern, name in ROLES:
        hit = body.rlike(pattern)
        if name == "secretary":
            hit = hit | (F.levenshtein(first, F.lit("secretario")) <= 2)
        if name == "chair":
            hit = hit | (F.levenshtein(first, F.lit("presidente")) <= 2)
        out = out.when(hit, name)
    return out.otherwise("deputy")


def parse(rows: DataFrame, raw: str = "speaker") -> DataFrame:
    """Adds role, honorific and name; a name in parentheses is that of an office holder."""
    inside = F.regexp_extract(F.col(raw), r"\(([^)]+)\)", 1)
    outside = F.regexp_replace(F.regexp_replace(F.col(raw), r"\([^)]*\)", ""), r"(?i)^\s*(el|la|o|a|the)?\s*(señor|señora|senhor|senhora|sr|sra|don|doña|mr|mrs|ms|dr|dra)\.?\s+", "")
    honorific = F.regexp_extract(fold(F.coalesce(F.col(raw), F.lit(""))), HONORIFIC, 2)
    name = F.regexp_replace(F.btrim(F.when(inside != "", inside).otherwise(outside)), r"[\s.:]+$", "")
    return rows.withColumns({"role": role(F.col(raw)), "honorific": honorific, "name": title_name(name)})


def direction_units(text: Column) -> Column:
    """Units of all parentheses of at most 900 characters: their sentences and clauses."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\(([^()]{1,900})\)"), 1)
    return F.filter(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"[.;—–]\s*|\s-\s"))), F.btrim), lambda u: u != "")


def classify(unit: Column) -> Column:
    """Struct (class, label); null for what is no stage direction."""
    body = fold(unit)
    kind, label = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    allowed = unit.rlike(r"^\p{Lu}|^[¡!]") & (F.size(F.split(unit, r"\s+")) <= 40)
    for pattern, k, name in DIRECTIONS:
        hit = allowed & body.rlike(pattern)
        kind, label = kind.when(hit, k), label.when(hit, name)
    return F.when(kind.isNotNull(), F.struct(kind.alias("class"), label.alias("label")))


def climate(corpus: DataFrame) -> DataFrame:
    """(id, applause, conflict, order, neutral, total) of each speech's stage directions."""
    units = F.filter(F.transform(direction_units(F.col("speech")), classify), lambda u: u.isNotNull())
    marked = corpus.select("id", units.alias("u"))

    def count(kind: str) -> Column:
        return F.size(F.filter("u", lambda u: u["class"] == kind)).alias(kind)

    return marked.select("id", *map(count, ("applause", "conflict", "order", "neutral")), F.size("u").alias("total"))


def climate_labels(corpus: DataFrame) -> DataFrame:
    """(class, label, n) over all speeches."""
    units = corpus.select(F.explode(F.transform(direction_units(F.col("speech")), classify)).alias("u")).filter("u IS NOT NULL")
    return units.groupBy("u.class", "u.label").agg(F.count("*").alias("n"))
