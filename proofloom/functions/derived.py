"""Derived columns of the register: texts, tags, structs and caps. Built-in expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .exprs import choose, grade_rank

# What is said of a silence.
SILENCE_TEXT = {
    "RECORD-DESTROYED": "the record is known to be destroyed", "UNINFORMATIVE": "no record would be expected", "UNSEARCHED": "not searched", "INFORMATIVE": "searched and not found",
}
# Custody of a receipt and the largest magnitude it carries.
CUSTODY_CAP = {"deposition": 4, "interview": 3, "quotation": 2, "unknown": 1}
# Label and the largest magnitude a row under it keeps.
LABEL_CAP = {"STATES-ON-FACE": 4, "ENTAILS": 3, "CONSISTENT-WITH-BOTH": 0, "UNDERCUTS": 4, "IRRELEVANT": 0}
LADDER = ["A", "B", "C", "D", "E", "F"]


def silence_text(reading: Column) -> Column:
    return choose(reading, SILENCE_TEXT)


def predicate_args(cls: Column, n: Column, text: Column) -> Column:
    """The arguments of a predicate as JSON: an extent in metres, a named function, a status with its year, else none."""
    return (
        F.when(cls == "EXTENT", F.to_json(F.struct((n * 10).alias("metres")))).when(cls == "FUNCTION", F.to_json(F.struct(text.alias("function"))))
        .when(cls == "STATUS", F.to_json(F.struct(text.alias("status"), (n % 60 + 1940).alias("year")))).when(cls == "LOCATE", F.to_json(F.struct(text.alias("precision")))).otherwise("{}")
    )


def level(scope_text: Column) -> Column:
    """Level of an entity by what its scope text names; the wider one wins."""
    return F.when(scope_text.contains("network"), "NETWORK").when(scope_text.contains("complex"), "COMPLEX").when(scope_text.contains("building"), "BUILDING").otherwise("SITE")


def chart_tags(exist_grade: Column, located: Column, precision: Column) -> Column:
    """Tags of a mark, in order: existence doubtful, position doubtful, position approximate, reported."""
    rank = F.coalesce(grade_rank(exist_grade), F.lit(0))
    return F.array_compact(F.array(
        F.when(rank.between(1, 3), F.lit("ED")), F.when(~located & precision.isin("surveyed", "approximate_1km"), F.lit("PD")),
        F.when(precision.isin("approximate_1km", "approximate_10km", "regional"), F.lit("PA")), F.when(rank == 4, F.lit("Rep")),
    ))


def last_part(text: Column) -> Column:
    """What follows the last comma, trimmed."""
    return F.trim(F.element_at(F.split(text, ","), -1))


def stops_between(grade: Column, ceiling: Column) -> Column:
    """The grades above `grade` up to `ceiling`, nearest first; none for unranked grades."""
    rank = lambda g: F.coalesce(grade_rank(g), F.lit(0))
    steps = F.array(*(F.lit(g) for g in reversed(LADDER)))
    return F.when(grade_rank(grade).isNull(), F.array().cast("array<string>")).otherwise(F.filter(steps, lambda g: (rank(g) > rank(grade)) & (rank(g) <= rank(ceiling))))


def truncated(text: Column, most: int) -> Column:
    """At most so many characters; what is cut off ends in an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def corpus_era(first_capture: Column, registered: Column, byline: Column) -> Column:
    """Before the cut if any date shows it; without any date unattributed."""
    cut = F.lit(vocab.CUT_DATE).cast("date")
    first = F.least(first_capture, registered, byline)
    return F.when(first <= cut, "PRE-2022").when(first.isNull() | byline.isNull(), "POST-2022-UNATTRIBUTED").otherwise("POST-2022-ATTRIBUTED")


def custody_capped(magnitude: Column, custody: Column) -> Column:
    return F.least(magnitude, choose(custody, CUSTODY_CAP, F.lit(0)))


def demoted(assigned: Column, sign: Column, label: Column) -> tuple[Column, Column]:
    """(magnitude, sign) under a label, which only lowers: the row's own sign stays but under one that undercuts. A missing or unknown label leaves nothing."""
    return F.least(assigned, choose(label, LABEL_CAP, F.lit(0))), F.when(label == "UNDERCUTS", "UNDERCUTS").otherwise(sign)
