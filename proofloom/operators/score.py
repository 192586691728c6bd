"""Grades of all propositions: null state, refutation, bands, caps, search floor, ceiling, clamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs, vocab
from . import evidence
from .shared import cut

_FLAGS = ["t1_place", "judged_apart", "destroyed", "has_t1t2", "mirror_d3", "dated_before_cut", "excl_d3", "excl_d2", "excl_any", "null_documented", "unrebutted_d3", "r3", "r1", "negative_receipt"]


def gather(propositions: DataFrame, counts: DataFrame, profiles: DataFrame) -> DataFrame:
    """One wide row a proposition with every count (evidence.all_counts) and flag the conditions read; absent evidence counts as none."""
    wide = propositions.join(counts, "proposition_id", "left").join(evidence.search(profiles), "proposition_id", "left")
    numbers = [c for c, t in wide.dtypes if t == "bigint" and c.startswith(("n_", "v_", "l_", "u_", "place_", "claim_", "search_", "solicited_", "unbound_"))]
    return wide.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers} | {c: F.coalesce(c, F.lit(False)) for c in _FLAGS} | {"silence": F.coalesce("silence", F.lit("UNINFORMATIVE"))})


def null_state() -> Column:
    c = F.col
    return (
        F.when(~c("null_selected"), "UNTESTED").when(c("excl_d3"), "EXCLUDED").when(c("excl_d2"), "INSUFFICIENT").when(c("null_documented") & ~c("excl_any"), "DOMINANT").otherwise("SURVIVING")
    )


def refutation_state() -> Column:
    c = F.col
    return F.when(c("r3"), "R3").when((c("u_lineages") >= 2) & (c("null_state") == "DOMINANT") & c("r2_proposed"), "R2").when(c("r1") & (c("l_d0") <= 1), "R1").otherwise("R0")


def conditions(c1c: Column | None = None) -> dict[str, Column]:
    c, ns = F.col, F.col("null_state")
    clear = ~c("unrebutted_d3")
    return {
        "A1": (c("v_d4_claim") >= 1) | (c("l_d3_claim") >= 2), "A1alt": c("class").isin(vocab.PLACE_CLASSES) & (c("n_direct") >= 2) & c("t1_place"), "A2": c("unbound_d3") == 0, "A5": c("solicited_d3") == 0, "A3": ns == "EXCLUDED", "A4": clear, "A6": ~c("mirror_d3") | (c("l_d2") >= 2),
        "B1": (c("l_d3") >= 2) | ((c("l_d2") >= 3) & c("has_t1t2")), "B2": ns.isin("EXCLUDED", "INSUFFICIENT"), "B3": clear, "B4": c("n_v_claim") >= 1,
        "C1a": c("v_d2_claim") >= 1, "C1b": c("l_d2_place_excluding") >= 2, "C1c": F.lit(False) if c1c is None else c1c, "C2": ns != "UNTESTED", "C3": clear,
        "D1": (c("v_d1") >= 1) | (c("v_d0") >= 2), "D2": ns.isin("SURVIVING", "DOMINANT", "UNTESTED"), "E1": c("n_v") > 0, "E2": c("v_d2") == 0,
    }


def evaluate(wide: DataFrame, program_grades: DataFrame | None = None) -> DataFrame:
    """wide with null_state, refutation, the conditions, awarded band, caps, grade, ceiling, limiting condition and marginal flag.

    program_grades: candidate_set_id, program_ok (the set is undiluted and its program graded A or B).
    """
    w = wide.withColumn("null_state", null_state()).withColumn("refutation", refutation_state())
    if program_grades is not None:
        # rows outside all sets stay where they are
        outside = w.where("candidate_set_id is null").withColumn("program_ok", F.lit(False))
        w = w.where("candidate_set_id is not null").join(program_grades, "candidate_set_id", "left").unionByName(outside)
    w = w.withColumns(conditions(None if program_grades is None else F.coalesce("program_ok", F.lit(False)) & (F.col("v_d1_claim") >= 1)))
    c = F.col
    award = (
        F.when(c("refutation") != "R0", "R").when((c("A1") | c("A1alt")) & c("A2") & c("A3") & c("A4") & c("A5") & c("A6"), "A").when(c("B1") & c("B2") & c("B3") & c("B4"), "B")
        .when((c("C1a") | c("C1b") | c("C1c")) & c("C2") & c("C3"), "C").when(c("D1") & c("D2"), "D").when(c("E1") & c("E2"), "E").otherwise("F")
    )
    w = w.withColumn("awarded", award)
    place = c("class").isin([*vocab.PLACE_CLASSES, "TYPOLOGY"])
    caps = [
        ("CAP-1", (c("l_d2") <= 1) & ~c("A1") & ~c("A1alt"), "C"), ("CAP-2a", (c("n_v_claim") == 0) & place, "D"), ("CAP-2b", (c("n_v_claim") == 0) & ~place, "E"), ("CAP-3", c("citogenesis"), "E"),
        ("CAP-4", (c("n_v") > 0) & ~c("dated_before_cut"), "D"), ("CAP-5", c("n_v") == 0, "F"), ("CAP-6", c("mirror_d3") & ~c("A6"), "B"), ("CAP-7", c("null_state") == "UNTESTED", "D"),
        ("CAP-C1c", c("C1c") & ~c("C1a") & ~c("C1b"), "C"),
    ]
    ranked = c("awarded") != "R"
    w = w.withColumn("caps", F.array_compact(F.array(*(F.when(ranked & on, F.lit(name)) for name, on, _ in caps))))
    rank = exprs.grade_rank(c("awarded"))
    low = F.least(rank, *(F.when(on, F.lit(vocab.RANKED[to])) for _, on, to in caps))
    # a column of its own: written out in each of rank_grade's comparisons it would make a method too large for the JVM to translate
    w = w.withColumn("low", low).withColumn("capped", F.when(ranked, exprs.rank_grade(c("low"))).otherwise(c("awarded"))).drop("low")
    floored = (c("search_index") < 500) & c("capped").isin("D", "E", "F")
    w = w.withColumn("caps", F.when(floored, F.array_append("caps", F.lit("SCI-FLOOR"))).otherwise(c("caps"))).withColumn("grade", F.when(floored, "X").otherwise(c("capped")))
    none_expected = (c("search_n") == 0) & (c("n_v_claim") == 0)
    w = w.withColumn("ceiling", F.when(c("citogenesis"), "E").when(none_expected & place, "D").when(none_expected, "E").otherwise("A"))
    marginal = ((c("l_d2") == 2) & (c("grade") == "B")) | ((c("l_d3") == 2) & c("grade").isin("A", "B")) | ((c("l_d2") == 1) & (c("grade") == "C")) | c("judged_apart")
    w = w.withColumn("marginal", marginal).withColumn("at_ceiling", c("grade") == c("ceiling")).withColumn("cap_text", F.array_join("caps", ","))
    w = w.withColumn("ceiling_reason", F.when(c("citogenesis"), "citogenesis").when(none_expected, "no record of the claim is expected"))
    capped = (F.size("caps") > 0) & (c("grade") != c("awarded"))
    w = w.withColumn("limiting", limiting())
    return w.withColumn("limiting", F.when(capped, F.concat(F.coalesce("limiting", F.lit("")), F.lit(" [capped by "), F.array_join("caps", ", "), F.lit("]"))).otherwise(c("limiting")))


def limiting() -> Column:
    """The name of the first condition that keeps the grade from the next band."""
    c = F.col
    return (
        F.when(c("grade") == "A", F.lit(None).cast("string"))
        .when(c("grade") == "B", F.when(~c("A1") & ~c("A1alt"), "A1").when(~c("A2"), "A2").when(~c("A3"), "A3").when(~c("A4"), "A4").when(~c("A5"), "A5").otherwise("A6"))
        .when(c("grade") == "C", F.when(~c("B1"), "B1").when(~c("B2"), "B2").when(~c("B3"), "B3").otherwise("B4"))
        .when(c("grade") == "D", F.when(~(c("C1a") | c("C1b") | c("C1c")), "C1").when(~c("C2"), "C2").otherwise("C3"))
        .when(c("grade") == "E", F.when(~c("D1"), "D1").otherwise("D2"))
        .when(c("grade") == "F", F.when(~c("E1"), "E1").otherwise("E2"))
        .when(c("grade") == "X", F.format_string("insufficient search (%d of %d)", c("search_k"), c("search_n")))
        .otherwise(F.concat(F.lit("refuted: "), c("refutation")))
    )


def candidate_sets(propositions: DataFrame | None, graded: DataFrame, sets: DataFrame) -> DataFrame:
    """candidate_set_id with members, documented instances and program_ok: at most three members a documented instance, and a program graded A or B.

    propositions: all members, where only some of them are graded; None where all are.
    """
    kept = ["proposition_id", "candidate_set_id", "class", "entity_id"]
    with_grade = (graded if propositions is None else propositions).where("candidate_set_id is not null").select(*kept, *(["grade"] if propositions is None else []))
    if propositions is not None:  # members count whether graded or not, so that only a set's programs need grades
        with_grade = with_grade.join(graded.select("proposition_id", "grade"), "proposition_id", "left")
    program = F.coalesce(F.col("grade").isin("A", "B"), F.lit(False)) & (F.col("class") == "PROGRAM")
    s = with_grade.groupBy("candidate_set_id").agg(F.count_distinct("entity_id").alias("members"), F.bool_or(program).alias("program")).join(sets, "candidate_set_id")
    return s.withColumn("undiluted", F.col("members") <= 3 * F.col("documented")).withColumn("program_ok", F.col("undiluted") & F.col("program"))


def clamp(graded: DataFrame, unranked_parent: bool = False) -> DataFrame:
    """graded with `final` (not above the parent's final grade) and `clamped`; PROGRAM, ORIGIN and EXIST are exempt.

    By path doubling: a proposition holds the lowest grade on a stretch of its way up and where that
    stretch ends, and each round joins it with the stretch that begins there, so a chain of n takes
    log n rounds. An unranked parent limits its children only where unranked_parent is set; then the
    nearest unranked one on the way up takes over. A child whose parent is not in the table keeps its
    own grade; parents in a circle are an error.
    """
    c, rank = F.col, exprs.grade_rank(F.col("grade"))
    own = cut(graded.select("proposition_id", "class", "parent_id", "grade"), "own")  # what the way up needs; other columns come back at the end
    free = c("class").isin("EXIST", "PROGRAM", "ORIGIN") | c("parent_id").isNull() | rank.isNull()
    known = own.where(rank.isNotNull() | F.lit(unranked_parent)).select(c("proposition_id").alias("jump"), F.lit(True).alias("holds"))
    ways = own.select("proposition_id", rank.alias("low"), F.when(rank.isNull(), c("grade")).alias("mark"), F.when(~free, c("parent_id")).alias("jump"))
    ways = ways.join(known, "jump", "left").select("proposition_id", "low", "mark", F.when(c("holds"), c("jump")).alias("jump"))
    now = cut(ways, "ways")
    rounds = now.count().bit_length() + 1
    while not now.where("jump is not null").isEmpty():
        if not rounds:
            raise ValueError("propositions are their own parents in a circle")
        rounds -= 1
        ends = now.select(c("proposition_id").alias("jump"), c("low").alias("low_up"), c("mark").alias("mark_up"), c("jump").alias("next"))
        step = now.where("jump is not null").join(ends, "jump").select("proposition_id", F.least("low", "low_up").alias("low"), F.coalesce("mark", "mark_up").alias("mark"), c("next").alias("jump"))
        now = cut(now.where("jump is null").unionByName(step), "ways")
    final = F.coalesce("mark", exprs.rank_grade(c("low")))
    return graded.join(now.select("proposition_id", final.alias("final")), "proposition_id").withColumn("clamped", c("final") != c("grade"))
