"""Observations with membership, and counts of evidence for all propositions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, vocab


GATES = ["gate_a", "gate_b", "gate_c", "gate_d", "gate_e", "gate_f"]


def build_observations(raw: DataFrame, documents: DataFrame, propositions: DataFrame) -> DataFrame:
    """Raw observations with provenance of their documents, clamps, weights, membership and the reason of exclusion.

    Rows from negative searches take the register's own provenance and are verified about the search.
    An instance that is not bound to its subject becomes a class. Rows of the matrix take sign and
    magnitude from their two ordinals. A pending tier limits the magnitude to 2 and loses catalogue
    and ordinals; magnitude 4 needs the six gates, a T1 or T2 source, verification and instance scope.
    A row excludes the null by its catalogue entry (of any null or the proposition's own), else by its
    alternative (A0 or A1), or because it is of magnitude 4 on its face and by an authority.
    """
    return _excluding(_judged(_with_documents(_by_itself(raw), documents)), propositions).drop("raw_magnitude", "raw_sign", "catalog_excluding", "catalog_null", "null_id", "pending", "at")


def _at() -> Column:
    """The document's number as text; rows without one have a text of their own, so that they do not meet in one task."""
    nowhere = F.concat(F.lit("none "), F.pmod(F.xxhash64("proposition_id"), F.lit(4096)).cast("string"))
    return F.coalesce(F.col("document_id").cast("string"), nowhere)


def _with_documents(raw: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows beside their documents, by `at`."""
    docs = documents.select(F.col("document_id").cast("string").alias("at"), "tier", "channel", "causal", "era", "self_attesting", "echo", "model_family", F.coalesce("document_date", "first_observed").alias("document_date"))
    return raw.withColumn("at", _at()).join(docs, "at", "left")


def _own(name: str, value: str | bool) -> Column:
    """A column, or the register's own value for rows from negative searches."""
    return F.when(F.col("negative_search"), F.lit(value)).otherwise(F.col(name))


def _by_itself(raw: DataFrame) -> DataFrame:
    """Rows with scope, receipt state, sign and magnitude as they stand before their documents are known."""
    by_matrix = (F.col("source") == "MATRIX") & F.col("alternative").isNotNull() & ~F.col("negative_search")
    # a fold over an array rather than a chain of ANDs: the step is then compiled in parts that the JVM translates, not as one method too large for it
    return raw.withColumns({
        "scope": F.when(~F.col("bound") & (F.col("scope") == "INSTANCE"), "CLASS").otherwise(F.col("scope")), "receipt_state": _own("receipt_state", "VERIFIED"), "raw_sign": F.col("sign"),
        "sign": F.when(by_matrix, exprs.matrix_sign(F.col("expected"), F.col("alternative"))).otherwise(F.col("sign")),
        "raw_magnitude": F.when(by_matrix, exprs.matrix_magnitude(F.col("expected"), F.col("alternative"))).otherwise(F.col("raw_magnitude")),
        "gates": F.forall(F.array(*GATES), lambda g: g), "improbable": F.col("expected") == "E0",
    })


def _judged(o: DataFrame) -> DataFrame:
    """Everything of build_observations but what depends on the proposition's null; of rows beside their documents."""
    o = o.select(
        "observation_id", "proposition_id", "document_id", "negative_search", "mirror_only", "raw_magnitude", *GATES, "locus", "fact_key", "superseded", "rebutted", "asserted_on", "documents_null", "refutation_class", "in_basis",
        "model_family", "document_date", "source", "expected", "alternative", "catalog_excluding", "catalog_null", "at", "direct", "lawful", "georeferenced", "witness_id", "custody", "disagreed", "defaulted", "bound",
        "scope", "receipt_state", "raw_sign", "sign", "gates", "improbable",
        _own("tier", "T3").alias("prov_tier"), _own("channel", "ORIGIN-HOST").alias("prov_channel"), _own("causal", "UNSOLICITED").alias("prov_causal"), _own("era", "PRE-2022").alias("prov_era"),
        F.coalesce(_own("self_attesting", False), F.lit(False)).alias("self_attesting"), F.coalesce(_own("echo", False), F.lit(False)).alias("echo"),
    )
    gated = F.col("gates") & F.col("prov_tier").isin("T1", "T2") & (F.col("receipt_state") == "VERIFIED") & (F.col("scope") == "INSTANCE") & (F.col("prov_causal") == "UNSOLICITED")
    clamped = F.when((F.col("raw_magnitude") == 4) & ~gated, 3).otherwise(F.col("raw_magnitude"))
    pending = (F.col("prov_tier") == "PENDING") & (clamped > 2)
    o = o.withColumn("pending", F.coalesce(pending, F.lit(False))).withColumn("magnitude", F.when(F.col("pending"), 2).otherwise(clamped))
    o = o.withColumn("source", F.when(F.col("pending"), "DEFAULT").otherwise(F.col("source")))
    o = o.withColumn("signed_weight", exprs.signed_weight(F.col("sign"), F.col("magnitude")))
    return o.withColumn("membership", exprs.membership()).withColumn("exclusion_reason", exprs.exclusion_reason())


def _excluding(o: DataFrame, propositions: DataFrame, how: str = "left") -> DataFrame:
    """o with null_excluding. Joined last, so rows stay dealt by proposition."""
    o = o.join(propositions.select("proposition_id", "null_id"), "proposition_id", how)
    kept = lambda c: F.when(~F.col("pending"), F.col(c))
    by_catalog = kept("catalog_excluding") & (F.col("catalog_null").isNull() | (F.col("catalog_null") == F.col("null_id")))
    excluding = F.when(kept("catalog_excluding").isNotNull(), by_catalog).when(kept("alternative").isNotNull(), F.col("alternative").isin("A0", "A1")).otherwise(False)
    face = (F.col("magnitude") == 4) & F.col("gate_d") & F.col("gate_e")
    return o.withColumn("null_excluding", excluding | face)


def _n(condition):
    return F.count_if(condition)


def _tallies() -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """Conditions whose rows are counted, conditions that some row must meet, and what is added up, by name."""
    m, mag, claim = F.col("membership"), F.col("magnitude"), F.col("locus") == "CLAIM"
    v, vouched = m == "V", F.col("prov_tier").isin("T1", "T2")
    counted = {
        "n_v": v, "n_u": m == "U", "n_v0": m == "V0", "n_inert": m == "INERT",
        "n_v_claim": v & claim, "v_d4_claim": v & claim & (mag >= 4), "v_d2_claim": v & claim & (mag >= 2), "v_d1_claim": v & claim & (mag >= 1), "v_d1": v & (mag >= 1), "v_d0": v & (mag == 0), "v_d2": v & (mag >= 2),
        "solicited_d3": v & (mag >= 3) & ~F.col("prov_causal").isin(vocab.COUNTED_CAUSES), "unbound_d3": v & (mag >= 3) & (~F.col("bound") | (F.col("receipt_state") != "VERIFIED")),
    }
    met = {
        "has_t1t2": v & vouched, "mirror_d3": v & (mag >= 3) & F.col("mirror_only"), "dated_before_cut": v & (F.col("document_date") <= F.lit(vocab.CUT_DATE).cast("date")),
        "excl_d3": v & F.col("null_excluding") & (mag >= 3), "excl_d2": v & F.col("null_excluding") & (mag >= 2), "excl_any": v & F.col("null_excluding"),
        "null_documented": F.col("documents_null") & (F.col("receipt_state") == "VERIFIED") & vouched, "t1_place": v & (F.col("prov_tier") == "T1") & ~claim, "judged_apart": F.col("disagreed") | F.col("defaulted"),
    }
    return counted, met, {"place_weight": F.when(v & ~claim, mag), "claim_weight": F.when(v & claim, mag)}


def _met(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def counts(obs: DataFrame) -> DataFrame:
    """One row a proposition with observations: conditional counts in one pass."""
    counted, met, added = _tallies()
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in added.items()]
    return obs.groupBy("proposition_id").agg(*(_n(c).alias(k) for k, c in counted.items()), *(_met(c).alias(k) for k, c in met.items()), *sums)


#: Conditions that a row meets by itself, each a bit of `own`; and those of its document. A missing value meets none.
_ROW = ["V", "U", "V0", "INERT", "negative", "claim", "place", "off_claim", "fails", "unbound", "mirror", "documents_null", "apart", "r3", "r1", "unrebutted", "improbable", "in_person", "face", "excludes", "excludes_own", "placed"]
_DOCUMENT = ["inert", "vouched", "t1", "pending", "unfit", "counted", "uncounted", "dated"]
_BIT = {k: 1 << i for i, k in enumerate(_ROW + _DOCUMENT)}


def _mask(conditions: dict[str, Column], bits: dict[str, int]) -> Column:
    """The sum of the bits of conditions that hold; a fold for the reason given in _by_itself."""
    return F.aggregate(F.array(*(F.when(on, F.lit(bits[k])).otherwise(F.lit(0)) for k, on in conditions.items())), F.lit(0), lambda a, b: a + b).cast("long")


def _all(mask: Column, *names: str) -> Column:
    bits = sum(_BIT[k] for k in names)
    return mask.bitwiseAND(F.lit(bits).cast("long")) == F.lit(bits).cast("long")


def _any(mask: Column, *names: str) -> Column:
    return mask.bitwiseAND(F.lit(sum(_BIT[k] for k in names)).cast("long")) != F.lit(0).cast("long")


def _packed_rows(raw: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Rows as far as they can be judged without their documents: `own` has what they meet, with the membership that a faultless
    document leaves them; what only counts for V or U rows is left out of others."""
    c = F.col
    o = _by_itself(raw)
    verified = c("receipt_state") == "VERIFIED"
    row = F.when(c("superseded"), "INERT").when(c("receipt_state") != "VERIFIED", "V0").when((c("scope") != "INSTANCE") | (c("sign") == "NEUTRAL"), "INERT").when(c("sign") == "SUPPORTS", "V").otherwise("U")
    o = o.withColumn("row", row).withColumn("witnessed", F.when(c("direct") & c("lawful") & c("georeferenced") & c("custody").isin(HELD), c("witness_id")))
    resolvable = witnesses.where("resolvable and record_kind <> 'none'").select(c("witness_id").alias("witnessed"), F.lit(True).alias("resolvable"))
    ok = verified & ~c("negative_search") & ~c("rebutted")
    listed = c("catalog_excluding").isNotNull()
    met = {
        **{k: c("row") == k for k in ("V", "U", "V0", "INERT")}, "negative": c("negative_search"), "claim": c("locus") == "CLAIM", "place": c("locus") == "PLACE", "off_claim": c("locus") != "CLAIM",
        "fails": ~(c("gates") & verified & (c("scope") == "INSTANCE")), "unbound": ~c("bound") | ~verified, "mirror": c("mirror_only"), "documents_null": c("documents_null") & verified, "apart": c("disagreed") | c("defaulted"),
        "r3": (c("refutation_class") == "R3") & ok & (c("scope") == "INSTANCE") & c("gate_e") & c("in_basis"), "r1": (c("refutation_class") == "R1") & ok, "unrebutted": ~c("rebutted"), "improbable": c("improbable") & ~c("negative_search") & ~c("rebutted"),
        "in_person": c("resolvable"), "face": c("gate_d") & c("gate_e"), "placed": c("document_id").isNotNull(),
        "excludes": (c("catalog_excluding") & c("catalog_null").isNull()) | (~listed & c("alternative").isin("A0", "A1")), "excludes_own": c("catalog_excluding") & c("catalog_null").isNotNull(),
    }
    seen = c("row").isin("V", "U")
    return o.join(resolvable, "witnessed", "left").select(
        "proposition_id", _at().alias("at"), _mask(met, _BIT).alias("own"), F.when(c("row") == "V", F.when(met["excludes_own"], c("catalog_null"))).alias("catalog_null"),
        *(F.when(seen, c(k)).alias(k) for k in ("raw_magnitude", "observation_id", "fact_key", "asserted_on")),
    )


def _packed_documents(documents: DataFrame) -> DataFrame:
    """at, model_family and `of`: what a document means for its rows."""
    c = F.col
    met = {
        "inert": F.coalesce(c("channel") == "ADVERSARY-WRITABLE", F.lit(False)) | F.coalesce(~c("causal").isin(vocab.COUNTED_CAUSES), F.lit(False)) | F.coalesce(c("era") == "POST-2022-UNATTRIBUTED", F.lit(False)) | F.coalesce("self_attesting", F.lit(False)) | F.coalesce("echo", F.lit(False)),
        "vouched": c("tier").isin("T1", "T2"), "t1": c("tier") == "T1", "pending": c("tier") == "PENDING", "unfit": ~(c("tier").isin("T1", "T2") & (c("causal") == "UNSOLICITED")), "counted": c("causal").isin(vocab.COUNTED_CAUSES),
        "uncounted": ~c("causal").isin(vocab.COUNTED_CAUSES), "dated": F.coalesce("document_date", "first_observed") <= F.lit(vocab.CUT_DATE).cast("date"),
    }
    return documents.select(c("document_id").cast("string").alias("at"), "model_family", _mask(met, _BIT).alias("of"))


def all_counts(raw: DataFrame, documents: DataFrame, propositions: DataFrame, roots: DataFrame, witnesses: DataFrame) -> DataFrame:
    """counts, lineage_counts, undercut_flags, refuting_rows and direct_witnesses of every given proposition with rows, side by side.

    Rows move twice at most: to their documents, with what they meet by themselves in one number, and to their propositions,
    with the key of their lineage. There the strongest row of a fact is found, then rows are counted by lineage and lineages by proposition.
    """
    c, bits = F.col, lambda *names: F.lit(sum(_BIT[k] for k in names)).cast("long")
    o = _packed_rows(raw, witnesses).join(_packed_documents(documents), "at", "left").join(roots.select(c("node").cast("string").alias("at"), c("root").cast("string").alias("root")), "at", "left")
    of = F.coalesce("of", F.lit(0).cast("long"))
    of = F.when(_any(c("own"), "negative"), of.bitwiseAND(bits("dated")).bitwiseOR(bits("counted", "unfit"))).otherwise(of)  # the register's own search
    o = o.withColumn("mask", c("own").bitwiseOR(of))
    o = o.withColumn("magnitude", F.when((c("raw_magnitude") == 4) & _any(c("mask"), "fails", "unfit"), 3).otherwise(c("raw_magnitude")))
    pending, spoilt = _any(c("mask"), "pending") & (c("magnitude") > 2), _any(c("mask"), "V", "U") & _any(c("mask"), "inert")
    o = o.select(
        "proposition_id", "at", "root", "model_family", "observation_id", "fact_key", "asserted_on", "catalog_null", F.when(pending, 2).otherwise(c("magnitude")).alias("magnitude"),
        F.when(spoilt, c("mask").bitwiseAND(F.bitwise_not(bits("V", "U"))).bitwiseOR(bits("INERT"))).when(pending, c("mask").bitwiseAND(F.bitwise_not(bits("excludes", "excludes_own")))).otherwise(c("mask")).alias("mask"),
    )
    mask, mag = c("mask"), c("magnitude")
    v, u, placed = _any(mask, "V"), _any(mask, "U"), _any(mask, "placed")
    # the document's or family's lineage; rows without either have their own, by their ids
    line = F.when(v, F.when(c("model_family").isNotNull(), F.concat(F.lit("m"), "model_family")).when(placed, F.concat(F.lit("c"), F.coalesce("root", "at")))).when(placed & _all(mask, "U", "improbable") & (mag >= 2), F.concat(F.lit("u"), F.coalesce("root", "at")))
    narrow = o.select(
        "proposition_id", "mask", line.alias("line"), *(F.when(v | u, c(k)).alias(k) for k in ("magnitude", "fact_key", "observation_id", "asserted_on")), F.when(v, c("catalog_null")).alias("catalog_null"),
    )
    n = narrow.repartition("proposition_id").join(propositions.select("proposition_id", "null_id"), "proposition_id")  # once: what follows is all by proposition
    fact = Window.partitionBy("proposition_id", F.coalesce("fact_key", "observation_id")).orderBy(F.desc("v"), F.desc("magnitude"), "asserted_on", "observation_id").rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("v", v).withColumns({"k": F.row_number().over(fact), "answer": F.first(F.when(c("v"), mag)).over(fact)})  # V rows stand first, so the first one's magnitude is their greatest
    own = F.when(c("v") & _any(mask, "negative"), F.concat(F.lit("n"), "observation_id")).when(c("v"), F.concat(F.lit("o"), "observation_id")).when(_all(mask, "U", "improbable") & (mag >= 2), F.concat(F.lit("u"), "observation_id"))
    n = n.withColumn("line", F.when((c("k") == 1) | ~c("v"), F.coalesce("line", own)))
    n = n.withColumn("first", c("v") & (c("k") == 1)).withColumn("excluding", c("v") & (_any(mask, "excludes") | (_any(mask, "excludes_own") & (c("catalog_null") == c("null_id"))) | ((mag == 4) & _any(mask, "face"))))
    many = {
        **{f"n_{k.lower()}": _any(mask, k) for k in ("V", "U", "V0", "INERT")}, "n_v_claim": _all(mask, "V", "claim"), "v_d4_claim": _all(mask, "V", "claim") & (mag >= 4), "v_d2_claim": _all(mask, "V", "claim") & (mag >= 2), "v_d1_claim": _all(mask, "V", "claim") & (mag >= 1),
        "v_d1": c("v") & (mag >= 1), "v_d0": c("v") & (mag == 0), "v_d2": c("v") & (mag >= 2), "solicited_d3": _all(mask, "V", "uncounted") & (mag >= 3), "unbound_d3": _all(mask, "V", "unbound") & (mag >= 3), "n_direct": _all(mask, "V", "in_person"),
    }
    some = {
        "has_t1t2": _all(mask, "V", "vouched"), "mirror_d3": _all(mask, "V", "mirror") & (mag >= 3), "dated_before_cut": _all(mask, "V", "dated"), "excl_d3": c("excluding") & (mag >= 3), "excl_d2": c("excluding") & (mag >= 2), "excl_any": c("excluding"),
        "null_documented": _all(mask, "documents_null", "vouched"), "t1_place": _all(mask, "V", "t1", "off_claim"), "judged_apart": _any(mask, "apart"), "r3": _all(mask, "r3", "counted"), "r1": _any(mask, "r1"),
        "unrebutted_d3": _all(mask, "U", "unrebutted") & (mag >= 3) & (c("fact_key").isNull() | c("answer").isNull() | (c("answer") < mag)),
    }
    of_line = {"u": u, "d0": c("first") & (mag >= 0), "d2": c("first") & (mag >= 2), "d3": c("first") & (mag >= 3), "d3_claim": c("first") & (mag >= 3) & _any(mask, "claim"), "d2_place_excluding": c("first") & (mag >= 2) & _any(mask, "place") & c("excluding")}
    bit = {k: 1 << i for i, k in enumerate([*some, *of_line])}
    flag = lambda k: c("flags").bitwiseAND(F.lit(bit[k]).cast("long")) != 0
    n = n.withColumn("flags", _mask(some | of_line, bit))
    sums = {"place_weight": F.when(_all(mask, "V", "off_claim"), mag), "claim_weight": F.when(_all(mask, "V", "claim"), mag)}
    lines = n.groupBy("proposition_id", "line").agg(*(_n(x).alias(k) for k, x in many.items()), *(F.sum(x).alias(k) for k, x in sums.items()), F.bit_or("flags").alias("flags"))
    counted = c("line").isNotNull()
    out = lines.groupBy("proposition_id").agg(
        *(F.sum(k).alias(k) for k in many), *(F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in sums), F.bit_or("flags").alias("flags"),
        *(_n(counted & ~flag("u") & flag(k)).alias(f"l_{k}") for k in of_line if k != "u"), _n(counted & flag("u")).alias("u_lineages"),
    )
    return out.select("proposition_id", *many, *(flag(k).alias(k) for k in some), *sums, *(f"l_{k}" for k in of_line if k != "u"), "u_lineages")


def _keyed(obs: DataFrame, roots: DataFrame) -> DataFrame:
    """V rows, one a fact (the strongest, then the earliest, then the least id), with the key of their lineage.

    The strongest row of a fact is the same whatever the least magnitude asked for, so one pass serves all.
    Rows of one model family and rows of one citation component are one lineage. roots: node, root.
    """
    fact = Window.partitionBy("proposition_id", F.coalesce("fact_key", "observation_id")).orderBy(F.desc("magnitude"), "asserted_on", "observation_id")
    one = obs.where("membership = 'V'").withColumn("k", F.row_number().over(fact)).where("k = 1")
    return one.join(roots.withColumnRenamed("node", "document_id"), "document_id", "left").withColumn("lineage_key", _lineage_key())


def _lineage_key() -> Column:
    return (
        F.when(F.col("model_family").isNotNull(), F.concat(F.lit("model-family:"), "model_family"))
        .when(F.col("document_id").isNotNull(), F.concat(F.lit("component:"), F.coalesce("root", "document_id").cast("string")))
        .when(F.col("negative_search"), F.concat(F.lit("negative-search:"), "observation_id")).otherwise(F.concat(F.lit("orphan:"), "observation_id"))
    )


def lineage_rows(obs: DataFrame, roots: DataFrame, least: int) -> DataFrame:
    """Independent lineages of V rows of magnitude >= least: proposition_id, lineage_key, n_rows, has_claim, has_place_excluding, documents."""
    place = (F.col("locus") == "PLACE") & F.col("null_excluding")
    keyed = _keyed(obs, roots).where(F.col("magnitude") >= least)
    return keyed.groupBy("proposition_id", "lineage_key").agg(F.count("*").alias("n_rows"), F.bool_or(F.col("locus") == "CLAIM").alias("has_claim"), F.bool_or(place).alias("has_place_excluding"), F.count_distinct("document_id").alias("documents"))


def lineage_counts(obs: DataFrame, roots: DataFrame) -> DataFrame:
    """proposition_id with l_d0, l_d2, l_d3, l_d3_claim and l_d2_place_excluding."""
    m, place = F.col("magnitude"), (F.col("locus") == "PLACE") & F.col("null_excluding")
    lines = _keyed(obs, roots).groupBy("proposition_id", "lineage_key").agg(F.max("magnitude").alias("top"), F.bool_or((m >= 3) & (F.col("locus") == "CLAIM")).alias("claim3"), F.bool_or((m >= 2) & place).alias("place2"))
    return lines.groupBy("proposition_id").agg(
        _n(F.col("top") >= 0).alias("l_d0"), _n(F.col("top") >= 2).alias("l_d2"), _n(F.col("top") >= 3).alias("l_d3"), _n(F.col("claim3")).alias("l_d3_claim"), _n(F.col("place2")).alias("l_d2_place_excluding"),
    )


def undercut_flags(obs: DataFrame, roots: DataFrame) -> DataFrame:
    """proposition_id with unrebutted_d3 (a strong undercut nobody answers) and u_lineages (independent improbable undercuts)."""
    answers = obs.where("membership = 'V' and fact_key is not null").groupBy("proposition_id", "fact_key").agg(F.max("magnitude").alias("answer"))
    u = obs.where("membership = 'U'").join(answers, ["proposition_id", "fact_key"], "left").join(roots.withColumnRenamed("node", "document_id"), "document_id", "left")
    strong = (F.col("magnitude") >= 3) & ~F.col("rebutted") & (F.col("answer").isNull() | (F.col("answer") < F.col("magnitude")))
    return u.groupBy("proposition_id").agg(F.bool_or(strong).alias("unrebutted_d3"), F.count_distinct(F.when(_counted_undercut(), _undercut_key())).alias("u_lineages"))


def _counted_undercut() -> Column:
    return (F.col("membership") == "U") & (F.col("magnitude") >= 2) & F.col("improbable") & ~F.col("negative_search") & ~F.col("rebutted")


def _undercut_key() -> Column:
    return F.coalesce(F.coalesce("root", "document_id").cast("string"), "observation_id")


def refuting_rows(obs: DataFrame) -> DataFrame:
    """proposition_id with r3 (a listed contradiction by an authority) and r1 (a fabricated origin)."""
    r3, r1 = _refuting()
    return obs.where("refutation_class is not null").groupBy("proposition_id").agg(_met(r3).alias("r3"), _met(r1).alias("r1"))


def _refuting() -> tuple[Column, Column]:
    ok = (F.col("receipt_state") == "VERIFIED") & ~F.col("negative_search") & ~F.col("rebutted")
    r3 = (F.col("refutation_class") == "R3") & ok & (F.col("scope") == "INSTANCE") & F.col("prov_causal").isin(vocab.COUNTED_CAUSES) & F.col("gate_e") & F.col("in_basis")
    return r3, (F.col("refutation_class") == "R1") & ok


#: Kinds of custody that let a witness count.
HELD = ["interview", "quotation", "deposition", "accession"]


def attestations(obs: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Attested observations with `resolvable` (the witness stands in an unrelated record) and `held` (custody is known);
    without custody the statement's lineage is that of the asserting document."""
    a = obs.where("witness_id is not null").select("observation_id", "proposition_id", "membership", "witness_id", "custody", "document_id", "direct", "lawful", "georeferenced")
    a = a.join(witnesses.select("witness_id", (F.col("resolvable") & (F.col("record_kind") != "none")).alias("resolvable")), "witness_id", "left")
    held = F.col("custody").isin(HELD)
    return a.withColumn("resolvable", F.coalesce("resolvable", F.lit(False))).withColumn("held", held).withColumn("lineage_of", F.when(held, F.concat(F.lit("witness:"), F.col("witness_id").cast("string"))).otherwise(F.concat(F.lit("document:"), F.col("document_id").cast("string"))))


def direct_witnesses(obs: DataFrame, witnesses: DataFrame) -> DataFrame:
    """proposition_id with n_direct: V rows seen in person, lawfully, tied to the ground, by a resolvable witness in known custody."""
    ok = F.col("direct") & F.col("lawful") & F.col("georeferenced") & F.col("resolvable") & F.col("held") & (F.col("membership") == "V")
    return attestations(obs, witnesses).groupBy("proposition_id").agg(_n(ok).alias("n_direct"))


def search(profiles: DataFrame) -> DataFrame:
    """proposition_id with the numbers of applicable and searched profiles, the index and flags for the reading of silence."""
    counted = F.col("applicable") & F.col("resolved_x").isin("X1", "X2", "X3")
    found = F.col("searched") | F.col("outcome").isin("POSITIVE", "NEGATIVE")
    s = profiles.groupBy("proposition_id").agg(
        F.coalesce(F.bool_or(F.col("applicable") & (F.col("override") == "RECORD-DESTROYED")), F.lit(False)).alias("destroyed"), _n(counted).cast("long").alias("search_n"), _n(counted & F.coalesce(found, F.col("searched"))).cast("long").alias("search_k"), F.coalesce(F.bool_or(counted & (F.col("outcome") == "NEGATIVE")), F.lit(False)).alias("negative_receipt")
    )
    index = F.when(F.col("search_n") == 0, F.lit(1000)).otherwise(F.round(F.col("search_k") * 1000 / F.col("search_n"))).cast("long")
    reading = F.when(F.col("destroyed"), "RECORD-DESTROYED").when(F.col("search_n") == 0, "UNINFORMATIVE").when(F.col("search_k") == 0, "UNSEARCHED").when(F.col("negative_receipt"), "INFORMATIVE").otherwise("UNSEARCHED")
    return s.withColumn("search_index", index).withColumn("silence", reading)
