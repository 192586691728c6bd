"""DuckDB SQL of the evidence engine: shared common table expressions and a query's own part."""

from __future__ import annotations

from ..functions import vocab
from ..sources import fixture

_DOC = "case when negative_search then {v} else {c} end"

_SIGN = "case expected || alternative " + " ".join(f"when '{e}{x}' then '{v[0]}'" for (e, x), v in vocab.MATRIX.items()) + " end"
_MAGNITUDE = "case expected || alternative " + " ".join(f"when '{e}{x}' then {v[1]}" for (e, x), v in vocab.MATRIX.items()) + " end"

OBS = f"""
obs0 as (select r.* exclude (scope, receipt_state, sign), case when not bound and scope = 'INSTANCE' then 'CLASS' else scope end as scope, {_DOC.format(v="'VERIFIED'", c="receipt_state")} as receipt_state, null_id, model_family, coalesce(document_date, first_observed) as document_date,
  source = 'MATRIX' and alternative is not null and not negative_search as by_matrix, case when source = 'MATRIX' and alternative is not null and not negative_search then {_SIGN} else sign end as sign, expected = 'E0' as improbable, gate_a and gate_b and gate_c and gate_d and gate_e and gate_f as gates,
  {_DOC.format(v="'T3'", c="tier")} as prov_tier, {_DOC.format(v="'ORIGIN-HOST'", c="channel")} as prov_channel, {_DOC.format(v="'UNSOLICITED'", c="causal")} as prov_causal,
  {_DOC.format(v="'PRE-2022'", c="era")} as prov_era, coalesce({_DOC.format(v="false", c="self_attesting")}, false) as self_attesting, coalesce({_DOC.format(v="false", c="echo")}, false) as echo
  from raw_observation r left join document d using (document_id) left join (select proposition_id, null_id from proposition) p using (proposition_id)),
obs1 as (select * exclude (raw_magnitude), case when by_matrix then {_MAGNITUDE} else raw_magnitude end as raw_magnitude from obs0),
obs2 as (select *, case when raw_magnitude = 4 and not (gates and prov_tier in ('T1', 'T2') and receipt_state = 'VERIFIED' and scope = 'INSTANCE' and prov_causal = 'UNSOLICITED') then 3 else raw_magnitude end as m0 from obs1),
obs3 as (select *, coalesce(prov_tier = 'PENDING' and m0 > 2, false) as pending, case when prov_tier = 'PENDING' and m0 > 2 then 2 else m0 end as magnitude from obs2),
obs as (select * exclude (source), case when pending then 'DEFAULT' else source end as source, case when magnitude = 4 and gate_d and gate_e then true when pending then false when catalog_excluding is not null then catalog_excluding and (catalog_null is null or catalog_null = null_id) when alternative is not null then alternative in ('A0', 'A1') else false end as null_excluding,
  case sign when 'SUPPORTS' then magnitude when 'UNDERCUTS' then -magnitude else 0 end as signed_weight,
  case when superseded then 'superseded' when receipt_state <> 'VERIFIED' then 'receipt not verified' when scope <> 'INSTANCE' then 'scope is not the instance' when prov_channel = 'ADVERSARY-WRITABLE' then 'writable channel'
    when prov_causal not in ('UNSOLICITED', 'SOLICITED-3P') then 'solicited or self-published' when prov_era = 'POST-2022-UNATTRIBUTED' then 'unattributed era' when self_attesting then 'self-attesting' when echo then 'echo of the register' when sign = 'NEUTRAL' then 'neutral' end as exclusion_reason,
  case when superseded then 'INERT' when receipt_state <> 'VERIFIED' then 'V0' when scope <> 'INSTANCE' or prov_channel = 'ADVERSARY-WRITABLE' or prov_causal not in ('UNSOLICITED', 'SOLICITED-3P') or prov_era = 'POST-2022-UNATTRIBUTED'
    or self_attesting or echo or sign = 'NEUTRAL' then 'INERT' when sign = 'SUPPORTS' then 'V' else 'U' end as membership from obs3)"""

ROOTS = """
both_ways as (select citing as x, cited as y from citation where collapses union select cited, citing from citation where collapses),
reach(x, y) as (select distinct x, x from both_ways union select r.x, e.y from reach r join both_ways e on r.y = e.x),
roots as (select x as node, min(y) as root from reach group by x)"""


def _lineage(k: int) -> str:
    return f"""
lin{k} as (select proposition_id, case when model_family is not null then 'model-family:' || model_family when document_id is not null then 'component:' || coalesce(root, document_id) when negative_search then 'negative-search:' || observation_id else 'orphan:' || observation_id end as lineage_key,
  count(*) as n_rows, bool_or(locus = 'CLAIM') as has_claim, bool_or(locus = 'PLACE' and null_excluding) as has_place_excluding, count(distinct document_id) as documents
  from (select *, row_number() over (partition by proposition_id, coalesce(fact_key, observation_id) order by magnitude desc, asserted_on, observation_id) as k from obs where membership = 'V' and magnitude >= {k}) o
  left join roots on node = document_id where k = 1 group by 1, 2)"""


LINEAGES = ",".join(_lineage(k) for k in (0, 2, 3)) + """,
lcounts as (select proposition_id, count(*) filter (where k = 0) as l_d0, count(*) filter (where k = 2) as l_d2, count(*) filter (where k = 3) as l_d3, count(*) filter (where k = 3 and has_claim) as l_d3_claim,
  count(*) filter (where k = 2 and has_place_excluding) as l_d2_place_excluding from (select *, 0 as k from lin0 union all select *, 2 from lin2 union all select *, 3 from lin3) t group by 1)"""

COUNTS = f"""
counts as (select proposition_id, count(*) filter (where membership = 'V') as n_v, count(*) filter (where membership = 'U') as n_u, count(*) filter (where membership = 'V0') as n_v0, count(*) filter (where membership = 'INERT') as n_inert,
  count(*) filter (where membership = 'V' and locus = 'CLAIM') as n_v_claim, count(*) filter (where membership = 'V' and locus = 'CLAIM' and magnitude >= 4) as v_d4_claim, count(*) filter (where membership = 'V' and locus = 'CLAIM' and magnitude >= 2) as v_d2_claim,
  count(*) filter (where membership = 'V' and locus = 'CLAIM' and magnitude >= 1) as v_d1_claim, count(*) filter (where membership = 'V' and magnitude >= 1) as v_d1, count(*) filter (where membership = 'V' and magnitude = 0) as v_d0, count(*) filter (where membership = 'V' and magnitude >= 2) as v_d2,
  coalesce(bool_or(membership = 'V' and prov_tier in ('T1', 'T2')), false) as has_t1t2, coalesce(bool_or(membership = 'V' and magnitude >= 3 and mirror_only), false) as mirror_d3, coalesce(bool_or(membership = 'V' and document_date <= date '{vocab.CUT_DATE}'), false) as dated_before_cut,
  coalesce(bool_or(membership = 'V' and null_excluding and magnitude >= 3), false) as excl_d3, coalesce(bool_or(membership = 'V' and null_excluding and magnitude >= 2), false) as excl_d2, coalesce(bool_or(membership = 'V' and null_excluding), false) as excl_any,
  coalesce(bool_or(documents_null and receipt_state = 'VERIFIED' and prov_tier in ('T1', 'T2')), false) as null_documented,
  count(*) filter (where membership = 'V' and magnitude >= 3 and prov_causal not in ('UNSOLICITED', 'SOLICITED-3P')) as solicited_d3, count(*) filter (where membership = 'V' and magnitude >= 3 and (not bound or receipt_state <> 'VERIFIED')) as unbound_d3,
  coalesce(bool_or(membership = 'V' and prov_tier = 'T1' and locus = 'PLACE'), false) as t1_place, coalesce(bool_or(disagreed or defaulted), false) as judged_apart,
  coalesce(sum(magnitude) filter (where membership = 'V' and locus = 'PLACE'), 0)::bigint as place_weight, coalesce(sum(magnitude) filter (where membership = 'V' and locus = 'CLAIM'), 0)::bigint as claim_weight from obs group by 1),
undercuts as (select proposition_id, bool_or(magnitude >= 3 and not rebutted and (answer is null or answer < magnitude)) as unrebutted_d3,
  count(distinct case when magnitude >= 2 and improbable and not negative_search and not rebutted then coalesce(coalesce(root, document_id)::varchar, observation_id) end) as u_lineages
  from obs o left join (select proposition_id as p, fact_key as f, max(magnitude) as answer from obs where membership = 'V' and fact_key is not null group by 1, 2) a on p = proposition_id and f = fact_key left join roots on node = document_id where membership = 'U' group by 1),
refuting as (select proposition_id, coalesce(bool_or(refutation_class = 'R3' and receipt_state = 'VERIFIED' and not negative_search and not rebutted and scope = 'INSTANCE' and prov_causal in ('UNSOLICITED', 'SOLICITED-3P') and gate_e and in_basis), false) as r3,
  coalesce(bool_or(refutation_class = 'R1' and receipt_state = 'VERIFIED' and not negative_search and not rebutted), false) as r1 from obs where refutation_class is not null group by 1),
attested as (select observation_id, proposition_id, membership, o.witness_id, custody, document_id, direct, lawful, georeferenced, coalesce(w.resolvable and record_kind <> 'none', false) as resolvable, custody in ('interview', 'quotation', 'deposition', 'accession') as held,
  case when custody in ('interview', 'quotation', 'deposition', 'accession') then 'witness:' || o.witness_id else 'document:' || document_id end as lineage_of from obs o left join witness w on w.witness_id = o.witness_id where o.witness_id is not null),
direct_witnesses as (select proposition_id, count(*) filter (where direct and lawful and georeferenced and resolvable and held and membership = 'V') as n_direct from attested group by 1),
searched as (select *, case when search_n = 0 then 1000 else (2 * search_k * 1000 + search_n) // (2 * search_n) end as search_index, case when destroyed then 'RECORD-DESTROYED' when search_n = 0 then 'UNINFORMATIVE' when search_k = 0 then 'UNSEARCHED' when negative_receipt then 'INFORMATIVE' else 'UNSEARCHED' end as silence from (
  select proposition_id, count(*) filter (where applicable and resolved_x <> 'X0') as search_n, count(*) filter (where applicable and resolved_x <> 'X0' and (searched or coalesce(outcome in ('POSITIVE', 'NEGATIVE'), false))) as search_k,
    coalesce(bool_or(applicable and override = 'RECORD-DESTROYED'), false) as destroyed,
    coalesce(bool_or(applicable and resolved_x <> 'X0' and outcome = 'NEGATIVE'), false) as negative_receipt from profile group by 1) s)"""

_N = ["n_v", "n_u", "n_v0", "n_inert", "n_v_claim", "v_d4_claim", "v_d2_claim", "v_d1_claim", "v_d1", "v_d0", "v_d2", "l_d0", "l_d2", "l_d3", "l_d3_claim", "l_d2_place_excluding", "u_lineages", "place_weight", "claim_weight", "search_n", "search_k", "search_index", "n_direct", "solicited_d3", "unbound_d3"]
_B = ["t1_place", "judged_apart", "destroyed", "has_t1t2", "mirror_d3", "dated_before_cut", "excl_d3", "excl_d2", "excl_any", "null_documented", "unrebutted_d3", "r3", "r1"]

WIDE = (
    "\nwide0 as (select p.*, coalesce(silence, 'UNINFORMATIVE') as silence, " + ", ".join([f"coalesce({c}, 0) as {c}" for c in _N] + [f"coalesce({c}, false) as {c}" for c in _B])
    + " from proposition p left join direct_witnesses using (proposition_id) left join counts using (proposition_id) left join lcounts using (proposition_id) left join undercuts using (proposition_id) left join refuting using (proposition_id) left join searched using (proposition_id)),"
    + """
wide1 as (select *, case when not null_selected then 'UNTESTED' when excl_d3 then 'EXCLUDED' when excl_d2 then 'INSUFFICIENT' when null_documented and not excl_any then 'DOMINANT' else 'SURVIVING' end as null_state from wide0),
wide as (select *, case when r3 then 'R3' when u_lineages >= 2 and null_state = 'DOMINANT' and r2_proposed then 'R2' when r1 and l_d0 <= 1 then 'R1' else 'R0' end as refutation from wide1)"""
)

_RANK = "case {g} when 'A' then 7 when 'B' then 6 when 'C' then 5 when 'D' then 4 when 'E' then 3 when 'F' then 2 end"
_UNRANK = "case {r} when 7 then 'A' when 6 then 'B' when 5 then 'C' when 4 then 'D' when 3 then 'E' when 2 then 'F' end"


def _evaluate(prefix: str, source: str, c1c: str) -> str:
    place = "class in ('EXIST', 'EXTENT', 'LOCATE', 'FEATURE', 'TYPOLOGY')"
    caps = [
        ("CAP-1", "l_d2 <= 1 and not A1 and not A1alt", 5), ("CAP-2a", f"n_v_claim = 0 and {place}", 4), ("CAP-2b", f"n_v_claim = 0 and not {place}", 3), ("CAP-3", "citogenesis", 3), ("CAP-4", "n_v > 0 and not dated_before_cut", 4),
        ("CAP-5", "n_v = 0", 2), ("CAP-6", "mirror_d3 and not A6", 6), ("CAP-7", "null_state = 'UNTESTED'", 4), ("CAP-C1c", "C1c and not C1a and not C1b", 5),
    ]
    low = "least(" + ", ".join([_RANK.format(g="awarded")] + [f"case when {on} then {r} else 7 end" for _, on, r in caps]) + ")"
    names = "concat_ws(',', " + ", ".join(f"case when awarded <> 'R' and {on} then '{n}' end" for n, on, _ in caps) + ")"
    return f"""
{prefix}1 as (select *, v_d4_claim >= 1 or l_d3_claim >= 2 as A1, class in ('EXIST', 'EXTENT', 'LOCATE', 'FEATURE') and n_direct >= 2 and t1_place as A1alt, unbound_d3 = 0 as A2, solicited_d3 = 0 as A5, not unrebutted_d3 as B3, not unrebutted_d3 as C3, null_state = 'EXCLUDED' as A3, not unrebutted_d3 as A4, not mirror_d3 or l_d2 >= 2 as A6, l_d3 >= 2 or (l_d2 >= 3 and has_t1t2) as B1, null_state in ('EXCLUDED', 'INSUFFICIENT') as B2, n_v_claim >= 1 as B4,
  v_d2_claim >= 1 as C1a, l_d2_place_excluding >= 2 as C1b, {c1c} as C1c, null_state <> 'UNTESTED' as C2, v_d1 >= 1 or v_d0 >= 2 as D1, null_state in ('SURVIVING', 'DOMINANT', 'UNTESTED') as D2, n_v > 0 as E1, v_d2 = 0 as E2 from {source}),
{prefix}2 as (select *, case when refutation <> 'R0' then 'R' when (A1 or A1alt) and A2 and A3 and A4 and A5 and A6 then 'A' when B1 and B2 and B3 and B4 then 'B' when (C1a or C1b or C1c) and C2 and C3 then 'C' when D1 and D2 then 'D' when E1 and E2 then 'E' else 'F' end as awarded from {prefix}1),
{prefix}3 as (select *, {names} as cap_names, case when awarded = 'R' then 'R' else {_UNRANK.format(r=low)} end as capped from {prefix}2),
{prefix}4 as (select *, case when search_index < 500 and capped in ('D', 'E', 'F') then 'X' else capped end as grade, case when search_index < 500 and capped in ('D', 'E', 'F') then concat_ws(',', nullif(cap_names, ''), 'SCI-FLOOR') else cap_names end as cap_text,
  case when citogenesis then 'E' when search_n = 0 and n_v_claim = 0 and {place} then 'D' when search_n = 0 and n_v_claim = 0 then 'E' else 'A' end as ceiling from {prefix}3),
{prefix}5 as (select *, (l_d2 = 2 and grade = 'B') or (l_d3 = 2 and grade in ('A', 'B')) or (l_d2 = 1 and grade = 'C') or judged_apart as marginal, grade = ceiling as at_ceiling,
  case grade when 'A' then null when 'B' then case when not A1 and not A1alt then 'A1' when not A2 then 'A2' when not A3 then 'A3' when not A4 then 'A4' when not A5 then 'A5' else 'A6' end when 'C' then case when not B1 then 'B1' when not B2 then 'B2' when not B3 then 'B3' else 'B4' end
    when 'D' then case when not (C1a or C1b or C1c) then 'C1' when not C2 then 'C2' else 'C3' end when 'E' then case when not D1 then 'D1' else 'D2' end when 'F' then case when not E1 then 'E1' else 'E2' end
    when 'X' then 'insufficient search (' || search_k || ' of ' || search_n || ')' else 'refuted: ' || refutation end as limiting0, case when citogenesis then 'citogenesis' when search_n = 0 and n_v_claim = 0 then 'no record of the claim is expected' end as ceiling_reason from {prefix}4),
{prefix} as (select * exclude (limiting0), case when cap_text <> '' and grade <> awarded then coalesce(limiting0, '') || ' [capped by ' || replace(cap_text, ',', ', ') || ']' else limiting0 end as limiting from {prefix}5)"""


GRADED = (
    _evaluate("first_pass", "wide", "false")
    + """,
sets as (select candidate_set_id, count(distinct entity_id) as members, bool_or(grade in ('A', 'B') and class = 'PROGRAM') as program, any_value(documented) as documented from first_pass join candidate_set using (candidate_set_id) where candidate_set_id is not null group by 1),
with_sets as (select w.*, coalesce(members <= 3 * documented and program, false) as program_ok from wide w left join sets using (candidate_set_id)),"""
    + _evaluate("graded", "with_sets", "program_ok and v_d1_claim >= 1")
    + f""",
fin(proposition_id, final) as (select proposition_id, grade from graded where class in ('EXIST', 'PROGRAM', 'ORIGIN') or parent_id is null
  union all select g.proposition_id, case when f.final in ('R', 'X') or g.grade in ('R', 'X') then g.grade else {_UNRANK.format(r="least(" + _RANK.format(g="g.grade") + ", " + _RANK.format(g="f.final") + ")")} end
  from fin f join graded g on g.parent_id = f.proposition_id and not (class in ('EXIST', 'PROGRAM', 'ORIGIN'))),
final as (select g.*, f.final from graded g join fin f using (proposition_id))"""
)

_PARTS = {"fixture": fixture.ctes(), "obs": OBS.strip(), "roots": ROOTS.strip(), "lineages": LINEAGES.strip(), "counts": COUNTS.strip(), "wide": WIDE.strip(), "graded": GRADED.strip()}
_ORDER = list(_PARTS)


def world(name: str, tables: dict[str, str], select: str) -> str:
    """An expression that holds what `select` finds in a register some of whose tables are others: everything from the observations on is computed again inside."""
    inner = [f"{table} as ({text})" for table, text in tables.items()] + [_PARTS[k] for k in _ORDER[1:]]
    return f"{name} as (with recursive " + ",\n".join(inner) + f"\n{select})"


def sql(body: str, upto: str = "fixture") -> str:
    """body under all common table expressions up to the named part; more expressions may stand in body before `=>`."""
    own, _, select = body.rpartition("=>")
    parts = [_PARTS[k] for k in _ORDER[: _ORDER.index(upto) + 1]] + ([own.strip()] if own.strip() else [])
    return "with recursive " + ",\n".join(parts) + "\n" + select.strip()
