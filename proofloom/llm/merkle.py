"""Operator 13, Merkle dataset manifest.

Each row is a leaf. The leaves of a source stand in ascending order of doc_id (nulls first; rows
that share one by their leaf), and every three consecutive nodes become the hash of their joined
digests until one, the source's subroot, is left; the subroots in order of their sources (null
first) become the root likewise.

The work goes by superblocks of 3**DEPTH consecutive nodes, so that no task sees more of a tree than
that, however many rows a source has. Going up, each superblock is reduced to its node, and these
nodes are the next, far smaller row of the tree. Going down, the nodes of a row and what they need from
outside, the siblings of their superblock's node up to the root, are cogrouped by superblock in
applyInPandas: there the local reduction is finished, the proofs of all nodes are joined from local
and outer siblings, and changed leaves are folded up to the root along them. Superblocks of small
sources share groups.

Places within a source come from a range shuffle: the rows of a source in one partition are
consecutive, so a row's place is its number there and the rows of the source before, and no window
spans a source. Nulls in any column are `-` in the leaf; repeated rows are leaves of their own; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Levels of the tree that a superblock reduces: 3**DEPTH nodes.
DEPTH = 8
FAN = 3
#: Rows that share a group where sources are small.
GROUP_ROWS = 5000

_FIELDS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}


def _sha(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_hash(text: Column) -> Column:
    """The leaf of a row whose text is given; the other fields are read from the columns."""
    values = [F.col(c).cast("string") if c != "text" else text for c in _FIELDS]
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _ranked(rows: DataFrame, tree: str | None, order: list[str], name: str) -> DataFrame:
    """rows with idx, their place from 0 in their tree (None: one tree), and n, the tree's number of rows.

    tree is a nullable column; the rows of a tree that a range partition holds stand together in it.
    """
    keys = [*([tree] if tree else []), *order]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = common.cut(spread.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), name)
    by = [F.col(tree).eqNullSafe(F.col("t"))] if tree else []
    group = ["part", *([tree] if tree else [])]
    runs = placed.groupBy(*group).agg(F.min("at").alias("first"), F.count("*").alias("held"))
    before = Window.partitionBy(*([tree] if tree else [])).orderBy("part")  # one row a partition that holds any of the tree
    whole = Window.partitionBy(*([tree] if tree else []))
    runs = runs.select(F.col("part").alias("p"), *([F.col(tree).alias("t")] if tree else []), (F.sum("held").over(before) - F.col("held") - F.col("first")).alias("shift"), F.sum("held").over(whole).alias("n"))
    joined = placed.join(runs, [placed["part"] == runs["p"], *by])
    return joined.select(*rows.columns, (F.col("at") + F.col("shift")).alias("idx"), "n")


def reduce_block(nodes: list[str], n: int, depth: int) -> list[list[str]]:
    """The rows of a superblock from its nodes up to its own: `depth` levels, or fewer where the tree, which has n nodes in this row, ends before."""
    rows = [nodes]
    while n > 1 and len(rows) <= depth:
        now = rows[-1]
        rows.append([_sha("".join(now[i : i + FAN])) for i in range(0, len(now), FAN)])
        n = -(-n // FAN)
    return rows


def steps_of(rows: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Left and right siblings of node i of a superblock, level by level."""
    out = []
    for row in rows[:-1]:
        run = i - i % FAN
        out.append(("".join(row[run:i]), "".join(row[i + 1 : run + FAN])))
        i //= FAN
    return out


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        node = _sha(left + node + right)
    return node


def _pack(steps: list[tuple[str, str]]) -> str:
    return ";".join(f"{left},{right}" for left, right in steps)


def _unpack(steps: str) -> list[tuple[str, str]]:
    return [tuple(s.split(",")) for s in steps.split(";")] if steps else []


def _blocks(frame: pd.DataFrame):
    """(tree, block) and the frame of each superblock in a group, in order."""
    frame = frame.sort_values("idx", kind="stable")
    for key, block in frame.groupby(["tree", "block"], dropna=False, sort=False):
        yield (None if pd.isna(key[0]) else key[0], int(key[1])), block


def _grouped(rows: DataFrame, depth: int) -> DataFrame:
    """rows (tree, idx, n) with their superblock and the group that it is worked on in; superblocks of trees that have but one share groups."""
    size = FAN**depth
    small = rows.where(F.col("n") <= size).agg(F.count("*").alias("few"))
    block = F.floor(F.col("idx") / size).cast("long")
    lots = F.greatest(F.lit(1), F.floor(F.col("few") / GROUP_ROWS))
    group = F.when(F.col("n") > size, F.xxhash64("tree", "block")).otherwise(F.xxhash64(F.pmod(F.xxhash64("tree"), lots)))
    return rows.withColumn("block", block).crossJoin(F.broadcast(small)).withColumn("group", group).drop("few")


def _climb(rows: DataFrame, depth: int) -> list[DataFrame]:
    """Rows of the trees, each (tree, idx, n, node, block, group) written: the leaves, the nodes of their superblocks, and so on to one a tree."""

    def up(frame: pd.DataFrame) -> pd.DataFrame:
        out = [(tree, block, int(b["n"].iloc[0]), reduce_block(b["node"].tolist(), int(b["n"].iloc[0]), depth)[-1][0]) for (tree, block), b in _blocks(frame)]
        return pd.DataFrame(out, columns=["tree", "idx", "n", "node"])

    found = []
    while True:
        found.append(common.cut(_grouped(rows, depth), "merkle-row"))
        if found[-1].where(F.col("n") > 1).isEmpty():
            return found
        nodes = found[-1].where(F.col("n") > 1).select("tree", "idx", "n", "node", "block", "group")
        rows = common.cut(nodes.groupBy("group").applyInPandas(up, "tree string, idx long, n long, node string"), "merkle-up").withColumn("n", F.ceil(F.col("n") / FAN**depth).cast("long"))


#: Columns of what a superblock of the row below needs from outside.
_STEPS = "tree string, block long, top string, subroot string, steps string"


def _down(depth: int, last, final: bool):
    """Finishes superblocks with what they need from outside: the rows of `last` where final, else what each node's own superblock will need."""

    def run(nodes: pd.DataFrame, needs: pd.DataFrame) -> pd.DataFrame:
        known = {(None if pd.isna(r.tree) else r.tree, int(r.block)): r for r in needs.rename(columns=lambda c: c.removeprefix("of_")).itertuples(index=False)}
        out = []
        for (tree, block), b in _blocks(nodes):
            r, rows = known[tree, block], reduce_block(b["node"].tolist(), int(b["n"].iloc[0]), depth)
            beyond = _unpack(r.steps)
            for i, row in enumerate(b.itertuples(index=False)):
                steps = steps_of(rows, i) + beyond
                out.append(last(row, steps, r) if final else (tree, int(row.idx), r.top, r.subroot, _pack(steps)))
        return pd.DataFrame(out, columns=last.columns if final else [f.split()[0] for f in _STEPS.split(", ")])

    return run


def _descend(found: list[DataFrame], outer: DataFrame, depth: int, last) -> DataFrame:
    """The leaves with their proofs. outer: tree, root, subroot and steps from the tree's own root on; last: makes the result's rows of a leaf's."""
    for k in reversed(range(len(found))):
        # superblocks of trees that end here need what their tree needs, others what the node above needs
        single = outer.join(found[k].where("idx = 0 and n <= " + str(FAN**depth)).select(F.col("tree").alias("t"), "group"), F.col("tree").eqNullSafe(F.col("t"))).select("tree", F.lit(0).cast("long").alias("block"), "top", "subroot", "steps", "group")
        need = single
        if k + 1 < len(found):
            above = found[k].where((F.col("n") > FAN**depth) & (F.col("idx") % FAN**depth == 0)).select(F.col("tree").alias("t"), F.col("block").alias("b"), "group")
            need = need.unionByName(above.join(told, (F.col("tree").eqNullSafe(F.col("t"))) & (F.col("block") == F.col("b"))).select("tree", "block", "top", "subroot", "steps", "group"))
        final = k == 0
        told = found[k].groupBy("group").cogroup(need.select(*(F.col(c).alias(f"of_{c}") for c in need.columns)).groupBy("of_group")).applyInPandas(_down(depth, last, final), last.schema if final else _STEPS)
        if not final:
            told = common.cut(told, "merkle-down")
    return told


class _Subroot:
    """Rows of the tree of sources: each source's subroot with the root and the way there."""

    schema = "tree string, top string, subroot string, steps string"
    columns = ["tree", "top", "subroot", "steps"]

    def __call__(self, row, steps, outer):
        return (None if pd.isna(row.source) else row.source, fold(row.node, steps), row.node, _pack(steps))


class _Proof:
    """Rows of the result: proof and fold of each leaf."""

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def __call__(self, row, steps, outer):
        folded = fold(row.changed, steps)
        doc = None if pd.isna(row.doc_id) else int(row.doc_id)
        return (doc, row.node, outer.subroot, outer.top, _sha("".join(left + right for left, right in steps)), folded, folded == outer.top)


def manifest(docs: DataFrame, changed: Column, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of every row as it is, and folded_root and verified of the row with the text that `changed` gives."""
    rows = common.columns(docs, **{c: (c, t) for c, t in _FIELDS.items()})
    leaves = common.cut(rows.select("source", "doc_id", leaf_hash(F.col("text")).alias("node"), leaf_hash(changed).alias("changed")), "leaves")
    # doc_id travels as text so that pandas keeps whole numbers beside nulls
    ranked = _ranked(leaves, "source", ["doc_id", "node"], "leaf-order").select(F.col("source").alias("tree"), F.col("doc_id").cast("string").alias("doc_id"), "node", "changed", "idx", "n")
    found = _climb(ranked, depth)
    ends = [f.where("n = 1").select("tree", "node") for f in found]
    subroots = ends[0]
    for e in ends[1:]:
        subroots = subroots.unionByName(e)
    sources = _ranked(common.cut(subroots.withColumnRenamed("tree", "source"), "subroots"), None, ["source"], "source-order").withColumn("tree", F.lit(None).cast("string"))
    above = _climb(sources, depth)
    spark = docs.sparkSession
    nothing = spark.range(1).select(F.lit(None).cast("string").alias("tree"), F.lit("").alias("top"), F.lit("").alias("subroot"), F.lit("").alias("steps"))
    outer = common.cut(_descend(above, nothing, depth, _Subroot()), "source-proofs")
    return _descend(found, outer, depth, _Proof())


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof; rows with an even checksum of their doc_id are folded as if newlines were deleted from their text."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    changed = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest(common.read(spark, sf_dir, "documents"), changed)


def _op13_sql(levels: int = 18, tops: int = 8) -> str:
    """DuckDB SQL with one expression a level: enough for 3**levels rows a source and 3**tops sources."""
    field = lambda v: f"case when {v} is null then '-' else octet_length(encode({v}::varchar)) || ':' || {v} end"
    leaf = lambda text: "sha256(" + " || ".join(field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # the checksum, bit by bit
    crc = "list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::bigint, 1))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: k::bigint)), lambda x, k: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))"
    # the last step complements all bits, so an even checksum is an odd remainder
    changed = f"case when {crc} % 2 = 1 then replace(text, chr(10), '') else text end"
    parts = [
        f"d as (select doc_id, coalesce('s' || source, '') as tree, {leaf('text')} as leaf, {leaf(f'({changed})')} as changed, source from documents)",
        "r0 as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, leaf as node, changed as folded, '' as proof from d)",
        "t0 as (select tree, idx, node from r0)",
    ]

    def level(t: str, r: str, k: int) -> list[str]:
        return [
            f"{t}k{k} as (select tree, idx // 3 as up, list(node order by idx) as kids, max(count(*)) over (partition by tree) > 1 or count(*) over (partition by tree) > 1 as more from {t}{k} group by 1, 2)",
            f"{t}{k + 1} as (select tree, up as idx, case when more then sha256(array_to_string(kids, '')) else kids[1] end as node from {t}k{k})",
            f"{r}{k + 1} as (select r.* exclude (idx, folded, proof), r.idx // 3 as idx, case when more then sha256(array_to_string(kids[1:(r.idx % 3)::bigint], '') || folded || array_to_string(kids[(r.idx % 3 + 2)::bigint:], '')) else folded end as folded, proof || case when more then array_to_string(kids[1:(r.idx % 3)::bigint], '') || array_to_string(kids[(r.idx % 3 + 2)::bigint:], '') else '' end as proof from {r}{k} r join {t}k{k} k on k.tree = r.tree and k.up = r.idx // 3)",
        ]

    for k in range(levels):
        parts += level("t", "r", k)
    parts += [
        f"subs as (select tree as source_key, node as subroot, row_number() over (order by tree) - 1 as idx from t{levels})",
        "u0 as (select 'all' as tree, idx, subroot as node from subs)",
        f"q0 as (select doc_id, leaf, subroot, 'all' as tree, s.idx, folded, proof from r{levels} r join subs s on s.source_key = r.tree)",
    ]
    for k in range(tops):
        parts += level("u", "q", k)
    return "with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, u.node as root, sha256(proof) as proof_sha256, folded as folded_root, folded = u.node as verified from q{tops} cross join u{tops} u"


OP13_SQL = _op13_sql()
