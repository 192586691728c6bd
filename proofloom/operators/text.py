"""Text jobs: duplicates, span location, fingerprints and name similarity, by equi-joins on short keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import norm_token
from .shared import cut

SHINGLE = 5
#: Characters of a seed where a span has too few words for seeds of words.
GRAM = 12


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """content hash, first document and number of copies, where there are any."""
    h = docs.where("text is not null").select(F.sha2("text", 256).alias("content"), "doc_id")
    return h.groupBy("content").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


def _tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, body (the normalised text) and its words, each made once: what is built on them reads the columns."""
    body = rows.select(key, norm_token(F.col(text)).alias("body"))
    return body.select(key, "body", F.coalesce(F.split("body", " "), F.array().cast("array<string>")).alias("words"))


def _runs(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of `size` words; words must be a column, not an expression, as it is read for each run."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size)))


def _pieces(spans: DataFrame, percent: int) -> DataFrame:
    """item_id, span, most, size, key: seeds of each span, one row a seed.

    A span of n characters may differ in most = n * percent / 100 edits. An edit spoils two
    neighbouring words at most (it can take out the blank between them), so of 2 * most + 1 stretches
    of words, none shared, one is left whole by any such edits; the first `size` words of a stretch
    are its seed. Spans with fewer words than that have no seeds and a size of 0.
    """
    t = _tokens(spans, "item_id", "text").where("body is not null").withColumn("most", F.floor(F.length("body") * percent / 100).cast("int"))
    t = t.withColumn("parts", 2 * F.col("most") + 1).withColumn("of", F.expr("size(words) div parts").cast("int")).withColumn("size", F.least(F.lit(SHINGLE), F.col("of")))
    seeds = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.xxhash64(F.slice("words", p * F.col("of") + 1, F.col("size"))))
    return t.select("item_id", F.col("body").alias("span"), "most", "size", F.explode(F.when(F.col("size") > 0, F.array_distinct(seeds)).otherwise(F.array(F.lit(0).cast("long")))).alias("key"))


def _seeded(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the documents that hold a seed of a span, by an equi-join on length and hash of runs of words."""
    sizes = [r.size for r in pieces.select("size").distinct().where("size > 0").collect()]  # SHINGLE values at most

    def keyed(k: int) -> Column:
        return F.transform(F.array_distinct(_runs(F.col("words"), k)), lambda h: F.struct(F.lit(k).alias("size"), h.alias("key")))

    runs = F.concat(*map(keyed, sizes)) if sizes else F.array().cast("array<struct<size:int,key:bigint>>")
    have = _tokens(docs, "doc_id", "text").select("doc_id", F.explode(runs).alias("run")).select("doc_id", "run.size", "run.key")
    met = have.join(pieces.where("size > 0").select("size", "key", "item_id"), ["size", "key"]).select("doc_id", "item_id").distinct()
    bare = pieces.where("size = 0")
    if bare.isEmpty():
        return met
    # too few words for seeds of words: seeds of characters, the first GRAM of most + 1 stretches, of which an edit spoils one
    spread = bare.select("item_id", "span", "most", F.expr("length(span) div (most + 1)").alias("of"))
    grams = spread.select("item_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("most")), lambda p: F.xxhash64(F.substr("span", p * F.col("of") + 1, F.lit(GRAM)))))).alias("key"))
    chars = docs.select("doc_id", norm_token(F.col("text")).alias("body")).where(F.length("body") >= GRAM)
    have = chars.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("body") - GRAM + 1), lambda i: F.xxhash64(F.substr("body", i, F.lit(GRAM)))))).alias("key"))
    return met.unionByName(have.join(grams, "key").select("doc_id", "item_id")).distinct()


def _located(docs: DataFrame, spans: DataFrame, percent: int) -> DataFrame:
    """doc_id, item_id, body, span, most of the documents that may hold a span."""
    pieces = cut(_pieces(spans, percent), "pieces")
    bodies = docs.select("doc_id", norm_token(F.col("text")).alias("body"))
    return _seeded(docs, pieces).join(pieces.select("item_id", "span", "most").distinct(), "item_id").join(bodies, "doc_id")


def locate_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, item_id, at): the places at which a span's normalised text stands in a document's, from character 1, none overlapping the one before.

    A document is a candidate when it holds the span's first words, found by an equi-join; then the
    places are looked up in the text itself. Spans of any number of words are looked for.
    """
    found = _located(docs, spans, 0)
    return found.select("doc_id", "item_id", F.explode(_places(F.col("body"), F.col("span"))).alias("at"))


def _places(body: Column, span: Column) -> Column:
    """Places of span in body, from 1, none overlapping the one before. Normalised text has no special characters, so a span is its own pattern."""
    parts = F.split(body, span, -1)
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.aggregate(F.slice(parts, F.lit(1), k), (k - 1) * F.length(span) + 1, lambda n, x: n + F.length(x)))


def span_edits(body: str, span: str, most: int) -> tuple[int, int] | None:
    """Fewest edits, up to `most`, that turn span into a stretch of body, and where the first such stretch ends; bit-parallel over the span."""
    if len(span) > len(body) + most:
        return None
    places: dict[str, int] = {}
    for k, c in enumerate(span):
        places[c] = places.get(c, 0) | 1 << k
    full, top = (1 << len(span)) - 1, 1 << (len(span) - 1)
    up, down, now = full, 0, len(span)
    best = (now, 0)
    for j, c in enumerate(body, 1):
        eq = places.get(c, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(flat | up)), up & flat
        now += bool(right & top) - bool(left & top)
        right, left = (right << 1) & full, (left << 1) & full
        flat = eq | down
        up, down = left | (full & ~(flat | right)), right & flat
        if now < best[0]:
            best = (now, j)
    return best if best[0] <= most else None


def windows(body: str, span: str, most: int) -> list[tuple[int, int]]:
    """Stretches of body, apart from each other, outside which span cannot stand with so many edits: around each of most + 1 pieces of it that an edit leaves whole."""
    size, found = len(span) // (most + 1), []
    for p in range(most + 1):
        piece, at = span[p * size : (p + 1) * size], -1
        while piece and (at := body.find(piece, at + 1)) >= 0:
            found.append((max(0, at - p * size - most), min(len(body), at - p * size + len(span) + most)))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def fuzzy_spans(docs: DataFrame, spans: DataFrame, percent: int) -> DataFrame:
    """(doc_id, item_id, edits, exact): documents with a stretch within percent of a span's length of edits, and the fewest edits; all there are.

    Candidates come from seeds that such edits cannot all spoil; the alignment lets the stretch begin and end anywhere.
    """

    def align(frames):
        for frame in frames:
            kept = []
            for r in frame.itertuples(index=False):
                tried = [e for a, b in windows(r.body, r.span, r.most) if (e := span_edits(r.body[a:b], r.span, r.most))]
                if tried:
                    edits = min(e for e, _ in tried)
                    kept.append((r.doc_id, r.item_id, edits, edits == 0))
            yield pd.DataFrame(kept, columns=["doc_id", "item_id", "edits", "exact"])

    found = _located(docs, spans, percent).select("doc_id", "item_id", "body", "span", "most")
    return cut(found.mapInPandas(align, "doc_id long, item_id long, edits int, exact boolean"), "spans", 200)


def name_classes(names: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """key and class: the least key whose name is the same once normalised."""
    n = names.select(F.col(key).alias("id"), F.coalesce(norm_token(F.col(name)), F.lit("")).alias("norm"))
    return n.join(n.groupBy("norm").agg(F.min("id").alias("class")), "norm").select("id", "class", "norm")


def similar_names(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, common) of classes whose trigram sets have a Jaccard similarity of at least percent / 100; flags, never merges.

    Each class is dealt out under its rarest trigrams only, as many as must hold one of any similar
    name's (prefix filter), and meets names of fitting length; what meets is counted exactly.
    """
    c = classes.select(F.col("class").alias("id"), "norm").distinct()
    padded = c.select("id", F.concat(F.lit("  "), "norm", F.lit(" ")).alias("s"))
    grams = padded.select("id", F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s") - 2), lambda i: F.substr("s", i, F.lit(3)))).alias("grams")).withColumn("n", F.size("grams"))
    each = grams.select("id", "n", F.explode("grams").alias("gram"))
    ranked = each.join(each.groupBy("gram").agg(F.count("*").alias("df")), "gram").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("df", "gram")))
    first = ranked.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    a, b = first.select(F.col("id").alias("a"), F.col("n").alias("na"), "gram"), first.select(F.col("id").alias("b"), F.col("n").alias("nb"), "gram")
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    met = a.join(b, "gram").where(fits).select("a", "b").distinct()
    both = met.join(grams.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    counted = both.withColumn("common", F.size(F.array_intersect("ga", "gb")).cast("long"))
    return counted.where(F.col("common") * 100 >= percent * (F.size("ga") + F.size("gb") - F.col("common"))).select("a", "b", "common")


def fact_lineages(docs: DataFrame, share: int, components) -> DataFrame:
    """(doc_id, root) of documents tied by rare shared facts, numbers of three digits or more.

    Exact copies count once. A fact ties its documents if at least two state it and at most one in
    `share` of all, so the bound grows with the corpus; ties are stars to the least document.
    """
    first = docs.where("text is not null").groupBy(F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text"))
    facts = first.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\d{3,})"), F.lit(1)))).alias("fact"))
    n = facts.groupBy("fact").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).crossJoin(docs.agg(F.count("*").alias("total")))
    rare = n.where(F.col("n").between(2, F.greatest(F.lit(2), F.floor(F.col("total") / share)))).select("fact", "first_doc")
    stars = facts.join(rare, "fact").where("doc_id <> first_doc").select("doc_id", "first_doc").distinct()
    return components(stars, "doc_id", "first_doc").select(F.col("node").alias("doc_id"), "root")


def segments(rows: DataFrame, key: list[str], text: str, mark: str) -> DataFrame:
    """key, part, begins (character from 1) and content of the pieces between marks, all of the text."""
    parts = rows.select(*key, F.posexplode(F.split(text, mark, -1)).alias("part", "content"))
    before = F.sum(F.length("content") + 1).over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("begins", F.coalesce(before, F.lit(0)) + 1)
