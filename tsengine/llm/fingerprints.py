"""Merkle fingerprints of documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

#: Rows of a range of ids, about; and the ranges at most, which bounds the table of their first keys.
RANGE_ROWS = 512
RANGES = 100_000
#: Sample rows for each range, from which the ranges are cut.
SAMPLE = 5
#: Hex digits of a leaf that a fingerprint shows; trees and roots are made of whole digests.
LEAF_DIGITS = 8


def leaves(text: Column) -> Column:
    """array<array<array<string>>>: digests of the clauses of each paragraph of each section.

    Sections are separated by blank lines, paragraphs by line feeds, clauses by a blank after one of .,;:!? - so a text is its
    clauses with those separators between, and different texts have different trees.
    """
    paragraph = lambda p: F.transform(F.split(p, "(?<=[.,;:!?]) ", -1), lambda x: F.sha2(x, 256))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), paragraph))


def _node(kind: str, children: Column) -> Column:
    """The digest of a node: of its kind and its children's digests, all of one length."""
    return F.sha2(F.concat(F.lit(kind), F.array_join(children, "")), 256)


def nodes(tree: Column) -> Column:
    """struct(paragraphs, sections, root) of a tree of leaves: the digests of its inner nodes."""
    paragraphs = F.transform(tree, lambda s: F.transform(s, lambda p: _node("p", p)))
    return F.struct(F.flatten(paragraphs).alias("paragraphs"), F.transform(paragraphs, lambda s: _node("s", s)).alias("sections"))


def fingerprint(tree: Column, inner: Column) -> Column:
    """root:branches. The root is over the sections, a section over its paragraphs, a paragraph over its leaves: equal roots mean
    equal texts. Branches are the first digits of the leaves, paragraphs parted by commas and sections by slashes."""
    short = lambda p: F.array_join(F.transform(p, lambda x: F.substring(x, 1, LEAF_DIGITS)), "")
    shown = F.array_join(F.transform(tree, lambda s: F.array_join(F.transform(s, short), ",")), "/")
    return F.concat(_node("r", inner["sections"]), F.lit(":"), shown)


def likeness(a: Column, a_inner: Column, b: Column, b_inner: Column) -> Column:
    """Twice the distinct nodes that two trees share over the sum of their distinct nodes: leaves, paragraphs, sections and the
    root. 1 for equal texts only: texts of equal leaves in another order share the leaves, but not what is above."""

    def all_nodes(tree, inner):
        return F.array_distinct(F.concat(F.flatten(F.flatten(tree)), inner["paragraphs"], inner["sections"], F.array(_node("r", inner["sections"]))))

    x, y = all_nodes(a, a_inner), all_nodes(b, b_inner)
    return F.lit(2.0) * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def differing_branches(a: Column, b: Column) -> Column:
    """array<string> `section.paragraph` (from 0) of the paragraphs of fingerprint `a` that differ from `b` there; empty if the
    roots are equal. Only sections whose branches differ are opened."""
    sections = lambda f: F.split(F.substring_index(f, ":", -1), "/", -1)
    there = sections(b)

    def opened(s, i):
        other = F.split(F.coalesce(F.get(there, i), F.lit("")), ",", -1)
        marked = F.transform(F.split(s, ",", -1), lambda p, j: F.when(F.get(other, j).eqNullSafe(p), F.lit(None).cast("string")).otherwise(F.concat_ws(".", i, j)))
        return F.when(F.get(there, i).eqNullSafe(s), F.array().cast("array<string>")).otherwise(F.filter(marked, lambda x: x.isNotNull()))

    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.array().cast("array<string>")).otherwise(F.flatten(F.transform(sections(a), opened)))


def _key() -> Column:
    """What rows are ordered by: null ids first, then the id, then the text's hash."""
    return F.struct(F.col("_id").isNotNull().alias("known"), F.col("_id").alias("id"), F.col("_order").alias("order"))


def _with_range(rows: DataFrame, edges: list) -> DataFrame:
    """`rows` with _range, the number of edges at or below _key, found in two steps of about the square root of their number.

    The edges, RANGES at most, are the one row of a broadcast table.
    """
    if not edges:
        return rows.withColumn("_range", F.lit(0).cast("long"))
    step = max(1, int(len(edges) ** 0.5))
    kind = T.ArrayType(rows.schema["_key"].dataType)
    table = rows.sparkSession.createDataFrame([(1, edges, edges[::step])], T.StructType([T.StructField("_one", T.IntegerType()), T.StructField("_all", kind), T.StructField("_top", kind)]))
    upto = lambda x: F.size(F.filter(x, lambda e: e <= F.col("_key")))
    low = F.col("_low")
    at = F.when(low < 0, 0).otherwise(low * step + upto(F.slice("_all", F.greatest(low, F.lit(0)) * step + 1, step))).cast("long")
    joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(table), "_one").withColumn("_low", upto(F.col("_top")) - 1)
    return joined.withColumn("_range", at).drop("_one", "_all", "_top", "_low")


def with_next(docs: DataFrame) -> DataFrame:
    """`docs` (_id, _text) with _next, the text of the row with the next id; after the last comes the first. Rows of one id
    follow each other by their text's hash, null ids come first.

    Rows are dealt into ranges of whole ids and text hashes, cut at keys of a bounded sample (RANGES times SAMPLE rows with the
    least hashes; it only balances the ranges), so no task orders all of them and a hot id is dealt over ranges like any other rows;
    only rows that are equal in id and text stay together. Each range gets, as its last row, the first text of the range after it.
    The first keys of all ranges (RANGES at most) are the only thing that one task orders.
    """
    rows = docs.select("_id", "_text", F.xxhash64("_text").alias("_order"))
    n = rows.count()
    parts = max(1, min(RANGES, n // RANGE_ROWS))
    keys = rows.select(_key().alias("k"))
    sample = keys.orderBy(F.xxhash64("k"), "k").limit(SAMPLE * parts).select("k").sort("k").collect() if parts > 1 else []
    edges = [sample[len(sample) * j // parts]["k"] for j in range(1, parts)] if sample else []
    edges = [e for e, before in zip(edges, [None, *edges]) if e != before]
    rows = _with_range(rows.withColumn("_key", _key()), edges)

    ordered = Window.orderBy("_range")
    first = rows.groupBy("_range").agg(F.min("_key").alias("_first"))
    follow = first.select("_range", F.coalesce(F.lead("_first").over(ordered), F.first("_first").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))).alias("f"))
    follow = follow.select(F.col("_range").alias("_before"), "f")
    heads = rows.join(F.broadcast(follow), F.col("_key") == F.col("f")).groupBy("_before").agg(F.first("_text").alias("_text"))
    heads = heads.select(F.lit(None).cast(docs.schema["_id"].dataType).alias("_id"), "_text", F.col("_before").alias("_range"), F.lit(None).cast(rows.schema["_key"].dataType).alias("_key"), F.lit(True).alias("_head"))
    together = rows.select("_id", "_text", "_range", "_key", F.lit(False).alias("_head")).union(heads)
    w = Window.partitionBy("_range").orderBy("_head", "_key")
    return together.withColumn("_next", F.lead("_text").over(w)).filter(~F.col("_head")).select("_id", "_text", "_next")


def merkle_fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, n_chars long, edited_sha256, fingerprint, edited_fingerprint string, near_edited, near_next double): one row a row.

    The edited text is the text whose last half of code points (rounded down) gives way to as many (or all) of the next
    document's first. near_edited and near_next are the likeness to the edited and to the next text's fingerprint. A column
    edited_branches follows: section.paragraph of the paragraphs that the edit changed, found by going down differing branches.

    Null is the empty text, a tree of one empty leaf. Rows of one id (or of null) follow each other in a fixed order; a table of
    one row is its own next. Extra columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = with_next(docs).withColumn("n_chars", F.length("_text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("_next"), F.lit(1), half))
    trees = ("_text", "_edited", "_next")
    rows = rows.withColumn("_edited", edited).select("_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), *[leaves(F.col(c)).alias(c) for c in trees])
    rows = rows.select("_id", "n_chars", "edited_sha256", *trees, *[nodes(F.col(c)).alias(f"{c}_nodes") for c in trees])
    like = lambda x, y: likeness(F.col(x), F.col(f"{x}_nodes"), F.col(y), F.col(f"{y}_nodes"))
    prints = rows.select(
        F.col("_id").alias(id_column),
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("_text"), F.col("_text_nodes")).alias("fingerprint"),
        fingerprint(F.col("_edited"), F.col("_edited_nodes")).alias("edited_fingerprint"),
        like("_text", "_edited").alias("near_edited"),
        like("_text", "_next").alias("near_next"),
    )
    return prints.withColumn("edited_branches", F.array_join(differing_branches(F.col("fingerprint"), F.col("edited_fingerprint")), ","))
