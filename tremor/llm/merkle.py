"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections. DataFrame functions alone.

A leaf is the digest of a sentence. A paragraph's digest is that of its leaves' whole digests, a section's that of its paragraphs',
the root's that of its sections'. A section ends after a paragraph whose digest ends in one of four sixteenths, so an edit moves no other
section's bounds. A fingerprint is the root, then the sections with their paragraphs and shortened leaves. Roots test equality. Two
trees are compared from above: branches with equal digests are not opened, and only in those that differ are paragraphs and
then leaves compared, which shows where an edit is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.llm.common import doc_texts, table

#: Hex digits of a node's digest, and of a leaf as a fingerprint shows it.
NODE, LEAF = 64, 8
#: Divides sentences; it is put after a mark and the blank that follows it, so no two texts are divided into the same parts.
CUT = "\x1f"
#: Ranges of rows without doc_id, by the leading bits of their texts' hash.
NULL_RANGES = 64


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def digest(col: Column) -> Column:
    return F.sha2(col, 256)


def paragraph(text: Column) -> Column:
    """'digest(leaf leaf ...)' of a paragraph."""
    shown = lambda leaves: F.array_join(F.transform(leaves, lambda d: F.substring(d, 1, LEAF)), " ")
    return let(F.transform(F.split(text, CUT), digest), lambda leaves: F.concat(digest(F.array_join(leaves, "")), F.lit("("), shown(leaves), F.lit(")")))


def sections(text: Column) -> Column:
    """The sections of a text's tree, in order: 'digest{paragraph paragraph ...}' each. An empty text has one section of one empty leaf; a null one gives null."""
    marked = F.regexp_replace(text, "([.!?|] )", "$1" + CUT)
    nodes = F.array_join(F.transform(F.split(marked, "\n"), paragraph), " ")
    # a paragraph ends its section if its digest ends in 0, 1, 2 or 3
    cut = F.split(F.regexp_replace(nodes, r"(\b[0-9a-f]{63}[0-3]\([0-9a-f ]*\)) ", "$1\n"), "\n")
    return F.transform(cut, lambda s: F.concat(digest(s), F.lit("{"), s, F.lit("}")))


def shown(tree: Column) -> Column:
    """'root[section section ...]' of an array of sections: equal for equal texts, and the root covers every character."""
    return let(F.array_join(tree, ""), lambda all_: F.concat(digest(all_), F.lit("["), all_, F.lit("]")))


def fingerprint(text: Column) -> Column:
    return shown(sections(text))


def sections_of(print_: Column) -> Column:
    """The sections of a fingerprint, one at least; null of a null one."""
    return F.split(F.substr(print_, F.lit(NODE + 2), F.length(print_) - NODE - 2), r"(?<=\})")


def inner(node: Column) -> Column:
    """What stands between a node's brackets."""
    return F.substr(node, F.lit(NODE + 2), F.length(node) - NODE - 2)


def paragraphs_of(tree: Column) -> Column:
    return F.flatten(F.transform(tree, lambda s: F.split(inner(s), r"(?<=\)) ")))


def leaves_of(paragraphs: Column) -> Column:
    return F.flatten(F.transform(paragraphs, lambda p: F.split(inner(p), " ")))


def tally(nodes: Column) -> Column:
    """Each distinct node and how often it comes, as a map: the nodes are sorted, and a run of equal ones ends where the next one starts."""

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i < F.size(s)) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        return let(starts, lambda p: F.map_from_arrays(F.transform(p, lambda i: F.get(s, i)), F.transform(p, lambda i, j: F.coalesce(F.get(p, j + 1), F.size(s)) - i)))

    return let(F.sort_array(nodes), of)


def matched(x: Column, y: Column, leaves: Callable[[Column], Column]) -> Column:
    """Two arrays of nodes matched one to one: same (leaves of the matched ones, on one side), and x and y, the nodes that are left over, as often as they are."""
    both = F.map_entries(F.map_zip_with(tally(x), tally(y), lambda k, m, n: F.struct(F.coalesce(m, F.lit(0)).alias("m"), F.coalesce(n, F.lit(0)).alias("n"))))
    rest = lambda e, m, n: F.flatten(F.transform(e, lambda v: F.array_repeat(v["key"], F.greatest(v["value"][m] - v["value"][n], F.lit(0)))))
    shared = lambda v: F.least(v["value"]["m"], v["value"]["n"])
    same = lambda e: F.aggregate(e, F.lit(0), lambda total, v: total + F.when(shared(v) > 0, shared(v) * leaves(v["key"])).otherwise(0))
    return let(both, lambda e: F.struct(same(e).alias("same"), rest(e, "m", "n").alias("x"), rest(e, "n", "m").alias("y")))


def likeness(a: Column, b: Column) -> Column:
    """How alike two trees (arrays of sections) are, 0 to 1: twice the leaves in equal branches over those and the others of both.

    Equal sections count with all their leaves; in sections that are left over, equal paragraphs do; in paragraphs that are left over, equal leaves. A branch is
    matched as often as both have it, so a repeat that one tree lacks counts as a difference.
    """
    of_paragraph = lambda p: F.size(F.split(inner(p), " "))
    of_section = lambda s: F.size(leaves_of(paragraphs_of(F.array(s))))
    last = lambda c, d: let(matched(leaves_of(d["x"]), leaves_of(d["y"]), lambda _: F.lit(1)), lambda e: let(c["same"] + d["same"] + e["same"], lambda same: F.lit(2.0) * same / (2 * same + F.size(e["x"]) + F.size(e["y"]))))
    middle = lambda c: let(matched(paragraphs_of(c["x"]), paragraphs_of(c["y"]), of_paragraph), lambda d: last(c, d))
    return F.when(a == b, 1.0).otherwise(let(matched(a, b, of_section), middle))


def differing(a: Column, b: Column) -> Column:
    """Where fingerprint a differs from b: section and paragraph (places from 0, a section's paragraphs counted in it) of each paragraph in
    a section that b lacks which no such section of b has. Equal fingerprints give an empty array, a null one null."""

    def open_(tree: Column, other: Column) -> Column:
        placed = F.filter(F.transform(tree, lambda s, i: F.struct(i.alias("section"), s.alias("node"))), lambda x: ~F.array_contains(other, x["node"]))
        return F.flatten(F.transform(placed, lambda x: F.transform(F.split(inner(x["node"]), r"(?<=\)) "), lambda p, j: F.struct(x["section"].alias("section"), j.alias("paragraph"), p.alias("node")))))

    both = F.struct(sections_of(a).alias("a"), sections_of(b).alias("b"))
    opened = lambda o: F.struct(open_(o["a"], o["b"]).alias("a"), F.transform(open_(o["b"], o["a"]), lambda x: x["node"]).alias("b"))
    lacking = lambda o: F.transform(F.filter(o["a"], lambda x: ~F.array_contains(o["b"], x["node"])), lambda x: F.struct(x["section"], x["paragraph"]))
    return let(both, lambda o: let(opened(o), lacking))


def place_in(bounds: list[int], value: Column) -> Column:
    """How many of bounds, in order, are less than value, by halving."""
    held = F.array(*map(F.lit, bounds)).cast("array<long>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) < value, at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, its tree, and next_text and next_tree: those of the next row in ascending doc_id, nulls first, then hash of the text and text; for the last row the first's.

    Rows are dealt in ranges; the first row of each range is also sent to the range before it, so that
    no range needs another. A range's first rows are found from the keys alone.
    """
    spark = docs.sparkSession
    texts = doc_texts(docs).withColumn("hash", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    cuts = texts.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), 10_000)).first()[0] or []
    shift = 64 - (NULL_RANGES - 1).bit_length()
    of = F.when(F.col("doc_id").isNull(), (F.shiftright("hash", shift) - NULL_RANGES // 2).cast("int")).otherwise(place_in(sorted(set(cuts)), F.col("doc_id")))
    ranged = texts.withColumn("range", of)
    firsts = ranged.groupBy("range").agg(F.min(F.struct("doc_id", "hash")).alias("k")).select("range", "k.*").orderBy("range").collect()  # a row for each range
    if not firsts:
        return texts.select("doc_id", "text", F.array().cast("array<string>").alias("tree"), F.lit(None).cast("string").alias("next_text"), F.array().cast("array<string>").alias("next_tree"))
    before = {f["range"]: p["range"] for p, f in zip([firsts[-1], *firsts[:-1]], firsts)}
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    is_first = F.coalesce(F.col("doc_id").isin([f["doc_id"] for f in firsts if f["doc_id"] is not None]), F.col("hash").isin([f["hash"] for f in firsts if f["doc_id"] is None]))
    lent = ranged.where(is_first).withColumns({"home": F.lit(1), "range": to[F.col("range")]})
    order = Window.partitionBy("range").orderBy("home", F.col("doc_id").asc_nulls_first(), "hash", "text")
    both = ranged.withColumn("home", F.lit(0)).unionByName(lent).repartition("range").withColumn("tree", sections(F.col("text")))
    return both.withColumns({"next_text": F.lead("text").over(order), "next_tree": F.lead("tree").over(order)}).where("home = 0").drop("home", "range", "hash")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row of docs (doc_id, text).

    The edited text has the last half of its code points, rounded down, replaced by the first as many of the next document in ascending doc_id
    (the last's next is the first). A null text counts as empty; an empty text has one empty leaf. Null doc_ids come first. Rows that repeat a doc_id,
    or have none, stand in order of their texts' hashes. One row alone is its own next. An empty table gives no rows.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("text", "next_text").withColumn("edited_tree", sections(F.col("edited")))
    tree, other = F.col("tree"), F.col("edited_tree")
    return rows.select(
        "doc_id", "n_chars", digest(F.col("edited")).alias("edited_sha256"), shown(tree).alias("fingerprint"), shown(other).alias("edited_fingerprint"), likeness(tree, other).alias("near_edited"), likeness(tree, F.col("next_tree")).alias("near_next")
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprints of all documents."""
    return fingerprints(table(spark, sf_dir, "documents"))
