"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Test items are parted by size, the powers of two times a base block of shingles. A document is cut into base blocks, each
with the least value of its shingles under every permutation; larger blocks take the least of two smaller ones. For a part
of items of at most q shingles, the windows of a document are pairs of neighbouring blocks of q: any
passage of q shingles lies whole in one, so the Jaccard similarity of item and window stays near the containment over two,
however long the document is. An item and a window that agree in a permutation are a candidate; the share of the item's shingles that
the whole document has decides. Items too short for the smallest windows are joined with the documents by their few shingles
themselves, and items of fewer words than a shingle by shingles of their own length. DataFrame functions alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import free_name, stored, table

WORDS, CONTAINED = 5, 0.8
#: Shingles of a base block; permutations. A whole passage of over half its part's size misses all of 24 with a chance below 0.1 %; one of which 0.8 is there, of about 0.6 % a window.
BASE, PERMUTATIONS = 16, 24
#: Items of at most this many shingles, half the smallest part's size, are searched for by each shingle.
SHORT = BASE // 2
NAMES = [f"m{i}" for i in range(PERMUTATIONS)]


def words_of(text: Column) -> Column:
    """Small-lettered runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_rows(df: DataFrame, keys: list[str], words: int = WORDS) -> DataFrame:
    """keys, place and sh: the hash of the words from each word on; texts of fewer words have none."""
    hashed = df.select(*keys, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    shifted = [F.slice("w", i + 1, F.size("w")).alias(f"w{i}") for i in range(words)]
    rows = hashed.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("place", "z"))
    parts = [F.col(f"z.w{i}") for i in range(words)]
    return rows.where(parts[-1].isNotNull()).select(*keys, "place", F.xxhash64(*parts).alias("sh"))


def least() -> list[Column]:
    return [F.min(F.hash("sh", F.lit(i))).alias(name) for i, name in enumerate(NAMES)]


def least_of_least() -> list[Column]:
    return [F.min(name).alias(name) for name in NAMES]


def signature_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode(F.array(*NAMES)).alias("permutation", "least"))


def common_shingles(texts: DataFrame, of_items: DataFrame) -> DataFrame:
    """doc_id, item_id and common, the number of distinct shingles of the item (item_id, sh) that the document (doc_id, text) has, if any."""
    shared = shingle_rows(texts, ["doc_id"]).join(of_items, "sh").select("doc_id", "item_id", "sh").distinct()
    return shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("common"))


def common_of_candidates(texts: DataFrame, of_items: DataFrame, signed: DataFrame, parts: list[int]) -> DataFrame:
    """common_shingles of the pairs of a document and an item of signed (item_id, part, least hashes) of which a window and the item agree in a permutation."""
    wanted = signature_rows(signed, ["part", "item_id"])
    # dealt by document once: all blocks and windows of a document are then grouped where they are
    keyed = texts.withColumn("version", F.xxhash64("text"))
    blocks = shingle_rows(keyed.repartition("doc_id", "version"), ["doc_id", "version"])
    blocks = blocks.groupBy("doc_id", "version", F.floor(F.col("place") / BASE).cast("int").alias("block")).agg(*least())
    found = None
    for k in range(max(parts) + 1):
        if k:
            blocks = blocks.groupBy("doc_id", "version", F.floor(F.col("block") / 2).cast("int").alias("block")).agg(*least_of_least())
        if k not in parts:
            continue
        windows = blocks.withColumn("window", F.explode(F.array(F.col("block"), F.col("block") - 1))).groupBy("doc_id", "version", "window").agg(*least_of_least())
        rows = signature_rows(windows, ["doc_id"]).join(wanted.where(F.col("part") == k).drop("part"), ["permutation", "least"])
        found = rows.select("doc_id", "item_id") if found is None else found.unionByName(rows.select("doc_id", "item_id"))
    candidates = stored(found.distinct(), "candidates")

    likely = candidates.select("doc_id").distinct()
    again = texts.join(likely, texts["doc_id"].eqNullSafe(likely["doc_id"]), "left_semi")
    counts = common_shingles(again, of_items)
    return candidates.join(counts, candidates["doc_id"].eqNullSafe(counts["doc_id"]) & candidates["item_id"].eqNullSafe(counts["item_id"])).select(candidates["doc_id"], candidates["item_id"], "common")


def whole_items(texts: DataFrame, items: DataFrame) -> list[DataFrame]:
    """doc_id, item_id and containment (1) of the items (item_id, text) of fewer words than a shingle that stand in documents; a table for each number of words."""
    sized = stored(items.select("item_id", "text", F.size(words_of(F.col("text"))).alias("words")).where((F.col("words") > 0) & (F.col("words") < WORDS)), "short-items")
    found = []
    for r in sized.select("words").distinct().orderBy("words").collect():  # WORDS - 1 rows at most
        wanted = shingle_rows(sized.where(F.col("words") == r.words), ["item_id"], r.words).select("item_id", "sh")
        found.append(shingle_rows(texts, ["doc_id"], r.words).join(wanted, "sh").select("doc_id", "item_id").distinct().withColumn("containment", F.lit(1.0)))
    return found


def contaminated(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """doc_id, item_id and containment of each pair of a document of docs (doc_id, text) and an item of items (item_id, text)
    that it contains: the share of the item's distinct five-word shingles that the document has is contained or more.

    Words are small-lettered runs of letters and digits. An item of fewer than five words is contained where its words stand one
    after the other. Null or empty texts, and texts without words, contain nothing and are contained in
    nothing. Rows that repeat a doc_id, or an item_id, count as one text each that has all their shingles; of a repeated item_id, texts of fewer than five words
    are looked for each. Null keys are keys like others. An empty table on either side gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text <> ''")
    of_items = stored(shingle_rows(items, ["item_id"]).select("item_id", "sh").distinct(), "item-shingles")
    sized = of_items.groupBy("item_id").agg(F.count("*").alias("n"), *least())
    part = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BASE)).cast("int"))
    signed = stored(sized.withColumn("part", part), "item-signatures")
    short = of_items.join(signed.where(F.col("n") <= SHORT).select(F.col("item_id").alias("item")), F.col("item_id").eqNullSafe(F.col("item")), "left_semi")
    parts = [r.part for r in signed.where(F.col("n") > SHORT).select("part").distinct().orderBy("part").collect()]  # one for each power of two
    counts = []
    if parts:
        counts.append(common_of_candidates(texts, of_items, signed.where(F.col("n") > SHORT), parts))
    if not signed.where(F.col("n") <= SHORT).isEmpty():
        counts.append(common_shingles(texts, short))
    found = whole_items(texts, items)
    if counts:
        sizes = signed.select(F.col("item_id").alias("item"), "n")
        shares = reduce(DataFrame.unionByName, counts).join(sizes, F.col("item_id").eqNullSafe(F.col("item"))).select("doc_id", "item_id", (F.col("common") / F.col("n")).alias("containment"))
        found.append(shares.where(F.col("containment") >= contained))
    if not found:
        return docs.sparkSession.createDataFrame([], f"doc_id long, item_id {dict(items.dtypes)['item_id']}, containment double")
    # an item_id may be repeated with texts of both kinds: its largest share counts
    return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """The rows of docs whose doc_id contains no item, with all their columns, whatever their names. A null doc_id is one like others."""
    hit = free_name("hit", docs)
    found = contaminated(docs, items, contained).select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col(hit)), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contaminated of all documents and the whole benchmark."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text <> ''
), item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text <> ''
), doc_sh AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i : i + 4], 'string_agg', ' '))) AS sh
  FROM doc_words WHERE len(w) > 4
), item_sh AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i : i + 4], 'string_agg', ' '))) AS sh
  FROM item_words WHERE len(w) > 4
), sizes AS (SELECT item_id, count(*) AS n FROM item_sh GROUP BY item_id
), short_items AS (SELECT item_id, len(w) AS k, list_aggregate(w, 'string_agg', ' ') AS sh FROM item_words WHERE len(w) BETWEEN 1 AND 4
), short_sh AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_aggregate(w[i : i + k - 1], 'string_agg', ' '))) AS sh
  FROM doc_words, (SELECT DISTINCT k FROM short_items) WHERE len(w) >= k
), found AS (
  SELECT d.doc_id, s.item_id, count(*) / any_value(n)::DOUBLE AS containment
  FROM item_sh s JOIN doc_sh d USING (sh) JOIN sizes z ON z.item_id = s.item_id
  GROUP BY d.doc_id, s.item_id HAVING count(*) / any_value(n)::DOUBLE >= 0.8
  UNION ALL SELECT d.doc_id, i.item_id, 1.0 FROM short_items i JOIN short_sh d USING (sh)
)
SELECT doc_id, item_id, max(containment) AS containment FROM found GROUP BY doc_id, item_id
"""
