"""Language ID with bit-sliced Bloom filters of letter n-grams.

One array of bit masks serves all languages: bit l of the slots that an n-gram hashes to is set if language l
has the n-gram. The AND of an n-gram's slots gives every language that contains it at once. Summed over a text, the bits
of each language are its hits; the hits that a filter of that fill gives by chance are taken off, and the
language with the largest share decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.llm.common import blocks, doc_texts, fold_is, mix64, stored, table, text_blocks

BLOCK_CHARS = 1_000_000
N, HASHES, SLOTS = 3, 3, 1 << 19
#: An n-gram belongs to a language if it is at least this share of the language's n-grams (so a filter has at most
#: 1 / MIN_SHARE of them, whatever the size of the corpus) and at least RATIO of its share in the language that has most of it (else foreign
#: words and names would in time put every n-gram into every language).
MIN_SHARE, RATIO = 1e-5, 0.2
#: Languages of a word of a slot's mask.
BITS = 63


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the hash of each letter n-gram, a blank at either end of a word; and which texts have a letter."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\n".join([""] + low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(low) + 1), np.array([len(t) + 1 for t in ["", *low]]))[: len(points)] - 1
    is_letter = letters()[points]
    kept = is_letter.copy()
    kept[1:] |= is_letter[:-1]
    kept[:-1] |= is_letter[1:]  # one blank on either side; of two blanks in a row, no n-gram has both
    at = np.flatnonzero(kept)
    letter, code, doc = is_letter[at], np.where(is_letter[at], points[at], 0).astype(np.uint64), of[at]
    has = np.zeros(len(low), bool)
    has[doc[letter]] = True
    n = max(0, len(at) - N + 1)
    good, h = np.ones(n, bool), np.zeros(n, np.uint64)
    for i in range(N):
        part = slice(i, n + i)
        if 0 < i < N - 1:
            good &= letter[part]
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[part] + np.uint64(1)
    middle = doc[1 : n + 1]
    return middle[good], mix64(h[good]), has


def slots(h: np.ndarray, i: int) -> np.ndarray:
    return (mix64(h + np.uint64((i + 1) * 0xD1B54A32D192ED03 % 2**64)) % np.uint64(SLOTS)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram and n: how often each language's texts (text, lang, neither null) have each n-gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text", BLOCK_CHARS):
                langs, which = np.unique(np.array(b.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                doc, gram, _ = grams(b.column("text").to_pylist())
                for i, lang in enumerate(langs.tolist()):
                    found, n = np.unique(gram[which[doc] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counted = docs.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of docs (text, lang; rows with a null are left out) in order, and the slots' bit masks, a 64-bit word for each 63 languages.

    Counts cover all rows. Only the languages and the slots, whose number is fixed, come to the driver: 4 MB for each 63 languages.
    """
    counts = stored(gram_counts(docs.where("text IS NOT NULL AND lang IS NOT NULL")), "gram-counts")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()}  # a row for each language
    masks = np.zeros((-(-len(totals) // BITS), SLOTS), np.uint64)
    if not totals:
        return [], masks
    langs = list(totals)
    numbered = counts.sparkSession.createDataFrame([(lang, i, float(totals[lang])) for i, lang in enumerate(langs)], "lang string, bit long, total double")
    shares = counts.join(F.broadcast(numbered), "lang").select("bit", "gram", (F.col("n") / F.col("total")).alias("share"))
    most = F.max("share").over(Window.partitionBy("gram"))  # at most a row for each language
    held = shares.withColumn("most", most).where((F.col("share") >= MIN_SHARE) & (F.col("share") >= RATIO * F.col("most")))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, bits = b.column("gram").to_numpy().view(np.uint64), b.column("bit").to_numpy().astype(np.int64)
            at = np.concatenate([slots(gram, i) for i in range(HASHES)])
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(bits // BITS, HASHES)), pa.array(at), pa.array(np.tile(np.int64(1) << bits % BITS, HASHES))], ["word", "slot", "mask"])

    filled = held.select("gram", "bit").mapInArrow(fill, "word long, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most SLOTS rows a word
    masks[filled.column("word").to_numpy(), filled.column("slot").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64)
    return langs, masks


def verdict_of(spark: SparkSession, langs: list[str], masks: np.ndarray) -> Callable[[Column], Column]:
    """lang_pred and score (the corrected share of a text's n-grams that the language has) of a text column, as a struct.

    A text that is null or has no letter is und with score 0; so is every text if no language was learned. If no language
    has an n-gram of the text, it gets the first language with score 0. Equal shares: the first language in order.
    """
    fill = np.array([np.count_nonzero(masks[i // BITS] >> np.uint64(i % BITS) & np.uint64(1)) for i in range(len(langs))]) / SLOTS
    by_chance = (fill**HASHES)[:, None]
    shared = spark.sparkContext.broadcast(masks.astype(np.uint32) if len(langs) <= 32 else masks)

    def decide(texts: list[str]) -> pd.DataFrame:
        doc, gram, has = grams(texts)
        if not langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0})
        hits, at = np.zeros((len(langs), len(texts)), np.int64), [slots(gram, i) for i in range(HASHES)]
        for w, held in enumerate(shared.value):
            one, found = held.dtype.type(1), held[at[0]]
            for i in range(1, HASHES):
                found &= held[at[i]]
            for k in range(w * BITS, min((w + 1) * BITS, len(langs))):
                hits[k] = np.bincount(doc[(found >> held.dtype.type(k % BITS)) & one > 0], minlength=len(texts))
        n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        share = np.clip((hits / n - by_chance) / (1 - by_chance), 0, 1)
        names = np.array([*langs, "und"], object)[np.where(has, share.argmax(0), len(langs))]
        return pd.DataFrame({"lang_pred": names, "score": np.where(has, share.max(0), 0.0)})

    @F.pandas_udf("lang_pred string, score double")
    def verdict(texts: pd.Series) -> pd.DataFrame:
        parts = [decide(some) for some in text_blocks(texts.fillna("").tolist(), BLOCK_CHARS)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": pd.Series(dtype=str), "score": pd.Series(dtype=float)})

    return verdict


def predict(docs: DataFrame, langs: list[str], masks: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs (doc_id, text; other columns are left out), as verdict_of gives them."""
    found = doc_texts(docs).select("doc_id", verdict_of(docs.sparkSession, langs, masks)(F.col("text")).alias("v"))
    return found.select("doc_id", "v.lang_pred", "v.score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predict for all documents, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    langs, masks = learn(docs.where(~fold_is(4, 2)))
    return predict(docs, langs, masks).select("doc_id", fold_is(4, 2).alias("held_out"), "lang_pred", "score")
