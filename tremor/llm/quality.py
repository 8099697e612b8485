"""Quality classifier by Bradley-Terry pairwise ranking.

The features of a text are how often its kinds of characters follow each other, and how often words and lines
repeat. Preference pairs, a good text over a bad one, give a logistic loss on the difference of their features; its weights
score any text. The threshold is a quantile of the scores of the learning rows: the share of bad ones among them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.llm.common import blocks, doc_texts, fold_is, stored, table, text_blocks

#: Score at and above which a text is predicted good.
CUT = 0.3
#: Bounds of the fit: labelled rows, picked by a hash of their key; pairs for each row of the rarer label.
MOST_ROWS, PAIRS = 20_000, 6

KINDS = 16


def kinds() -> np.ndarray:
    """The kind of each byte: 0 small letter (and every byte of a wider code point), 1 capital, 2 digit, 3 blank, 4 line end, then marks."""
    kind = np.full(256, 15, np.uint8)
    kind[128:] = 0
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "|", "*", "#$%&@~^", "'\"`", ":;-/", "<>{}[]()\\_=+")):
        kind[list(chars.encode())] = k
    return kind


#: Pairs added to each text, so that a few characters alone don't decide.
PRIOR = 20
KIND = kinds()
FEATURES = KINDS * KINDS + 3


def features(texts: list[bytes]) -> np.ndarray:
    """A row for each text: roots of the shares of its pairs of kinds, of its repeated words and lines, and a bounded log of its size."""
    sizes = np.array([len(t) for t in texts], np.int64)
    kind = KIND[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)].astype(np.int64)
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    pairs = of[:-1] * KINDS**2 + kind[:-1] * KINDS + kind[1:]
    inside = of[:-1] == of[1:]  # the line end that divides the texts ends each of them
    counts = np.bincount(pairs[inside], minlength=len(texts) * KINDS**2).reshape(len(texts), KINDS**2)
    more = np.zeros((len(texts), 3))
    for i, t in enumerate(texts):
        words, lines = t.split(), t.split(b"\n")
        more[i] = 1 - len(set(words)) / max(len(words), 1), 1 - len(set(lines)) / len(lines), min(math.log1p(len(words)), 8) / 8
    return np.hstack([np.sqrt(counts / (counts.sum(1, keepdims=True) + PRIOR)), more])


@dataclass(frozen=True)
class Ranking:
    """Weights of the features, and the raw score at the threshold with the scale of the scores around it."""

    weights: tuple[float, ...]
    cut: float
    scale: float

    def scores(self, raw: np.ndarray) -> np.ndarray:
        """0 to 1, and CUT at the threshold."""
        z = (raw - self.cut) / self.scale + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id, features and version (a hash of the text) of each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                x = features(b.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "version", "features"])

    return doc_texts(docs).withColumn("version", F.xxhash64("text")).mapInArrow(make, "doc_id long, version long, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, pairs: int = PAIRS) -> Ranking:
    """Learns from docs (doc_id, text) and labels (doc_id, quality), of whose rows most_rows are taken at most, by a hash of doc_id.

    Labels that are null or not 0 or 1 and labels without a text are left out; a doc_id that has both labels is too. With one label alone,
    or none, all weights are 0 and every score is CUT. Of several texts of one doc_id the one of the least hash is learned from.
    """
    good = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    picked = good.where("quality = most").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = doc_texts(docs).join(F.broadcast(picked), "doc_id")  # most_rows rows of 12 bytes
    one = with_features(texts).groupBy("doc_id").agg(F.min_by("features", "version").alias("features"))
    rows = stored(one.join(F.broadcast(picked), "doc_id"), "quality-rows")
    n = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Ranking((0.0,) * FEATURES, 0.0, 1.0)
    # both windows hold at most most_rows rows
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")) - 1)
    rare = min(n, key=n.get)
    many, few = n[1 - rare], n[rare]
    # each row of the rarer label meets `pairs` others, and each of the others is met as evenly
    each = max(pairs, math.ceil(many / few))
    left = placed.where(F.col("quality") == rare).select(F.col("at").alias("a"), F.col("features").alias("x")).withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda k: (F.col("a") * each + k) % many)))
    right = placed.where(F.col("quality") == 1 - rare).select("at", F.col("features").alias("y"))
    sign = 1.0 if rare == 1 else -1.0
    difference = F.zip_with("x", "y", lambda x, y: (x - y) * F.when(F.col("up"), sign).otherwise(-sign))
    # every second pair is turned round, so that both outcomes occur
    met = left.join(right, "at").withColumn("up", F.xxhash64("a", "at") % 2 == 0)
    learned = stored(met.select(array_to_vector(difference).alias("features"), F.col("up").cast("double").alias("label")), "quality-pairs")
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=1e-4, maxIter=60).fit(learned)
    weights = tuple(float(w) for w in model.coefficients)
    raw = rows.select("quality", F.aggregate(F.zip_with("features", F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x).alias("raw"))
    share = n[0] / (n[0] + n[1])
    cut, low, high = raw.agg(F.percentile("raw", F.array(*map(F.lit, (share, 0.25, 0.75))))).first()[0]
    return Ranking(weights, cut, max((high - low) / 4, 1e-3))


def score_of(ranking: Ranking) -> Callable[[Column], Column]:
    """The score (0 to 1) of a text column; a null or empty text has the score of no text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = np.array(ranking.weights)
        found = [ranking.scores(features([t.encode("utf-8", "surrogatepass") for t in some]) @ w) for some in text_blocks(texts.fillna("").tolist())]
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    return score


def scored(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from CUT on) of each row of docs (doc_id, text; other columns are left out)."""
    return doc_texts(docs).select("doc_id", score_of(ranking)(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored for all documents, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    ranking = fit(docs, table(spark, sf_dir, "labels").where(~fold_is(5, 0)))
    return scored(docs, ranking).select("doc_id", fold_is(5, 0).alias("held_out"), "score", "predicted")
