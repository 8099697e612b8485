"""LM scoring with Brown class-based n-grams.

Words are assigned to classes by exchange clustering: each word moves to the class that raises the likelihood of the class
bigrams most. The most frequent words, the anchors, move one at a time; with their classes as a start, all other words of the vocabulary
move in a sweep over the whole corpus, in tasks, by their counts with the classes before and after them, and then all words in further ones. A sweep that doesn't raise the likelihood is
dropped, and ends them. A text's probability is that of
its class transitions, smoothed by the classes' own shares, times that of each word in its class. A word has (c + 0.1) of its
class's mass, c its training count, and unknown words share one part of 0.1.

Texts are cut into words once and stored as ids of the vocabulary. Counts cover all training texts and stay in tables. Only the vocabulary,
whose size is a parameter, is sent to tasks; each of the words below it has the class of its last mark, and its count meets the texts that use it in a
join on the word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import blocks, doc_texts, fold_is, stored, table

#: Words that are clustered, into CLASSES classes; of them, the first ANCHORS by exchange of one word at a time in ANCHOR_SWEEPS sweeps; then the others, and from the second of SWEEPS sweeps on all, at once.
VOCABULARY, ANCHORS, CLASSES, ANCHOR_SWEEPS, SWEEPS = 250_000, 1_000, 48, 4, 2
#: Words that came less often are not clustered: so few neighbours tell their own texts' classes, not the language's.
LEAST = 3
PRIOR = 0.1
#: Weight of a class's own share in the transitions, in bigrams.
BACKING = 20.0
END = ""
#: Last marks that tell apart the classes of words below the vocabulary; the first of these classes is that of other words.
MARKS = (".", ",", "!", "?", ":", ";")
TAILS = len(MARKS) + 1
#: The class of words that have none yet.
NONE = 255
CAPITALS = {c: c + 32 for c in range(65, 91)}
#: Cells that a task counts at once, and words whose cells it counts in a table.
AT_ONCE, FREQUENT = 8_000_000, 4096
_words = re.compile("[^\x20\x09-\x0d]+").findall


def words_of(text: str) -> list[str]:
    """The words of a text, A-Z in small letters."""
    return _words(text.translate(CAPITALS) if not text.isascii() else text.lower())


def word_counts(texts: DataFrame) -> DataFrame:
    """word and n over all texts; ends count as a word of no letters. Each task counts before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                held.update(words_of(t))
            if b.num_rows:
                held[END] += b.num_rows
            if len(held) > 300_000:
                yield rows_of(held)
                held.clear()
        yield rows_of(held)

    def rows_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tail_of(word: str) -> int:
    """The place of a word below the vocabulary among the classes of last marks."""
    return MARKS.index(word[-1]) + 1 if word[-1:] in MARKS else 0


@dataclass
class Model:
    """The vocabulary with its classes and log10 of count and prior (the end first); log10 of transition over class mass, at [class before, class]."""

    words: list[str]
    class_of: np.ndarray
    logs: np.ndarray
    step: np.ndarray
    ends: int
    tokens: int
    distinct: int


def vocabulary(counts: DataFrame, size: int = VOCABULARY, least: int = LEAST) -> tuple[list[str], np.ndarray]:
    """The end, then the words that came least times at least, the size most frequent ones at most, and their counts."""
    ends = counts.where(F.col("word") == END).first()
    first = counts.where((F.col("word") != END) & (F.col("n") >= least)).orderBy(F.desc("n"), "word").limit(size).toArrow()
    return [END, *first.column("word").to_pylist()], np.concatenate(([ends.n if ends else 0], first.column("n").to_numpy()))


def word_ids(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, version, ids (32 bits each, without the end) and rare (the words that have only a last mark's id) of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = shared.value, len(shared.value)
        for batch in batches:
            for b in blocks(batch, "text"):
                out, rare, ends = [], [], [0]
                for t in b.column("text").to_pylist():
                    own = words_of(t)
                    ids = np.fromiter(map(known.get, own, NEVER), np.int64, len(own))
                    at = np.flatnonzero(ids < 0)
                    if len(at):
                        lost = [own[i] for i in at.tolist()]
                        ids[at] = [size + tail_of(w) for w in lost]
                        rare += lost
                    ends.append(len(rare))
                    out.append(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), pa.array(out, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare, pa.string()))], ["doc_id", "version", "ids", "rare"])

    return doc_texts(docs).withColumn("version", F.xxhash64("text")).mapInArrow(encode, "doc_id long, version long, ids binary, rare array<string>")


class Never:
    """-1 without end."""

    def __iter__(self) -> Iterator[int]:
        while True:
            yield -1


NEVER = Never()


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The ids of blocks of texts, an end (0) before, between and after them."""
    end = bytes(4)
    for batch in batches:
        for b in blocks(batch, "ids"):
            yield np.frombuffer(end + end.join(b.column("ids").to_pylist()) + end, "<u4")


def summed(cells: Iterator[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Each distinct cell and how often it came, in batches of bounded work."""
    held, n = [], 0
    for c in cells:
        held.append(c)
        n += len(c)
        if n >= AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(held), return_counts=True)], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(held), return_counts=True)], names)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """The class of each word: exchange clustering by the likelihood of class bigrams, sum of n log n over them less that of their margins.

    Words start dealt out by frequency and move one at a time; ties stay. bigrams: n of (word before, word), most frequent words first.
    """
    size = len(bigrams)
    own = np.arange(size) % classes
    one = np.eye(classes)[own]
    right, left = bigrams @ one, bigrams.T @ one  # of each word with each class after and before it
    joint = one.T @ right
    xlog = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(sweeps):
        moved = 0
        for w in range(size):
            k, self_n = own[w], bigrams[w, w]
            r, f = right[w].copy(), left[w].copy()
            r[k] -= self_n
            f[k] -= self_n
            base = joint.copy()
            base[k] -= r
            base[:, k] -= f
            base[k, k] -= self_n
            rows, cols = base.sum(1) + f, base.sum(0) + r  # the words around it stay, whichever class it joins
            # what changes if the word joins class c: row c, column c and the cell where they cross
            x_base = xlog(base)
            crossed = np.diag(base)
            row = xlog(base + r[None, :]).sum(1) - x_base.sum(1) - (xlog(crossed + r) - xlog(crossed))
            col = xlog(base + f[:, None]).sum(0) - x_base.sum(0) - (xlog(crossed + f) - xlog(crossed))
            cell = xlog(crossed + r + f + self_n) - xlog(crossed)
            margin = xlog(rows + r.sum() + self_n) - xlog(rows) + xlog(cols + f.sum() + self_n) - xlog(cols)
            gain = row + col + cell - margin
            best = int(gain.argmax())
            if gain[best] <= gain[k] + 1e-9:
                best = k
            moved += best != k
            joint = base
            joint[best] += r
            joint[:, best] += f
            joint[best, best] += self_n
            if best != k:
                own[w] = best
                # other words' counts with these two classes
                right[:, k] -= bigrams[:, w]
                right[:, best] += bigrams[:, w]
                left[:, k] -= bigrams[w]
                left[:, best] += bigrams[w]
        if not moved:
            break
    return own


def likelihood(joint: np.ndarray) -> float:
    """What the classes say of the class bigrams: sum of n log n over them less that of their margins."""
    xlog = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return xlog(joint) - xlog(joint.sum(0)) - xlog(joint.sum(1))


def bigram_table(rows: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """n of (of[id before], of[id]) over all texts of rows (ids), a size x size table summed by Spark; ids of which of is size are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(of.astype(np.uint16))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wide = np.zeros((size + 1) ** 2, np.int64), size + 1
        for s in runs(batches):
            c = shared.value[s].astype(np.int64)
            held += np.bincount(c[:-1] * wide + c[1:], minlength=wide * wide)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["at", "n"])

    found = rows.select("ids").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # (size + 1)**2 rows at most
    out = np.zeros((size + 1) ** 2)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size + 1, size + 1)[:size, :size]


def contexts(rows: DataFrame, class_of: np.ndarray, first: int, end: int, classes: int) -> DataFrame:
    """word and found (cell, n): how often each id from first to before end stands before (cell: class) and after (cell: classes + class) each class."""
    shared = rows.sparkSession.sparkContext.broadcast(class_of)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for s in runs(batches):
            c, word = shared.value[s], s.astype(np.int64)
            mine = (s >= first) & (s < end)
            for side, here, other in ((0, slice(None, -1), slice(1, None)), (1, slice(1, None), slice(None, -1))):
                at = mine[here] & (c[other] != NONE)
                yield word[here][at] * (2 * classes) + side * classes + c[other][at]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(min(end, FREQUENT) * 2 * classes, np.int64)  # most cells are those of the first words: no sorting for them

        def others() -> Iterator[np.ndarray]:
            for at in cells(batches):
                often = at < len(dense)
                dense[:] += np.bincount(at[often], minlength=len(dense))
                yield at[~often]

        yield from summed(others(), ["at", "n"])
        at = np.flatnonzero(dense)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(dense[at])], ["at", "n"])

    counted = rows.select("ids").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    word = F.expr(f"at div {2 * classes}")
    return counted.groupBy(word.alias("word")).agg(F.collect_list(F.struct((F.col("at") - word * 2 * classes).cast("int").alias("cell"), "n")).alias("found"))  # 2 * classes entries at most


def best_classes(own: np.ndarray, of: np.ndarray, cell: np.ndarray, n: np.ndarray, joint: np.ndarray, allowed: range) -> np.ndarray:
    """The class of allowed that raises the likelihood most for each word; entries: of (the word's place, ascending), cell and n as contexts gives them.

    own is the class that a word has so far, NONE if none: its own counts are taken out of joint there. Ties go to its own class, then to the first.
    """
    classes = len(joint)
    delta = lambda base, more: (base + more) * np.log(np.maximum(base + more, 1e-300)) - base * np.log(np.maximum(base, 1e-300))
    stacked = np.concatenate([joint.T, joint])  # row: cell; column: the word's class
    gain = np.zeros((len(own), classes))
    for a in range(0, len(of), 50_000):
        i = slice(a, a + 50_000)
        base = stacked[cell[i]]
        has = np.flatnonzero(own[of[i]] != NONE)
        base[has, own[of[i][has]]] -= n[i][has]
        np.add.at(gain, of[i], delta(np.maximum(base, 0), n[i][:, None]))
    for side, margin in ((0, joint.sum(1)), (1, joint.sum(0))):
        total = np.bincount(of, np.where(cell // classes == side, n, 0), minlength=len(own))
        base = np.repeat(margin[None, :], len(own), 0)
        has = np.flatnonzero(own != NONE)
        base[has, own[has]] -= total[has]
        gain -= delta(np.maximum(base, 0), total[:, None])
    has = np.flatnonzero(own != NONE)
    gain[has, own[has]] += 1e-9
    return allowed.start + gain[:, allowed.start : allowed.stop].argmax(1)


def sweep(rows: DataFrame, class_of: np.ndarray, joint: np.ndarray, first: int, end: int, allowed: range) -> np.ndarray:
    """class_of after each id from first to before end has moved to its best class. Ids that no class surrounds stay."""
    shared = rows.sparkSession.sparkContext.broadcast(class_of)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, lists = b.column("word").to_numpy(), b.column("found")
            entries = lists.flatten()
            of = np.repeat(np.arange(len(words)), lists.value_lengths().to_numpy())
            found = best_classes(shared.value[words], of, entries.field("cell").to_numpy(), entries.field("n").to_numpy(), joint, allowed)
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(found)], ["word", "class"])

    moved = contexts(rows, class_of, first, end, len(joint)).mapInArrow(move, "word long, class long").toArrow()  # a row for each word of the vocabulary at most
    out = class_of.copy()
    out[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
    return out


def learn(rows: DataFrame, counts: DataFrame, words: list[str], n: np.ndarray, anchors: int = ANCHORS, classes: int = CLASSES, sweeps: int = SWEEPS) -> Model:
    """The model of the training rows (ids, as word_ids gives them for words) and counts (word, n); n: the counts of words. No rows give a model of the end alone; rows that repeat a doc_id, with one text or several, are
    learned from each."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    size, anchored = len(words), min(anchors + 1, len(words))
    # classes: the end, the clusters, the last marks
    classes = min(classes, max(anchored - 1, 1))
    width, tails = classes + 1 + TAILS, classes + 1 + np.arange(TAILS)
    class_of = np.full(size + TAILS, NONE, np.uint8)
    class_of[0], class_of[size:] = 0, tails
    if anchored > 1:
        place = np.full(size + TAILS, anchored, np.int64)
        place[:anchored] = np.arange(anchored)
        class_of[1:anchored] = 1 + exchange(bigram_table(rows, place, anchored)[1:, 1:], classes, ANCHOR_SWEEPS)
    joint = lambda of: bigram_table(rows, np.where(of == NONE, width, of), width)
    transitions, first = joint(class_of), anchored
    for k in range(sweeps if size > anchored else 0):
        moved = sweep(rows, class_of, transitions, first, size, range(1, classes + 1))
        moved[:size][moved[:size] == NONE] = 1
        table_ = joint(moved)
        if k and likelihood(table_) <= likelihood(transitions):
            break  # words that move at once may spoil it: the classes before stay
        class_of, transitions, first = moved, table_, 1  # anchors move from now on, too
    # the mass of a class: its words' counts and 0.1 for each of its words; classes by last mark have 0.1 more for unknown words
    mass = np.bincount(class_of[:size], n + PRIOR, minlength=width).astype(float)
    mass[tails] = PRIOR
    if size - 1 < total.v - 1:  # there are words below the vocabulary
        last = F.right("word", F.lit(1))
        inside = Counter()
        for w, k in zip(words[1:], n[1:].tolist()):
            inside[tail_of(w)] += k + PRIOR
        for r in counts.where(F.col("word") != END).groupBy(F.when(last.isin(*MARKS), last).otherwise("").alias("last")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            mass[tails[tail_of(r["last"])]] += max(r.n + PRIOR * r.v - inside[tail_of(r["last"])], 0.0)
    share = mass / mass.sum()
    smoothed = (transitions + BACKING * share) / (transitions.sum(1, keepdims=True) + BACKING)
    step = np.log10(np.where(mass > 0, smoothed, 1.0)) - np.log10(np.where(mass > 0, mass, 1.0))  # classes without words are never asked for
    return Model(words, class_of, np.log10(n + PRIOR), step, int(n[0]), int(total.n), int(total.v))


def scored(rows: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each of rows, as word_ids gives them for the model's words.

    A null or empty text has its end alone. Rows that repeat a doc_id are scored each.
    counts: word and n of the training texts, which the words below the vocabulary are joined with.
    """
    size = len(model.words)
    # words below the vocabulary have their logs from the join
    logs = np.concatenate([model.logs, np.zeros(TAILS)])
    shared = rows.sparkSession.sparkContext.broadcast((model.class_of, logs, model.step))
    ends = int(model.ends > 0)
    base = float(np.log10(model.tokens + PRIOR * (model.distinct + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, logs, step = shared.value
        end = np.zeros(1, np.int64)
        for batch in batches:
            for b in blocks(batch, "ids"):
                out = []
                for x in b.column("ids").to_pylist():
                    ids = np.concatenate([end, np.frombuffer(x, "<u4"), end])
                    c = class_of[ids]
                    own = ids[1:]
                    out.append((len(own), int((own[:-1] < size).sum()) + ends, float(logs[own].sum()), float(step[c[:-1], c[1:]].sum())))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), *[pa.array(v) for v in zip(*out)]], ["doc_id", "version", "n_tokens", "known", "found", "steps"])

    whole = rows.select("doc_id", "version", "ids").mapInArrow(score, "doc_id long, version long, n_tokens long, known long, found double, steps double").withColumn("rows", F.lit(1).cast("long"))
    times = rows.where(F.size("rare") > 0).select("doc_id", "version", F.explode("rare").alias("word")).groupBy("doc_id", "version", "word").agg(F.count("*").alias("times"))
    log = F.log10(F.coalesce("n", F.lit(0)) + PRIOR)
    rare = times.join(counts, "word", "left").select(
        "doc_id", "version", F.lit(None).cast("long").alias("n_tokens"), F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"), (F.col("times") * log).alias("found"), F.lit(None).cast("double").alias("steps"), F.lit(0).cast("long").alias("rows")
    )
    # rows of one doc_id and text are equal: their sums are shared out and the row is given as often
    sums = whole.unionByName(rare).groupBy("doc_id", "version").agg(F.sum("rows").alias("rows"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("known"), F.sum("found").alias("found"), F.max("steps").alias("steps"))
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    logs_of = F.col("found") / F.col("rows")
    return each.select(
        "doc_id", "n_tokens", F.expr("known div rows").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (logs_of - F.col("n_tokens") * base).alias("base_score"), (logs_of + F.col("steps")).alias("score")
    )


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored for all documents, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    counts = stored(word_counts(doc_texts(docs).where(~fold_is(10, 0))), "word-counts")
    words, n = vocabulary(counts)
    rows = stored(word_ids(docs, words), "word-ids")
    model = learn(rows.where(~fold_is(10, 0)), counts, words, n)
    return scored(rows, counts, model).select("doc_id", fold_is(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
