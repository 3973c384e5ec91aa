"""Toxicity of texts by subword-bag embeddings.

Method: a word is the mean of the vectors of its character n-grams and of itself, a
passage the mean of its words, and a linear softmax over that mean gives the two labels.
Vectors and softmax are trained together in numpy.  A misspelling that training never
saw still shares most n-grams with its word.  A text scores as its worst passage, so a
toxic paragraph is not thinned out by the rest of a long text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.bpe_chunks import Memory

SAMPLE_ROWS = 1500
SAMPLE_PASSAGES = 10_000
PASSAGE_WORDS = 48
BUCKETS = 1 << 18
KEPT_WORDS = 250_000
# letters, marks and digits; an unbroken run of them is cut every 32
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]{1,32}")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label is not learned from; a null id counts as an empty text."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % 5 == 0


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def passages(count: int, size: int = PASSAGE_WORDS) -> np.ndarray:
    """Where passages of about equal length, at most ``size`` words, begin."""
    parts = max(1, -(-count // size))
    return np.arange(parts) * count // parts


def subwords(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the marked word and of its n-grams of 3 to 5 characters."""
    marked = f"<{word}>"
    grams = {marked[k : k + n] for n in (3, 4, 5) for k in range(len(marked) - n + 1)}
    return sorted(zlib.crc32(g.encode()) % buckets for g in grams | {marked + " "})


@dataclass(frozen=True)
class Model:
    """What scoring needs: each bucket's share of the log odds, and their offset.

    The mean of vectors under a linear softmax is linear in every bucket, so vectors and
    softmax fold into one number a bucket.
    """

    weights: np.ndarray
    offset: float


@dataclass
class Trainer:
    """Stochastic gradient descent over embeddings and softmax together, by passage.

    Only buckets whose rates in toxic and clean texts differ by ``apart`` standard errors are
    learned: most others would only name single texts.  Steps of a bucket are scaled by
    its mean square share, so that frequent n-grams do not slow down the telling ones;
    ``damping`` holds back those that fewer than that share of all passages hold.
    """

    buckets: int = BUCKETS
    width: int = 8
    epochs: int = 12
    rate: float = 0.5
    apart: float = 4.0
    damping: float = 0.01
    seed: int = 7
    found: dict[str, np.ndarray] = field(default_factory=dict)

    def _subwords(self, word: str) -> np.ndarray:
        if word not in self.found:
            self.found[word] = np.array(subwords(word, self.buckets), np.int32)
        return self.found[word]

    def _bag(self, passage: str) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, their shares of the passage's mean)"""
        words = passage.split()
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        grams = [self._subwords(w) for w in words]
        sizes = np.array([len(g) for g in grams])
        ids, place = np.unique(np.concatenate(grams), return_inverse=True)
        shares = np.bincount(place, np.repeat(1 / sizes, sizes)) / len(words)
        return ids, shares.astype(np.float32)

    def _telling(self, passages: list[str], labels: np.ndarray, order: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Buckets whose rates among toxic and clean texts differ by ``apart`` errors."""
        held, total = np.zeros((2, self.buckets)), np.zeros(2)
        for start, stop in zip(firsts, np.append(firsts[1:], len(order))):
            ids = np.concatenate([self._bag(passages[k])[0] for k in order[start:stop]])
            label = labels[order[start]]
            held[label, np.unique(ids)] += 1
            total[label] += 1
        rate = held.sum(0) / total.sum()
        error = np.sqrt(rate * (1 - rate) * (1 / total[0] + 1 / total[1]))
        return np.abs(held[1] / total[1] - held[0] / total[0]) > self.apart * error + 1e-12

    def fit(self, passages: list[str], labels: np.ndarray, groups: np.ndarray) -> Model:
        """Fit on passages: their words, the label (0 or 1) and the text each is from.

        A label is the whole text's, so a toxic text may have clean passages.  Each epoch
        learns from every text's worst passage as the model then sees it, which is
        what scoring goes by, and from one drawn at random.  With one label alone the
        score is that label.
        """
        if len(set(labels.tolist())) < 2:
            return Model(np.zeros(self.buckets), 30.0 if labels.any() else -30.0)
        rng = np.random.default_rng(self.seed)
        order = np.argsort(groups, kind="stable")
        firsts = np.flatnonzero(np.diff(groups[order], prepend=groups[order[0]] - 1))
        counts = np.diff(np.append(firsts, len(order)))
        known = self._telling(passages, labels, order, firsts)
        bags = []
        for passage in passages:
            ids, share = self._bag(passage)
            bags.append((ids[known[ids]], share[known[ids]]))
        self.found.clear()
        sizes = np.array([len(ids) for ids, _ in bags])
        all_ids = np.concatenate([ids for ids, _ in bags])
        all_shares = np.concatenate([share for _, share in bags])
        rows = np.repeat(np.arange(len(bags)), sizes)

        vectors = np.zeros((self.buckets, self.width))
        softmax = rng.normal(0, self.width**-0.5, (self.width, 2))
        offset = np.zeros(2)
        # both labels weigh the same in all
        by_text = np.bincount(labels[order[firsts]], minlength=2)
        weight = len(firsts) / 2 / np.maximum(by_text, 1)
        square = np.bincount(all_ids, all_shares**2, self.buckets) / len(bags)
        typical = square.sum() * len(bags) / max(len(all_ids), 1)
        scale = 1 / (square + self.damping * typical + 1e-30)
        size = float((all_shares**2 * scale[all_ids]).sum()) / len(bags) or 1.0
        steps, done = self.epochs * 2 * len(firsts), 0
        for _ in range(self.epochs):
            folded = vectors @ (softmax[:, 1] - softmax[:, 0])
            seen = np.bincount(rows, folded[all_ids] * all_shares, len(bags))[order]
            # the last of each text's passages when ordered by odds is its worst
            worst = order[np.lexsort((seen, groups[order]))[firsts + counts - 1]]
            drawn = order[firsts + rng.integers(0, counts)]
            for k in rng.permutation(np.concatenate([worst, drawn])):
                (ids, share), label = bags[k], labels[k]
                rate = self.rate * (1 - done / steps)
                done += 1
                mean = share @ vectors[ids]
                logits = mean @ softmax + offset
                odds = np.exp(logits - logits.max())
                error = odds / odds.sum()
                error[label] -= 1
                error *= weight[label]
                vectors[ids] -= np.outer(rate / size * scale[ids] * share, softmax @ error)
                softmax -= 0.01 * rate * np.outer(mean, error)
                offset -= 0.1 * rate * error
        apart = softmax[:, 1] - softmax[:, 0]
        return Model(vectors @ apart, float(offset[1] - offset[0]))


class Scorer:
    """Scores texts; a word's share of the log odds is kept while it is in use."""

    def __init__(self, model: Model, size: int = PASSAGE_WORDS, kept: int = KEPT_WORDS) -> None:
        self.weights, self.offset, self.size = model.weights.tolist(), model.offset, size
        self.buckets = len(self.weights)
        self.words = Memory(self._word, kept)

    def _word(self, word: str) -> float:
        grams = subwords(word, self.buckets)
        return sum(map(self.weights.__getitem__, grams)) / len(grams)

    def score(self, text: str | None) -> float:
        self.words.tidy()
        found = words_of(text)
        odds = self.offset
        if found:
            shares = np.fromiter(map(self.words.__getitem__, found), float, len(found))
            starts = passages(len(found), self.size)
            sizes = np.diff(np.append(starts, len(found)))
            odds += float((np.add.reduceat(shares, starts) / sizes).max())
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def training_passages(
    labelled: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    rows: int = SAMPLE_ROWS,
    limit: int = SAMPLE_PASSAGES,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = PASSAGE_WORDS,
) -> DataFrame:
    """(label, name, place, words): a bounded sample of passages of labelled rows.

    Of each label about ``rows`` rows are drawn by a hash of the id, or all if there are no
    more; only their ids are broadcast.  Their whole texts are cut into passages, of which at
    most ``limit`` a label are taken, by a hash.  Labels other than 0 and 1 and rows
    without an id are not learned from.
    """
    known = labels.select(
        F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("label")
    ).where("_id is not null and label in (0, 1)").distinct()
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64("_id", F.lit("rows")), F.lit(1_000_000))
    share = F.lit(0)
    for label, count in sorted(counts.items()):
        share = F.when(F.col("label") == label, min(1_000_000, rows * 1_000_000 // count + 1)).otherwise(share)
    picked = F.broadcast(known.where(place < share))
    texts = labelled.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")
    ).join(picked, "_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words_of(text)
                stops = np.append(passages(len(found), size), len(found)).tolist()
                for at in range(0, len(stops) - 1, 4096):
                    here = list(zip(stops[at : at + 4096], stops[at + 1 : at + 4097]))
                    yield pa.record_batch(
                        [
                            pa.array([label] * len(here), pa.int32()),
                            pa.array([name] * len(here), pa.int64()),
                            pa.array([a for a, _ in here], pa.int64()),
                            pa.array([" ".join(found[a:b]) for a, b in here]),
                        ],
                        names=["label", "_id", "start", "words"],
                    )

    cuts = texts.select("_id", "text", "label").mapInArrow(
        cut, "label int, _id long, start long, words string"
    )
    cuts = cuts.withColumn("place", F.xxhash64("_id", "start", "words"))
    both = [cuts.where(F.col("label") == k).orderBy("place", "words").limit(limit) for k in (0, 1)]
    return both[0].unionByName(both[1]).select("label", F.col("_id").alias("name"), "place", "words")


def train(sample: DataFrame, trainer: Trainer | None = None) -> Model:
    """Fit on the rows of ``training_passages``, a bounded number, on the driver."""
    rows = sorted(sample.select("place", "words", "label", "name").collect())
    labels = np.array([r[2] for r in rows], np.int64)
    # a text that carries both labels stands for two
    names = [2 * r[3] + r[2] for r in rows]
    return (trainer or Trainer()).fit([r[1] for r in rows], labels, np.array(names))


def score_texts(
    docs: DataFrame, model: Model, *keep: str | Column, text_col: str = "text"
) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1, higher is likelier toxic) and ``predicted``.

    Every row gets a score, from its whole text: the highest of its passages.  A null text
    counts as empty; a text without words scores as the model's offset alone.  Words are
    lower-cased runs of letters, marks and digits.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(
        Model(model.weights.astype(np.float32), model.offset)
    )
    kept = docs.select(*keep)
    chosen = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = np.array([scorer.score(t.as_py()) for t in batch.column(len(names))])
            yield pa.record_batch(
                [
                    *batch.columns[:-1],
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= 0.5).astype(np.int32)),
                ],
                names=[*names, "score", "predicted"],
            )

    schema = kept.schema.add("score", "double").add("predicted", "integer")
    return chosen.mapInArrow(run, schema)
