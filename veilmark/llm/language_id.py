"""Language identification by words first and character n-grams for unseen words.

Method: word-first backoff.  A word the model knows has a log frequency in each
language.  A word it does not know is scored by its longest known character n-grams:
the n-grams of the largest order of which any is known, then shorter ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilmark.llm.bpe_chunks import Memory, text_blocks
from veilmark.llm.common import stored

SAMPLE_DOCS = 20_000
WORDS = 50_000
GRAMS = 100_000
ORDER = 5
KEPT = 100_000
NO_LANGUAGE = "und"
NO_LETTER, NO_MODEL = "rejected: no letter", "no model"
# training splits at everything else
RUN = regex.compile(r"[\p{L}\p{M}]+")


class LanguageModel:
    """Log frequencies by word and by n-gram, one column per language."""

    def __init__(
        self, languages: list[str], words: dict[str, bytes], grams: dict[str, bytes]
    ) -> None:
        self.languages = languages
        self.words = words  # word -> log frequencies, as bytes of 32-bit floats
        self.grams = grams
        self.table: Memory | None = None

    def word(self, word: str) -> bytes:
        """Log frequencies of a known word, else the mean of its longest known n-grams."""
        found = self.words.get(word)
        if found is not None:
            return found
        marked, get = f" {word} ", self.grams.get
        for n in range(ORDER, 0, -1):
            known = [get(marked[k : k + n]) for k in range(len(marked) - n + 1)]
            known = [row for row in known if row is not None]
            if known:
                rows = np.frombuffer(b"".join(known), np.float32)
                return rows.reshape(len(known), -1).mean(0).tobytes()
        return bytes(4 * len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the share of the evidence's posterior."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, str | None]:
        """(language, score, why there is no language)."""
        found = RUN.findall((text or "").lower())
        if not found or not any(any(c.isalpha() for c in w) for w in set(found)):
            return NO_LANGUAGE, 0.0, NO_LETTER
        if not self.languages:
            return NO_LANGUAGE, 0.0, NO_MODEL
        table = self.table
        if table is None:
            table = self.table = Memory(self.word, KEPT)
        table.tidy()
        rows = np.frombuffer(b"".join(map(table.__getitem__, found)), np.float32)
        mean = rows.reshape(-1, len(self.languages)).sum(0, dtype=np.float64)
        # words are not independent: their joint evidence counts by its square root
        mean /= np.sqrt(len(found))
        weights = np.exp(mean - mean.max())
        best = int(np.argmax(weights))
        return self.languages[best], float(weights[best] / weights.sum()), None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "table": None}


def _log_frequencies(
    counts: DataFrame, key: str, most: int, totals: dict[str, int]
) -> dict[str, bytes]:
    """Smoothed log frequencies by language of the commonest keys of each language.

    Every language has the same share of the ``most`` keys.  Ties in the count are broken
    by the key, so the model does not depend on the order of rows.  Labels stay values.
    """
    languages = sorted(totals)
    if not languages:
        return {}
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), key))
    chosen = (
        counts.withColumn("place", place)
        .where(F.col("place") <= max(1, most // len(languages)))
        .select(key)
        .distinct()
    )
    rows = counts.join(F.broadcast(chosen), key).select(key, "lang", "n").toArrow()
    column = {x: k for k, x in enumerate(languages)}
    found: dict[str, np.ndarray] = {}
    for name, lang, n in zip(*(rows.column(c).to_pylist() for c in (key, "lang", "n")), strict=True):
        found.setdefault(name, np.zeros(len(languages)))[column[lang]] = n
    smooth = 0.1
    base = np.array([totals[x] for x in languages]) + smooth * most
    return {k: np.log((row + smooth) / base).astype(np.float32).tobytes() for k, row in found.items()}


def _sums(counts: DataFrame) -> dict[str, int]:
    return {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}


def train(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    words: int = WORDS,
    grams: int = GRAMS,
) -> LanguageModel:
    """Fit the model to labelled rows; rows without a label or text teach nothing.

    About ``sample_docs`` labelled rows are used at most, whole distinct texts drawn by a
    hash of the text.  Every language has the same share of them, and a language with fewer
    rows gives all it has, so none is lost beside a larger one.  The model holds at most
    ``words`` words and ``grams`` n-grams, shared out in the same way: what is collected and
    sent to the workers is bounded by them and the number of labels.
    """
    labelled = docs.select(
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    ).where("text is not null and lang is not null")
    rows = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    languages = F.count(F.lit(1)).over(Window.partitionBy())
    # one row a language
    shares = rows.select("lang", (F.lit(sample_docs) / languages / F.col("rows")).alias("share"))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    chosen = (
        labelled.join(F.broadcast(shares), "lang")
        .where(place < F.col("share") * (1 << 20))
        .select("lang", "text")
        .distinct()
    )
    word_counts = (
        chosen.select("lang", F.explode(F.expr(r"split(lower(text), '[^\\p{L}\\p{M}]+')")).alias("word"))
        .where("word <> ''")
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # each is read several times
    word_counts = stored(word_counts, "word-counts")
    totals = _sums(word_counts)
    known = _log_frequencies(word_counts, "word", words, totals)
    marked = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    gram_counts = (
        word_counts.withColumn("w", marked)
        .withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(ORDER))))
        .where("length(w) >= size")
        .withColumn("at", F.explode(F.expr("sequence(1, length(w) - size + 1)")))
        .select("lang", F.expr("substring(w, at, size)").alias("gram"), "n")
        .where("gram <> ' '")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    gram_counts = stored(gram_counts, "gram-counts")
    parts = _log_frequencies(gram_counts, "gram", grams, _sums(gram_counts))
    return LanguageModel(sorted(totals), known, parts)


def identify(
    docs: DataFrame,
    model: LanguageModel,
    *keep: Column | str,
    text_col: str = "text",
    reason: str | None = None,
) -> DataFrame:
    """Columns ``keep`` with lang_pred and score, one row per input row.

    Whole texts are read.  A text that is null or has no letter is ``und`` with score
    0; so is every text when the model was trained on nothing.  A column named by ``reason``
    tells them apart: ``NO_LETTER``, ``NO_MODEL``, or null for a language.  The score is between
    0 and 1.  Columns that are not kept are not looked at.  Equal posteriors go to the language that comes first by name.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kept = rows.drop("_text").schema
    added = ["lang_pred", "score"] + ([reason] if reason else [])
    if {*added, "_text"} & {f.name for f in kept}:
        raise ValueError("kept columns must not be named like the result's")
    names = [f.name for f in kept] + added

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for start, stop in text_blocks([t or "" for t in texts]):
                found = [work.judge(t) for t in texts[start:stop]]
                part = batch.slice(start, stop - start)
                yield pa.record_batch(
                    [part.column(k) for k in range(part.num_columns - 1)]
                    + [
                        pa.array([x for x, _, _ in found], pa.string()),
                        pa.array([x for _, x, _ in found], pa.float64()),
                        pa.array([x for _, _, x in found], pa.string()),
                    ][: len(added)],
                    names=names,
                )

    schema = kept.add("lang_pred", "string").add("score", "double")
    if reason:
        schema = schema.add(reason, "string")
    return rows.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
