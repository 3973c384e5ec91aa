"""Secrets in texts: three patterns, and a battery of randomness tests.

Method: randomness test battery.  A candidate is a long unbroken run of key
characters; parts of a run that a pattern covers are cut out, the others are candidates.
Its encoding (digits, hexadecimal, letters of one case, base32, letters and digits, base64)
is inferred from its characters.  Three tests ask how well the null hypothesis "a word of the corpus"
explains it: chi-squared against a uniform alphabet, the number of runs of character
kinds, and serial correlation of neighbours.  A run of one kind has no changes of kind, so
chi-squared decides there, unless neighbours follow each other as in an alphabet.  What words look like is measured over all texts.
The p-values are combined, weighted by length, and a false-discovery threshold over
all candidates of the corpus decides which are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb, erfc, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.bpe_chunks import text_blocks
from veilmark.llm.common import stored

FALSE_SHARE = 0.01
LEAST = 20
BINS = 4096
# How often kinds change in written-out names: mixed case, and one case with digits.
MIXED_SWITCH, NARROW_SWITCH = 0.35, 0.1
CLUSTERED = 0.3
# The least unevenness of the digits of written-out numbers (dates, padded counts).
NUMBERS = 1 / 6
# The base patterns; letters of the first match in either case.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
ENCODINGS = (
    ("digits", re.compile(r"[0-9]+"), 10),
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16),
    ("letters", re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), 26),
    ("base32", re.compile(r"[A-Z2-7]+=*"), 32),
    ("alnum", re.compile(r"[A-Za-z0-9]+"), 62),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+=*"), 64),
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and apart within each kind."""
    spans = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [
            (m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16
        ]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def infer(run: str) -> tuple[str, int]:
    """(encoding, size of its alphabet): the narrowest that holds the run."""
    for name, pattern, size in ENCODINGS:
        if pattern.fullmatch(run):
            return name, size
    return "base64", 64


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts of key character runs that no base span covers, if they are
    long enough and have a letter or digit."""
    taken: list[list[int]] = []
    for a, _, b in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    first = 0  # runs and base spans are walked side by side
    for match in CANDIDATE.finditer(text):
        at, end = match.span()
        while first < len(taken) and taken[first][1] < at:
            first += 1
        k = first
        while k < len(taken) and taken[k][0] <= end:
            a, b = taken[k]
            if a - at >= LEAST and any(map(str.isalnum, text[at:a])):
                yield at, a
            at = max(at, b)
            k += 1
        if end - at >= LEAST and any(map(str.isalnum, text[at:end])):
            yield at, end
        first = max(first, k - 1)


def statistics(run: str) -> tuple[str, float, int, float]:
    """(encoding, chi-squared over its degrees of freedom, runs of character kinds,
    serial correlation of neighbouring codes)."""
    name, size = infer(run)
    body = run.rstrip("=")
    # a capital at the start is no letter of its own
    body = body.lower() if name == "letters" else body
    codes = np.frombuffer(body.encode(), np.uint8)
    n = len(codes)
    if n < 2:
        return name, float(size), 1, 1.0
    counts = np.bincount(codes, minlength=128)
    expected = n / size
    chi = float((counts.astype(float) ** 2).sum() / expected - n) / (size - 1)
    # separators of written-out names are no kind of their own
    kinds = KIND_OF[codes]
    kinds = kinds[kinds > 0]
    runs = 1 + int((kinds[1:] != kinds[:-1]).sum())
    centred = codes - codes.mean()
    spread = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum() / spread) if spread else 1.0
    return name, chi, runs, serial


KIND_OF = np.zeros(128, np.uint8)
KIND_OF[ord("0") : ord("9") + 1] = 1
KIND_OF[ord("A") : ord("Z") + 1] = 2
KIND_OF[ord("a") : ord("z") + 1] = 3


def below(z: float) -> float:
    """Standard normal distribution function."""
    return 0.5 * erfc(-z / sqrt(2))


def at_least(k: int, n: int, q: float) -> float:
    """Probability of k or more successes in n trials; a normal tail for long runs."""
    if n > 400:
        return below((n * q - k + 0.5) / sqrt(n * q * (1 - q)))
    return min(1.0, sum(comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(k, n + 1)))


class WordNull:
    """How the tests come out on the corpus's ordinary words.

    ``letters`` counts a-z in all texts, ``switches`` and ``pairs`` count changes of
    character kind and neighbours within words.
    """

    def __init__(self, letters: list[int], switches: int, pairs: int) -> None:
        total = sum(letters)
        # at least English-like unevenness, also for a corpus without letters
        shares = [x / total for x in letters] if total else [1 / 16] * 16
        self.unevenness = max(sum(x * x for x in shares), 1 / 20)
        self.cubes = sum(x**3 for x in shares)
        self.switch = min(0.5, (switches + 1) / (pairs + 2))

    def p_value(self, run: str) -> float:
        """Combined p-value of "this run is made of words"."""
        name, size = infer(run)
        n = len(run.rstrip("="))
        if n < 2:
            return 1.0
        _, chi, runs, serial = statistics(run)
        # under words chi-squared is non-central; small values speak against them
        freedom = size - 1
        if name in ("digits", "letters"):
            return self.one_kind(name, n, chi * freedom, serial)
        shift = n * (self.unevenness * size - 1)
        mean = freedom + max(shift, 0.0)
        spread = sqrt(2 * (freedom + 2 * max(shift, 0.0)))
        p_chi = below((chi * freedom - mean) / spread)
        # under words kinds rarely change; names in mixed case change them more often
        usual = MIXED_SWITCH if size > 32 else NARROW_SWITCH
        kinds = int((KIND_OF[np.frombuffer(run.encode(), np.uint8)] > 0).sum())
        p_runs = at_least(runs - 1, max(kinds - 1, runs - 1), max(usual, self.switch))
        # under words kinds cluster, which correlates neighbours
        p_serial = below((serial - CLUSTERED) * sqrt(n)) if runs > 1 else 1.0
        # Fisher's sum over three tests; chi-squared with six degrees of freedom
        s = -sum(log(max(p, 1e-80)) for p in (p_chi, p_runs, p_serial))
        return min(1.0, float(np.exp(-s)) * (1 + s + s * s / 2))

    def one_kind(self, name: str, n: int, chi: float, serial: float) -> float:
        """p-value of a run of letters of one case or of digits.

        Chi-squared is linear in the sum of squared counts, whose mean and variance
        under the shares of a word's letters are known.
        """
        if serial >= CLUSTERED:
            return 1.0
        size = 10 if name == "digits" else 26
        squares = NUMBERS if name == "digits" else self.unevenness
        cubes = squares**1.5 if name == "digits" else self.cubes
        mean = n + n * (n - 1) * squares
        variance = 4 * n**3 * max(cubes - squares**2, 0.0) + 2 * n**2 * squares
        return below(((chi + n) * n / size - mean) / sqrt(variance))


def weighted(p: float, length: int) -> float:
    """Long candidates weigh more, short ones less; weights average about one."""
    return min(1.0, p * (32.0 / length) ** 2)


def to_bin(p: float) -> int:
    """Log-scaled bin of a p-value, smallest first."""
    return max(0, min(BINS - 1, BINS - 1 + int(np.floor(log(max(p, 1e-300), 10) * 13.6))))


def _letter_counts(texts: list[str]) -> tuple[np.ndarray, int, int]:
    letters = np.zeros(26, np.int64)
    switches = pairs = 0
    for text in texts:
        codes = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
        counts = np.bincount(codes, minlength=128)
        letters += counts[97:123] + counts[65:91]
        kinds = KIND_OF[codes]
        inside = (kinds[1:] > 0) & (kinds[:-1] > 0)
        pairs += int(inside.sum())
        switches += int((inside & (kinds[1:] != kinds[:-1])).sum())
    return letters, switches, pairs


def word_null(docs: DataFrame, text_col: str = "text") -> WordNull:
    """Measured over all texts; 28 numbers per task come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, switches, pairs = np.zeros(26, np.int64), 0, 0
        for batch in batches:
            found = _letter_counts([t or "" for t in batch.column(0).to_pylist()])
            letters += found[0]
            switches += found[1]
            pairs += found[2]
        yield pa.record_batch(
            [pa.array(range(28), pa.int32()), pa.array([*letters.tolist(), switches, pairs])],
            names=["item", "n"],
        )

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    sums = rows.mapInArrow(run, "item int, n long").groupBy("item").agg(F.sum("n").alias("n"))
    found = {r["item"]: r["n"] for r in sums.collect()}
    return WordNull([found.get(k, 0) for k in range(26)], found.get(26, 0), found.get(27, 0))


CANDIDATES = (
    "doc_id long, base array<struct<start:int,kind:int,stop:int>>, "
    "random array<struct<start:int,stop:int,bin:int>>"
)


def scan(docs: DataFrame, null: WordNull, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and scored candidates of each row, texts left behind."""

    def one(text: str) -> tuple[list, list]:
        base = base_spans(text)
        random = []
        for a, b in candidates(text, base):
            p = weighted(null.p_value(text[a:b]), b - a)
            random.append({"start": a, "stop": b, "bin": to_bin(p)})
        return [{"start": a, "kind": k, "stop": b} for a, k, b in base], random

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
        scored = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("bin", pa.int32())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in text_blocks(texts):
                found = [one(t) for t in texts[start:stop]]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.array([x for x, _ in found], span),
                        pa.array([x for _, x in found], scored),
                    ],
                    names=["doc_id", "base", "random"],
                )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, CANDIDATES)


def threshold(scanned: DataFrame, false_share: float = FALSE_SHARE) -> int:
    """The last bin whose candidates count: the step-up rule over all candidates.

    At most 4096 numbers come to the driver.
    """
    bins = (
        scanned.select(F.explode("random.bin").alias("bin")).groupBy("bin").count().collect()
    )
    total = sum(r["count"] for r in bins)
    last, rank = -1, 0
    for row in sorted(bins, key=lambda r: r["bin"]):
        rank += row["count"]
        upper = 10 ** ((row["bin"] + 2 - BINS) / 13.6)
        if upper <= false_share * rank / total:
            last = row["bin"]
    return last


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    false_share: float = FALSE_SHARE,
) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, stop), one row per input row.

    ``kind`` is a name's place in ``KINDS``; offsets count code points, ``stop`` is
    exclusive; both arrays are in order of start, then kind.  ``base`` has the three
    patterns' spans, ``spans`` also those of the randomness tests, which never overlap
    a base span.  A null or empty text has none.  Rows that repeat are each returned;
    ids are carried as they are, other columns are not looked at.
    """
    scanned = stored(scan(docs, word_null(docs, text_col), id_col, text_col), "secret-scan")
    last = threshold(scanned, false_share)
    added = F.expr(
        f"transform(filter(random, x -> x.bin <= {last}), "
        "x -> struct(x.start as start, 3 as kind, x.stop as stop))"
    )
    return scanned.select(
        "doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans")
    )


def written(spans: str) -> str:
    """SQL of spans as kind:start:end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return (
        f"array_join(transform({spans}, x -> concat_ws(':', "
        f"element_at(array({names}), x.kind + 1), x.start, x.stop)), ',')"
    )


def mask_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<SECRET>"
) -> DataFrame:
    """The input with every span of its texts replaced by ``mark``; columns unchanged.

    Overlapping spans are masked as one.  Spans are found and cut in the row, so
    repeated or null ids do no harm; the threshold still comes from all rows.
    """
    null = word_null(docs, text_col)
    last = threshold(stored(scan(docs, null, id_col, text_col), "secret-scan"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else cut(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch(
                [pa.array(texts, pa.string()), *batch.columns[1:]], names=batch.schema.names
            )

    def cut(text: str) -> str:
        base = base_spans(text)
        spans = [(a, b) for a, _, b in base]
        for a, b in candidates(text, base):
            if to_bin(weighted(null.p_value(text[a:b]), b - a)) <= last:
                spans.append((a, b))
        out, at = [], 0
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            out += [text[at:a], mark]
            at = b
        return "".join(out) + text[at:]

    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.col(f"`{text_col}`").cast("string"), *[F.col(f"`{c}`") for c in others])
    return rows.mapInArrow(run, rows.schema).select(*[F.col(f"`{c}`") for c in docs.columns])
