"""Near-duplicates of embeddings by cosine, found by lattice hashing.

Method: lattice hashing.  Each of several tables projects a unit vector to a few
blocks of eight dimensions, and decodes each block to the nearest point of the E8
lattice; the points name the cell.  A vector is stored in its own cell and looked up
in it and in the cells that differ by one of the nearest lattice neighbours in one
block.  Pairs that meet are compared by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import join_groups, stored
from veilmark.llm.components import components


@dataclass(frozen=True)
class Lattice:
    """The index: more ``blocks`` make cells smaller, more ``tables`` and ``probes``
    (neighbours per block) find more; ``scale`` sets the cell width."""

    tables: int = 6
    blocks: int = 3
    probes: int = 3
    scale: float = 4.0
    seed: int = 7


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    whole = np.rint(x)
    odd = (whole.sum(1) % 2) != 0
    rows = np.flatnonzero(odd)
    off = x[rows] - whole[rows]
    worst = np.abs(off).argmax(1)
    whole[rows, worst] += np.where(off[np.arange(len(rows)), worst] >= 0, 1.0, -1.0)
    return whole


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: D8 or D8 moved by one half in every coordinate."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
    return np.where(closer[:, None], b, a)


def shortest_e8() -> np.ndarray:
    """The 240 shortest vectors of E8, the steps to a point's neighbours."""
    rows = []
    for i in range(8):
        for j in range(i):
            for s in (1.0, -1.0):
                for t in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = s, t
                    rows.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> k & 1 else -0.5 for k in range(8)])
        if v.sum() % 2 == 0:
            rows.append(v)
    return np.array(rows)


def projections(dims: int, lattice: Lattice) -> np.ndarray:
    """(tables, 8 * blocks, dims): random, with orthogonal rows where they fit."""
    rng = np.random.default_rng(lattice.seed)
    out = []
    for _ in range(lattice.tables):
        rows: list[np.ndarray] = []
        while sum(map(len, rows)) < 8 * lattice.blocks:
            q, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
            rows.append(q.T)
        out.append(np.concatenate(rows)[: 8 * lattice.blocks])
    # lengths are kept on average whatever the dimension
    return np.array(out) * np.sqrt(dims / 8) * lattice.scale / np.sqrt(8)


def cells(unit: np.ndarray, lattice: Lattice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per table (own cells, looked-up cells): a 64-bit name for each lattice tuple."""
    steps = shortest_e8()
    rng = np.random.default_rng(lattice.seed + 1)
    weights = rng.integers(1, 1 << 62, (lattice.blocks, 8), dtype=np.int64) | 1
    salts = rng.integers(1, 1 << 62, lattice.tables, dtype=np.int64)
    step_names = np.rint(2 * steps).astype(np.int64) @ weights.T  # wraps around
    for k, projection in enumerate(projections(unit.shape[1], lattice)):
        own = np.full(len(unit), salts[k], np.int64)
        moves = []
        for b in range(lattice.blocks):
            x = unit @ projection[8 * b : 8 * b + 8].T
            point = nearest_e8(x)
            own += np.rint(2 * point).astype(np.int64) @ weights[b]
            gain = (x - point) @ steps.T
            best = np.argpartition(-gain, lattice.probes - 1, axis=1)[:, : lattice.probes]
            moves.append(step_names[best, b])
        looked = np.concatenate([np.zeros((len(unit), 1), np.int64), *moves], 1)
        yield own, own[:, None] + looked


def unit_vectors(raw: pa.Array, dims: int) -> np.ndarray:
    data = b"".join(raw.to_pylist())
    x = np.frombuffer(data, "<f8").reshape(-1, dims)
    # by the largest component first: squares neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


CLEAN = "vec_id long, label string, dims int, vector binary"
CELLS = "vec long, cell long, looked boolean, label string, dims int"


def clean(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, dims, vector): vectors as bytes of doubles; ``vector`` is null for
    rows that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = [], []
            for label, values in zip(
                batch.column(1).to_pylist(), batch.column(2), strict=True
            ):
                x = None
                if label is not None and values.is_valid and not values.values.null_count:
                    x = values.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                    if not (len(x) and np.isfinite(x).all() and x.any()):
                        x = None
                dims.append(0 if x is None else len(x))
                out.append(None if x is None else x.tobytes())
            yield pa.record_batch(
                [
                    batch.column(0), batch.column(1), pa.array(dims, pa.int32()),
                    pa.array(out, pa.binary()),
                ],
                names=["vec_id", "label", "dims", "vector"],
            )

    return rows.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    ).mapInArrow(run, CLEAN)


def hashed(classes: DataFrame, lattice: Lattice) -> DataFrame:
    """(vec, cell, looked, label, dims): where each class is stored and looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                sizes = part.column(2).to_numpy()
                for dims in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == dims)
                    rows = part.take(pa.array(at))
                    unit = unit_vectors(rows.column(3), dims)
                    for own, looked in cells(unit, lattice):
                        names = np.concatenate([own[:, None], looked], 1)
                        wide = names.shape[1]
                        index = pa.array(np.repeat(np.arange(len(at)), wide))
                        yield pa.record_batch(
                            [
                                rows.column(0).take(index),
                                pa.array(names.ravel()),
                                pa.array(np.tile(np.arange(wide) > 0, len(at))),
                                rows.column(1).take(index),
                                rows.column(2).take(index),
                            ],
                            names=["vec", "cell", "looked", "label", "dims"],
                        )

    return classes.select("vec", "label", "dims", "vector").mapInArrow(run, CELLS)


def close_pairs(classes: DataFrame, least: float, lattice: Lattice) -> DataFrame:
    """(a, b, a_size, b_size): pairs of distinct vectors of one label and length with
    cosine at least ``least``."""
    entries = hashed(classes, lattice)
    key = F.xxhash64("cell", "label", "dims").alias("cell")
    stays = entries.where("not looked").select(key, F.col("vec").alias("b"), "label")
    looks = entries.where("looked").select(key, F.col("vec").alias("a"), "label")
    met = (
        looks.join(stays, ["cell", "label"])
        .where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    side = classes.select("vec", "dims", "vector", "size")
    both = met.join(
        side.select(*[F.col(c).alias(f"a_{c}") for c in side.columns]),
        F.col("a") == F.col("a_vec"),
    ).join(
        side.select(*[F.col(c).alias(f"b_{c}") for c in side.columns]),
        (F.col("b") == F.col("b_vec")) & (F.col("a_dims") == F.col("b_dims")),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                sizes = part.column("a_dims").to_numpy()
                for dims in np.unique(sizes).tolist():
                    rows = part.take(pa.array(np.flatnonzero(sizes == dims)))
                    x = unit_vectors(rows.column("a_vector"), dims)
                    y = unit_vectors(rows.column("b_vector"), dims)
                    near = np.einsum("ij,ij->i", x, y) >= least
                    yield rows.select(["a", "b", "a_size", "b_size"]).filter(pa.array(near))

    return both.select(
        "a", "b", "a_size", "b_size", "a_dims", "a_vector", "b_vector"
    ).mapInArrow(run, "a long, b long, a_size long, b_size long")


def embedding_dedup(
    rows: DataFrame,
    least: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    lattice: Lattice = Lattice(),  # noqa: B008
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Vectors of one label link when their cosine is at least ``least``; a vector with
    a null label, that is null or zero, or that holds a null or non-finite component
    links with nothing and is its own component.  Equal vectors of one label are one class and
    link with each other; pairs are searched between classes, and membership
    carries them to the rows.  ``n_links`` counts rows.  Vectors of different length
    never link.  Rows that repeat an id count as rows, a null id is no component's
    name unless all its ids are null; ``kept`` holds where the id is the component's.
    Other columns are not looked at.

    No pair below ``least`` is ever linked; the index may miss pairs at the very
    edge (the tests measure it).
    """
    vectors = stored(
        clean(rows, id_col, vector_col, label_col).withColumn(
            "class", F.sha2(F.concat(F.encode(F.concat("label", F.lit("\0")), "utf-8"), "vector"), 256)
        ),
        "vectors",
    )
    able = vectors.where("vector is not null")
    classes = able.groupBy("class", "label", "dims", "vector").agg(
        F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("size")
    )
    # a number of its own for each class: ids may repeat or be null
    classes = stored(
        classes.withColumn("vec", F.monotonically_increasing_id()), "vector-classes"
    )
    pairs = stored(close_pairs(classes, least, lattice), "close-pairs")
    ends = pairs.select(F.col("a").alias("vec"), F.col("b_size").alias("n")).unionByName(
        pairs.select(F.col("b").alias("vec"), F.col("a_size").alias("n"))
    )
    links = ends.groupBy("vec").agg(F.sum("n").alias("others"))
    roots = components(pairs, "a", "b").withColumnRenamed("node", "vec")
    named = (
        classes.select("vec", "class", "size", "least_id")
        .join(roots, "vec", "left")
        .join(links, "vec", "left")
        .withColumn("root", F.coalesce("root", "vec"))
    )
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    groups = stored(
        named.join(names, "root").select(
            "class",
            "size",
            "component_id",
            (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        ),
        "vector-components",
    )
    linked = join_groups(
        able.select("vec_id", "class"), groups, "class", "size", F.col("vec_id")
    ).select("vec_id", "n_links", "component_id")
    alone = vectors.where("vector is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
