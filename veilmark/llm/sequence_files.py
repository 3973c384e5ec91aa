"""Token ids in Arrow files of equal-length sequences.

Method: Arrow stream-file format.  A shard is one Arrow IPC file whose record batches
hold fixed-size lists: ``ids`` (the narrowest unsigned type that holds the
vocabulary) and ``mask`` (bits, true where an id is real).  Every sequence of a shard
has the same length, so sequence k lies at a computed place and can be read, mapped
without a copy, alone.  An index table says where each document lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilmark.llm.bpe_chunks import encoder, text_blocks
from veilmark.llm.common import new_path

LENGTH = 2048
BATCH_ROWS = 256
INDEX = "doc_id long, shard long, file string, first long, n_tokens long"


def open_store(path: str):
    """(file system, path in it) of a URI or a plain path, by Arrow's file systems."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def file_schema(dtype: np.dtype, length: int) -> pa.Schema:
    ids = pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), False), length)
    mask = pa.list_(pa.field("item", pa.bool_(), False), length)
    return pa.schema([pa.field("ids", ids, False), pa.field("mask", mask, False)])


class ShardWriter:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch_rows: int) -> None:
        self.schema = file_schema(dtype, length)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.dtype, self.length, self.full = dtype, length, length * batch_rows
        self.parts: list[np.ndarray] = []
        self.held = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.full:
            joined = np.concatenate(self.parts)
            stop = len(joined) - len(joined) % self.full
            for start in range(0, stop, self.full):
                self._batch(joined[start : start + self.full])
            self.parts, self.held = [joined[stop:]], len(joined) - stop

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        padded = np.zeros(rows * self.length, self.dtype)
        padded[: len(ids)] = ids
        mask = np.arange(rows * self.length) < len(ids)
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(values), type=field.type)
            for values, field in zip((padded, mask), self.schema, strict=True)
        ]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))
        self.written += len(ids)

    def close(self) -> None:
        if self.held:
            self._batch(np.concatenate(self.parts))
        self.out.close()


class ShardReader:
    """Random access to a shard's sequences; local files are memory mapped."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        store, inner = open_store(path)
        local = isinstance(store, fs.LocalFileSystem)
        source = pa.memory_map(inner) if local else store.open_input_file(inner)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        first = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.batch_ids = first * self.length

    def _values(self, batch: int, column: str) -> pa.Array:
        return self.file.get_batch(batch).column(column).values

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence k; the ids are a view of the file."""
        batch, start = divmod(k * self.length, self.batch_ids)
        ids = self._values(batch, "ids").slice(start, self.length)
        mask = self._values(batch, "mask").slice(start, self.length)
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, first: int, count: int) -> np.ndarray:
        """Ids ``first`` to ``first + count`` of the shard."""
        parts = []
        while count > 0:
            batch, start = divmod(first, self.batch_ids)
            take = min(count, self.batch_ids - start)
            parts.append(self._values(batch, "ids").slice(start, take).to_numpy())
            first, count = first + take, count - take
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_sequences(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Write every text's ids and ``end_id`` to shards under ``folder``; its index.

    Rows are dealt by ranges of the id and sorted, so shards in order hold the
    documents in order.  Null ids come first; rows with equal ids are ordered by
    text.  A null text counts as empty and is its end id.  A task writes its shard
    under a name of its own attempt, and the index, written by Spark, names
    only the files of the attempts that counted: a task may run again at any time.
    No rows give an empty index.  The index has
    (doc_id, shard, file, first, n_tokens), ``first`` counting within the shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        path = f"{folder}/shard-{shard:06d}-{task.taskAttemptId()}.arrow"
        store, inner = open_store(path)
        work = encoder(tokenizer)
        dtype = work.dtype if end_id < 1 << 8 * work.dtype.itemsize else np.dtype("<u4")
        end = np.array([end_id], dtype)
        writer, sink, first = None, None, 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = []
            for start, stop in text_blocks(texts):
                for ids in work.encode(texts[start:stop]):
                    if writer is None:
                        store.create_dir(inner.rpartition("/")[0], recursive=True)
                        sink = store.open_output_stream(inner)
                        writer = ShardWriter(sink, dtype, length, batch_rows)
                    writer.add(ids.astype(dtype, copy=False))
                    writer.add(end)
                    counts.append(len(ids) + 1)
            n = np.array(counts, np.int64)
            firsts = first + np.cumsum(n) - n
            first += int(n.sum())
            size = len(counts)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(np.full(size, shard, np.int64)),
                    pa.array([path] * size, pa.string()),
                    pa.array(firsts),
                    pa.array(n),
                ],
                names=["doc_id", "shard", "file", "first", "n_tokens"],
            )
        if writer is not None:
            writer.close()
            sink.close()

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    )
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = f"{folder}/index"
    dealt.mapInArrow(run, INDEX).write.parquet(index)
    return docs.sparkSession.read.schema(INDEX).parquet(index)


def document_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: the ids of all documents before each one.

    The running sum goes over one row per shard, as many as the write had tasks.
    """
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    return index.join(F.broadcast(bases), "shard").withColumn(
        "start", F.col("base") + F.col("first")
    )


def read_documents(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document's ids, read back from its file.

    ``ids`` are little-endian unsigned 32-bit numbers, as bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, ShardReader] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = zip(*(part.column(c).to_pylist() for c in ("file", "first", "n_tokens")), strict=True)
                found = []
                for file, first, count in rows:
                    if file not in readers:
                        if len(readers) > 64:
                            readers.clear()
                        readers[file] = ShardReader(file)
                    found.append(readers[file].ids(first, count).astype("<u4").tobytes())
                yield pa.record_batch(
                    [part.column(c) for c in ("doc_id", "start", "n_tokens")]
                    + [pa.array(found, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return document_starts(index).select(
        "doc_id", "start", "n_tokens", "file", "first"
    ).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def sequence_files(
    spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2
) -> DataFrame:
    """Write all documents to a new folder of shards and read every one back."""
    folder = new_path(spark, "sequences")
    return read_documents(write_sequences(docs, tokenizer, folder, end_id))


