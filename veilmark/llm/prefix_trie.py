"""A trie of conversation prefixes and its counts.

Method: minimal-perfect-hash node table.  Every prefix has a digest; the distinct ones are
the nodes.  Nodes are dealt to shards that hold whole subtrees.  A shard gives each of its
digests a slot by a minimal perfect hash and checks the digest kept there, scatters the
counts into flat numpy arrays, and adds them up through an array of parent slots, deepest
nodes first.  Nodes that only one conversation has need no sums and no shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilmark.llm.common import join_groups, stored

ROOT = bytes(16)
PATHS = (
    "node binary, parent binary, depth long, conv_id long, words long, remaining long"
)
SUMS = "node binary, parent binary, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"
LEAST_SHARD, LARGEST_SHARD, SHARDS = 1 << 12, 1 << 18, 1024
BROADCAST_ROWS = 1 << 17
BLOB = 1 << 18
GROUP = 20


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 128-bit keys.

    Keys that alone hit a cell of a level's table have that cell, numbered by its rank;
    the others go on to the next level.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        base, left = 0, keys
        while len(left):
            if len(self.levels) > 100:
                raise ValueError("a node stands twice in a shard")
            size = max(8, 2 * len(left))
            place = self._place(left, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            left = left[~alone[place]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = keys[:, 0] + keys[:, 1] * np.uint64(2 * level + 1)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A key's slot; for a key that is not in the set any slot or -1."""
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            place = self._place(keys[open_], level, len(alone))
            hit = alone[place]
            found[open_[hit]] = rank[place[hit]]
            open_ = open_[~hit]
        return found


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


class NodeTable:
    """The nodes of one shard in flat arrays, one place a slot."""

    def __init__(self, node: list[bytes], parent: list[bytes], depth, conv, n_convs, words, private) -> None:
        keys = _keys(node)
        self.hash = PerfectHash(keys)
        slot = self.hash.slots(keys)
        n = len(node)
        self.keys = np.zeros((n, 2), np.uint64)
        self.keys[slot] = keys

        def scattered(values) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[slot] = np.asarray(values, np.int64)
            return out

        self.slot = slot
        self.depth, self.conv = scattered(depth), scattered(conv)
        self.children = scattered(private)
        self.leaves = self.children.copy()
        self.saved = (scattered(n_convs) - 1) * scattered(words)
        self.up = np.zeros(n, np.int64)
        self.up[slot] = self.find(_keys(parent))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots, -1 where the digest kept at the slot is another one."""
        slot = self.hash.slots(keys)
        same = (slot >= 0) & (self.keys[np.maximum(slot, 0)] == keys).all(1)
        return np.where(same, slot, -1)

    def add(self, node: list[bytes], children, leaves, saved) -> None:
        """Sums that come from subtrees in other shards."""
        slot = self.find(_keys(node))
        np.add.at(self.children, slot, np.asarray(children, np.int64))
        np.add.at(self.leaves, slot, np.asarray(leaves, np.int64))
        np.add.at(self.saved, slot, np.asarray(saved, np.int64))

    def accumulate(self) -> None:
        order = np.argsort(-self.depth, kind="stable")
        starts = np.flatnonzero(np.diff(self.depth[order], prepend=-1))
        for level in np.split(order, starts[1:]):
            self.leaves[level] = np.where(self.children[level] == 0, 1, self.leaves[level])
            level = level[self.up[level] >= 0]
            up = self.up[level]
            np.add.at(self.children, up, 1)
            np.add.at(self.leaves, up, self.leaves[level])
            np.add.at(self.saved, up, self.saved[level])

    def sums(self, node: list[bytes], parent: list[bytes]) -> pa.RecordBatch:
        slot, up = self.slot, self.up[self.slot]
        columns = [
            pa.array(node, pa.binary()),
            pa.array(parent, pa.binary()),
            pa.array(self.conv[up], pa.int64(), mask=up < 0),
            pa.array(self.children[slot]),
            pa.array(self.leaves[slot]),
            pa.array(self.saved[slot]),
        ]
        return pa.record_batch(columns, names=[c.split()[0] for c in SUMS.split(", ")])


def rebuilt_paths(turns: DataFrame, heads_of: int = GROUP) -> DataFrame:
    """(node, parent, depth, conv_id, words, remaining): each conversation's prefixes.

    Conversation c begins with the first h turns of the first conversation of its group
    of ``heads_of`` ids (h is its id's crc32 modulo 4) and goes on with its own turns after
    its first h.  Turns are taken by number, nulls first, and of equal numbers by a digest
    of role and text.  A null role or text is empty; rows without conv_id belong to no
    conversation.  Only digests are shuffled.  One conversation is read in order by one task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    own = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.unhex(F.substring(F.sha2(framed, 256), 1, 32)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    size = F.lit(heads_of)
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    name = F.col("conv_id").cast("string").cast("binary")
    convs = convs.withColumns({"first": F.col("conv_id") - F.col("conv_id") % size, "h": F.crc32(name) % 4})
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    heads = (
        own.where(F.col("conv_id") % size == 0)
        .withColumn("place", F.row_number().over(order))
        .where("place <= 3")
        .select(F.col("conv_id").alias("first"), F.col("place").cast("long"), "digest", "words")
    )
    lent = convs.join(heads, "first").where("place <= h")
    nothing = F.lit(None)
    rows = (
        convs.select("conv_id", F.lit(0).alias("kind"), "h", "n", nothing.cast("binary").alias("digest"))
        .unionByName(
            lent.select("conv_id", F.lit(1).alias("kind"), F.col("place").alias("h"), F.col("words").alias("n"), "digest")
        )
        .unionByName(
            own.select("conv_id", F.lit(2).alias("kind"), F.col("turn").alias("h"), F.col("words").alias("n"), "digest")
        )
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "h", "digest")
    names = [c.split()[0] for c in PATHS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, skip, own_turns, parent, depth, total = None, 0, 0, ROOT, 0, 0
        waiting: list[tuple] = []

        def begin() -> None:
            """The conversation's length is known: its root and lent turns go out."""
            nonlocal total, depth, parent, skip
            total = len(waiting) + max(own_turns - skip, 0)
            parent, depth = ROOT, 0
            out.append((ROOT, None, 0, conv, 0, total))
            for digest, words in waiting:
                go(digest, words)
            waiting.clear()

        def go(digest: bytes, words: int) -> None:
            nonlocal parent, depth
            node = hashlib.sha256(parent + digest).digest()[:16]
            depth += 1
            out.append((node, parent, depth, conv, words, total - depth))
            parent = node

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.binary(), pa.binary()] + [pa.int64()] * 4
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        begun = True
        for batch in batches:
            for conv_id, kind, h, n, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if not begun:
                        begin()
                    conv, skip, own_turns, begun = conv_id, h, n, False
                elif kind == 1:
                    waiting.append((digest, n))
                else:
                    if not begun:
                        begin()
                        begun = True
                    if skip > 0:
                        skip -= 1
                    else:
                        go(digest, n)
            if len(out) > 1 << 14:
                yield batch_of()
        if not begun:
            begin()
        yield batch_of()

    return dealt.mapInArrow(run, PATHS)


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): a digest of the ids (node, conv_id) of each node, ascending.

    Ranges of (node, id) are sorted and written out in as many tasks as it takes; only the
    finished text of a node goes through one digest, piece by piece.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        ids: list[str] = []
        node, first, size = None, None, 0
        for batch in batches:
            for name, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (name != node or size > BLOB):
                    out.append((node, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    node, first = name, conv
                ids.append(str(conv))
                size += len(ids[-1])
            if len(out) > 1 << 12:
                yield table_of(out)
                out = []
        if ids:
            out.append((node, first, ",".join(ids)))
        yield table_of(out)

    def table_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        types = [pa.binary(), pa.int64(), pa.string()]
        return pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["node", "first", "ids"]
        )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashed, out = None, None, []
        for batch in batches:
            for name, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != node:
                    if node is not None:
                        out.append((node, hashed.hexdigest()))
                    node, hashed = name, hashlib.sha256()
                else:
                    hashed.update(b",")
                hashed.update(ids.encode())
        if node is not None:
            out.append((node, hashed.hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 2
        yield pa.record_batch(
            [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())],
            names=["node", "ends_sha256"],
        )

    ranged = ends.select("node", "conv_id").repartitionByRange("node", "conv_id")
    parts = ranged.sortWithinPartitions("node", "conv_id").mapInArrow(
        pieces, "node binary, first long, ids string"
    )
    return (
        parts.repartition("node")
        .sortWithinPartitions("node", "first")
        .mapInArrow(digest, "node binary, ends_sha256 string")
    )


def _shard_sums(core: DataFrame, limit: int) -> DataFrame:
    """Sums of each node over its shard; ``core`` has the shard's name in ``anchor``."""
    names = ["node", "parent", "depth", "conv_id", "n_convs", "words", "private"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]
        anchor = None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            start = 0
            for k, name in enumerate(columns[-1]):
                if name != anchor:
                    # a shard ends where the next begins; small ones share a table
                    if len(held[0]) + k - start >= limit:
                        for into, column in zip(held, columns):
                            into += column[start:k]
                        yield sums(held)
                        held, start = [[] for _ in names], k
                    anchor = name
            for into, column in zip(held, columns):
                into += column[start:]
        if held[0]:
            yield sums(held)

    def sums(held: list[list]) -> pa.RecordBatch:
        table = NodeTable(*held)
        table.accumulate()
        return table.sums(held[0], held[1])

    dealt = core.select(*names, "anchor").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, SUMS)


def _crown_sums(crown: DataFrame, below: DataFrame) -> DataFrame:
    """Sums of the nodes above all shards, ``below`` being what shards hand up."""
    names = ["node", "parent", "depth", "conv_id", "n_convs", "words", "private"]
    handed = ["children", "leaves", "saved"]
    rows = crown.join(below, "node", "left").select(
        *names, *(F.coalesce(c, F.lit(0)).alias(c) for c in handed)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names + handed]
        for batch in batches:
            for into, column in zip(held, batch.columns):
                into += column.to_pylist()
        if held[0]:
            # the root's parent is a digest that no node has
            parents = [p if p is not None else b"\xff" * 16 for p in held[1]]
            table = NodeTable(held[0], parents, *held[2:7])
            table.add(held[0], *held[7:])
            table.accumulate()
            yield table.sums(held[0], held[1])

    return rows.coalesce(1).mapInArrow(run, SUMS)


def trie(paths: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """One row per distinct prefix; ``paths`` as ``rebuilt_paths`` gives them.

    Columns: node (its digest), conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its
    subtree, words of the last turn times members but one) and ends_sha256 (ids of the
    conversations that end there, ascending, joined by commas).  No paths give no rows.

    A subtree is a shard when at most ``shard_rows`` prefixes of conversations run through
    it (by default a 1024th of all, between 4,096 and 262,144).  The nodes above the shards
    are few, at most prefixes / ``shard_rows`` at each depth, and summed in one table; a
    turn that a third of all conversations begin with is one of them, its subtrees spread.
    """
    paths = stored(paths, "prefixes")
    ended = F.col("remaining") == 0
    nodes = stored(
        paths.groupBy("node").agg(
            F.max("parent").alias("parent"),
            F.max("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.max("words").alias("words"),
            F.sum(F.col("remaining") + 1).alias("below"),
            F.count(F.when(ended, 1)).alias("n_ends"),
            F.min(F.when(ended, F.col("conv_id"))).alias("end"),
        ),
        "prefix-nodes",
    )
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    limit = shard_rows or min(max(total // SHARDS, LEAST_SHARD), LARGEST_SHARD)

    # nodes of one conversation: sums are plain, and the topmost is a child of a shared node
    # (or of nothing, when there is but one conversation)
    private = nodes.where("n_convs = 1")
    tops = private.groupBy("conv_id").agg(F.min(F.struct("depth", "node", "parent")).alias("top"))
    tops = stored(tops.select("top.node", "top.parent"), "prefix-tops")
    lent = tops.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("private"))
    core = nodes.where("n_convs > 1").join(lent.withColumnRenamed("parent", "node"), "node", "left")
    core = stored(core.withColumn("private", F.coalesce("private", F.lit(0))), "prefix-core")
    groups = core.where("private > 0").select(
        F.col("node").alias("parent"), "private", F.col("conv_id").alias("parent_conv_id")
    )
    named = join_groups(tops.where("parent is not null"), groups, "parent", "private", F.col("node"))
    plain = private.join(named.select("node", "parent_conv_id"), "node", "left").select(
        "node",
        F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        F.when(F.col("n_ends") > 0, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
    )

    high = (F.col("below") > limit) | (F.col("depth") == 0)
    crown = core.where(high)
    small = crown.count() <= BROADCAST_ROWS

    def few(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if small else frame

    # how far down each conversation's path lies above the shards, and its shard there
    above = paths.join(few(crown.where("depth > 0").select("node")), "node", "left_semi")
    above = above.groupBy("conv_id").agg(F.max("depth").alias("high"))
    rest = core.where(~high)
    owners = rest.select("conv_id").distinct()
    cut = owners.join(above, "conv_id", "left").select(
        "conv_id", (F.coalesce("high", F.lit(0)) + 1).alias("depth")
    )
    anchors = paths.join(cut, ["conv_id", "depth"]).select("conv_id", F.col("node").alias("anchor"))
    shards = stored(_shard_sums(rest.join(anchors, "conv_id"), limit), "prefix-sums")
    below = (
        shards.where("parent_conv_id is null")
        .groupBy(F.col("parent").alias("node"))
        .agg(
            F.count(F.lit(1)).alias("children"),
            F.sum("n_leaves").alias("leaves"),
            F.sum("saved_tokens").alias("saved"),
        )
    )
    # a shard's top has its parent in the crown
    over = few(crown.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")))
    shards = shards.join(over, "parent", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above")
    )
    sums = plain
    for found in (shards, _crown_sums(crown, below)):
        sums = sums.unionByName(found.select(plain.columns))

    several = paths.where(ended).select("node", "conv_id")
    digests = end_digests(several)
    lone = F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")).cast("binary"), 256)
    return (
        nodes.join(sums, "node")
        .join(digests, "node", "left")
        .select(
            "node",
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.when(F.col("n_ends") > 1, F.col("ends_sha256")).otherwise(lone).alias("ends_sha256"),
        )
    )
