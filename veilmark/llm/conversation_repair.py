"""Repair of conversations: the cheapest edits that give well-formed turns.

Method: survivor-coalescence Viterbi.  Reading turns in order, the cheapest way to each
role state is kept as a path in a tree of back pointers with reference counts.  As soon
as all surviving paths share an ancestor, the edits up to it are certain: they are emitted
and freed.  Ways of equal cost are ordered by their whole edit strings; only the part
below the common ancestor can differ, and jump pointers find the first difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
# fixed values: what the edits cost, and an undeleted truncated turn
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
# states: nothing yet, after a system turn, after a user's, after an assistant's
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
SPEAKER = {USER: "user", ASSISTANT: "assistant"}
ALTERNATION = {"su", "ua", "au"}

TURNS = "conv_id long, position long, edit string, turn long, role string, text string"
REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string"
)


class Node:
    """One edit of a path.  ``jump`` leads far up; its depth depends on ``depth`` alone."""

    __slots__ = ("parent", "kids", "heads", "depth", "jump", "jump_depth", "edit", "turn", "role")

    def __init__(self, parent: Node | None, edit: str, turn=None, role: str | None = None) -> None:
        self.parent, self.edit, self.turn, self.role = parent, edit, turn, role
        self.kids: list[Node] = []
        self.heads = 0
        if parent is None:
            self.depth = self.jump_depth = 0
            self.jump: Node = self
            return
        self.depth = parent.depth + 1
        far = parent.jump
        if parent.depth - far.depth == far.depth - far.jump_depth:
            self.jump, self.jump_depth = far.jump, far.jump_depth
        else:
            self.jump, self.jump_depth = parent, parent.depth


@dataclass
class Turn:
    """A turn of a conversation and what is wrong with it."""

    turn: int | None
    role: str
    text: bytes | None
    doomed: bool = False  # blank or duplicate: must be deleted
    truncated: bool = False


class Repairer:
    """Feed turns in order; gives out edits as soon as they are certain.

    ``held`` is the number of edits not yet certain.  Turns that every path deletes are
    not kept.
    """

    def __init__(self) -> None:
        self.root = Node(None, "")
        self.root.heads = 1
        self.best: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        best = dict(self.best)
        self._inserts(best)
        self._replace(best)
        self.cost = 0

    def _before(self, a: Node, b: Node) -> bool:
        """Whether path a's edit string is before path b's."""
        deep_a, deep_b = a.depth, b.depth
        a, b = self._lift(a, deep_b), self._lift(b, deep_a)
        if a is b:
            return deep_a < deep_b
        while a.parent is not b.parent:
            if a.jump is not b.jump:
                a, b = a.jump, b.jump
            else:
                a, b = a.parent, b.parent
        return a.edit < b.edit

    def _lift(self, node: Node, depth: int) -> Node:
        while node.depth > depth:
            node = node.jump if node.jump_depth >= depth else node.parent
        return node

    def _offer(self, best: dict, state: int, cost: int, node: Node) -> bool:
        held = best.get(state)
        if held is None or cost < held[0] or (cost == held[0] and self._before(node, held[1])):
            best[state] = (cost, node)
            return True
        return False

    def _inserts(self, best: dict) -> None:
        changed = True
        while changed:
            changed = False
            for state in (START, SYSTEM, USER, ASSISTANT):
                if state not in best:
                    continue
                cost, node = best[state]
                for after in NEXT[state].values():
                    if after in SPEAKER:
                        new = Node(node, INSERT, None, SPEAKER[after])
                        changed |= self._offer(best, after, cost + COSTS[INSERT], new)

    def _replace(self, best: dict) -> None:
        """Make ``best`` the survivors: hang their paths into the tree, free the others'."""
        best = dict(best)
        if ASSISTANT in best:
            cost = best[ASSISTANT][0]
            # whatever follows these states costs at most so much more after an assistant
            for state, more in ((START, COSTS[DELETE]), (SYSTEM, 0)):
                if state in best and best[state][0] > cost + more:
                    del best[state]
        for _, node in best.values():
            node.heads += 1
            while node.parent is not None and not any(k is node for k in node.parent.kids):
                node.parent.kids.append(node)
                node = node.parent
        for _, node in self.best.values():
            node.heads -= 1
        for _, node in self.best.values():
            while node is not self.root and not node.heads and not node.kids:
                above, node.parent = node.parent, None
                if above is None:
                    break
                above.kids = [k for k in above.kids if k is not node]
                node = above
        self.best = best

    def feed(self, turn: Turn) -> Iterator[Node]:
        best: dict[int, tuple[int, Node]] = {}
        more = TRUNCATED_COST if turn.truncated else 0
        for state, (cost, node) in self.best.items():
            self._offer(best, state, cost + COSTS[DELETE], Node(node, DELETE))
            if turn.doomed:
                continue
            after = NEXT[state].get(turn.role[:1])
            if after is not None:
                self._offer(best, after, cost + more, Node(node, KEEP, turn, turn.role))
            for after in NEXT[state].values():
                if after in SPEAKER:
                    new = Node(node, REROLE, turn, SPEAKER[after])
                    self._offer(best, after, cost + more + COSTS[REROLE], new)
        self._inserts(best)
        self._replace(best)
        yield from self._certain()

    def _certain(self) -> Iterator[Node]:
        while not self.root.heads and len(self.root.kids) == 1:
            done, self.root = self.root, self.root.kids[0]
            # jumps may still lead to it, but nothing it held stays
            done.kids, done.turn, self.root.parent = [], None, None
            yield self.root

    def finish(self) -> Iterator[Node]:
        """The rest of the edits; ``cost`` is then that of all."""
        final = {k: v for k, v in self.best.items() if k in (START, ASSISTANT)}
        least = min(cost for cost, _ in final.values())
        paths = [node for cost, node in final.values() if cost == least]
        chosen = paths[0]
        for node in paths[1:]:
            if self._before(node, chosen):
                chosen = node
        self.cost = least
        rest = []
        while chosen is not self.root:
            rest.append(chosen)
            chosen = chosen.parent
        yield from reversed(rest)

    def held(self) -> int:
        seen, todo = 0, list(self.root.kids)
        while todo:
            seen += 1
            todo += todo.pop().kids
        return seen


MARK, ROW, NAME = 0, 1, 2


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, kind, text): each conversation's turns together, in order.

    ``turns`` has conv_id, turn, role, text and ``here``, false for a row that only tells that
    its conversation exists.  By turn, nulls first, then role, then text.  In front of the
    turns of one role and number stand marks: the digests of the texts that occur there for
    the first time in the conversation.  They come from a grouping that is combined in
    each task first, so a text that a conversation repeats a billion times is one mark.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).cast("binary").alias("text"),
        "here",
    )
    digest = F.unhex(F.sha2("text", 256)).alias("text")
    place = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("place")
    marks = (
        rows.where("here")
        .select("conv_id", "turn", "role", digest)
        .groupBy("conv_id", "role", "text")
        .agg(place)
        .select("conv_id", "place.turn", "role", F.lit(MARK).alias("kind"), "text")
    )
    full = rows.where("here").select("conv_id", "turn", "role", F.lit(ROW).alias("kind"), "text")
    nothing = F.lit(None)
    names = rows.where("not here").select(
        "conv_id",
        nothing.cast("long").alias("turn"),
        nothing.cast("string").alias("role"),
        F.lit(NAME).alias("kind"),
        nothing.cast("binary").alias("text"),
    )
    every = full.unionByName(marks).unionByName(names.distinct())
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "kind", "text")


class Conversation:
    """Counts of one conversation and its repairer."""

    def __init__(self) -> None:
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None
        self.last: int | None = None
        self.block: tuple | None = None
        self.firsts: set[bytes] = set()
        self.repairer = Repairer()

    def mark(self, turn: int | None, role: str, digest: bytes) -> None:
        if self.block != (turn, role):
            self.block, self.firsts = (turn, role), set()
        self.firsts.add(digest)

    def add(self, turn: int | None, role: str, text: bytes) -> Iterator[Node]:
        if turn is not None and turn != self.last:
            if self.last is not None:
                self.gaps += turn - self.last - 1
            self.last = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ALTERNATION:
            self.illegal += 1
        self.before = initial
        digest = hashlib.sha256(text).digest()
        first = self.block == (turn, role) and digest in self.firsts
        if first:
            self.firsts.discard(digest)
        body = text.rstrip()  # of bytes: white space is \x20 and \x09-\x0D
        blank, cut = not body, body[-1:] not in (b".", b"!", b"?")
        if blank:
            self.blank += 1
        elif not first:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        found = Turn(turn, role, text, blank or not first, cut)
        return self.repairer.feed(found)


def _edits(node: Node) -> tuple:
    turn = node.turn
    if node.edit == DELETE:
        return node.edit, None, None, None
    text = b"" if turn is None else turn.text
    return node.edit, None if turn is None else turn.turn, node.role, text


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, conversation, its new edits, whether it ends here), in order."""
    now, key = None, None
    for batch in batches:
        for name, turn, role, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or name != key:
                if now is not None:
                    yield key, now, now.repairer.finish(), True
                now, key = Conversation(), name
            if kind == MARK:
                now.mark(turn, role, text)
            elif kind == ROW:
                yield key, now, now.add(turn, role, text), False
    if now is not None:
        yield key, now, now.repairer.finish(), True


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.record_batch(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _arrow(ddl: str) -> pa.Schema:
    types = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(c.split()[0], types[c.split()[1]]) for c in ddl.split(", ")])


def repair_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, position, edit, turn, role, text): every edit of every conversation.

    ``position`` counts a conversation's edits from 0.  Keep and Rerole have the turn's
    number and text, Insert an empty text and no number, Delete neither.  See ``repair_report``
    for the rules.  Memory is bounded by the edits that are not yet certain.
    """
    schema = _arrow(TURNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, position, size = [], 0, 0
        for name, _, nodes, ends in _runs(batches):
            for node in nodes:
                edit, turn, role, text = _edits(node)
                text = None if text is None else text.decode()
                size += len(text or "")
                rows.append((name, position, edit, turn, role, text))
                position += 1
            position = 0 if ends else position
            if len(rows) >= 4096 or size > 1 << 22:
                yield _batch(rows, schema)
                rows, size = [], 0
        yield _batch(rows, schema)

    return in_order(_all_here(turns)).mapInArrow(run, TURNS)


def _all_here(turns: DataFrame) -> DataFrame:
    if "here" in turns.columns:
        return turns
    return turns.select("conv_id", "turn", "role", "text", F.lit(True).alias("here"))


def repair_report(turns: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cheapest repair's cost, edits and result.

    A turn's first fault counts: blank (no character but ASCII white space), duplicate (an
    earlier turn of the conversation has the same role and text), truncated (its last such
    character is none of ``.!?``).  Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert
    of an empty user or assistant turn 5; a truncated turn that stays costs 5 more, blank and
    duplicate turns must go.  The repaired turns' role initials are nothing, or
    an s at most once in front and then ua repeated.  Of equal cost the least edit string wins.

    Turns are taken by number (nulls first), then role, then text.  A null role or text is one
    space, turns without conv_id are one conversation, rows may repeat.  With a column
    ``here``, rows where it is false only name their conversation.  No rows give no rows.
    One conversation is read by one task in order, whatever its length, because a digest of its
    text has an order; sorting spills, and memory holds only edits that are not yet
    certain, the edit string and the texts' digests of one number and role.
    """
    schema = _arrow(REPORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, audit, hashed, written = [], [], hashlib.sha256(), False
        for name, now, nodes, ends in _runs(batches):
            for node in nodes:
                audit.append(node.edit)
                if node.edit != DELETE:
                    text = b"" if node.turn is None else node.turn.text
                    if written:
                        hashed.update(b"\n")
                    hashed.update(f"{node.role}:".encode())
                    hashed.update(text)
                    written = True
            if ends:
                counts = (now.gaps, now.blank, now.duplicate, now.truncated, now.illegal)
                cost = now.repairer.cost
                rows.append((name, *counts, cost, "".join(audit), hashed.hexdigest()))
                audit, hashed, written = [], hashlib.sha256(), False
                if len(rows) >= 4096:
                    yield _batch(rows, schema)
                    rows = []
        yield _batch(rows, schema)

    return in_order(_all_here(turns)).mapInArrow(run, REPORT)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of ``conv_id:turn`` (a null is one space).

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it
    and 4 makes its role user.  A dropped row stays as one that is not ``here``.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
    )
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (fault != 0).alias("here"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")
