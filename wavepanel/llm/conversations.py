"""Conversation structure repair by prefix-doubling path ranking.

A conversation is to have the role initials ``(s?(ua)+)?``. Its rows are kept,
given another role, deleted, and empty rows inserted, at the least cost; of the
cheapest ways, the one whose edits' initials (the audit: D, I, K, R) come first
in ASCII order is taken.

Nodes are (rows done, state of the pattern): 0 nothing yet, 1 after s, 2 after u,
3 after a. Costs to the end come from a DP over the rows. An arc is optimal if
its cost and that of its target are the node's. Nodes are ranked by the least
audit of 1, 2, 4, ... edits that starts there: two ranks, the node's and that of
the node as many edits on, give the rank by twice as many, and two pointers the
pointer twice as far. A node takes the optimal arc of the least edit and then of
the target of least rank; the least path is read off through the doubled
pointers. Two arcs of a node never share an edit's initial, so paths that agree
in all edits are the same path, and one pointer a node is enough.

At scale: rows are dealt by ranges of (conversation, turn, ...), so one
conversation may spread over many tasks. A task packs its rows into segments,
each of one conversation, bounded in rows and bytes. Most conversations are one
segment. Those of several go through three steps more: texts that an earlier
task has seen; the cost of each segment from each state to each other, with the
order of the audits; and these small tables joined up in order (one row for
thousands of rows), which gives every segment the states that it leads between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from wavepanel.llm.common import free_name, write_shared

#: Most rows and characters of a segment (one row at least), and rows that are worked on at once.
SEGMENT_ROWS, SEGMENT_CHARS, WORK_ROWS = 4096, 1 << 22, 1 << 16
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
RETAG, DELETE, INSERT, BROKEN = 1, 2, 5, 5
EDITS = "DIKR"
STATES = 4
INITIALS = {"s": 1, "u": 2, "a": 3}
LEGAL = {(1, 2), (2, 3), (3, 2)}
#: State after a row of the wanted role (what Insert and Rerole give), and after keeping a row by its initial; -1: not allowed.
WANTED = np.array([2, 2, 3, 2])
KEPT = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
ROLE_OF = {2: "user", 3: "assistant"}
#: Inserts that complete the pattern from each state.
TO_END = np.array([0, 2, 1, 0])
FAR = np.int64(1) << 60


def damage(df: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with a column more, how often each occurs (0: dropped), damaged by
    crc32 of ``id:turn`` modulo 20: 0 drops, 1 empties the text, 2 removes its
    sentence ends, 3 repeats the row, 4 makes it a user's. Nulls of the key, of
    roles and of texts are one space."""
    space = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn))) % 20
    return df.select(
        df[id_col].alias(id_col), df[turn].alias(turn),
        F.when(fault == 4, F.lit("user")).otherwise(space(role)).alias(role),
        F.when(fault <= 1, F.lit("")).when(fault == 2, F.translate(space(text), ".!?", "")).otherwise(space(text)).alias(text),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"))


# ---- packing ---------------------------------------------------------------

def _segment_type(id_type: T.DataType) -> T.StructType:
    whole, numbers = T.LongType(), T.ArrayType(T.LongType())
    return T.StructType([
        T.StructField("id", id_type), T.StructField("part", whole), T.StructField("place", whole),
        T.StructField("edge", T.BooleanType()), T.StructField("turns", numbers),
        T.StructField("classes", T.BinaryType()), T.StructField("initials", T.BinaryType()),
        T.StructField("fresh", T.ArrayType(T.BinaryType())), T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("texts", T.ArrayType(T.StringType()))])


class _Packer:
    """Gathers sorted rows into segments. ``edge`` marks segments whose conversation
    may have others: cut ones, and those at the ends of the task's range."""

    def __init__(self, part: int, most_rows: int):
        self.most_rows = most_rows
        self.part, self.place, self.id, self.first, self.cut = part, 0, None, True, False
        self.started, self.seen = False, set()
        self._clear()

    def _clear(self) -> None:
        self.n = self.chars = self.distinct = 0
        self.low = self.high = None
        self.classes, self.initials, self.fresh, self.roles, self.texts = bytearray(), bytearray(), [], [], []

    def segment(self, edge: bool) -> tuple:
        edge = edge or self.first or self.cut
        out = (self.id, self.part, self.place, edge, [self.low, self.high, self.distinct], bytes(self.classes),
               bytes(self.initials), self.fresh if edge else None, self.roles, self.texts)
        self.place += 1
        self._clear()
        return out

    def add(self, row_id, turn, role: str, text: str, times: int) -> Iterator[tuple]:
        if not self.started or row_id != self.id:
            if self.started:
                yield self.segment(False)
                self.first = False
            self.started, self.id, self.cut, self.seen = True, row_id, False, set()
        for _ in range(times):
            if self.n and (self.n >= self.most_rows or self.chars + len(text) > SEGMENT_CHARS):
                self.cut = True
                yield self.segment(True)
            tail = text.rstrip(WHITE)
            kind = BLANK
            if tail:
                key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if key in self.seen:
                    kind = DUPLICATE
                else:
                    self.seen.add(key)
                    self.fresh.append(key)
                    kind = OK if tail[-1] in ".!?" else TRUNCATED
            self.classes.append(kind)
            self.initials.append(INITIALS.get(role[:1], 0))
            self.roles.append(role)
            self.texts.append(text if kind in (OK, TRUNCATED) else "")
            self.n += 1
            self.chars += len(text)
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.distinct += turn != self.high
                self.high = turn


def pack(rows: DataFrame, id_col: str, turn: str, role: str, text: str, times: str,
         most_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Segments of each conversation's rows by turn (null turns first); rows of one
    turn by role, the first 64 characters of the text and its hash."""
    sorted_by = ["id", "turn", "role", "start", "hash", "salt"]
    slim = rows.select(rows[id_col].alias("id"), rows[turn].cast("long").alias("turn"),
                       F.coalesce(rows[role].cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(rows[text].cast("string"), F.lit(" ")).alias("text"), F.col(times).cast("int").alias("times"))
    keyed = slim.select("*", F.substring("text", 1, 64).alias("start"), F.xxhash64("text").alias("hash"),
                        F.monotonically_increasing_id().alias("salt"))      # equal rows may be dealt apart
    schema = _segment_type(slim.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, done, chars = _Packer(TaskContext.get().partitionId(), most_rows), [], 0
        arrow = None
        for batch in batches:
            arrow = arrow or pa.schema([pa.field("id", batch.schema.field(0).type), *ARROW_REST])
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for segment in packer.add(*row):
                    done.append(segment)
                    chars += sum(map(len, segment[-1]))
                if len(done) >= 2000 or chars > 4 * SEGMENT_CHARS:
                    yield _batch(done, arrow)
                    done, chars = [], 0
        if packer.started:
            done.append(packer.segment(True))
            yield _batch(done, arrow)

    ranged = keyed.repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by)
    return ranged.select("id", "turn", "role", "text", "times").mapInArrow(run, schema)


ARROW_REST = [pa.field("part", pa.int64()), pa.field("place", pa.int64()), pa.field("edge", pa.bool_()),
              pa.field("turns", pa.list_(pa.int64())), pa.field("classes", pa.binary()), pa.field("initials", pa.binary()),
              pa.field("fresh", pa.list_(pa.binary())), pa.field("roles", pa.list_(pa.string())),
              pa.field("texts", pa.list_(pa.string()))]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# ---- cost DP and path ranking ------------------------------------------------

class Paths:
    """Costs and least audits of segments, all at once. ``goals`` holds the cost
    that is left from each state after a segment's rows (FAR: not allowed);
    ``last`` segments may insert rows after their own."""

    def __init__(self, classes: list[bytes], initials: list[bytes], goals: np.ndarray, last: np.ndarray):
        self.sizes = np.array([len(c) for c in classes])
        self.base = np.append(0, np.cumsum(self.sizes + 1))[:-1]            # level of each segment's first node
        levels = int((self.sizes + 1).sum())
        self.kind, self.initial = np.zeros(levels, np.int64), np.zeros(levels, np.int64)
        at_row = np.ones(levels, bool)
        at_row[self.base + self.sizes] = False
        self.kind[at_row] = np.frombuffer(b"".join(classes), np.uint8)
        self.initial[at_row] = np.frombuffer(b"".join(initials), np.uint8)
        self._costs(goals, last, at_row)
        self._rank()

    def _costs(self, goals: np.ndarray, last: np.ndarray, at_row: np.ndarray) -> None:
        levels = len(self.kind)
        state = np.arange(STATES)
        stays = self.kind[:, None] % 3 == 0                                  # neither blank nor duplicate
        broken = np.where(self.kind == TRUNCATED, BROKEN, 0)[:, None]
        to_kept = KEPT[state[None, :], self.initial[:, None]]
        open_end = np.zeros(levels, bool)
        open_end[(self.base + self.sizes)[last]] = True
        node = np.arange(levels)[:, None] * STATES
        one = np.full((levels, STATES), -1, np.int64)
        # targets and costs of D, I, K, R, in ASCII order
        self.to = np.stack([np.where(at_row[:, None], node + STATES + state, one),
                            np.where((at_row | open_end)[:, None], node + WANTED, one),
                            np.where(at_row[:, None] & stays & (to_kept >= 0), node + STATES + to_kept, one),
                            np.where(at_row[:, None] & stays, node + STATES + WANTED, one)], axis=2).reshape(-1, 4)
        price = np.stack([np.full((levels, STATES), DELETE), np.full((levels, STATES), INSERT),
                          np.broadcast_to(broken, (levels, STATES)), np.broadcast_to(RETAG + broken, (levels, STATES))],
                         axis=2).reshape(-1, 4)
        price = np.where(self.to >= 0, price, FAR)
        cost = np.full(levels * STATES, FAR, np.int64)
        ends = ((self.base + self.sizes)[:, None] * STATES + state).ravel()
        cost[ends] = goals.ravel()
        by_size = np.argsort(-self.sizes, kind="stable")
        ahead = -self.sizes[by_size]
        for back in range(1, int(self.sizes.max(initial=0)) + 1):            # rows from the end, all segments together
            active = by_size[:np.searchsorted(ahead, -back, "right")]
            nodes = ((self.base + self.sizes - back)[active][:, None] * STATES + state)
            arcs = [0, 2, 3]
            best = np.minimum(cost[self.to[nodes][:, :, arcs]] + price[nodes][:, :, arcs], FAR).min(axis=2)
            for _ in range(STATES - 1):
                best = np.minimum(best, best[:, WANTED] + INSERT)
            cost[nodes] = best
        self.cost = cost
        ahead_cost = np.where(self.to >= 0, cost[self.to], FAR) + price
        self.tight = (self.to >= 0) & (ahead_cost == cost[:, None]) & (cost[:, None] < FAR)

    def _rank(self) -> None:
        """Doubled pointers of the least audits; ``edit`` is each node's first edit (4: none)."""
        nodes = len(self.cost)
        rank = np.where(self.tight.any(axis=1), 1 + self.tight.argmax(axis=1), 0)
        self.edit, self.jumps = None, []
        while True:
            wide = int(rank.max(initial=0)) + 1
            # least edit first, then the target whose audit of the length ranked so far is least
            key = np.where(self.tight, np.arange(4) * wide + rank[self.to], 4 * wide)
            chosen = np.where(self.tight.any(axis=1), key.argmin(axis=1), 4)
            depth = len(self.jumps)
            if self.edit is None or (chosen != self.edit).any():
                self.edit = chosen
                step = np.where(chosen < 4, np.take_along_axis(self.to, np.minimum(chosen, 3)[:, None], 1)[:, 0], np.arange(nodes))
                self.jumps = [step]
                while len(self.jumps) <= depth:
                    self.jumps.append(self.jumps[-1][self.jumps[-1]])
            else:
                self.jumps.append(self.jumps[-1][self.jumps[-1]])
            far = self.jumps[-1]
            if (self.edit[far] == 4).all():                                  # every audit has ended
                return
            rank = np.unique(rank * wide + rank[far], return_inverse=True)[1]

    def follow(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which start, node) of every edit of the paths from the given nodes, in order."""
        owner, step, node = np.arange(len(starts)), np.zeros(len(starts), np.int64), starts
        for k in range(len(self.jumps) - 1, -1, -1):
            on = self.edit[node] < 4
            owner, step, node = (np.concatenate((a[on], b)) for a, b in
                                 ((owner, owner[on]), (step, step[on] + (1 << k)), (node, self.jumps[k][node[on]])))
        on = self.edit[node] < 4
        owner, step, node = owner[on], step[on], node[on]
        order = np.lexsort((step, owner))
        return owner[order], node[order]

    def starts(self, states: np.ndarray) -> np.ndarray:
        return self.base * STATES + states

    def audits(self, states: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """(audit, nodes) of each segment from the given state."""
        owner, node = self.follow(self.starts(states))
        letters = np.frombuffer(EDITS.encode(), np.uint8)[self.edit[node]].tobytes().decode()
        cuts = np.searchsorted(owner, np.arange(len(states) + 1))
        return [(letters[a:b], node[a:b]) for a, b in zip(cuts, cuts[1:])]


def end_goal() -> np.ndarray:
    return TO_END * INSERT


def one_goal(state: int) -> np.ndarray:
    return np.where(np.arange(STATES) == state, 0, FAR)


def _counts(classes: bytes, initials: bytes) -> tuple[int, int, int, int]:
    illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
    return classes.count(BLANK), classes.count(DUPLICATE), classes.count(TRUNCATED), illegal


def _gaps(low, high, distinct) -> int:
    return 0 if low is None else high - low + 1 - distinct


def _transcript(paths: Paths, nodes: np.ndarray, base: int, roles: list[str], texts: list[str]) -> list[str]:
    out = []
    for node in nodes.tolist():
        edit = int(paths.edit[node])
        if edit:
            row, state = node // STATES - base, node % STATES
            role = roles[row] if edit == 2 else ROLE_OF[int(WANTED[state])]
            out.append(f"{role}:{texts[row] if edit > 1 else ''}")
    return out


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > WORK_ROWS:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(sizes):
        yield start, len(sizes)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _repair_whole(segments: DataFrame, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            turns, classes, initials, roles, texts = (batch.column(i).to_pylist() for i in range(1, 6))
            for a, b in _slices([len(c) for c in classes]):
                paths = Paths(classes[a:b], initials[a:b], np.tile(end_goal(), (b - a, 1)), np.ones(b - a, bool))
                found = paths.audits(np.zeros(b - a, np.int64))
                said = ["\n".join(_transcript(paths, nodes, int(paths.base[i]), roles[a + i], texts[a + i]))
                        for i, (_, nodes) in enumerate(found)]
                counts = [_counts(c, x) for c, x in zip(classes[a:b], initials[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([_gaps(*t) for t in turns[a:b]], pa.int64()),
                     *(pa.array([c[j] for c in counts], pa.int64()) for j in range(4)),
                     pa.array(paths.cost[paths.starts(np.zeros(b - a, np.int64))], pa.int64()),
                     pa.array([audit for audit, _ in found], pa.string()), pa.array(said, pa.string())],
                    names=["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "transcript"])

    return segments.select("id", "turns", "classes", "initials", "roles", "texts") \
        .mapInArrow(run, f"id {id_type}, {REPORT}, audit string, transcript string")


# ---- conversations of several segments ---------------------------------------

def _known_earlier(split: DataFrame) -> DataFrame:
    """(id, part, place, stale): of each segment's first texts, those that an earlier task has."""
    each = split.select("id", "part", "place", F.explode("fresh").alias("key"))
    first = F.min("part").over(W.partitionBy("id", "key"))                  # at most one row a task
    return each.withColumn("first", first).filter("part > first").groupBy("id", "part", "place") \
        .agg(F.collect_set("key").alias("stale"))


def _settle(split: DataFrame, id_type: str) -> DataFrame:
    """The split segments with their final classes."""
    stale = _known_earlier(split).select(F.col("id").alias("i"), F.col("part").alias("p"), F.col("place").alias("q"), "stale")
    joined = split.join(stale, F.col("id").eqNullSafe(F.col("i")) & (F.col("part") == F.col("p"))
                        & (F.col("place") == F.col("q")), "left")

    @F.arrow_udf("binary")
    def final(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for classes, fresh, stale in batches:
            out = []
            for own, keys, known in zip(classes.to_pylist(), fresh.to_pylist(), stale.to_pylist()):
                if known:
                    known, own = set(known), bytearray(own)
                    firsts = (i for i, c in enumerate(bytes(own)) if c in (OK, TRUNCATED))
                    for i, key in zip(firsts, keys):
                        if key in known:
                            own[i] = DUPLICATE
                out.append(bytes(own))
            yield pa.array(out, pa.binary())

    return joined.select("id", "part", "place", "turns", final("classes", "fresh", "stale").alias("classes"), "initials",
                         "roles", "texts")


def _tables(split: DataFrame, id_type: str) -> DataFrame:
    """(id, part, place, table, order, facts): costs from each state to each, which
    of the audits from a state comes first, and the segment's counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, classes, initials = (batch.column(i).to_pylist() for i in range(3, 6))
            tables, orders, facts = [], [], []
            for a, b in _slices([len(c) for c in classes]):
                n = b - a
                costs, audits = np.zeros((n, STATES, STATES), np.int64), []
                for goal in range(STATES):
                    paths = Paths(classes[a:b], initials[a:b], np.tile(one_goal(goal), (n, 1)), np.zeros(n, bool))
                    for state in range(STATES):
                        states = np.full(n, state)
                        costs[:, state, goal] = paths.cost[paths.starts(states)]
                        audits.append([x for x, _ in paths.audits(states)])
                for i in range(n):
                    by_state = [sorted(range(STATES), key=lambda g, s=s: audits[g * STATES + s][i]) for s in range(STATES)]
                    orders.append([by_state[s].index(g) for s in range(STATES) for g in range(STATES)])
                    tables.append(costs[i].ravel().tolist())
                    c, x = classes[a + i], initials[a + i]
                    facts.append([*_counts(c, x), *turns[a + i], x[0] if x else None, x[-1] if x else None])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(tables, longs),
                                              pa.array(orders, longs), pa.array(facts, longs)],
                                             names=["id", "part", "place", "table", "order", "facts"])

    return split.select("id", "part", "place", "turns", "classes", "initials") \
        .mapInArrow(run, f"id {id_type}, part long, place long, table array<long>, order array<long>, facts array<long>")


def join_up(tables: list[list[int]], orders: list[list[int]], facts: list[list]) -> tuple[list[int], list[int]]:
    """The state that each segment starts and ends in, and the conversation's
    report (gaps, blank, duplicate, truncated, illegal, cost)."""
    grids = [np.array(t).reshape(STATES, STATES) for t in tables]
    after = [end_goal()]
    for grid in reversed(grids):
        after.append(np.minimum((grid + after[-1][None, :]).min(axis=1), FAR))
    after.reverse()
    states = [0]
    for grid, order, left in zip(grids, orders, after[1:]):
        s = states[-1]
        states.append(min(range(STATES), key=lambda g: (min(int(grid[s, g] + left[g]), int(FAR)), order[s * STATES + g])))
    blank, duplicate, truncated, illegal = (sum(f[j] for f in facts) for j in range(4))
    low = high = before = None
    distinct = 0
    for f in facts:
        if f[4] is not None:
            low = f[4] if low is None else low
            distinct += f[6] - (f[4] == high)
            high = f[5]
        if f[7] is not None:
            illegal += before is not None and (before, f[7]) not in LEGAL
            before = f[8]
    return states, [_gaps(low, high, distinct), blank, duplicate, truncated, illegal, int(after[0][0])]


def _ways(tables: DataFrame, id_type: str) -> DataFrame:
    """(id, part, place, piece, pieces, start, goal, report). A group has one small row for a whole segment."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("place", "ascending")])
        states, report = join_up(*(table[c].to_pylist() for c in ("table", "order", "facts")))
        n = table.num_rows
        return pa.table({"id": table["id"], "part": table["part"], "place": table["place"], "piece": pa.array(range(n), pa.int64()),
                         "pieces": pa.array([n] * n, pa.int64()), "start": pa.array(states[:-1], pa.int64()),
                         "goal": pa.array(states[1:], pa.int64()), "report": pa.array([report] * n, pa.list_(pa.int64()))})

    return tables.groupBy("id").applyInArrow(
        run, f"id {id_type}, part long, place long, piece long, pieces long, start long, goal long, report array<long>")


def _repair_pieces(split: DataFrame, ways: DataFrame, id_type: str) -> DataFrame:
    w = ways.select(F.col("id").alias("i"), F.col("part").alias("p"), F.col("place").alias("q"), "piece", "pieces", "start",
                    "goal", "report")
    joined = split.join(w, F.col("id").eqNullSafe(F.col("i")) & (F.col("part") == F.col("p")) & (F.col("place") == F.col("q")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece, pieces, start, goal, classes, initials, roles, texts = (batch.column(i).to_pylist() for i in range(1, 9))
            audits, said, messages = [], [], []
            for a, b in _slices([len(c) for c in classes]):
                last = np.array([p + 1 == n for p, n in zip(piece[a:b], pieces[a:b])])
                goals = np.array([end_goal() if end else one_goal(g) for end, g in zip(last, goal[a:b])])
                paths = Paths(classes[a:b], initials[a:b], goals, last)
                for i, (audit, nodes) in enumerate(paths.audits(np.array(start[a:b]))):
                    lines = _transcript(paths, nodes, int(paths.base[i]), roles[a + i], texts[a + i])
                    audits.append(audit)
                    said.append("\n".join(lines))
                    messages.append(len(lines))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(9), pa.array(audits, pa.string()),
                 pa.array(messages, pa.int64()), pa.array(said, pa.string())],
                names=["id", "piece", "report", "audit", "messages", "transcript"])

    return joined.select("id", "piece", "pieces", "start", "goal", "classes", "initials", "roles", "texts", "report") \
        .mapInArrow(run, f"id {id_type}, piece long, report array<long>, audit string, messages long, transcript string")


@dataclass
class Repaired:
    """``whole``: (id, report columns, audit, transcript) of conversations that fit a
    segment. ``pieces``: (id, piece, report, audit, messages, transcript) of the
    others, in order of ``piece``. Transcripts are ``role:text`` lines."""

    whole: DataFrame
    pieces: DataFrame
    id_col: str

    def digests(self) -> DataFrame:
        """One row a conversation: id, report, audit, ``repaired_sha256`` of the whole
        transcript. A digest of many pieces is taken of them as a stream."""
        kind = self.pieces.schema["id"].dataType.simpleString()
        short = self.whole.select("id", *REPORT_COLUMNS, "audit", F.sha2("transcript", 256).alias("repaired_sha256"))
        ordered = self.pieces.repartition("id").sortWithinPartitions("id", "piece")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_id, report, digest, audit, begun = None, None, None, [], False

            def close() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array([open_id], id_type), *(pa.array([x], pa.int64()) for x in report),
                     pa.array(["".join(audit)], pa.string()), pa.array([digest.hexdigest()], pa.string())],
                    names=["id", *REPORT_COLUMNS, "audit", "repaired_sha256"])

            for batch in batches:
                id_type = batch.schema.field(0).type
                for key, piece, own, edits, messages, said in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    if piece == 0:
                        if digest is not None:
                            yield close()
                        open_id, report, digest, audit, begun = key, own, hashlib.sha256(), [], False
                    audit.append(edits)
                    if messages:
                        digest.update((("\n" if begun else "") + said).encode())
                        begun = True
            if digest is not None:
                yield close()

        streamed = ordered.mapInArrow(run, f"id {kind}, {REPORT}, audit string, repaired_sha256 string")
        return short.unionByName(streamed).withColumnRenamed("id", self.id_col)


REPORT_COLUMNS = [c.split()[0] for c in REPORT.split(", ")]


def repair(df: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           times: str | None = None, segment_rows: int = SEGMENT_ROWS) -> Repaired:
    """Repair every conversation; ``times`` names a column of how often a row
    occurs (a conversation whose rows are all 0 has none, yet is returned).

    Rows are taken by turn, null turns first. A null role or text is one space, rows
    without id are one conversation. A row's first fault counts: blank (nothing but
    ASCII white space; empty texts too), duplicate (role and text seen before in the
    conversation), truncated (its last other character ends no sentence). Rows of
    one turn go by role and text, so repeated rows and ties have one result. Texts
    and conversations may be of any length. An empty table gives no rows.
    """
    if times is None:
        times = free_name(df, "times")
        df = df.withColumn(times, F.lit(1))
    segments = write_shared(pack(df, id_col, turn, role, text, times, segment_rows), "segments")
    id_type = segments.schema["id"].dataType.simpleString()
    several = segments.filter("edge").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("several"))
    edge, same = segments.filter("edge"), F.col("id").eqNullSafe(F.col("several"))
    whole = segments.filter("NOT edge").unionByName(edge.join(several, same, "left_anti"))
    split = write_shared(_settle(edge.join(several, same, "left_semi"), id_type), "split")
    ways = _ways(_tables(split, id_type), id_type)
    return Repaired(_repair_whole(whole, id_type), _repair_pieces(split, ways, id_type), id_col)

