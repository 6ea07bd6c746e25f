"""Cheapest repair of conversations whose turns break the order of roles.

The roles of a sound conversation form a small language.  :class:`Tables` turns its
grammar into LR states; a conversation is then parsed by a graph-structured stack in
which every row may be kept, given another role or deleted and a turn may be inserted
between rows, each at a price.  Alternatives whose stacks end in the same state are
merged: the one with the smaller ``(cost, audit)`` stays.

Rows are range-partitioned by conversation and turn, so that a long conversation
spreads over as many tasks as it needs.  A task repairs the conversations that lie
inside it.  Those at its borders, and those longer than a segment, are cut into
segments; a segment's cheapest moves between all pairs of states are found on their
own, the segments are chained by those small tables, and only then are the pieces of
the repaired text made.  Only the digest of a repaired text runs through its pieces
in order; it holds one piece at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.staging import stage

# (s?(ua)+)? : the stack under a state is the same for every way into it, so equal tops may be merged.
GRAMMAR = {"conversation": ("", "P"), "P": ("ua", "sua", "Pua")}
ROLES = {"u": "user", "a": "assistant"}  # what rerole and insert may make
RETYPE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
SPACES = " \t\n\v\f\r"
SEGMENT_ROWS, SEGMENT_CHARS = 1_024, 1 << 22

Best = dict[int, tuple[int, str]]


class Tables:
    """LR(0) states of a grammar ``{left: (right, ...)}`` over one-character symbols; ``first``
    is the start.  States that hold one complete item of another symbol reduce at once."""

    def __init__(self, grammar: dict[str, tuple[str, ...]]):
        first = next(iter(grammar))

        def closed(items: set[tuple[str, str, int]]) -> frozenset:
            open_ = list(items)
            while open_:
                _, right, at = open_.pop()
                for more in grammar.get(right[at : at + 1], ()):
                    item = (right[at], more, 0)
                    if item not in items:
                        items.add(item)
                        open_.append(item)
            return frozenset(items)

        sets = [closed({(first, right, 0) for right in grammar[first]})]
        self.goto: dict[tuple[int, str], int] = {}
        for i, items in enumerate(sets):  # grows while it is read
            for symbol in sorted({right[at] for _, right, at in items if at < len(right)}):
                after = closed({(left, right, at + 1) for left, right, at in items if right[at : at + 1] == symbol})
                if after not in sets:
                    sets.append(after)
                self.goto[i, symbol] = sets.index(after)
        complete = [[(left, right) for left, right, at in items if at == len(right)] for items in sets]
        self.accepts = {i for i, c in enumerate(complete) if any(left == first for left, _ in c)}
        self.reduces = {i: next((left, len(right)) for left, right in c if left != first) for i, c in enumerate(complete) if any(left != first for left, _ in c)}
        # the one stack that leads to each state, shortest first
        self.stacks = {0: (0,)}
        for (i, _), j in sorted(self.goto.items()):
            self.stacks.setdefault(j, (*self.stacks[i], j))
        # states between rows, and where a terminal takes each of them
        self.states = [i for i in self.stacks if i not in self.reduces]
        self.shift = {(i, t): self._settle(i, t) for i, t in self.goto if t not in grammar and i in self.states}

    def _settle(self, state: int, terminal: str) -> int:
        stack = (*self.stacks[state], self.goto[state, terminal])
        while stack[-1] in self.reduces:
            left, n = self.reduces[stack[-1]]
            stack = stack[:-n]
            stack = (*stack, self.goto[stack[-1], left])
        assert stack == self.stacks[stack[-1]], "two stacks under one state"
        return stack[-1]


TABLES = Tables(GRAMMAR)


def _offer(best: Best, state: int, found: tuple[int, str]) -> bool:
    """Merge at the stack top ``state``; true if ``found`` is the better one."""
    if state in best and best[state] <= found:
        return False
    best[state] = found
    return True


def _with_inserts(best: Best) -> Best:
    """The tops that any number of inserted turns lead to as well."""
    out, open_ = dict(best), list(best)
    while open_:
        state = open_.pop()
        cost, audit = out[state]
        for t in ROLES:
            after = TABLES.shift.get((state, t))
            if after is not None and _offer(out, after, (cost + INSERT, audit + "I")):
                open_.append(after)
    return out


RUN = re.compile("x+|.", re.DOTALL)


@lru_cache(maxsize=50_000)
def repair(codes: str, entry: int) -> Best:
    """Cheapest ``(cost, audit)`` from the stack top ``entry`` to each other one over the rows
    ``codes``: ``x`` for a row that must go, else the role's initial (``?`` if it is none of the
    grammar's), in upper case (``!``) if its text is unfinished.

    A turn inserted before a deleted row costs what one after it costs and reads later
    (``I`` after ``D``), so inserts only stand before rows that stay and at the end.
    """
    best: Best = {entry: (0, "")}
    for m in RUN.finditer(codes):
        run = m[0]
        n = len(run)
        after = {s: (cost + DELETE * n, audit + "D" * n) for s, (cost, audit) in best.items()}
        if run[0] != "x":
            late = UNFINISHED if run in "USA!" else 0
            own = run.lower()
            for s, (cost, audit) in _with_inserts(best).items():
                to = TABLES.shift.get((s, own))
                if to is not None:
                    _offer(after, to, (cost + late, audit + "K"))
                for t in ROLES:
                    if (to := TABLES.shift.get((s, t))) is not None:
                        _offer(after, to, (cost + RETYPE + late, audit + "R"))
        best = after
    return best


def ending(best: Best) -> tuple[int, str, int] | None:
    """Cheapest ``(cost, audit, state)`` of the tops that end a conversation."""
    return min(((*found, s) for s, found in _with_inserts(best).items() if s in TABLES.accepts), default=None)


def repaired(codes: str, rows: list[tuple[str, str]], audit: str, state: int) -> list[str]:
    """``role:text`` of the turns that ``audit`` leaves, from the stack top ``state`` on; ``rows``
    are those that need not go."""
    lines, left, at = [], iter(rows), 0
    for edit in audit:
        role, text = "", ""
        if edit != "I":
            role, text = next(left) if codes[at] != "x" else ("", "")
            at += 1
        if edit == "D":
            continue
        symbol = role[:1] if edit == "K" else next(t for t in ROLES if (state, t) in TABLES.shift)
        lines.append(f"{role if edit == 'K' else ROLES[symbol]}:{text}")
        state = TABLES.shift[state, symbol]
    return lines


def damage(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, turn, role, text, copies)`` after damage that a checksum of each row's key and turn
    chooses; a dropped row leaves its conversation's key with no copies."""
    c = lambda name: F.coalesce(conversations[f"`{name}`"].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", c(key), c("turn")).cast("binary")) % 20
    gone = kind == 0
    return conversations.select(
        conversations[f"`{key}`"].alias("conv"),
        F.when(~gone, conversations["turn"].cast("long")).alias("turn"),
        F.when(gone, "").when(kind == 4, "user").otherwise(c("role")).alias("role"),
        F.when(gone | (kind == 1), "").when(kind == 2, F.regexp_replace(c("text"), "[.!?]", "")).otherwise(c("text")).alias("text"),
        F.when(gone, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


class Segment:
    """A run of one conversation's rows: its codes, its counts and the rows that need not go."""

    def __init__(self, conv):
        self.conv, self.codes, self.rows, self.chars, self.n = conv, [], [], 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first = self.last = self.first_turn = self.last_turn = None

    def add(self, turn, role, text, copies, repeated) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn, self.last_turn = (turn if self.first_turn is None else self.first_turn), turn
            self.n_turns += 1
        initial = role[:1]
        if self.n:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.illegal += (copies - 1) * (initial * 2 not in ("su", "ua", "au"))
        self.last = initial
        self.n += copies
        end = text.rstrip(SPACES)[-1:]
        if not end:
            self.blank += copies
            self.codes.append("x" * copies)
            return
        self.duplicate += copies if repeated else copies - 1
        if repeated:
            self.codes.append("x" * copies)
            return
        code = initial if initial in ("u", "s", "a") else "?"
        if end not in ".!?":
            self.truncated += 1
            code = "!" if code == "?" else code.upper()
        self.codes.append(code + "x" * (copies - 1))
        self.rows.append((role, text))
        self.chars += len(text)


STATS = ["first_turn", "last_turn", "n_turns", "blank", "duplicate", "truncated", "illegal"]
_long, _text = T.LongType(), T.StringType()


def _schema(key: T.DataType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("conv", key), *(T.StructField(n, t) for n, t in fields)])


def _batches(rows: Iterator[tuple], schema: T.StructType, size: int = 256) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    arrow, held = to_arrow_schema(schema), []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in it:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _moves(codes: str) -> bytes:
    """Costs and audit ranks of a segment for all pairs of stack tops; -1 where there is no way."""
    found = {(i, j): v for i in TABLES.states for j, v in repair(codes, i).items()}
    rank = {a: r for r, a in enumerate(sorted({audit for _, audit in found.values()}))}
    n = max(TABLES.states) + 1
    out = np.full((n, n, 2), -1, "<i8")
    for (i, j), (cost, audit) in found.items():
        out[i, j] = cost, rank[audit]
    return out.tobytes()


def cut_segments(rows: Iterator[tuple], task: int, segment_rows: int, segment_chars: int) -> Iterator[tuple]:
    """From rows in order, one task's segments with their number, counts and either the repair of
    a whole conversation (``cost``, ``audit``, ``sha``) or what chaining needs (``codes``,
    ``moves``, ``roles``, ``texts``)."""
    number, at_start, longer, seg = task << 32, True, False, None

    def closed(open_: bool) -> tuple:
        nonlocal number
        number += 1
        codes = "".join(seg.codes)
        counts = [getattr(seg, s) for s in STATS]
        if open_:
            return (seg.conv, number, seg.n, seg.first, seg.last, *counts, None, None, None, codes, _moves(codes), [r for r, _ in seg.rows], [t for _, t in seg.rows])
        cost, audit, _ = ending(repair(codes, 0))
        return (seg.conv, number, seg.n, seg.first, seg.last, *counts, cost, audit, digest(repaired(codes, seg.rows, audit, 0)), None, None, None, None)

    for conv, turn, role, text, copies, repeated in rows:
        if seg is not None and conv != seg.conv:
            yield closed(at_start or longer)
            seg, at_start, longer = None, False, False
        elif seg is not None and (seg.n + copies > segment_rows or seg.chars + len(text) > segment_chars):
            yield closed(True)
            seg, longer = None, True
        seg = seg or Segment(conv)
        if copies:
            seg.add(turn, role, text, copies, repeated)
    if seg is not None:
        yield closed(True)


def _chain(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From the open segments in order, each segment's entry and exit and, on a conversation's
    last one, its cost and counts."""
    conv, held, back, best, stats = None, [], [], {0: (0, 0)}, None

    def flush() -> Iterator[tuple]:
        # the order of the audits so far decides between equal costs; inserts at the end come last
        tails = {}
        for s, (cost, rank) in best.items():
            end = ending({s: (cost, "")})
            if end is not None:
                tails[s] = (end[0], rank, end[1])
        state = min(tails, key=tails.__getitem__)
        cost, _, tail = tails[state]
        out = []
        for number, came in zip(reversed(held), reversed(back), strict=True):
            out.append([conv, number, came[state], state, "", *[None] * 6])
            state = came[state]
        first, last, n_turns, *counts = stats[:7]
        gaps = last - first + 1 - n_turns if n_turns else 0
        out[0][4:] = [tail, cost, gaps, *counts]
        yield from map(tuple, reversed(out))

    for key, number, n, first, last, first_turn, last_turn, n_turns, blank, duplicate, truncated, illegal, moves in rows:
        if held and key != conv:
            yield from flush()
            held, back, best, stats = [], [], {0: (0, 0)}, None
        conv = key
        size = max(TABLES.states) + 1
        table = np.frombuffer(moves, "<i8").reshape(size, size, 2)
        ways = {}
        for i, (cost, rank) in best.items():
            for j in np.nonzero(table[i, :, 0] >= 0)[0]:
                way = (cost + int(table[i, j, 0]), rank, int(table[i, j, 1]), i)
                if int(j) not in ways or way < ways[int(j)]:
                    ways[int(j)] = way
        order = {k: r for r, k in enumerate(sorted({w[1:3] for w in ways.values()}))}
        best = {j: (w[0], order[w[1:3]]) for j, w in ways.items()}
        held.append(number)
        back.append({j: w[3] for j, w in ways.items()})
        if stats is None:
            stats = [first_turn, last_turn, n_turns, blank, duplicate, truncated, illegal, last if n else None]
        else:
            if n:
                seen = stats[7]
                stats[6] += seen is not None and seen + first not in ("su", "ua", "au")
                stats[7] = last
            if n_turns:
                stats[2] += n_turns - (stats[1] == first_turn)
                stats[0] = first_turn if stats[0] is None else stats[0]
                stats[1] = last_turn
            for k, v in zip((3, 4, 5, 6), (blank, duplicate, truncated, illegal), strict=True):
                stats[k] += v
    if held:
        yield from flush()


def _pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, number, codes, roles, texts, entry, leave, tail, *counts in rows:
        audit = repair(codes, entry)[leave][1] + tail
        lines = repaired(codes, list(zip(roles, texts, strict=True)), audit, entry)
        yield (conv, number, audit, "\n".join(lines), len(lines), *counts)


def _joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One row a conversation from its pieces in order: the text is only hashed."""
    sha = hashlib.sha256()
    audits, lines = [], 0
    for conv, _, audit, text, n, cost, *counts in rows:
        if n:
            sha.update(("\n" if lines else "").encode() + text.encode())
        audits.append(audit)
        lines += n
        if cost is not None:  # the last piece
            yield (conv, *counts, cost, "".join(audits), sha.hexdigest())
            sha, audits, lines = hashlib.sha256(), [], 0


def repair_conversations(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row per conversation of ``rows`` (``conv, turn, role, text, copies``): ``conv, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are taken by turn, nulls first; ties by role, then by a hash of the text and the text
    itself; ``copies`` of a row stand next to each other, and exact repeats of a row add up.
    Roles and texts must not be null.  A role without an initial is none of the grammar's, so
    its row is rerolled or deleted.  The null key is a conversation of its own.  A conversation
    without copies has zeros, an empty audit and the digest of the empty string.  No rows give
    an empty result.  Very long texts are read whole; only a segment's texts (4 million
    characters, or one row) are held at a time.  Other columns are not looked at.
    """
    spark = rows.sparkSession
    key = rows.schema["conv"].dataType
    once = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # where a text was seen first; most texts occur at one turn and are left out
    mark = F.md5(F.col("text").cast("binary"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    first = (
        rows.filter("copies > 0").groupBy("conv", "role", mark.alias("mark"))
        .agg(F.min(when).alias("first"), F.max(when).alias("late")).filter("first != late").drop("late")
    )
    first = first.withColumnsRenamed({"conv": "f_conv", "role": "f_role", "mark": "f_mark"})
    same = once["conv"].eqNullSafe(first["f_conv"]) & (once["role"] == first["f_role"]) & (mark == first["f_mark"])
    seen = F.coalesce(F.col("first") < when, F.lit(False))
    flagged = once.join(first, same, "left").select("conv", "turn", "role", "text", "copies", seen.alias("repeated"))
    at = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    ordered = flagged.repartitionByRange(*at).sortWithinPartitions(*at, "text")

    counts = [(s, _long) for s in STATS]
    schema = _schema(
        key, ("number", _long), ("n", _long), ("first", _text), ("last", _text), *counts, ("cost", _long), ("audit", _text), ("sha", _text),
        ("codes", _text), ("moves", T.BinaryType()), ("roles", T.ArrayType(_text)), ("texts", T.ArrayType(_text)),
    )
    segments = lambda it: cut_segments(_rows(it), TaskContext.get().partitionId(), segment_rows, segment_chars)
    cut = stage(ordered.mapInArrow(lambda it: _batches(segments(it), schema, 16), schema), "conversation-segments")
    gaps = F.when(F.col("n_turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns")).otherwise(F.lit(0)).cast("long")
    tail = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = cut.filter("codes IS NULL").select("conv", gaps.alias("gaps"), *tail, F.col("sha").alias("repaired_sha256"))

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("conv").sortWithinPartitions("conv", "number")

    rest = [("gaps", _long), *((s, _long) for s in tail[:4])]
    path_schema = _schema(key, ("number", _long), ("entry", _long), ("leave", _long), ("tail", _text), ("cost", _long), *rest)
    open_ = cut.filter("codes IS NOT NULL")
    light = in_order(open_.select("conv", "number", "n", "first", "last", *STATS, "moves"))
    path = light.mapInArrow(lambda it: _batches(_chain(_rows(it)), path_schema), path_schema)
    path = path.withColumnsRenamed({"conv": "p_conv", "number": "p_number"})
    ways = open_.select("conv", "number", "codes", "roles", "texts").join(path, F.col("number") == F.col("p_number")).select(
        "conv", "number", "codes", "roles", "texts", "entry", "leave", "tail", "cost", *[n for n, _ in rest]
    )
    piece_schema = _schema(key, ("number", _long), ("audit", _text), ("text", _text), ("lines", _long), ("cost", _long), *rest)
    pieces = in_order(ways.mapInArrow(lambda it: _batches(_pieces(_rows(it)), piece_schema, 16), piece_schema))
    out_schema = _schema(key, *rest, ("cost", _long), ("audit", _text), ("repaired_sha256", _text))
    chained = pieces.mapInArrow(lambda it: _batches(_joined(_rows(it)), out_schema), out_schema)
    return whole.unionByName(chained)


def repaired_turns(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """The digest of :func:`repair_conversations` over rows as they are, without damage; null
    roles and texts count as one space."""
    text = lambda c: F.coalesce(conversations[f"`{c}`"].cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(
        conversations[f"`{key}`"].alias("conv"), conversations["turn"].cast("long").alias("turn"), text("role"), text("text"), F.lit(1).cast("long").alias("copies")
    )
    return repair_conversations(rows).withColumnRenamed("conv", key)
