"""Late session merging: the versions that sessions go through while batches with late events arrive, by reverse deletion.

Events of a user that lie at most ``gap`` seconds apart share a session. After each batch a session that holds an event of that batch
is a new version, and retracts the standing sessions that it contains. Going forward sessions would have to be merged; going
backward they only split: the final sessions are a doubly linked list of events, batches are taken out from the last to the
first, and where a gap widens beyond ``gap`` a session falls apart. Read the other way round, a session that vanishes was created,
one that stays in one piece was extended, and one that falls into several pieces was merged from them.

An event arrives at most ``late`` batches after the window it lies in, so what lies that far back no longer changes. Timelines are
therefore cut into blocks of ``span`` windows, each with the events of ``late`` windows before it and of as many and a gap behind,
and with one row for what the session in progress at its left edge holds (its carry). Blocks are independent of each other: a
user with a third of all events is many groups, and as events of one second and batch are counted together first, a block holds at
most (late + 1) rows a second. Carries run through blocks that hold no gap at all by pointer doubling: log2 of the longest such run
in joins on unique keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.llm.common import dropped, table, written

VERSIONS = "user long, batch long, start_s long, end_s long, n_events long, n_new long, n_retracted long, h_sum long, retracted_batch long, retracted_start_s long"
#: The batch of a carry: it came before all others.
BEFORE = -(1 << 63)


@dataclass(frozen=True)
class SessionParams:
    gap: int = 240  # seconds between neighbours of one session, at most
    window: int = 1800  # seconds of the window that a batch belongs to
    late: int = 3  # batches an event may come late
    span: int = 16  # windows a block; more than late


def _div(x: Column, n: int) -> Column:
    """Floor of x / n in whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(n).cast("long")), F.lit(n).cast("long"))


def reverse_deletion(s: list[int], batch: list[int], n: list[int], h: list[int], start: list[int], gap: int) -> list[tuple]:
    """The versions of sessions over rows in order of time: second, batch (BEFORE: never taken out), events, sum, and the second at
    which what the row stands for began. Rows as in VERSIONS, without the user.

    Each batch walks from its first row to the end of the sessions it touches, so the work is rows times ``late`` at most."""
    m = len(s)
    s, n, h, start = [0, *s], [0, *n], [0, *h], [0, *start]  # row 0 is the head of the list
    before, behind = [m, *range(m)], [*range(1, m + 1), 0]
    standing: list[tuple] = []  # sessions in order: first row, last row, events, sum, what retracts it
    first, events, total = 1, 0, 0
    for i in range(1, m + 1):
        events, total = events + n[i], total + h[i]
        if i == m or s[i + 1] - s[i] > gap:
            standing.append((first, i, events, total, (None, None)))
            first, events, total = i + 1, 0, 0
    of_batch: dict[int, list[int]] = {}
    for i, b in enumerate(batch, 1):
        if b != BEFORE:
            of_batch.setdefault(b, []).append(i)
    out = []
    for b in sorted(of_batch, reverse=True):
        gone, at, near = of_batch[b], 0, []
        while standing and standing[-1][1] >= gone[0]:
            near.append(standing.pop())
        for session in reversed(near):
            first, last, events, total, retracted = session
            own = []
            while at < len(gone) and gone[at] <= last:
                own.append(gone[at])
                at += 1
            if not own:
                standing.append(session)
                continue
            left = before[own[0]]  # the last row ahead of what goes
            for i in own:
                behind[before[i]], before[behind[i]] = behind[i], before[i]
            by, pieces = (b, start[first]), []
            held = first <= left  # the rows up to left stay together
            piece = [first, left, 0, 0] if held else None
            i = behind[left]
            while i and i <= last:
                if piece is None or s[i] - s[piece[1]] > gap:
                    if piece:
                        pieces.append(piece)
                    piece = [i, i, 0, 0]
                piece[1], piece[2], piece[3] = i, piece[2] + n[i], piece[3] + h[i]
                i = behind[i]
            if piece:
                pieces.append(piece)
            new = sum(n[i] for i in own)
            if held:
                pieces[0][2] += events - new - sum(p[2] for p in pieces)
                pieces[0][3] += total - sum(h[i] for i in own) - sum(p[3] for p in pieces)
            standing.extend((*p, by) for p in pieces)
            out.append((b, start[first], s[last], events, new, len(pieces), total, *retracted))
    return out


def _blocks(params: SessionParams):
    """Streams rows (user, block, s, batch, n, h, start) sorted by these; a block of a user is held at a time."""
    names = [f.split()[0] for f in VERSIONS.split(", ")]

    def told(keys, cols):
        user, block = keys
        lo, hi = block * params.span * params.window, (block + 1) * params.span * params.window
        return [(user, *r) for r in reverse_deletion(*cols, params.gap) if lo <= r[2] < hi]

    def frame(rows):
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    def run(batches):
        at, kept, rows = None, [[] for _ in range(5)], []
        for b in batches:
            keys = np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))]) if b.num_rows else np.zeros((2, 0), np.int64)
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), b.num_rows]
            cols = [b.column(i).to_pylist() for i in range(2, 7)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                here = (int(keys[0, x]), int(keys[1, x]))
                if here != at:
                    if at is not None:
                        rows += told(at, kept)
                    at, kept = here, [[] for _ in range(5)]
                for own, c in zip(kept, cols, strict=True):
                    own += c[x:y]
            if len(rows) >= 10_000:
                yield frame(rows)
                rows = []
        if at is not None:
            rows += told(at, kept)
        yield frame(rows)

    return run


def _carries(cells: DataFrame, params: SessionParams) -> DataFrame:
    """(user, segment, s, n, h, start): what the session that reaches into a segment holds up to the last event before it."""
    by = W.partitionBy("user", "segment")
    broken = F.coalesce(F.col("s") - F.lag("s").over(by.orderBy("s")) > params.gap, F.lit(True))
    marked = cells.withColumn("start", F.when(broken, F.col("s"))).withColumn("start", F.max("start").over(by))
    here = F.col("s") >= F.col("start")
    ends = marked.groupBy("user", "segment").agg(
        F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.max("start").alias("start"), F.sum(F.when(here, F.col("n"))).alias("n"), F.sum(F.when(here, F.col("h"))).alias("h"),
    )
    ends = written(ends)
    ahead = ends.select("user", (F.col("segment") + 1).alias("segment"), F.col("last_s").alias("_last"))
    joined = ends.join(ahead.hint("merge"), ["user", "segment"], "left").withColumn("linked", F.coalesce(F.col("first_s") - F.col("_last") <= params.gap, F.lit(False)))
    # a segment that is one run, and linked, passes on what comes into it
    state = written(joined.select("user", "segment", "last_s", "start", "n", "h", "linked", F.when(F.col("linked") & (F.col("start") == F.col("first_s")), F.col("segment") - 1).alias("source")))
    dropped(ends)
    while state.where("source is not null").take(1):
        up = state.select("user", F.col("segment").alias("source"), F.col("start").alias("_start"), F.col("n").alias("_n"), F.col("h").alias("_h"), F.col("source").alias("_source"))
        moved = state.where("source is not null").join(up.hint("merge"), ["user", "source"]).select("user", "segment", "last_s", F.col("_start").alias("start"), (F.col("n") + F.col("_n")).alias("n"), (F.col("h") + F.col("_h")).alias("h"), "linked", F.col("_source").alias("source"))
        after = written(state.where("source is null").unionByName(moved))
        dropped(state)
        state = after
    into = state.where("linked").select("user", "segment")
    ahead = state.select("user", (F.col("segment") + 1).alias("segment"), F.col("last_s").alias("s"), "n", "h", "start")
    return into.join(ahead.hint("merge"), ["user", "segment"])  # merges: users are never broadcast


def session_versions(events: DataFrame, params: SessionParams = SessionParams()) -> DataFrame:
    """Every version of every session of events (user, s, batch, h: longs), as VERSIONS says.

    Events without user, second or batch are none; a null h adds nothing; rows that repeat are events of their own, and events of one second share
    a session. A batch outside 0 to ``late`` windows behind its second's raises. No events, no versions.
    """
    if params.span <= params.late or params.gap > params.window:
        raise ValueError("a block must be wider than what comes late, and a gap no wider than a window")
    window = _div(F.col("s"), params.window)
    kept = events.where("user is not null and s is not null and batch is not null")
    checked = F.when((F.col("batch") - window).between(0, params.late), F.col("batch")).otherwise(F.raise_error(F.lit("an event arrives before its window or too late")).cast("long"))
    kept = kept.select(F.col("user").cast("long").alias("user"), F.col("s").cast("long").alias("s"), checked.alias("batch"), F.coalesce("h", F.lit(0)).cast("long").alias("h"))
    cells = kept.groupBy("user", "s", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))
    cells = written(cells.withColumn("segment", _div(window + params.late, params.span)))
    carries = _carries(cells, params)
    edge = (F.col("segment") * params.span - params.late) * params.window
    blocks = F.when(F.col("s") <= edge + params.late * params.window + params.gap, F.array("segment", F.col("segment") - 1)).otherwise(F.array("segment"))
    rows = cells.select("user", F.explode(blocks).alias("block"), "s", "batch", "n", "h", F.col("s").alias("start"))
    rows = rows.unionByName(carries.select("user", F.col("segment").alias("block"), "s", F.lit(BEFORE).cast("long").alias("batch"), "n", "h", "start"))
    return rows.repartition("user", "block").sortWithinPartitions("user", "block", "s", "batch").mapInArrow(_blocks(params), VERSIONS)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The contract's events of turns: (user, s, batch, h). A null turn is no event; without conversation there is no user and no time, so
    no event either; seconds beyond 64 bits are none."""
    t = conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"))
    t = t.withColumns({"c": F.crc32(F.col("conv_id").cast("string")), "h": F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))})
    g = _div(F.col("h"), 600)
    late = F.when(g % 5 == 0, g % 4).otherwise(F.lit(0).cast("long"))
    s = F.try_add(F.try_multiply(F.col("turn"), F.lit(300).cast("long")), _div(F.col("c"), 2) % 7200 + F.col("h") % 600)
    return t.select((F.shiftright("conv_id", 3) * 2 + F.col("c") % 2).alias("user"), s.alias("s"), late.alias("late"), "h").select("user", "s", (_div(F.col("s"), 1800) + F.col("late")).alias("batch"), "h")


def op11_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of the sessions of all turns of ``conversations``, with what retracts it."""
    return session_versions(conversation_events(table(spark, sf_dir, "conversations")))
