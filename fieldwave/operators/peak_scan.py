"""The hysteresis scan of series that are cut into blocks, each scanned by a task of its own.

What a block does depends on the state it begins in only until the first event
that it confirms by itself.  From there on every scan of it is in the same
state: the sample that confirms a peak is the lowest of the block so far, lower
also than any trough the scan may have held before, or that trough has become an
event.  So a block is summed up by its first event and its last state, a block
without events by its extremes, and summaries of neighbours compose to the
summary of both.  States at the beginning of blocks come from composing upwards
in groups, then following downwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldwave.operators.stretches import each_stretch
from fieldwave.sources.shared import written

#: (value, place) of a running extreme.
Extreme = tuple[float, int]
#: (way, highest, lowest): way is 1 after a trough, -1 after a peak, 0 before the first event; only the extreme that the way leads to counts.
State = tuple[int, Extreme, Extreme]
#: (kind, value, place): kind is 1 for a peak, -1 for a trough.
Event = tuple[int, float, int]


class Turns:
    """The scan of a series that comes in parts: it goes on where it stopped."""

    def __init__(self, threshold: float):
        self.threshold, self.way, self.high, self.low = threshold, 0, None, None

    def feed(self, places: np.ndarray, values: np.ndarray) -> list[Event]:
        """The events that these samples confirm."""
        out = []
        for place, v in zip(places.tolist(), values.tolist()):
            if self.high is None:
                self.high = self.low = (v, place)
                continue
            if self.way >= 0 and v > self.high[0]:
                self.high = (v, place)
            if self.way <= 0 and v < self.low[0]:
                self.low = (v, place)
            if self.way >= 0 and self.high[0] - v > self.threshold:
                out.append((1, *self.high))
                self.way, self.low = -1, (v, place)
            elif self.way <= 0 and v - self.low[0] > self.threshold:
                out.append((-1, *self.low))
                self.way, self.high = 1, (v, place)
        return out

    @property
    def state(self) -> State:
        return self.way, self.high, self.low


def follow(state: State | None, first: Event | None, end: State, threshold: float) -> tuple[list[Event], State]:
    """The events up to a block's first own one, and the state behind it, for a scan that enters it in ``state`` (None: it begins there)."""
    if state is None:
        return ([first] if first else []), end
    way, high, low = state
    if first is None:
        _, top, bottom = end
        if way >= 0 and high[0] - bottom[0] > threshold:
            return [(1, *high)], (-1, high, bottom)
        if way <= 0 and top[0] - low[0] > threshold:
            return [(-1, *low)], (1, top, low)
        return [], (way, high if high[0] >= top[0] else top, low if low[0] <= bottom[0] else bottom)
    kind, value, _ = first
    if kind > 0:
        if way <= 0 and value - low[0] > threshold:
            return [(-1, *low), first], end
        return ([] if way < 0 else [first if value > high[0] else (1, *high)]), end
    if way >= 0 and high[0] - value > threshold:
        return [(1, *high), first], end
    return ([] if way > 0 else [first if value < low[0] else (-1, *low)]), end


def compose(blocks: Iterable[tuple[Event | None, State]], threshold: float) -> tuple[Event | None, State]:
    """The summary of neighbouring blocks as one."""
    first, state = None, None
    for own, end in blocks:
        found, state = follow(state, own, end, threshold)
        first = first or (found[0] if found else None)
    return first, state


# ---------------------------------------------------------------- tables of summaries
_SUMMARY = "first_kind int, first_v double, first_idx long, way int, high_v double, high_idx long, low_v double, low_idx long"
_NAMES = [c.split()[0] for c in _SUMMARY.split(", ")]
_EVENT = "kind int, v double, idx long"
_HEAD, _NO_STATE = 9, 9  # a row that holds the state of its group; no state, as at the beginning of a series


def _flat(first: Event | None, state: State) -> tuple:
    return (*(first or (0, *state[1])), state[0], *state[1], *state[2])


def _summary(row: tuple) -> tuple[Event | None, State]:
    return (tuple(row[:3]) if row[0] else None), (row[3], (row[4], row[5]), (row[6], row[7]))


def scan_blocks(samples: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    """One row per block (keys, _block; kind 0, its summary) and per event after its first (kind, v, idx).

    ``samples(keys, _block, idx, v)``.  In a task only the samples at which a block turns, and its ends, are looked at.
    """
    # the window has put a block into one partition
    return _scanned(turning_samples(samples, keys), threshold, keys)


def turning_samples(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The samples at which a block turns, and its ends; every event is one of them."""
    w = W.partitionBy(*keys, "_block").orderBy("idx")
    before, after = F.col("_b"), F.col("_a")
    turn = ((F.col("v") >= before) & (F.col("v") >= after)) | ((F.col("v") <= before) & (F.col("v") <= after))
    rows = samples.withColumn("_b", F.lag("v").over(w)).withColumn("_a", F.lead("v").over(w))
    return rows.where(before.isNull() | after.isNull() | turn).drop("_b", "_a")


def _scanned(rows: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    def more(held, pdf):
        turns, first = held
        found = turns.feed(pdf["idx"].to_numpy(), pdf["v"].to_numpy())
        if found and not first:
            first.append(found.pop(0))
        return [(*e, *[0] * len(_NAMES)) for e in found]

    def end(held):
        turns, first = held
        return [(0, 0.0, 0, *_flat(first[0] if first else None, turns.state))]

    return each_stretch(rows, [*keys, "_block"], ["idx"], f"{_EVENT}, {_SUMMARY}", lambda: (Turns(threshold), []), more, end)


def _state_rows(held: State | None) -> tuple:
    return (_NO_STATE, 0.0, 0, 0.0, 0) if held is None else (held[0], *held[1], *held[2])


def _compose_level(level: DataFrame, threshold: float, keys: Sequence[str], bits: int) -> DataFrame:
    """Groups of ``2**bits`` neighbours as blocks of the next level."""

    def more(held, pdf):
        for row in pdf[_NAMES].itertuples(index=False, name=None):
            found, held[1] = follow(held[1], *_summary(row), threshold)
            held[0] = held[0] or (found[0] if found else None)
        return []

    rows = level.withColumn("_up", F.shiftright("_block", bits)).repartition(*keys, "_up")
    above = each_stretch(rows, [*keys, "_up"], ["_block"], _SUMMARY, lambda: [None, None], more, lambda held: [_flat(*held)])
    return above.withColumnRenamed("_up", "_block")


def _follow_level(level: DataFrame, began: DataFrame | None, threshold: float, keys: Sequence[str], bits: int, last: bool) -> DataFrame:
    """The state in which each block of a level begins (keys, _block, state), or, at the last level, the events of ``entry_events``.

    ``began`` holds the same of the level above, a row before those of its
    group; without it a series is one group and begins without a state.
    """

    def more(held, pdf):
        out = []
        for block, *row in pdf[["_block", *_NAMES]].itertuples(index=False, name=None):
            if row[0] == _HEAD:
                held[0] = None if row[3] == _NO_STATE else (row[3], (row[4], row[5]), (row[6], row[7]))
                continue
            if not last:
                out.append((block, *_state_rows(held[0])))
            found, held[0] = follow(held[0], *_summary(row), threshold)
            if last:
                out += found
        return out

    rows, by = level.select(*keys, "_block", *_NAMES), list(keys)
    if began is not None:
        head = [F.lit(_HEAD).alias("first_kind"), F.lit(0.0).alias("first_v"), F.lit(0).cast("long").alias("first_idx")]
        rows = rows.withColumn("_up", F.shiftright("_block", bits)).unionByName(began.select(*keys, F.col("_block").alias("_up"), F.lit(-(1 << 62)).alias("_block"), *head, *_NAMES[3:]))
        by.append("_up")
    rows = rows.repartition(*by) if by else rows.repartition(1)  # a row per group of the level below
    out = each_stretch(rows, by, ["_block"], _EVENT if last else f"_block long, {', '.join(_SUMMARY.split(', ')[3:])}", lambda: [None], more, lambda held: [])
    return out.drop("_up")


def entry_events(blocks: DataFrame, threshold: float, keys: Sequence[str], bits: int = 12) -> DataFrame:
    """(keys, kind, v, idx): the events up to and with each block's first own one.

    ``blocks(keys, _block, summary)``.  ``2**bits`` neighbours are composed to
    one block of the next level until a series is one group; then each level's
    groups, which know the state they begin in, hand it down.
    """
    levels = [blocks.select(*keys, "_block", *_NAMES)]
    span = blocks.agg(F.max(F.abs("_block"))).first()[0] or 0
    while span >> bits:
        span >>= bits
        levels.append(written(_compose_level(levels[-1], threshold, keys, bits), "levels"))
    began = None
    for level in reversed(levels):
        began = _follow_level(level, began, threshold, keys, bits, last=level is levels[0])
    return began


def detect(samples: DataFrame, threshold: float, keys: Sequence[str], *, block_bits: int = 16, group_bits: int = 12, also: Sequence[str] = ()) -> DataFrame:
    """(keys, idx, v, kind, also): the events of whole series ``samples(keys, idx, v)``, cut into blocks of ``2**block_bits`` places.

    No task sees more than a block of a series, or the summaries of a group of
    blocks, and both only batch by batch.  ``also`` names columns of the samples that
    events keep; they meet the samples at which blocks turn, not all of them.
    """
    rows = samples.select(*keys, F.col("idx").cast("long"), F.col("v").cast("double"), *also).where(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = rows.withColumn("_block", F.shiftright("idx", block_bits))
    if also:
        turns = written(turning_samples(rows, keys), "turns")
        scanned = written(_scanned(turns.drop(*also).repartition(*keys, "_block"), threshold, keys), "scan")
    else:
        scanned = written(scan_blocks(rows, threshold, keys), "scan")
    entry = entry_events(scanned.where("kind = 0"), threshold, keys, group_bits)
    found = scanned.where("kind <> 0").select(*keys, "kind", "v", "idx").unionByName(entry)
    found = found.select(*keys, "idx", "v", F.when(F.col("kind") > 0, "peak").otherwise("trough").alias("kind"))
    return found.join(turns.select(*keys, "idx", *also), [*keys, "idx"]) if also else found
