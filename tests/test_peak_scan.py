"""The scan over blocks equals the scan of the whole series, however it is cut."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldwave.operators import events as V
from fieldwave.operators import peak_scan as P


def whole(values, threshold):
    turns = P.Turns(threshold)
    return turns.feed(np.arange(len(values)), np.asarray(values, float))


def summary(values, start, threshold):
    turns = P.Turns(threshold)
    found = turns.feed(np.arange(start, start + len(values)), np.asarray(values, float))
    return (found[0] if found else None), turns.state, found[1:]


def in_blocks(values, cuts, threshold, fan):
    parts = [summary(values[a:z], a, threshold) for a, z in zip(cuts, cuts[1:])]
    out, state = [], None
    for k in range(0, len(parts), fan):
        group = parts[k : k + fan]
        first, end = P.compose([p[:2] for p in group], threshold)
        inner, reached = [], state
        for own, last, rest in group:
            found, reached = P.follow(reached, own, last, threshold)
            inner += found + rest
        found, state = P.follow(state, first, end, threshold)
        assert inner[: len(found)] == found  # the group's summary tells what its blocks do
        way, high, low = state
        assert way == reached[0] and (way < 0 or high == reached[1]) and (way > 0 or low == reached[2])
        out += inner
    return out


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=1, max_size=40), st.integers(0, 7), st.data())
def test_summaries_compose(values, threshold, data):
    inner = data.draw(st.sets(st.integers(1, max(1, len(values) - 1))))
    cuts = sorted({0, len(values)} | {c for c in inner if c < len(values)})
    for fan in (1, 2, 3):
        assert in_blocks(values, cuts, threshold, fan) == whole(values, threshold)


def test_summaries_compose_for_any_float():
    rng = random.Random(4)
    for _ in range(800):
        values = [rng.choice([rng.gauss(0, 1), rng.random() * 1e-9, 0.1 * rng.randint(-20, 20)]) for _ in range(rng.randint(1, 60))]
        cuts = sorted({0, len(values), *rng.sample(range(len(values)), min(6, len(values)))})
        threshold = rng.choice([0.1, 0.30000000000000004, 1.0, 2.0])
        assert in_blocks(values, cuts, threshold, 2) == whole(values, threshold)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    rows = [("walk", i, float(v)) for i, v in enumerate(rng.normal(0, 1, 5000).cumsum())]
    rows += [("flat", i, 1.0) for i in range(300)] + [("one", 7, 0.0), ("two", -5, 0.0), ("two", 9, 50.0), (None, 3, 0.0), (None, 400, 9.0), (None, 900, -9.0)]
    rows += [("slow", i, float(i // 100 % 7 * 3)) for i in range(-1500, 1500)] + [("gaps", i * 37 - 4000, float(v)) for i, v in enumerate(rng.integers(-9, 9, 300))]
    rows += [("holes", i, [None, float("nan"), 5.0, 0.0][i % 4]) for i in range(200)]
    return spark.createDataFrame(rows, "rec string, idx long, v double"), pd.DataFrame(rows, columns=["rec", "idx", "v"])


@pytest.mark.parametrize("block_bits, group_bits", [(16, 12), (5, 12), (4, 3), (2, 2), (0, 1)])
def test_blocks_of_any_size(spark, series, block_bits, group_bits):
    """Up to twelve levels; negative places, gaps, a series without a name, values that are missing."""
    df, pdf = series
    if block_bits == 0:
        df, pdf = df.where("rec in ('two', 'holes', 'flat')"), pdf[pdf["rec"].isin(["two", "holes", "flat"])]
    want = []
    for rec, rows in pdf.groupby("rec", dropna=False):
        rows = rows.dropna(subset=["v"]).sort_values("idx")
        turns = P.Turns(4.0)
        want += [(None if rec != rec else rec, i, v, k) for k, v, i in turns.feed(rows["idx"].to_numpy(), rows["v"].to_numpy())]
    got = [(r.rec, r.idx, r.v, 1 if r.kind == "peak" else -1) for r in P.detect(df.repartition(5), 4.0, ["rec"], block_bits=block_bits, group_bits=group_bits).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 50


def test_no_window_spans_a_series(spark, series):
    df, _ = series
    rows = df.withColumn("_block", df.idx / 16)
    plan = P.scan_blocks(rows, 4.0, ["rec"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and all("_block" in line for line in windows)
    found = V.detect_peaks(df, 4.0, ["rec"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in found


def test_no_keys_and_no_rows(spark, series):
    df, pdf = series
    one = pdf[pdf["rec"] == "walk"]
    got = P.detect(df.where("rec = 'walk'").drop("rec"), 4.0, [], block_bits=6, group_bits=3).collect()
    assert sorted((r.idx, r.v) for r in got) == sorted((i, v) for _, v, i in P.Turns(4.0).feed(one["idx"].to_numpy(), one["v"].to_numpy()))
    assert P.detect(df.limit(0), 4.0, ["rec"]).collect() == []
