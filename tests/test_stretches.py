"""Islands between gaps, against plain loops."""

import numpy as np
import pytest

from fieldwave.operators import stretches as T


@pytest.mark.parametrize("fan, closed", [(4096, False), (2, False), (3, True)])
def test_islands(spark, fan, closed):
    """One island over many stretches, islands of one row, stretches without rows, ties, negative places."""
    rng = np.random.default_rng(3)
    series = {"dense": np.arange(3000) * 0.5 - 700, "gaps": np.cumsum(rng.choice([0.1, 0.5, 1.0, 1.5, 400.0], 800)), "one": np.array([7.0]), "same": np.zeros(50), "far": np.array([-1e6, -1e6 + 1.0, 0.0, 64.0, 65.0, 66.5, 1e6])}
    data = [(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(data, "rec string, id int, x double").repartition(5)
    got = {(r.rec, r.id): r.island for r in T.islands(df, ["rec"], "x", 1.0, ["id"], fan=fan, closed=closed).collect()}
    assert len(got) == len(data)
    for k, v in series.items():
        order, number, want = np.argsort(v, kind="stable"), 0, {}
        for before, i in zip([None, *order], order):
            gap = before is None or (v[i] - v[before] >= 1.0 if closed else v[i] - v[before] > 1.0)
            number += gap
            want[k, int(i)] = number
        assert {key: n for key, n in got.items() if key[0] == k} == want


def test_one_recording_with_all_rows_is_cut(spark):
    """Events across channels and distinct frequencies of a single recording: the greedy steps see stretches of it, with the result of one pass."""
    from fieldwave.operators import clusters as C
    from fieldwave.operators import frequencies as Q

    rng = np.random.default_rng(5)
    t = np.cumsum(rng.choice([0.3, 0.9, 1.0, 5.0], 6000, p=[0.3, 0.2, 0.1, 0.4]))
    pulses = spark.createDataFrame([("r", int(c), float(x), float(h)) for c, x, h in zip(rng.integers(0, 4, 6000), t, rng.random(6000))], "rec string, channel int, t double, height double")
    got = sorted((r.event, r.channel, r.t) for r in C.group_across_channels(pulses, ["rec"], 1.0, 0.05).collect())
    rows = sorted((r.t, r.channel, r.height) for r in pulses.collect())
    sessions, want, n = [[rows[0]]], [], 0
    for r in rows[1:]:
        sessions.append([r]) if r[0] - sessions[-1][-1][0] > 1.0 else sessions[-1].append(r)
    for s in sessions:
        left = list(s)
        for top in sorted(s, key=lambda r: (-r[2], r[0])):
            if top in left:
                near = [r for r in left if abs(r[0] - top[0]) <= 1.0]
                left = [r for r in left if r not in near]
                if top[2] >= 0.05:
                    n += 1
                    best = {}
                    for r in sorted(near, key=lambda r: (-r[2], abs(r[0] - top[0]))):
                        best.setdefault(r[1], r)
                    want += [(n, c, r[0]) for c, r in best.items()]
    assert got == sorted(want) and n > 1000
    f = spark.createDataFrame([("r", int(e), i, float(x)) for i, (e, x) in enumerate(zip(rng.integers(0, 6, 3000), np.cumsum(rng.choice([0.01, 0.2, 2.0], 3000))))], "rec string, element long, id long, f double")
    groups = Q.unique_frequencies_index(f, 0.5, ["rec"]).collect()
    assert len(groups) == 3000 and {(r.element, r.id) for r in groups} == {(r.element, r.id) for r in f.collect()}
    first = {}
    for r in groups:
        first[r.unique] = min(first.get(r.unique, (99, 0.0)), (r.element, r.f))
    assert sorted(first) == list(range(len(first))) and [first[k] for k in sorted(first)] == sorted(first.values())
