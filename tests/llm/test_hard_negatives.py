"""Hard negatives: products, heaps, and the mined rows against plain loops."""

import numpy as np
import pytest

from fieldwave.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, row string, q int, rank string"


def test_strassen_is_exact():
    rng = np.random.default_rng(5)
    for m, k, n in [(1, 1, 1), (3, 5, 7), (64, 64, 64), (65, 33, 100), (130, 64, 1), (0, 4, 3), (5, 0, 2)]:
        for top in (3, 1 << 12, 1 << 27):
            a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
            want = a.astype(object) @ b.astype(object) if k else np.zeros((m, n), object)
            for leaf in (1, 4, 32):
                assert (hn.strassen(a, b, leaf) == want).all()


def test_sums_that_wrap_on_the_way_are_exact():
    a = np.full((4, 4), 1 << 60, np.int64)
    b = np.array([[7, 0, 1, 2], [-7, 0, -1, -2], [1, 3, 0, 0], [-1, -3, 0, 1]], np.int64)
    assert (hn.strassen(a, b, 1) == (a.astype(object) @ b.astype(object))).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(1)
    scores, names = rng.integers(-3, 4, (6, 40)), np.stack([np.zeros(40), np.arange(40) // 2, np.arange(40)], 1).astype(np.int64)
    allowed = rng.random((6, 40)) < 0.6
    parts = [hn.best_of(scores[:, c : c + 8], allowed[:, c : c + 8], names[c : c + 8], 3) for c in range(0, 40, 8)]
    for order in (range(5), [3, 1, 4, 0, 2]):
        heaps = hn.empty_heaps(6, 3)
        for k in order:
            heaps = hn.merge_heaps(heaps, parts[k])
        for r in range(6):
            want = sorted((-int(s), *map(int, n)) for s, n, ok in zip(scores[r], names, allowed[r]) if ok)[:3]
            assert [tuple(map(int, p)) for p in heaps[r]][: len(want)] == want


def brute(rows, every=50, shift=True):
    """rows: (vec_id, label, vector)."""
    used = []
    for k, (i, label, v) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        used.append((k, i, (label + 1) % 10 if shift and i is not None and i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda p: (-p[0], p[1] is None, p[1] or 0, p[2])
    out = []
    for k, i, label, v in used:
        if i is None or i % every:
            continue
        scored = sorted(((dot(v, w), j, kk, lab == label) for kk, j, lab, w in used if kk != k), key=order)
        for ps, j, _, _ in [p for p in scored if p[3]][:5]:
            fits = [p for p in scored if not p[3] and 50 * ps <= 100 * p[0] <= 95 * ps][:3]
            out += [(i, j, r + 1, p[1], ps, p[0]) for r, p in enumerate(fits)]
    return sorted(map(repr, out))


def answer(spark, rows, **options):
    from pyspark.sql import functions as F

    df = hn.integer_vectors(spark.createDataFrame([(i, label, v, "x", 1, "y") for i, label, v in rows], SCHEMA))
    df = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return sorted(repr(tuple(r)) for r in hn.mine_hard_negatives(df, **options).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    rows = [(int(i), int(rng.choice([0, 0, 0, 1, 2, 9])), [float(x) for x in rng.normal(0.2, 0.3, 6)]) for i in range(260)]
    rows += [(i, 1, list(rows[4][2])) for i in range(300, 340)]  # one vector many times
    rows += [(50, 2, [0.5] * 6), (50, 2, [0.5] * 6), (None, 0, [0.4] * 6), (None, 1, [0.3] * 6), (51, 0, [0.4, 0.2]), (52, 3, [])]  # repeated and null ids, short vectors
    rows += [(100, None, [0.5] * 6), (150, 0, None), (53, 0, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (54, 1, [float("nan")] * 6), (55, 1, [float("inf")] + [0.1] * 5)]  # take no part
    return rows + [(350, 4, [0.0] * 6), (-50, 0, [0.3] * 6), (400, 77, [0.9] * 6)]


def test_against_plain_loops(spark, rows):
    want = brute(rows)
    assert len(want) > 30
    assert answer(spark, rows) == want


def test_groups_of_anchors_change_nothing(spark, rows):
    assert answer(spark, rows, group_bytes=6 * 8 * 2) == brute(rows)


def test_values_that_no_long_can_hold_take_no_part(spark):
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.75, 0.75]), (3, 2, [1e300, 0.7]), (4, 2, [8.0e6, 8.0e6]), (6, 3, [-0.75, 2.25])]
    assert answer(spark, rows) == brute([r for r in rows if r[0] not in (3, 4)])


def test_no_rows(spark):
    assert answer(spark, []) == []
    assert answer(spark, [(1, 1, [1.0])]) == []
