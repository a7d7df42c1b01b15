"""Near-duplicate groups by HyperMinHash.

A document's set of five-word shingles is sketched in 256 registers.  A register
belongs to a bucket of the hash space and holds, of the bucket's smallest hash,
the count of leading zeros and ten mantissa bits; empty buckets borrow from
others by a fixed probing order.  Registers are banded to find candidates, the
Jaccard estimate, corrected for chance collisions, discards most of them, and
the rest is confirmed on the full sets.

Only what decides components is verified.  Documents with equal sets are one
class.  First each class meets the leading class of the bucket it shares most
bands with, then the one it is most similar to by estimate.  What still lies
outside a bucket's largest component probes the bucket in full, in tiles of
bounded size that return the few links that join components, never pairs; the
members of the largest component never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import fresh, small_batches, use_table, written

_N = 5  # words in a shingle
_BITS, _MANTISSA = 8, 10
REGISTERS = 1 << _BITS
ROWS, BANDS = 5, 51  # a pair at 0.75 shares no band with probability 1e-6
_TILE = 512  # members of a bucket that meet in one piece of work
_MEMO = 200_000  # word hashes that a worker remembers
_FILTER_BITS = 1 << 23  # of the filter over ids whose sets are needed: one MB


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalizer with good avalanche on 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_FACTORS = _mix(np.arange(1, _N + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_memo: dict[bytes, int] = {}


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_memo) > _MEMO:
        _memo.clear()
    for w in set(words).difference(_memo):
        _memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    n = min(len(h), _N)
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * _FACTORS[i]
    return np.unique(_mix(total))


def _probes() -> np.ndarray:
    at = np.arange(REGISTERS, dtype=np.uint64)[None, :] + np.arange(1, 129, dtype=np.uint64)[:, None] * np.uint64(1 << 20)
    return (_mix(at * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


_PROBES = _probes()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers (unsigned 16 bit: zeros in the high six, mantissa in the low ten) of a sorted, non-empty set."""
    edges = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _BITS)
    first = np.searchsorted(hashes, edges)
    full = np.diff(np.append(first, len(hashes))) > 0
    rest = hashes[np.minimum(first, len(hashes) - 1)] << np.uint64(_BITS)
    zeros = np.where(rest > 0, 64 - np.frexp(rest.astype(np.float64))[1], 63).clip(0, 63).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1)).clip(0, 63)) >> np.uint64(64 - _MANTISSA)
    out = ((zeros << np.uint64(_MANTISSA)) | mantissa).astype(np.uint16)
    empty = np.flatnonzero(~full)
    for probe in _PROBES:
        if not len(empty):
            break
        to = probe[empty]
        good = full[to]
        out[empty[good]] = out[to[good]]
        empty = empty[~good]
    if len(empty):
        filled = np.flatnonzero(full)
        out[empty] = out[filled[np.searchsorted(filled, _PROBES[0][empty]) % len(filled)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """Keys (row per sketch, column per band)."""
    bands = registers[:, : ROWS * BANDS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(bands.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return key.view(np.int64)


#: Chance that registers of unrelated sets agree: half the mantissa values' inverse, weighted by how often counts of zeros agree.
_CHANCE = 1 / 3 / (1 << _MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch pairs, corrected for chance collisions."""
    return ((a == b).mean(-1) - _CHANCE) / (1 - _CHANCE)


def possible(estimates: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Pairs that may reach ``least``: by their sizes, and within five standard errors of the estimate."""
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    error = np.sqrt(least * (1 - least) / np.minimum(REGISTERS, low))
    return (low >= least * high - 1e-9) & (estimates >= least - 5 * error)


def _registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint16).reshape(-1, REGISTERS)


# ---------------------------------------------------------------- tables
def sketches(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, n, set_id, registers) of every document; the last two are null for empty sets.

    ``row`` names a column of unique integers that tells rows apart, else one is
    made.  Ids never reach Python.
    """

    @F.pandas_udf("struct<n:long,set_id:binary,registers:binary>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        use_table("shingles", _memo.clear)
        n, ids, regs = [], [], []
        for text in texts:
            s = shingle_set(text)
            n.append(len(s))
            ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            regs.append(sketch(s).tobytes() if len(s) else None)
        return pd.DataFrame({"n": n, "set_id": ids, "registers": regs})

    key = F.monotonically_increasing_id() if row is None else F.col(row)
    return written(docs.select(key.alias("row"), "doc_id", sketched("text").alias("s")).select("row", "doc_id", "s.*"), "sketches")


def banded(classes: DataFrame) -> DataFrame:
    """(key, rep) for every band of every class."""

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                keys = band_keys(_registers(pdf["registers"][a : a + 2000]))
                yield pd.DataFrame({"key": keys.ravel(), "rep": np.repeat(pdf["rep"][a : a + 2000].to_numpy(), BANDS)})

    return classes.select("rep", "registers").mapInPandas(run, "key long, rep long")


def plausible(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose estimate allows a link."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                ok = possible(estimate(_registers(pdf["ra"]), _registers(pdf["rb"])), pdf["na"].to_numpy(), pdf["nb"].to_numpy(), least)
                yield pdf.loc[ok, ["a", "b"]]

    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long")


def full_sets(docs: DataFrame, classes: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, hashes) of the given classes, from the texts.

    A one-MB bit filter over the wanted ids keeps all other texts from being
    hashed and shuffled; it is exact after the join, however full it gets.
    """
    wanted = written(reps.join(classes.select("rep", "doc_id", "set_id"), "rep"), "wanted")
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(_FILTER_BITS)) + 1  # bucket numbers begin at 1 for values from 1 on
    parts = wanted.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect()
    bits = np.zeros(_FILTER_BITS + (1 << 16), bool)
    for p in parts:
        at = (p.part - 1) << 15
        bits[at : at + (1 << 15)] = np.unpackbits(np.frombuffer(bytes(p.bits), np.uint8), bitorder="little")
    mask = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    near = F.bitmap_bucket_number("spot"), F.bitmap_bit_position("spot")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        use_table("shingles", _memo.clear)
        have = np.unpackbits(mask.value).astype(bool)
        for pdf in batches:
            pdf = pdf[have[((pdf["part"] - 1) * (1 << 15) + pdf["bit"]).to_numpy()]]
            for a in range(0, len(pdf), 500):
                some = pdf[a : a + 500]
                sets = [shingle_set(t).tobytes() for t in some["text"]]
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "set_id": [xxhash.xxh3_128_digest(s) for s in sets], "hashes": sets})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", spot.alias("spot")).select("doc_id", "text", near[0].alias("part"), near[1].alias("bit"))  # ids reach pandas as text, whole
    made = rows.mapInPandas(run, "doc_id string, set_id binary, hashes binary").withColumn("doc_id", F.col("doc_id").cast(kind)).alias("m")
    same = F.col("m.set_id").eqNullSafe(F.col("w.set_id")) & F.col("m.doc_id").eqNullSafe(F.col("w.doc_id"))
    return written(made.join(wanted.alias("w"), same).select("rep", "hashes").dropDuplicates(["rep"]), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` with 100 * intersection >= percent * union on the full sets."""
    reps = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = full_sets(docs, classes, reps)

    def run(batches):
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["sa"], pdf["sb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    side = lambda x: sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"s{x}"))
    return written(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long"), "links")


def _cuts(pdf: pd.DataFrame) -> list[int]:
    spot = pdf[["key", "ti", "tj"]].to_numpy()
    return [0, *(np.flatnonzero((spot[1:] != spot[:-1]).any(1)) + 1)]


def _pieces(pdf: pd.DataFrame, cuts: list[int]) -> Iterator[dict[str, np.ndarray]]:
    """The tiles of a batch as arrays by column, cut from those of the whole batch."""
    whole = {c: _registers(pdf[c]) if c == "registers" and len(pdf) else pdf[c].to_numpy() for c in pdf}
    for i, j in zip(cuts, cuts[1:]):
        if j - i > 1:
            yield {c: v[i:j] for c, v in whole.items()}


def _frame(made: list[tuple[np.ndarray, ...]], schema: str) -> pd.DataFrame:
    """What tiles returned, column by column, as one frame."""
    names = [x.split() for x in schema.split(", ")]
    return pd.DataFrame({n: np.concatenate([np.asarray(m[k]) for m in made]).astype("float64" if t == "double" else "int64") for k, (n, t) in enumerate(names)})


def sided(rows: DataFrame) -> DataFrame:
    """``rows(key, rep, label)`` of buckets with size, outside (not in the bucket's largest component) and n_outside; whole buckets of one component go."""
    counts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    sides = counts.groupBy("key").agg(F.sum("n").alias("size"), F.max("n").alias("top"), F.max_by("label", F.struct("n", "label")).alias("main"))
    sides = written(sides.select("key", "size", (F.col("size") - F.col("top")).alias("n_outside"), "main").where("n_outside > 0"), "sides")  # a table of its own, so that hot buckets of the other side can be split
    return rows.join(sides, "key").select("key", "rep", "label", "size", "n_outside", (F.col("label") != F.col("main")).alias("outside"))


def _in_tiles(rows: DataFrame, work, schema: str) -> DataFrame:
    """Applies ``work`` to the tiles of every bucket.

    ``rows`` is what ``sided`` returns, and more columns.  The members outside a
    bucket's largest component are its probes; a chunk of probes and a chunk of
    the bucket make a tile, so no piece of work sees more than two chunks, and
    members of the largest component are repeated once for a chunk of probes.
    """
    chunks, probes = (F.ceil(F.col(c) / _TILE).cast("int") for c in ("size", "n_outside"))
    spot = F.xxhash64("rep")
    place = lambda ti, tj, probe: F.struct(ti.cast("int").alias("ti"), tj.cast("int").alias("tj"), F.lit(probe).alias("probe"))
    as_member = F.transform(F.sequence(F.lit(0), probes - 1), lambda k: place(k, F.pmod(spot, chunks), False))
    as_probe = F.transform(F.sequence(F.lit(0), chunks - 1), lambda k: place(F.pmod(spot, probes), k, True))
    spread = rows.withColumn("place", F.explode(F.when(F.col("outside"), F.concat(as_member, as_probe)).otherwise(as_member)))
    spread = spread.select("*", "place.*").drop("place", "size", "n_outside", "outside")

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            cuts = _cuts(pdf)
            held = pdf[cuts[-1] :]
            made = [work(g) for g in _pieces(pdf[: cuts[-1]], cuts)]
            if made:
                yield _frame(made, schema)
        if held is not None and len(held) > 1:
            yield _frame([work(g) for g in _pieces(held, [0, len(held)])], schema)

    return spread.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj").mapInPandas(run, schema)


def split_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, rep, label, size, n_outside, outside) of the buckets that hold more than one component."""
    rows = members.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    rows = written(rows, "labelled")
    split = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return sided(written(rows.join(written(split, "split"), "key"), "split-rows"))


def _matches(g: dict[str, np.ndarray], least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, j, estimates) for every probe of a tile: its plausible partners in other components."""
    regs, label, n, probe = g["registers"], g["label"], g["n"], g["probe"].astype(bool)
    for i in np.flatnonzero(probe):
        j = np.flatnonzero(~probe & (label != label[i]))
        e = estimate(regs[i], regs[j])
        ok = possible(e, n[i], n[j], least)
        if ok.any():
            yield i, j[ok], e[ok]


def best_partners(buckets: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b): for each class its most similar one, by estimate, in another component of a bucket it is in."""

    def work(g: dict[str, np.ndarray]) -> tuple[list, ...]:
        rep = g["rep"]
        best = [(rep[i], rep[j[e.argmax()]], e.max()) for i, j, e in _matches(g, least)]
        return tuple(zip(*best)) or ([], [], [])

    rows = buckets.join(classes.select("rep", "n", "registers"), "rep")
    top = _in_tiles(rows, work, "x long, y long, e double").groupBy("x").agg(F.max_by("y", F.struct("e", "y")).alias("y"))
    return top.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def remaining_links(buckets: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, enough of them to join all that are linked.

    Buckets keep the classes that have a plausible partner in another component;
    their full sets meet in tiles, where all intersections are counted at once.
    """
    least = percent / 100

    def hopeful(g: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        on = np.zeros(len(g["rep"]), bool)
        for i, j, _ in _matches(g, least):
            on[i] = True
            on[j] = True
        return g["key"][on], g["rep"][on], g["label"][on]

    rows = buckets.join(classes.select("rep", "n", "registers"), "rep")
    rows = written(_in_tiles(rows, hopeful, "key long, rep long, label long").distinct(), "hopeful")
    sets = full_sets(docs, classes, rows.select("rep").distinct())

    def links(g: dict[str, np.ndarray]) -> tuple[list, ...]:
        return tuple(zip(*linked(g["rep"], g["label"], g["probe"].astype(bool), [np.frombuffer(x, np.uint64) for x in g["hashes"]], percent))) or ([], [])

    return written(_in_tiles(sided(rows).join(sets, "rep"), links, "a long, b long").distinct(), "links")


def linked(rep: np.ndarray, label: np.ndarray, probe: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between probes and sets of different labels, one for each two labels that they first join.

    A set of which too few elements are in any other is linked with none.  For the
    rest a block of shared elements at a time is a 0/1 matrix, whose products
    with itself add up to the sizes of all intersections.
    """
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts[place] > 1
    able = np.flatnonzero(100 * np.bincount(owner[common], minlength=len(n)) >= percent * n)
    values = np.unique(label[able])
    if len(values) < 2 or not probe[able].any():
        return []
    row = np.full(len(n), -1)
    row[able] = np.arange(len(able))
    at = common & (row[owner] >= 0)
    _, column = np.unique(place[at], return_inverse=True)
    line, own = row[owner[at]], np.flatnonzero(probe[able])
    both = np.zeros((len(own), len(able)), np.float32)
    order = np.argsort(column, kind="stable")
    line, column = line[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        i, j = np.searchsorted(column, [a, a + 8192])
        block = np.zeros((len(able), 8192), np.float32)
        block[line[i:j], column[i:j] - a] = 1
        both += block[own] @ block.T
    size, name = n[able], label[able]
    hit = (100 * both >= percent * (size[own][:, None] + size[None, :] - both)) & (name[own][:, None] != name[None, :])
    parent = {v: v for v in values.tolist()}

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for k, i in enumerate(own):
        js = np.flatnonzero(hit[k])
        for v, first in zip(*np.unique(name[js], return_index=True)):
            x, y = root(int(name[i])), root(int(v))
            if x != y:
                parent[x] = y
                out.append((int(rep[able[i]]), int(rep[able[js[first]]])))
    return out


# ---------------------------------------------------------------- the operator
def near_dedup(docs: DataFrame, *, percent: int = 75, row: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, row.

    ``component_id`` is the smallest doc_id reachable over links of at least
    ``percent`` hundredths Jaccard similarity; exactly one row of a component is
    kept, that with this id.  Null text is empty; texts without words are linked
    with nothing.  Repeated rows are copies of each other, null ids count as
    largest.  An empty table stays empty; extra columns are not read.  ``row``
    names a column of unique integers that tells rows apart, else one is made.

    Shingles are compared by 64-bit hashes, sets by 128-bit ones.
    """
    least = percent / 100
    small_batches(docs.sparkSession)
    rows = sketches(docs, row)
    first = rows.where("n > 0").groupBy("set_id").agg(F.min("row").alias("rep"))
    classes = written(rows.join(first.select("rep"), F.col("row") == F.col("rep"), "left_semi").select(F.col("row").alias("rep"), "doc_id", "n", "set_id", "registers"), "classes")
    bands = banded(classes)
    buckets = bands.groupBy("key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(bands.join(buckets, "key"), "members")
    shared = members.where("rep <> lead").groupBy("rep", "lead").agg(F.count(F.lit(1)).alias("n"))
    nearest = shared.groupBy("rep").agg(F.max(F.struct("n", (-F.col("lead")).alias("back"))).alias("best")).select((-F.col("best.back")).alias("a"), F.col("rep").alias("b"))
    pairs = written(plausible(nearest, classes, least), "pairs")
    links = confirmed(pairs, docs, classes, percent)
    buckets = split_buckets(members, links.select(F.col("b").alias("node"), F.col("a").alias("label")))
    near = written(best_partners(buckets, classes, least).join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = links.union(confirmed(near, docs, classes, percent))
    labels = components(links)
    rest = remaining_links(split_buckets(members, labels), docs, classes, percent)
    if not rest.isEmpty():
        labels = components(links.union(rest))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    best = rows.where("n > 0").groupBy("set_id").agg(F.min("row").alias("rep"), F.min(order).alias("best"))
    best = best.join(labels, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("label", "rep").alias("label"), "best")
    least_of = written(best.groupBy("label").agg(F.min("best").alias("least")), "least")
    named = best.join(least_of, "label").select("set_id", "least")
    out = rows.select("row", "doc_id", "n", "set_id").join(named, "set_id", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        F.coalesce(F.col("least.row") == F.col("row"), F.lit(True)).alias("kept"),
        "row",
    )


def without_near_duplicates(docs: DataFrame, *, max_broadcast: int = 500_000, **options) -> DataFrame:
    """``docs`` with one document of each group, all columns kept.

    Rows are told apart by a key of their own, written with them, so of repeated
    rows one stays, and null ids are no exception.  The keys that go are broadcast
    up to a checked number and shuffled beyond it.
    """
    key, gone = fresh(docs, "row_key", "gone_key")
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    out = written(near_dedup(keyed, row=key, **options).where("not kept").select(F.col("row").alias(gone)), "gone")
    out = F.broadcast(out) if out.count() <= max_broadcast else out
    return keyed.join(out, F.col(key) == F.col(gone), "left_anti").drop(key)


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
