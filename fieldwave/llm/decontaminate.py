"""Benchmark decontamination: a BM25 index of the test items, queried by every training passage.

The index holds the test items, the smaller side; training passages are the
queries, so texts are read once and never shuffled.  Item scores are divided by
the item's score for itself, so one threshold serves all items.  Retrieval is
block-max WAND and returns every item above the threshold; hits are then
verified on five-word shingles of question and answer, or of the whole item.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from math import fsum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, small_batches, use_table, written

_K1, _B = 1.2, 0.75
_BLOCK = 64  # postings that one block maximum covers
_UNIT = 64  # words of an item that are indexed as one; longer items are several units
_WINDOW = 2 * _UNIT  # words of a passage; passages begin every _UNIT words, so each unit fits in one
_N = 5  # words in a shingle
_LOW = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def leak_type(items: DataFrame) -> str:
    return f"struct<item_id:{items.schema['item_id'].dataType.simpleString()},bm25:double,question_overlap:double,answer_overlap:double>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and all that is not ASCII."""
    return (text or "").lower().encode().translate(_LOW).split()


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of question and answer: the answer is the last sentence, or the last third where that leaves a side under five words."""
    words = words_of(text)
    ends = [m.end() for m in re.finditer(r"[.?!](?=\s)|\n", text.strip())]
    if ends:
        n = len(words_of(text.strip()[ends[-1] :]))
        if n >= _N and len(words) - n >= _N:
            return words[: len(words) - n], words[len(words) - n :]
    n = min(max(_N, len(words) // 3), len(words))
    return words[: len(words) - n], words[len(words) - n :]


def shingles(words: list[bytes], n: int = _N) -> set[tuple[bytes, ...]]:
    """Runs of ``n`` words; fewer words are one run."""
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def units_of(text: str) -> list[list[bytes]]:
    """The words of an item, cut into what is indexed as one."""
    words = words_of(text)
    return [words[k : k + _UNIT] for k in range(0, len(words), _UNIT)]


@dataclass
class Statistics:
    """Of all test items, whichever block they are in: number of units, their mean length, and in how many units a word stands."""

    n: int
    mean: float
    df: dict[bytes, int]

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        units = [u for t in texts for u in units_of(t)]
        return cls(len(units), sum(map(len, units)) / len(units) if units else 1.0, Counter(w for u in units for w in set(u)))


@dataclass
class ItemIndex:
    """Inverted index of test items, with block maxima; scores use the ``statistics`` of all items, those of ``items`` where none are given."""

    items: list[tuple[int, str]]
    threshold: float = 0.5
    need: float = 0.2  # what an item's rarest terms must give before it is retrieved
    statistics: Statistics | None = None
    units: list[tuple[int, int]] = field(default_factory=list)  # (item, words)
    terms: dict[bytes, int] = field(default_factory=dict)
    postings: list[tuple[list[int], list[float], list[float], list[int], float]] = field(default_factory=list)

    def __post_init__(self):
        self.parts = [split_item(t) for _, t in self.items]
        texts = []
        for i, (_, t) in enumerate(self.items):
            cut = units_of(t)
            texts += cut
            self.units += [(i, sum(map(len, cut)))] * len(cut)
        known, self.statistics = self.statistics or Statistics.of([t for _, t in self.items]), None
        n, mean, df = known.n, known.mean, known.df
        lists: dict[bytes, list[tuple[int, float]]] = {}
        self.essential: dict[bytes, list[tuple[int, float]]] = {}
        for u, t in enumerate(texts):
            norm = _K1 * (1 - _B + _B * len(t) / mean)
            part = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (_K1 + 1) / (c + norm) for w, c in Counter(t).items()}
            whole, given = sum(part.values()), 0.0
            for w in sorted(part, key=lambda w: (-df[w], part[w], w)):
                share = part[w] / whole
                lists.setdefault(w, []).append((u, share))
                given += share
                if given > self.threshold - self.need:
                    self.essential.setdefault(w, []).append((u, share))
        for k, (w, posts) in enumerate(sorted(lists.items())):
            ids, shares = [p[0] for p in posts], [p[1] for p in posts]
            blocks = [max(shares[i : i + _BLOCK]) for i in range(0, len(ids), _BLOCK)]
            ends = [ids[min(i + _BLOCK, len(ids)) - 1] for i in range(0, len(ids), _BLOCK)]
            self.terms[w] = k
            self.postings.append((ids, shares, blocks, ends, max(blocks)))
        names = sorted(self.essential)
        self.rare = {w: k for k, w in enumerate(names)}
        self.first = np.cumsum([0, *(len(self.essential[w]) for w in names)])
        flat = [p for w in names for p in self.essential[w]]
        self.rare_units, self.rare_shares = np.array([p[0] for p in flat], np.int64), np.array([p[1] for p in flat])
        self.sets = [(shingles(q), shingles(a)) for q, a in self.parts]

    def promising(self, words: list[bytes]) -> np.ndarray:
        """Passages in which some item's rarest terms reach what it needs of them.

        An item's other terms give at most ``threshold - need``, so no item can
        pass the threshold in any other passage.
        """
        ids = np.fromiter(map(self.rare.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        last = max(0, -(-(len(words) - _WINDOW) // _UNIT))
        if not len(at):
            return at
        first = at // _UNIT
        window, hit = np.concatenate([first, first - 1, np.full(len(at), last)]), np.tile(ids[at], 3)
        fits = (window >= 0) & (window <= last)
        fits[2 * len(at) :] = at >= (last + 1) * _UNIT  # the last passage reaches the end
        window, hit = np.divmod(np.unique(window[fits] * len(self.rare) + hit[fits]), len(self.rare))
        n = self.first[hit + 1] - self.first[hit]
        place = np.repeat(self.first[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        keys, back = np.unique(np.repeat(window, n) * len(self.units) + self.rare_units[place], return_inverse=True)
        return np.unique(keys[np.bincount(back, self.rare_shares[place], len(keys)) >= self.need - 1e-9] // len(self.units))

    def wand(self, words: list[bytes]) -> list[tuple[int, float]]:
        """All (unit, score) with a score of at least the threshold, by block-max WAND."""
        least, found = self.threshold - 1e-9, []
        cursors = [[self.postings[k], 0, self.postings[k][0][0]] for k in {self.terms[w] for w in set(words) if w in self.terms}]
        while cursors:
            cursors.sort(key=lambda c: c[2])
            total = 0.0
            for pivot, c in enumerate(cursors):
                total += c[0][4]
                if total >= least:
                    break
            else:
                break
            unit = cursors[pivot][2]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][2] == unit:
                pivot += 1
            blocks = [min(bisect_left(c[0][3], unit), len(c[0][2]) - 1) for c in cursors[: pivot + 1]]
            if sum(c[0][2][b] for c, b in zip(cursors, blocks)) >= least:
                if cursors[0][2] == unit:
                    score = fsum(c[0][1][c[1]] for c in cursors[: pivot + 1])  # in whatever order
                    if score >= least:
                        found.append((unit, score))
                    moved, to = cursors[: pivot + 1], unit + 1
                else:
                    moved, to = [c for c in cursors[: pivot + 1] if c[2] < unit], unit
            else:
                to = min([c[0][3][b] + 1 for c, b in zip(cursors, blocks)] + [c[2] for c in cursors[pivot + 1 : pivot + 2]])
                moved, to = cursors[: pivot + 1], max(to, unit + 1)
            for c in moved:
                c[1] = bisect_left(c[0][0], to, c[1])
                c[2] = c[0][0][c[1]] if c[1] < len(c[0][0]) else -1
            cursors = [c for c in cursors if c[2] >= 0]
        return found

    def holds(self, item: int, near: set[tuple[bytes, ...]], whole: float) -> bool:
        """Whether ``near`` has that share of an item's shingles, those across its cut too."""
        s = shingles(sum(self.parts[item], []))
        return len(s & near) >= whole * len(s)

    def leaks(self, text: str | None, question: float, answer: float, whole: float) -> list[dict]:
        """Verified leaks of a text, one per item, ordered by item.

        The surroundings of an item's retrieved passages, as many words as the
        item has on both sides, are joined where they meet, so a long item is
        verified once per stretch of text.
        """
        if not self.units:
            return []
        words = words_of(text)
        found: dict[int, list[tuple[int, int, float]]] = {}
        for p in self.promising(words):
            start = int(p) * _UNIT
            end = min(start + _WINDOW, len(words))
            for unit, score in self.wand(words[start:end]):
                item, size = self.units[unit]
                begin, stop, of = max(0, start - size), end + size, found.setdefault(item, [])
                if of and begin <= of[-1][1]:
                    of[-1] = (of[-1][0], stop, max(score, of[-1][2]))
                else:
                    of.append((begin, stop, score))
        out = []
        for item in sorted(found):
            q, a = self.sets[item]
            size, best = sum(map(len, self.parts[item])), None
            for begin, stop, score in found[item]:
                near = shingles(words[begin:stop], min(size, _N))
                of_q, of_a = (len(s & near) / len(s) if s else 1.0 for s in (q, a))
                if (of_q >= question and of_a >= answer or self.holds(item, near, whole)) and (best is None or (of_q + of_a, score) > best):
                    best = (of_q + of_a, score)
                    got = {"item_id": self.items[item][0], "bm25": score, "question_overlap": of_q, "answer_overlap": of_a}
            if best is not None:
                out.append(got)
        return out


def item_statistics(items: DataFrame) -> tuple[Statistics, DataFrame]:
    """Statistics of all items without their words, and ``df(block, word, df)``: for the words of each block, in how many units of any block they stand.

    ``items(block, text)``.  Words are counted by Spark, once for all blocks.
    """

    def count(batches):
        for pdf in batches:
            rows = Counter()
            for block, text in zip(pdf["block"], pdf["text"]):
                for u in units_of(text):
                    rows.update((block, w) for w in set(u))
                    rows[block, None] += 1
                    rows[block, b""] += len(u)
            yield pd.DataFrame([(b, w, n) for (b, w), n in rows.items()], columns=["block", "word", "n"])

    counts = written(items.mapInPandas(count, "block long, word binary, n long").groupBy("block", "word").agg(F.sum("n").alias("n")), "words")
    every = written(counts.groupBy("word").agg(F.sum("n").alias("df")), "frequencies")
    sums = {r["word"]: r["df"] for r in every.where("word is null or word = X''").collect()}
    n = sums.get(None, 0)
    of = counts.where("word is not null and word <> X''").select("block", "word").join(every, "word")
    return Statistics(n, sums.get(b"", 0) / n if n else 1.0, {}), of


def item_blocks(items: DataFrame, max_chars: int) -> Iterator[tuple[list[tuple[object, str]], Statistics]]:
    """The test items in blocks of about ``max_chars`` characters, one at a time, with the statistics of all; each becomes one index of bounded size."""
    rows = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // max_chars)
    if not n:
        return
    rows = written(rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "items")
    known, df = item_statistics(rows)
    df = written(df, "df") if n > 1 else df
    for k in range(n):
        block = [(r.item_id, r.text) for r in rows.where(F.col("block") == k).orderBy("item_id", "text").collect()]
        yield block, Statistics(known.n, known.mean, {bytes(r["word"]): r["df"] for r in df.where(F.col("block") == k).collect()})


def _searcher(index, kind: str, question: float, answer: float, whole: float):
    def leaks(texts: pd.Series) -> pd.Series:
        use_table("")
        return pd.Series([index.value.leaks(t, question, answer, whole) for t in texts], dtype=object)

    return F.pandas_udf(leaks, f"array<{kind}>")


def mark_leaks(
    docs: DataFrame, items: DataFrame, *, threshold: float = 0.5, question: float = 0.75, answer: float = 0.5, whole: float = 0.75, max_chars: int = 3_500_000, name: str = "leaks", most: int = 500_000
) -> DataFrame:
    """``docs`` with an array of the test items that each text holds.

    A leak is an item whose BM25 share in some passage is at least ``threshold``
    and of whose five-word shingles at least ``question`` of the question's and
    ``answer`` of the answer's stand around that passage, or at least ``whole``
    of the whole item's, wherever its words were changed.  An item of fewer than
    five words is one shingle: it must stand there as it is.  Null or empty texts
    hold none and are no items; a null item_id is an id like others; items with
    the same id are told apart by text; rows are independent; an empty table on
    either side gives empty arrays or no rows.  A column called like the new one
    is replaced, all others pass through.

    Test sets of more than ``max_chars`` characters are indexed in blocks, one
    at a time: all passages query a block, its hits are written to the shared
    folder, and its index is released before the next one is made.  An index
    takes about 70 bytes a character in a worker, so the default holds it under 250 MB.
    Word frequencies and lengths are those of all items, so scores are the
    same however items fall into blocks.  Hits are broadcast up to ``most`` rows that have any.
    """
    spark, docs, kind = docs.sparkSession, docs.drop(name), leak_type(items)
    small_batches(spark)
    blocks = item_blocks(items, max_chars)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        return docs.withColumn(name, F.array().cast(f"array<{kind}>"))
    index = lambda b: spark.sparkContext.broadcast(ItemIndex(b[0], threshold, statistics=b[1]))
    if following is None:
        return docs.withColumn(name, _searcher(index(block), kind, question, answer, whole)("text"))
    key, hit = fresh(docs, "row_key", "hit_key")
    keyed, hits = written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), None
    while block is not None:
        sent = index(block)
        marked = keyed.select(F.col(key).alias(hit), F.explode(_searcher(sent, kind, question, answer, whole)("text")).alias("leak"))
        marked = written(marked, "hits")
        sent.destroy()
        hits = marked if hits is None else hits.unionByName(marked)
        block, following = following, next(blocks, None)
    by_row = written(hits.groupBy(hit).agg(F.array_sort(F.collect_list("leak")).alias(name)), "leaks")
    by_row = F.broadcast(by_row) if by_row.count() <= most else by_row
    return keyed.join(by_row, F.col(key) == F.col(hit), "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>"))).drop(key, hit)


def leak_pairs(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document and item: doc_id, item_id, bm25, question_overlap, answer_overlap."""
    marked = mark_leaks(docs.select("doc_id", "text"), items, **options)
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a test item."""
    (name,) = fresh(docs, "leaks")
    return mark_leaks(docs, items, name=name, **options).where(F.size(name) == 0).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leak_pairs(docs, items)
