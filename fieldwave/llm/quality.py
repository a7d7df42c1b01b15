"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded from its words, pairs
of neighbouring words and character trigrams, hashed into embeddings that are
learned, and from rates of character classes; a gated attention network weighs
the passages of a document; the weighted sum of their encodings is scored.  Only
documents carry labels, so embeddings, encoder, attention and score are learned
together from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pieces, small_batches, use_table

_PASSAGE = 512  # bytes, up to the next space
_BUCKETS, _WIDTH = (1 << 15, 1 << 15, 1 << 14), 4  # of the embeddings of words, word pairs and trigrams
_MEMO = 200_000  # word hashes that a worker remembers
_memo: dict[bytes, int] = {}
_GROUPS = [b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b";:", b"'\"", b"()[]{}", b"-_", b"#", b"$", b"%", b"&", b"*", b"@", b"/\\", b"|", b"<>=+~^`"]
_LOWER, _UPPER, _DIGIT, _LEAD, _NEXT, _CONTROL = range(len(_GROUPS), len(_GROUPS) + 6)
_CLASSES = len(_GROUPS) + 6
N_FEATURES = _CLASSES + 7


def _classes() -> np.ndarray:
    table = np.full(256, _CONTROL, np.uint8)
    table[128:192], table[192:] = _NEXT, _LEAD
    for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT)):
        table[list(chars)] = k
    for k, chars in enumerate(_GROUPS):
        table[list(chars)] = k
    return table


_TABLE = _classes()


def passages(raw: bytes) -> list[int]:
    """Ends of a text's passages; an empty text is one empty passage."""
    ends, n = [], len(raw)
    while (at := (ends[-1] if ends else 0) + _PASSAGE) < n:
        cut = raw.find(b" ", at, at + _PASSAGE // 2)
        ends.append(cut if cut >= 0 else at)
    return [*ends, n]


@dataclass
class Bags:
    """Passages of texts, one after the other: rates, hashed tokens of each kind with their number in each passage, passages of each text."""

    x: np.ndarray
    tokens: list[tuple[np.ndarray, np.ndarray]]
    sizes: np.ndarray
    begins: list[np.ndarray] = field(init=False)

    def __post_init__(self):
        self.begins = [np.concatenate([[0], np.cumsum(c)]) for c in (self.sizes, *(n for _, n in self.tokens))]

    def take(self, at: np.ndarray) -> Bags:
        """The bags at these places."""
        rows = _runs(self.begins[0], at)
        return Bags(self.x[rows], [(ids[_runs(begins, rows)], n[rows]) for (ids, n), begins in zip(self.tokens, self.begins[1:])], self.sizes[at])


def _runs(begins: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the elements of some runs."""
    n = begins[at + 1] - begins[at]
    return np.repeat(begins[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else np.zeros(0, np.int64)


def _mixed(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(12))) & np.uint32(buckets - 1)).astype(np.int32)


def featurize(texts: list[str | None]) -> Bags:
    """Whole texts as bags: square roots of character class rates, word statistics, and hashed tokens."""
    raws = [(t or "").encode() for t in texts]
    cuts = [passages(r) for r in raws]
    sizes = np.concatenate([np.diff([0, *c]) for c in cuts]).astype(np.int64) if raws else np.zeros(0, np.int64)
    n = len(sizes)
    chars = np.frombuffer(b"".join(raws), np.uint8)
    kinds = _TABLE[chars].astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    counts = np.bincount(owner * _CLASSES + kinds, minlength=n * _CLASSES).reshape(n, _CLASSES)
    shouts = np.bincount(owner[1:], (kinds[1:] == _UPPER) & (kinds[:-1] == _UPPER), n) if len(kinds) else np.zeros(n)
    words, hashes = np.zeros((n, 5)), []
    if len(_memo) > _MEMO:
        _memo.clear()
    i = 0
    for raw, ends in zip(raws, cuts):
        for a, b in zip([0, *ends], ends):
            w = raw[a:b].split()
            if w:
                different = set(w)
                for x in different.difference(_memo):
                    _memo[x] = xxhash.xxh32_intdigest(x)
                hashes += map(_memo.__getitem__, w)
                top = max(map(w.count, different)) if len(different) * 4 < len(w) else 0
                words[i] = len(w), len(different) / len(w), top / len(w), sum(map(len, w)) / len(w), len(set(map(len, w)))
            i += 1
    length = np.maximum(sizes, 1)[:, None]
    x = np.hstack([np.sqrt(counts / length), np.sqrt(shouts[:, None] / length), words[:, :1] / length, words[:, 1:3], words[:, 3:4] / 10, words[:, 4:] / 10, (sizes == 0)[:, None]])
    h, n_words = np.array(hashes, np.uint32), words[:, 0].astype(np.int64)
    of = np.repeat(np.arange(n), n_words)
    inside = of[1:] == of[:-1]
    three = (owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, bool)
    grams = chars[:-2].astype(np.uint32) | chars[1:-1].astype(np.uint32) << np.uint32(8) | chars[2:].astype(np.uint32) << np.uint32(16) if len(three) else np.zeros(0, np.uint32)
    tokens = [
        (_mixed(h, _BUCKETS[0]), n_words),
        (_mixed((h[:-1] * np.uint32(0x9E3779B1) + h[1:])[inside], _BUCKETS[1]), np.maximum(n_words - 1, 0)),
        (_mixed((grams * np.uint32(0x85EBCA77))[three], _BUCKETS[2]), np.maximum(sizes - 2, 0)),
    ]
    return Bags(x.astype(np.float32), tokens, np.array([len(c) for c in cuts], np.int64))


def featurize_all(texts: list[str | None], most: int = 300_000) -> Bags:
    """The same for many texts, about ``most`` characters at a time, so that only the result is held whole."""
    parts = [featurize(texts[a:b]) for a, b in pieces([len(t or "") for t in texts], most)] or [featurize([])]
    tokens = [(np.concatenate([p.tokens[k][0] for p in parts]), np.concatenate([p.tokens[k][1] for p in parts])) for k in range(len(_BUCKETS))]
    return Bags(np.concatenate([p.x for p in parts]), tokens, np.concatenate([p.sizes for p in parts]))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionMil:
    """The trained model; its size is fixed: some 330,000 numbers, nearly all of them embeddings."""

    weights: dict[str, np.ndarray]

    def encode(self, bags: Bags) -> np.ndarray:
        """A row per passage: scaled rates, then the mean embedding of each kind of token."""
        out = [(bags.x - self.weights["mean"]) / self.weights["std"]]
        for k, (ids, n) in enumerate(bags.tokens):
            mean, some = np.zeros((len(n), _WIDTH), np.float32), np.flatnonzero(n)
            if len(some):
                for j, line in enumerate(self.weights[f"E{k}"]):
                    mean[some, j] = np.add.reduceat(line[ids], bags.begins[k + 1][some]) / n[some]
            out.append(mean)
        return np.hstack(out)

    def forward(self, bags: Bags) -> tuple[np.ndarray, dict]:
        """Logits of the bags."""
        p, sizes = self.weights, bags.sizes
        starts, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(sizes)), sizes)
        xs = self.encode(bags)
        h = np.tanh(xs @ p["We"] + p["be"])
        t, s = np.tanh(h @ p["Wt"]), _sigmoid(h @ p["Ws"])
        e = (t * s) @ p["wa"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts)
        return z @ p["wo"] + p["bo"], {"xs": xs, "h": h, "t": t, "s": s, "a": a, "z": z, "owner": owner, "starts": starts}

    def score(self, bags: Bags) -> np.ndarray:
        return _sigmoid(self.forward(bags)[0]) if len(bags.sizes) else np.zeros(0)

    def gradients(self, bags: Bags, y) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        p = self.weights
        logit, c = self.forward(bags)
        d = (_sigmoid(logit) - y) / len(y)
        dz = d[:, None] * p["wo"]
        da = (c["h"] * dz[c["owner"]]).sum(1)
        de = c["a"] * (da - np.add.reduceat(c["a"] * da, c["starts"])[c["owner"]])
        dts = de[:, None] * p["wa"]
        dt, ds = dts * c["s"] * (1 - c["t"] ** 2), dts * c["t"] * c["s"] * (1 - c["s"])
        dh = c["a"][:, None] * dz[c["owner"]] + dt @ p["Wt"].T + ds @ p["Ws"].T
        dpre = dh * (1 - c["h"] ** 2)
        out = {"wo": c["z"].T @ d, "bo": d.sum(), "wa": (c["t"] * c["s"]).T @ de, "Wt": c["h"].T @ dt, "Ws": c["h"].T @ ds, "We": c["xs"].T @ dpre, "be": dpre.sum(0)}
        dx = dpre @ p["We"].T
        for k, (ids, n) in enumerate(bags.tokens):
            at = N_FEATURES + k * _WIDTH
            part = (dx[:, at : at + _WIDTH] / np.maximum(n, 1)[:, None]).T
            out[f"E{k}"] = np.stack([np.bincount(ids, np.repeat(line, n), _BUCKETS[k]) for line in part])
        return out


def fit(bags: Bags, y: np.ndarray, *, hidden: int = 24, gate: int = 12, epochs: int = 8, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> AttentionMil:
    """Adam on mini-batches of bags.  With one class only, a constant model.

    Embeddings begin at zero, so that tokens never seen in training say nothing.
    """
    rng, x = np.random.default_rng(seed), bags.x
    p = {"mean": x.mean(0) if len(x) else np.zeros(N_FEATURES), "std": x.std(0) + 0.02 if len(x) else np.ones(N_FEATURES)}
    p |= {f"E{k}": np.zeros((_WIDTH, n), np.float32) for k, n in enumerate(_BUCKETS)}
    for name, shape in (("We", (N_FEATURES + len(_BUCKETS) * _WIDTH, hidden)), ("Wt", (hidden, gate)), ("Ws", (hidden, gate))):
        p[name] = rng.normal(0, shape[0] ** -0.5, shape)
    share = (y.sum() + 1) / (len(y) + 1)
    p |= {"be": np.zeros(hidden), "wa": rng.normal(0, gate**-0.5, gate), "wo": np.zeros(hidden), "bo": np.array(np.log(share / max(1 - share, 1e-3)))}
    model = AttentionMil(p)
    if not 0 < y.sum() < len(y):
        return model
    m, v, step = {}, {}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            at = order[k : k + batch]
            step += 1
            pace = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for name, g in model.gradients(bags.take(at), y[at]).items():
                g = np.asarray(g + decay * p[name] * (name[0] in "WE"), np.float32 if name[0] == "E" else float)
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                p[name] = p[name] - pace * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, max_bytes: int = 6_000_000, **fitting) -> AttentionMil:
    """Fits on labelled documents, none of them held out, of about ``max_bytes`` together.

    Where there is more, documents are chosen by hash of doc_id, so that their
    expected size together is the bound: it fixes what the driver gets.  A chosen
    document is used whole.  Labels that contradict each other count as good.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 64  # so that the number of documents is bounded too
    total = docs.select("doc_id", size.alias("n")).join(known.select("doc_id"), "doc_id").agg(F.sum("n")).first()[0] or 0
    steps = 1 << 30
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < int(min(1, max_bytes / max(total, 1)) * steps))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_bytes / 64 labels, expected
    got = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("quality").cast("double")).toPandas().sort_values(["doc_id", "text"], kind="stable")
    bags, y = featurize_all(got["text"].tolist()), got["quality"].to_numpy(float)
    del got
    _memo.clear()
    model = fit(bags, y, **fitting)
    return model


def score_documents(docs: DataFrame, model: AttentionMil, *, name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of its whole text.

    Null text is empty; empty texts have a score too.  Every column passes
    through, one called like the score is replaced; rows are independent, so
    ties and repeats score alike.
    """
    docs = docs.drop(name)
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        use_table("quality", _memo.clear)
        for part in parts:
            out = []
            texts, size = [], 0
            for t in [*part, None]:
                texts.append(t)
                size += len(t or "")
                if size > 1_000_000 or len(texts) >= 500:
                    out.append(known.value.score(featurize(texts)))
                    texts, size = [], 0
            if texts:
                out.append(known.value.score(featurize(texts)))
            yield pd.Series(np.concatenate(out)[: len(part)])

    return docs.withColumn(name, scored(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, **training) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 from 0.5 on).

    Without labels of both kinds every document gets the same score.  An empty
    table stays empty.
    """
    scored = score_documents(docs.drop("held_out", "predicted"), train(docs, labels, **training))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels).select("doc_id", "held_out", "score", "predicted")
