"""Token ids in directly addressable codes.

An id is cut into chunks of eight bits, lowest first.  Level 0 holds the first
chunk of every token, level 1 the second chunk of the tokens that need one, and
so on; a bitmap per level says which of its tokens go on, and a rank directory
counts the set bits before every block of 512.  The chunk of token i on the next
level stands at rank(i), so any token is read without decoding its neighbours.

File: ``DAC1``, header, then per level chunks, bitmap and rank directory, then
the document directory (doc_id, known flag, first token) and the offsets.  Files
are numbered in ascending doc_id order and bounded in size.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import filesystem, partitions, pieces, settle, shared_dir, small_batches, use_table

MAGIC = b"DAC1"
_BLOCK = 512  # bits that one entry of a rank directory covers
_MANIFEST = "file string, part int, number int, n_docs long, n_tokens long"


# ---------------------------------------------------------------- the codes
def encode_ids(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels (chunks, bitmap, ranks) of unsigned ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> 8
        on = more > 0
        bits = np.packbits(on, bitorder="little")
        counts = np.add.reduceat(on, np.arange(0, len(on), _BLOCK), dtype=np.uint64) if len(on) else np.zeros(0, np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])
        levels.append(((rest & 255).astype(np.uint8), bits, ranks))
        if not on.any():
            return levels
        rest = more[on]


class TokenFile:
    """A file's bytes, addressed directly."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_tokens, n_levels = struct.unpack_from("<QQI", raw, 4)
        at, self.levels = 24, []
        sizes = struct.unpack_from(f"<{n_levels}Q", raw, at)
        at += 8 * n_levels
        for n in sizes:
            chunks = np.frombuffer(raw, np.uint8, n, at)
            bits = np.frombuffer(raw, np.uint8, -(-n // 8), at + n)
            at += n + len(bits)
            ranks = np.frombuffer(raw, "<u8", -(-n // _BLOCK) + 1, at)
            at += 8 * len(ranks)
            self.levels.append((chunks, bits, ranks))
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        self.known = np.frombuffer(raw, np.uint8, self.n_docs, at + 8 * self.n_docs).astype(bool)
        self.offsets = np.frombuffer(raw, "<u8", self.n_docs + 1, at + 9 * self.n_docs).astype(np.int64)

    def token(self, i: int) -> int:
        """Token ``i``, by one probe and one rank on each of its levels."""
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // _BLOCK
            first = block * _BLOCK >> 3
            ahead = np.unpackbits(bits[first : (i >> 3) + 1], bitorder="little")[: i - block * _BLOCK]
            i = int(ranks[block]) + int(ahead.sum())
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Tokens of a range: each level is a range too, found by the rank of its ends."""
        out, where = np.zeros(stop - start, np.uint32), slice(None)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * k)
            on = np.unpackbits(bits[start >> 3 : -(-stop // 8)], bitorder="little")[start & 7 :][: stop - start].astype(bool)
            if not on.any():
                break
            block = start // _BLOCK
            ahead = np.unpackbits(bits[block * _BLOCK >> 3 : (start >> 3) + 1], bitorder="little")[: start - block * _BLOCK]
            start = int(ranks[block]) + int(ahead.sum())
            stop = start + int(on.sum())
            where = np.flatnonzero(on) if k == 0 else where[on]
        return out


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    levels = encode_ids(ids)
    parts = [MAGIC, struct.pack("<QQI", len(doc_ids), len(ids), len(levels)), struct.pack(f"<{len(levels)}Q", *(len(x[0]) for x in levels))]
    for chunks, bits, ranks in levels:
        parts += [chunks.tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
    parts += [np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes()]
    return b"".join([*parts, np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()])


# ---------------------------------------------------------------- tokenizing
#: The normalizer and the split of vocabularies that drop white space and never join across it: fixed values.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"  # ASCII punctuation that may end a word; no apostrophe, and nothing that added tokens begin or end with
_ODD = re.compile("[^\x00-\u012f\u0131-\u024f]")  # all but Latin letters that are lower-cased alike everywhere and need no composing


def by_words(tokenizer) -> bool:
    """Whether a text's ids are its words' ids in a row."""
    kind = json.loads(tokenizer.to_str())
    split = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    before = (kind["pre_tokenizer"] or {}).get("pretokenizers", [])
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and t["content"].isascii() and " " not in t["content"] and "\n" not in t["content"] for t in kind["added_tokens"])
    return bool(plain and (kind["normalizer"] or {}).get("normalizers") == _NORMALIZERS and before[:1] == [split] and len(before) == 2 and before[1]["type"] == "ByteLevel" and not before[1]["use_regex"] and kind["model"].get("end_of_word_suffix"))


class WordEncoder:
    """Encodes whole texts with the tokenizers library, each different word once.

    Where a vocabulary drops white space and never joins across it (``by_words``),
    a text's ids are its words' ids in a row; words are cut at spaces and line
    feeds only, and the library sees all else.  Texts are looked up in lower case,
    as the vocabulary lower-cases, unless that would make an added token, as these
    are matched with case.  New words of letters alone reach the library many at
    once, without its normalizer and pattern, which would leave them as they are;
    their ids are told apart by the token that ends a word.  All other new words
    go through the whole of it.  Other vocabularies get whole texts.

    About ``most`` words of at most 200 characters are remembered, in two
    generations: words that still occur move to the younger one, the older one is
    forgotten when the younger is full, and what was forgotten is encoded again.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.kind = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.by_words = by_words(self.tokenizer)
        if self.by_words:
            self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.letters = Tokenizer.from_file(path)
            self.letters.normalizer = normalizers.Sequence([])
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for w, i in vocab.items() if w.endswith(suffix)]] = True

    def _encode_letters(self, words: list[str]) -> None:
        """Ids of words of letters alone, lower-cased: each ends with the token that ends a word."""
        blocks = [words[a : a + 2000] for a in range(0, len(words), 2000)]
        for part, e in zip(blocks, self.letters.encode_batch_fast([" ".join(b) for b in blocks], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            ends, raw = ((np.flatnonzero(self.last[ids]) + 1) * self.kind.itemsize).tolist(), ids.tobytes()
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not end its words")
            start = 0
            for w, end in zip(part, ends):
                self.words[w] = raw[start:end]
                start = end

    def _encode_any(self, words: list[str]) -> None:
        """Ids of words, many in one call; tokens are told apart by where their text stands."""
        short = [w for w in words if len(w) <= 200]
        for a in range(0, len(short), 2000):
            part = short[a : a + 2000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.cumsum([0, *(len(w) + 1 for w in part)])
            cuts = np.searchsorted(np.array([x[0] for x in e.offsets], np.int64), begins)
            ids = np.array(e.ids, self.kind)
            for w, i, j in zip(part, cuts, cuts[1:]):
                self.words[w] = ids[i:j].tobytes()
        for w in words:
            if len(w) > 200:
                self.words[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, self.kind).tobytes()

    def _unknown(self, words: set[str]) -> list[str]:
        """Those of ``words`` that are not remembered; the others are in the younger generation afterwards."""
        out, old = [], self.old
        for w in words.difference(self.words):
            ids = old.get(w)
            if ids is None:
                out.append(w)
            else:
                self.words[w] = ids
        return out

    def _cut(self, text: str | None) -> list[str]:
        text = text or ""
        if not _ODD.search(text):
            low = text.lower()
            if not any(t in low for t in self.added):
                text = low
        return text.replace("\n", " ").split(" ")

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned integers of ``kind``."""
        if not self.by_words:
            made = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, self.kind).tobytes() for e in made]
        split = [self._cut(t) for t in texts]
        if len(self.words) > self.most // 2:
            self.old, self.words = self.words, {}
        self.words[""] = b""
        parts, other, long = [], [], []
        for w in self._unknown(set().union(*split)):
            core = w.rstrip(_TAIL)
            if len(w) > 200:
                long += [w, core.lower(), w[len(core) :]]
            if core.isalpha() and (core.isascii() or not _ODD.search(core)):
                parts.append((w, core.lower(), w[len(core) :]))
            else:
                other.append(w)
        self._encode_letters(self._unknown({c for _, c, _ in parts}))
        self._encode_any([*other, *self._unknown({t for _, _, t in parts})])
        for w, core, tail in parts:
            if tail or core is not w:
                self.words[w] = self.words[core] + self.words[tail]
        out = [b"".join(map(self.words.__getitem__, words)) for words in split]
        for w in long:
            self.words.pop(w, None)
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker: what it remembers serves its later tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- the operator
def write_tokens(docs: DataFrame, tokenizer: str, *, end_id: int = 1, file_tokens: int = 8_000_000) -> DataFrame:
    """Tokenizes ``docs(doc_id, text)`` into files; returns their manifest with ``base``, the tokens in all earlier files.

    Documents are range-partitioned by doc_id (null first; repeated rows all
    stand, ordered by the first 64 characters of their text, then a hash of it, so
    that a null or repeated id is spread over ranges too); a task fills files of
    about ``file_tokens`` tokens.  A document is never cut, so a file holds at
    least one, however long.  A file is written under its attempt's name and
    renamed when whole, so lost tasks are simply run again.  Null text is empty
    and has the end id only; an empty table has no files; extra columns are not
    read.
    """
    spark, target = docs.sparkSession, shared_dir(docs.sparkSession, "tokens")
    small_batches(spark)
    order = ["doc_id", "head", "tie", "row"]
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string"), "text")  # ids reach pandas as text, whole

    def write(batches):
        use_table("tokens", _encoders.clear)
        task, enc = TaskContext.get(), encoder(tokenizer)
        fs, root = filesystem(target)
        fs.create_dir(root, recursive=True)
        end, number, made = np.array([end_id], enc.kind).tobytes(), 0, []
        ids, lengths, held, total = [], [], [], 0

        def close():
            nonlocal number, total
            name = f"part-{task.partitionId():05d}-{number:04d}.dac"
            temp = f"{root}/.{name}.{task.taskAttemptId()}"
            with fs.open_output_stream(temp, compression=None) as fh:
                fh.write(pack_file(ids, lengths, np.frombuffer(b"".join(held), enc.kind)))
            settle(fs, temp, f"{root}/{name}")
            made.append((f"{target}/{name}", task.partitionId(), number, len(ids), total))
            number, total = number + 1, 0
            for x in (ids, lengths, held):
                x.clear()

        for pdf in batches:
            texts, rows = pdf["text"].tolist(), pdf["doc_id"].tolist()
            for a, b in pieces([len(t or "") for t in texts], 1_000_000):
                for doc_id, raw in zip(rows[a:b], enc.batch(texts[a:b])):
                    ids.append(None if doc_id is None else int(doc_id))
                    held += [raw, end]
                    lengths.append(len(raw) // enc.kind.itemsize + 1)
                    total += lengths[-1]
                    if total >= file_tokens:
                        close()
        if ids:
            close()
        yield pd.DataFrame(made, columns=["file", "part", "number", "n_docs", "n_tokens"])

    manifest = shared_dir(spark, "token-manifest")
    ranged.mapInPandas(write, _MANIFEST).write.parquet(manifest)
    files = spark.read.schema(_MANIFEST).parquet(manifest)
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(W.orderBy("part")).alias("ahead"))  # one row per task that wrote
    return files.join(F.broadcast(parts), "part").withColumn("base", F.col("ahead") + before(W.partitionBy("part").orderBy("number"))).drop("ahead")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers)."""

    def read(batches) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, base in zip(pdf["file"], pdf["base"]):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as fh:
                    f = TokenFile(fh.read())
                for a in range(0, f.n_docs, 500):
                    cuts = f.offsets[a : a + 501]
                    block = f.tokens(int(cuts[0]), int(cuts[-1])).astype("<u4")
                    ids = [block[i - cuts[0] : j - cuts[0]].tobytes() for i, j in zip(cuts, cuts[1:])]
                    doc = pd.Series(f.doc_ids[a : a + 500], dtype="Int64").where(f.known[a : a + 500], pd.NA)
                    yield pd.DataFrame({"doc_id": doc, "start": base + cuts[:-1], "n_tokens": np.diff(cuts), "ids": ids})

    n = max(1, partitions(manifest.sparkSession))
    return manifest.select("file", "base").repartition(n, "file").mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the files, reads them back, and returns doc_id, start, n_tokens, ids_crc32."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    back = read_tokens(write_tokens(docs, tokenizer))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
