"""WARC files with a Zstandard dictionary of their own records.

A file begins with a skippable frame that holds the dictionary; every record
follows as a frame of its own, compressed with it, so any record can be read by
its offset.  The dictionary is trained on a bounded sample of the records.
Records with equal, long payloads are stored once; the others refer to it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, settle, shared_dir, written

#: Skippable frame that holds a dictionary (WARC Zstandard format): a fixed value.
DICT_FRAME = 0x184D2A5D
_URN = uuid.UUID("5b0f1a52-6d0a-4a8f-9a43-2f4f5e3f3c11")
_INDEX = "page_id long, file string, offset long, length long"


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_URN, name)}>"


def payload_name(sha: bytes, n: int) -> str:
    """What names the one response that revisits of a payload refer to."""
    return f"payload:{bytes(sha).hex()}:{n}"


def record(page_id, url, payload: bytes, refers_to=None, *, revisit: bool = False, name: str | None = None, refers_name: str | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit has no payload but names its digest and the record it refers to.

    Records with different ``name`` have different ids; without, page_id is the
    name.  ``refers_name`` is the name of the record that is referred to.
    """
    sha = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(str(page_id) if name is None else name)}", f"WARC-Date: {date}"]
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head += [f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{sha}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        refers = str(refers_to) if refers_name is None else refers_name
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers)}", f"X-Refers-To-Page-Id: {refers_to}"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of an uncompressed stream, one at a time."""
    held = b""
    while True:
        while (cut := held.find(b"\r\n\r\n")) < 0:
            more = stream.read(1 << 16)
            if not more:
                if held.strip():
                    raise ValueError("a record ends early")
                return
            held += more
        head = dict(x.split(": ", 1) for x in held[:cut].decode().split("\r\n")[1:])
        need, parts, have = int(head["Content-Length"]) + 4, [held[cut + 4 :]], len(held) - cut - 4
        while have < need:
            more = stream.read(max(1 << 16, need - have))
            if not more:
                raise ValueError("a record ends early")
            parts.append(more)
            have += len(more)
        rest = b"".join(parts)
        held = rest[need:]
        yield head, rest[: need - 4]


def open_warc(fh):
    """An uncompressed stream of a file that begins with its dictionary."""
    magic, size = struct.unpack("<II", fh.read(8))
    if magic != DICT_FRAME:
        raise ValueError("no dictionary frame")
    raw = fh.read(size)
    known = zstandard.ZstdCompressionDict(raw) if raw else None
    return zstandard.ZstdDecompressor(dict_data=known).stream_reader(fh, read_across_frames=True)


def train_dictionary(pages: DataFrame, *, size: int = 65_536, max_records: int = 1000, max_chars: int = 4096) -> bytes:
    """A dictionary from records of at most ``max_records`` pages (by hash of page_id).

    Ids are chosen first and only their records are fetched.  Both bounds fix
    what the driver gets: ``2 * max_records * max_chars`` characters (repeated ids).
    Only this sample is cut; records are archived whole.  Too few pages to train
    on give no dictionary (b"").
    """
    ids = pages.select("page_id").where("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(max_records)
    rows = pages.join(F.broadcast(ids.distinct()), "page_id")  # at most max_records ids
    taken = rows.select("page_id", "url", F.substring(F.coalesce("html", F.lit("")), 1, max_chars).alias("html"))
    taken = taken.orderBy(F.xxhash64("page_id", "url", "html"), "page_id", "url", "html").limit(2 * max_records).collect()
    taken.sort(key=lambda r: (r.page_id, r.url or "", r.html))
    samples = [record(r.page_id, r.url, r.html.encode()) for r in taken]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def payload_key(html: Column, min_bytes: int) -> Column:
    """What equal, long payloads share: SHA-256 and length; null for payloads under ``min_bytes``."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    n = F.octet_length(body)
    return F.when(n >= min_bytes, F.struct(F.unhex(F.sha2(body, 256)).alias("sha"), n.alias("n")))


def _broadcast_up_to(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """``df``, broadcast where it has at most ``most`` rows, and whether it is."""
    few = df.count() <= most
    return (F.broadcast(df) if few else df), few


def told_apart(keys: DataFrame, *, most: int = 500_000, salts: int = 32) -> DataFrame:
    """(row, page_id, refers_to, payload) of ``keys(row, page_id, payload)``: of the rows that refer to another, and of those that are referred to (refers_to null).

    Of equal, long payloads the largest page_id holds it; where several rows have that
    page_id one of them is referred to.  Null ids count as smallest, and can't be
    referred to.  Payloads that are held more than once are broadcast up to
    ``most`` of them; beyond, they meet the rows by shuffle, each dealt over ``salts`` parts, so a hot
    payload is never one task's.
    """
    known = keys.where("payload is not null")
    best = known.groupBy("payload").agg(F.max(F.struct("page_id", "row")).alias("best"), F.min("page_id").alias("least"), F.count_if(F.col("page_id").isNull()).alias("nameless"))
    best = best.where("least < best.page_id or nameless > 0 and best.page_id is not null")
    best = written(best.select("payload", F.col("best.page_id").alias("holder"), F.col("best.row").alias("at")), "payloads")
    side, few = _broadcast_up_to(best, most)
    if few:
        met = known.join(side, "payload")
    else:
        side = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = known.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(side, ["payload", "salt"])
    other = F.col("page_id").isNull() | (F.col("page_id") < F.col("holder"))
    return met.where(other | (F.col("row") == F.col("at"))).select("row", "page_id", F.when(other, F.col("holder")).alias("refers_to"), "payload")


def write_warc(pages: DataFrame, *, min_bytes: int = 1000, level: int = 3, file_bytes: int = 64 << 20, most: int = 500_000, **training) -> DataFrame:
    """Archives ``pages(page_id, url, html)``; returns the index (page_id, file, offset, length), itself a table in the shared folder.

    Pages are written once with a key of their row; only digests are compared, and
    where few rows refer to others (up to ``most``) pages are archived where
    they stand, else dealt by row, so neither a hot payload nor pages without an
    id meet in one task.  A task writes its records in page_id order to files of
    about ``file_bytes``, under a name of its own attempt first, renamed when
    whole: a lost task leaves nothing half-written, and a second attempt writes the
    same bytes.  Null html is an empty payload; a null page_id counts as smallest,
    so it revisits any other that has its payload; rows that repeat a page_id are
    records of their own, each with an id of its own and judged by its own
    payload; equal rows that hold the payload are responses all, one of them
    referred to; extra columns are not archived; an empty table gives an empty
    index.
    """
    spark = pages.sparkSession
    raw, target = train_dictionary(pages, **training), shared_dir(spark, "warc")
    keyed = written(pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("row")), "pages")
    told = written(told_apart(keyed.select("row", "page_id", payload_key(F.col("html"), min_bytes).alias("payload")), most=most).select("row", "refers_to", "payload"), "told")
    side, _ = _broadcast_up_to(told, most)
    rows = keyed.join(side, "row", "left").sortWithinPartitions("page_id", "url", "html", "row")
    rows = rows.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"), F.col("row").cast("string"), F.col("payload.sha").alias("sha"), F.col("payload.n").cast("string").alias("n"))  # ids reach pandas as text, whole

    def write(batches):
        task = TaskContext.get()
        fs, root = filesystem(target)
        fs.create_dir(root, recursive=True)
        known = zstandard.ZstdCompressionDict(raw) if raw else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
        out, n, index = None, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                settle(fs, temp, f"{root}/{name}")
                out = None

        for pdf in batches:
            for page_id, url, html, refers, row, sha, size in pdf[["page_id", "url", "html", "refers_to", "row", "sha", "n"]].itertuples(index=False, name=None):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{n:04d}.warc.zst"
                    temp = f"{root}/.{name}.{task.taskAttemptId()}"
                    out, at, n = fs.open_output_stream(temp, compression=None), 8 + len(raw), n + 1
                    out.write(struct.pack("<II", DICT_FRAME, len(raw)) + raw)
                shared = None if sha is None else payload_name(sha, int(size))
                own = shared if shared and refers is None else f"page:{page_id}:{row}"
                frame = packer.compress(record(page_id, url, (html or "").encode(), refers, revisit=refers is not None, name=own, refers_name=shared))
                out.write(frame)
                index.append((None if page_id is None else int(page_id), f"{target}/{name}", at, len(frame)))
                at += len(frame)
                if at >= file_bytes:
                    close()
            yield _frame(index, ["page_id", "file", "offset", "length"])
            index = []
        close()

    index = shared_dir(spark, "warc-index")
    rows.mapInPandas(write, _INDEX).write.parquet(index)
    return spark.read.schema(_INDEX).parquet(index)


def read_warc(index: DataFrame) -> DataFrame:
    """The records of the files that ``index`` names, one row each, read whole from the files.

    Columns: page_id, url, record_type, refers_to, payload_bytes (of the full
    payload), payload_digest (SHA-1, hex), body, record_id, refers_id.  Digests of responses are
    recomputed from the body and checked against the header.
    """
    files = index.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file")

    def read(batches):
        for pdf in batches:
            for file in pdf["file"]:
                fs, path = filesystem(file)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as fh:
                    for head, body in read_records(open_warc(fh)):
                        kind, sha = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(body, usedforsecurity=False).hexdigest() != sha:
                            raise ValueError(f"{head['WARC-Record-ID']} in {file} is damaged")
                        page, to = head["X-Page-Id"], head.get("X-Refers-To-Page-Id")
                        rows.append((int(page) if page else None, head["WARC-Target-URI"], kind, int(to) if to else None, int(head["X-Payload-Length"]), sha, body, head["WARC-Record-ID"], head.get("WARC-Refers-To")))
                        held += len(body)
                        if held > 8 << 20:
                            yield _frame(rows, _READ)
                            rows, held = [], 0
                yield _frame(rows, _READ)

    n = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "file").mapInPandas(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, body binary, record_id string, refers_id string")


_READ = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "body", "record_id", "refers_id"]


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows as a frame; nullable ids stay integers."""
    return pd.DataFrame({n: pd.array([r[k] for r in rows], dtype="Int64") if n in ("page_id", "refers_to") else [r[k] for r in rows] for k, n in enumerate(names)})


def query(spark, sf_dir: str) -> DataFrame:
    back = read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND coalesce(page_id < best, best IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND coalesce(page_id < best, best IS NOT NULL) THEN best END AS refers_to
FROM r
"""
