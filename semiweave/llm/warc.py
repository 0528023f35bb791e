"""WARC archives: a deterministic sharded writer, and a reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh_path, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Cells that a range of ids is cut into when shards are cut.
CELLS = 4096
#: Writer tasks at most; beyond it a task writes several shards.
MAX_TASKS = 50_000
MANIFEST = T.StructType([T.StructField("file", T.StringType()), T.StructField("shard", T.LongType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("file_digest", T.StringType())])
RECORDS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType())])


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(kind: str, identity: str, headers: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    """One gzip member. Same arguments give the same bytes: gzip carries no time."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, identity)}>"), ("WARC-Date", date), *headers]
    head += [("WARC-Block-Digest", f"sha1:{b32(hashlib.sha1(block).digest())}"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class _Roll:
    """Files of one shard, rolled by compressed size, each renamed when whole."""

    def __init__(self, root: str, shard: int, file_bytes: int, date: str):
        self.store, self.root = fs.FileSystem.from_uri(root)
        self.shard, self.limit, self.date, self.seq, self.out = shard, file_bytes, date, 0, None
        self.done: list[tuple] = []

    def add(self, record: bytes) -> None:
        if self.out is not None and self.size + len(record) > self.limit:
            self.close()
        if self.out is None:
            self.name = f"{self.shard:08d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.store.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha1()
            self._put(_record("warcinfo", self.name, [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", self.date))
        self._put(record)
        self.records += 1

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.sha.update(raw)
        self.size += len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.records, self.size, b32(self.sha.digest())))
            self.out, self.seq = None, self.seq + 1


def _id(page_id) -> int | None:
    return None if page_id is None or page_id != page_id else int(page_id)


def _writer(root: str, file_bytes: int, date: str, least_revisit: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll = None
        # rows of one page and payload come together: a note of whom to refer to, if any, then the records
        now, target, ordinal = None, None, 0
        for batch in batches:
            for shard, page, digest, kind, url, html, first in zip(*(batch[c] for c in ("shard", "page", "digest", "kind", "url", "html", "first"))):
                page, first = _id(page), _id(first)
                if roll is None or roll.shard != shard:
                    if roll:
                        roll.close()
                        yield pd.DataFrame(roll.done, columns=MANIFEST.names)
                    roll = _Roll(root, int(shard), file_bytes, date)
                if (page, digest) != now:
                    now, target, ordinal = (page, digest), None, 0
                if kind == 0:
                    target = first
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                own = b32(hashlib.sha1(payload).digest())
                refers = target if target is not None else page
                revisit = (target is not None or ordinal > 0) and len(payload) >= least_revisit
                address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
                headers = [("WARC-Target-URI", address)] if url else []
                headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{own}"), ("X-Payload-Length", str(len(payload)))]
                headers += [("X-Page-Id", str(page))] if page is not None else []
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                identity = f"page:{page}:{own}"
                if revisit:
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers}:{own}')}>")]
                    headers += [("X-Refers-To-Page", str(refers))] if refers is not None else []
                    roll.add(_record("revisit", f"{identity}:{ordinal}", headers, http, date))
                else:
                    roll.add(_record("response", f"{identity}:{ordinal}" if ordinal else identity, headers, http + payload, date))
                ordinal += 1
        if roll:
            roll.close()
            yield pd.DataFrame(roll.done, columns=MANIFEST.names)

    return write


def _leaves(sizes: DataFrame, shard_bytes: int) -> tuple[list[tuple[int, DataFrame]], int, int]:
    """([(bits, leaves of cells of so many low bits)], shards of ids, shards of rows without one).

    A cell is a range of ids with equal high bits; one of more than a shard is
    cut into CELLS at the next level, down to single ids, all such cells of a
    level by one aggregate. The leaves in order of ids, with a running sum of
    their bytes, are dealt to shards; a single id of more than a shard gets parts
    shards of its own. Depends on the data alone.
    """
    low, high, total, known = sizes.agg(F.min("page"), F.max("page"), F.sum("bytes"), F.sum(F.when(F.col("page").isNotNull(), F.col("bytes")))).first()
    levels, shards = [], 0
    if low is not None:
        # some cells for each shard, if the ids are dealt evenly
        cells = max(CELLS, 16 * known // shard_bytes)
        bits = max(0, (high - low).bit_length() - cells.bit_length())
        left = sizes.where("page is not null")
        while True:
            found = written(left.groupBy(F.shiftright("page", bits).alias("cell")).agg(F.sum("bytes").alias("bytes")), "warc-cells")
            heavy = found.where(F.col("bytes") > shard_bytes) if bits else found.limit(0)
            levels.append((bits, found if not bits else found.where(F.col("bytes") <= shard_bytes)))
            if not bits or not heavy.limit(1).count():
                break
            left = left.join(near(heavy.select("cell")), F.shiftright("page", bits) == F.col("cell"), "left_semi")
            bits = max(0, bits - CELLS.bit_length() + 1)
        leaves = None
        for bits, found in levels:
            rows = found.select(F.shiftleft("cell", bits).alias("start"), F.lit(bits).alias("bits"), "cell", "bytes")
            leaves = rows if leaves is None else leaves.union(rows)
        # a running sum in two steps, so that no task gets all leaves but only a sum for every few thousand
        block = F.shiftright("start", max(0, (high - low).bit_length() - 13))
        leaves = leaves.withColumn("block", block).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("bytes") / shard_bytes)).cast("long"))
        leaves = leaves.withColumn("own", F.when(F.col("parts") > 1, F.col("parts") * shard_bytes).otherwise(F.col("bytes")))
        sums = leaves.groupBy("block").agg(F.sum("own").alias("own"))
        before = sums.select(F.col("block").alias("b"), F.coalesce(F.sum("own").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        within = F.coalesce(F.sum("own").over(Window.partitionBy("block").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        leaves = leaves.withColumn("within", within).join(before, F.col("block") == F.col("b"))
        at = F.col("before") + F.col("within")
        # one that is split starts at the next whole shard
        shard = F.when(F.col("parts") > 1, F.ceil(at / shard_bytes)).otherwise(F.floor(at / shard_bytes)).cast("long")
        leaves = written(leaves.select("bits", "cell", shard.alias("shard"), "parts"), "warc-leaves")
        shards = (leaves.agg(F.max(F.col("shard") + F.col("parts"))).first()[0] or 0) + 1
        levels = [(bits, leaves.where(F.col("bits") == bits).select("cell", "shard", "parts")) for bits, _ in levels]
    return levels, shards, max(1, -(-((total or 0) - (known or 0)) // shard_bytes))


def near(df: DataFrame) -> DataFrame:
    """df of three numbers a row for a join: broadcast up to 2 million rows (80 MB or so)."""
    return F.broadcast(df) if df.count() <= 2_000_000 else df


def write_warc(pages: DataFrame, path: str, *, file_bytes: int = 8 << 20, shard_bytes: int = 24 << 20, least_revisit: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) as WARC files under path; return the manifest.

    Records are sorted by page_id over ranges cut from the byte counts of all
    ids, those of one page_id by digest, url and html, so the files' names,
    records and bytes depend on the table alone.
    Payload and headers are written anew with their digests. Of pages with
    equal payloads (of least_revisit bytes at least) the smallest page_id is a
    response and the others are revisits of it.

    A file is written under _temporary with a name of its attempt and renamed
    when whole; a retried task writes the same bytes and renames over them.
    The manifest, a Parquet table in path/manifest, is committed when all
    files are in place; read_warc takes only what it lists.

    A null html has an empty payload; a null url gives no target header; rows
    without page_id make last shards of their own and are responses only if
    no page with an id has their payload; of rows with one
    page_id and one payload the first is written as the response. A page_id of
    more than a shard, and the rows without one, are dealt to several by their
    digests, so no task gets them all. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digest = F.sha1(text.cast("binary"))
    sizes = written(pages.select(F.col("page_id").cast("long").alias("page"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")), "warc-digests")
    levels, shards, bare = _leaves(sizes.select("page", (F.col("bytes") + 600).alias("bytes")), shard_bytes)

    first = sizes.where(F.col("bytes") >= least_revisit).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    refers = sizes.join(first, "digest").where("page is null or page > first").select("page", "digest", "first").distinct()
    notes = refers.select("page", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first")
    whole = pages.select(F.col("page_id").cast("long").alias("page"), digest.alias("digest"), F.lit(1).alias("kind"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.lit(None).cast("long").alias("first"))
    rows, shard = notes.union(whole), F.lit(None).cast("long")
    drawn = F.xxhash64("digest")
    for k, (bits, leaves) in enumerate(levels):
        rows = rows.join(near(leaves.select(F.col("cell").alias(f"c{k}"), F.col("shard").alias(f"s{k}"), F.col("parts").alias(f"p{k}"))), F.shiftright("page", bits) == F.col(f"c{k}"), "left")
        shard = F.coalesce(shard, F.col(f"s{k}") + F.pmod(drawn, F.col(f"p{k}")))
    shard = F.when(F.col("page").isNull(), F.lit(shards) + F.pmod(drawn, F.lit(bare))).otherwise(shard)
    rows = rows.select("page", "digest", "kind", "url", "html", "first", shard.cast("long").alias("shard"))
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(f"{root}/_temporary", recursive=True)
    # each task gets a run of shards, one alone where they are not too many
    each = -(-(shards + bare) // MAX_TASKS)
    laid = rows.withColumn("task", (F.col("shard") / each).cast("int")).repartitionById(-(-(shards + bare) // each), "task").drop("task").sortWithinPartitions("shard", "page", "digest", "kind", "url", "html")
    laid.mapInPandas(_writer(path, file_bytes, date, least_revisit), MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream, one in memory at a time."""
    unpack, parts, start, at = zlib.decompressobj(31), [], 0, 0
    while chunk := stream.read(1 << 20):
        while chunk:
            parts.append(unpack.decompress(chunk))
            if not unpack.eof:
                at += len(chunk)
                break
            at += len(chunk) - len(unpack.unused_data)
            yield start, b"".join(parts)
            chunk, start = unpack.unused_data, at
            unpack, parts = zlib.decompressobj(31), []
    if b"".join(parts):
        raise ValueError(f"a record at {start} is cut off")


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _reader(root: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch["file"]:
                rows = []
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, raw in _members(stream):
                        headers, block = _parsed(raw)
                        if headers["WARC-Block-Digest"] != f"sha1:{b32(hashlib.sha1(block).digest())}":
                            raise ValueError(f"{name}: block digest differs at {offset}")
                        kind, digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "")[5:]
                        if kind == "warcinfo":
                            continue
                        size = int(headers["X-Payload-Length"])
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size, digest = len(payload), b32(hashlib.sha1(payload).digest())
                            if f"sha1:{digest}" != headers["WARC-Payload-Digest"]:
                                raise ValueError(f"{name}: payload digest differs at {offset}")
                        rows.append((headers.get("X-Page-Id"), headers.get("WARC-Target-URI"), size, digest, kind, headers.get("X-Refers-To-Page"), name, offset))
                        if len(rows) >= 4096:
                            yield _frame(rows)
                            rows = []
                if rows:
                    yield _frame(rows)

    return read


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=RECORDS.names)
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([None if x is None else int(x) for x in out[c]], dtype="Int64")
    return out


def read_warc(manifest: DataFrame, path: str) -> DataFrame:
    """A row for each record that the manifest's files hold, digests checked.

    page_id, url, payload_bytes and payload_digest (of the full payload, also
    for revisits), record_type, refers_to, file and the record's offset in it.
    """
    tasks = max(1, int(manifest.count()))
    return manifest.select("file").repartition(min(tasks, 4096)).mapInPandas(_reader(path), RECORDS)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages into a fresh folder of the shared store and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, path, **options), path)
