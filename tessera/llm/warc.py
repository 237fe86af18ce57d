"""WARC archives: a deterministic sharded writer, and a reader.

Payload digests are built in (sha1 of the html in UTF-8), and of the records with one payload that with the largest id is
the response. Ids with their decisions and ids with their payloads are range-sorted together, so that html crosses one
shuffle. The ranges' borders are quantiles of a sample of rows chosen by their hashes, about SAMPLES for each shard of
``shard_bytes`` of payload, so they depend on the rows alone: the same table gives the same files, byte by byte, whatever
the cluster. An id or null that holds more than a shard is dealt on by digest over the shards whose borders it makes up.
Each shard is written, as it streams, to files of about ``roll_bytes`` of compressed data: one gzip member per record,
headers made anew from the row, no clock and no random ids. A file gets a temporary name of its own attempt, then is
renamed; a shard's manifest is renamed into place last, and the writer's own manifest lists the shards. Readers take the
files that manifests name.

Defined results: null html is an empty payload; null url writes urn:page:<id>; rows with the same id and payload are
records of their own, of which the first is the response if the payload's response is that id; null ids sort first, are
read back as null, and of records whose ids are all null none refers to another (there is no id to name); other columns are
not carried.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import attach, lean, new_path, small_batches, written

DATE = "1970-01-01T00:00:00Z"
SAMPLES, MOST_SHARDS = 40, 20_000


def _store(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, compressed: a response with its payload, or a revisit without."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    kind = "response" if payload is not None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = head + (payload or b"")
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{uri}:{digest}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", "Content-Type: application/http;msgtype=response"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}"]
    lines += [f"X-Payload-Length: {size}"] + ([] if page_id is None else [f"X-Page-ID: {page_id}"])
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    block = "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"
    return gzip.compress(block, 3, mtime=0)


def borders(sizes: DataFrame, shard_bytes: int) -> np.ndarray:
    """Ids between which the shards lie (null: the least), one less than there are shards: quantiles by bytes of rows chosen by
    hash. At most MOST_SHARDS x SAMPLES numbers reach the driver, whatever the table; beyond that, shards grow."""
    total, rows = sizes.agg(F.sum(F.col("size") + 512), F.count(F.lit(1))).first()
    n = min(MOST_SHARDS, -(-(total or 0) // shard_bytes))
    if n < 2:
        return np.zeros(0, np.int64)
    share = min(1.0, n * SAMPLES / rows)
    some = sizes.where(F.pmod(F.xxhash64("id", "d", F.lit(3)), F.lit(1 << 40)) < int(share * (1 << 40)))
    got = some.select(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), (F.col("size") + 512).alias("size")).toArrow()
    ids, size = (got.column(c).to_numpy() for c in range(2))
    order = np.lexsort((size, ids))
    ends = np.cumsum(size[order])
    return ids[order][np.searchsorted(ends, ends[-1] * np.arange(1, n) / n)] if len(ids) else np.zeros(0, np.int64)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, roll_bytes: int = 64 << 20, shard_bytes: int = 32 << 20, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archives below ``path``. Returns the manifest (file, records, bytes), which lies there too."""
    spark = pages.sparkSession
    small_batches(spark, 500)
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    sizes = written(own.select("id", F.sha1("html").alias("d"), F.octet_length("html").cast("long").alias("size")), "digests")
    cuts = borders(sizes, shard_bytes)
    best = sizes.where(F.col("size") >= min_bytes).groupBy("d").agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("c"))
    marks = attach(sizes.select("id", "d").distinct(), written(best.where("c > 1"), "best"), ["d"], "c", F.col("id")).where("best is not null")
    empty = F.lit(None).cast("string")

    @F.arrow_udf("int")
    def shard_of(ids: pa.Array, spread: pa.Array) -> pa.Array:
        x = ids.to_numpy(zero_copy_only=False)
        lo, hi = np.searchsorted(cuts, x, "left"), np.searchsorted(cuts, x, "right")
        return pa.array((lo + spread.to_numpy(zero_copy_only=False) % (hi - lo + 1)).astype(np.int32))

    # decisions (kind 0) stand before the rows (kind 1) of the same id and payload
    both = marks.select("id", "d", F.lit(0).alias("kind"), empty.alias("url"), empty.alias("html"), "best").union(own.select("id", F.sha1("html").alias("d"), F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("best")))
    to = shard_of(F.coalesce("id", F.lit(-(1 << 63))), F.pmod(F.xxhash64("d"), F.lit(1 << 31))) if len(cuts) else F.lit(0)
    dealt = both.withColumn("shard", to).repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "id", "d", "kind", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        fs, root = _store(path)
        fs.create_dir(root, recursive=True)
        out, name, count, size, files, shard, last, best, done = None, "", 0, 0, [], None, None, None, False
        every: list[tuple[str, int, int]] = []

        def settle(name: str) -> None:
            """A finished temporary file gets its name; an earlier attempt may have put the same bytes there."""
            if fs.get_file_info(f"{root}/{name}").is_file:
                fs.delete_file(f"{root}/.tmp-{name}-{attempt}")
            else:
                fs.move(f"{root}/.tmp-{name}-{attempt}", f"{root}/{name}")

        def roll() -> None:
            nonlocal out
            if out:
                out.close()
                settle(name)
                files.append((name, count, size))
                out = None

        def end() -> None:
            if shard is not None:
                roll()
                note = f"shard-{shard:06d}.json"
                with fs.open_output_stream(f"{root}/.tmp-{note}-{attempt}") as f:
                    f.write(json.dumps([{"file": f, "records": r, "bytes": s} for f, r, s in files]).encode())
                settle(note)
                every.extend(files)
                files.clear()

        for b in batches:
            for i, d, kind, url, html, mark, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != shard:
                    end()
                    shard, last = at, None
                if (i, d) != last:
                    last, best, done = (i, d), None, False
                if kind == 0:
                    best = mark
                    continue
                data = html.encode()
                whole = best is None or (best == i and not done)
                done = True
                if out is None:
                    name, count, size = f"part-{shard:06d}-{len(files):05d}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/.tmp-{name}-{attempt}")
                got = record(i, url, base64.b32encode(bytes.fromhex(d)).decode(), len(data), data if whole else None, None if whole else best)
                out.write(got)
                count, size = count + 1, size + len(got)
                if size >= roll_bytes:
                    roll()
        end()
        yield pa.record_batch([pa.array([f for f, _, _ in every], pa.string()), pa.array([r for _, r, _ in every], pa.int64()), pa.array([s for _, _, s in every], pa.int64())], names=["file", "records", "bytes"])

    manifest = dealt.mapInArrow(lean(run), "file string, records long, bytes long")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema("file string, records long, bytes long").parquet(f"{path}/manifest")


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:  # noqa: ANN001
    """The gzip members of a stream, one at a time."""
    d, out, rest = zlib.decompressobj(31), [], b""
    while data := rest or stream.read(chunk):
        out.append(d.decompress(data))
        rest = d.unused_data
        if d.eof:
            yield b"".join(out)
            d, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("an archive ends within a record")


def parse(block: bytes) -> dict:
    """Headers by lower-case name, and the payload; digests are checked."""
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(h["content-length"])]
    if len(body) != int(h["content-length"]) or f"sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}" != h["warc-block-digest"]:
        raise ValueError(f"damaged record {h.get('warc-record-id')}")
    h["payload"] = body.partition(b"\r\n\r\n")[2]
    return h


def read_warc(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """(page_id, url, record_type, payload binary, payload_bytes, payload_digest, refers_to) of the files in the manifest."""
    small_batches(spark, 500)
    manifest = spark.read.parquet(f"{path}/manifest") if manifest is None else manifest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(path)
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    rows = []
                    for h in map(parse, _members(f)):
                        whole = h["warc-type"] == "response"
                        if whole and f"sha1:{base64.b32encode(hashlib.sha1(h['payload']).digest()).decode()}" != h["warc-payload-digest"]:
                            raise ValueError(f"damaged payload {h['warc-record-id']}")
                        ids = [int(v) if (v := h.get(k)) is not None else None for k in ("x-page-id", "x-refers-to-page-id")]
                        rows.append((ids[0], h["warc-target-uri"], h["warc-type"], h["payload"] if whole else None, int(h["x-payload-length"]), h["warc-payload-digest"][5:], ids[1]))
                        if len(rows) >= 200:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                    if rows:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return manifest.select("file").repartition(n, "file").mapInArrow(lean(run), "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Write, then read back."""
    path = path or new_path(pages.sparkSession, "warc")
    return read_warc(pages.sparkSession, path, write_warc(pages, path, **options))
