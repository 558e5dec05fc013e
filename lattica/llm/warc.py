"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id, files roll by compressed size, headers and digests are made anew,
and files are committed through temporary names and a manifest.

Defined results: a null html is the empty payload; a null page id sorts before all others and is written
as an empty header; a null url is written as an empty target URI; repeated rows each get a record.  Of
records with equal payloads the one with the largest page id is the response and the others revisit it
(of rows that repeat that page id too, the first in url order).  An empty table gives no file and no row.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common

#: Records have no crawl time in ``pages``; a fixed date keeps the files a function of the rows.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _header(pairs: list[tuple[str, object]]) -> bytes:
    clean = lambda x: str(x).replace("\r", "%0D").replace("\n", "%0A")
    return b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in pairs).encode() + b"\r\n"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, ordinal: int) -> bytes:
    """One WARC record: HTTP response with its payload, or a revisit that keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, digest = http if revisit else http + payload, _digest(payload)
    name = uuid.uuid5(NAMESPACE, f"{page_id}\n{url}\n{digest}\n{ordinal}")
    pairs = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "" if url is None else url),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _digest(block)),
        ("X-Page-Id", "" if page_id is None else page_id),
    ]
    if revisit:
        pairs += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", "" if refers_to is None else refers_to)]
    pairs += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _header(pairs) + block + b"\r\n\r\n"


def write(pages: DataFrame, uri: str, roll_bytes: int = 32 << 20, shard_bytes: int = 16 << 20, revisit_from: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ``.warc.gz`` files below ``uri``; gives the written manifest.

    ``roll_bytes``: a file closes once its compressed size has reached this.  ``shard_bytes``: payload bytes
    of a range shard, about; a page id that fills more is parted by its payloads' digests.  ``revisit_from``: equal payloads of fewer bytes are all responses.

    The payload is shuffled once: the copies' decisions travel as small rows of their own, which sort
    just before the record they belong to, so the writing task needs no join.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    keys = rows.select("page_id", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    keys = common.materialize(keys, "warc-keys")
    # Only payloads that occur more than once need a decision; sums per digest are made before the shuffle.
    groups = keys.where(F.col("n") >= revisit_from).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("copies")).where("copies > 1")
    revisits = keys.join(groups, "digest").select("page_id", "digest", "leader").distinct()
    both = rows.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.unhex(F.sha1("payload")).alias("digest"), F.lit(None).cast("long").alias("leader")).unionByName(
        revisits.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "leader")
    )
    shards = common.range_shards(keys.select("page_id", (F.col("n") + 512).alias("w")), "page_id", "w", shard_bytes)
    both = shards.add(both, "page_id", F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"))
    ordered = both.repartitionById(shards.count, "_shard").sortWithinPartitions("page_id", "digest", "kind", "url")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, part, n, shard, group, led, ordinal = [], io.BytesIO(), 0, 0, None, None, None, 0

        def close() -> None:
            nonlocal out, part, n
            data = out.getvalue()
            temp, name = common.write_file(uri, f"part-{shard:06d}-{part:05d}.warc.gz", data)
            files.append({"name": name, "temp": temp, "shard": shard, "part": part, "rows": n, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
            out, part, n = io.BytesIO(), part + 1, 0

        for batch in common.text_slices(batches, "payload", 8 << 20):
            for row in batch.to_pylist():
                if row["_shard"] != shard:
                    if n:
                        close()
                    shard, part, group = row["_shard"], 0, None
                if (row["page_id"], row["digest"]) != group:
                    group, led, ordinal = (row["page_id"], row["digest"]), None, 0
                if not row["kind"]:
                    led = (row["leader"],)
                    continue
                # The first row of the leading page is the response; what repeats it, and all others, revisit it.
                again = led is not None and (row["page_id"] != led[0] or ordinal > 0)
                text = record(row["page_id"], row["url"], row["payload"], led[0] if again else None, again, ordinal)
                out.write(gzip.compress(text, 6, mtime=0))
                n, ordinal = n + 1, ordinal + 1
                if out.tell() >= roll_bytes:
                    close()
        if n:
            close()
        if files:
            yield pa.RecordBatch.from_pylist(files, schema=MANIFEST_ARROW)

    manifest = ordered.mapInArrow(store, common.MANIFEST)
    manifest.write.parquet(f"{uri}/_manifest")
    manifest = spark.read.schema(common.MANIFEST).parquet(f"{uri}/_manifest")
    common.commit_files(manifest)
    common.drop_path(spark, f"{uri}/_temporary")
    return manifest


MANIFEST_ARROW = pa.schema([("name", pa.string()), ("temp", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("rows", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def members(data: memoryview) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    at = 0
    while at < len(data):
        unzip = zlib.decompressobj(31)
        parts, step = [], 1 << 16
        while not unzip.eof:
            if at >= len(data):
                raise ValueError("a record is cut off")
            piece = data[at : at + step]
            parts.append(unzip.decompress(piece))
            at += len(piece) - len(unzip.unused_data)
        yield b"".join(parts)


def parse(text: bytes) -> dict:
    """Header fields and payload of a record; a block or payload that doesn't fit its digest is an error."""
    head, _, rest = text.partition(b"\r\n\r\n")
    field = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(field["Content-Length"])]
    if _digest(block) != field["WARC-Block-Digest"]:
        raise ValueError(f"{field['WARC-Record-ID']}: the block doesn't fit its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = field["WARC-Type"] == "revisit"
    if not revisit and _digest(payload) != field["WARC-Payload-Digest"]:
        raise ValueError(f"{field['WARC-Record-ID']}: the payload doesn't fit its digest")
    number = lambda k: int(field[k]) if field.get(k) else None
    return {
        "page_id": number("X-Page-Id"),
        "url": field["WARC-Target-URI"],
        "payload_bytes": int(http.decode().rpartition("Content-Length: ")[2]),
        "payload_digest": field["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": field["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-Id"),
        "payload": None if revisit else payload,
    }


def read(spark: SparkSession, uri: str) -> DataFrame:
    """A row per record of the archives below ``uri``, read by Spark and held against their digests."""

    def rows(buffer: pa.Buffer) -> Iterator[pa.RecordBatch]:
        held = []
        for text in members(memoryview(buffer)):
            held.append({k: v for k, v in parse(text).items() if k != "payload"})
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, schema=READ_ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=READ_ARROW)

    return common.binary_files(spark, uri, READ, rows, "*.warc.gz")


READ_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all of ``pages`` and read the archives back."""
    uri = common.scratch_dir(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), uri)
    return read(spark, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no base32 function, so the digest's hex digits are turned into bits and cut in fives.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, row_number() OVER (ORDER BY page_id) AS row_no FROM pages
), d AS (
  SELECT page_id, row_no, octet_length(encode(t)) AS payload_bytes, upper(sha1(t)) AS h FROM p
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right(format('{:04b}', strpos('0123456789ABCDEF', h[i]) - 1), 4)), '') AS bits FROM d
), e AS (
  SELECT page_id, row_no, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
      1 + 16 * bits[5*i+1]::INT + 8 * bits[5*i+2]::INT + 4 * bits[5*i+3]::INT + 2 * bits[5*i+4]::INT + bits[5*i+5]::INT]), '') AS payload_digest FROM b
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS leader FROM e
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to
FROM g
"""
