"""Fuzzy line dedup by MinHash.

A line is what stands between newlines, without spaces at its ends; empty lines are kept as they are.  A hash names a
line, so equal lines are one vertex.  A line's signature takes minima over hashes of all its character shingles: every
shingle falls by its hash into one of ``bands * ROWS`` bins, the smallest of a bin is its minimum, and a bin without
shingles takes the minimum of another, in an order of its own.  Bands of four minima make the keys on which lines meet.

1.  Every slice of documents splits its texts once, signs each of its lines once, and sends the keys in a packed row for
    each bucket of keys.  A bucket names for every key the smallest line as leader: pairs (leader, line).
2.  Pairs that parity sketches don't rule out are verified by the exact Jaccard similarity of all shingles, and components
    are taken over the links by distributed union-find.
3.  What a leader leaves open is settled in blocks: lines around one leader that links do not join are compared by their
    sketches, and verified.

Of each component the first occurrence stays: smallest document id, then smallest line number.  Two lines of the
similarity s share no key with a chance of (1 - s^4)^bands: 0.2 % for 0.8.  Sketches rule out no linked pair.

This is not written in SQL functions alone: these took three times the time that is set (see README).

Defined results: a null text has no lines; rows that repeat a document id with another text are documents of their
own, rows that repeat id and text have the same result; a null id comes first; lines shorter than a shingle link with
equal lines alone; lines of one 64-bit name that a second hash tells apart link with equal lines alone; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common, jaccard

#: Characters of a shingle; per cent of similarity at which lines link; bands, and minima of each.
SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 12, 4
#: Bytes of text for each bucket of keys, and of a slice of documents; lines that are signed at once (at most 1 << 18).
BUCKET_BYTES, SLICE_BYTES, SIGNED = 16 << 20, 2 << 20, 1 << 16
U = np.uint64


def shingle_hashes(lines: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the lines, and how many each line has; a line of fewer characters has none."""
    texts = [x.decode("utf-8", "replace") for x in lines]
    counts = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    rolled = codes[: max(0, len(codes) - size + 1)] + U(1)
    for k in range(1, size):
        rolled = (rolled ^ (rolled >> U(29))) * U(0x9E3779B97F4A7C15) + codes[k : len(codes) - size + 1 + k]
    hashes = jaccard.mix(rolled)
    per = np.maximum(counts - size + 1, 0)
    starts = np.cumsum(counts) - counts
    at = np.repeat(starts - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    return hashes[at], per


def line_sets(lines: list[bytes], size: int) -> list[np.ndarray]:
    """Each line's distinct shingles as ascending 64-bit hashes."""
    hashes, per = shingle_hashes(lines, size)
    return [common.distinct(x) for x in np.split(hashes, np.cumsum(per)[:-1])] if len(per) else []


def probes(bins: int) -> np.ndarray:
    """For each bin all bins, itself first, in the order in which it asks them for a minimum."""
    return np.array([[j, *(k for k in np.random.default_rng(j).permutation(bins).tolist() if k != j)] for j in range(bins)])


def sign(lines: list[bytes], size: int, bands: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of lines with shingles: their places in ``lines``, set sizes, band keys (a row per line), and parity sketches."""
    bins = bands * ROWS
    hashes, per = shingle_hashes(lines, size)
    owner = np.repeat(np.arange(len(lines)), per)
    # Line, bin and value in one number: sorted, a bin's first is its minimum.
    packed = (owner.astype(U) << U(46)) | ((hashes >> U(40)) % U(bins)) << U(40) | (hashes & U((1 << 40) - 1))
    packed = common.distinct(packed)
    line = (packed >> U(46)).astype(np.int64)
    slot = (packed >> U(40)).astype(np.int64)
    heads = lambda x: np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)
    starts, first = np.flatnonzero(heads(line)), np.flatnonzero(heads(slot))
    place, sizes = line[starts], np.diff(np.append(starts, len(line)))
    local = np.repeat(np.arange(len(place)), sizes)
    minima = np.full((len(place), bins), -1, np.int64)
    minima[local[first], slot[first] & 63] = (packed[first] & U((1 << 40) - 1)).astype(np.int64)
    gaps = np.flatnonzero((minima < 0).any(axis=1))
    filled, ask = minima[gaps], probes(bins)
    for step in range(1, bins):
        lacking = filled < 0
        if not lacking.any():
            break
        rows, columns = np.nonzero(lacking)
        filled[rows, columns] = minima[gaps[rows], ask[columns, step]]
    minima[gaps] = filled
    keys = np.zeros((len(place), bands), U)
    for r in range(ROWS):  # a band takes its minima from bins that are far apart
        keys = jaccard.mix(keys + minima[:, r * bands : (r + 1) * bands].astype(U)) + U(r + 1)
    keys = jaccard.mix(keys + np.arange(bands, dtype=U))
    sketches: list[bytes] = [b""] * len(place)
    widths = np.array([jaccard.sketch_width(n, percent) for n in range(int(sizes.max(initial=0)) + 1)])[sizes]
    spots = jaccard.mix(packed & U((1 << 46) - 1))
    for width in np.unique(widths).tolist():
        some = np.flatnonzero(widths == width)
        number = np.full(len(place), -1)
        number[some] = np.arange(len(some))
        mine = number[local] >= 0
        odd = np.bincount(number[local[mine]] * width + (spots[mine] & U(width - 1)).astype(np.int64), minlength=len(some) * width) & 1
        bits = np.packbits(odd.astype(np.uint8)).reshape(len(some), width // 8)
        for k, row in zip(some.tolist(), bits, strict=True):
            sketches[k] = row.tobytes()
    return place, sizes, keys, sketches


FOUND = "kind int, bucket int, doc long, copy long, line_no int, h1 long, h2 long, n long, sketch binary, keys binary"
FOUND_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("doc", pa.int64()), ("copy", pa.int64()), ("line_no", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("keys", pa.binary())])


def _batch(rows: int, **columns) -> pa.RecordBatch:
    """A batch of so many rows; what is not given is null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in FOUND_ARROW], schema=FOUND_ARROW)


def hash_lines(text: bytes) -> tuple[list[bytes], list[int], list[int], list[int]]:
    """Lines that are not empty, their numbers, and two hashes of each as signed numbers."""
    lines, numbers = [], []
    for k, raw in enumerate(text.split(b"\n")):
        line = raw.strip(b" ")
        if line:
            lines.append(line)
            numbers.append(k)
    return lines, numbers, [xxhash.xxh64_intdigest(x, 42) for x in lines], [xxhash.xxh64_intdigest(x, 7) for x in lines]


def split_and_sign(docs: DataFrame, size: int, bands: int, percent: int, buckets: int) -> DataFrame:
    """Kind 0: a row per line of ``docs`` (doc, text).  Kind 1: a row per line of a slice, once, with its sketch.
    Kind 2: the slice's keys of one bucket, each with its smallest line.  Kind 3: pairs (leader h1, line h2) of the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in common.text_slices(batches, "text", SLICE_BYTES):
            lines, numbers, h1, h2, docs_, copies = [], [], [], [], [], []
            for doc, copy, text in zip(batch.column("doc").to_pylist(), batch.column("copy").to_pylist(), common.text_bytes(batch, "text"), strict=True):
                some, no, a, b = hash_lines(text)
                lines += some
                numbers += no
                h1 += a
                h2 += b
                docs_ += [doc] * len(some)
                copies += [copy] * len(some)
            if not lines:
                continue
            a, b = np.array(h1, U).view(np.int64), np.array(h2, U).view(np.int64)
            yield _batch(len(a), kind=np.zeros(len(a), np.int32), doc=docs_, copy=copies, line_no=np.array(numbers, np.int32), h1=a, h2=b)
            names, at = np.unique(a, return_index=True)
            for low in range(0, len(names), SIGNED):
                yield from signed(names[low : low + SIGNED], b[at[low : low + SIGNED]], [lines[k] for k in at[low : low + SIGNED].tolist()])

    def signed(names: np.ndarray, seconds: np.ndarray, lines: list[bytes]) -> Iterator[pa.RecordBatch]:
        place, sizes, keys, sketches = sign(lines, size, bands, percent)
        if not len(place):
            return
        names, seconds = names[place], seconds[place]
        yield _batch(len(names), kind=np.ones(len(names), np.int32), h1=names, h2=seconds, n=sizes, sketch=sketches)
        once, leaders, pairs = jaccard.pairs_of(keys.reshape(-1), np.repeat(names, bands), jaccard.TOGETHER)
        if len(pairs):
            yield _batch(len(pairs), kind=np.full(len(pairs), 3, np.int32), h1=pairs[:, 0], h2=pairs[:, 1])
        packed = [(k, len(some), once[some].tobytes() + leaders[some].tobytes()) for k, some in common.by_value(((once >> U(20)) % U(buckets)).astype(np.int64))]
        yield _batch(len(packed), kind=np.full(len(packed), 2, np.int32), bucket=np.array([p[0] for p in packed], np.int32), n=np.array([p[1] for p in packed], np.int64), keys=[p[2] for p in packed])

    return common.materialize(docs.mapInArrow(run, FOUND), "line-signs", "kind")


def lead(found: DataFrame, buckets: int) -> DataFrame:
    """Distinct pairs (a, b, own): a bucket's leader and another of the lines that slices send for its keys, and the slices' own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        keys, lines = [], []
        for batch in batches:
            for blob in batch.column("keys"):
                data = np.frombuffer(blob.as_buffer(), np.int64)
                keys.append(data[: len(data) // 2].view(U).copy())
                lines.append(data[len(data) // 2 :].copy())
        if keys:
            pairs = jaccard.pairs_of(np.concatenate(keys), np.concatenate(lines))[2]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    sent = found.where("kind = 2").select("bucket", "keys").repartitionById(buckets, "bucket").select("keys")
    own = found.where("kind = 3").select(F.col("h1").alias("a"), F.col("h2").alias("b"), F.lit(True).alias("own"))
    return sent.mapInArrow(run, "a long, b long").withColumn("own", F.lit(False)).unionAll(own).distinct()


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, text): once each line of ``docs`` whose name is in ``wanted`` (doc), by its name."""
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("raw")).select(F.trim("raw").alias("text")).where("text <> ''")
    named = lines.withColumn("doc", F.xxhash64("text"))  # the seed of this function is 42
    few = wanted.count() <= jaccard.BROADCAST_IDS
    return named.join(F.broadcast(wanted) if few else wanted, "doc", "left_semi").groupBy("doc").agg(F.first("text").alias("text"))


def links(docs: DataFrame, found: DataFrame, buckets: int, size: int, percent: int) -> DataFrame:
    """Verified pairs (a, b) of names of different lines."""
    sets_of = lambda texts: line_sets(texts, size)
    lines = found.where("kind = 1").groupBy("h1").agg(F.min("h2").alias("h2"), F.max("h2").alias("last"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    alike = lines.where("h2 = last").select(F.col("h1").alias("doc"), "n", "sketch")
    led = common.settle(lambda: lead(found, buckets), "line-pairs")
    for kind in (2, 3):  # the keys are most of what was written, and only the leaders come from them
        common.drop_path(found.sparkSession, f"{found.scratch_path}/kind={kind}")
    ends = led.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    lines = common.settle(lambda: alike.join(ends, "doc", "left_semi"), "line-sketches")
    side = lambda c, n, s: lines.select(F.col("doc").alias(c), F.col("n").alias(n), F.col("sketch").alias(s))
    both = lambda pairs: pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b")
    likely = common.settle(lambda: jaccard.may_link(both(led.select("a", "b").distinct()), percent), "line-likely")
    texts_of = lambda wanted: line_texts(docs, wanted)
    named = likely.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    out = common.settle(lambda: jaccard.verify(texts_of(named), likely, sets_of, percent), "line-links")
    joined = common.settle(lambda: common.connected_components(out), "line-joined")
    tiles = common.settle(lambda: jaccard.unsettled(led, lines, joined, percent), "line-tiles")
    return out.unionAll(common.settle(lambda: jaccard.links_of_tiles(tiles, texts_of, sets_of, percent), "line-links"))


def components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every non-empty line with its class and whether it stays: doc, copy, line_no, h1, h2, class_doc, class_line, kept."""
    if bands * ROWS > 64:
        raise ValueError("a line has 64 bins at most")
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("copy"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    found = split_and_sign(rows, size, bands, percent, buckets)
    parts = common.settle(lambda: common.connected_components(links(rows, found, buckets, size, percent)), "line-components")
    joined = parts.select(F.col("v").alias("h1"), "component")
    places = found.where("kind = 0").select("doc", "copy", "line_no", "h1", "h2").distinct()
    classes = places.join(joined, "h1", "left")
    # Lines without links are a class by both hashes; components need none beside their number.
    classed = classes.withColumn("c1", F.coalesce("component", "h1")).withColumn("c2", F.when(F.col("component").isNull(), F.col("h2")))
    classes = common.settle(lambda: classed.drop("component"), "line-classes")
    common.discard(found, parts)
    first = classes.groupBy("c1", "c2").agg(F.min(F.struct("doc", "copy", "line_no")).alias("first"), F.count("*").alias("lines"))
    first = first.where("lines > 1").select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), "first")
    out = classes.join(first, (F.col("c1") == F.col("d1")) & F.col("c2").eqNullSafe(F.col("d2")), "left")
    kept = F.col("first").isNull() | F.struct("doc", "copy", "line_no").eqNullSafe(F.col("first"))
    return out.select("doc", "copy", "line_no", "h1", "h2", F.when(F.col("first").isNull(), F.col("doc")).otherwise(F.col("first.doc")).alias("class_doc"), F.coalesce(F.col("first.line_no"), F.col("line_no")).alias("class_line"), kept.alias("kept"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document: its lines that are not empty, those that stay, and those that repeat an earlier line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = components(docs)
    sums = found.groupBy("doc", "copy").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.col("kept").cast("long")).alias("n_kept"),
        F.array_sort(F.collect_list(F.when(F.col("kept"), F.col("line_no")))).alias("kept_lines"),
        F.array_sort(F.collect_list(F.when(~F.col("kept"), F.struct("line_no", "class_doc", "class_line")))).alias("removed"),
    )
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("copy"))
    sums = sums.withColumnRenamed("copy", "of")
    out = rows.join(sums, (F.col("copy") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("doc")), "left")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "kept_lines", "removed")
