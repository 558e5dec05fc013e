"""Exact removal of repeated substrings: every byte that a string of ``length`` bytes covers which also starts in a
document with a smaller id.

The order of suffixes matters only up to ``length`` bytes, and only where texts repeat.  So the distributed
difference-cover algorithm runs in three rounds over packed slices of documents:

1.  Sample.  A window's sampled position is that of the smallest hash of a ``GRAM`` inside it, so equal windows have
    the same sampled position, wherever they stand.  Names of sampled positions are sorted in buckets; what occurs in
    one document alone is dropped: no window over it can repeat.
2.  Name and sort.  The text around each sampled position that is left goes to the position's bucket once per slice.
    There, of every three consecutive suffixes two are sampled: their triples of words are sorted and named, names of
    triples are sorted and named again, the remaining suffixes are ordered by their first byte and the name that
    follows, and adjacent prefixes of ``length`` bytes are compared.  Each prefix's smallest document is found.
3.  Each slice hears which of its prefixes occur in smaller documents, and removes the bytes that they cover.

Documents whose whole text equals that of a smaller id are settled by a hash of the text beforehand.

Defined results: a null text is empty; a null id is neither smaller nor larger than any other, so its row keeps all
bytes and takes none; rows that repeat an id are documents of their own, none smaller than the other; texts shorter
than ``length`` keep all bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common

LENGTH, GRAM = 50, 16
#: Bytes of a slice of documents, of a piece of a long document, and of text for each bucket.
SLICE_BYTES, PIECE_BYTES, BUCKET_BYTES = 2 << 20, 1 << 20, 12 << 20
#: Prefixes that are named and sorted together.
SORTED = 1 << 20
BROADCAST_IDS = 1 << 20
U = np.uint64
LOW = U((1 << 24) - 1)

SLICES = "slice string, ids binary, ends binary, text binary"
PACKED = "slice string, bucket int, n int, blob binary"
PACKED_ARROW = pa.schema([("slice", pa.string()), ("bucket", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
BACK = "slice string, blob binary"
BACK_ARROW = pa.schema([("slice", pa.string()), ("blob", pa.binary())])


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, of an array that ends with eight bytes more."""
    return np.ndarray((len(data) - 7,), U, data, 0, (1,))


class Units:
    """The windows of some pieces of text, in runs that share a sampled position."""

    def __init__(self, pieces: list[bytes], length: int):
        self.length = length
        self.sizes = sizes = np.array([len(p) for p in pieces], np.int64)
        self.data = b"".join(pieces)
        n = len(self.data)
        buffer = np.frombuffer(self.data + bytes(GRAM + 8), np.uint8)
        words = words_at(buffer)[: n + 8]
        h = (words[:n] * U(0x9E3779B97F4A7C15)) ^ (words[8:] * U(0xC2B2AE3D27D4EB4F))
        h ^= h >> U(29)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(32)
        span = length - GRAM + 1  # grams inside a window
        key = (h & ~LOW) | np.arange(n, dtype=U)
        reach = 1
        while 2 * reach <= span:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if reach < span:
            key = np.minimum(key[: -(span - reach)], key[span - reach :])
        ends = np.cumsum(sizes)
        # Windows that lie in one piece.
        inside = np.zeros(n + 1, np.int32)
        for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            if end - start >= length:
                inside[start] += 1
                inside[end - length + 1] -= 1
        at = np.flatnonzero(np.cumsum(inside[:n]))
        anchor = (key[at] & LOW).astype(np.int64)
        piece = np.searchsorted(ends, at, side="right")
        head = np.ones(len(at), bool)
        head[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(head)
        self.start = at[first]
        self.count = np.diff(np.append(first, len(at)))
        self.anchor, self.piece = anchor[first], piece[first]
        self.name = h[self.anchor]

    def content(self, k: int) -> bytes:
        start = int(self.start[k])
        return self.data[start : start + int(self.count[k]) + self.length - 1]


class Slice:
    """Some documents, and their units a few megabytes at a time."""

    def __init__(self, ids: bytes, ends: bytes, text: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.ends = np.frombuffer(ends, np.int64)
        self.text = _unzip(text)

    def chunks(self, length: int) -> Iterator[tuple[Units, np.ndarray, np.ndarray]]:
        """Units of some pieces, and for each piece its document's number and its offset in the slice."""
        pieces, owners, offsets, size = [], [], [], 0
        for k, end in enumerate(self.ends.tolist()):
            start = int(self.ends[k - 1]) if k else 0
            for at in range(start, max(start + 1, end - length + 1), PIECE_BYTES):
                piece = self.text[at : min(end, at + PIECE_BYTES + length - 1)]
                pieces.append(piece)
                owners.append(k)
                offsets.append(at)
                size += len(piece)
                if size >= SLICE_BYTES:
                    yield Units(pieces, length), np.array(owners), np.array(offsets)
                    pieces, owners, offsets, size = [], [], [], 0
        if pieces:
            yield Units(pieces, length), np.array(owners), np.array(offsets)

    def contents(self, length: int, shared: np.ndarray) -> Iterator[tuple[Units, np.ndarray, np.ndarray, np.ndarray, list[int], list[tuple]]]:
        """As :meth:`chunks`, with the units over shared names, their contents' numbers, and contents that are new.

        A content's number is its place among the slice's distinct contents; a new one comes as
        (name, place of the sampled position, bytes).
        """
        known: dict[tuple[int, bytes], int] = {}
        for units, owners, offsets in self.chunks(length):
            some = np.flatnonzero(_in_sorted(units.name, shared))
            rel = (units.anchor - units.start)[some].tolist()
            numbers, new = [], []
            for k, r in zip(some.tolist(), rel, strict=True):
                content = units.content(k)
                number = known.get((r, content))
                if number is None:
                    number = known[r, content] = len(known)
                    new.append((number, int(units.name[k]), r, content))
                numbers.append(number)
            yield units, owners, offsets, some, numbers, new


def _in_sorted(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    place = np.searchsorted(ordered, values)
    place[place == len(ordered)] = 0
    return ordered[place] == values


def rank(*columns: np.ndarray) -> np.ndarray:
    """Names in order: equal tuples of the columns get equal numbers, smaller ones smaller numbers.

    Columns whose ranges fit into 64 bits together are sorted as one number.
    """
    lows = [int(c.min(initial=0)) for c in columns]
    bits = [(int(c.max(initial=0)) - low).bit_length() for c, low in zip(columns, lows, strict=True)]
    if len(columns) > 1 and sum(bits) <= 64:
        joined = np.zeros(len(columns[0]), U)
        for c, low, n in zip(columns, lows, bits, strict=True):
            joined = joined << U(n % 64) | (c - c.dtype.type(low)).astype(U)  # beside a column of 64 bits all others are zero
        columns = (joined,)
    order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
    head = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        head[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(head)
    return out


def prefix_names(buffer: np.ndarray, starts: np.ndarray, phase: np.ndarray, length: int) -> np.ndarray:
    """Names of the ``length``-byte prefixes at ``starts``, equal for equal prefixes of equal phase.

    Suffixes of phase 1 and 2 are the sample: triples of words are named, then pairs of those names; a suffix of
    phase 0 is its first byte and the name of the sampled suffix after it.
    """
    words = words_at(buffer).byteswap()  # so that numbers have the order of the bytes
    sampled = starts + (phase == 0)
    step, body = 24, length - 2
    places = sorted({*range(0, body - step + 1, step), body - step})  # the last one may be one of the others
    marked = np.zeros(len(words), bool)
    for k in places:
        marked[sampled + k] = True
    wanted, number = np.flatnonzero(marked), np.cumsum(marked) - 1
    triple = rank(words[wanted], words[wanted + 8], words[wanted + 16])
    again = rank(*(triple[number[sampled + k]] for k in places))
    rest = phase == 0
    first = np.where(rest, buffer[starts].astype(np.int64), -1)
    tail = np.where(rest, buffer[starts + length - 1].astype(np.int64), buffer[starts + length - 2].astype(np.int64) << 8 | buffer[starts + length - 1])
    return rank(first, again, tail)


def _smallest(contents: list[tuple[int, bytes]], least: np.ndarray, length: int) -> np.ndarray:
    """The smallest document of each prefix of the contents, whose own smallest documents are ``least``."""
    sizes = np.array([len(c) for _, c in contents], np.int64)
    counts = sizes - length + 1
    buffer = np.frombuffer(b"".join(c for _, c in contents) + bytes(40), np.uint8)
    begins = np.cumsum(sizes) - sizes
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    rel = np.array([r for r, _ in contents], np.int64)
    names = prefix_names(buffer, np.repeat(begins, counts) + inner, (inner - np.repeat(rel, counts)) % 3, length)
    smallest = np.full(int(names.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, names, np.repeat(least, counts))
    return smallest[names]


def _pack_slices(docs: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "text", SLICE_BYTES):
            texts = common.text_bytes(batch, "text")
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            ids = batch.column("doc").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (uuid.uuid4().hex, ids.tobytes(), ends.tobytes(), _squeeze(b"".join(texts)))], names=["slice", "ids", "ends", "text"])

    return common.materialize(docs.mapInArrow(pack, SLICES), "slices")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _cut(place: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(place, kind="stable")
    return order, np.searchsorted(place[order], np.arange(buckets + 1))


def _shared_names(slices: DataFrame, length: int, buckets: int) -> DataFrame:
    """Round 1: for each slice the sampled names that occur in more than one document, in order."""

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            part = Slice(row["ids"], row["ends"], row["text"])
            names, docs = [], []
            for units, owners, _ in part.chunks(length):
                names.append(units.name)
                docs.append(part.ids[owners[units.piece]])
            name, doc = np.concatenate(names), np.concatenate(docs)
            order = np.lexsort((doc, name))
            name, doc = name[order], doc[order]
            first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(name)) - 1
            name, low, high = name[first], doc[first], doc[last]
            # Names that two documents of the slice share are marked.
            mark = (low != high).astype(np.uint8)
            for b, some in common.by_value(((name >> U(17)) % U(buckets)).astype(np.int64)):
                blob = name[some].tobytes() + mark[some].tobytes()
                yield pa.RecordBatch.from_pylist([{"slice": row["slice"], "bucket": b, "n": len(some), "blob": blob}], schema=PACKED_ARROW)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices_, names, owners, sets = [], [], [], []
        for row in _rows(batches):
            n, blob = row["n"], row["blob"]
            names.append(np.frombuffer(blob, U, n))
            sets.append(np.frombuffer(blob, np.uint8, n, 8 * n))
            owners.append(np.full(n, len(slices_), np.int64))
            slices_.append(row["slice"])
        if not names:
            return
        name, owner, mark = (np.concatenate(x) for x in (names, owners, sets))
        # Documents of different slices differ, unless rows repeat an id: then a name counts as shared, which loses nothing.
        order = np.lexsort((owner, name))
        s, o = name[order], owner[order]
        same = np.zeros(len(s), bool)
        if len(s):
            equal = s[1:] == s[:-1]
            same[1:] |= equal
            same[:-1] |= equal
        keep = order[same | (mark[order] > 0)]
        by, edges = _cut(owner[keep], len(slices_))
        for k, slice_ in enumerate(slices_):
            got = keep[by[edges[k] : edges[k + 1]]]
            if len(got):
                yield pa.RecordBatch.from_pylist([{"slice": slice_, "blob": np.sort(name[got]).tobytes()}], schema=BACK_ARROW)

    back = slices.mapInArrow(offer, PACKED).repartitionById(buckets, "bucket").mapInArrow(settle, BACK)
    return common.materialize(back.groupBy("slice").agg(F.collect_list("blob").alias("shared")), "shared")


def _repeated_prefixes(slices: DataFrame, length: int, buckets: int) -> DataFrame:
    """Round 2: for each slice the contents of which some prefixes occur in a document smaller than any of the slice's with that content."""

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            part = Slice(row["ids"], row["ends"], row["text"])
            shared = np.sort(np.frombuffer(b"".join(row["shared"] or []), U))
            all_new, all_numbers, docs = [], [], []
            for units, owners, _, some, numbers, new in part.contents(length, shared):
                all_new += new
                all_numbers.append(np.array(numbers, np.int64))
                docs.append(part.ids[owners[units.piece[some]]])
            if not all_new:
                continue
            least = _least(np.concatenate(all_numbers), np.concatenate(docs))
            number, name, rel, content = zip(*all_new, strict=True)
            number, name, rel = np.array(number, np.uint32), np.array(name, U), np.array(rel, np.uint8)
            doc = least[number]
            size = np.array([len(c) for c in content], np.uint16)
            for b, some in common.by_value(((name >> U(17)) % U(buckets)).astype(np.int64)):
                blob = b"".join(x[some].tobytes() for x in (doc, number, size, rel)) + b"".join(content[k] for k in some.tolist())
                yield pa.RecordBatch.from_pylist([{"slice": row["slice"], "bucket": b, "n": len(some), "blob": _squeeze(blob)}], schema=PACKED_ARROW)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices_, owners, docs, numbers, which = [], [], [], [], []
        known: dict[tuple[int, bytes], int] = {}
        for row in _rows(batches):
            n, blob = row["n"], _unzip(row["blob"])
            docs.append(np.frombuffer(blob, np.int64, n).copy())  # a view would keep the whole blob
            numbers.append(np.frombuffer(blob, np.uint32, n, 8 * n).copy())
            size = np.frombuffer(blob, np.uint16, n, 12 * n).tolist()
            rel = np.frombuffer(blob, np.uint8, n, 14 * n).tolist()
            at, ids = 15 * n, []
            for s, r in zip(size, rel, strict=True):
                ids.append(known.setdefault((r, blob[at : at + s]), len(known)))
                at += s
            which.append(np.array(ids, np.int64))
            owners.append(np.full(n, len(slices_), np.int64))
            slices_.append(row["slice"])
        if not slices_:
            return
        doc, number, owner, kind = (np.concatenate(x) for x in (docs, numbers, owners, which))
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, doc)
        contents = list(known)
        known.clear()
        counts = np.array([len(c) for _, c in contents], np.int64) - length + 1
        firsts = np.cumsum(counts) - counts
        found = np.empty(int(counts.sum()), np.int64)
        # Equal prefixes surround the same gram, so the grams' contents are sorted some at a time.
        parts = 1 + len(found) // SORTED
        part_of = np.array([zlib.crc32(c[r : r + GRAM]) % parts for r, c in contents])
        for part in range(parts):
            some = np.flatnonzero(part_of == part)
            if len(some):
                values = _smallest([contents[k] for k in some.tolist()], least[some], length)
                per = counts[some]
                found[np.repeat(firsts[some] - (np.cumsum(per) - per), per) + np.arange(len(values))] = values
        del contents
        # One bit for each prefix of a content that a smaller document has than the row's own.
        per = counts[kind]
        row_of = np.repeat(np.arange(len(kind)), per)
        place = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        bits = (found[firsts[kind][row_of] + place] < doc[row_of]).astype(U) << place.astype(U)
        masks = np.bitwise_or.reduceat(bits, np.cumsum(per) - per)
        some = np.flatnonzero(masks)
        by, edges = _cut(owner[some], len(slices_))
        for k, slice_ in enumerate(slices_):
            got = some[by[edges[k] : edges[k + 1]]]
            if len(got):
                yield pa.RecordBatch.from_pylist([{"slice": slice_, "blob": np.stack((number[got].astype(U), masks[got]), axis=1).tobytes()}], schema=BACK_ARROW)

    back = slices.mapInArrow(offer, PACKED).repartitionById(buckets, "bucket").mapInArrow(settle, BACK)
    return common.materialize(back.groupBy("slice").agg(F.collect_list("blob").alias("masks")), "masks")


def _least(number: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The smallest document of each number."""
    out = np.full(int(number.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(out, number, docs)
    return out


#: A mask of all prefixes of a unit.
ALL = U((1 << 64) - 1)


def cover(size: int, at: np.ndarray, count: np.ndarray, masks: np.ndarray, length: int) -> np.ndarray:
    """Which of ``size`` bytes lie in a marked prefix: of the units of ``count`` prefixes from ``at`` on, bit k of a mask marks the k-th."""
    edges = np.zeros(size + length + 1, np.int64)
    whole = masks == ALL
    begins, ends = [at[whole]], [at[whole] + count[whole] + length - 1]
    some = np.flatnonzero((masks != 0) & ~whole)
    for bit in range(int(count[some].max(initial=0))):
        got = some[(count[some] > bit) & (masks[some] >> U(bit) & U(1) != 0)]
        begins.append(at[got] + bit)
        ends.append(at[got] + bit + length)
    edges += np.bincount(np.concatenate(begins), minlength=len(edges))
    edges -= np.bincount(np.concatenate(ends), minlength=len(edges))
    return np.cumsum(edges[:size]) > 0


FOUND = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"
FOUND_ARROW = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _removed(slices: DataFrame, length: int) -> DataFrame:
    """Round 3: what is removed from each document of the slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            part = Slice(row["ids"], row["ends"], row["text"])
            shared = np.sort(np.frombuffer(b"".join(row["shared"] or []), U))
            told = np.frombuffer(b"".join(row["masks"] or []), U).reshape(-1, 2)
            heard = dict(zip(told[:, 0].tolist(), told[:, 1].tolist(), strict=True))
            held = []
            for units, owners, offsets, some, numbers, _ in part.contents(length, shared):
                # A unit's place in the slice: its piece's offset, and its place in the piece.
                piece_starts = np.cumsum(units.sizes) - units.sizes
                piece = units.piece[some]
                masks = np.array([heard.get(n, 0) for n in numbers], U)
                held.append((units.start[some] - piece_starts[piece] + offsets[piece], units.count[some], np.array(numbers, np.int64), part.ids[owners[piece]], masks))
            covered = np.zeros(len(part.text), bool)
            if held:
                at, count, number, docs, masks = (np.concatenate(x) for x in zip(*held, strict=True))
                covered = cover(len(part.text), at, count, np.where(docs > _least(number, docs)[number], ALL, masks), length)
            data = np.frombuffer(part.text, np.uint8)
            out = []
            for k, end in enumerate(part.ends.tolist()):
                start = int(part.ends[k - 1]) if k else 0
                gone = covered[start:end]
                edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                spans = [{"start": a, "stop": b} for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True)]
                kept = data[start:end][~gone].tobytes()
                out.append({"doc": int(part.ids[k]), "n_bytes": end - start, "n_removed": int(gone.sum()), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": spans})
            yield pa.RecordBatch.from_pylist(out, schema=FOUND_ARROW)

    return slices.mapInArrow(run, FOUND)


def find(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What is removed from each row of ``docs``: ``key``, n_bytes, n_removed, n_spans, kept_sha256, spans."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    keys = common.materialize(rows.select("doc", size.alias("n_bytes"), F.sha2("text", 256).alias("hash")), "text-keys")
    long = keys.where((F.col("n_bytes") >= length) & F.col("doc").isNotNull())
    first = long.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("hash", "first")
    copies = common.materialize(long.join(first, "hash").where("doc > first").select("doc", "hash").distinct(), "text-copies")
    few = copies.count() <= BROADCAST_IDS
    # A row is a copy by its id and its text, for rows may repeat an id with another text.
    marks = copies.select(F.col("doc"), F.col("hash"))
    left = rows.where((size >= length) & F.col("doc").isNotNull()).withColumn("hash", F.sha2("text", 256))
    left = left.join(F.broadcast(marks) if few else marks, ["doc", "hash"], "left_anti").select("doc", "text")
    total = long.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    slices = _pack_slices(left)
    slices = slices.join(_shared_names(slices, length, buckets), "slice", "left")
    masks = _repeated_prefixes(slices, length, buckets)
    found = _removed(slices.join(masks, "slice", "left"), length)
    empty = F.array().cast("array<struct<start:long,stop:long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    gone = long.join(copies, ["doc", "hash"], "left_semi").select("doc", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), whole.alias("spans"))
    same = keys.where((F.col("n_bytes") < length) | F.col("doc").isNull()).select("doc", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("hash").alias("kept_sha256"), empty.alias("spans"))
    return found.unionByName(gone).unionByName(same).withColumnRenamed("doc", key)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, strings of 50 bytes."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
