"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased (A-Z) and reduced to words joined by one space, so that a window of words is one byte
string between spaces.  Patterns are windows of ``words`` consecutive benchmark words (all words of a shorter
item).  They are searched in length classes, each with a shift table over hashed blocks of the class's first
bytes: a block that no pattern holds lets the scan skip the class's length, suffix-hash buckets list the
patterns that may end where the shift is zero, and a direct comparison confirms each.  Many stretches of a
text are scanned side by side, one numpy step at a time.

The patterns are broadcast in shards of a bounded number of bytes; a larger benchmark takes more passes over
the documents, and the passes' results are joined by document.

Defined results: null has no words; empty texts have none; a null item id counts as an item and is written
as the empty string; repeated item rows count once; repeated document rows each get a row; an empty
benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common

WINDOW = 10
#: Bytes of benchmark text of one broadcast.  A window takes 40 bytes there and starts at a word, so at most 20 bytes go with
#: each of text, and 20 MB for the tables.
SHARD_BYTES = 6 << 20
#: Upper ends of the length classes of patterns, in bytes; a class's scan looks at the bytes of its shortest pattern.
CLASSES = (4, 8, 16, 32, 1 << 62)
TABLE_BITS = 20
LANES = 4096

#: ASCII bytes that are not 0-9 or letters become spaces, A-Z become a-z, the rest stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal(text: bytes) -> tuple[bytes, int]:
    """The words of ``text`` with a space before and after each, and their number."""
    words = text.translate(NORMAL).split(b" ")
    words = [w for w in words if w]
    return (b" " + b" ".join(words) + b" ") if words else b"", len(words)


class LengthClass:
    """Shift table and suffix-hash buckets of patterns of similar lengths: places in the items' common text.

    A bucket holds the patterns with the same block at the end of their first ``m`` bytes and the same eight bytes in
    front; it is a run of an array sorted by a hash of both.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, numbers: np.ndarray, m: int):
        self.m = m
        self.block = block = min(8, max(1, m // 2))
        self.mask, self.front = np.uint64((1 << (8 * block)) - 1), np.uint64((1 << (8 * min(8, m))) - 1)
        words = words_of(text)
        self.shift = np.full(1 << TABLE_BITS, m - block + 1, np.int32)
        for end in range(block, m + 1):
            np.minimum.at(self.shift, self.slot(words[starts + (end - block)] & self.mask), m - end)
        keys = self.key(words[starts + (m - block)] & self.mask, words[starts] & self.front)
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers = keys[order], numbers[order]

    @staticmethod
    def slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)

    @staticmethod
    def key(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        return (last * np.uint64(0x9E3779B97F4A7C15)) ^ (first * np.uint64(0xC2B2AE3D27D4EB4F))

    def candidates(self, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the ``n`` bytes of ``text`` and patterns whose bucket they fall into."""
        m, block = self.m, self.block
        words, hits = words_of(text), []
        lanes = max(1, min(LANES, n // 256))
        edges = np.linspace(0, max(0, n - m + 1), lanes + 1).astype(np.int64)
        at, stop = edges[:-1].copy(), edges[1:]
        live = at < stop
        at, stop = at[live], stop[live]
        while at.size:
            found = words[at + (m - block)] & self.mask
            step = self.shift[self.slot(found)]
            zero = np.flatnonzero(step == 0)
            if zero.size:
                hits.append(at[zero])
                step[zero] = 1
            at += step
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        spots = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        keys = self.key(words[spots + (m - block)] & self.mask, words[spots] & self.front)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        many = high - low
        offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(spots, many), self.numbers[np.repeat(low, many) + offset]


def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, of an array that ends with eight bytes more."""
    return np.ndarray((len(text) - 7,), np.uint64, text, 0, (1,))


class Patterns:
    """The search over all windows of some items: their texts in one buffer, and a place, a length and an item per window."""

    def __init__(self, items: list[tuple[str, bytes]], words: int = WINDOW):
        self.names = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.names)}
        parts, starts, lengths, counts, owners, at = [], [], [], [], [], 0
        for item, text in items:
            spelled, n = normal(text)
            if not n:
                continue
            spaces = np.flatnonzero(np.frombuffer(spelled, np.uint8) == 32)
            size = min(n, words)
            starts.append(at + spaces[: n - size + 1])
            lengths.append(spaces[size:] - spaces[: n - size + 1] + 1)
            counts.append(np.full(n - size + 1, size))
            owners.append(np.full(n - size + 1, number[item]))
            parts.append(spelled)
            at += len(spelled)
        self.text = b"".join(parts)
        none = np.zeros(0, np.int64)
        start, self.length, self.count, self.owner = (np.concatenate(x or [none]) for x in (starts, lengths, counts, owners))
        self.start, self.length, self.count, self.owner = start.astype(np.int64), self.length.astype(np.int32), self.count.astype(np.int16), self.owner.astype(np.int32)
        buffer, self.classes, low = np.frombuffer(self.text + bytes(8), np.uint8), [], 0
        for high in CLASSES:
            some = np.flatnonzero((self.length > low) & (self.length <= high))
            if len(some):
                self.classes.append(LengthClass(buffer, self.start[some], some.astype(np.int32), int(self.length[some].min())))
            low = high

    def find(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of a pattern in ``text``: where, and which."""
        buffer, places, which = np.frombuffer(text + bytes(8), np.uint8), [], []
        for c in self.classes:
            for at, p in zip(*(x.tolist() for x in c.candidates(buffer, len(text))), strict=True):
                begin, n = int(self.start[p]), int(self.length[p])
                if text[at : at + n] == self.text[begin : begin + n]:
                    places.append(at)
                    which.append(p)
        return np.array(places, np.int64), np.array(which, np.int64)

    def search(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its number of words, the hit word ranges (merged, ascending), the items found."""
        made = [normal(t) for t in texts]
        # One scan over all; no pattern holds the separator, so none crosses from text to text.
        joined = b"\n".join(t for t, _ in made)
        starts = np.cumsum([0] + [len(t) + 1 for t, _ in made])
        out = [(n, [], []) for _, n in made]
        at, which = self.find(joined)
        owners = np.searchsorted(starts, at, side="right") - 1
        for k in np.unique(owners).tolist():
            mine = owners == k
            spaces = np.flatnonzero(np.frombuffer(made[k][0], np.uint8) == 32)
            first = np.searchsorted(spaces, at[mine] - int(starts[k]))
            ranges = zip(first.tolist(), (first + self.count[which[mine]]).tolist(), strict=True)
            out[k] = (made[k][1], merge(list(ranges)), [self.names[x] for x in np.unique(self.owner[which[mine]]).tolist()])
        return out


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


HITS = "n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def find(docs: DataFrame, items: DataFrame, words: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Where windows of ``items`` occur in ``docs``: ``key``, n_words, spans of hit words, items.

    One pass and no shuffle while the items' texts are within ``shard_bytes``.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    bench = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    kind = rows.schema[key].dataType.simpleString()
    if shards > 1:
        rows = common.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    else:
        rows = rows.withColumn("row", F.lit(0).cast("long"))

    def scan(shard: int) -> DataFrame:
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)
        patterns = spark.sparkContext.broadcast(Patterns([(r["item"], r["text"].encode()) for r in part.collect()], words))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.release()
            search = patterns.value
            for batch in common.text_slices(batches, "text", 4 << 20):
                got = search.search(common.text_bytes(batch, "text"))
                if shard:  # the first pass has a row for every document
                    rows_ = pa.array([k for k, (_, s, _) in enumerate(got) if s], pa.int64())
                    batch, got = batch.take(rows_), [g for g in got if g[1]]
                spans = [[{"start": a, "stop": b} for a, b in s] for _, s, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([n for n, _, _ in got], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([x for _, _, x in got], pa.list_(pa.string()))],
                    names=[key, "row", "n_words", "spans", "items"],
                )

        return rows.select(key, "text", "row").mapInArrow(run, f"`{key}` {kind}, row long, {HITS}")

    if shards == 1:
        return scan(0).drop("row")
    parts = scan(0)
    for k in range(1, shards):
        parts = parts.unionAll(scan(k))
    both = parts.groupBy("row").agg(F.first(key).alias(key), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Spans of different passes may overlap: fold them into ascending, disjoint ones.
    folded = F.expr(
        "aggregate(array_sort(spans), cast(array() as array<struct<start:bigint,stop:bigint>>), (acc, x) -> "
        "if(size(acc) > 0 and x.start <= element_at(acc, -1).stop, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(x.stop, element_at(acc, -1).stop)))), "
        "concat(acc, array(x))))"
    )
    return both.select(key, "n_words", folded.alias("spans"), "items")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns from what :func:`find` gives."""
    hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.stop - x.start)")
    return found.select(key, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``."""
    return digest(find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


_WORDS = "list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS k, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS u(i) WHERE len(w) > 0
),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM d, ks, unnest(range(1, len(w) - k + 2)) AS u(i)
),
hits AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
words AS (SELECT DISTINCT doc_id, j FROM hits, unnest(range(i, i + k)) AS u(j)),
nh AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
ni AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
