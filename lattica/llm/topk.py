"""Exact top-k search with a bit-sliced index.

The index holds blocks of rows.  A block keeps, for every attribute (component quantised to an integer), one
bitmap for each bit of its value less the attribute's least value in the block.  A query's scores are summed
over bitmaps: a slice of weight 2^i is counted once for each signed power of two of the query's component,
shifted by i, positive and negative powers in separate sums, by carry-save adders; the two sums' slices give
the score's slices.
The top rows are selected from the most significant slice downward; rows that tie on every slice at the
boundary are resolved by their ids.  Every row is indexed and every score exact.

The index streams past broadcast queries, which come in shards of a bounded number of bytes, one pass for each; every task
keeps its best rows for each query, so only these are shuffled.

Defined results: vectors that are null or hold a null or non-finite component take no part; vectors are
compared with those of their own length; an empty vector scores 0 with others of length 0; rows that repeat
a vec_id are rows of their own, and a query skips all rows of its id; rows with a null id take no part.
Vectors with a component beyond 2^24 after scaling are kept in blocks of their own, whose numbers are Python's; a score
beyond a long counts as the nearest long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import common

SCALE = 256
#: Rows of an index block, and bytes of queries of a broadcast.
BLOCK_ROWS, QUERY_BYTES = 1 << 14, 16 << 20
MOST, LONG = 1 << 24, (1 << 63) - 1


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part: ``id`` and ``x``, the components."""
    fine = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(F.col(vector), lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where(fine).select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda v: v.cast("double")).alias("x"))


def integers(x: np.ndarray) -> np.ndarray:
    """Components quantised: 64-bit integers, or Python's where one is large."""
    scaled = x * SCALE  # a power of two: exact, or infinite for a component that is nearly so
    if np.isfinite(scaled).all():
        scaled = np.floor(scaled)
        return scaled.astype(np.int64) if not scaled.size or np.abs(scaled).max() <= MOST else np.array([[int(v) for v in row] for row in scaled.tolist()], object).reshape(x.shape)
    return np.array([[int(v) * SCALE if abs(v) > 1 << 53 else int(np.floor(v * SCALE)) for v in row] for row in x.tolist()], object).reshape(x.shape)


def slices_of(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Least value of each attribute, and (attribute, bit, bitmap) for every bit that some row has."""
    low = x.min(axis=0)
    up = (x - low).T
    out = []
    for d in range(up.shape[0]):
        for bit in range(int(up[d].max()).bit_length()):
            out.append((d, bit, np.packbits((up[d] >> bit) & 1)))
    return low, out


def pad(bitmap: np.ndarray) -> np.ndarray:
    """The bitmap as 64-bit words."""
    return np.pad(bitmap, (0, -len(bitmap) % 8)).view(np.uint64)


def add_slices(columns: list[np.ndarray]) -> list[np.ndarray | None]:
    """Bit slices, least first, of the sum of bitmaps: the rows of ``columns[w]`` count 2^w each.

    Full adders turn three bitmaps of a weight into one of it and a carry of the next weight; all triples
    of a weight are added by the same few numpy calls.
    """
    out, carries, w = [], [], 0
    while w < len(columns) or carries:
        column = np.concatenate([*columns[w : w + 1], *carries])
        carries = []
        while len(column) > 2:
            n = len(column) // 3
            a, b, c = column[:n], column[n : 2 * n], column[2 * n : 3 * n]
            half = a ^ b
            carry = half & c
            carry |= a & b
            half ^= c
            carries.append(carry)
            column = np.concatenate((half, column[3 * n :])) if len(column) > 3 * n else half
        if len(column) == 2:
            carries.append(column[:1] & column[1:])
            column = column[:1] ^ column[1:]
        out.append(column[0] if len(column) else None)
        w += 1
    return out


def digits(value: int) -> Iterator[tuple[int, int]]:
    """(sign, shift) of the non-adjacent form of ``value``: its fewest signed powers of two."""
    shift = 0
    while value:
        if value & 1:
            sign = 2 - (value & 3)
            yield sign, shift
            value -= sign
        value >>= 1
        shift += 1


def subtract(a: list, b: list, words: int) -> list[np.ndarray]:
    """Slices of a - b in two's complement, the sign slice last."""
    zero = np.zeros(words, np.uint64)
    n = max(len(a), len(b)) + 1
    carry, out = ~zero, []
    for i in range(n):
        x = a[i] if i < len(a) and a[i] is not None else zero
        y = ~(b[i] if i < len(b) and b[i] is not None else zero)
        half = x ^ y
        out.append(half ^ carry)
        carry = (x & y) | (half & carry)
    return out


def select_top(slices: list[np.ndarray], among: np.ndarray, k: int, ids: np.ndarray) -> np.ndarray:
    """Rows of the k largest scores of those in ``among``; ties at the boundary go to smaller ids.

    ``slices``: most significant last, the sign slice at the end (a set bit is a negative score).
    """
    sure, tied = np.zeros_like(among), among
    if int(np.bitwise_count(among).sum()) > k:
        for i in range(len(slices) - 1, -1, -1):
            bits = ~slices[i] if i == len(slices) - 1 else slices[i]
            with_bit = tied & bits
            n = int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(with_bit).sum())
            if n > k:
                tied = with_bit
            elif n < k:
                sure, tied = sure | with_bit, tied & ~bits
            else:
                sure, tied = sure | with_bit, np.zeros_like(tied)
                break
    rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8))[: len(ids)])
    first, rest = rows(sure), rows(tied)
    return np.concatenate((first, rest[np.argsort(ids[rest], kind="stable")][: k - len(first)]))


class Block:
    """A block of the index, ready to answer queries."""

    def __init__(self, ids: np.ndarray, low: list[int], slices: list[tuple[int, int, bytes]]):
        self.ids, self.low = ids, low
        self.words = -(-len(ids) // 64)
        self.of: dict[int, list[tuple[int, int]]] = {}
        for n, (d, bit, _) in enumerate(slices):
            self.of.setdefault(d, []).append((bit, n))
        self.bitmaps = np.stack([pad(np.frombuffer(raw, np.uint8)) for _, _, raw in slices]) if slices else np.zeros((0, self.words), np.uint64)
        self.every = pad(np.packbits(np.ones(len(ids), np.uint8)))

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        sides: dict[int, list[list[int]]] = {1: [], -1: []}
        for d, value in enumerate(query.tolist()):
            for sign, shift in digits(value):
                for bit, n in self.of.get(d, ()):
                    side = sides[sign]
                    while len(side) <= bit + shift:
                        side.append([])
                    side[bit + shift].append(n)
        plus, minus = (add_slices([self.bitmaps[np.array(c, np.int64)] for c in sides[sign]]) for sign in (1, -1))
        scores = subtract(plus, minus, self.words)
        among = self.every
        if (mine := self.ids == own).any():
            among = among & ~pad(np.packbits(mine))
        rows = select_top(scores, among, k, self.ids)
        # What every row of the block scores for the attributes' least values is added back.
        base = sum(a * b for a, b in zip(query.tolist(), self.low, strict=True))
        total = [base] * len(rows)
        for i, s in enumerate(scores):
            bits = (s.view(np.uint8)[rows >> 3] >> (7 - (rows & 7)).astype(np.uint8)) & 1
            weight = -(1 << i) if i == len(scores) - 1 else 1 << i
            total = [t + weight if bit else t for t, bit in zip(total, bits.tolist(), strict=True)]
        return [(int(self.ids[r]), t) for r, t in zip(rows, total, strict=True)]


INDEX = "dim int, block string, ids binary, low string, slices array<struct<d:int,bit:int,bitmap:binary>>"
SLICES = pa.list_(pa.struct([("d", pa.int32()), ("bit", pa.int32()), ("bitmap", pa.binary())]))


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors) of ``most`` rows at most, of one length and with or without large components; a partition's rest comes last."""
    held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        ids = batch.column("id").to_numpy()
        x = batch.column("x")
        dims = x.value_lengths().to_numpy(zero_copy_only=False)
        flat, offsets = x.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(dims)))
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            got = flat[(offsets[rows][:, None] + np.arange(dim)).astype(np.int64)] if dim else np.zeros((len(rows), 0))
            large = (np.abs(got) * SCALE > MOST).any(axis=1)
            for kind in np.unique(large).tolist():
                some = large == kind
                held.setdefault((dim, kind), []).append((ids[rows[some]], got[some]))
                if sum(len(i) for i, _ in held[dim, kind]) >= most:
                    i, v = (np.concatenate(y) for y in zip(*held.pop((dim, kind)), strict=True))
                    while len(i) >= most:
                        yield i[:most], integers(v[:most])
                        i, v = i[most:], v[most:]
                    if len(i):
                        held[dim, kind] = [(i, v)]
    for parts in held.values():
        i, v = (np.concatenate(y) for y in zip(*parts, strict=True))
        yield i, integers(v)


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index of ``vectors`` as a written table of blocks of ``block_rows`` rows at most."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _runs(batches, block_rows):
            low, slices = slices_of(x) if x.shape[1] else (np.zeros(0, np.int64), [])
            row = {"dim": x.shape[1], "block": str(ids[0]), "ids": ids.astype(np.int64).tobytes(), "low": json.dumps(low.tolist()), "slices": [{"d": d, "bit": b, "bitmap": m.tobytes()} for d, b, m in slices]}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("block", pa.string()), ("ids", pa.binary()), ("low", pa.string()), ("slices", SLICES)]))

    rows = quantised(vectors, key, vector)
    n = rows.count()
    rows = rows.repartition(max(1, -(-n // block_rows)))
    return common.materialize(rows.mapInArrow(pack, INDEX), "bit-slices")


def search(index: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``k`` highest scores of each query: query_id, rank, vec_id, score."""
    spark = index.sparkSession
    asked = quantised(queries, key, vector).withColumn("bytes", 8 * F.size("x") + 64)
    total = asked.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-total // query_bytes))
    asked = common.materialize(asked.withColumns({"n": F.monotonically_increasing_id()}).withColumn("shard", F.pmod(F.xxhash64("n"), F.lit(shards))), "queries")
    found = []
    for shard in range(shards):  # a pass over the index for each QUERY_BYTES of queries
        rows = asked.where(F.col("shard") == shard).select("n", "id", "x").toArrow()
        vectors = [(n, q, integers(np.array([x]).reshape(1, -1))[0]) for n, q, x in zip(*(rows.column(c).to_pylist() for c in ("n", "id", "x")), strict=True)]
        held = spark.sparkContext.broadcast(vectors)

        def answer(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[int, list[tuple[int, int]]]] = {}
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    block = Block(np.frombuffer(row["ids"], np.int64), json.loads(row["low"]), [(s["d"], s["bit"], s["bitmap"]) for s in row["slices"]])
                    for n, q, x in held.value:
                        if len(x) == row["dim"]:
                            got = best.get(n, (q, []))[1] + block.top(x, q, k)
                            best[n] = (q, sorted(got, key=lambda r: (-r[1], r[0]))[:k])
            out = [(n, q, i, max(-LONG - 1, min(LONG, s))) for n, (q, rows) in best.items() for i, s in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["n", "query_id", "vec_id", "score"])

        part = index.mapInArrow(answer, "n long, query_id long, vec_id long, score long")
        found.append(common.materialize(part, "nearest"))
        held.unpersist()
    every = found[0]
    for part in found[1:]:
        every = every.unionAll(part)
    order = Window.partitionBy("n").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest by integer inner product of every fiftieth vector, among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(build(vectors), vectors.where("vec_id % 50 = 0"), 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
