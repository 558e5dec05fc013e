"""Similarity of bit sets: Tanimoto pairs, neighbour counts, Butina clusters, components, and splits by cluster."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import order
from lattica.operators.rounds import discard, settle


def sign_bits(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, bit: the positions of a vector's positive components."""
    return vectors.select(F.col(key).alias("key"), F.posexplode(vector).alias("bit", "x")).where("x > 0").select("key", "bit")


#: Bits of a block of sets; rows and columns of the matrices that meet at once.
BLOCK_BITS, STEP_ROWS, STEP_BITS = 1 << 17, 2048, 4096


def tanimoto_pairs(bits: DataFrame, cutoff: float) -> DataFrame:
    """Pairs a < b of bit sets (key, bit) at a distance of ``cutoff`` at most: a, b, both, either.

    Near sets' sizes are within a factor of 1 - cutoff, so they are in the same size band or in neighbouring ones.
    Blocks of such bands meet, a row for each pair of blocks, and their common bits are counted by matrix products:
    no pair is a row before it is known to be near.  Sets without bits are near to none.
    """
    near = 1 - cutoff
    sets = bits.groupBy(F.col("key").cast("long").alias("key")).agg(F.collect_set(F.col("bit").cast("long")).alias("bits")).withColumn("n", F.size("bits"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(near)) + 1e-9) if 0 < near < 1 else F.col("n") if near >= 1 else F.lit(0)
    sets = settle(sets.withColumn("band", band.cast("long")))
    loads = sets.groupBy("band").agg(F.ceil(F.sum("n") / BLOCK_BITS).cast("int").alias("blocks"))  # a row per band
    placed = sets.join(F.broadcast(loads), "band").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    blocks = settle(placed.groupBy("band", "block").agg(F.collect_list(F.struct("key", "bits")).alias("rows")))  # BLOCK_BITS of bits, about
    x = blocks.select(F.explode(F.array("band", F.col("band") + 1)).alias("to"), F.col("band").alias("i"), F.col("block").alias("x_block"), F.col("rows").alias("x"))
    y = blocks.select(F.col("band").alias("to"), F.col("block").alias("y_block"), F.col("rows").alias("y"))
    both = x.join(y, "to").where((F.col("i") < F.col("to")) | (F.col("x_block") <= F.col("y_block"))).select((F.col("i") == F.col("to")).alias("same_band"), "x_block", "y_block", "x", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.column("same_band")[k].as_py() and batch.column("x_block")[k].as_py() == batch.column("y_block")[k].as_py()
                yield from _near_pairs(batch.column("x")[k].values, batch.column("y")[k].values, near, one)

    return both.repartition(int(bits.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(count, "a long, b long, both int, either int")


def _near_pairs(x: pa.StructArray, y: pa.StructArray, near: float, one: bool) -> Iterator[pa.RecordBatch]:
    """Near pairs of two blocks, or of one with itself; each pair once."""
    kx, ky = (z.field("key").to_numpy() for z in (x, y))
    (ox, fx), (oy, fy) = ((z.field("bits").offsets.to_numpy().astype(np.int64), z.field("bits").values.to_numpy()) for z in (x, y))
    names = np.unique(np.concatenate((fx[ox[0] : ox[-1]], fy[oy[0] : oy[-1]])))
    fx, fy = np.searchsorted(names, fx), np.searchsorted(names, fy)
    nx, ny = np.diff(ox), np.diff(oy)
    for i in range(0, len(kx), STEP_ROWS):
        for j in range(0, len(ky), STEP_ROWS):
            hi, hj = min(i + STEP_ROWS, len(kx)), min(j + STEP_ROWS, len(ky))
            both = np.zeros((hi - i, hj - j), np.float32)
            for low in range(0, len(names), STEP_BITS):
                width = min(STEP_BITS, len(names) - low)
                both += _matrix(ox, fx, i, hi, low, width) @ _matrix(oy, fy, j, hj, low, width).T
            either = nx[i:hi, None] + ny[None, j:hj] - both
            fine = (both >= either * near - 1e-9) & (either > 0)
            fine &= (kx[i:hi, None] < ky[None, j:hj]) if one else kx[i:hi, None] != ky[None, j:hj]
            r, c = np.nonzero(fine)
            if len(r):
                a, b = kx[i + r], ky[j + c]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(both[r, c].astype(np.int32)), pa.array(either[r, c].astype(np.int32))], names=["a", "b", "both", "either"])


def _matrix(offsets: np.ndarray, bits: np.ndarray, start: int, stop: int, low: int, width: int) -> np.ndarray:
    """Rows ``start`` to ``stop`` over ``width`` columns from ``low`` on, as zeros and ones."""
    some = bits[offsets[start] : offsets[stop]] - low
    rows = np.repeat(np.arange(stop - start), np.diff(offsets[start : stop + 1]))
    inside = (some >= 0) & (some < width)
    out = np.zeros((stop - start, width), np.float32)
    out[rows[inside], some[inside]] = 1
    return out


def neighbour_counts(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, neighbours of every key, those without pairs included."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    return keys.select("key").join(ends.groupBy("key").agg(F.count("*").alias("neighbours")), "key", "left").select("key", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def butina(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, centre: sets in the order of neighbour count (more first, then larger key) become centres unless taken, and take their free neighbours.

    Done in rounds: a free key that comes before all its undecided neighbours is a centre, and its neighbours are no more
    undecided.  Every round settles at least the first key, usually a share of all.  Who takes a key is known at the end: of
    all centres around it the first in order, which may be found in a later round than others.
    """
    rank = F.struct(F.col("neighbours"), F.col("key"))
    first = settle(neighbour_counts(keys, pairs).select("key", rank.alias("rank")))
    edge = pairs.select(F.col("a").alias("key"), F.col("b").alias("other")).unionAll(pairs.select(F.col("b").alias("key"), F.col("a").alias("other")))
    edge = settle(edge.join(first.select(F.col("key").alias("other"), F.col("rank").alias("other_rank")), "other"))
    left, all_centres = first, None
    while True:
        ahead = edge.join(left.select(F.col("key").alias("other")), "other", "left_semi").groupBy("key").agg(F.max("other_rank").alias("ahead"))
        centres = settle(left.join(ahead, "key", "left").where(F.col("ahead").isNull() | (F.col("rank") > F.col("ahead"))).select("key"))
        all_centres = centres if all_centres is None else all_centres.unionAll(centres)
        beside = edge.join(centres.select(F.col("key").alias("other")), "other", "left_semi").select("key")
        before, left = left, settle(left.join(centres.unionAll(beside), "key", "left_anti"))
        if before is not first:
            discard(before)
        if not left.limit(1).count():
            break
    taken = edge.join(all_centres.select(F.col("key").alias("other")), "other", "left_semi").groupBy("key").agg(F.max_by("other", "other_rank").alias("centre"))
    return all_centres.select("key", F.col("key").alias("centre")).unionAll(taken.join(all_centres, "key", "left_anti").select("key", "centre"))


def components(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, component: the smallest key that pairs connect to.

    Links point from the larger key to the smaller.  In turn every key hands its larger partners to its least partner,
    and its smaller ones to the least of them, until all links are stars; a round is one written table.
    """
    point = lambda df, u, v: df.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    links, before = settle(point(pairs, "a", "b")), None
    while True:
        ends = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m"))
        up = ends.where("v > u").join(least, "u").select("v", F.least("u", "m").alias("m"))
        up = settle(point(up, "v", "m"))
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(least, "u")
        down = settle(point(down.select("v", "m"), "v", "m").unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        state = down.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        discard(links, up)
        links = down
        if state == before:
            break
        before = state
    found = links.select(F.col("u").alias("key"), F.col("v").alias("component"))
    return keys.select("key").distinct().join(found, "key", "left").select("key", F.coalesce("component", "key").alias("component"))


def fill_splits(clusters: DataFrame, shares: list[tuple[str, float]]) -> DataFrame:
    """cluster, split: largest clusters first, each into the split that is furthest below its target; of equals the first declared.

    ``clusters``: cluster, size.  Clusters of one size are dealt at once: the driver sees a row for each distinct size, and
    answers with runs of places that splits take in turn.
    """
    sizes = clusters.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()  # distinct sizes: the square root of all rows, about
    total = sum(r["size"] * r["n"] for r in sizes)
    goals, filled, runs, place = [share * total for _, share in shares], [0] * len(shares), [], 0
    for r in sizes:
        left = r["n"]
        while left:
            order_, times = _turns(goals, filled, r["size"], left)
            for k in order_:
                filled[k] += r["size"] * times
            runs.append((r["size"], place, place + len(order_) * times, [shares[k][0] for k in order_]))
            place += len(order_) * times
            left -= len(order_) * times
    spark = clusters.sparkSession
    table = spark.createDataFrame(runs, "size long, low long, high long, turns array<string>")
    placed = order.numbered(settle(clusters.select("cluster", F.col("size").cast("long").alias("size"))), [F.desc("size"), F.col("cluster")], "place")
    dealt = placed.join(F.broadcast(table), "size").where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))  # a few rows for each distinct size
    turn = ((F.col("place") - F.col("low")) % F.size("turns")).cast("int") + 1
    return dealt.select("cluster", F.element_at("turns", turn).alias("split"))


def _turns(goals: list[float], filled: list[int], size: int, left: int) -> tuple[list[int], int]:
    """Which splits take the next clusters of a size in turn, and how often that turn repeats unchanged."""
    lack, now, turn = [g - f for g, f in zip(goals, filled, strict=True)], list(filled), []
    while len(turn) < min(left, len(lack)):
        k = max(range(len(now)), key=lambda i: (goals[i] - now[i], -i))
        if k in turn:
            break
        turn.append(k)
        now[k] += size
    if len(turn) == 1:  # one split alone, until another lacks as much
        others = [x for i, x in enumerate(lack) if i != turn[0]]
        return turn, min(left, max(1, int((lack[turn[0]] - max(others)) // size))) if others else left
    outside = [x for i, x in enumerate(lack) if i not in turn]
    times = left // len(turn)
    if outside:  # until those in turn lack no more than one outside does
        times = min(times, int((min(lack[i] for i in turn) - max(outside)) // size))
    return (turn, times) if times > 1 else (turn[:1], 1)


def stratified_fill(clusters: DataFrame, strata: list[str], shares: list[tuple[str, float]]) -> DataFrame:
    """cluster, split: largest clusters first, each into the split that lacks most of the cluster's strata.

    ``clusters``: cluster, and a column with the number of its rows in each of ``strata``.  What a split lacks of a stratum
    is weighted by the cluster's share in it; clusters of one composition are dealt at once, as in :func:`fill_splits`.
    """
    size = reduce(lambda a, b: a + b, (F.col(x) for x in strata))
    kinds = clusters.groupBy(*strata).agg(F.count("*").alias("n")).orderBy(F.desc(size), *(F.desc(x) for x in strata)).collect()  # distinct compositions
    totals = [sum(r[x] * r["n"] for r in kinds) for x in strata]
    filled, runs, place = [[0] * len(strata) for _ in shares], [], 0
    for r in kinds:
        weight = [r[x] / sum(r[y] for y in strata) for x in strata]
        step = sum(w * r[x] / t for w, x, t in zip(weight, strata, totals, strict=True) if t)
        left = r["n"]
        while left:
            lack = [sum(w * (share - f / t) for w, f, t in zip(weight, filled[k], totals, strict=True) if t) for k, (_, share) in enumerate(shares)]
            turn, times = _turns(lack, [0.0] * len(shares), step, left)
            for k in turn:
                filled[k] = [f + r[x] * times for f, x in zip(filled[k], strata, strict=True)]
            runs.append((*(r[x] for x in strata), place, place + len(turn) * times, [shares[k][0] for k in turn]))
            place += len(turn) * times
            left -= len(turn) * times
    kinds_of = ", ".join(f"`{x}` long" for x in strata)
    table = clusters.sparkSession.createDataFrame(runs, f"{kinds_of}, low long, high long, turns array<string>")
    slim = clusters.select("cluster", *(F.col(x).cast("long").alias(x) for x in strata))
    placed = order.numbered(settle(slim), [F.desc(size), *(F.desc(x) for x in strata), F.col("cluster")], "place")
    dealt = placed.join(F.broadcast(table), strata).where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))  # a few rows for each composition
    return dealt.select("cluster", F.element_at("turns", ((F.col("place") - F.col("low")) % F.size("turns")).cast("int") + 1).alias("split"))


def shard_names(n: int) -> list[tuple[str, float]]:
    """Equal shares of shards s00, s01, ..."""
    return [(f"s{k:02d}", 1 / n) for k in range(n)]


def whole_clusters(clusters: DataFrame, shares: list[tuple[str, float]], shards: int) -> DataFrame:
    """cluster, split, shard: clusters dealt to splits, and those of the first split to shards; an empty shard is an error."""
    split = settle(fill_splits(clusters, shares))
    train = settle(clusters.join(split.where(F.col("split") == shares[0][0]).select("cluster"), "cluster", "left_semi"))
    shard = settle(fill_splits(train, shard_names(shards)))
    if shard.select("split").distinct().count() < shards:
        raise ValueError("a shard is empty")
    return split.join(shard.select("cluster", F.col("split").alias("shard")), "cluster", "left")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def generalised_tanimoto(x: Column, y: Column) -> Column:
    """dot / (|x|^2 + |y|^2 - dot), 0 where that is 0."""
    both = dot(x, y)
    either = dot(x, x) + dot(y, y) - both
    return F.when(either != 0, both / either).otherwise(0.0)
