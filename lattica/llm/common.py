"""Helpers that the training-data operators share: scratch tables, deterministic range
shards, committed binary files and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins of a level of the histograms behind :func:`range_shards`, of which the driver sees one row each, and shards.
HISTOGRAM_BINS, MOST_SHARDS = 1 << 16, 1 << 15
#: Rows of an Arrow batch between Spark and the Python workers.
BATCH_ROWS = 1000


_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir``; only a local session that has none gets a temporary one.
    """
    small_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        root = _local[app]
    if "://" not in root:  # a path without a scheme means the default file system, as everywhere in Spark
        root = spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()).resolve("/").toString().rstrip("/") + root if root.startswith("/") else root
        root = "file://" + root.removeprefix("file:") if root.startswith("file:/") and not root.startswith("file://") else root
    return f"{root.rstrip('/')}/lattica/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session have BATCH_ROWS rows at most: texts are long, and a batch is held twice."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_written: list[list[DataFrame]] = []


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, with a folder for each value of ``by``, and read it back:
    cuts the lineage, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _written:
        _written[-1].append(out)
    return out


def settle(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` as by :func:`materialize`; then the tables that it wrote on its way, and their shuffles, are deleted.

    Only for steps whose tables nothing else reads.
    """
    spark, clean = SparkSession.active(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")  # every write plans its shuffles anew, so no later step asks for these
    _written.append([])
    try:
        out = materialize(make(), name)
    finally:
        made = _written.pop()
        spark.conf.set(clean, before)
    discard(*made[:-1])
    if _written:
        _written[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later step reads."""
    for t in tables:
        drop_path(t.sparkSession, t.scratch_path)


def drop_path(spark: SparkSession, uri: str) -> None:
    """Delete a scratch path by Hadoop's file system API, which knows every store that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_held: dict = {}


def held(key, make: Callable):
    """What a Python worker keeps from task to task: one object, made anew when another ``key`` is asked for."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drop what the worker keeps, and give its memory back: tasks that need it for other things begin with this."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable) -> Callable:
    """``run`` over batches, with :func:`release` before and after: idle workers stay beside those of later tasks."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return tidy


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices whose ``column`` holds about ``most`` bytes at most; a longer text is a slice alone."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8; null becomes the empty text."""
    values = batch.column(column)
    values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
    return [x or b"" for x in values.to_pylist()]


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values, by a sort: numpy's own function may go through a much slower hash table."""
    ordered = np.sort(values)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


def by_value(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value that occurs, and where: work in proportion to the values, not to their range."""
    order = np.argsort(values, kind="stable")
    firsts = np.flatnonzero(np.append(True, values[order][1:] != values[order][:-1])) if len(values) else []
    for rows in np.split(order, firsts[1:]) if len(values) else []:
        yield int(values[rows[0]]), rows


_EXACT = "decimal(38,0)"  # a difference of two longs can exceed a long
_NODES = "_node int, _bin long, _next int, _next_low decimal(38,0), _next_width decimal(38,0), _first int, _parts int"


class Shards:
    """How an integer key is cut into ascending shards: a tree of bins, a table for each of its levels."""

    def __init__(self, low: int, width: int):
        self.low, self.width, self.levels, self.count = low, width, [], 1

    def place(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` with the leaf of each row: ``_first`` shard, and the ``_parts`` that share it if one key fills several."""
        out = df.withColumns({"_node": F.lit(0), "_low": F.lit(self.low).cast(_EXACT), "_width": F.lit(self.width).cast(_EXACT), "_first": F.lit(None).cast("int"), "_parts": F.lit(None).cast("int")})
        for table in self.levels:
            nodes = F.broadcast(df.sparkSession.createDataFrame(table, _NODES).withColumnsRenamed({"_first": "_f", "_parts": "_p", "_node": "_n"}))  # HISTOGRAM_BINS rows, about
            found = out.withColumn("_at", self.bin_of(key)).join(nodes, (F.col("_node") == F.col("_n")) & (F.col("_at") == F.col("_bin")), "left")
            out = found.withColumns({"_first": F.coalesce("_first", "_f"), "_parts": F.coalesce("_parts", "_p"), "_node": F.col("_next"), "_low": F.col("_next_low"), "_width": F.col("_next_width")}).drop("_at", "_n", "_bin", "_next", "_next_low", "_next_width", "_f", "_p")
        return out

    @staticmethod
    def bin_of(key: str):
        """The key's bin, by whole division: a quotient of decimals is rounded to few digits before it could be floored."""
        return F.call_function("div", F.col(key).cast(_EXACT) - F.col("_low"), F.col("_width")).cast("long")

    def add(self, df: DataFrame, key: str, sub, to: str = "_shard") -> DataFrame:
        """``df`` with its shard; null keys go to shard 0.  ``sub`` (0 to 2^32 - 1) parts the rows of a key that fills several."""
        shard = F.col("_first") + F.when(F.col("_parts") > 1, F.floor(sub * F.col("_parts") / float(1 << 32)).cast("int")).otherwise(0)
        return self.place(df, key).withColumn(to, F.coalesce(shard, F.lit(0))).drop("_node", "_low", "_width", "_first", "_parts")


def range_shards(slim: DataFrame, key: str, weight: str, target: int) -> Shards:
    """Shards of about ``target`` of ``weight`` each, MOST_SHARDS at most, from a written table of keys and weights.

    They depend on the rows alone.  A histogram over equal key ranges is taken, bins that weigh more than the target get a
    histogram of their own, and so on down to single keys, so far outliers and dense runs do no harm.  The driver sees
    HISTOGRAM_BINS rows of a level, about.
    """
    low, high, total = slim.where(F.col(key).isNotNull()).agg(F.min(key), F.max(key), F.sum(weight)).first()
    if low is None:
        return Shards(0, 1)
    target = max(target, int(total or 0) // MOST_SHARDS)
    out = Shards(int(low), max(1, -(-(int(high) - int(low) + 1) // HISTOGRAM_BINS)))
    rows, nodes, leaves = slim.where(F.col(key).isNotNull()), {0: (out.low, out.width)}, []
    while nodes:
        placed = out.place(rows, key).where("_first IS NULL AND _node IS NOT NULL").withColumn("_bin", out.bin_of(key))
        sums = placed.groupBy("_node", "_bin").agg(F.sum(weight).cast("double").alias("w")).collect()
        heavy = [r for r in sums if (r["w"] or 0) > target and nodes[r["_node"]][1] > 1]
        fine, table, further, number = max(2, HISTOGRAM_BINS // max(1, len(heavy))), [], {}, 1 + max(nodes)
        for r in sums:
            start, width = nodes[r["_node"]][0] + r["_bin"] * nodes[r["_node"]][1], nodes[r["_node"]][1]
            row = {"_node": r["_node"], "_bin": r["_bin"], "_next": None, "_next_low": None, "_next_width": None, "_first": None, "_parts": None}
            if (r["w"] or 0) > target and width > 1:
                row |= {"_next": number, "_next_low": Decimal(start), "_next_width": Decimal(max(1, -(-width // fine)))}
                further[number] = (start, int(row["_next_width"]))
                number += 1
            else:
                leaves.append((start, r["w"] or 0.0, row))
            table.append(row)
        out.levels.append(table)
        nodes = further
    shard, total = 0, 0.0
    for _, w, row in sorted(leaves, key=lambda x: x[0]):
        if total and total + min(w, target) > target:
            shard, total = shard + 1, 0.0
        row["_parts"] = max(1, -(-int(w) // target))
        row["_first"] = shard
        shard, total = (shard + row["_parts"], 0.0) if row["_parts"] > 1 else (shard, total + w)
    out.count = shard + 1
    out.levels = [[tuple(r.values()) for r in t] for t in out.levels]
    return out


MANIFEST = "name string, temp string, shard int, part int, rows long, bytes long, sha256 string"


def commit_files(manifest: DataFrame) -> None:
    """Give every file of a written manifest its final name.

    The manifest lists only files of task attempts that Spark committed.  A rename that was done before
    the executor died is recognised by the final file's size, so the step can run again.
    """

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                store, temp = fs.FileSystem.from_uri(row["temp"])
                _, final = fs.FileSystem.from_uri(row["name"])
                there = store.get_file_info(final)
                if store.get_file_info(temp).type == fs.FileType.File:
                    store.move(temp, final)
                elif there.type != fs.FileType.File or there.size != row["bytes"]:
                    raise OSError(f"neither {row['temp']} nor a whole {row['name']} exists")
                done.append(row["name"])
            yield pa.RecordBatch.from_pydict({"name": pa.array(done, pa.string())})

    manifest.select("name", "temp", "bytes").mapInArrow(rename, "name string").agg(F.count("*")).collect()


def write_file(uri_dir: str, name: str, data: bytes) -> tuple[str, str]:
    """Write ``data`` below ``_temporary`` under a name no other attempt has; gives the temporary and the final URI."""
    from pyarrow import fs

    temp = f"{uri_dir}/_temporary/{name}.{uuid.uuid4().hex}"
    store, path = fs.FileSystem.from_uri(temp)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)
    return temp, f"{uri_dir}/{name}"


def binary_files(spark: SparkSession, paths: DataFrame | str, columns: str, parse: Callable, pattern: str) -> DataFrame:
    """Read whole files through Spark's own reader and parse each by ``parse`` (bytes to record batches)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from parse(batch.column(0)[k].as_buffer())

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths).select("content")
    return files.mapInArrow(run, columns)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable vertex of every vertex of ``edges``: columns ``v``, ``component``.

    Alternates the large-star and small-star steps until the edges are stars.  Each step keeps the
    number of edges linear, aggregates before it shuffles, and joins back on a key that Spark may split
    when it is hot; every round is written to the shared folder.  Null ends and loops are ignored.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = materialize(small, "links")
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    stars = links.select(F.col("u").alias("v"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("v"), "component").distinct())
