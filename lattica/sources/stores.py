"""Reading stores, record files and run logs; writing samples and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators import order
from lattica.operators.groups import isolated
from lattica.operators.rounds import settle

SPLITS = ("train", "val", "test")


def load_store(spark: SparkSession, path: str, splits: tuple[str, ...] = SPLITS, split_column: str = "split", limit: int | None = None, ordinal: str | None = None) -> DataFrame:
    """Rows of a Parquet store whose split was asked for; the filter reaches the scan.

    ``limit`` keeps the first rows by ``ordinal``, before the split is looked at.  An unknown split is an error.
    """
    if unknown := set(splits) - set(SPLITS):
        raise ValueError(f"unknown splits {sorted(unknown)}")
    repair(spark, path)
    rows = spark.read.parquet(path)
    if limit is not None:
        if ordinal is None:
            raise ValueError("a limit needs an ordinal column")
        rows = rows.orderBy(ordinal).limit(limit)
    return rows.where(F.col(split_column).isin(*splits))


def load_shards(spark: SparkSession, path: str, shards: list[str], column: str = "shard") -> DataFrame:
    """Rows of some shards; of a store written by shard only their folders are read."""
    return spark.read.parquet(path).where(F.col(column).isin(*shards))


def write_store(rows: DataFrame, path: str, by: str | None = None, split_column: str = "split", member: str | None = None) -> DataFrame:
    """Write a store and give its summary: rows, and distinct members, of each split."""
    (rows.write.partitionBy(by) if by else rows.write).parquet(path)
    written = rows.sparkSession.read.parquet(path)
    return written.groupBy(split_column).agg(F.count("*").alias("n_rows"), *([F.countDistinct(member).alias("n_members")] if member else []))


def records(spark: SparkSession, path: str, separator: str = "$$$$\n") -> DataFrame:
    """Multi-line records of text files, with their number in their file from 0 on: file, number, record.

    Spark splits large files at the separator, so a file needs no task of its own.  Rows of one split are numbered where they
    were read; what a file has before a split is a running sum over its splits, a row for each.  Empty records have no number.
    """
    lines = spark.read.option("lineSep", separator).text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("record"))
    rows = settle(rows.where(F.trim("record") != ""))
    splits = rows.groupBy("file", "_from").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("file").orderBy("_from")) - F.col("_n")
    place = F.row_number().over(Window.partitionBy("file", "_from").orderBy("_at")) - 1
    out = rows.withColumn("_place", place).join(splits.select("file", "_from", ahead.alias("_ahead")), ["file", "_from"])
    return out.select("file", (F.col("_ahead") + F.col("_place")).alias("number"), "record")


def typed_records(rows: DataFrame, scalars: dict[str, str], lists: dict[str, str], required: tuple[str, ...], length: str, separator: str = "|") -> tuple[DataFrame, DataFrame]:
    """Two tables from one scan of ``rows`` (file, number, record), keyed by file and number: accepted records, and rejected ones with ``reason``.

    ``scalars`` are fields and their types, ``lists`` fields of values between separators and the type of a value.  A record
    is rejected, by the first reason that holds, if a required field is missing, if a value isn't of its type, if ``length`` (one of
    the scalars) is null or a list has another number of values than it tells.  A list that a record lacks is null unless it is required.
    """
    text = lambda c: F.trim(record_field(c))
    cut = lambda c: F.split(text(c), f"\\Q{separator}\\E", -1)
    wide = rows.select("file", "number", *(text(c).alias(f"_{c}") for c in scalars), *(cut(c).alias(f"_{c}") for c in lists))
    value = {c: F.expr(f"try_cast(`_{c}` AS {t})") for c, t in scalars.items()} | {c: F.expr(f"transform(`_{c}`, x -> try_cast(trim(x) AS {t}))") for c, t in lists.items()}
    wide = settle(wide.select("*", *(v.alias(c) for c, v in value.items())))
    reason = None
    tests = [(F.col(f"_{c}").isNull(), f"{c} is missing") for c in required]
    tests += [(F.col(f"_{c}").isNotNull() & F.col(c).isNull(), f"{c} is not {t}") for c, t in scalars.items()]
    tests += [(F.exists(c, lambda x: x.isNull()), f"{c} has values that are not {t}") for c, t in lists.items()]
    tests += [(F.col(length).isNull(), f"{length} is missing")] if lists else []
    tests += [(F.size(c) != F.col(length), f"{c} has another length") for c in lists]
    for test, why in tests:
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    judged = wide.withColumn("reason", F.lit(None).cast("string") if reason is None else reason)
    fine = judged.where("reason IS NULL").select("file", "number", *scalars, *lists)
    return fine, judged.where("reason IS NOT NULL").select("file", "number", "reason")


def with_ordinals(rows: DataFrame, group: str, prefix: str, to: str) -> DataFrame:
    """``rows`` (file, number, ...) with an id ``to`` made of ``prefix`` and their place in their group, in the order of files."""
    out = order.numbered_within(rows, [group], [F.col("file"), F.col("number")], "_place")
    return out.withColumn(to, F.concat(F.lit(prefix), F.col("_place").cast("string"))).drop("_place")


def record_field(name: str) -> Column:
    """The line after ``> <name>`` in a record, null without it."""
    found = F.regexp_extract("record", rf"(?m)^>\s*<{name}>[^\n]*\n([^\n]*)", 1)
    return F.when(found != "", found)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Metrics of run folders ``<root>/<experiment>/<run>/metrics.json``: experiment, run, metric, value; values that aren't finite fall out."""
    files = spark.read.option("wholetext", True).text(f"{root}/*/*/metrics.json")
    parts = F.split(F.regexp_replace(F.input_file_name(), "/part-[^/]*$", ""), "/")
    rows = files.select(F.element_at(parts, -3).alias("experiment"), F.element_at(parts, -2).alias("run"), F.explode(F.from_json("value", "map<string,double>")).alias("metric", "value"))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """experiment, run, field, text of ``manifest.json`` files, one level deep."""
    files = spark.read.option("wholetext", True).text(f"{root}/*/*/manifest.json")
    parts = F.split(F.regexp_replace(F.input_file_name(), "/part-[^/]*$", ""), "/")
    return files.select(F.element_at(parts, -3).alias("experiment"), F.element_at(parts, -2).alias("run"), F.explode(F.from_json("value", "map<string,string>")).alias("field", "text"))


def report(rows: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A pivot of "mean ± std (n)" texts."""
    cell = F.format_string("%.4f ± %.4f (%d)", F.avg(value), F.coalesce(F.stddev_pop(value), F.lit(0.0)), F.count(value))
    return rows.groupBy(row).pivot(column).agg(cell)


def markdown(table: DataFrame) -> str:
    """A small result table as Markdown."""
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    lines += ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in table.toLocalIterator()]
    return "\n".join(lines)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, path)
    return files.exists(where)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: Spark's marker comes last."""
    return exists(spark, f"{path}/_SUCCESS")


def repair(spark: SparkSession, path: str) -> bool:
    """Put back what :func:`replace_store` left beside ``path`` if it ended between its two renames; whether there was something.

    Whole new rows go first, then the old ones; a copy without Spark's last marker is never used.
    """
    where, files = _files(spark, path)
    if files.exists(where):
        return False
    to = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    for kind in ("new", "old"):
        for status in files.globStatus(to(f"{path.rstrip('/')}.{kind}-*")) or []:
            found = status.getPath().toString()
            if committed(spark, found):
                return bool(files.rename(to(found), where))
    return False


def replace_store(rows: DataFrame, path: str) -> DataFrame:
    """Write ``rows`` beside ``path`` and put them in its place.

    Two renames: between them nothing is at ``path``, and a reader of that moment gets an error, never half a table.  A
    run that ends there leaves whole rows beside it, which :func:`repair` puts back; :func:`stage`, :func:`annotate` and
    :func:`load_store` call it first.
    """
    spark, mark = rows.sparkSession, uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    rows.write.parquet(new)
    where, files = _files(spark, path)
    to = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    had = files.exists(where)
    if had and not files.rename(where, to(old)):
        raise OSError(f"{path} can't be moved")
    if not files.rename(to(new), where):
        if had:
            files.rename(to(old), where)
        raise OSError(f"{path} can't be written")
    if had:
        files.delete(to(old), True)
    return spark.read.parquet(path)


def annotate(spark: SparkSession, path: str, columns: dict[str, Column], stale: tuple[str, ...] = ()) -> DataFrame:
    """Add derived columns to a store in place; columns that they make stale go."""
    repair(spark, path)
    return replace_store(spark.read.parquet(path).drop(*stale).withColumns(columns), path)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; it is made first unless it was written to its end before."""
    repair(spark, path)
    return spark.read.parquet(path) if committed(spark, path) else replace_store(make(), path)


def _text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def cached(spark: SparkSession, path: str, key: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept at ``path`` for ``key``; the key is written last, and another key there is an error."""
    said = json.dumps(key, sort_keys=True)
    if committed(spark, f"{path}/key"):
        if spark.read.text(f"{path}/key").first()[0] != said:
            raise ValueError(f"{path} was made for another key")
        return spark.read.parquet(f"{path}/rows")
    out = replace_store(make(), f"{path}/rows")
    _text(spark, f"{path}/key", said)
    return out


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a store, from its files' footers."""
    return spark.read.parquet(path).count()


def drop_isolated(spark: SparkSession, path: str, group: list[str], record: str, y: str, threshold: float) -> dict:
    """Drop records with a value that is isolated in its group from a store, once: the summary beside it tells by the row count."""
    summary = f"{path.rstrip('/')}.curated"
    if committed(spark, summary):
        said = json.loads(spark.read.text(summary).first()[0])
        if said["rows_after"] == row_count(spark, path) and said["threshold"] == threshold:
            return said
    rows = spark.read.parquet(path)
    before = rows.count()
    bad = isolated(rows, group, y, threshold).where("isolated").select(record).distinct()
    after = replace_store(rows.join(bad, record, "left_anti").select(rows.columns), path).count()
    said = {"rows_before": before, "rows_after": after, "threshold": threshold}
    _text(spark, summary, json.dumps(said))
    return said


def check_domain(rows: DataFrame, column: str, allowed: tuple) -> DataFrame:
    """``rows``, of which one with another value of ``column`` is an error when it is read."""
    fine = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit(f"{column} can't be "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("boolean")
    return rows.where(F.when(fine, True).otherwise(wrong))


def load_states(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Auxiliary states; a column that an older file lacks is null."""
    return spark.read.schema(schema).parquet(path)


def ragged(rows: DataFrame, key: str, values: str) -> DataFrame:
    """key, at, value: the elements of an array column."""
    return rows.select(key, F.posexplode(values).alias("at", "value"))


def write_run(spark: SparkSession, root: str, experiment: str, run: str, metrics: dict[str, float], manifest: dict[str, str], predictions: DataFrame | None = None) -> None:
    """Predictions, metrics and manifest of a run as tables of one line; the manifest is written last and stands for all."""
    at = f"{root}/{experiment}/{run}"
    if committed(spark, f"{at}/manifest.json"):
        raise ValueError(f"{at} was written before")
    if predictions is not None:
        replace_store(predictions, f"{at}/predictions")
    _text(spark, f"{at}/metrics.json", json.dumps(metrics))
    _text(spark, f"{at}/manifest.json", json.dumps(manifest))


def commits(manifests: DataFrame, field: str = "commit") -> DataFrame:
    """experiment and the distinct commits that its runs were made with."""
    return manifests.where(F.col("field") == field).groupBy("experiment").agg(F.sort_array(F.collect_set("text")).alias("commits"))


def flatten(config: dict, prefix: str = "") -> dict[str, object]:
    """A nested configuration as names with dots."""
    out: dict[str, object] = {}
    for k, v in config.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def configured(defaults: dict, given: dict, overrides: tuple[str, ...] = ()) -> dict[str, object]:
    """``defaults`` with what was given, and ``a.b=value`` overrides (values as JSON, else text); an unknown name is an error."""
    out = flatten(defaults)
    new = flatten(given)
    for item in overrides:
        name, _, text = item.partition("=")
        try:
            new[name] = json.loads(text)
        except ValueError:
            new[name] = text
    if unknown := set(new) - set(out):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return out | new
