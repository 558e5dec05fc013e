"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed over cells of source, language and topic.  A factor for each value of each of the three
is fitted in turn until the cells' tokens, times their factors, have the target marginals.  A document's
probability is its cell's weight times a common scale, 1 at most, and a hash of its id decides, so the same table
always gives the same sample.  Cells and weights are tables; nothing but a few totals reaches the driver.

Without explicit targets a marginal's shares are its token shares to the power ``temper``: large sources, languages
and topics give way to small ones.

Defined results: null values of a dimension are a value of their own; a null text has no tokens, and a cell without
tokens keeps weight 1; a target for a value that no document has is left out, and a value without a target gets
none of the sample; rows that repeat an id are kept or dropped together if they share a cell; an empty table gives
an empty result; other columns are passed on, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common

TEMPER, KEEP, TOLERANCE, SWEEPS = 0.7, 0.7, 1e-5, 500
DIMENSIONS = ("source", "lang", "topic")
UNIT = 1 << 53


def form_of(text: str = "text") -> Column:
    """The form of a text (prose, table, figures and so on): what stands in for a topic in tables that have none."""
    t = F.coalesce(F.col(text), F.lit(""))
    size = F.greatest(F.length(t), F.lit(1))
    rate = lambda letters: 1 - F.length(F.translate(t, letters, "")) / size
    return (
        F.when(F.length(t) < 120, "short")
        .when(rate("|\t") > 0.02, "table")
        .when(rate("#$%&*{}<>=;") > 0.05, "symbols")
        .when(rate("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.3, "capitals")
        .when(rate("0123456789") > 0.05, "figures")
        .otherwise("prose")
    )


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _value(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> DataFrame:
    """Weights of ``cells`` (one column per dimension, and ``tokens``) that bring them to ``targets``.

    ``targets``: for each dimension a table (value, share).  Gives ``cells`` with a column ``weight``.  A sweep fits the
    dimensions in turn in one plan over the cells, and ends after it moved no weight by more than ``tolerance``.  Targets
    that ``sweeps`` sweeps don't reach so closely are an error.
    """
    dims = list(targets)
    full = cells.where("tokens > 0")
    total = full.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("weight", F.lit(1.0))
    now = full.withColumn("weight", F.lit(1.0))
    for d in dims:
        there = full.select(F.col(d).alias("value")).distinct().join(targets[d], "value", "left").select("value", F.coalesce("share", F.lit(0.0)).cast("double").alias("share"))
        whole = there.agg(F.sum("share").alias("all"))
        goal = there.crossJoin(F.broadcast(whole)).select(F.col("value").alias(d), F.when(F.col("all") > 0, F.col("share") / F.col("all") * float(total)).otherwise(0.0).alias(f"_goal_{d}"))  # one row with the total
        now = now.join(goal, d)
    now = common.materialize(now, "raked")
    for _ in range(sweeps):
        new = now.withColumn("_old", F.col("weight"))
        for d in dims:
            sums = new.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("_now"))
            fitted = F.when(F.col("_now") > 0, F.col("weight") * F.col(f"_goal_{d}") / F.col("_now")).otherwise(0.0)
            new = new.join(sums, d).withColumn("weight", fitted).drop("_now")
        new = common.materialize(new, "raked")
        moved = new.agg(F.max(F.abs(F.col("weight") - F.col("_old")) / F.greatest(F.col("_old"), F.lit(1e-300)))).first()[0]
        now = new.drop("_old")
        if moved is None or moved < tolerance:
            break
    else:
        raise ValueError(f"after {sweeps} sweeps weights still moved by {moved}, more than {tolerance}")
    return cells.join(now.select(*dims, "weight"), dims, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def tempered(cells: DataFrame, dimension: str, temper: float) -> DataFrame:
    """Shares of a dimension's values: their token shares to a power."""
    sums = cells.where("tokens > 0").groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens"))
    return sums.select("value", F.pow(F.col("tokens").cast("double"), F.lit(temper)).alias("share"))


def scale_for(weights: DataFrame, keep: float) -> float:
    """The scale at which min(1, scale * weight) of each cell's tokens add up to ``keep`` of all tokens."""
    tokens, product = F.col("tokens"), F.col("tokens") * F.col("weight")
    total, free = weights.agg(F.sum(tokens), F.sum(product)).first()
    if not total or not free:
        return 1.0
    scale, capped = keep * total / free, -1
    while True:
        full = F.col("weight") * F.lit(scale) >= 1
        whole, rest, cells = weights.agg(F.sum(F.when(full, tokens)), F.sum(F.when(~full, product)), F.count(F.when(full, 1))).first()
        if cells == capped or not rest:
            return scale
        capped = cells
        scale = max(scale, (keep * total - (whole or 0)) / rest)


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, keep: float = KEEP, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, seed: int = 0, carry: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with four more columns, and their names by what they hold: tokens, weight, probability, kept.

    With ``carry`` texts are evaluated once: rows with their cells and tokens are written, with those columns of ``docs`` that
    it names.  Without, all columns are passed on, and texts are read twice rather than written once more.
    """
    names = {n: f"_{n}_{uuid.uuid4().hex}" for n in (*DIMENSIONS, "tokens", "weight", "probability", "kept")}
    carried = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(UNIT)) / F.lit(float(UNIT))
    made = docs.select(
        *carried,
        _value(F.col(source)).alias(names["source"]),
        _value(F.col(lang)).alias(names["lang"]),
        _value(form_of(text) if topic is None else topic).alias(names["topic"]),
        token_count(text).alias(names["tokens"]),
        draw.alias(names["kept"]),
    )
    if carry is not None:
        made = common.materialize(made, "mixed")
    cells = made.groupBy(*(F.col(names[d]).alias(d) for d in DIMENSIONS)).agg(F.sum(names["tokens"]).alias("tokens"))
    cells = common.materialize(cells, "cells")
    weights = common.materialize(rake(cells, targets or {d: tempered(cells, d, temper) for d in DIMENSIONS}), "weights")
    scale = scale_for(weights, keep)
    table = weights.select(*(F.col(d).alias(names[d]) for d in DIMENSIONS), F.col("weight").alias(names["weight"]))
    out = made.join(table, [names[d] for d in DIMENSIONS])
    chance = F.least(F.lit(1.0), F.col(names["weight"]) * F.lit(scale))
    out = out.withColumn(names["probability"], chance).withColumn(names["kept"], F.col(names["kept"]) < chance)
    return out.drop(*(names[d] for d in DIMENSIONS)), names


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs``, with its columns."""
    out, names = mixed(docs, **options)
    return out.where(F.col(names["kept"])).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, probability and draw of every document, raked to tempered marginals."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    out, names = mixed(docs, carry=["doc_id"])
    return out.select("doc_id", F.col(names["tokens"]).alias("n_tokens"), F.col(names["weight"]).alias("weight"), F.col(names["probability"]).alias("probability"), F.col(names["kept"]).alias("kept"))
