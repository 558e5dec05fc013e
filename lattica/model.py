"""A fitted model: configuration, class tables and the global row, with merging, prediction and persistence."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import estimate, predict, refine, stats
from lattica.operators.graph import Graph
from lattica.sources import stores

FORMAT = 1
SCHEMA = "cid long, parent long, n long, mean double, msd double, level int"


@dataclass(frozen=True)
class Config:
    """What a class means (levels, depth, edge codes, neighbour level), and options that are read at prediction only."""

    levels: tuple[str, ...]
    depth: int
    edge_codes: tuple[str, ...] = ()
    neighbour_level: int | None = None
    minimum_support: int = 1
    shrinkage: str = "none"
    strength: float = 0.0

    def __post_init__(self) -> None:
        if not self.levels or self.depth < 0 or self.minimum_support < 1:
            raise ValueError("levels, depth and support must be positive")
        if self.neighbour_level == len(self.levels) or not self.depth:
            object.__setattr__(self, "neighbour_level", None)

    @property
    def digest(self) -> str:
        """Of what a class means; models merge only if theirs agree."""
        kept = {k: v for k, v in asdict(self).items() if k not in ("minimum_support", "shrinkage", "strength")}
        return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()

    @property
    def n_levels(self) -> int:
        return len(self.levels) + self.depth


@dataclass(frozen=True)
class Model:
    config: Config
    classes: DataFrame
    whole: DataFrame = field(repr=False)

    @staticmethod
    def labels(config: Config, graph: Graph) -> DataFrame:
        return refine.refine(graph, config.levels, config.depth, config.edge_codes, config.neighbour_level)

    @classmethod
    def fit(cls, config: Config, graph: Graph) -> Model:
        return cls(config, stats.class_stats(cls.labels(config, graph), graph.nodes), stats.global_stats(graph.nodes))

    def merge(self, *others: Model) -> Model:
        """Exactly the model of all corpora together, with this model's inference options."""
        if any(o.config.digest != self.config.digest for o in others):
            raise ValueError("the models' classes mean different things")
        rows = [m.whole.withColumn("k", F.lit(0)) for m in (self, *others)]
        return Model(self.config, stats.merge([m.classes for m in (self, *others)]), stats.merge(rows, ("k",)).drop("k"))

    def __add__(self, other: Model) -> Model:
        return self.merge(other)

    def with_params(self, **options) -> Model:
        """The same tables read under other inference options."""
        if wrong := set(options) - {"minimum_support", "shrinkage", "strength"}:
            raise ValueError(f"not inference options: {sorted(wrong)}")
        return Model(replace(self.config, **options), self.classes, self.whole)

    def truncate(self, depth: int) -> Model:
        if depth > self.config.depth:
            raise ValueError("a model can't be made deeper")
        return Model(replace(self.config, depth=depth), stats.truncate(self.classes, len(self.config.levels) + depth - 1), self.whole)

    def predict(self, graph: Graph) -> DataFrame:
        """Back-off predictions for the nodes of ``graph``; see :func:`lattica.operators.predict.back_off`."""
        classes, value = self.classes, "mean"
        if self.config.shrinkage != "none":
            classes = estimate.shrink(classes, self.whole, self.config.n_levels, self.config.shrinkage, self.config.strength)
            value = "shrunk"
        return predict.back_off(self.labels(self.config, graph), classes, self.whole, self.config.minimum_support, value)

    def predict_loo(self, graph: Graph) -> DataFrame:
        """Predictions for the training nodes, each left out of its classes; only plain and count-shrunk models have them."""
        if not estimate.supports_loo(self.config.shrinkage):
            raise ValueError(f"no leave-one-out prediction with {self.config.shrinkage}")
        return predict.leave_one_out(self.labels(self.config, graph), self.classes, graph.nodes, self.whole, self.config.minimum_support)

    def save(self, path: str) -> None:
        """Class tables by level, the global row, and last the configuration with the tables' digest: plain Parquet and JSON, written by Spark.

        A model there already is an error.  The configuration stands for the whole: without it nothing can be loaded.
        """
        spark = self.classes.sparkSession
        if stores.exists(spark, f"{path}/config"):
            raise ValueError(f"a model is at {path}")
        self.classes.write.mode("overwrite").partitionBy("level").parquet(f"{path}/classes")
        self.whole.write.mode("overwrite").parquet(f"{path}/whole")
        text = json.dumps(asdict(self.config) | {"format": FORMAT, "digest": self.config.digest, "content": _content(spark, path)})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str, verify: bool = False) -> Model:
        """Read a saved model; an unknown format, a digest that doesn't fit and a model that wasn't written to its end are errors.

        The number of classes is checked by the files' footers; ``verify`` reads all classes and checks their digest.
        """
        if not all(stores.committed(spark, f"{path}/{t}") for t in ("classes", "whole", "config")):
            raise ValueError(f"no whole model is at {path}")
        data = json.loads(spark.read.text(f"{path}/config").first()[0])
        if data.pop("format") != FORMAT:
            raise ValueError("unknown format")
        digest, content = data.pop("digest"), data.pop("content", None)
        config = Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})
        if config.digest != digest:
            raise ValueError("the configuration doesn't fit its digest")
        out = cls(config, spark.read.schema(SCHEMA).parquet(f"{path}/classes"), spark.read.parquet(f"{path}/whole"))
        if content is not None:
            found = _content(spark, path) if verify else f"{out.classes.count()}:"
            if not content.startswith(found):
                raise ValueError("the classes aren't those that were saved")
        return out


def _content(spark: SparkSession, path: str) -> str:
    """Number and hash sum of the classes as they are on disk: the same in any order of rows."""
    classes = spark.read.schema(SCHEMA).parquet(f"{path}/classes")
    n, total = classes.agg(F.count("*"), F.sum(F.xxhash64(*sorted(classes.columns)).cast("decimal(38,0)"))).first()
    return f"{n}:{total}"
