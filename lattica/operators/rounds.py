"""Tables between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def _scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def settle(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Cut the plan between rounds: ``df`` as a table written to the shared folder, which outlives lost executors.

    ``tidy``: the write's shuffles are deleted when it ends, not when the driver next collects its garbage.
    """
    path = f"{_scratch(df.sparkSession).rstrip('/')}/rounds/{uuid.uuid4().hex}"
    conf, clean = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(clean)
    conf.set(clean, "true" if tidy else before)
    try:
        df.write.parquet(path)
    finally:
        conf.set(clean, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`settle` that no later round reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.settled_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
