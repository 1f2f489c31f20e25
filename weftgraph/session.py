"""Sessions, and getting this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with UTC, AQE and Arrow; ``conf`` adds settings."""
    builder = SparkSession.builder.master(master).appName("weftgraph")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": memory,
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session's ``spark.checkpoint.dir`` names, set as its checkpoint folder.

    Where the setting is absent a local master gets a temporary folder; on a
    cluster, whose executors would not see it, that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, its lineage forgotten.

    Estimates are forgotten as well: a checkpoint keeps the size that was estimated
    for its plan, a join multiplies its sides' sizes, and a loop of joins over cut
    tables soon computes with numbers of millions of digits.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)
    if not hasattr(kept, "_jdf"):
        return kept
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), spark)


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application.

    Arrow functions are pickled by reference, so workers must be able to
    import the package even where it is not installed.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="weftgraph-src-")
    name = os.path.join(folder, "weftgraph_src.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
