"""Session, table loading and lineage cutting."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "quillspark", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """The running session, or a new one with the engine's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | (conf or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan gives fewer partitions than there are: a small input before heavy work a row.

    A large input has partitions enough and passes unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode; on a cluster an error.

    A machine-local folder would hold only the part of a table that executors of that machine wrote.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quillspark-shared-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


_LOCAL: list[str] = []


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Unlike a cached or locally checkpointed frame the result survives the loss of any executor, and, being columnar and
    compressed, takes a fraction of the space that checkpoint() needs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> bool:
    """Delete the tables that cut_lineage left in the shared folder; frames that read them can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillspark")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
