"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "cdrloom", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """Session for tests and benchmarks; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _named_folder(spark: SparkSession) -> str | None:
    """Shared folder from ``spark.checkpoint.dir``, None if the setting is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def _scratch(spark: SparkSession, prefix: str) -> str:
    """Folder of a session without the setting: fine on one machine, refused on a cluster."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names.

    Only a session without that setting (a local test) gets a scratch folder of
    its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_named_folder(spark) or _scratch(spark, "cdrloom-ckpt-"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """Fresh folder path every executor can reach, next to the checkpoints."""
    base = _named_folder(spark) or _scratch(spark, "cdrloom-work-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, key: str, waves: int = 4) -> DataFrame:
    """Rows dealt by a key to a fixed number of parts, ahead of much work per row.

    An adaptive plan joins parts by their bytes, so a few MB of short rows would
    end up in one task, whatever is done with each of them.  ``waves``: parts per
    core, at least; 1 where many short jobs read them.
    """
    context = df.sparkSession.sparkContext
    parts = max(waves * context.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, key)
