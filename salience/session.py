"""Session helpers shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder the cluster names.

    ``spark.checkpoint.dir`` wins when it is set.  Without it only a session whose
    tasks run in the driver's process (unit tests) gets a folder of its own; on a
    cluster, where such a folder would not be shared, this raises a ValueError.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="salience-checkpoints-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared checkpoint folder and read it back.

    A written table survives lost executors, lets later reads prune columns,
    and carries no constraints over; those of a plain checkpoint pile up from
    round to round in iterative plans and slow the optimizer down.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Number of tasks a CPU-heavy stage should be cut into."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder for a written table."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
