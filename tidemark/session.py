"""Session helpers: settings, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A broadcast side may hold at most this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
# Bytes a row and a field take besides what they hold.
ROW_BYTES, FIELD_BYTES = 32, 16


def build_session(app: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a temporary folder, because executors elsewhere cannot read it.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage there.

    Used for frames that several later steps read.  A frame that is already
    stored comes back as it is.
    """
    if getattr(df, "_stored", False):
        return df
    shared_folder(df.sparkSession)
    stored = df.checkpoint(eager=True)
    stored._stored = True
    return stored


def stored_lookup(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Store a derived lookup frame, and hint a broadcast when it came out small in bytes.

    Without the hint Spark joins by shuffle and splits skewed partitions at run
    time.  A frame that was looked up before is not measured again.
    """
    size = getattr(df, "_bytes", None)
    if size is None:
        text = F.octet_length(F.to_json(F.struct("*"))) + ROW_BYTES + FIELD_BYTES * len(df.columns)
        measure = F.coalesce(F.sum(text), F.lit(0)).alias("bytes")
        if getattr(df, "_stored", False):
            size = df.agg(measure).first()[0]
        else:
            seen = Observation()
            df = checkpointed(df.observe(seen, measure))
            size = seen.get["bytes"]
        df._bytes = size
    return F.broadcast(df) if size <= max_bytes else df
