"""The block pipeline: stage rows, clean each closed block, bin, update models, report.

Every micro-batch is written to a staging folder of its own batch number, so a
retried batch replaces itself.  Blocks are processed once the newest event time
has passed their end by the allowed delay; outputs and models are stored under
the block's name, so processing a block again replaces them too.  ``finish``
treats the block still open at the end of the input.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import forecast as Fc
from tidemark.operators import forest
from tidemark.operators import series as S
from tidemark.operators.boosting import Boosting, Ensemble
from tidemark.operators.records import vendor_filter
from tidemark.schema import CLEAN_FEATURES, STREAM_CONTAMINATION, TREES, lag_count, resolution_seconds
from tidemark.session import checkpointed
from tidemark.sources.sinks import rebalanced, table_exists

PICKUP = "tpep_pickup_datetime"

# Block names, which sort in time order and suit folder names.
BLOCK_FORMAT = "%Y-%m-%dT%H-%M"
# Closed blocks cleaned in one pass, then learnt from one after another.
BLOCKS_AT_ONCE = 32

# ---- fixed values: the columns of a window's result --------------------------
WINDOW_RESULT = (
    "run_name string, window_index int, ts_start timestamp_ntz, ts_end timestamp_ntz, metric string, "
    "resolution string, vendor string, n_raw long, n_unusable long, n_anomaly long, n_clean long, "
    "anom_rate double, model_name string, mode string, status string, wape double, mae double, "
    "n_train long, detail string, seconds double"
)
# ---- end of fixed values ----------------------------------------------------

# (pipe, metric, series, block) -> result; see also :func:`together`.
Updater = Callable[..., dict]


@dataclass
class Settings:
    """What the pipeline forecasts, how it cleans and how often it updates."""

    metrics: tuple[str, ...] = ("trip_count", "total_amount")
    resolution: str = "1h"
    vendor: str = "all"
    block_hours: int = 24
    delay_hours: int = 1
    how: str = "mean"
    contamination: float | str = STREAM_CONTAMINATION
    trees: int = TREES
    features: tuple[str, ...] = tuple(CLEAN_FEATURES)
    models: tuple[str, ...] = ("boosted",)
    mode: str = "finetune"
    update_rounds: int = Fc.UPDATE_ROUNDS
    fresh_rounds: int = Fc.FRESH_ROUNDS
    depth: int = Fc.TREE_DEPTH
    lags: int | None = None
    update_every: dict[str, int] = field(default_factory=dict)
    max_bins: int = 4000
    max_windows: int = 0
    run_name: str = "stream"
    seed: int = 42


def together(updater):
    """Mark an updater that takes all metrics and a run of blocks at once: (pipe, blocks) -> {(metric, block): result}."""
    updater.together = True
    return updater


@together
def boosted_updates(pipe: "BlockPipeline", blocks: list[str]) -> dict[tuple[str, str], dict]:
    """Add trees to every metric's model by each block in turn, and store the models as of the last block."""
    c = pipe.settings
    ways = [Boosting(rounds, c.depth, Fc.STEP_SIZE, Fc.MIN_LEAF, Fc.ROW_SHARE, Fc.BINS, Fc.PATIENCE, c.seed)
            for rounds in (c.update_rounds, c.fresh_rounds)]
    done = checkpointed(Fc.update_in_turn(
        pipe.bins(blocks[0], blocks[-1]), pipe.model_rows("boosted"), ["metric"], blocks, c.resolution, c.mode, *ways,
        c.lags, c.max_bins))
    kept = done.filter((F.col("window") == blocks[-1]) & (F.size("roots") > 0))
    _replace_blocks(kept.withColumnRenamed("window", "block"), f"{pipe.folder}/models/boosted")
    # one row per metric and block
    told = done.select("metric", "window", "status", "wape", "mae", "n_train", "detail").collect()
    return {(r["metric"], r["window"]): r.asDict() for r in told}


UPDATERS: dict[str, Updater] = {"boosted": boosted_updates}


class BlockPipeline:
    """Cleans and learns block by block; all state lives in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None,
                 updaters: dict[str, Updater] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.settings = settings or Settings()
        self.updaters = updaters or UPDATERS

    # -- stored tables --------------------------------------------------------

    def _read(self, name: str) -> DataFrame | None:
        path = f"{self.folder}/{name}"
        return self.spark.read.parquet(path) if table_exists(self.spark, path) else None

    def telemetry(self) -> DataFrame:
        """One row per window, model and metric."""
        rows = self._read("telemetry")
        return self.spark.createDataFrame([], WINDOW_RESULT) if rows is None else rows.drop("block")

    def cleaned(self) -> DataFrame | None:
        """Cleaned records of all processed blocks."""
        return self._read("cleaned")

    def late(self) -> DataFrame | None:
        """Records that arrived after their block was processed, per batch."""
        return self._read("late")

    def progress(self) -> tuple[str, int]:
        """The newest processed block ("" before the first) and how many there are.

        Blocks are processed in time order, so all up to the newest are done; the
        names are folders, so no file is read.
        """
        rows = self._read("telemetry")
        if rows is None:
            return "", 0
        name = F.col("block").cast("string")
        found = rows.agg(F.max(name).alias("last"), F.count_distinct(name).alias("n")).first()
        return found["last"] or "", found["n"]

    def series(self, metric: str, up_to: str | None = None) -> DataFrame:
        """The newest bins of a metric's cleaned series, optionally up to a block.

        Blocks hold whole bins, so the newest block's value of a bin wins and
        nothing is merged.  With ``up_to`` only the folders that can hold the
        newest ``max_bins`` bin widths are read.
        """
        stored = self._read(f"series/{metric}")
        if stored is None:
            return self.spark.createDataFrame([], "ts timestamp_ntz, value double")
        stored = stored.withColumn("block", F.col("block").cast("string"))
        if up_to is not None:
            c = self.settings
            reach = dt.timedelta(seconds=c.max_bins * resolution_seconds(c.resolution), hours=c.block_hours)
            oldest = (dt.datetime.strptime(up_to, BLOCK_FORMAT) - reach).strftime(BLOCK_FORMAT)
            stored = stored.filter(F.col("block").between(oldest, up_to))
        newest = S.latest_per_key(stored.select("ts", "value", "block"), ["ts"], "block")
        return S.keep_newest(newest.select("ts", "value"), self.settings.max_bins)

    def bins(self, first: str, last: str) -> DataFrame:
        """Rows (metric, ts, value, window) of all metrics: the blocks from ``first`` to ``last``, and before them the
        newest ``max_bins`` bins of each metric.  Only folders that can hold those are read."""
        c = self.settings
        reach = dt.timedelta(seconds=c.max_bins * resolution_seconds(c.resolution), hours=c.block_hours)
        oldest = (dt.datetime.strptime(first, BLOCK_FORMAT) - reach).strftime(BLOCK_FORMAT)
        parts = [self.spark.createDataFrame([], "metric string, ts timestamp_ntz, value double, window string")]
        for metric in c.metrics:
            stored = self._read(f"series/{metric}")
            if stored is not None:
                window = F.col("block").cast("string")
                parts.append(stored.filter(window.between(oldest, last)).select(
                    F.lit(metric).alias("metric"), "ts", "value", window.alias("window")))
        newest = S.latest_per_key(reduce(DataFrame.unionByName, parts), ["metric", "ts"], "window")
        before = S.keep_newest(newest.filter(F.col("window") < first), c.max_bins, ["metric"])
        return newest.filter(F.col("window") >= first).unionByName(before)

    def model_rows(self, name: str) -> DataFrame:
        """The newest stored model of each metric, of blocks that are processed."""
        last, _ = self.progress()
        path = f"{self.folder}/models/{name}"
        if not _has_files(self.spark, path):  # no series was long enough yet
            return self.spark.createDataFrame([], f"metric string, {Fc.UPDATED}")
        stored = self.spark.read.parquet(path)
        block = F.col("block").cast("string")
        known = stored.withColumn("_block", block)
        known = known.filter(block <= last) if last else known
        return S.latest_per_key(known.drop("block"), ["metric"], "_block").drop("_block")

    def model(self, metric: str, name: str = "boosted") -> Fc.Forecaster | None:
        """The forecaster of a metric as of the last processed block."""
        c, row = self.settings, self.model_rows(name).filter(F.col("metric") == metric).first()
        if row is None:
            return None
        lags = c.lags or lag_count(c.resolution)
        return Fc.Forecaster(S.feature_names(c.resolution, lags), lags, c.resolution, Ensemble.of_row(row),
                             {k: row[k] for k in ("width_90", "width_95")})

    # -- stream ---------------------------------------------------------------

    def _block_of(self, ts: str = PICKUP):
        return F.date_format(C.bin_floor(F.col(ts), self.settings.block_hours * 3600), "yyyy-MM-dd'T'HH-mm")

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Stage a micro-batch, then process every block that has closed."""
        rows = batch.withColumn(PICKUP, F.col(PICKUP).cast("timestamp_ntz"))
        if "tpep_dropoff_datetime" in rows.columns:
            rows = rows.withColumn("tpep_dropoff_datetime", F.col("tpep_dropoff_datetime").cast("timestamp_ntz"))
        staged = f"{self.folder}/staged/batch={batch_id}"
        (rebalanced(vendor_filter(rows, self.settings.vendor).withColumn("block", self._block_of()), ["block"])
            .write.mode("overwrite").partitionBy("block").parquet(staged))
        last, _ = self.progress()
        if last and _has_files(self.spark, staged):
            behind = self.spark.read.parquet(staged).filter(F.col("block").cast("string") <= last)
            behind.groupBy("block").agg(F.count(F.lit(1)).alias("n_late")).write.mode(
                "overwrite").parquet(f"{self.folder}/late/batch={batch_id}")
        self._process_closed(final=False)
        self._prune()

    def _staged(self) -> DataFrame | None:
        path = f"{self.folder}/staged"
        if not table_exists(self.spark, path) or not _has_files(self.spark, path):
            return None
        return self.spark.read.option("recursiveFileLookup", "false").parquet(path)

    def _process_closed(self, final: bool) -> None:
        staged = self._staged()
        if staged is None:
            return
        last, n_done = self.progress()
        # block is a folder, so rows of processed blocks are not read again
        staged = staged.withColumn("block", F.col("block").cast("string")).filter(F.col("block") > last)
        # one row per open block
        spans = staged.groupBy("block").agg(F.max(PICKUP).alias("last")).collect()
        newest = max((r["last"] for r in spans), default=None)
        reach = dt.timedelta(hours=self.settings.block_hours + self.settings.delay_hours)
        due = sorted(
            r["block"] for r in spans
            if (final or dt.datetime.strptime(r["block"], BLOCK_FORMAT) + reach <= newest))
        if self.settings.max_windows:
            due = due[: max(self.settings.max_windows - n_done, 0)]
        for i in range(0, len(due), BLOCKS_AT_ONCE):
            part = due[i:i + BLOCKS_AT_ONCE]
            self.process(staged.filter(F.col("block").between(part[0], part[-1])).drop("batch"), part, n_done + i)

    def _prune(self) -> None:
        """Remove the staged rows of processed blocks; a retried batch would count them as late."""
        last, _ = self.progress()
        if last:
            for path, name in _folders(self.spark, f"{self.folder}/staged", "block="):
                if name <= last:
                    _delete(self.spark, path)

    def process(self, rows: DataFrame, blocks: list[str], first_index: int) -> None:
        """Clean blocks in one pass, extend the series, then update models block by block.

        ``rows`` carries its block name in ``block``.
        """
        c, began = self.settings, time.time()
        marked = forest.clean_blocks(rows, "block", list(c.features), c.contamination, c.trees, c.seed)
        spans = marked.groupBy("block").agg(F.min(PICKUP).alias("ts_start"), F.max(PICKUP).alias("ts_end"))
        # one row per block
        stats = {r["block"]: r for r in forest.cleaning_stats(marked, ["block"]).join(spans, "block").collect()}
        self.accumulate(forest.clean_rows(marked))
        results = self._updates(blocks, first_index)
        out = []
        for offset, block in enumerate(blocks):
            found = stats[block]
            for name in c.models:
                for metric in c.metrics:
                    result = results[name, metric, block]
                    out.append((
                        block, c.run_name, first_index + offset, found["ts_start"], found["ts_end"], metric, c.resolution, c.vendor,
                        found["n_raw"], found["n_unusable"], found["n_anomaly"], found["n_clean"], found["anom_rate"],
                        name, c.mode, result["status"], result.get("wape"), result.get("mae"),
                        result.get("n_train"), result.get("detail") or "", round(time.time() - began, 2)))
        # written last: a block counts as processed once its telemetry is there
        _replace_blocks(self.spark.createDataFrame(out, f"block string, {WINDOW_RESULT}").coalesce(1),
                        f"{self.folder}/telemetry")

    def _updates(self, blocks: list[str], first_index: int) -> dict[tuple[str, str, str], dict]:
        """The result of every model, metric and block; a model that learns in every so many blocks skips the others."""
        out = {}
        for name in self.settings.models:
            every, updater = self.settings.update_every.get(name, 1), self.updaters[name]
            learnt = [b for i, b in enumerate(blocks, first_index) if i % every == 0]
            for metric in self.settings.metrics:
                out.update({(name, metric, b): {"status": "skip"} for b in blocks})
            if getattr(updater, "together", False):
                made = updater(self, learnt) if learnt else {}
                missing = {"status": "warmup", "n_train": 0}  # a metric without any bin
                out.update({(name, m, b): made.get((m, b), missing) for m in self.settings.metrics for b in learnt})
            else:
                out.update({(name, m, b): self._one(updater, m, b) for b in learnt for m in self.settings.metrics})
        return out

    def _one(self, updater: Updater, metric: str, block: str) -> dict:
        try:
            return updater(self, metric, checkpointed(self.series(metric, block)), block)
        except (PySparkException, Py4JError):  # a failed job must be tried again, not recorded as done
            raise
        except Exception as error:  # one failing model must not stop the others
            return {"status": "error", "detail": f"{type(error).__name__}: {error}"[:300]}

    def accumulate(self, clean: DataFrame) -> None:
        """Store cleaned records and the bins of every metric, by block."""
        _replace_blocks(clean, f"{self.folder}/cleaned")
        names = [r[0] for r in clean.select("block").distinct().collect()]
        stored = self.spark.read.parquet(f"{self.folder}/cleaned").withColumn("block", F.col("block").cast("string"))
        stored = stored.filter(F.col("block").isin(names))
        for metric in self.settings.metrics:
            binned = S.bin_series(stored, metric, self.settings.resolution, self.settings.how, keys=["block"])
            _replace_blocks(binned, f"{self.folder}/series/{metric}")

    def run(self, stream: DataFrame, flush: bool = True) -> None:
        """Consume what the stream holds now, then treat the open block too."""
        query = (stream.writeStream.foreachBatch(self.on_batch)
                 .option("checkpointLocation", f"{self.folder}/offsets")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        if flush:
            self.finish()

    def start(self, stream: DataFrame, every: str = "10 seconds"):
        """Run continuously; stop with the returned query's ``stop()``."""
        return (stream.writeStream.foreachBatch(self.on_batch)
                .option("checkpointLocation", f"{self.folder}/offsets")
                .trigger(processingTime=every).start())

    def finish(self) -> None:
        """Process blocks that no later record has closed."""
        self._process_closed(final=True)

    # -- batch use ------------------------------------------------------------

    def _days(self, source: DataFrame, first, days: int) -> DataFrame:
        """Rows of some whole days, midnight to midnight, with their block."""
        low = F.lit(first).cast("date")
        rows = vendor_filter(source, self.settings.vendor).filter(
            (F.col(PICKUP) >= low.cast("timestamp_ntz")) & (F.col(PICKUP) < F.date_add(low, days).cast("timestamp_ntz")))
        return rows.withColumn("block", F.date_format(C.trunc_day(F.col(PICKUP)), "yyyy-MM-dd'T'HH-mm"))

    def prewarm(self, history: DataFrame, start: str, days: int = 30) -> None:
        """Clean each of the days before ``start`` on its own, then train once."""
        c = self.settings
        first = dt.date.fromisoformat(start[:10]) - dt.timedelta(days=days)
        rows = self._days(history, first, days)
        marked = forest.clean_blocks(rows, "block", list(c.features), c.contamination, c.trees, c.seed)
        self.accumulate(forest.clean_rows(marked))
        self._updates([f"{start[:10]}T00-00"], 0)

    def retrain(self, source: DataFrame, day: str) -> DataFrame:
        """Clean one day, update the models and return its telemetry."""
        block = f"{day}T00-00"
        rows = self._days(source, day, 1)
        if rows.isEmpty():
            return self.telemetry().limit(0)
        last, n_done = self.progress()
        self.process(rows, [block], n_done - (last == block))
        found = self.spark.read.parquet(f"{self.folder}/telemetry")
        return found.filter(F.col("block").cast("string") == block).drop("block")


def _replace_blocks(df: DataFrame, path: str) -> None:
    """Write by block, replacing only the blocks present in ``df``; a block is one file unless it is large."""
    (rebalanced(df, ["block"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("block").parquet(path))


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _folders(spark: SparkSession, path: str, prefix: str) -> list[tuple[str, str]]:
    """(path, value) of the partition folders two levels below ``path``."""
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return []
    return [(inner.getPath().toString(), inner.getPath().getName()[len(prefix):])
            for outer in fs.listStatus(where) if outer.isDirectory()
            for inner in fs.listStatus(outer.getPath()) if inner.getPath().getName().startswith(prefix)]


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _files(spark, path)
    fs.delete(where, True)


def _has_files(spark: SparkSession, path: str) -> bool:
    """Whether any parquet file lies under ``path``."""
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return False
    files = fs.listFiles(where, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False
