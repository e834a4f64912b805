"""Models of many series as a table: trained together, promoted as a version, joined by the series they serve.

A row is the model of one (metric, resolution, vendor): its lags and features, the node arrays of its trees, and its band
widths.  Versions are folders, written aside and renamed, so readers see a version whole or not at all.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.joins import join_on
from tidemark.operators import calibration as Cal
from tidemark.operators import forecast as Fc
from tidemark.operators import series as S
from tidemark.operators.boosting import ENSEMBLE, Boosting, Ensemble, fit_models
from tidemark.schema import SERIES_KEYS, lag_count, resolution_seconds
from tidemark.session import checkpointed, stored_lookup

# Rows of a series that meet one copy of its model; a block of 60 features takes 5 MB.
SCORE_ROWS = 10_000
ENSEMBLE_COLUMNS = [c.split()[0] for c in ENSEMBLE.split(", ")]


def _groups(resolutions: list[str]) -> list[tuple[str, list[str]]]:
    """Resolutions of equal features, each group with one that stands for it."""
    groups: dict[tuple, list[str]] = {}
    for r in resolutions:
        groups.setdefault(tuple(S.feature_names(r)), []).append(r)
    return [(members[0], members) for members in groups.values()]


def _features(rows: DataFrame, names: list[str]) -> DataFrame:
    """Features as one array, and the block of the series that a row lies in."""
    x = F.array(*[F.col(n).cast("double") for n in names]).alias("_x")
    return rows.select(*SERIES_KEYS, "ts", F.col("value").cast("double").alias("value"), x,
                       F.floor(F.col("_pos") / SCORE_ROWS).alias("_block"))


def _scored(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``rows`` with the forecast of their series' model: a block of rows meets one copy of the model."""
    place = [*SERIES_KEYS, "_block"]
    rows = checkpointed(rows)
    blocks = rows.select(*[F.col(c).alias(c) for c in place]).distinct()  # under new names, as both sides of the cogroup have them
    copies = join_on(blocks, models.select(*SERIES_KEYS, *ENSEMBLE_COLUMNS), SERIES_KEYS)
    schema = T.StructType([rows.schema[c] for c in (*SERIES_KEYS, "ts", "value")] + [T.StructField("forecast", T.DoubleType())])

    def predict(block: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(model):
            return pd.DataFrame(columns=schema.names)
        x = np.vstack(block["_x"].to_numpy()) if len(block) else np.zeros((0, 1))
        return block[schema.names[:-1]].assign(forecast=Ensemble.of_row(model.iloc[0]).predict(x))

    return rows.groupBy(*place).cogroup(copies.groupBy(*place)).applyInPandas(predict, schema)


def train_models(
    series: DataFrame, resolutions: list[str], depth: int = Fc.TREE_DEPTH, rounds: int | None = None, seed: int = 42,
) -> DataFrame:
    """A model per series of ``metric, resolution, vendor, ts, value``, those of equal features in one pass.

    A model learns the first 80 % of its series; the rest chooses the number of
    rounds and gives the band widths.  Series that are too short have no row.
    """
    out = []
    for one, members in _groups(resolutions):
        names = S.feature_names(one)
        chosen = rounds or (Fc.MINUTE_ROUNDS if resolution_seconds(one) < 3600 else Fc.ROUNDS)
        how = Boosting(chosen, depth, Fc.STEP_SIZE, Fc.MIN_LEAF, Fc.ROW_SHARE, Fc.BINS, Fc.PATIENCE, seed)
        rows = checkpointed(Fc.training_rows(series.filter(F.col("resolution").isin(members)), one, SERIES_KEYS))
        learn = rows.select(*SERIES_KEYS, *names, "value", "part", F.xxhash64("ts").alias("_id"))
        fitted = fit_models(learn, SERIES_KEYS, names, "value", how, Fc._alike(names))
        held = _scored(_features(rows.filter("part = 'holdout'"), names), fitted)
        widths = Fc.holdout_widths(held, SERIES_KEYS).select(*SERIES_KEYS, "width_90", "width_95")
        described = fitted.withColumns({"lags": F.lit(lag_count(one)), "features": F.array(*map(F.lit, names))})
        out.append(join_on(described, stored_lookup(widths), SERIES_KEYS).select(
            *SERIES_KEYS, "lags", "features", *ENSEMBLE_COLUMNS, "n_train", "n_holdout", "trees", "width_90", "width_95"))
    return checkpointed(reduce(DataFrame.unionByName, out))


# -- the table ----------------------------------------------------------------

def _hadoop(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, where, where.getFileSystem(conf)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that were promoted, oldest first."""
    _, _, where, fs = _hadoop(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def promote(models: DataFrame, path: str) -> int:
    """Store models as the next version and return its number.

    They are written to a hidden folder, which is then renamed.  The rename fails
    where the version exists, so of two promoters at a time the later one gets
    the number after it.  The models of series that are not given stay in force.
    """
    spark = models.sparkSession
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    models.write.parquet(staged)
    jvm, conf, source, _ = _hadoop(spark, staged)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf)
    keep = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    number = max(versions(spark, path), default=0) + 1
    while True:
        try:
            files.rename(files.makeQualified(source), files.makeQualified(
                jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version={number}")), keep)
            return number
        except Py4JJavaError as error:
            if number not in versions(spark, path):
                raise error
            number += 1


def registered(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The model of each series in force, or as it was at an earlier version; ``version`` tells where a model is from."""
    known = [v for v in versions(spark, path) if version is None or v <= version]
    if not known:
        raise FileNotFoundError(f"no models in {path}")
    rows = spark.read.option("basePath", path).parquet(*[f"{path.rstrip('/')}/version={v}" for v in known])
    # only keys and folder names are read here
    newest = rows.groupBy(*SERIES_KEYS).agg(F.max("version").alias("version"))
    return join_on(rows, stored_lookup(newest), [*SERIES_KEYS, "version"], "left_semi")


def forecaster(models: DataFrame, metric: str, resolution: str, vendor: str) -> Fc.Forecaster | None:
    """The registered model of one series, or None."""
    key = dict(zip(SERIES_KEYS, (metric, resolution, vendor)))
    row = models.filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in key.items()])).first()
    if row is None:
        return None
    return Fc.Forecaster(list(row["features"]), row["lags"], resolution, Ensemble.of_row(row),
                         {w: row[w] for w in ("width_90", "width_95")})


def score_registered(series: DataFrame, models: DataFrame, start: str, end: str, level="95") -> DataFrame:
    """One-step forecasts of all registered series over a range, with each model's band, in one plan.

    ``series`` holds ``metric, resolution, vendor, ts, value``.  Series without
    a model give no rows.
    """
    models = checkpointed(models)
    # one row per series
    resolutions = sorted(r[0] for r in models.select("resolution").distinct().collect())
    if not resolutions:
        raise ValueError("no models")
    wanted = join_on(series, stored_lookup(models.select(*SERIES_KEYS)), SERIES_KEYS, "left_semi")
    wanted = checkpointed(wanted.select(*SERIES_KEYS, "ts", "value"))
    parts = []
    for one, members in _groups(resolutions):
        rows = Fc.rows_in_range(wanted.filter(F.col("resolution").isin(members)), lag_count(one), one, start, end, SERIES_KEYS)
        parts.append(_features(rows, S.feature_names(one)))
    scored = _scored(reduce(DataFrame.unionByName, parts), models).withColumnRenamed("value", "actual")
    column = Cal.LEVEL_WIDTHS[Cal.level_of(level)]
    if column is None:
        return scored
    own = stored_lookup(models.select(*SERIES_KEYS, F.col(column).alias("half_width")))
    return Fc.with_band(join_on(scored, own, SERIES_KEYS))
