"""Kernel models by random Fourier features (Rahimi and Recht, 2007)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import scalar_quantiles
from tidemark.operators import anomaly as A
from tidemark.operators.forest import with_model_features
from tidemark.schema import time_feature_names
from tidemark.session import checkpointed

# ---- fixed values -----------------------------------------------------------
NOVELTY_NU = 0.05
# ---- end of fixed values ----------------------------------------------------


def scaling(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature; a constant column has deviation 0."""
    row = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                 *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return {f: (row[f"m_{f}"], row[f"s_{f}"]) for f in features}


def standardize(df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """Replace features by (x - mean) / population deviation per group; constants give 0."""
    from tidemark.functions.ordering import per_group

    stats = df.groupBy(*(keys or [])).agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    joined = per_group(df, stats, keys or [])
    scaled = {
        f: F.when(F.col(f"_s_{f}") > 0, (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")))
        .when(F.col(f).isNotNull(), F.lit(0.0)) for f in features
    }
    return joined.withColumns(scaled).drop(*[f"_m_{f}" for f in features], *[f"_s_{f}" for f in features])


@dataclass
class FourierMap:
    """Scaled features and a random cosine map approximating an RBF kernel."""

    features: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    zeroed: list[int] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], size: int = 128, seed: int = 42) -> "FourierMap":
        stats = scaling(df, features)
        rng = np.random.default_rng(seed)
        # a kernel width of 1 / (number of features) suits unit variances
        gamma = 1.0 / len(features)
        return cls(
            list(features), np.array([stats[f][0] for f in features]),
            np.array([stats[f][1] or 1.0 for f in features]),
            rng.normal(0.0, np.sqrt(2.0 * gamma), (len(features), size)), rng.uniform(0.0, 2 * np.pi, size))

    def apply(self, values: np.ndarray, zero: bool = False) -> np.ndarray:
        scaled = (values - self.mean) / self.deviation
        if zero and self.zeroed:
            scaled[:, self.zeroed] = 0.0
        return np.sqrt(2.0 / len(self.phases)) * np.cos(scaled @ self.weights + self.phases)


def _columns(features: list[str]) -> list[Column]:
    return [F.col(f).cast("double") for f in features]


def kernel_mean(df: DataFrame, mapping: FourierMap) -> np.ndarray:
    """Mean mapped vector: sums per batch in the tasks, then one short aggregation."""
    def sums(batches):
        for pdf in batches:
            mapped = mapping.apply(pdf.to_numpy(dtype=float))
            yield pd.DataFrame({"i": np.arange(mapped.shape[1]), "s": mapped.sum(axis=0), "n": len(pdf)})

    rows = df.select(*_columns(mapping.features)).mapInPandas(sums, "i long, s double, n long")
    # one row per dimension of the map
    total = rows.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("i").collect()
    return np.array([r["m"] for r in total])


def novelty_score(df: DataFrame, mapping: FourierMap, center: np.ndarray) -> DataFrame:
    """Add ``novelty``: one minus the kernel similarity to the training mean."""
    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        values = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.Series(1.0 - mapping.apply(values, zero=True) @ center)

    return df.withColumn("novelty", score(*_columns(mapping.features)))


def score_series_kernel(
    train: DataFrame, series: DataFrame, resolution: str, k: float = 3.0, nu: float = NOVELTY_NU,
    size: int = 128, seed: int = 42,
) -> DataFrame:
    """Kernel novelty of one series as a z-score blended with the local deviation.

    Stands in for a one-class SVM: the training mean in kernel space is its
    limit for nu = 1.  Calendar features are zeroed after scaling, so the score
    depends on the value only.  ``is_novel`` marks scores above the 1 - nu
    quantile of the training scores.
    """
    calendar = time_feature_names(resolution)
    features = ["value", *calendar]
    learn = checkpointed(with_model_features(train, resolution))
    mapping = FourierMap.fit(learn, features, size, seed)
    mapping.zeroed = [i for i, f in enumerate(features) if f in calendar]
    center = kernel_mean(learn, mapping)
    cut = scalar_quantiles(novelty_score(learn, mapping, center), "novelty", {"q": 1 - nu})["q"]
    raw = checkpointed(novelty_score(with_model_features(series, resolution), mapping, center))
    z = A.series_robust_z(raw, "novelty").drop(*calendar)
    return A.blend_score(z.withColumn("is_novel", F.col("novelty") > F.lit(cut)), k)


class KernelRegressor:
    """RBF regression: a cosine map and a linear model with Huber loss."""

    def __init__(self, mapping: FourierMap, model):
        self.mapping, self.model = mapping, model

    @staticmethod
    def _mapped(df: DataFrame, mapping: FourierMap) -> DataFrame:
        @F.pandas_udf("array<double>")
        def project(*columns: pd.Series) -> pd.Series:
            values = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            return pd.Series(list(mapping.apply(values)))

        return df.withColumn("_x", array_to_vector(project(*_columns(mapping.features))))

    @classmethod
    def fit(
        cls, rows: DataFrame, features: list[str], label: str = "value", size: int = 256, reg: float = 0.01,
        seed: int = 42,
    ) -> "KernelRegressor":
        learn = checkpointed(rows.select(label, *features))
        mapping = FourierMap.fit(learn, features, size, seed)
        mapped = cls._mapped(learn, mapping).withColumn("_y", F.col(label).cast("double"))
        linear = LinearRegression(
            featuresCol="_x", labelCol="_y", loss="huber", regParam=reg, maxIter=50, predictionCol="_p")
        return cls(mapping, linear.fit(mapped))

    def transform(self, df: DataFrame, name: str = "forecast") -> DataFrame:
        return self.model.transform(self._mapped(df, self.mapping)).withColumnRenamed("_p", name).drop("_x")
