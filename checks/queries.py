"""One Spark query per operator, over the driver's tables."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import anomaly as A
from tidemark.operators import calibration as Cal
from tidemark.operators import forecast as Fc
from tidemark.operators import forest, kernel, neighbors, registry
from tidemark.operators import records as R
from tidemark.operators import series as S
from tidemark.plans import preparation, requests
from tidemark.schema import CLEAN_FEATURES, TRIP_COLUMNS
from tidemark.session import checkpointed, shared_folder
from tidemark.sources import readers, sinks
from tidemark.streaming import matching, pipeline, sources, windows

PICKUP = "tpep_pickup_datetime"
TRAIN_END = "2024-01-23 00:00:00"
# Leaves a forecaster with its usual lags enough bins to learn from.
MODEL_END = "2024-01-26 00:00:00"
RANGE = ("2024-01-05 00:00:00", "2024-01-20 00:00:00")
QUERIES: dict = {}


def query(fn):
    """Register a query under its function name; doubles are rounded to 6 places.

    Engines break exact ties differently, so values are first moved off them by
    far less than the last place.
    """
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(spark, sf_dir)
        return out.select(*[
            (F.round(F.col(n) + F.lit(1.3e-8), 6) + F.lit(0.0)).alias(n) if k == "double" else F.col(n) for n, k in out.dtypes])

    QUERIES[fn.__name__] = run
    return fn


# -- inputs -------------------------------------------------------------------

def table(spark, sf, name):
    return readers.read_table(spark, f"{sf}/{name}.parquet")


def raw(spark, sf):
    return readers.events_as_trips(table(spark, sf, "events"))


def trips(spark, sf):
    return R.derive_features(raw(spark, sf))


def full(spark, sf):
    return R.attach_hourly_stats(trips(spark, sf))


def entries(spark, sf):
    return readers.events_as_entries(table(spark, sf, "events"))


def users(spark, sf):
    return readers.events_as_users(table(spark, sf, "events"))


def train(df):
    return df.filter(F.col(PICKUP) < F.lit(TRAIN_END).cast("timestamp_ntz"))


def later(df):
    return df.filter(F.col(PICKUP) >= F.lit(TRAIN_END).cast("timestamp_ntz"))


def hourly(spark, sf, metric="total_amount", how="mean", resolution="1h"):
    return S.bin_series(trips(spark, sf), metric, resolution, how)


KEYS = ["metric", "resolution", "vendor"]


def some_series(spark, sf, resolutions=("1h", "3h")):
    """Long series of all metrics and vendors, labelled by split."""
    rows = S.long_series(full(spark, sf), list(resolutions))
    return S.with_split(checkpointed(rows), 8)


def daily_orders(spark, sf):
    """Median order price per day, gaps filled."""
    days = S.daily_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return S.interpolate_linear(S.fill_calendar(checkpointed(days)))


def scratch(spark, name):
    """A new folder next to the checkpoints."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# -- records ------------------------------------------------------------------

@query
def trip_features(spark, sf):
    return R.sanity_filter(trips(spark, sf)).select(
        "id", "trip_duration_minutes", "trip_speed_mph", "price_per_distance")


@query
def trip_features_eps(spark, sf):
    return R.derive_features(raw(spark, sf), "eps").select(
        "id", "trip_duration_minutes", "trip_speed_mph", "price_per_distance")


@query
def trips_filtered(spark, sf):
    rows = R.vendor_filter(R.time_range(trips(spark, sf), *RANGE), 2)
    rows = R.range_filters(
        rows, {"trip_distance": ("0.5", "20"), "trip_speed_mph": ("1", ""), "fare_amount": ("bad", None)})
    return R.select_visible(rows, ["id", PICKUP, "vendorid", "trip_distance", "trip_speed_mph"])


@query
def hour_slice(spark, sf):
    return R.hour_range(trips(spark, sf), "2024-01-10 08:00:00").select("id", PICKUP, "total_amount")


@query
def null_features_dropped(spark, sf):
    return R.drop_null_features(trips(spark, sf), ["trip_speed_mph", "price_per_distance"]).select("id", "vendorid")


@query
def trips_page(spark, sf):
    rows = R.page(raw(spark, sf).select("id", PICKUP, "vendorid", "total_amount"), 2, 25)
    return R.display_format(rows)


@query
def trips_export(spark, sf):
    path = scratch(spark, "export")
    chosen = R.vendor_filter(trips(spark, sf), 1)
    sinks.write_csv(chosen, path, ["id", PICKUP, "vendorid", "total_amount", "trip_speed_mph"])
    back = spark.read.csv(path, header=True)
    return back.select(
        F.col("id").cast("bigint"), PICKUP, "vendorid", F.col("total_amount").cast("double"),
        F.col("trip_speed_mph").cast("double"))


@query
def month_slice(spark, sf):
    orders = table(spark, sf, "orders")
    return readers.in_months(orders, "1996-02:1997-03", "o_orderdate").select("o_orderkey", "o_orderdate")


@query
def schema_aligned(spark, sf):
    loud = raw(spark, sf).withColumnsRenamed({"vendorid": "VendorID", "pulocationid": "PULocationID"})
    return readers.align_schema(readers.normalize_names(loud.withColumn("Extra", F.lit(1))), TRIP_COLUMNS)


@query
def monthly_files(spark, sf):
    """Two files that differ in names, types and columns, read as one table."""
    folder = scratch(spark, "months")
    rows = raw(spark, sf).drop("id")
    train(rows).withColumnRenamed("vendorid", "VendorID").write.parquet(f"{folder}/a")
    older = later(rows).drop("pulocationid", "dolocationid")
    older.withColumn("passenger_count", F.col("passenger_count").cast("double")).write.parquet(f"{folder}/b")
    parts = [readers.scan_trips(spark, f"{folder}/{p}") for p in "ab"]
    return reduce(R.union_trips, parts).drop(
        "trip_duration_minutes", "trip_speed_mph", "price_per_distance", "hourly_trip_volume", "hourly_avg_speed")


@query
def insert_ignore(spark, sf):
    rows = raw(spark, sf).select("id", "vendorid", "total_amount")
    existing = train(raw(spark, sf)).select("id", "vendorid")
    return sinks.insert_ignore(rows, existing, ["id", "vendorid"])


@query
def result_cache(spark, sf):
    path = scratch(spark, "results")
    scored = A.intraday_mad(hourly(spark, sf), "2024-01-01", "2024-01-31").select(
        F.lit("total_amount").alias("metric"), F.lit("1h").alias("resolution"), F.lit("all").alias("vendor"),
        F.lit("intraday").alias("model_name"), "ts", F.col("value").alias("actual"), "expected", "z")
    held = checkpointed(scored)
    sinks.save_results(held.filter(F.col("ts") < F.lit(TRAIN_END).cast("timestamp_ntz")), path)
    sinks.save_results(held, path)
    found = sinks.lookup_results(spark.read.parquet(path), "total_amount", "1h", "all", "intraday", *RANGE)
    return found.select("ts", "actual", "expected", "z")


@query
def union_provenance(spark, sf):
    rows = R.union_with_provenance(raw(spark, sf), entries(spark, sf), users(spark, sf))
    return rows.select("id", PICKUP, "vendorid", "source", "added_by", "added_by_name")


@query
def manual_of_user(spark, sf):
    rows = R.union_with_provenance(raw(spark, sf), entries(spark, sf), users(spark, sf))
    return R.provenance_filter(rows, "manual", 7).select("id", "source", "added_by", "added_by_name")


@query
def activity_log(spark, sf):
    return R.activity_log(entries(spark, sf), users(spark, sf))


@query
def entry_names(spark, sf):
    return R.attach_user_names(entries(spark, sf), users(spark, sf)).select(
        "id", "added_by_name", "deleted_by_name")


@query
def user_summary(spark, sf):
    return R.user_activity_summary(users(spark, sf), entries(spark, sf))


@query
def users_with_entries(spark, sf):
    return R.users_with_entries(users(spark, sf), entries(spark, sf))


@query
def recent_entries(spark, sf):
    return R.recent_entries(entries(spark, sf), 500).select("id", "added_at", "added_by")


@query
def entry_metrics(spark, sf):
    rows = entries(spark, sf).withColumn("trip_duration_minutes", F.col("dolocationid").cast("double"))
    return R.derive_entry_metrics(rows).select("id", "trip_speed_mph", "price_per_distance")


@query
def hour_context(spark, sf):
    new = entries(spark, sf).withColumn("trip_duration_minutes", F.col("dolocationid").cast("double"))
    out = R.hour_context(new, train(trips(spark, sf)), entries(spark, sf))
    return out.select("id", F.col("hourly_trip_volume").cast("bigint").alias("hourly_trip_volume"), "hourly_avg_speed")


# -- scalars ------------------------------------------------------------------

@query
def time_parts(spark, sf):
    ts = F.col(PICKUP)
    return raw(spark, sf).select(
        "id", C.trunc_minute(ts).alias("minute_start"), C.trunc_hour(ts).alias("hour_start"),
        C.trunc_day(ts).alias("day_start"), C.bin_to(ts, "15m").alias("quarter_start"),
        *C.time_features(ts), C.seconds_of_day(ts).alias("tb"), C.day_name(ts).alias("day_name"))


@query
def coerced_text(spark, sf):
    e = table(spark, sf, "events")
    stamp = F.replace(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.lit("T"))
    amount = F.format_string("%.2f", "value")
    return e.select(
        "event_id", C.coerce_float(amount).alias("as_float"), C.coerce_int(amount).alias("as_int"),
        C.coerce_float("event_type").alias("not_a_number"), C.parse_pickup(stamp).alias("pickup"),
        C.parse_pickup("event_type").alias("not_a_time"))


@query
def finite_features(spark, sf):
    return trips(spark, sf).select("id", *[C.finite_or_zero(f).alias(f) for f in CLEAN_FEATURES])


@query
def calendar_features(spark, sf):
    days = S.daily_series(table(spark, sf, "orders"), "o_orderdate")
    return days.select("day", *C.calendar_features("day", 1990, 2010))


# -- bins and series ----------------------------------------------------------

@query
def bin_hourly_count(spark, sf):
    return S.bin_series(trips(spark, sf), "trip_count", "1h")


@query
def bin_3h_median(spark, sf):
    return S.bin_series(trips(spark, sf), "trip_speed_mph", "3h", "median")


@query
def bin_1d_mean(spark, sf):
    return S.bin_series(trips(spark, sf), "trip_speed_mph", "1d", "mean", vendor="2")


@query
def bin_all_metrics(spark, sf):
    return S.bin_all_metrics(full(spark, sf), "1h")


@query
def bin_mean_metrics(spark, sf):
    return S.bin_mean_metrics(full(spark, sf), "hour")


@query
def resampled_mean(spark, sf):
    return S.resample_mean(S.bin_mean_metrics(full(spark, sf), "hour"), "3h")


@query
def long_series(spark, sf):
    return S.long_series(full(spark, sf), ["1h", "3h", "1d"]).select("series_id", "ts", "value")


@query
def union_bins(spark, sf):
    both = R.union_trips(train(trips(spark, sf)), later(trips(spark, sf)))
    return S.bin_series(both, "total_amount", "1h")


@query
def series_split(spark, sf):
    return some_series(spark, sf).select("series_id", "ts", "split", "value")


@query
def split_report(spark, sf):
    return S.split_report(some_series(spark, sf))


@query
def length_report(spark, sf):
    return S.length_report(some_series(spark, sf))


@query
def distinct_series(spark, sf):
    return S.distinct_series(some_series(spark, sf))


@query
def series_meta(spark, sf):
    rows = some_series(spark, sf)
    sums = rows.groupBy("series_id").agg(F.sum("value").alias("total"))
    return S.attach_series_meta(sums, rows)


@query
def hourly_stats_window(spark, sf):
    out = full(spark, sf)
    return out.select("id", F.col("hourly_trip_volume").cast("bigint").alias("hourly_trip_volume"), "hourly_avg_speed")


@query
def hourly_stats_join(spark, sf):
    out = R.attach_hourly_stats(R.derive_features(raw(spark, sf), "eps"))
    return out.select("id", F.col("hourly_trip_volume").cast("bigint").alias("hourly_trip_volume"), "hourly_avg_speed")


@query
def weekly_profile(spark, sf):
    rows = S.long_series(train(full(spark, sf)), ["1h"], how="mean")
    return S.weekly_profile(rows, ["metric", "vendor"])


@query
def training_profiles(spark, sf):
    return preparation.profiles(train(full(spark, sf)), ["1h", "3h", "1d"])


@query
def lag_features(spark, sf):
    return S.lag_features(hourly(spark, sf), 24, resolution="1h").drop("_n", "_pos")


@query
def time_split(spark, sf):
    rows = some_series(spark, sf).select(*KEYS, "ts", "value")
    return S.time_split(rows, 0.8, KEYS, min_rows=300)


@query
def context_horizon(spark, sf):
    return S.context_and_horizon(hourly(spark, sf), *RANGE, "1h", 48)


def _window_summary(w: DataFrame, keys: list[str]) -> DataFrame:
    def total(name):
        return F.aggregate(name, F.lit(0.0), lambda a, x: a + x)

    return w.select(
        *keys, "origin", F.get("target_ts", 0).alias("origin_ts"), F.size("context").alias("n_context"),
        F.size("target").alias("n_target"), F.get("context", 0).alias("first_value"),
        total("context").alias("context_sum"), total("target").alias("target_sum"))


@query
def fixed_windows(spark, sf):
    return _window_summary(S.fixed_windows(hourly(spark, sf), 48, 24, 6, 20), [])


@query
def rolling_origins(spark, sf):
    return _window_summary(S.rolling_origins(some_series(spark, sf), 72, 24, 5, KEYS), KEYS)


@query
def naive_diff(spark, sf):
    return S.naive_diff(hourly(spark, sf))


@query
def keep_newest(spark, sf):
    return S.keep_newest(some_series(spark, sf).select(*KEYS, "ts", "value"), 100, KEYS)


@query
def latest_per_key(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "ts", "value")
    return S.latest_per_key(rows, ["user_id", "event_type"], "ts")


# -- daily series -------------------------------------------------------------

@query
def daily_filled(spark, sf):
    return daily_orders(spark, sf)


@query
def calendar_lags(spark, sf):
    return S.calendar_lag(daily_orders(spark, sf), [364, 365, 371])


@query
def trailing_year_mean(spark, sf):
    return S.trailing_mean(daily_orders(spark, sf))


# -- anomalies ----------------------------------------------------------------

@query
def global_mad(spark, sf):
    profile = S.weekly_profile(hourly_train(spark, sf))
    return A.global_mad(S.bin_series(later(trips(spark, sf)), "total_amount", "1h", "mean"), profile, 3.0)


def hourly_train(spark, sf):
    return S.bin_series(train(trips(spark, sf)), "total_amount", "1h", "mean")


@query
def local_mad(spark, sf):
    return requests.answer(trips(spark, sf), requests.Request("trip_count", "1h", *RANGE, k=2.5), "anomaly", "local_mad")


@query
def record_mad(spark, sf):
    return A.record_mad(trips(spark, sf), "total_amount", 3.0).select("id", "z", "is_anomaly")


@query
def intraday_mad(spark, sf):
    return A.intraday_mad(hourly(spark, sf, "trip_speed_mph"), "2024-01-10", "2024-01-20")


@query
def engineered_trips(spark, sf):
    out = R.engineer_trips(raw(spark, sf))
    return out.select("id", "trip_speed_mph", F.col("hourly_trip_volume").cast("bigint").alias("hourly_trip_volume"),
                      "hourly_avg_speed")


@query
def blend_score(spark, sf):
    profile = S.weekly_profile(hourly_train(spark, sf))
    z = A.global_mad(S.bin_series(later(trips(spark, sf)), "total_amount", "1h", "mean"), profile)
    return A.blend_score(z.select("ts", "value", "z"), 2.0)


@query
def local_deviation(spark, sf):
    return A.local_deviation(hourly(spark, sf))


@query
def series_robust_z(spark, sf):
    return A.series_robust_z(some_series(spark, sf).select(*KEYS, "ts", "value"), "value", KEYS)


@query
def standardized(spark, sf):
    rows = hourly(spark, sf).select("ts", "value", F.hour("ts").cast("double").alias("hour"),
                                    F.minute("ts").cast("double").alias("minute"))
    return kernel.standardize(rows, ["value", "hour", "minute"])


@query
def knn_distances(spark, sf):
    points = checkpointed(neighbors.prepare(hourly(spark, sf, resolution="3h"), []))
    return neighbors.knn_distance(points, [])


@query
def eps_neighbors(spark, sf):
    points = checkpointed(neighbors.prepare(hourly(spark, sf, resolution="3h"), []))
    return neighbors.neighbor_counts(points, points, [], F.lit(0.75))


@query
def dbscan_noise(spark, sf):
    out = neighbors.dbscan_noise(hourly(spark, sf, "trip_count", resolution="3h"), 2.0)
    return out.select("ts", "value", "eps", "found", "is_noise", "score", "is_anomaly")


# -- calibration and scores ---------------------------------------------------

def backtest(spark, sf):
    rows = some_series(spark, sf)
    return Fc.rolling_forecast(rows, lambda c, h: Fc.seasonal_ahead(24)(c, h), 72, 24, KEYS)


@query
def seasonal_backtest(spark, sf):
    return backtest(spark, sf).select(*KEYS, "ts", "step", "actual", "forecast")


@query
def seasonal_naive(spark, sf):
    return Fc.seasonal_naive(hourly(spark, sf), "1h")


@query
def forecast_metrics(spark, sf):
    return Cal.forecast_metrics(backtest(spark, sf), KEYS)


@query
def wape_by_resolution(spark, sf):
    scores = Fc.score_by_series(backtest(spark, sf), "seasonal")
    return Cal.median_by(scores, ["resolution", "tag"])


@query
def compare_tags(spark, sf):
    rows = some_series(spark, sf)
    day = Fc.score_by_series(Fc.rolling_forecast(rows, Fc.seasonal_ahead(24), 72, 24, KEYS), "s24")
    half = Fc.score_by_series(Fc.rolling_forecast(rows, Fc.seasonal_ahead(12), 72, 24, KEYS), "s12")
    return Cal.compare_tags(checkpointed(day.unionByName(half)), tags=["s12", "s24"])


def naive_rows(spark, sf):
    return Fc.seasonal_naive(hourly(spark, sf), "1h").withColumnRenamed("value", "actual")


@query
def conformal_band(spark, sf):
    rows = checkpointed(naive_rows(spark, sf))
    cut = F.lit(TRAIN_END).cast("timestamp_ntz")
    widths = Cal.conformal_widths(rows.filter(F.col("ts") < cut))
    out = Cal.band(rows.filter(F.col("ts") >= cut), widths, "90")
    return out.withColumn("outside", C.outside_band())


@query
def local_scale_band(spark, sf):
    rows = checkpointed(naive_rows(spark, sf).dropna(subset=["forecast"]))
    widths = Cal.conformal_widths(rows)
    scaled = rows.withColumn("scale", F.abs(F.col("forecast")))
    return Cal.mean_half_width(Cal.band(scaled, widths, "95", local_scale="scale")).unionByName(
        Cal.mean_half_width(Cal.band(scaled, widths, "95")))


@query
def cqr_band(spark, sf):
    rows = checkpointed(naive_rows(spark, sf).dropna(subset=["forecast"])).withColumns(
        {"lower": F.col("forecast") * 0.9, "upper": F.col("forecast") * 1.1})
    q = Cal.cqr_q(rows, "90").select(F.col("q").alias("_q"))
    lower, upper = Cal.cqr_adjust(F.col("lower"), F.col("upper"), F.col("_q"))
    return rows.join(F.broadcast(q), how="cross").select(
        "ts", "actual", lower.alias("lower"), upper.alias("upper"), F.col("_q").alias("q"))


@query
def sample_band(spark, sf):
    paths = hourly(spark, sf).select(F.hour("ts").alias("step"), F.col("value").alias("sample"))
    return Cal.sample_band(paths, "95", ["step"])


@query
def lagged_wape(spark, sf):
    """Forecasts made one and two seasons ahead; the newer one counts."""
    actual = checkpointed(hourly(spark, sf))
    made = [
        actual.select((F.col("ts") + F.expr(f"INTERVAL '{d}' DAY")).alias("ts"),
                      F.col("ts").alias("made_at"), F.col("value").alias("forecast")) for d in (1, 2)]
    return Fc.lagged_wape(Fc.match_forecasts(actual, made[0].unionByName(made[1])))


# -- blocks and windows -------------------------------------------------------

@query
def block_daily(spark, sf):
    marked = trips(spark, sf).withColumns({
        "usable": F.col("trip_speed_mph").isNotNull() & F.col("price_per_distance").isNotNull(),
        "is_anomaly": F.coalesce(F.col("trip_speed_mph") > 60, F.lit(False))})
    return forest.cleaning_stats(S.block_rows(marked, 24), ["block"])


@query
def latest_windows(spark, sf):
    blocks = S.block_rows(trips(spark, sf), 24).groupBy("block").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if(F.col("trip_speed_mph") > 60).alias("n_anomaly"),
        F.min(PICKUP).alias("ts_start"))
    rows = blocks.select(
        F.lit("stream").alias("run_name"), F.dayofyear("block").alias("window_index"), "ts_start", "n_raw",
        "n_anomaly", (F.col("n_raw") - F.col("n_anomaly")).alias("n_clean"),
        F.round(F.col("n_anomaly") / F.col("n_raw"), 4).alias("anom_rate"), F.lit("trip_count").alias("metric"),
        F.explode(F.array(F.lit("boosted"), F.lit("naive"))).alias("model_name"))
    return R.latest_windows(rows, "stream", 40)


@query
def count_windows(spark, sf):
    out = windows.sliding_count_windows(raw(spark, sf))
    return out.groupBy("window_index").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(PICKUP).alias("ts_start"), F.max(PICKUP).alias("ts_end"),
        F.sum("total_amount").alias("total"))


# -- models (no SQL twin) -----------------------------------------------------

@query
def iforest_flags(spark, sf):
    path = scratch(spark, "flagged")
    sinks.split_flagged(forest.flag_file(trips(spark, sf)), path, drop=True)
    parts = [spark.read.parquet(f"{path}/{p}").select(F.lit(p).alias("part"), "id", "is_anomaly", "anomaly_score")
             for p in ("flagged", "anomalies", "cleaned")]
    return reduce(DataFrame.unionByName, parts)


@query
def iforest_clean(spark, sf):
    return forest.cleaning_stats(forest.clean_blocks(trips(spark, sf)))


@query
def iforest_daily(spark, sf):
    """A forest per day."""
    daily = S.block_rows(trips(spark, sf), 24)
    return forest.cleaning_stats(forest.clean_blocks(daily, "block"), ["block"])


@query
def iforest_series(spark, sf):
    request = requests.Request("total_amount", "1h", TRAIN_END, "2024-01-30 23:59:59", history=train(trips(spark, sf)))
    return requests.answer(later(trips(spark, sf)), request, "anomaly", "if")


@query
def kernel_novelty(spark, sf):
    request = requests.Request("total_amount", "1h", TRAIN_END, "2024-01-30 23:59:59", history=train(trips(spark, sf)))
    return requests.answer(later(trips(spark, sf)), request, "anomaly", "svm")


@query
def gbt_forecast(spark, sf):
    cut = F.lit(MODEL_END).cast("timestamp_ntz")
    rows = trips(spark, sf)
    request = requests.Request(
        "trip_count", "1h", MODEL_END, "2024-01-30 23:59:59", how="median", history=rows.filter(F.col(PICKUP) < cut))
    return requests.answer(rows.filter(F.col(PICKUP) >= cut), request, "forecast", "xgboost")


MODEL_RESOLUTIONS, MODEL_METRICS = ["30m", "1h"], ["total_amount"]


def model_table(spark, sf):
    """Models of two metrics (counts come with any) and all vendors at two resolutions, promoted to a table and read from there."""
    early = trips(spark, sf).filter(F.col(PICKUP) < F.lit(MODEL_END).cast("timestamp_ntz"))
    path = scratch(spark, "models")
    rows = S.long_series(early, MODEL_RESOLUTIONS, metrics=MODEL_METRICS, how="mean")
    registry.promote(registry.train_models(checkpointed(rows), MODEL_RESOLUTIONS), path)
    return registry.registered(spark, path)


@query
def registered_forecasts(spark, sf):
    """Forecasts of every registered series in one plan, each with its model's band."""
    return requests.forecast_all(trips(spark, sf), model_table(spark, sf), MODEL_END, "2024-01-30 23:59:59")


@query
def gbt_incremental(spark, sf):
    rows = checkpointed(S.bin_series(trips(spark, sf), "trip_count", "1h"))
    cut = F.lit(TRAIN_END).cast("timestamp_ntz")
    first = Fc.update_forecaster(None, checkpointed(rows.filter(F.col("ts") < cut)), "1h")
    second = Fc.update_forecaster(first.model, rows, "1h")
    return spark.createDataFrame(
        [(i, o.status, o.n_train, o.wape, o.mae, o.trees, o.incremental) for i, o in enumerate((first, second))],
        "step int, status string, n_train long, wape double, mae double, trees int, incremental boolean")


@query
def recursive_forecast(spark, sf):
    rows = checkpointed(S.bin_series(trips(spark, sf), "trip_count", "1h", keys=["vendorid"]))
    model = Fc.fit_forecaster(rows, "1h", keys=["vendorid"])
    return Fc.forecast_recursive(rows, model, "2024-01-30 12:00:00", 12, ["vendorid"])


@query
def live_panel(spark, sf):
    rows = checkpointed(hourly(spark, sf))
    model = Fc.fit_forecaster(rows, "1h")
    past = Fc.seasonal_naive(rows, "1h").select(
        "ts", (F.col("ts") - F.expr("INTERVAL '1' DAY")).alias("made_at"), "forecast").dropna()
    return Fc.live_forecast(rows, model, "2024-01-29 00:00:00", 6, past)


@query
def kernel_regression(spark, sf):
    request = requests.Request("trip_count", "1h", "2024-01-29 00:00:00", "2024-01-30 23:59:59", how="median",
                               history=trips(spark, sf).filter(F.col(PICKUP) < F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")))
    return requests.answer(trips(spark, sf).filter(F.col(PICKUP) >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")),
                           request, "forecast", "svr")


@query
def annual_anomaly(spark, sf):
    days = checkpointed(daily_orders(spark, sf))
    cut = days.agg(F.date_sub(F.max("day"), 180)).first()[0]
    clean, new = days.filter(F.col("day") <= F.lit(cut)), days.filter(F.col("day") > F.lit(cut))
    return Fc.annual_anomaly(clean, new, first_year=1990, last_year=2010)


@query
def setting_search(spark, sf):
    rows = checkpointed(S.bin_series(trips(spark, sf), "trip_count", "1h"))
    grid = [{"rounds": r, "depth": d, "step": s} for r in (100, 400) for d in (3, 8) for s in (0.02, 0.1)]
    found = Fc.time_ordered_search(rows, "1h", grid)
    return spark.createDataFrame([(w, str(s), e) for w, s, e in found], "wape double, setting string, error string")


@query
def residual_band(spark, sf):
    rows = naive_rows(spark, sf).dropna(subset=["forecast"])
    scored = checkpointed(rows.select("ts", "actual", "forecast"))
    steps = scored.withColumns({"origin": F.to_date("ts").cast("string"), "step": F.hour("ts")})
    paths = Fc.residual_paths(steps, checkpointed(Fc.index_residuals(scored)))
    return Cal.sample_band(paths, "90", ["origin", "step"])


@query
def sampled_rows(spark, sf):
    return S.sample_rows(raw(spark, sf).select("id", "vendorid"), 500)


@query
def random_windows(spark, sf):
    w = S.random_windows(some_series(spark, sf).select(*KEYS, "ts", "value"), 48, 24, 200, keys=KEYS)
    return w.select("draw", *KEYS, "start", F.size("context").alias("n_context"), F.size("target").alias("n_target"))


# -- streams ------------------------------------------------------------------

STREAM_COLUMNS = {"id": "bigint", **{k: v for k, v in TRIP_COLUMNS.items() if not k.startswith("hourly_")}}


SLICES, LATE, ALL_FILES = 5, "id % 50 = 7", 1_000_000


def feed(spark, sf, consume):
    """The trips as a file stream that arrives in slices of six days; ``consume`` takes what is there after each.

    A slice keeps Spark's partitions.  A tenth of each slice's last day comes out
    of order, with the next slice.  Every fiftieth row of the first slice comes
    last of all, when its time is long past.
    """
    path = scratch(spark, "stream")
    rows = checkpointed(readers.align_schema(trips(spark, sf), STREAM_COLUMNS))
    day = F.dayofmonth(PICKUP) - 1
    held = F.when((F.col("id") % 10 == 3) & (day % 6 == 5), 1).otherwise(0)
    place = F.least(F.floor(day / 6), F.lit(SLICES - 1))
    sliced = rows.withColumn("_s", F.when(F.expr(LATE) & (place == 0), SLICES).otherwise(F.least(place + held, F.lit(SLICES - 1))))
    for i in range(SLICES + 1):
        sliced.filter(F.col("_s") == i).drop("_s").write.parquet(f"{path}/{i}")
        consume(sources.read_trip_stream(spark, path, STREAM_COLUMNS, ALL_FILES))


def drained(spark, sf, transform):
    """Run a streaming query over the slices, from its checkpoint after each, and read back its output."""
    out, offsets = scratch(spark, "out"), scratch(spark, "offsets")

    def consume(stream):
        (transform(stream).writeStream.format("parquet").option("checkpointLocation", offsets).outputMode("append")
         .trigger(availableNow=True).start(out).awaitTermination())

    feed(spark, sf, consume)
    return spark.read.parquet(out)


@query
def stream_bins(spark, sf):
    """What the stream emits by itself: hourly bins closed by the last watermark, without late rows."""
    closed = drained(spark, sf, lambda s: sources.stream_bin_series(s, "total_amount", "1h", "2 days"))
    return closed.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def stream_blocks(spark, sf):
    out = drained(spark, sf, lambda s: sources.tumbling_blocks(s, 24, "2 days"))
    return out.select(F.col("block").cast("timestamp_ntz").alias("block"), "n_rows", "mean_total")


@query
def stream_two_day_blocks(spark, sf):
    """Blocks whose width does not divide a day: the stream's next to the batch form's."""
    out = drained(spark, sf, lambda s: sources.tumbling_blocks(s, 48, "2 days"))
    batch = S.block_rows(trips(spark, sf), 48).filter(~(F.expr(LATE) & (F.dayofmonth(PICKUP) <= 6)))
    batch = batch.groupBy("block").agg(F.count(F.lit(1)).alias("n_batch"))
    return out.select(F.col("block").cast("timestamp_ntz").alias("block"), F.col("n_rows")).join(batch, "block")


@query
def stream_count_windows(spark, sf):
    """Windows of 100 records of a vendor, every 40, that the stream gives out by itself."""
    columns = ["vendorid", "id", PICKUP, "total_amount"]
    with state_store(spark):
        out = drained(spark, sf, lambda s: windows.stream_count_windows(s.select(*columns), ["vendorid"], 100, 40, "2 days"))
    return out.groupBy("vendorid", "window_index").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("low_id"), F.max("id").alias("high_id"),
        F.min(F.col(PICKUP).cast("timestamp_ntz")).alias("first_ts"), F.max(F.col(PICKUP).cast("timestamp_ntz")).alias("last_ts"),
        F.sum("total_amount").alias("total"))


@query
def stream_matching(spark, sf):
    """Hourly bins of each vendor next to the newest of two forecasts of them, as both streams close.

    A forecast of a bin is the value a day or two days before it, made at the
    later of those times; every seventh bin has none from the day before, and
    noon bins have none at all.
    """
    folders, offsets, out = {x: scratch(spark, x) for x in ("actuals", "forecasts")}, scratch(spark, "offsets"), scratch(spark, "out")
    bins = checkpointed(S.bin_series(trips(spark, sf), "total_amount", "1h", "mean", keys=["vendorid"]))
    number = F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")
    made = [bins.select("vendorid", (F.col("ts") + F.make_dt_interval(F.lit(d))).alias("ts"), F.col("ts").alias("made_at"),
                        F.col("value").alias("forecast")).filter((F.hour("ts") != 12) & ((number % 7 != 3) | F.lit(d == 2))) for d in (1, 2)]
    forecasts = checkpointed(made[0].unionByName(made[1]))
    schemas = {"actuals": "vendorid string, ts timestamp_ntz, value double", "forecasts": "vendorid string, ts timestamp_ntz, made_at timestamp_ntz, forecast double"}
    for i in range(SLICES):
        for name, rows, at in (("actuals", bins, "ts"), ("forecasts", forecasts, "made_at")):
            rows.filter(F.least(F.floor((F.dayofmonth(at) - 1) / 6), F.lit(SLICES - 1)) == i).write.parquet(f"{folders[name]}/{i}")
        read = {n: spark.readStream.schema(k).option("recursiveFileLookup", "true").parquet(folders[n]).withColumn(
            "ts", F.col("ts").cast("timestamp")) for n, k in schemas.items()}
        matched = matching.stream_matches(read["actuals"], read["forecasts"], ["vendorid"], "1 hour", "2 days")
        (matched.writeStream.format("parquet").option("checkpointLocation", offsets).outputMode("append")
         .trigger(availableNow=True).start(out).awaitTermination())
    return spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@contextmanager
def state_store(spark):
    """The RocksDB state store for the streams that need it; the session's own is put back."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _pipe(spark):
    return pipeline.BlockPipeline(spark, scratch(spark, "pipe"))


@query
def stream_telemetry(spark, sf):
    pipe = _pipe(spark)
    feed(spark, sf, lambda stream: pipe.run(stream, flush=False))
    pipe.finish()
    return pipe.telemetry().drop("seconds")


@query
def stream_prewarm(spark, sf):
    pipe = _pipe(spark)
    pipe.prewarm(trips(spark, sf), "2024-01-11")
    return pipe.retrain(trips(spark, sf), "2024-01-11").drop("seconds")
