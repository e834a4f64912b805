"""Queries that state checkable facts of results SQL cannot compute, and of sinks and lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import queries as Q
from checks.twins import BASE, CLOSED, ENTRIES, FULL, METRICS, ON_TIME, RAW, T, bins, long, with_
from tidemark import schema
from tidemark.operators import forecast as Fc
from tidemark.operators import forest
from tidemark.operators import records as R
from tidemark.operators import series as S
from tidemark.sources import readers, sinks
from tidemark.streaming import pipeline, sources

QUERIES: dict = {}
TWINS: dict[str, str] = {}
PICKUP = Q.PICKUP


def fact(sql: str, doubles: str = ""):
    """Register a query and its SQL; ``doubles`` are rounded to 6 places on both sides."""
    names = doubles.split()

    def add(fn):
        def run(spark, sf_dir):
            return fn(spark, sf_dir).withColumns({c: F.round(c, 6) for c in names}) if names else fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        replaced = ", ".join(f"round({c}, 6) AS {c}" for c in names)
        TWINS[fn.__name__] = f"SELECT * REPLACE ({replaced}) FROM (\n{sql}\n)" if names else sql
        return fn

    return add


def all_true(*conditions):
    """One column that is true if every condition holds on every row."""
    whole = F.lit(True)
    for c in conditions:
        whole = whole & F.coalesce(c, F.lit(False))
    return F.coalesce(F.bool_and(whole), F.lit(True)).alias("holds")


# -- sources and sinks --------------------------------------------------------

@fact(with_(RAW) + f"""SELECT vendorid, date_trunc('minute', {T}) AS {T}, passenger_count, trip_distance, total_amount
FROM raw WHERE id % 2 = 0""", "trip_distance total_amount")
def entries_csv(spark, sf):
    """Entries read back from CSV; rows without a pickup are skipped."""
    path = Q.scratch(spark, "entries")
    rows = Q.raw(spark, sf)
    blank = F.when(F.col("id") % 2 == 0, F.col(PICKUP))
    sinks.write_csv(rows.withColumn(PICKUP, blank), path, ["vendorid", PICKUP, "passenger_count", "trip_distance", "total_amount"])
    return readers.read_entries_csv(spark, path).select(
        "vendorid", PICKUP, F.col("passenger_count").cast("bigint").alias("passenger_count"), "trip_distance", "total_amount")


@fact(with_(RAW) + f"SELECT CAST({T} AS DATE) AS pickup_date, count(*) AS n, min(id) AS first_id, sum(total_amount) AS total FROM raw GROUP BY 1", "total")
def trips_by_date(spark, sf):
    """Trips stored by date and scanned back by our own reader."""
    path = Q.scratch(spark, "by_date")
    sinks.write_trips(Q.raw(spark, sf), path)
    back = spark.read.parquet(path)
    same = readers.scan_trips(spark, path).count() == back.count()
    return back.filter(F.lit(same)).groupBy("pickup_date").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.sum("total_amount").alias("total"))


@fact(with_(*BASE, FULL, long("l", "full_", METRICS, {"1h": "1 hour", "3h": "3 hours"}),
            "s AS (SELECT *, CASE WHEN ts >= (SELECT date_trunc('day', max(ts)) - INTERVAL 8 DAY FROM l) THEN 'val' ELSE 'train' END AS split FROM l)") +
      "SELECT resolution, split, count(*) AS n, count(DISTINCT series_id) AS n_series, sum(value) AS total FROM s GROUP BY ALL", "total")
def series_store(spark, sf):
    """Series stored by resolution and split."""
    path = Q.scratch(spark, "series")
    sinks.write_series(Q.some_series(spark, sf), path)
    return spark.read.parquet(path).groupBy("resolution", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("series_id").alias("n_series"), F.sum("value").alias("total"))


@fact("""SELECT step, times * (SELECT count(*) FROM events) AS n_rows, wrote
FROM (VALUES ('replace', 1, TRUE), ('keep', 2, TRUE), ('if_empty', 2, FALSE), ('replace again', 1, TRUE)) v(step, times, wrote)""")
def load_modes(spark, sf):
    """Rows stored after each load mode, one after another."""
    path, rows, out = Q.scratch(spark, "load"), Q.raw(spark, sf), []
    for step in ("replace", "keep", "if_empty", "replace again"):
        wrote = sinks.load_table(rows, path, step.split()[0])
        out.append((step, spark.read.parquet(path).count(), wrote))
    return spark.createDataFrame(out, "step string, n_rows long, wrote boolean")


@fact("SELECT unnest(" + str(["trip_count", "passenger_count", "trip_distance", "fare_amount", "tip_amount", "tolls_amount", "total_amount",
                              "trip_duration_minutes", "trip_speed_mph", "price_per_distance"]) + ") AS metric WHERE (SELECT count(*) FROM events) > 0")
def metric_columns(spark, sf):
    """The metrics found in derived trips."""
    return spark.createDataFrame([(m,) for m in R.metric_columns(Q.trips(spark, sf))], "metric string")


RESOLUTIONS = ", ".join(
    f"('{r}', {schema.RESOLUTION_SECONDS[r]}, {schema.SEASON_BINS[r]}, {60 if s < 3600 else 48 if s < 86400 else 14})"
    for r, s in schema.RESOLUTION_SECONDS.items())


@fact(with_(*BASE, FULL, long("l", "full_", METRICS, {"1h": "1 hour", "3h": "3 hours"})) +
      f"SELECT DISTINCT l.resolution, v.width, v.season, v.lags FROM l JOIN (VALUES {RESOLUTIONS}) v(resolution, width, season, lags) USING (resolution)")
def resolution_tables(spark, sf):
    """Widths, seasons and lags looked up for the series' resolutions."""
    found = Q.some_series(spark, sf).select("resolution").distinct()
    lags = {r: schema.lag_count(r) for r in schema.RESOLUTION_SECONDS}
    return found.select(
        "resolution", schema.resolution_lookup(F.col("resolution"), schema.RESOLUTION_SECONDS, 3600).alias("width"),
        schema.resolution_lookup(F.col("resolution"), schema.SEASON_BINS, 24).alias("season"),
        schema.resolution_lookup(F.col("resolution"), lags, 48).alias("lags"))


@fact(with_(*BASE) + """SELECT count(trip_speed_mph) AS n_rows, TRUE AS refused FROM feat""")
def row_guard(spark, sf):
    """All rows with the metric pass a guard of their number, and are refused by one less."""
    rows = Q.trips(spark, sf)
    n = rows.filter("trip_speed_mph IS NOT NULL").count()
    passed = R.guarded_limit(rows, "trip_speed_mph", n).count()
    try:
        R.guarded_limit(rows, "trip_speed_mph", n - 1)
        refused = False
    except R.TooManyRows:
        refused = True
    return spark.createDataFrame([(passed, refused)], "n_rows long, refused boolean")


@fact(with_(RAW, ENTRIES) + f"""SELECT entry_id, time, action FROM (
  SELECT id AS entry_id, added_at AS time, 'added' AS action FROM entries UNION ALL SELECT id, deleted_at, 'deleted' FROM entries WHERE is_deleted)
ORDER BY time DESC, entry_id, action LIMIT 50 OFFSET 50""")
def activity_second_page(spark, sf):
    """The second page of the activity log, newest first."""
    return R.activity_page(Q.entries(spark, sf), Q.users(spark, sf), 2).select("entry_id", "time", "action")


@fact(with_(RAW) + f"SELECT id, {T} FROM raw ORDER BY {T} DESC, id LIMIT 50 OFFSET 100")
def third_page_by_key(spark, sf):
    """A page found from the last row of the page before it."""
    rows = Q.raw(spark, sf).select("id", PICKUP)
    last = None
    for _ in range(2):
        end = R.page_after(rows, last).orderBy(F.asc(PICKUP), F.desc("id")).first()
        last = (end[PICKUP], end["id"])
    return R.page_after(rows, last)


# -- series at all resolutions ------------------------------------------------

WIDTHS = {"1m": "1 minute", "3m": "3 minutes", "5m": "5 minutes", "10m": "10 minutes", "15m": "15 minutes", "30m": "30 minutes",
          "1h": "1 hour", "3h": "3 hours", "1d": "1 day"}


@fact(with_(*BASE, FULL, long("l", "full_", METRICS, WIDTHS)) +
      "SELECT series_id, count(*) AS n, sum(value) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM l GROUP BY 1", "total")
def long_series_all(spark, sf):
    """All nine training resolutions, summed by series."""
    rows = S.long_series(Q.full(spark, sf), schema.TRAINING_RESOLUTIONS)
    return rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# -- forests and kernels ------------------------------------------------------

@fact(with_(*BASE) + "SELECT p.part, CASE WHEN p.part = 'flagged' THEN count(*) END AS n_rows, TRUE AS holds FROM feat, (VALUES ('flagged'), ('anomalies'), ('cleaned')) p(part) GROUP BY 1")
def iforest_flags_facts(spark, sf):
    """Flags agree with scores, parts add up, and no more are flagged than the asked share of all rows."""
    rows = Q.QUERIES["iforest_flags"](spark, sf)
    counts = {r["part"]: r for r in rows.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_anomaly").alias("flags"), F.count_distinct("id").alias("ids"),
        F.bool_and((F.col("anomaly_score") > 0) == (F.col("is_anomaly") == 1)).alias("agree")).collect()}
    n = counts["flagged"]["n"]
    parts = {
        "flagged": 0 < counts["flagged"]["flags"] <= schema.FILE_CONTAMINATION * n + 1 and counts["flagged"]["ids"] == n,
        "anomalies": counts["anomalies"]["n"] == counts["flagged"]["flags"],
        "cleaned": counts["cleaned"]["n"] + counts["anomalies"]["n"] == n}
    return spark.createDataFrame(
        [(p, n if p == "flagged" else None, bool(ok and counts[p]["agree"])) for p, ok in parts.items()],
        "part string, n_rows long, holds boolean")


UNUSABLE = "(trip_speed_mph IS NULL OR price_per_distance IS NULL OR trip_distance IS NULL OR trip_duration_minutes IS NULL)"


def _share_holds(share):
    usable = F.col("n_raw") - F.col("n_unusable")
    return ((F.col("n_anomaly") + F.col("n_clean") == usable) & (F.col("n_anomaly") <= share * usable + 1)
            & (F.col("n_anomaly") >= F.when(usable >= 40, 1).otherwise(0)))


@fact(with_(*BASE) + f"SELECT CAST(date_trunc('day', {T}) AS TIMESTAMP) AS block, count(*) AS n_raw, count(*) FILTER ({UNUSABLE}) AS n_unusable, TRUE AS holds FROM feat GROUP BY 1")
def iforest_daily_facts(spark, sf):
    """Counts per day, and that each day's forest flags about the asked share of it."""
    return Q.QUERIES["iforest_daily"](spark, sf).select("block", "n_raw", "n_unusable", _share_holds(schema.STREAM_CONTAMINATION).alias("holds"))


@fact(with_(*BASE) + f"SELECT count(*) AS n_raw, count(*) FILTER ({UNUSABLE}) AS n_unusable, TRUE AS holds FROM feat")
def iforest_clean_facts(spark, sf):
    return Q.QUERIES["iforest_clean"](spark, sf).select("n_raw", "n_unusable", _share_holds(schema.STREAM_CONTAMINATION).alias("holds"))


@fact(with_(*BASE) + "SELECT count(*) AS n_raw, TRUE AS holds FROM feat")
def iforest_auto_facts(spark, sf):
    """Without a share, scores above one half are flagged."""
    marked = forest.clean_blocks(Q.trips(spark, sf), contamination="auto")
    agree = F.coalesce(F.col("forest_score") > 0.5, F.lit(False)) == F.col("is_anomaly")
    return marked.agg(F.count(F.lit(1)).alias("n_raw"), all_true(agree))


LATER_BINS = with_(*BASE, bins("b", "total_amount", "1 hour", where=f"{T} >= TIMESTAMP '2024-01-23 00:00:00' AND {T} <= TIMESTAMP '2024-01-30 23:59:59'"))


@fact(LATER_BINS + "SELECT ts, value, TRUE AS holds FROM b", "value")
def iforest_series_facts(spark, sf):
    """Every bin is scored, and flags are scores above the threshold."""
    out = Q.QUERIES["iforest_series"](spark, sf)
    return out.select("ts", "value", (F.col("is_anomaly") == (F.col("score") > 3.0)).alias("holds"))


@fact(LATER_BINS + "SELECT ts, value, TRUE AS holds FROM b", "value")
def kernel_novelty_facts(spark, sf):
    out = Q.QUERIES["kernel_novelty"](spark, sf)
    return out.select("ts", "value", ((F.col("is_anomaly") == (F.col("score") > 3.0)) & F.col("is_novel").isNotNull()).alias("holds"))


# -- forecasts ----------------------------------------------------------------

def _range_bins(start, how="count"):
    return with_(*BASE, bins("b", "", "1 hour", how, where=f"{T} <= TIMESTAMP '2024-01-30 23:59:59'")) + \
        f"SELECT ts, value AS actual, TRUE AS holds FROM b WHERE ts >= TIMESTAMP '{start}'"


def _band_holds():
    outside = (F.col("actual") < F.col("lower")) | (F.col("actual") > F.col("upper"))
    return ((F.col("lower") >= 0) & (F.col("lower") <= F.col("upper")) & F.col("forecast").isNotNull()
            & (F.col("outside") == outside)).alias("holds")


@fact(_range_bins("2024-01-26 00:00:00"), "actual")
def gbt_forecast_facts(spark, sf):
    """Every bin of the range has a forecast and a band."""
    return Q.QUERIES["gbt_forecast"](spark, sf).select("ts", "actual", _band_holds())


MODELLED = with_(*BASE, long("l", "feat", Q.MODEL_METRICS, {"30m": "30 minutes", "1h": "1 hour"}, "mean", where=f"{T} <= TIMESTAMP '2024-01-30 23:59:59'"))


@fact(MODELLED + "SELECT metric, resolution, vendor, ts, round(value + 1.3e-8, 6) AS actual, TRUE AS holds FROM l WHERE ts >= TIMESTAMP '2024-01-26 00:00:00' AND value IS NOT NULL")
def registered_forecasts_facts(spark, sf):
    """Every bin of every series has a forecast and a band from the series' own model."""
    out = Q.QUERIES["registered_forecasts"](spark, sf)
    return out.select("metric", "resolution", "vendor", "ts", "actual", _band_holds())


@fact(MODELLED + """SELECT metric, resolution, vendor, count(*) AS n, TRUE AS better, TRUE AS covers
FROM l WHERE ts >= TIMESTAMP '2024-01-26 00:00:00' AND value IS NOT NULL GROUP BY ALL""")
def registered_errors(spark, sf):
    """Registered models err less than last day's values do, and their 95 % bands hold four fifths of unseen bins."""
    rows = S.long_series(Q.trips(spark, sf), Q.MODEL_RESOLUTIONS, metrics=Q.MODEL_METRICS, how="mean").drop("series_id")
    past = rows.select(*Q.KEYS, (F.col("ts") + F.expr("INTERVAL '1' DAY")).alias("ts"), F.col("value").alias("_past"))
    out = Q.checkpointed(Q.QUERIES["registered_forecasts"](spark, sf)).join(past, [*Q.KEYS, "ts"], "left")
    known = F.col("_past").isNotNull()
    model, naive = (F.avg(F.when(known, F.abs(F.col("actual") - F.col(c)))) for c in ("forecast", "_past"))
    return out.groupBy(*Q.KEYS).agg(F.count(F.lit(1)).alias("n"), (model < naive).alias("better"),
                                    (F.count_if(~F.col("outside")) >= 0.8 * F.count(F.lit(1))).alias("covers"))


@fact(_range_bins("2024-01-29 00:00:00"), "actual")
def kernel_regression_facts(spark, sf):
    return Q.QUERIES["kernel_regression"](spark, sf).select("ts", "actual", _band_holds())


@fact(with_(*BASE, bins("b", "", "1 hour", "count"),
            "c AS (SELECT 0 AS step, count(*) FILTER (ts < TIMESTAMP '2024-01-23 00:00:00') AS n FROM b UNION ALL SELECT 1, count(*) FROM b)") +
      "SELECT step, 'ok' AS status, CAST(floor((n - 48) * 0.9) AS BIGINT) AS n_train, step = 1 AS incremental, TRUE AS holds FROM c")
def gbt_incremental_facts(spark, sf):
    """The second update adds its rounds to the first and learns on nine tenths of its rows."""
    out = Q.QUERIES["gbt_incremental"](spark, sf)
    trees = Fc.FRESH_ROUNDS + F.col("step") * Fc.UPDATE_ROUNDS
    good = (F.col("trees") == trees) & (F.col("wape") < 100)
    return out.select("step", "status", "n_train", "incremental", good.alias("holds"))


@fact(with_(*BASE) + f"""SELECT CAST(vendorid AS VARCHAR) AS vendorid, CAST(s.i AS INTEGER) AS step,
  TIMESTAMP '2024-01-30 12:00:00' + s.i * INTERVAL 1 HOUR AS ts, min(c) AS low, max(c) AS high, TRUE AS holds
  FROM (SELECT vendorid, date_trunc('hour', {T}) AS h, count(*)::DOUBLE AS c FROM feat GROUP BY ALL), generate_series(1, 12) s(i)
  GROUP BY ALL""")
def recursive_forecast_facts(spark, sf):
    """Every vendor gets every step, at a value within the least and the greatest of its bins."""
    bins = S.bin_series(Q.trips(spark, sf), "trip_count", "1h", keys=["vendorid"])
    span = bins.groupBy("vendorid").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    out = Q.QUERIES["recursive_forecast"](spark, sf).join(span, "vendorid")
    return out.select("vendorid", "step", "ts", "low", "high", F.col("forecast").between(F.col("low"), F.col("high")).alias("holds"))


@fact("SELECT CAST(i AS VARCHAR) AS vendorid, TRUE AS holds FROM generate_series(1, 3) v(i)")
def per_series_bands(spark, sf):
    """One model of all vendors covers nine tenths of the calibration rows of each, but for a part of a row."""
    rows = Q.checkpointed(S.bin_series(Q.trips(spark, sf), "trip_count", "1h", keys=["vendorid"]))
    model = Fc.fit_forecaster(rows, "1h", keys=["vendorid"])
    held = Fc.training_rows(rows, "1h", ["vendorid"]).filter("part = 'holdout'")
    scored = Fc.banded(model.transform(held).withColumnRenamed("value", "actual"), model, "90")
    covered = F.count_if(~F.col("outside"))
    return scored.groupBy("vendorid").agg((covered >= 0.9 * F.count(F.lit(1)) - 1).alias("holds"))


@fact(with_(*BASE, bins("b", "total_amount", "1 hour")) + """SELECT 'actual' AS kind, least(count(*), 180) AS n, max(ts) AS last_ts FROM b WHERE ts <= TIMESTAMP '2024-01-29 00:00:00'
UNION ALL SELECT 'forecast', 7, TIMESTAMP '2024-01-29 06:00:00'
UNION ALL SELECT 'forecast_past', least(count(*), 180), max(ts) FROM b WHERE ts <= TIMESTAMP '2024-01-29 00:00:00'""")
def live_panel_facts(spark, sf):
    """Rows by kind: what was, what is to come from the last value on, and what had been forecast."""
    return Q.QUERIES["live_panel"](spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


@fact("""SELECT count(DISTINCT CAST(o_orderdate AS DATE)) > 0 AS has_days, 180 AS n_days, TRUE AS holds FROM orders""")
def annual_anomaly_facts(spark, sf):
    """Every new day with a year behind it is judged by the one allowed difference."""
    out = Q.QUERIES["annual_anomaly"](spark, sf)
    agree = F.col("is_anomaly") == (F.abs(F.col("value") - F.col("forecast")) > F.col("q"))
    near = F.abs(F.abs(F.col("value") - F.col("forecast")) - F.col("q")) < 1e-4
    return out.agg((F.count(F.lit(1)) > 0).alias("has_days"), F.count(F.lit(1)).cast("int").alias("n_days"), all_true(agree | near))


@fact("SELECT 8 AS n_settings, TRUE AS holds FROM events HAVING count(*) > 0")
def setting_search_facts(spark, sf):
    """All settings are scored, best first."""
    out = Q.QUERIES["setting_search"](spark, sf)
    rows = [r["wape"] for r in out.collect()]
    return spark.createDataFrame([(len(rows), rows == sorted(rows) and rows[-1] < Fc.FAILED_SCORE)], "n_settings int, holds boolean")


@fact(with_(*BASE, bins("b", "total_amount", "1 hour")) + "SELECT strftime(ts, '%Y-%m-%d') AS origin, CAST(hour(ts) AS INTEGER) AS step, TRUE AS holds FROM b QUALIFY lag(value, 24) OVER (ORDER BY ts) IS NOT NULL")
def residual_band_facts(spark, sf):
    """Every forecast has ordered quantiles."""
    out = Q.QUERIES["residual_band"](spark, sf)
    return out.select("origin", "step", F.col("median").between(F.col("lower"), F.col("upper")).alias("holds"))


# -- samples ------------------------------------------------------------------

@fact(with_(RAW) + "SELECT least(500, count(*)) AS n, least(500, count(*)) AS n_ids, least(500, count(*)) AS n_known FROM raw")
def sampled_rows_facts(spark, sf):
    """So many rows, all different, all from the table."""
    out = Q.QUERIES["sampled_rows"](spark, sf)
    known = out.join(Q.raw(spark, sf).select("id", "vendorid"), ["id", "vendorid"], "left_semi").count()
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.lit(known).cast("long").alias("n_known"))


@fact("SELECT 200 AS n, 200 AS n_draws, TRUE AS holds")
def random_windows_facts(spark, sf):
    """Each draw is a whole window within its series."""
    out = Q.QUERIES["random_windows"](spark, sf)
    whole = (F.col("n_context") == 48) & (F.col("n_target") == 24) & (F.col("start") >= 0)
    return out.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("draw").cast("int").alias("n_draws"), all_true(whole))


# -- streams ------------------------------------------------------------------

@pipeline.together
def last_value(pipe, blocks):
    """A cheap model: the last value of the series."""
    rows = pipe.bins(blocks[0], blocks[-1])
    before = F.lag("value").over(Window.partitionBy("metric").orderBy("ts"))
    sums = rows.withColumn("d", F.abs(F.col("value") - before)).groupBy("metric", "window").agg(
        F.sum("d").alias("s"), F.count("d").alias("k"), F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for metric in pipe.settings.metrics:
        for block in blocks:
            seen = [r for r in sums if r["metric"] == metric and r["window"] <= block]
            pairs = sum(r["k"] for r in seen)
            out[metric, block] = {"status": "ok", "n_train": sum(r["n"] for r in seen),
                                  "mae": sum(r["s"] or 0.0 for r in seen) / pairs if pairs else None}
    return out


def _cheap_pipe(spark):
    settings = pipeline.Settings(metrics=("trip_count",), models=("last_value",))
    return pipeline.BlockPipeline(spark, Q.scratch(spark, "pipe"), settings, {"last_value": last_value})


@fact(with_(*BASE) + f"""SELECT CAST(row_number() OVER (ORDER BY date_trunc('day', {T})) - 1 AS INTEGER) AS window_index, min({T}) AS ts_start, max({T}) AS ts_end,
  count(*) AS n_raw, count(*) FILTER ({UNUSABLE}) AS n_unusable, 'ok' AS status, TRUE AS holds FROM feat WHERE {ON_TIME} GROUP BY date_trunc('day', {T})""")
def stream_windows(spark, sf):
    """Each day of the stream is cleaned once, with the rows that came in time."""
    pipe = _cheap_pipe(spark)
    Q.feed(spark, sf, lambda stream: pipe.run(stream, flush=False))
    pipe.finish()
    return pipe.telemetry().select("window_index", "ts_start", "ts_end", "n_raw", "n_unusable", "status",
                                   _share_holds(schema.STREAM_CONTAMINATION).alias("holds"))


@fact(with_(*BASE) + f"SELECT strftime({T}, '%Y-%m-%dT00-00') AS block, count(*) AS n_late FROM feat WHERE NOT {ON_TIME} GROUP BY 1")
def stream_late(spark, sf):
    """Rows that came after their block was processed, by block."""
    pipe = _cheap_pipe(spark)
    Q.feed(spark, sf, lambda stream: pipe.run(stream, flush=False))
    pipe.finish()
    return pipe.late().groupBy(F.col("block").cast("string").alias("block")).agg(F.sum("n_late").alias("n_late"))


@fact(with_(*BASE) + f"""SELECT FALSE AS running, count(*) AS input_rows, count(*) FILTER (NOT {ON_TIME}) AS late_rows,
  TRUE AS survives FROM feat""")
def stream_status(spark, sf):
    """Rows read and dropped as late, added up over six runs of a query, and again by a log that starts from the stored table."""
    out, offsets, folder = (Q.scratch(spark, x) for x in ("out", "offsets", "log"))
    found = []

    def consume(stream):
        with sources.StreamLog(spark, folder) as log:
            query = (sources.late_counted(stream, "2 days").writeStream.format("parquet").option("checkpointLocation", offsets)
                     .outputMode("append").trigger(availableNow=True).start(out))
            query.awaitTermination()
            found.append(log.status(query))

    Q.feed(spark, sf, consume)
    last, stored = found[-1], sources.StreamLog(spark, folder).totals()
    survives = len(stored) == 1 and list(stored.values())[0]["late_rows"] == last["late_rows"]
    return spark.createDataFrame([(last["running"], last["input_rows"], last["late_rows"], survives)],
                                 "running boolean, input_rows long, late_rows long, survives boolean")


@fact(with_(*BASE) + f"""SELECT 'trip_count' AS metric, count(DISTINCT CAST({T} AS DATE)) AS n, TRUE AS holds FROM feat WHERE {ON_TIME}
UNION ALL SELECT 'total_amount', count(DISTINCT CAST({T} AS DATE)), TRUE FROM feat WHERE {ON_TIME}""")
def stream_boosted(spark, sf):
    """The default models learn in every window once 108 bins are there, on ever more bins, with an error below the mean's own spread."""
    out = Q.QUERIES["stream_telemetry"](spark, sf)
    later = F.col("window_index") >= 8
    good = F.when(F.col("window_index") < 4, F.col("status") == "warmup").when(
        later, (F.col("status") == "ok") & (F.col("n_train") > 100) & F.col("wape").between(0, 100) & (F.col("mae") >= 0)).otherwise(True)
    return out.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), all_true(good))


@fact(with_(*BASE) + f"SELECT min({T}) AS ts_start, max({T}) AS ts_end, count(*) AS n_raw, count(*) FILTER ({UNUSABLE}) AS n_unusable, 'ok' AS status, TRUE AS holds FROM feat WHERE CAST({T} AS DATE) = DATE '2024-01-11'")
def day_retrained(spark, sf):
    """A day cleaned and learnt after the days before it were warmed up."""
    pipe = _cheap_pipe(spark)
    pipe.prewarm(Q.trips(spark, sf), "2024-01-11")
    return pipe.retrain(Q.trips(spark, sf), "2024-01-11").select(
        "ts_start", "ts_end", "n_raw", "n_unusable", "status", _share_holds(schema.STREAM_CONTAMINATION).alias("holds"))


@fact(with_(*BASE, f"""d AS (SELECT vendorid, date_trunc('day', {T})::TIMESTAMP AS ts, count(total_amount) AS n, TRUE AS holds
FROM feat WHERE {ON_TIME} GROUP BY 1, 2)""") + f"SELECT * FROM d WHERE n > 0 AND ts + INTERVAL 1 DAY {CLOSED}")
def stream_medians(spark, sf):
    """Daily medians of each vendor from sketches in the stream: their ranks among the day's rows are within one percent, or one row, of the middle."""
    out = Q.drained(spark, sf, lambda s: sources.stream_bin_medians(s, "total_amount", "1d", "2 days", ["vendorid"]))
    out = out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows = Q.trips(spark, sf).filter(~(F.expr(Q.LATE) & (F.dayofmonth(PICKUP) <= 6))).select(
        "vendorid", F.date_trunc("day", PICKUP).cast("timestamp_ntz").alias("ts"), F.col("total_amount").alias("_v")).dropna(subset=["_v"])
    ranked = rows.join(out, ["vendorid", "ts"]).groupBy("vendorid", "ts", "n").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_v") < F.col("value")).alias("_low"), F.count_if(F.col("_v") <= F.col("value")).alias("_high"))
    slack = F.greatest(F.lit(1.0), F.col("n") * 0.01)
    holds = (F.col("_n") == F.col("n")) & (F.col("_low") <= F.col("n") / 2 + slack) & (F.col("_high") >= F.col("n") / 2 - slack)
    return ranked.select("vendorid", "ts", "n", holds.alias("holds"))
