"""The same results as ``checks.queries`` in DuckDB SQL."""

from __future__ import annotations

TRAIN_END = "TIMESTAMP '2024-01-23 00:00:00'"
LOW, HIGH = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-20 00:00:00'"

RAW = """raw AS (
  SELECT event_id AS id, CAST(event_id % 3 + 1 AS VARCHAR) AS vendorid,
    ts AS tpep_pickup_datetime, ts + to_minutes(k) AS tpep_dropoff_datetime,
    1 + user_id % 6 AS passenger_count, value / 10 AS trip_distance, value * 0.8 AS fare_amount,
    value * 0.15 AS tip_amount, value * 0.05 AS tolls_amount, value AS total_amount,
    user_id AS pulocationid, k AS dolocationid, event_type
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""


def feat(name="feat", mode="null", source="raw"):
    eps = " ELSE {} / 0.001" if mode == "eps" else ""
    return f"""{name} AS (
  SELECT *, CASE WHEN trip_duration_minutes / 60.0 > 0 THEN trip_distance / (trip_duration_minutes / 60.0){eps.format('trip_distance')} END AS trip_speed_mph,
    CASE WHEN trip_distance > 0 THEN total_amount / trip_distance{eps.format('total_amount')} END AS price_per_distance
  FROM (SELECT *, date_sub('second', tpep_pickup_datetime, tpep_dropoff_datetime) / 60.0 AS trip_duration_minutes FROM {source}))"""


FULL = """full_ AS (
  SELECT *, CAST(count(*) OVER h AS DOUBLE) AS hourly_trip_volume, avg(trip_speed_mph) OVER h AS hourly_avg_speed
  FROM feat WINDOW h AS (PARTITION BY date_trunc('hour', tpep_pickup_datetime)))"""
ENTRIES = """entries AS (
  SELECT *, pulocationid AS added_by, tpep_pickup_datetime AS added_at, dolocationid % 5 = 0 AS is_deleted,
    CASE WHEN dolocationid % 5 = 0 THEN pulocationid % 10 END AS deleted_by,
    CASE WHEN dolocationid % 5 = 0 THEN tpep_pickup_datetime + INTERVAL 1 DAY END AS deleted_at
  FROM raw WHERE event_type = 'signup')"""
USERS = "users AS (SELECT DISTINCT user_id AS id, 'user_' || user_id AS username FROM events)"
METRICS = ["passenger_count", "trip_distance", "fare_amount", "tip_amount", "tolls_amount", "total_amount",
           "trip_duration_minutes", "trip_speed_mph", "price_per_distance", "hourly_trip_volume", "hourly_avg_speed"]


def bins(name, metric, width, how="mean", source="feat", where="TRUE"):
    agg = {"mean": f"avg({metric})", "median": f"quantile_cont({metric}, 0.5)",
           "count": "CAST(count(*) AS DOUBLE)"}[how]
    return f"""{name} AS (SELECT time_bucket(INTERVAL '{width}', tpep_pickup_datetime) AS ts, {agg} AS value
  FROM {source} WHERE {where} GROUP BY 1)"""


def long(name, source, metrics, widths, how="median", vendors=("all", "1", "2"), where="TRUE"):
    agg = "quantile_cont({}, 0.5)" if how == "median" else "avg({})"
    cols = ", ".join(f"{agg.format(m)} AS {m}" for m in metrics)
    values = ", ".join(f"('{r}', INTERVAL '{w}')" for r, w in widths.items())
    own = ", ".join(f"'{v}'" for v in vendors if v != "all")
    return f"""{name}_x AS (
  SELECT f.*, v.vendor, r.resolution, time_bucket(r.w, f.tpep_pickup_datetime) AS ts
  FROM {source} f
  JOIN (SELECT id, 'all' AS vendor FROM {source} UNION ALL SELECT id, vendorid FROM {source} WHERE vendorid IN ({own})) v ON f.id = v.id
  CROSS JOIN (VALUES {values}) r(resolution, w) WHERE {where}),
{name}_w AS (SELECT resolution, vendor, ts, CAST(count(*) AS DOUBLE) AS trip_count, {cols} FROM {name}_x GROUP BY ALL),
{name} AS (SELECT metric || '__' || resolution || '__' || vendor AS series_id, metric, resolution, vendor, ts, value
  FROM (UNPIVOT {name}_w ON trip_count, {', '.join(metrics)} INTO NAME metric VALUE value))"""


def with_(*parts):
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (RAW, feat())
SOME = (*BASE, FULL, long("some0", "full_", METRICS, {"1h": "1 hour", "3h": "3 hours"}),
        """sm AS (SELECT *, CASE WHEN ts >= (SELECT date_trunc('day', max(ts)) - INTERVAL 8 DAY FROM some0) THEN 'val' ELSE 'train' END AS split FROM some0)""")


def profile(name, source, keys="", floor=True, monday=False):
    k = f"{keys}, " if keys else ""
    wd = "isodow(ts) - 1" if monday else "dayofweek(ts)"
    low = "greatest(quantile_cont(abs(value - expected), 0.5), 1e-9)" if floor else "quantile_cont(abs(value - expected), 0.5)"
    return f"""{name}_s AS (SELECT *, {wd} AS wd, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS tb FROM {source} WHERE value IS NOT NULL),
{name} AS (SELECT {k}wd, tb, any_value(expected) AS expected, {low} AS mad
  FROM (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY {k}wd, tb) AS expected FROM {name}_s) GROUP BY {k}wd, tb)"""


def z(value="value", center="expected", spread="mad", zero="1e-9"):
    return f"0.6745 * ({value} - {center}) / (CASE WHEN {spread} = 0 THEN {zero} ELSE {spread} END)"


BACKTEST = (*SOME,
  "pos AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS p, count(*) FILTER (split = 'train') OVER (PARTITION BY series_id) AS v0 FROM sm)",
  "val AS (SELECT *, v0 + ((p - v0) // 24) * 24 AS origin, (p - v0) % 24 + 1 AS step FROM pos WHERE split = 'val')")


def seasonal(name, season):
    return f"""{name} AS (SELECT a.metric, a.resolution, a.vendor, a.series_id, a.ts, a.step, a.value AS actual, b.value AS forecast
  FROM val a JOIN pos b ON a.series_id = b.series_id AND b.p = a.origin - {season} + (a.step - 1) % {season})"""


def errors(source, keys):
    return f"""SELECT {keys}, count(*) AS n, sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0) * 100 AS wape_pct,
  avg(CASE WHEN actual <> 0 THEN abs(actual - forecast) / abs(actual) END) * 100 AS mape_pct,
  avg(abs(actual - forecast)) AS mae, sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse,
  avg(abs(actual - forecast)) / nullif(avg(abs(actual - prev)), 0) AS mase
  FROM (SELECT *, lag(actual) OVER (PARTITION BY {keys} ORDER BY ts) AS prev FROM {source} WHERE actual IS NOT NULL AND forecast IS NOT NULL)
  GROUP BY {keys}"""


HOLIDAY_FIXED = "((month({0}) = 1 AND day({0}) = 1) OR (month({0}) = 7 AND day({0}) = 4) OR (month({0}) = 11 AND day({0}) = 11) OR (month({0}) = 12 AND day({0}) = 25))"
HOLIDAY = f"""({HOLIDAY_FIXED.format('day')}
  OR (month(day) = 1 AND isodow(day) = 1 AND day(day) BETWEEN 15 AND 21) OR (month(day) = 2 AND isodow(day) = 1 AND day(day) BETWEEN 15 AND 21)
  OR (month(day) = 5 AND isodow(day) = 1 AND day(day) BETWEEN 25 AND 31) OR (month(day) = 9 AND isodow(day) = 1 AND day(day) BETWEEN 1 AND 7)
  OR (month(day) = 10 AND isodow(day) = 1 AND day(day) BETWEEN 8 AND 14) OR (month(day) = 11 AND isodow(day) = 4 AND day(day) BETWEEN 22 AND 28)
  OR (isodow(day) = 5 AND {HOLIDAY_FIXED.format("CAST(day + INTERVAL 1 DAY AS DATE)")}) OR (isodow(day) = 1 AND {HOLIDAY_FIXED.format("CAST(day - INTERVAL 1 DAY AS DATE)")}))"""
DAILY = """days AS (SELECT CAST(o_orderdate AS DATE) AS day, quantile_cont(o_totalprice, 0.5) AS value FROM orders GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM days)::TIMESTAMP, (SELECT max(day) FROM days)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day),
gaps AS (SELECT s.day, d.value,
    last_value(CASE WHEN d.value IS NOT NULL THEN s.day END IGNORE NULLS) OVER past AS a, last_value(d.value IGNORE NULLS) OVER past AS av,
    first_value(CASE WHEN d.value IS NOT NULL THEN s.day END IGNORE NULLS) OVER ahead AS b, first_value(d.value IGNORE NULLS) OVER ahead AS bv
  FROM spine s LEFT JOIN days d ON s.day = d.day
  WINDOW past AS (ORDER BY s.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (ORDER BY s.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
daily AS (SELECT day, coalesce(value, av + (bv - av) * (day - a) / nullif(b - a, 0), av, bv) AS value FROM gaps)"""

WINDOW_SUM = """SELECT {keys}o.origin, o.origin_ts, count(*) FILTER (w.p < o.origin) AS n_context, count(*) FILTER (w.p >= o.origin) AS n_target,
  max(CASE WHEN w.p = o.origin - {C} THEN w.value END) AS first_value, sum(w.value) FILTER (w.p < o.origin) AS context_sum, sum(w.value) FILTER (w.p >= o.origin) AS target_sum
  FROM {o} o JOIN {p} w ON w.p >= o.origin - {C} AND w.p < o.origin + {H}{on} GROUP BY ALL"""

SLOTS = (*BASE, bins("b", "total_amount", "3 hours"),
  "st AS (SELECT avg(value) AS m, stddev_pop(value) AS s, stddev_pop(dayofweek(ts)) AS sw, stddev_pop(hour(ts)) AS sh, count(*) AS n FROM b)",
  "pt AS (SELECT ts, (value - m) / s AS v, dayofweek(ts) AS w, hour(ts) AS h, sw, sh, n FROM b CROSS JOIN st)",
  "ds AS (SELECT a.ts, b.ts AS other, sqrt((a.v - b.v) ** 2 + ((a.w - b.w) / a.sw) ** 2 + ((a.h - b.h) / a.sh) ** 2) AS d, a.n FROM pt a CROSS JOIN pt b)",
  "nn AS (SELECT ts, any_value(n) AS n, list_sort(list(d)) AS l FROM ds GROUP BY ts)",
  "knn AS (SELECT ts, l[least(5, n - 1)] AS knn FROM nn)")


def rolling(source, score="z", k=2.0):
    """Local deviation and blended score over an ordered series ``source``."""
    return (f"lm AS (SELECT *, value - median(value) OVER (ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS dev, count(*) OVER () AS n_rows FROM {source})",
            "ls AS (SELECT *, greatest((SELECT quantile_cont(abs(dev), 0.5) FROM lm), 1e-9) AS scale FROM lm)",
            f"bl AS (SELECT *, CASE WHEN n_rows < 5 THEN {score} ELSE 0.4 * (CASE WHEN {score} < 0 THEN 0 ELSE {score} END) + 0.6 * (CASE WHEN 0.6745 * dev / scale < 0 THEN 0 ELSE 0.6745 * dev / scale END) END AS score FROM ls)")


def mad_chain(columns, k=3.0):
    """Nested steps: each column judged on the rows the previous one kept."""
    out, source = [], "sane"
    for i, c in enumerate(columns):
        out += [f"m{i} AS (SELECT quantile_cont({c}, 0.5) AS med FROM {source})",
                f"d{i} AS (SELECT quantile_cont(abs({c} - med), 0.5) AS mad FROM {source}, m{i})",
                f"k{i} AS (SELECT s.* FROM {source} s, m{i}, d{i} WHERE abs({z(c, 'med', 'mad')}) <= {k})"]
        source = f"k{i}"
    return out, source


TWINS: dict[str, str] = {}
DOUBLES: dict[str, list[str]] = {}


def twin(name, sql, doubles=()):
    """Register SQL; ``doubles`` are rounded as the queries round theirs."""
    names = doubles.split() if isinstance(doubles, str) else list(doubles)
    if names:
        sql = "SELECT * REPLACE (" + ", ".join(f"round({c} + 1.3e-8, 6) + 0.0 AS {c}" for c in names) + f") FROM (\n{sql}\n)"
    TWINS[name] = sql


# -- records ------------------------------------------------------------------
FEATS = "trip_duration_minutes trip_speed_mph price_per_distance"
twin("trip_features", with_(*BASE) + """SELECT id, trip_duration_minutes, trip_speed_mph, price_per_distance FROM feat
WHERE trip_duration_minutes > 0 AND trip_distance >= 0 AND total_amount >= 0""", FEATS)
twin("trip_features_eps", with_(RAW, feat(mode="eps")) + "SELECT id, trip_duration_minutes, trip_speed_mph, price_per_distance FROM feat", FEATS)
twin("trips_filtered", with_(*BASE) + f"""SELECT id, tpep_pickup_datetime, vendorid, trip_distance, trip_speed_mph FROM feat
WHERE tpep_pickup_datetime BETWEEN {LOW} AND {HIGH} AND vendorid = '2' AND (trip_distance IS NULL OR trip_distance BETWEEN 0.5 AND 20)
  AND (trip_speed_mph IS NULL OR trip_speed_mph >= 1)""", "trip_distance trip_speed_mph")
twin("hour_slice", with_(RAW) + """SELECT id, tpep_pickup_datetime, total_amount FROM raw
WHERE tpep_pickup_datetime >= TIMESTAMP '2024-01-10 08:00:00' AND tpep_pickup_datetime < TIMESTAMP '2024-01-10 09:00:00'""", "total_amount")
twin("null_features_dropped", with_(*BASE) + "SELECT id, vendorid FROM feat WHERE trip_speed_mph IS NOT NULL AND price_per_distance IS NOT NULL")
twin("trips_page", with_(RAW) + """SELECT CAST(id AS VARCHAR) AS id, strftime(tpep_pickup_datetime, '%Y-%m-%d %H:%M') AS tpep_pickup_datetime, vendorid,
  printf('%.2f', total_amount) AS total_amount, CAST(row_number() OVER (ORDER BY p.tpep_pickup_datetime DESC, p.id) + 25 AS VARCHAR) AS row_index
FROM (SELECT * FROM raw ORDER BY tpep_pickup_datetime DESC, id LIMIT 25 OFFSET 25) p""")
twin("trips_export", with_(*BASE) + """SELECT id, strftime(tpep_pickup_datetime, '%Y-%m-%d %H:%M') AS tpep_pickup_datetime, vendorid, total_amount, trip_speed_mph
FROM feat WHERE vendorid = '1'""", "total_amount trip_speed_mph")
twin("month_slice", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1997-04-01'")
ALIGNED = """vendorid, tpep_pickup_datetime, tpep_dropoff_datetime, passenger_count, trip_distance, fare_amount, tip_amount, tolls_amount, total_amount"""
twin("schema_aligned", with_(RAW) + f"""SELECT {ALIGNED}, pulocationid, dolocationid, CAST(NULL AS DOUBLE) AS trip_duration_minutes, CAST(NULL AS DOUBLE) AS trip_speed_mph,
  CAST(NULL AS DOUBLE) AS price_per_distance, CAST(NULL AS INTEGER) AS hourly_trip_volume, CAST(NULL AS DOUBLE) AS hourly_avg_speed FROM raw""",
  "trip_distance fare_amount tip_amount tolls_amount total_amount")
twin("monthly_files", with_(RAW) + f"""SELECT {ALIGNED}, CASE WHEN tpep_pickup_datetime < {TRAIN_END} THEN pulocationid END AS pulocationid,
  CASE WHEN tpep_pickup_datetime < {TRAIN_END} THEN dolocationid END AS dolocationid FROM raw""", "trip_distance fare_amount tip_amount tolls_amount total_amount")
twin("insert_ignore", with_(RAW) + f"SELECT id, vendorid, total_amount FROM raw WHERE tpep_pickup_datetime >= {TRAIN_END}", "total_amount")
INTRADAY = lambda metric: (*BASE, bins("b", metric, "1 hour"), profile("pr", "b", floor=False, monday=True),
  f"iz AS (SELECT s.*, expected, mad, {z(zero='NULL')} AS z FROM pr_s s LEFT JOIN pr USING (wd, tb))")
twin("result_cache", with_(*INTRADAY("total_amount")) + f"SELECT ts, value AS actual, expected, z FROM iz WHERE ts BETWEEN {LOW} AND {HIGH}", "actual expected z")
PROV = (RAW, ENTRIES, USERS, """prov AS (SELECT id, tpep_pickup_datetime, vendorid, 'raw' AS source, CAST(NULL AS BIGINT) AS added_by, '—' AS added_by_name FROM raw
  UNION ALL SELECT e.id, tpep_pickup_datetime, vendorid, 'manual', added_by, username FROM entries e LEFT JOIN users u ON e.added_by = u.id WHERE NOT is_deleted)""")
twin("union_provenance", with_(*PROV) + "SELECT * FROM prov")
twin("manual_of_user", with_(*PROV) + "SELECT id, source, added_by, added_by_name FROM prov WHERE source = 'manual' AND added_by = 7")
twin("activity_log", with_(RAW, ENTRIES, USERS, """ev AS (
  SELECT id AS entry_id, added_at AS time, 'added' AS action, added_by AS user_id, * EXCLUDE (added_by, added_at) FROM entries
  UNION ALL SELECT id, deleted_at, 'deleted', deleted_by, * EXCLUDE (added_by, added_at) FROM entries WHERE is_deleted)""") +
"""SELECT entry_id, time, action, user_id,
  '#' || entry_id || ' · ' || strftime(tpep_pickup_datetime, '%Y-%m-%d %H:%M') || ' · vendor ' || vendorid || ' · fare ' || coalesce(CAST(fare_amount AS VARCHAR), '—') AS summary,
  coalesce(username, '—') AS "user" FROM ev LEFT JOIN users u ON ev.user_id = u.id""")
twin("entry_names", with_(RAW, ENTRIES, USERS) + """SELECT e.id, coalesce(a.username, '—') AS added_by_name, coalesce(d.username, '—') AS deleted_by_name
FROM entries e LEFT JOIN users a ON e.added_by = a.id LEFT JOIN users d ON e.deleted_by = d.id""")
twin("user_summary", with_(RAW, ENTRIES, USERS) + """SELECT u.id, username, coalesce(a.t, 0) AS added_total, coalesce(a.act, 0) AS added_active, coalesce(d.n, 0) AS deleted_by_me, a.l AS last_added
FROM users u LEFT JOIN (SELECT added_by, count(*) AS t, count(*) FILTER (NOT is_deleted) AS act, max(added_at) AS l FROM entries GROUP BY 1) a ON u.id = a.added_by
LEFT JOIN (SELECT deleted_by, count(*) AS n FROM entries WHERE deleted_by IS NOT NULL GROUP BY 1) d ON u.id = d.deleted_by""")
twin("users_with_entries", with_(RAW, ENTRIES, USERS) + "SELECT * FROM users WHERE id IN (SELECT added_by FROM entries)")
twin("recent_entries", with_(RAW, ENTRIES) + "SELECT id, added_at, added_by FROM entries WHERE NOT is_deleted ORDER BY added_at DESC, id LIMIT 500")
ENTRY_SPEED = "CASE WHEN trip_distance <> 0 AND dolocationid > 0 THEN trip_distance / (dolocationid / 60.0) END"
twin("entry_metrics", with_(RAW, ENTRIES) + f"""SELECT id, {ENTRY_SPEED} AS trip_speed_mph,
  CASE WHEN total_amount <> 0 AND trip_distance > 0 THEN total_amount / trip_distance END AS price_per_distance FROM entries""", "trip_speed_mph price_per_distance")
twin("hour_context", with_(*BASE, ENTRIES,
  f"t AS (SELECT date_trunc('hour', tpep_pickup_datetime) AS h, count(*) AS n, avg(trip_speed_mph) AS sp FROM feat WHERE tpep_pickup_datetime < {TRAIN_END} GROUP BY 1)",
  "m AS (SELECT date_trunc('hour', tpep_pickup_datetime) AS h, count(*) AS n FROM entries WHERE NOT is_deleted GROUP BY 1)") +
f"""SELECT e.id, coalesce(t.n, 0) + coalesce(m.n, 0) + 1 AS hourly_trip_volume, coalesce(nullif(t.sp, 0), {ENTRY_SPEED}) AS hourly_avg_speed
FROM entries e LEFT JOIN t ON t.h = date_trunc('hour', e.tpep_pickup_datetime) LEFT JOIN m ON m.h = date_trunc('hour', e.tpep_pickup_datetime)""", "hourly_avg_speed")

# -- scalars ------------------------------------------------------------------
T = "tpep_pickup_datetime"
twin("time_parts", with_(RAW) + f"""SELECT id, date_trunc('minute', {T}) AS minute_start, date_trunc('hour', {T}) AS hour_start, CAST(date_trunc('day', {T}) AS TIMESTAMP) AS day_start,
  time_bucket(INTERVAL '15 minutes', {T}) AS quarter_start, CAST(dayofweek({T}) AS INTEGER) AS wd, CAST(hour({T}) AS INTEGER) AS hour, CAST(minute({T}) AS INTEGER) AS minute,
  CAST(second({T}) AS INTEGER) AS second, CAST(hour({T}) * 3600 + minute({T}) * 60 + second({T}) AS INTEGER) AS tb, dayname({T}) AS day_name FROM raw""")
twin("coerced_text", """SELECT event_id, try_cast(printf('%.2f', value) AS DOUBLE) AS as_float, CAST(trunc(try_cast(printf('%.2f', value) AS DOUBLE)) AS BIGINT) AS as_int,
  try_cast(event_type AS DOUBLE) AS not_a_number, date_trunc('minute', ts) AS pickup, try_strptime(event_type, '%Y-%m-%d %H:%M') AS not_a_time FROM events""", "as_float not_a_number")
twin("finite_features", with_(*BASE) + "SELECT id, " + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in ["trip_distance", *FEATS.split()]) + " FROM feat", ["trip_distance", *FEATS.split()])
twin("calendar_features", f"""SELECT day, CAST(isodow(day) - 1 AS INTEGER) AS weekday, CAST(month(day) AS INTEGER) AS month, CAST(day(day) AS INTEGER) AS day_of_month,
  CAST(isodow(day) >= 6 AS INTEGER) AS weekend, CAST({HOLIDAY} AS INTEGER) AS holiday FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)""")

# -- bins and series ----------------------------------------------------------
twin("bin_hourly_count", with_(*BASE, bins("b", "", "1 hour", "count")) + "SELECT * FROM b", "value")
twin("bin_3h_median", with_(*BASE, bins("b", "trip_speed_mph", "3 hours", "median")) + "SELECT * FROM b", "value")
twin("bin_1d_mean", with_(*BASE, bins("b", "trip_speed_mph", "1 day", where="vendorid = '2'")) + "SELECT * FROM b", "value")
H = f"time_bucket(INTERVAL '1 hour', {T}) AS ts, count(*) AS trip_count"
twin("bin_all_metrics", with_(*BASE, FULL) + f"SELECT {H}, " + ", ".join(f"quantile_cont({m}, 0.5) AS {m}" for m in METRICS) + " FROM full_ GROUP BY 1", METRICS)
MEANS = f"SELECT {H}, " + ", ".join(f"avg({m}) AS {m}" for m in METRICS) + " FROM full_ GROUP BY 1"
twin("bin_mean_metrics", with_(*BASE, FULL) + MEANS, METRICS)
twin("resampled_mean", with_(*BASE, FULL, f"h AS ({MEANS})") + "SELECT time_bucket(INTERVAL '3 hours', ts) AS ts, " +
     ", ".join(f"avg({m}) AS {m}" for m in ["trip_count", *METRICS]) + " FROM h GROUP BY 1", ["trip_count", *METRICS])
twin("long_series", with_(*BASE, FULL, long("l", "full_", METRICS, {"1h": "1 hour", "3h": "3 hours", "1d": "1 day"})) + "SELECT series_id, ts, value FROM l", "value")
twin("union_bins", with_(*BASE, bins("b", "total_amount", "1 hour", "median")) + "SELECT * FROM b", "value")
twin("series_split", with_(*SOME) + "SELECT series_id, ts, split, value FROM sm", "value")
twin("split_report", with_(*SOME) + "SELECT split, CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT series_id) AS n_series, min(ts) AS first_ts, max(ts) AS last_ts FROM sm GROUP BY 1")
twin("length_report", with_(*SOME) + """SELECT resolution, count(*) AS n_series, min(n) AS min_len, quantile_cont(n, 0.5) AS median_len, max(n) AS max_len
FROM (SELECT resolution, series_id, count(*) AS n FROM sm GROUP BY ALL) GROUP BY 1""", "median_len")
twin("distinct_series", with_(*SOME) + "SELECT DISTINCT series_id, metric, resolution, vendor FROM sm")
twin("series_meta", with_(*SOME) + "SELECT series_id, metric, resolution, vendor, sum(value) AS total FROM sm GROUP BY ALL", "total")
HS = "SELECT id, CAST(hourly_trip_volume AS BIGINT) AS hourly_trip_volume, hourly_avg_speed FROM full_"
twin("hourly_stats_window", with_(*BASE, FULL) + HS, "hourly_avg_speed")
twin("hourly_stats_join", with_(RAW, feat(mode="eps"), FULL) + HS, "hourly_avg_speed")
twin("weekly_profile", with_(*BASE, FULL, long("l", "full_", METRICS, {"1h": "1 hour"}, "mean", where=f"{T} < {TRAIN_END}"),
  profile("pr", "l", "metric, vendor")) + "SELECT metric, vendor, CAST(wd AS INTEGER) AS wd, CAST(tb AS INTEGER) AS tb, expected, mad FROM pr", "expected mad")
twin("training_profiles", with_(*BASE, FULL, long("l", "full_", METRICS, {"1h": "1 hour", "1d": "1 day"}, "mean", where=f"{T} < {TRAIN_END}"),
  "a AS (SELECT metric, resolution, vendor, ts, value FROM l UNION ALL SELECT metric, '3h', vendor, time_bucket(INTERVAL '3 hours', ts), avg(value) FROM l WHERE resolution = '1h' GROUP BY ALL)",
  profile("pr", "a", "metric, resolution, vendor")) + "SELECT metric, resolution, vendor, CAST(wd AS INTEGER) AS wd, CAST(tb AS INTEGER) AS tb, expected, mad FROM pr", "expected mad")
LAGS = [f"lag_{i}" for i in range(1, 25)]
twin("lag_features", with_(*BASE, bins("b", "total_amount", "1 hour"), "l AS (SELECT ts, value, " + ", ".join(
  f"lag(value, {i}) OVER (ORDER BY ts) AS lag_{i}" for i in range(1, 25)) + ", CAST(dayofweek(ts) AS INTEGER) AS wd, CAST(hour(ts) AS INTEGER) AS hour FROM b WHERE value IS NOT NULL)") +
  "SELECT * FROM l WHERE lag_24 IS NOT NULL", ["value", *LAGS])
twin("time_split", with_(*SOME, "p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY series_id) AS n FROM sm)") +
  "SELECT metric, resolution, vendor, ts, value, CASE WHEN p < floor(0.8 * n) THEN 'train' ELSE 'holdout' END AS part FROM p WHERE n >= 300", "value")
twin("context_horizon", with_(*BASE, bins("b", "total_amount", "1 hour"), f"near AS (SELECT *, CASE WHEN ts < {LOW} THEN 'context' ELSE 'horizon' END AS role FROM b WHERE ts BETWEEN {LOW} - INTERVAL 48 HOUR AND {HIGH})") +
  "SELECT ts, value, role FROM near QUALIFY role = 'horizon' OR row_number() OVER (PARTITION BY role ORDER BY ts DESC) <= 48", "value")
twin("fixed_windows", with_(*BASE, bins("b", "total_amount", "1 hour"), "p AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM b)",
  "c AS (SELECT (max(n) - 72) // 6 + 1 AS m FROM p)",
  "ks AS (SELECT DISTINCT CASE WHEN m <= 20 THEN i WHEN i = 19 THEN m - 1 ELSE CAST(floor(i * ((m - 1) / 19.0)) AS BIGINT) END AS k FROM c, generate_series(0, 100000) g(i) WHERE i < least(m, 20))",
  "o AS (SELECT 48 + k * 6 AS origin, p.ts AS origin_ts FROM ks JOIN p ON p.p = 48 + k * 6)") + WINDOW_SUM.format(keys="", C=48, H=24, o="o", p="p", on=""), "first_value context_sum target_sum")
twin("rolling_origins", with_(*SOME, "p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY series_id) AS n, count(*) FILTER (split = 'train') OVER (PARTITION BY series_id) AS v0 FROM sm)",
  "st AS (SELECT DISTINCT series_id, n, v0 + greatest(CAST(ceil((72 - v0) / 24.0) AS BIGINT), 0) * 24 AS o0 FROM p)",
  "c AS (SELECT *, (n - 24 - o0) // 24 + 1 AS m FROM st WHERE n - 24 >= o0)",
  "ks AS (SELECT DISTINCT series_id, o0, CASE WHEN m <= 5 THEN i WHEN i = 4 THEN m - 1 ELSE CAST(floor(i * ((m - 1) / 4.0)) AS BIGINT) END AS k FROM c, generate_series(0, 100) g(i) WHERE i < least(m, 5))",
  "o AS (SELECT ks.series_id, p.metric, p.resolution, p.vendor, o0 + k * 24 AS origin, p.ts AS origin_ts FROM ks JOIN p ON p.series_id = ks.series_id AND p.p = o0 + k * 24)") +
  WINDOW_SUM.format(keys="o.metric, o.resolution, o.vendor, ", C=72, H=24, o="o", p="p", on=" AND w.series_id = o.series_id"), "first_value context_sum target_sum")
twin("naive_diff", with_(*BASE, bins("b", "total_amount", "1 hour")) + "SELECT ts, value, abs(value - lag(value) OVER (ORDER BY ts)) AS naive_diff FROM b", "value naive_diff")
twin("keep_newest", with_(*SOME) + "SELECT metric, resolution, vendor, ts, value FROM sm QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 100", "value")
twin("latest_per_key", "SELECT user_id, event_type, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) = 1", "value")

# -- daily series -------------------------------------------------------------
twin("daily_filled", with_(DAILY) + "SELECT * FROM daily", "value")
twin("calendar_lags", with_(DAILY) + "SELECT d.day, d.value, " + ", ".join(f"l{n}.value AS lag_{n}d" for n in (364, 365, 371)) + " FROM daily d " +
  " ".join(f"LEFT JOIN daily l{n} ON l{n}.day = d.day - {n}" for n in (364, 365, 371)), "value lag_364d lag_365d lag_371d")
twin("trailing_year_mean", with_(DAILY) + "SELECT day, value, avg(value) OVER (ORDER BY day RANGE BETWEEN INTERVAL 395 DAY PRECEDING AND INTERVAL 365 DAY PRECEDING) AS trailing_mean FROM daily", "value trailing_mean")

# -- anomalies ----------------------------------------------------------------
GLOBAL = (*BASE, bins("tr", "total_amount", "1 hour", where=f"{T} < {TRAIN_END}"), bins("te", "total_amount", "1 hour", where=f"{T} >= {TRAIN_END}"), profile("pr", "tr"),
  f"gz AS (SELECT ts, value, CAST(dayofweek(ts) AS INTEGER) AS wd, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS tb, expected, mad, {z()} AS z FROM te LEFT JOIN pr ON pr.wd = dayofweek(ts) AND pr.tb = hour(ts) * 3600 + minute(ts) * 60 + second(ts))")
twin("global_mad", with_(*GLOBAL) + "SELECT *, coalesce(abs(z) > 3, FALSE) AS is_anomaly FROM gz", "value expected mad z")
twin("local_mad", with_(*BASE, bins("b", "", "1 hour", "count", where=f"{T} BETWEEN {LOW} - INTERVAL 1 HOUR AND {HIGH} + INTERVAL 1 HOUR"),
  "nn AS (SELECT greatest(20, count(*) // 10) AS w FROM b)", "c AS (SELECT b.*, w // 2 AS pre, (w - 1) // 2 AS post FROM b, nn)",
  "r1 AS (SELECT *, quantile_cont(value, 0.5) OVER (ORDER BY ts ROWS BETWEEN pre PRECEDING AND post FOLLOWING) AS expected FROM c)",
  "r2 AS (SELECT *, quantile_cont(abs(value - expected), 0.5) OVER (ORDER BY ts ROWS BETWEEN pre PRECEDING AND post FOLLOWING) AS mad FROM r1)") +
  f"SELECT ts, value, expected, mad, {z()} AS z, abs({z()}) > 2.5 AS is_anomaly FROM r2 WHERE ts BETWEEN {LOW} AND {HIGH}", "value expected mad z")
twin("record_mad", with_(*BASE, "m AS (SELECT quantile_cont(total_amount, 0.5) AS med FROM feat)", "d AS (SELECT quantile_cont(abs(total_amount - med), 0.5) AS mad FROM feat, m)") +
  f"SELECT id, {z('total_amount', 'med', 'mad')} AS z, abs({z('total_amount', 'med', 'mad')}) > 3 AS is_anomaly FROM feat, m, d WHERE total_amount IS NOT NULL", "z")
twin("intraday_mad", with_(*INTRADAY("trip_speed_mph")) + """SELECT ts, value, CAST(wd AS INTEGER) AS wd, CAST(tb AS INTEGER) AS tb, expected, mad, z, coalesce(abs(z) > 3.5, FALSE) AS is_anomaly
FROM iz WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""", "value expected mad z")
CHAIN, LAST = mad_chain(["trip_speed_mph", "trip_duration_minutes", "price_per_distance"])
twin("engineered_trips", with_(*BASE, "sane AS (SELECT * FROM feat WHERE trip_duration_minutes > 0 AND trip_distance >= 0 AND total_amount >= 0)", *CHAIN) +
  f"SELECT id, trip_speed_mph, count(*) OVER h AS hourly_trip_volume, avg(trip_speed_mph) OVER h AS hourly_avg_speed FROM {LAST} WINDOW h AS (PARTITION BY date_trunc('hour', {T}))", "trip_speed_mph hourly_avg_speed")
twin("blend_score", with_(*GLOBAL, *rolling("gz")) + "SELECT ts, value, z, score, coalesce(score > 2, FALSE) AS is_anomaly FROM bl", "value z score")
twin("local_deviation", with_(*BASE, bins("b", "total_amount", "1 hour"), "g AS (SELECT *, 0.0 AS z FROM b)", *rolling("g")[:2]) + "SELECT ts, value, dev, n_rows, scale FROM ls", "value dev scale")
twin("series_robust_z", with_(*SOME, "m AS (SELECT series_id, quantile_cont(value, 0.5) AS med FROM sm GROUP BY 1)",
  "d AS (SELECT series_id, any_value(med) AS med, quantile_cont(abs(value - med), 0.5) AS mad FROM sm JOIN m USING (series_id) GROUP BY 1)") +
  f"SELECT metric, resolution, vendor, ts, value, {z('value', 'med', 'mad')} AS z FROM sm JOIN d USING (series_id)", "value z")
twin("standardized", with_(*BASE, bins("b", "total_amount", "1 hour")) + """SELECT ts, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS value,
  (hour(ts) - avg(hour(ts)) OVER ()) / stddev_pop(hour(ts)) OVER () AS hour, 0.0::DOUBLE AS minute FROM b""", "value hour")
twin("knn_distances", with_(*SLOTS) + "SELECT ts, knn FROM knn", "knn")
twin("eps_neighbors", with_(*SLOTS) + "SELECT ts, CAST(count(*) AS BIGINT) AS found FROM ds WHERE d <= 0.75 * (1 + 1e-9) GROUP BY ts")
COUNT_SLOTS = (*BASE, bins("b", "", "3 hours", "count"), *SLOTS[3:])
twin("dbscan_noise", with_(*COUNT_SLOTS, "ep AS (SELECT greatest(quantile_cont(knn, 0.9), 0.3) AS eps FROM knn)",
  "ct AS (SELECT ts, count(*) AS found, any_value(n) AS n FROM ds, ep WHERE d <= eps * (1 + 1e-9) GROUP BY ts)", "core AS (SELECT ts FROM ct WHERE found >= greatest(3, n // 20))",
  "tc AS (SELECT DISTINCT ds.ts FROM ds JOIN core ON core.ts = ds.other CROSS JOIN ep WHERE d <= eps * (1 + 1e-9))",
  "nz AS (SELECT b.ts, b.value, eps, found, tc.ts IS NULL AS is_noise, CASE WHEN tc.ts IS NULL THEN 3.0 ELSE 0.0 END AS z FROM b JOIN ct USING (ts) LEFT JOIN tc USING (ts) CROSS JOIN ep)", *rolling("nz")) +
  "SELECT ts, value, eps, CAST(found AS BIGINT) AS found, is_noise, score, score > 2 AS is_anomaly FROM bl", "value eps score")

# -- calibration and scores ---------------------------------------------------
twin("seasonal_backtest", with_(*BACKTEST, seasonal("f", 24)) + "SELECT metric, resolution, vendor, ts, CAST(step AS INTEGER) AS step, actual, forecast FROM f", "actual forecast")
NAIVE = (*BASE, bins("b", "total_amount", "1 hour"), "nv AS (SELECT ts, value AS actual, lag(value, 24) OVER (ORDER BY ts) AS forecast FROM b)")
twin("seasonal_naive", with_(*NAIVE) + "SELECT ts, actual AS value, forecast FROM nv", "value forecast")
EK = "metric, resolution, vendor"
twin("forecast_metrics", with_(*BACKTEST, seasonal("f", 24)) + errors("f", EK), "wape_pct mape_pct mae rmse mase")
twin("wape_by_resolution", with_(*BACKTEST, seasonal("f", 24), f"e AS ({errors('f', EK)})") +
  "SELECT resolution, 'seasonal' AS tag, quantile_cont(wape_pct, 0.5) AS wape_pct, quantile_cont(mase, 0.5) AS mase FROM e GROUP BY 1", "wape_pct mase")
twin("compare_tags", with_(*BACKTEST, seasonal("f", 24), seasonal("g", 12), f"e AS ({errors('f', EK)})", f"h AS ({errors('g', EK)})",
  "t AS (SELECT *, 's24' AS tag FROM e UNION ALL SELECT *, 's12' FROM h)") + "SELECT resolution, " + ", ".join(
  f"quantile_cont({m}, 0.5) FILTER (tag = '{s}') AS {s}_{m}" for s in ("s12", "s24") for m in ("wape_pct", "mase")) + " FROM t GROUP BY 1",
  "s12_wape_pct s12_mase s24_wape_pct s24_mase")
twin("conformal_band", with_(*NAIVE, f"w AS (SELECT quantile_cont(abs(actual - forecast), 0.9) AS w FROM nv WHERE ts < {TRAIN_END})") +
  f"""SELECT ts, actual, forecast, w AS half_width, CASE WHEN forecast - w < 0 THEN 0 ELSE forecast - w END AS lower, forecast + w AS upper,
  coalesce(actual < greatest(forecast - w, 0) OR actual > forecast + w, FALSE) AS outside FROM nv, w WHERE ts >= {TRAIN_END}""", "actual forecast half_width lower upper")
twin("local_scale_band", with_(*NAIVE, "w AS (SELECT quantile_cont(abs(actual - forecast), 0.95) AS w, avg(abs(forecast)) AS m FROM nv)") +
  "SELECT avg(w * abs(forecast) / m) AS mean_half_width FROM nv, w WHERE forecast IS NOT NULL UNION ALL SELECT w FROM w", "mean_half_width")
twin("cqr_band", with_(*NAIVE, "r AS (SELECT *, forecast * 0.9 AS lo, forecast * 1.1 AS hi FROM nv WHERE forecast IS NOT NULL)",
  "q AS (SELECT quantile_cont(greatest(lo - actual, actual - hi), 0.9) AS q FROM r)") + "SELECT ts, actual, greatest(lo - q, 0) AS lower, hi + q AS upper, q FROM r, q", "actual lower upper q")
twin("sample_band", with_(*BASE, bins("b", "total_amount", "1 hour")) + "SELECT CAST(hour(ts) AS INTEGER) AS step, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper FROM b GROUP BY 1", "median lower upper")
twin("lagged_wape", with_(*BASE, bins("b", "total_amount", "1 hour"), "f AS (SELECT ts + INTERVAL 1 DAY AS ts, ts AS made_at, value AS forecast FROM b UNION ALL SELECT ts + INTERVAL 2 DAY, ts, value FROM b)",
  "g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ts ORDER BY made_at DESC) = 1)") + "SELECT count(*) AS n, sum(abs(value - forecast)) / nullif(sum(abs(value)), 0) AS wape_frac FROM b JOIN g USING (ts)", "wape_frac")

# -- blocks and windows -------------------------------------------------------
twin("block_daily", with_(*BASE, f"m AS (SELECT CAST(date_trunc('day', {T}) AS TIMESTAMP) AS block, trip_speed_mph IS NOT NULL AND price_per_distance IS NOT NULL AS usable, coalesce(trip_speed_mph > 60, FALSE) AS a FROM feat)") +
  """SELECT block, count(*) AS n_raw, count(*) FILTER (NOT usable) AS n_unusable, count(*) FILTER (a) AS n_anomaly, count(*) FILTER (usable AND NOT a) AS n_clean,
  round(count(*) FILTER (a) / count(*), 4) AS anom_rate FROM m GROUP BY 1""", "anom_rate")
twin("latest_windows", with_(*BASE) + f"""SELECT CAST(dayofyear({T}) AS INTEGER) AS window_index, min({T}) AS ts_start, count(*) AS n_raw, count(*) FILTER (trip_speed_mph > 60) AS n_anomaly,
  count(*) - count(*) FILTER (trip_speed_mph > 60) AS n_clean, round(count(*) FILTER (trip_speed_mph > 60) / count(*), 4) AS anom_rate FROM feat GROUP BY 1 ORDER BY 1 DESC LIMIT 20""", "anom_rate")
twin("count_windows", with_(RAW, f"p AS (SELECT *, row_number() OVER (ORDER BY {T}, id) - 1 AS p, count(*) OVER () AS n FROM raw)",
  "f AS (SELECT greatest((max(n) - 1000) // 200 + 1, 0) AS m, max(n) AS n FROM p)",
  "w AS (SELECT i AS window_index, i * 200 AS a, i * 200 + 1000 AS b FROM f, generate_series(0, 1000000) g(i) WHERE i < m UNION ALL SELECT m, greatest(n - 1000, 0), n FROM f)") +
  f"SELECT window_index, count(*) AS n_rows, min({T}) AS ts_start, max({T}) AS ts_end, sum(total_amount) AS total FROM w JOIN p ON p.p >= a AND p.p < b GROUP BY 1", "total")
ON_TIME = f"(id % 50 <> 7 OR day({T}) > 6)"
CLOSED = f"<= (SELECT max({T}) - INTERVAL 2 DAY FROM feat WHERE {ON_TIME})"
twin("stream_bins", with_(*BASE, bins("b", "total_amount", "1 hour", where=ON_TIME)) + f"SELECT * FROM b WHERE ts + INTERVAL 1 HOUR {CLOSED}", "value")
twin("stream_count_windows", with_(*BASE, f"""r AS (SELECT CAST(vendorid AS VARCHAR) AS vendorid, id, {T} AS ts, total_amount,
  row_number() OVER (PARTITION BY vendorid ORDER BY {T}, id) - 1 AS p FROM feat
  WHERE {ON_TIME} AND {T} <= (SELECT date_trunc('milliseconds', max({T})) FROM feat) - INTERVAL 2 DAY)""",
    "w AS (SELECT vendorid, unnest(range(0, (count(*) - 100) // 40 + 1)) AS window_index FROM r GROUP BY vendorid HAVING count(*) >= 100)")
    + """SELECT w.vendorid, window_index, count(*) AS n, min(id) AS low_id, max(id) AS high_id, min(ts) AS first_ts, max(ts) AS last_ts,
  sum(total_amount) AS total FROM w JOIN r ON r.vendorid = w.vendorid AND p BETWEEN 40 * window_index AND 40 * window_index + 99
  GROUP BY w.vendorid, window_index""", "total")
twin("stream_blocks", with_(*BASE) + f"""SELECT CAST(date_trunc('day', {T}) AS TIMESTAMP) AS block, count(*) AS n_rows, avg(total_amount) AS mean_total FROM feat
WHERE {ON_TIME} AND date_trunc('day', {T}) + INTERVAL 1 DAY {CLOSED} GROUP BY 1""", "mean_total")
twin("stream_two_day_blocks", with_(*BASE) + f"""SELECT time_bucket(INTERVAL 48 HOUR, {T}, TIMESTAMP '1970-01-01') AS block, count(*) AS n_rows, count(*) AS n_batch FROM feat
WHERE {ON_TIME} GROUP BY 1 HAVING time_bucket(INTERVAL 48 HOUR, any_value({T}), TIMESTAMP '1970-01-01') + INTERVAL 2 DAY {CLOSED}""")
twin("stream_matching", with_(*BASE, f"b AS (SELECT CAST(vendorid AS VARCHAR) AS vendorid, date_trunc('hour', {T})::TIMESTAMP AS ts, avg(total_amount) AS value FROM feat GROUP BY 1, 2)",
  """f AS (SELECT vendorid, ts + d * INTERVAL 1 DAY AS ts, ts AS made_at, value AS forecast FROM b CROSS JOIN (VALUES (1), (2)) v(d)
WHERE hour(ts) <> 12 AND (d = 2 OR (CAST(datediff('day', DATE '1970-01-01', CAST(ts + d * INTERVAL 1 DAY AS DATE)) AS BIGINT) * 24 + hour(ts)) % 7 <> 3))""",
  "n AS (SELECT vendorid, ts, max(made_at) AS made_at, arg_max(forecast, made_at) AS forecast FROM f WHERE forecast IS NOT NULL GROUP BY ALL)") +
  """SELECT b.vendorid, b.ts, b.value, n.made_at, n.forecast FROM b LEFT JOIN n ON b.vendorid = n.vendorid AND b.ts = n.ts
WHERE b.ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM b) AND b.ts <= (SELECT max(ts) - INTERVAL 49 HOUR FROM f)""", "value forecast")
