"""Record-level operators: derivation, filters, paging, audit trail and user reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C
from tidemark.functions.joins import join_on
from tidemark.functions.quantiles import scalar_mad
from tidemark.schema import ALL_VENDORS, COUNT_METRIC, GUARD_ROWS, NO_METRICS, PAGE_SIZES, canonical
from tidemark.session import checkpointed, stored_lookup

PICKUP = "tpep_pickup_datetime"


def _timestamp(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")


# -- derivation and cleaning --------------------------------------------------

def derive_features(trips: DataFrame, mode: str = "null") -> DataFrame:
    """Add duration, speed and price per distance."""
    return (
        trips.withColumn("trip_duration_minutes", C.trip_duration_minutes())
        .withColumn("trip_speed_mph", C.trip_speed_mph(mode))
        .withColumn("price_per_distance", C.price_per_distance(mode))
    )


def sanity_filter(trips: DataFrame) -> DataFrame:
    """Positive duration, non-negative distance and total; NULLs drop."""
    return trips.filter(
        "trip_duration_minutes > 0 AND trip_distance >= 0 AND total_amount >= 0")


def mad_clean(trips: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    """Drop outliers column by column, each judged on the rows still left.

    Each step reduces to two numbers, which enter the next step as constants:
    the result is one plain filter over the input.  The input is read once for
    the columns judged, which are stored for the passes of all steps.
    """
    judged, kept = checkpointed(trips.select(*columns)), trips
    for name in columns:
        median, mad = scalar_mad(judged, name)
        if median is None:
            return kept.filter(F.lit(False))
        inside = F.abs(C.robust_z(F.col(name), F.lit(median), F.lit(mad))) <= k
        judged, kept = judged.filter(inside), kept.filter(inside)
    return kept


def hourly_summary(trips: DataFrame) -> DataFrame:
    """Trips and mean speed per pickup hour."""
    return trips.groupBy(C.trunc_hour(PICKUP).alias("pickup_hour")).agg(
        F.count(F.lit(1)).cast("int").alias("hourly_trip_volume"),
        F.avg("trip_speed_mph").alias("hourly_avg_speed"),
    )


def attach_hourly_stats(trips: DataFrame) -> DataFrame:
    """Repeat the hour's volume and mean speed on each of its trips.

    A summary and a join rather than a window over the hour: the summary has one
    row per hour of the data's span and combines map-side, and no hour's trips
    meet in one task.
    """
    plain = trips.drop("hourly_trip_volume", "hourly_avg_speed")
    return join_on(
        plain.withColumn("pickup_hour", C.trunc_hour(PICKUP)),
        stored_lookup(hourly_summary(trips)), ["pickup_hour"], "left",
    ).drop("pickup_hour")


def engineer_trips(trips: DataFrame, clean: bool = True, k: float = 3.0) -> DataFrame:
    """Derive, drop entry errors, optionally remove outliers, add hourly stats."""
    ready = sanity_filter(derive_features(trips))
    if clean:
        ready = mad_clean(ready, ["trip_speed_mph", "trip_duration_minutes", "price_per_distance"], k)
    return attach_hourly_stats(ready)


# -- predicates ---------------------------------------------------------------

def time_range(df: DataFrame, low, high, ts: str = PICKUP) -> DataFrame:
    """Rows between two times, both included."""
    return df.filter(F.col(ts).between(_timestamp(low), _timestamp(high)))


def hour_range(df: DataFrame, hour, ts: str = PICKUP) -> DataFrame:
    """Rows of one hour, its end excluded."""
    start = _timestamp(hour)
    return df.filter((F.col(ts) >= start) & (F.col(ts) < start + F.expr("INTERVAL '1' HOUR")))


def vendor_filter(df: DataFrame, vendor, column: str = "vendorid") -> DataFrame:
    """Rows of one vendor, compared as text; ``all`` keeps everything."""
    vendor = canonical(str(vendor))
    return df if vendor == ALL_VENDORS else df.filter(F.col(column) == F.lit(vendor))


def range_filters(df: DataFrame, bounds: dict[str, tuple], selected: list[str] | None = None) -> DataFrame:
    """Minimum and maximum per column; NULL values and unreadable bounds pass.

    Only ``selected`` columns are filtered (default: all named ones).
    """
    def number(text):
        try:
            return None if text in (None, "") else float(text)
        except (TypeError, ValueError):
            return None

    tests = []
    for name, (low, high) in bounds.items():
        if selected is not None and name not in selected:
            continue
        value = F.col(name)
        if number(low) is not None:
            tests.append(value.isNull() | (value >= number(low)))
        if number(high) is not None:
            tests.append(value.isNull() | (value <= number(high)))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def provenance_filter(df: DataFrame, source: str = "all", added_by="all") -> DataFrame:
    """Rows of one source, and of one user among the manual rows."""
    if source != "all":
        df = df.filter(F.col("source") == source)
    if str(added_by) != "all":
        df = df.filter((F.col("source") == "manual") & (F.col("added_by").cast("string") == str(added_by)))
    return df


def drop_null_features(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def metric_columns(df: DataFrame) -> list[str]:
    """The count metric and every numeric column that is not an identifier."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return [COUNT_METRIC] + [n for n in numeric if n not in NO_METRICS]


def select_visible(df: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen columns that exist, in the frame's order."""
    chosen = set(columns)
    return df.select(*[c for c in df.columns if c in chosen])


def active_entries(entries: DataFrame) -> DataFrame:
    return entries.filter(~F.col("is_deleted"))


# -- paging -------------------------------------------------------------------

def page(df: DataFrame, number: int = 1, size: int = 50, ts: str = PICKUP, tie: str = "id") -> DataFrame:
    """One page, newest first, with a running ``row_index`` from 1.

    Sizes other than 25, 50 and 100 mean 50.
    """
    size = size if size in PAGE_SIZES else 50
    skipped = (max(number, 1) - 1) * size
    order = [F.desc(ts), F.asc(tie)]
    rows = df.orderBy(*order).offset(skipped).limit(size)
    # at most one page of rows reaches this window
    index = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + skipped
    return rows.withColumn("row_index", index.cast("bigint"))


def recent_entries(entries: DataFrame, n: int = 500, member=None) -> DataFrame:
    """The newest active entries, optionally of one user."""
    chosen = active_entries(entries)
    if member not in (None, ""):
        chosen = chosen.filter(F.col("added_by").cast("string") == str(member))
    return chosen.orderBy(F.desc("added_at"), F.asc("id")).limit(n)


class TooManyRows(ValueError):
    """More rows than an interactive request may return."""


def guarded_limit(df: DataFrame, column: str, n: int = GUARD_ROWS) -> DataFrame:
    """All rows with ``column`` present, refused when there are more than ``n``."""
    rows = df.dropna(subset=[column])
    if rows.count() > n:
        raise TooManyRows(f"more than {n:,} records: narrow the time range")
    return rows


def latest_windows(windows: DataFrame, run: str, k: int = 40) -> DataFrame:
    """The newest ``k`` telemetry rows of a run, one per window, oldest first."""
    newest = (
        windows.filter(F.col("run_name") == run)
        .orderBy(F.desc("window_index"), F.asc("model_name"), F.asc("metric")).limit(k)
    )
    columns = ["window_index", "ts_start", "n_raw", "n_anomaly", "n_clean", "anom_rate"]
    return newest.select(*columns).dropDuplicates(["window_index"]).orderBy("window_index")


def display_format(df: DataFrame, digits: int = 2) -> DataFrame:
    """Every column as display text: rounded numbers, minute timestamps, NULL empty."""
    def shown(name, kind):
        if kind == "double":
            return C.display_fixed(name, digits)
        if kind.startswith("timestamp"):
            return C.display_time(name)
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return df.select(*[shown(n, k).alias(n) for n, k in df.dtypes])


# -- set operations and the audit trail ---------------------------------------

def union_trips(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both trip tables."""
    return first.unionByName(second, allowMissingColumns=True)


def union_with_provenance(trips: DataFrame, entries: DataFrame, users: DataFrame) -> DataFrame:
    """Raw trips and active entries with their source and the user's name."""
    raw = trips.withColumns({
        "source": F.lit("raw"),
        "added_by": F.lit(None).cast("bigint"),
        "added_by_name": F.lit(C.EMPTY_MARK),
    })
    manual = attach_user_name(active_entries(entries), user_names(users), "added_by", "added_by_name", mark=None)
    manual = manual.withColumn("source", F.lit("manual"))
    shared = [c for c in raw.columns if c in manual.columns]
    return raw.select(*shared).unionByName(manual.select(*shared))


def user_names(users: DataFrame) -> DataFrame:
    """Ids and names of users, stored once for all lookups that follow."""
    return stored_lookup(users.select("id", "username"))


def attach_user_name(
    df: DataFrame, names: DataFrame, column: str, name: str, mark: str | None = C.EMPTY_MARK
) -> DataFrame:
    """Look up a user's name by id in :func:`user_names`; unknown users show ``mark``."""
    named = names.select(F.col("id").alias(column), F.col("username").alias(name))
    joined = df.join(named, column, "left").select(*df.columns, name)
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(mark))) if mark else joined


def attach_user_names(entries: DataFrame, users: DataFrame) -> DataFrame:
    """Names of the adding and the deleting user."""
    names = user_names(users)
    named = attach_user_name(entries, names, "added_by", "added_by_name")
    return attach_user_name(named, names, "deleted_by", "deleted_by_name")


def users_with_entries(users: DataFrame, entries: DataFrame) -> DataFrame:
    """Users with at least one entry, by name."""
    adders = entries.select(F.col("added_by").alias("id")).distinct()
    return users.join(adders, "id", "left_semi").orderBy("username")


def activity_log(
    entries: DataFrame, users: DataFrame, action: str = "all", member=None
) -> DataFrame:
    """An ``added`` event per entry and a ``deleted`` event per deleted entry, newest first."""
    added = F.struct(
        F.col("added_at").alias("time"), F.lit("added").alias("action"),
        F.col("added_by").alias("user_id"))
    deleted = F.struct(
        F.when(F.col("is_deleted"), F.col("deleted_at")).alias("time"),
        F.lit("deleted").alias("action"), F.col("deleted_by").alias("user_id"))
    events = (
        entries.withColumn("summary", C.entry_summary())
        .select("id", "summary", F.explode(F.array(added, deleted)).alias("e"))
        .select(F.col("id").alias("entry_id"), "e.*", "summary")
        .filter(F.col("time").isNotNull())
    )
    if action != "all":
        events = events.filter(F.col("action") == action)
    if member not in (None, ""):
        events = events.filter(F.col("user_id").cast("string") == str(member))
    return attach_user_name(events, user_names(users), "user_id", "user").orderBy(
        F.desc("time"), "entry_id", "action")


def activity_page(
    entries: DataFrame, users: DataFrame, number: int = 1, size: int = 50, action: str = "all", member=None
) -> DataFrame:
    """One page of the activity log; only the rows up to its end are ordered."""
    skipped = (max(number, 1) - 1) * size
    return activity_log(entries, users, action, member).offset(skipped).limit(size)


def page_after(df: DataFrame, last: tuple | None = None, size: int = 50, ts: str = PICKUP, tie: str = "id") -> DataFrame:
    """The page that follows the row (ts, tie), newest first; the first page without one.

    However deep the page, only rows behind the given one compete for it.
    """
    if last is not None:
        at, row = F.lit(last[0]).cast(df.schema[ts].dataType), F.lit(last[1])
        df = df.filter((F.col(ts) < at) | (F.col(ts) == at) & (F.col(tie) > row))
    return df.orderBy(F.desc(ts), F.asc(tie)).limit(size)


def user_activity_summary(users: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries added, still active, deleted by the user, and the last addition."""
    added = entries.groupBy(F.col("added_by").alias("id")).agg(
        F.count(F.lit(1)).alias("added_total"),
        F.count_if(~F.col("is_deleted")).alias("added_active"),
        F.max("added_at").alias("last_added"),
    )
    removed = entries.filter(F.col("deleted_by").isNotNull()).groupBy(
        F.col("deleted_by").alias("id")).agg(F.count(F.lit(1)).alias("deleted_by_me"))
    return (
        users.join(added, "id", "left").join(removed, "id", "left")
        .fillna(0, ["added_total", "added_active", "deleted_by_me"])
        .select("id", "username", "added_total", "added_active", "deleted_by_me", "last_added")
    )


def derive_entry_metrics(entries: DataFrame) -> DataFrame:
    """Speed and price per distance of entered records."""
    return entries.withColumns({
        "trip_speed_mph": C.entry_speed(),
        "price_per_distance": C.entry_price_per_distance(),
    })


def hour_context(new: DataFrame, trips: DataFrame, entries: DataFrame, is_new: bool = True) -> DataFrame:
    """Hourly volume and mean speed for entered records.

    Volume counts stored trips and active entries of the hour, plus the record
    itself when it is new; speed is that of stored trips, else the record's own.
    """
    hour = C.trunc_hour(PICKUP).alias("_hour")
    stored = trips.groupBy(hour).agg(
        F.count(F.lit(1)).alias("_trips"), F.avg("trip_speed_mph").alias("_speed"))
    manual = active_entries(entries).groupBy(hour).agg(F.count(F.lit(1)).alias("_entries"))
    # one row per hour of the span
    hours = stored_lookup(stored.join(manual, "_hour", "full"))
    found = derive_entry_metrics(new).withColumn("_hour", C.trunc_hour(PICKUP)).join(
        hours, "_hour", "left")
    volume = F.coalesce("_trips", F.lit(0)) + F.coalesce("_entries", F.lit(0)) + F.lit(int(is_new))
    speed = F.coalesce(F.nullif("_speed", F.lit(0.0)), "trip_speed_mph")
    return found.withColumns(
        {"hourly_trip_volume": volume.cast("int"), "hourly_avg_speed": speed}
    ).drop("_hour", "_trips", "_speed", "_entries")


def soft_delete(entries: DataFrame, ids: DataFrame, user, at) -> DataFrame:
    """Mark active entries as deleted by ``user`` when their id is listed."""
    listed = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull() & ~F.col("is_deleted")
    return (
        entries.join(listed, "id", "left")
        .withColumns({
            "deleted_by": F.when(hit, F.lit(user).cast("bigint")).otherwise(F.col("deleted_by")),
            "deleted_at": F.when(hit, _timestamp(at)).otherwise(F.col("deleted_at")),
            "is_deleted": hit | F.col("is_deleted"),
        })
        .drop("_hit")
    )
