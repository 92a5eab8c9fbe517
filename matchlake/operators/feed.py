"""Recent-activity feed, retention and document state, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchlake.functions import tables as T


def retained(events: DataFrame, ts: str = "ts", days: int = T.RETENTION_DAYS) -> DataFrame:
    """Events of the last ``days`` before the newest one."""
    newest = events.agg(F.max(ts).alias("_newest"))  # one row
    return events.join(F.broadcast(newest)).where(F.col(ts) >= F.col("_newest") - F.expr(f"INTERVAL {days} DAYS")).drop("_newest")


def recent_distinct(events: DataFrame, key: str, limit: int | None = None, ts: str = "ts") -> DataFrame:
    """(key, last): newest event of each key, newest first, ties to the smaller key."""
    rows = events.groupBy(key).agg(F.max(ts).alias("last")).orderBy(F.desc("last"), key)
    return rows if limit is None else rows.limit(limit)


def feed(events: DataFrame, catalog: DataFrame, key: str, limit: int, ts: str = "ts", over_fetch: int | None = None) -> DataFrame:
    """The ``limit`` newest keys that the catalogue knows.

    over_fetch: cut to so many times the limit before the join, which may return fewer.
    """
    rows = recent_distinct(events, key, None if over_fetch is None else limit * over_fetch, ts)
    return rows.join(catalog, key).orderBy(F.desc("last"), key).limit(limit)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``: last write wins, or first row wins."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows put in the place of those with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def missing(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """What incremental work is left: rows whose keys are not there yet."""
    return wanted.join(have.select(*keys).distinct(), keys, "left_anti")


def get_or_create(profiles: DataFrame, tokens: DataFrame, default: str = "{}") -> DataFrame:
    """profiles (profile_id, state) with an empty state for each new token's hash."""
    new = tokens.select(F.sha2(F.col("token"), 256).alias("profile_id")).distinct().join(profiles, "profile_id", "left_anti").withColumn("state", F.lit(default))
    return profiles.unionByName(new)


def valid_ratings(ratings: Column, most: int = 1000) -> Column:
    """Whether a map of ratings has at most ``most`` entries, all whole numbers from 1 to 5."""
    return (F.size(ratings) <= most) & F.forall(F.map_values(ratings), lambda r: r.between(1, 5))


def toggled(items: Column, item: Column, cap: int = 3) -> Column:
    """An array without the item if it is there, else with it if there is room."""
    return F.when(F.array_contains(items, item), F.array_except(items, F.array(item))).when(F.size(items) < cap, F.array_append(items, item)).otherwise(items)


def prepended(items: Column, item: Column, cap: int) -> Column:
    return F.slice(F.array_prepend(F.array_except(items, F.array(item)), item), 1, cap)


def health(**tables: DataFrame) -> DataFrame:
    """(name, rows): counts of the named tables."""
    rows = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def sessions(events: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), "events")
