"""Problem 5: one UTC instant for timestamps in many notations, through a dictionary of distinct values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.functions.instants import parse_clock
from loomwell.session import scratch
from loomwell.sources.commits import CommitLog, Conflict

KEYS = ("raw", "zone", "locale")
#: Parameter: how often a batch that another writer overtook is tried again.
ATTEMPTS = 8


_CLOCK = T.StructType([T.StructField("utc_us", T.LongType()), T.StructField("wall_us", T.LongType())])


@F.pandas_udf(_CLOCK)
def clock_udf(raw: pd.Series, zone: pd.Series, locale: pd.Series) -> pd.DataFrame:
    rows = [parse_clock(r, z, c) or (None, None) for r, z, c in zip(raw, zone, locale, strict=True)]
    return pd.DataFrame(rows, columns=_CLOCK.names, dtype="Int64")


def readable(raw: Column) -> Column:
    """False for values that no notation can give an instant: nulls, no digit, a leading year before 1995.

    Such placeholders are what makes a raw string hot; leaving them out before the shuffle keeps the join even.
    """
    return raw.isNotNull() & raw.rlike(r"\d") & ~raw.rlike(r"^\s*(0\d{3}|1[0-8]\d\d|19[0-8]\d|199[0-4])-")


class TimestampDictionary:
    """Distinct (raw, zone, locale) values with their instants, kept as one commit a batch.

    ``update`` parses only values not stored yet and appends them, so each value is parsed once. A batch that died
    before its commit is not seen and doesn't stand in the way; where two runs add at once, the later one looks again
    at what is new.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.log = spark, CommitLog(spark, path or scratch(spark, "instants"))

    def load(self) -> DataFrame | None:
        found = self.log.folders()
        return self.spark.read.schema("raw string, zone string, locale string, utc_us long, wall_us long").parquet(*found) if found else None

    def update(self, values: DataFrame) -> DataFrame:
        """values: columns raw, zone, locale. Returns the whole dictionary after adding what is new."""
        for _ in range(ATTEMPTS):
            number = len(self.log.numbers())
            fresh = values.select(*KEYS).where(readable(F.col("raw"))).distinct()
            known = self.load()
            if known is not None:
                on = [F.col(f"f.{k}").eqNullSafe(F.col(f"k.{k}")) for k in KEYS]
                fresh = fresh.alias("f").join(known.alias("k"), on, "left_anti")
            staged = self.log.stage()
            fresh.select(*KEYS, clock_udf(*KEYS).alias("_c")).select(*KEYS, "_c.*").write.parquet(staged)
            try:
                self.log.publish(staged, number)
            except Conflict:
                continue
            return self.load()
        raise Conflict(f"{self.log.path}: other writers came first {ATTEMPTS} times")


def normalise_timestamps(rows: DataFrame, raw: str, zone: str, locale: str, out: str = "utc_us", wall: str | None = None, dictionary: TimestampDictionary | None = None) -> DataFrame:
    """Add ``out`` (microseconds since 1970, UTC, or null) for the text in ``raw``, and ``wall``, the clock as written.

    Nulls, empty texts, placeholders, unreadable values and years before 1995 give null; a null zone means UTC and a
    null locale en-US. Rows are kept as they are, repeated ones too; an empty table gives an empty table; columns named
    like the dictionary's don't clash, since the join uses internal names.
    """
    d = dictionary or TimestampDictionary(rows.sparkSession)
    keyed = rows.select(F.struct("*").alias("_row"), F.col(raw).alias("raw"), F.col(zone).alias("zone"), F.col(locale).alias("locale"))
    table = d.update(keyed).where("utc_us is not null")
    good = readable(F.col("_r.raw"))
    on = good & (F.col("_r.raw") == F.col("_d.raw")) & F.col("_r.zone").eqNullSafe(F.col("_d.zone")) & F.col("_r.locale").eqNullSafe(F.col("_d.locale"))
    joined = keyed.alias("_r").join(table.alias("_d"), on, "left")
    kept = [F.col(f"_r._row.`{c}`").alias(c) for c in rows.columns if c not in (out, wall)]
    return joined.select(*kept, F.col("_d.utc_us").alias(out), *([F.col("_d.wall_us").alias(wall)] if wall else []))


def instants_found(posts: DataFrame, blogs: DataFrame, dictionary: TimestampDictionary | None = None) -> DataFrame:
    """(seq, field, utc_us) of every readable date and modified of posts."""
    long = posts.select("seq", "blog_id", F.explode(F.create_map(F.lit("date"), "date", F.lit("modified"), "modified")).alias("field", "value"))
    long = long.where(readable(F.col("value")))
    clocks = blogs.select("blog_id", F.col("timezone").alias("_tz"), F.col("locale").alias("_locale"))
    zoned = long.join(clocks, "blog_id", "left")
    done = normalise_timestamps(zoned, "value", "_tz", "_locale", dictionary=dictionary)
    return done.where("utc_us is not null").select("seq", "field", "utc_us").distinct()


def post_clocks(posts: DataFrame, blogs: DataFrame, field: str, dictionary: TimestampDictionary | None = None) -> DataFrame:
    """Add ``utc_us`` and ``wall_us``, the instant of a posts field and the clock it was written with, to every row."""
    clocks = blogs.select(F.col("blog_id").alias("_blog"), F.col("timezone").alias("_tz"), F.col("locale").alias("_locale"))
    zoned = posts.join(clocks, F.col("blog_id") == F.col("_blog"), "left").drop("_blog")
    return normalise_timestamps(zoned, field, "_tz", "_locale", wall="wall_us", dictionary=dictionary).drop("_tz", "_locale")
