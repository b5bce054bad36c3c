"""Problem 3 over the listing and the cache: the posts that the open runs have to take.

Two ledgers of processed numbers carry the work from run to run. The one over the cache folds each stored version into
the current versions once, in whatever order versions arrive; the one over the listing hands each listed row to one
successful run. Both commit what they computed together with the merged intervals it answers for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.operators.intervals import IntervalLedger
from loomwell.operators.timestamps import TimestampDictionary, normalise_timestamps
from loomwell.session import broadcast_if_small, scratch


def current_versions(posts: DataFrame) -> DataFrame:
    """(blog_id, key, _cached, _newest) of each post's current version: greatest fetched_at, on a tie the higher seq.

    Nulls in fetched_at come before every other value; rows without key are ignored.
    """
    newest = F.struct(F.col("fetched_at").try_cast("timestamp").alias("at"), "seq")
    keyed = posts.where("key is not null").groupBy("blog_id", "key")
    return keyed.agg(F.max_by("modified", newest).alias("_cached"), F.max(newest).alias("_newest"))


class CacheView:
    """Current versions kept by deltas: ``absorb`` looks at rows only that no earlier commit answers for, so versions that
    arrive late are found by their gap; a run that dies leaves its numbers open."""

    def __init__(self, ledger: IntervalLedger):
        self.ledger = ledger

    def absorb(self, posts: DataFrame) -> None:
        number = self.ledger.next_number()
        fresh = self.ledger.pending(posts.select("blog_id", "seq", "key", "modified", "fetched_at"), "blog_id", "seq")
        self.ledger.commit(current_versions(fresh), fresh.select(F.col("blog_id").alias("source"), "seq"), number)

    def current(self) -> DataFrame:
        """(blog_id, key, _cached) as absorbed so far; None before the first commit."""
        out = self.ledger.output()
        return None if out is None else out.groupBy("blog_id", "key").agg(F.max_by("_cached", "_newest").alias("_cached"))


def open_rows(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """(blog_id, seq, key, modified) of the rows that the blogs' open runs listed."""
    live = broadcast_if_small(runs.where("status = 'open'").select("blog_id", "run_id").distinct())
    rows = refs.select("blog_id", "run_id", "seq", "key", "modified").where("key is not null")
    return rows.join(live, ["blog_id", "run_id"], "left_semi").drop("run_id")


def changed_keys(listed: DataFrame, cached: DataFrame, blogs: DataFrame, dictionary: TimestampDictionary | None = None) -> DataFrame:
    """(blog_id, key) of the listed rows (blog_id, seq, key, modified) that are new, or whose instant differs from the
    cached one (blog_id, key, _cached). The last row of a key (highest seq) counts. A null or unreadable modified on
    either side counts as unchanged."""
    last = listed.groupBy("blog_id", "key").agg(F.max("seq").alias("seq"), F.max_by("modified", "seq").alias("_listed"))
    both = last.join(cached.withColumn("_has", F.lit(True)), ["blog_id", "key"], "left")
    clocks = blogs.select("blog_id", F.col("timezone").alias("_tz"), F.col("locale").alias("_locale"))
    differ = both.where("_has and _listed <> _cached").join(clocks, "blog_id", "left")
    sides = differ.select("blog_id", "key", "_tz", "_locale", F.explode(F.array("_listed", "_cached")).alias("_text"))
    read = normalise_timestamps(sides, "_text", "_tz", "_locale", out="_us", dictionary=dictionary).where("_us is not null")
    moved = read.groupBy("blog_id", "key").agg(F.countDistinct("_us").alias("_n")).where("_n = 2").select("blog_id", "key")
    return both.where("_has is null").select("blog_id", "key").unionByName(moved)


class ChangeRun:
    """One folder of state for the incremental runs over a listing and its cache."""

    def __init__(self, spark, path: str):
        self.cache = CacheView(IntervalLedger(spark, f"{path}/cache"))
        self.taken = IntervalLedger(spark, f"{path}/listing")
        self.dictionary = TimestampDictionary(spark, f"{path}/instants")

    def take(self, refs: DataFrame, runs: DataFrame, posts: DataFrame, blogs: DataFrame) -> int:
        """Judge the open runs' rows that no commit answers for against the cache, and commit the keys to take together
        with the numbers judged. Returns the commit's number; ``keys(number)`` reads it."""
        number = self.taken.next_number()
        self.cache.absorb(posts)
        listed = self.taken.pending(open_rows(refs, runs), "blog_id", "seq")
        keys = changed_keys(listed, self.cache.current(), blogs, self.dictionary)
        return self.taken.commit(keys, listed.select(F.col("blog_id").alias("source"), "seq"), number)

    def keys(self, number: int | None = None) -> DataFrame | None:
        """(blog_id, key) that one commit, or all of them, gave."""
        found = self.taken.output() if number is None else self.taken.spark.read.parquet(f"{self.taken.log.folder(number)}/output")
        return None if found is None else found.select("blog_id", "key").distinct()


def pending_keys(refs: DataFrame, runs: DataFrame, posts: DataFrame, blogs: DataFrame, state: str | None = None) -> DataFrame:
    """(blog_id, key) that the open runs have to take: new ones, and those whose modified instant differs.

    As in operation, the cache is absorbed by deltas: what was stored before each blog's last finished run began, then
    the gaps that are left, late versions among them. With a ``state`` folder of earlier runs only what these left is
    looked at, and only keys not yet handed out come back. Ties, repeated rows and empty tables need no special case.
    """
    spark = refs.sparkSession
    run = ChangeRun(spark, state or scratch(spark, "changes"))
    if run.cache.ledger.next_number() == 0:
        closed = runs.where("status <> 'open'").groupBy("blog_id").agg(F.max("started_at").alias("_began"))
        before = posts.join(broadcast_if_small(closed), "blog_id").where(F.col("fetched_at").try_cast("timestamp") < F.col("_began"))
        run.cache.absorb(before)
    return run.keys(run.take(refs, runs, posts, blogs))
