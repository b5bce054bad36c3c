"""Keeping a cache of posts in step with listings: changes, gates, upserts, counters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days after which an asset that failed for a passing reason may be asked for again.
RETRY_DAYS = 3


def needs_fetch(listed: DataFrame, cached: DataFrame, by: list[str], full: bool = False) -> DataFrame:
    """listed (by..., modified) with ``status`` new, changed or same. A row changes when both texts are there and differ.

    Extra columns of ``listed`` are kept; columns of ``cached`` other than by and modified are ignored.
    """
    known = cached.select(*by, F.col("modified").alias("_cached"), F.lit(True).alias("_known"))
    both = listed.join(known, by, "left")
    status = F.when(F.col("_known").isNull(), "new").when(F.col("modified") != F.col("_cached"), "changed").otherwise("changed" if full else "same")
    return both.withColumn("status", status).drop("_cached", "_known")


def vanished(listed: DataFrame, cached: DataFrame, by: list[str]) -> DataFrame:
    """Cached keys that the listing no longer has."""
    return cached.join(listed.select(*by).distinct(), by, "left_anti")


def not_returned(wanted: DataFrame, returned: DataFrame, by: list[str]) -> DataFrame:
    return wanted.join(returned.select(*by).distinct(), by, "left_anti")


def upsert(cached: DataFrame, fresh: DataFrame, by: list[str]) -> DataFrame:
    """The cache with fresh rows in place of those with their key."""
    return cached.join(fresh.select(*by).distinct(), by, "left_anti").unionByName(fresh, allowMissingColumns=True)


def latest(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The newest row of each key by the given columns, nulls oldest; one aggregation, no window over hot keys."""
    rest = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*by, *(F.col(f"_r.`{c}`").alias(c) for c in rest)).select(*rows.columns)


def gate(posts: DataFrame, chars: Column, least: Column | int) -> tuple[DataFrame, DataFrame]:
    """(passed, rejected) by text length; 0 lets everything pass."""
    limit = least if isinstance(least, Column) else F.lit(least)
    ok = (limit == 0) | (F.coalesce(chars, F.lit(0)) >= limit)
    return posts.where(ok), posts.where(~ok)


def counters(status: DataFrame, gone: DataFrame, by: str, prune: bool = False) -> DataFrame:
    """(by, new, changed, same, removed, stale) of a run."""
    a = status.groupBy(by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "same")))
    b = gone.groupBy(by).agg(F.count("*").alias("_gone"))
    both = a.join(b, by, "full")
    n, zero = F.coalesce("_gone", F.lit(0)), F.lit(0).cast("long")
    return both.select(by, *(F.coalesce(s, zero).alias(s) for s in ("new", "changed", "same")), (n if prune else zero).alias("removed"), (zero if prune else n).alias("stale"))


def blocks_retry(error: Column, permanent: Column, fetched_at: Column, now: datetime | Column, days: int = RETRY_DAYS) -> Column:
    """Whether an asset counts as failed for now: for good, or less than ``days`` ago; failures without a date don't."""
    at = now if isinstance(now, Column) else F.lit(now)
    recent = F.coalesce(at - F.make_dt_interval(F.lit(days)) < fetched_at, F.lit(False))
    return error.isNotNull() & (permanent | recent)


def to_rebuild(books: DataFrame, changed: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """books (book, blog) whose blogs changed, or that have no output yet."""
    hit = books.join(changed.select("blog").distinct(), "blog", "left_semi").select("book")
    missing = books.join(existing.select("book").distinct(), "book", "left_anti").select("book")
    return books.select("book").distinct() if force else hit.unionByName(missing).distinct()


def failure_summary(outcomes: DataFrame, by: str) -> DataFrame:
    """(by, outcome, n, example): rejected probes by outcome, with one example."""
    return outcomes.groupBy(by, "outcome").agg(F.count("*").alias("n"), F.min("url").alias("example"))
