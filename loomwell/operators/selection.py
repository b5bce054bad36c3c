"""Selecting, ordering, numbering, grouping and packing rows of a collection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Share of the limit that is planned with, and bytes kept for what the plan can't see.
SIZE_MARGIN, VOLUME_OVERHEAD = 0.97, 1_500_000


def reading_order(ts: str, title: str, tie: str, newest_first: bool) -> list[Column]:
    """Undated rows stand before all dated ones in time; equal rows keep their tie order in both directions."""
    if newest_first:
        return [F.desc_nulls_last(ts), F.lower(F.col(title)).desc(), F.asc(tie)]
    return [F.asc_nulls_first(ts), F.lower(F.col(title)).asc(), F.asc(tie)]


def select_posts(rows: DataFrame, by: str, ts: str, title: str, tie: str, *, newest_first: bool = True, most: int | None = None) -> DataFrame:
    """Add ``idx``, the place in reading order within each ``by`` group, keeping the ``most`` newest rows.

    In ascending order the newest rows are the tail. Null titles sort as Spark sorts nulls; None or 0 keeps all rows.
    """
    kept = rows
    if most:
        newest = Window.partitionBy(by).orderBy(*(reading_order(ts, title, tie, True) if newest_first else [F.desc_nulls_last(ts), F.lower(F.col(title)).desc(), F.desc(tie)]))
        kept = kept.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= most).drop("_rank")
    order = Window.partitionBy(by).orderBy(*reading_order(ts, title, tie, newest_first))
    return kept.withColumn("idx", F.row_number().over(order))


def group_parts(rows: DataFrame, by: str, part: Column, idx: str = "idx") -> DataFrame:
    """(by, part, first_idx, part_no, posts): groups in the order in which their first row is read."""
    per = rows.groupBy(by, part.alias("part")).agg(F.min(idx).alias("first_idx"), F.count("*").alias("posts"))
    return per.withColumn("part_no", F.row_number().over(Window.partitionBy(by).orderBy("first_idx")))


def budget_of(limit: int) -> int:
    return int(limit * SIZE_MARGIN) - VOLUME_OVERHEAD


def _stream_fold(rows: DataFrame, by: list[str], budget: int) -> DataFrame:
    """Bins of rows (by..., idx, w, names, sizes), streamed in order.

    What a bin holds depends on every row before it, so a group is folded in one pass; the rows are sorted on disk and
    streamed through in batches, and only the state of the open bin is held.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema) + ", idx long, bin long"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, number, used, seen = None, 0, 0, set()
        for batch in batches:
            bins = []
            for now, w, names, sizes in zip(zip(*(batch[c] for c in by), strict=True), batch["w"], batch["names"], batch["sizes"], strict=True):
                if key is None or any(a != b and not (a != a and b != b) for a, b in zip(now, key, strict=True)):
                    key, number, used, seen = now, 0, 0, set()
                assets = dict(zip(names, sizes, strict=True)) if names is not None else {}
                weight = w + sum(s for a, s in assets.items() if a not in seen)
                if not number or used + weight > budget:
                    number, used, seen = number + 1, 0, set()
                    weight = w + sum(assets.values())
                used += weight
                seen.update(assets)
                bins.append(number)
            yield pd.DataFrame({**{c: batch[c] for c in by}, "idx": batch["idx"], "bin": bins})

    return rows.repartition(*by).sortWithinPartitions(*by, "idx").mapInPandas(fold, schema)


def pack_in_order(rows: DataFrame, by: list[str], idx: str, weight: str, budget: int) -> DataFrame:
    """(by..., idx, bin): fill bins in reading order, never past the budget unless one row alone is larger.

    Null weights count as 0; an empty table gives none.
    """
    none = F.lit(None).cast("array<string>"), F.lit(None).cast("array<bigint>")
    slim = rows.select(*by, F.col(idx).cast("long").alias("idx"), F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("w"), none[0].alias("names"), none[1].alias("sizes"))
    return _stream_fold(slim, by, budget)


def pack_with_shared(rows: DataFrame, by: list[str], idx: str, own: str, assets: DataFrame, asset: str, size: str, budget: int) -> DataFrame:
    """(by..., idx, bin) where a row also brings its assets, each weighed once a bin.

    assets: (by..., idx, asset, size), repeated assets of a row counted once.
    """
    mine = assets.select(*by, F.col(idx).alias("idx"), F.col(asset).cast("string").alias("a"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("s"))
    lists = mine.groupBy(*by, "idx", "a").agg(F.max("s").alias("s")).groupBy(*by, "idx").agg(F.sort_array(F.collect_list(F.struct("a", "s"))).alias("l"))
    slim = rows.select(*by, F.col(idx).alias("idx"), F.coalesce(F.col(own).cast("long"), F.lit(0)).alias("w")).join(lists, [*by, "idx"], "left")
    slim = slim.select(*by, F.col("idx").cast("long").alias("idx"), "w", F.transform("l", lambda x: x["a"]).alias("names"), F.transform("l", lambda x: x["s"]).alias("sizes"))
    return _stream_fold(slim, by, budget)


def volume_names(packed: DataFrame, by: str, period: str, bin_: str, first_idx: str, title: Column, split: str) -> DataFrame:
    """Add volume, volumes, parts, label, slug and title to one row a (by, period, bin).

    Volumes follow the reading order; a period in one part carries its own name, one in several parts is numbered;
    a single unsplit volume has no label.
    """
    order = Window.partitionBy(by).orderBy(first_idx)
    out = packed.withColumn("volume", F.row_number().over(order)).withColumn("volumes", F.count("*").over(Window.partitionBy(by)))
    out = out.withColumn("parts", F.max(bin_).over(Window.partitionBy(by, period)))
    n, k = F.col("volume").cast("string"), F.col(bin_).cast("string")
    if split == "size":
        many = F.col("volumes") > 1
        label = F.when(many, F.concat(F.lit("Vol. "), n, F.lit(" of "), F.col("volumes").cast("string"))).otherwise("")
        slug = F.when(many, F.concat(F.lit("vol"), n)).otherwise("")
        name = F.when(many, F.concat(title, F.lit(", Vol. "), n)).otherwise(title)
    else:
        one = F.col("parts") == 1
        label = F.when(one, F.col(period)).otherwise(F.concat(F.col(period), F.lit(", part "), k, F.lit(" of "), F.col("parts").cast("string")))
        slug = F.when(one, F.col(period)).otherwise(F.concat(F.col(period), F.lit("-part"), k))
        name = F.concat(title, F.lit(" " if split == "year" else ", "), label)
    return out.withColumn("label", label).withColumn("slug", slug).withColumn("title", name)
