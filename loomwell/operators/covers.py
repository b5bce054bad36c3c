"""Cover lines and issue labels of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LONGEST = 80


def cover_lines(rows: DataFrame, by: str, ts: str, title: str, kicker: str, tie: str, n: int, filler: str = "FEATURE") -> DataFrame:
    """(by, line, kicker, title): n lines for each group.

    Newest first, undated last: the newest title of each kicker, then the newest titles not shown yet under ``filler``,
    then blanks; titles of more than 80 characters are never shown. Ranks are limited before rows meet, so no group is collected.
    """
    order = [F.desc_nulls_last(ts), F.asc(tie)]
    short = rows.where(F.length(title) <= LONGEST)
    first = short.withColumn("_k", F.row_number().over(Window.partitionBy(by, kicker).orderBy(*order))).where("_k = 1")
    first = first.withColumn("line", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("line") <= n)
    shown = first.select(by, "line", F.col(kicker).alias("kicker"), F.col(title).alias("title"))
    count = shown.groupBy(by).agg(F.count("*").alias("_have"))
    distinct = short.groupBy(by, F.col(title).alias("title")).agg(F.min_by(tie, F.struct(F.when(F.col(ts).isNull(), 1).otherwise(0), -F.unix_micros(ts), F.col(tie))).alias("_tie"), F.max(ts).alias("_ts"))
    unseen = distinct.join(shown.select(by, "title"), [by, "title"], "left_anti")
    more = unseen.withColumn("_m", F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last("_ts"), "_tie"))).where(F.col("_m") <= n)
    more = more.join(count, by, "left").withColumn("line", F.col("_m") + F.coalesce("_have", F.lit(0))).where(F.col("line") <= n)
    filled = shown.unionByName(more.select(by, "line", F.lit(filler).alias("kicker"), "title"))
    slots = rows.select(by).distinct().withColumn("line", F.explode(F.sequence(F.lit(1), F.lit(n))))
    blank = F.lit("")
    return slots.join(filled, [by, "line"], "left").select(by, "line", F.coalesce("kicker", blank).alias("kicker"), F.coalesce("title", blank).alias("title"))
