"""python -m loomwell.cli: list, status, pending, build over a folder of tables. Exit 0, 1 on bad settings, 2 on failures."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from loomwell.operators import changes, rendering, selection
from loomwell.plans.books import chapter_rows
from loomwell.session import build_session, read_table
from loomwell.sources.config import SettingsError, read_settings


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomwell")
    p.add_argument("command", choices=("list", "status", "pending", "build"))
    p.add_argument("--settings")
    p.add_argument("--set", action="append", default=[], metavar="ID.KEY=VALUE")
    p.add_argument("--tables", required=True)
    p.add_argument("--out")
    p.add_argument("--state", help="folder in which pending keeps what earlier runs answered; only what they left comes out")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(argv)
    try:
        settings = read_settings(a.settings, a.set) if a.settings else None
    except (SettingsError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    spark = build_session(a.master)
    try:
        if a.command == "list":
            read_table(spark, a.tables, "blogs").select("blog_id", "title", "source", "url").orderBy("blog_id").show(1000, False)
        elif a.command == "status":
            posts = read_table(spark, a.tables, "posts").groupBy("blog_id").agg(F.countDistinct("key").alias("posts"), F.max("fetched_at").alias("last"))
            posts.orderBy("blog_id").show(1000, False)
        elif a.command == "pending":
            out = changes.pending_keys(*(read_table(spark, a.tables, t) for t in ("refs", "sync_runs", "posts", "blogs")), state=a.state)
            out.write.mode("overwrite").parquet(a.out) if a.out else out.groupBy("blog_id").count().orderBy("blog_id").show(1000, False)
        else:
            if not a.out:
                print("build needs --out", file=sys.stderr)
                return 1
            rows = chapter_rows(spark, a.tables, [b.id for b in settings.select([])] if settings else None)
            budget = selection.budget_of(200_000_000)
            bins = selection.pack_in_order(rows.withColumn("w", F.length("xhtml")), ["blog_id"], "idx", "w", budget)
            volumes = rendering.package_volumes(rows.join(bins, ["blog_id", "idx"]).withColumn("book", F.col("blog_id")), ["blog_id", "bin"], "book")
            volumes.write.mode("overwrite").parquet(a.out)
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
