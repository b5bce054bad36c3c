"""The cache as tables: posts by blog, assets by url, builds; replaced by whole commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.sources.commits import CommitLog, Conflict

POSTS = "blog_id string, seq long, key string, url string, title string, html string, date string, modified string, author string, categories array<string>, tags array<string>, excerpt string, featured_image string, source string, fetched_at string"
ASSETS = "blog_id string, url string, file string, media_type string, error string, permanent boolean, fetched_at timestamp, bytes long"
BUILDS = "blog_id string, book_id string, built_at timestamp, posts long, files array<string>"
VERSION = 1
#: Parameter: how often a change that another writer overtook is tried again.
ATTEMPTS = 8


class Store:
    """A folder with one table a kind. A commit is a whole table in a folder of its own, published by a marker that one
    writer can create (``CommitLog``), so readers see the old rows or the new ones. ``put``, ``remove`` and ``put_assets``
    read, change and publish; where another writer was first they start again from its rows, so no update is lost. A
    missing store, or one of another version, is an empty one; a damaged table raises."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self, kind: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.path}/v{VERSION}/{kind}")

    def read(self, kind: str, schema: str) -> DataFrame:
        log = self._log(kind)
        done = log.numbers()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(log.folder(done[-1]))

    def change(self, kind: str, schema: str, rule, by: str = "blog_id") -> None:
        """Replace a table by ``rule(its rows)``; the rule is asked again when another writer published first."""
        log = self._log(kind)
        for _ in range(ATTEMPTS):
            done = log.numbers()
            old = self.spark.read.schema(schema).parquet(log.folder(done[-1])) if done else self.spark.createDataFrame([], schema)
            staged = log.stage()
            rows = rule(old)
            (rows.repartition(by) if by in rows.columns else rows).write.parquet(staged)
            try:
                log.publish(staged, len(done))
            except Conflict:
                continue
            return
        raise Conflict(f"{kind}: other writers came first {ATTEMPTS} times")

    def posts(self) -> DataFrame:
        return self.read("posts", POSTS)

    def assets(self) -> DataFrame:
        return self.read("assets", ASSETS)

    def write(self, kind: str, rows: DataFrame, by: str = "blog_id") -> None:
        n = len(self._commits(kind))
        staging = self._path(f"v{VERSION}", kind, f"_staging-{n:06d}")
        self._fs.delete(staging, True)
        rows.repartition(by).write.parquet(staging.toString()) if by in rows.columns else rows.write.parquet(staging.toString())
        if not self._fs.rename(staging, self._path(f"v{VERSION}", kind, f"commit-{n:06d}")):
            raise RuntimeError(f"{kind}: another writer committed first")

    def put(self, fresh: DataFrame) -> None:
        """Insert or replace posts by (blog_id, key)."""

        def rule(cached: DataFrame) -> DataFrame:
            kept = cached.join(fresh.select("blog_id", "key").distinct(), ["blog_id", "key"], "left_anti")
            return kept.unionByName(fresh, allowMissingColumns=True).select(*cached.columns)

        self.change("posts", POSTS, rule)

    def remove(self, keys: DataFrame) -> None:
        self.change("posts", POSTS, lambda cached: cached.join(keys.select("blog_id", "key").distinct(), ["blog_id", "key"], "left_anti"))

    def put_assets(self, rows: DataFrame) -> None:
        """Files and failures by url; a success replaces a failure and the other way round."""

        def rule(cached: DataFrame) -> DataFrame:
            kept = cached.join(rows.select("blog_id", "url").distinct(), ["blog_id", "url"], "left_anti")
            named = rows.withColumn("file", F.coalesce("file", F.when(F.col("error").isNull(), F.concat(F.lit("images/"), F.sha1("url")))))
            return kept.unionByName(named, allowMissingColumns=True).select(*cached.columns)

        self.change("assets", ASSETS, rule)

    def available_assets(self) -> DataFrame:
        """(blog_id, url, file, media_type, bytes) of the files that are stored and can be used."""
        return self.assets().where("error is null and file is not null").select("blog_id", "url", "file", "media_type", "bytes")
