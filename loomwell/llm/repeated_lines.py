"""Problem 7: lines repeated over many posts of one source, from line counts that grow by deltas.

Lines travel as 128-bit hashes; their text is written once, with the rows. Each delta counts what it adds, finds the
lines whose standing it changed, and only documents that hold one of these are rebuilt.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.functions.htmllines import fold_line, html_lines_udf, visible_lines
from loomwell.session import broadcast_if_small, materialise, scratch
from loomwell.sources.commits import CommitLog

MIN_CHARS = 12
MIN_KEYS = 3
SHARE = 0.10

ROWS = "seq long, blog_id string, key string, lines array<string>"
PAIRS = "blog_id string, a long, b long, k long, j int"
COUNTS = "blog_id string, a long, b long, n long"
KEYS = "blog_id string, k long, j int"
TOTALS = "blog_id string, keys long"
_LINE = ["blog_id", "a", "b"]


def line_table(posts: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(seq, blog_id, key, lines): the distinct lines of each row, of ``least`` characters at least. Rows without blog, key or html have none."""
    lines = F.array_distinct(html_lines_udf(F.coalesce("html", F.lit(""))))
    kept = posts.where("blog_id is not null and key is not null").select("seq", "blog_id", "key", lines.alias("lines"))
    return kept.withColumn("lines", F.filter("lines", lambda x: F.length(x) >= least))


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")]


def each_line(rows: DataFrame, *more: str) -> DataFrame:
    """(seq, blog_id, *more, line, a, b): one row a line, with its hash."""
    lines = rows.select("seq", "blog_id", *more, F.explode("lines").alias("line"))
    return lines.select("*", *_hashes(F.col("line")))


class LineCounts:
    """Per-source line counts on disk, one commit a delta (``CommitLog``).

    A commit holds the delta's ``rows`` with their lines, and only what they add: new ``pairs`` of line and key, new
    ``keys``, and the ``counts`` and ``totals`` of these. Reading sums over the commits. Redelivered rows add nothing;
    a delta that died before its commit is not seen; a state is reopened by its path. One writer at a time: a second
    one that is overtaken raises ``Conflict``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.log = spark, CommitLog(spark, path or scratch(spark, "line-counts"))

    def _read(self, part: str, schema: str, upto: int | None = None) -> DataFrame:
        paths = [f"{f}/{part}" for f in self.log.folders()[:upto]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, upto: int | None = None) -> DataFrame:
        return self._read("rows", ROWS, upto)

    def counts(self, upto: int | None = None) -> DataFrame:
        found = self._read("counts", COUNTS, upto)
        return found if len(self.log.numbers()[:upto]) < 2 else found.groupBy(*_LINE).agg(F.sum("n").alias("n"))

    def totals(self, upto: int | None = None) -> DataFrame:
        return self._read("totals", TOTALS, upto).groupBy("blog_id").agg(F.sum("keys").alias("keys"))

    def crossed(self, upto: int | None = None) -> DataFrame:
        """(blog_id, a, b) over the threshold. Their number is bounded: a line in more than a tenth of a blog's
        keys takes a tenth of its line places, so a blog has at most ten times its mean lines a post of them."""
        return self.over(MIN_KEYS, SHARE, upto)

    def over(self, least: int, share: float, upto: int | None = None) -> DataFrame:
        big = self.counts(upto).where(F.col("n") >= least)
        return big.join(broadcast_if_small(self.totals(upto)), "blog_id").where(F.col("n") > share * F.col("keys")).select(*_LINE)

    def apply(self, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Merge a delta of ``line_table`` rows; returns the lines (blog_id, a, b) that crossed the threshold (up, down)."""
        number = len(self.log.numbers())
        out = self.log.stage()
        lines.select("seq", "blog_id", "key", "lines").write.parquet(f"{out}/rows")
        rows = self.spark.read.schema(ROWS).parquet(f"{out}/rows")
        key = [F.xxhash64("key").alias("k"), F.hash("key").alias("j")]
        pairs = each_line(rows, "key").select(*_LINE, *key).distinct()
        keys = rows.select("blog_id", *key).distinct()
        if number:
            pairs = pairs.join(self._read("pairs", PAIRS, number), [*_LINE, "k", "j"], "left_anti")
            keys = keys.join(self._read("keys", KEYS, number), ["blog_id", "k", "j"], "left_anti")
        pairs.write.parquet(f"{out}/pairs")
        keys.write.parquet(f"{out}/keys")
        self.spark.read.schema(PAIRS).parquet(f"{out}/pairs").groupBy(*_LINE).agg(F.count("*").alias("n")).write.parquet(f"{out}/counts")
        self.spark.read.schema(KEYS).parquet(f"{out}/keys").groupBy("blog_id").agg(F.count("*").alias("keys")).write.parquet(f"{out}/totals")
        self.log.publish(out, number)
        now = self.crossed(number + 1)
        if not number:
            return now, now.limit(0)
        before = self.crossed(number)
        return now.join(before, _LINE, "left_anti"), before.join(now, _LINE, "left_anti")


def to_rebuild(lines: DataFrame, changed: DataFrame) -> DataFrame:
    """(seq) of the rows that hold a line whose standing changed: the only ones to write anew."""
    return each_line(lines).join(broadcast_if_small(changed), _LINE, "left_semi").select("seq").distinct()


def deltas(posts: DataFrame) -> list[DataFrame]:
    """A whole table as it came in: what was fetched before its last day, and the delta of that day."""
    day = F.to_date(F.col("fetched_at").try_cast("timestamp"))
    last = posts.agg(F.max(day)).first()[0]
    late = F.coalesce(day >= F.lit(last), F.lit(False))
    return [posts] if last is None else [posts.where(~late), posts.where(late)]


def repeated_lines(posts: DataFrame, counts: LineCounts | None = None) -> DataFrame:
    """(seq, line): every repeated line of every row, wherever it stands. Empty tables give no rows.

    The counts are built by deltas: with a ``counts`` state, ``posts`` is its next one; without, a new state takes the
    older posts and then the last day's.
    """
    state = counts or LineCounts(posts.sparkSession)
    for part in [posts] if counts else deltas(posts):
        state.apply(line_table(part))
    hot = broadcast_if_small(materialise(state.crossed(), "crossed"))
    return each_line(state.rows()).join(hot, _LINE, "left_semi").select("seq", "line").distinct()


_OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())])


@F.pandas_udf(_OUT)
def _without(htmls: pd.Series, repeated: pd.Series) -> pd.DataFrame:
    texts, counts = [], []
    for value, lines in zip(htmls, repeated, strict=True):
        drop = set(lines) if lines is not None else set()
        all_lines = visible_lines(value)
        kept = [x for x in all_lines if fold_line(x) not in drop]
        texts.append("\n".join(kept))
        counts.append(len(all_lines) - len(kept))
    return pd.DataFrame({"text": texts, "removed": counts})


def _built(posts: DataFrame, rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(seq, text, removed) of the given posts; ``rows`` are their lines. A row's own repeated lines go with it."""
    mine = each_line(rows).join(hot, _LINE, "left_semi").groupBy("seq").agg(F.collect_set("line").alias("_repeated"))
    return posts.select("seq", "html").join(mine, "seq", "left").select("seq", _without("html", "_repeated").alias("_o")).select("seq", "_o.*")


def without_repeated_lines(posts: DataFrame, counts: LineCounts | None = None) -> DataFrame:
    """(seq, text, removed): each post's lines without the repeated ones. A null html gives an empty text.

    Built as it grows: the older posts first, then the last day's delta, after which only its own posts and those with a
    line whose standing changed are written anew. Rows with the same seq share their repeated lines.
    """
    state = counts or LineCounts(posts.sparkSession)
    if counts and state.log.numbers():
        return _built(posts, state.rows(), broadcast_if_small(materialise(state.crossed(), "crossed")))
    parts = deltas(posts)
    state.apply(line_table(parts[0]))
    done = materialise(_built(parts[0], state.rows(), broadcast_if_small(state.crossed())), "without-lines")
    if len(parts) == 1:
        return done
    up, down = state.apply(line_table(parts[1]))
    touched = to_rebuild(state.rows(1), materialise(up.unionByName(down), "changed-lines"))
    touched = broadcast_if_small(materialise(touched, "rebuild"))
    again = parts[0].join(touched, "seq", "left_semi").unionByName(parts[1])
    return done.join(touched, "seq", "left_anti").unionByName(_built(again, state.rows(), broadcast_if_small(materialise(state.crossed(), "crossed"))))
