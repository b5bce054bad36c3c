"""Problem 3: what has been processed, kept as disjoint intervals of sequence numbers.

Everything works inside (source, block of ``BLOCK`` numbers), so a source with a third of all rows is spread over as
many tasks as it has blocks; only intervals that touch a block's edge (two a block at most) meet again afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwell.sources.commits import CommitLog

BLOCK = 65_536
SCHEMA = "source string, lo long, hi long"


def _block(col: str):
    return F.floor(F.col(col) / BLOCK).cast("long")


def to_intervals(numbers: DataFrame) -> DataFrame:
    """(source, seq) to maximal disjoint (source, lo, hi). Repeated and null numbers are ignored."""
    return merge_intervals(numbers.where("seq is not null").select("source", F.col("seq").alias("lo"), F.col("seq").alias("hi")))


def _islands(spans: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", (before.isNull() | (F.col("lo") > before + 1)).cast("int"))
    numbered = marked.withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_n")


def _cut(spans: DataFrame) -> DataFrame:
    """Cut intervals at block edges, so that each piece lies in one block."""
    pieces = spans.withColumn("_b", F.explode(F.sequence(_block("lo"), _block("hi"))))
    return pieces.select("source", "_b", F.greatest("lo", F.col("_b") * BLOCK).alias("lo"), F.least("hi", (F.col("_b") + 1) * BLOCK - 1).alias("hi"))


def merge_intervals(spans: DataFrame) -> DataFrame:
    """Union of overlapping or adjacent intervals. Null or inverted intervals are ignored."""
    parts = _islands(_cut(spans.where("lo <= hi").select("source", "lo", "hi").distinct()), ["source", "_b"])
    edge = (F.col("lo") == F.col("_b") * BLOCK) | (F.col("hi") == (F.col("_b") + 1) * BLOCK - 1)
    joined = _islands(parts.where(edge).drop("_b"), ["source"])
    return parts.where(~edge).select("source", "lo", "hi").unionByName(joined)


def subtract(rows: DataFrame, processed: DataFrame, source: str, seq: str) -> DataFrame:
    """Rows whose number lies in no processed interval of their source: the gaps, late commits included.

    A sweep over each block: the running greatest end of the intervals begun so far decides each row. Rows with a null
    number were never processed and stay. Columns of ``rows`` are kept.
    """
    left = rows.select(F.col(source).alias("source"), F.col(seq).alias("lo"), F.lit(None).cast("long").alias("hi"), F.struct("*").alias("_row"))
    numbered = left.where("lo is not null").withColumn("_b", _block("lo"))
    right = _cut(processed).select("source", "lo", "hi", F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "_b")
    both = numbered.unionByName(right)
    order = Window.partitionBy("source", "_b").orderBy("lo", F.col("hi").isNull())
    swept = both.withColumn("_end", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    open_rows = swept.where(F.col("_row").isNotNull() & (F.col("_end").isNull() | (F.col("_end") < F.col("lo")))).select("_row")
    return open_rows.unionByName(left.where("lo is null").select("_row")).select("_row.*")


class IntervalLedger:
    """Commits of output together with the merged intervals of processed numbers.

    A commit writes ``output`` and ``intervals`` into one folder of its own and publishes it by one marker
    (``CommitLog``): a run that dies before leaves nothing visible and its numbers stay open; a run that dies after has
    both. A run that another one overtook gets ``Conflict``, so no number is answered twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)

    def processed(self, upto: int | None = None) -> DataFrame:
        done = self.log.numbers() if upto is None else list(range(upto))
        if not done:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.log.folder(done[-1])}/intervals")

    def pending(self, rows: DataFrame, source: str, seq: str) -> DataFrame:
        """The rows that no commit answers for; all of them before the first commit."""
        return subtract(rows, self.processed(), source, seq) if self.log.numbers() else rows

    def output(self) -> DataFrame | None:
        done = self.log.folders()
        return self.spark.read.parquet(*(f"{f}/output" for f in done)) if done else None

    def next_number(self) -> int:
        """The number that a run begun now would commit; read it before ``pending`` and hand it to ``commit``."""
        return len(self.log.numbers())

    def commit(self, output: DataFrame, numbers: DataFrame, number: int | None = None) -> int:
        """numbers: (source, seq) that ``output`` answers for, rows without output included."""
        number = self.next_number() if number is None else number
        staged = self.log.stage()
        output.write.parquet(f"{staged}/output")
        mine = numbers.select("source", F.col("seq").alias("lo"), F.col("seq").alias("hi"))
        merge_intervals(self.processed(number).unionByName(mine)).write.parquet(f"{staged}/intervals")
        return self.log.publish(staged, number)
