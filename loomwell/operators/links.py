"""Links, assets and titles between posts, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions.text import image_key, normalize_url
from loomwell.session import broadcast_if_small, materialise


def link_targets(chapters: DataFrame, by: list[str], url: str, file: str, idx: str) -> DataFrame:
    """(by..., norm, file): one target for each normalised url; of posts with the same url the last one wins."""
    return chapters.groupBy(*by, normalize_url(url).alias("norm")).agg(F.max_by(file, idx).alias("file"))


def resolve_links(links: DataFrame, targets: DataFrame, by: list[str], href: str) -> DataFrame:
    """Add ``target`` (null where the link leaves the collection)."""
    keyed = links.withColumn("norm", normalize_url(href))
    return keyed.join(targets.withColumnRenamed("file", "target"), [*by, "norm"], "left").drop("norm")


def fix_fragments(links: DataFrame, ids: DataFrame) -> DataFrame:
    """links (file, target, fragment) against ids (file, id): a fragment stays only if its target has that id."""
    have = ids.select(F.col("file").alias("target"), F.col("id").alias("fragment"), F.lit(True).alias("_ok")).distinct()
    return links.join(have, ["target", "fragment"], "left").withColumn("fragment", F.when(F.col("_ok"), F.col("fragment"))).drop("_ok")


def relink_outside(links: DataFrame, placed: DataFrame) -> DataFrame:
    """links (file, target) and placed (file, volume, url): ``href`` is the file inside a volume, the url across volumes."""
    here = placed.select("file", F.col("volume").alias("_v"))
    there = placed.select(F.col("file").alias("target"), F.col("volume").alias("_w"), F.col("url").alias("_u"))
    both = links.join(here, "file").join(there, "target", "left")
    return both.withColumn("href", F.when(F.col("_v") == F.col("_w"), F.col("target")).otherwise(F.col("_u"))).drop("_v", "_w", "_u")


def same_image(a: Column | str, b: Column | str) -> Column:
    return image_key(a) == image_key(b)


def lead_image(featured: Column | str, inline: Column | str) -> Column:
    """The featured image unless the body shows it already."""
    f = F.col(featured) if isinstance(featured, str) else featured
    arr = F.col(inline) if isinstance(inline, str) else inline
    shown = F.exists(F.coalesce(arr, F.array().cast("array<string>")), lambda i: image_key(i) == image_key(f))
    return F.when((f != "") & ~shown, f)


def first_missing(uses: DataFrame, by: list[str], idx: str, url: str) -> DataFrame:
    """(by..., idx, missing): missing images count for the first chapter that wants them."""
    first = uses.groupBy(*by, url).agg(F.min(idx).alias(idx))
    return first.groupBy(*by, idx).agg(F.count("*").alias("missing"))


def bleeding_titles(bodies: DataFrame, titles: DataFrame, by: str, least: int = 25) -> DataFrame:
    """(by, id, other): bodies (by, id, text) that hold another row's title (by, id, title) of more than ``least`` characters.

    A body that holds a title holds the title's inner words as whole words in a row, so both sides are joined on a hash
    of up to three inner words and the containment is then checked; no pair is compared without such a match. Titles
    of one or two words are looked for by their characters in ``least``-character steps.
    """
    words = lambda c: F.filter(F.split(c, r"[ \t\r\n]+"), lambda w: w != "")
    t = titles.where(F.length("title") > least).select(by, F.col("id").alias("other"), "title", words(F.col("title")).alias("w"))
    t = t.withColumn("n", F.least(F.size("w") - 2, F.lit(3))).where("n > 0")
    t = t.withColumn("k", F.xxhash64(F.slice("w", F.lit(2), F.col("n")), "n")).select(by, "other", "title", "k")
    b = bodies.where("text is not null").select(by, "id", "text", words(F.col("text")).alias("w"))
    shingle = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice(F.col("w"), i, n), F.lit(n)))
    keys = F.concat(*(F.when(F.size("w") >= n, shingle(n)).otherwise(F.array().cast("array<bigint>")) for n in (1, 2, 3)))
    asked = broadcast_if_small(materialise(t.select(by, "k").distinct(), "title-keys"))  # few beside the words of all bodies
    met = b.select(by, "id", F.explode(F.array_distinct(keys)).alias("k")).join(asked, [by, "k"], "left_semi")
    found = met.join(t.select(by, "other", "k"), [by, "k"])
    short = titles.where(F.length("title") > least).where(F.size(words(F.col("title"))) <= 2).select(by, F.col("id").alias("other"), "title")
    near = bodies.where(F.length("text") >= least).join(short.select(by).distinct(), by, "left_semi")
    step = F.sequence(F.lit(1), F.length("text") - least + 1)
    grams = near.select(by, "id", F.explode(F.array_distinct(F.transform(step, lambda i: F.xxhash64(F.substring(F.col("text"), i, F.lit(least)))))).alias("k"))
    wanted = grams.join(short.select(by, "other", F.xxhash64(F.substring("title", 1, least)).alias("k")), [by, "k"])
    pairs = found.select(by, "id", "other").unionByName(wanted.select(by, "id", "other")).where(F.col("id") != F.col("other")).distinct()
    named = pairs.join(titles.select(by, F.col("id").alias("other"), "title"), [by, "other"]).join(bodies.select(by, "id", "text"), [by, "id"])
    return named.where(F.contains("text", "title")).select(by, "id", "other")


def pick_source(counts: DataFrame, by: str, name: str, n: str, ranks: dict[str, int]) -> DataFrame:
    """The source that lists most posts; ties go to the richer kind."""
    rank = F.coalesce(*(F.when(F.col(name) == k, F.lit(-v)) for k, v in ranks.items()), F.lit(-99))
    return counts.groupBy(by).agg(F.max_by(name, F.struct(F.col(n), rank)).alias("picked"))


def batch_ids(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Number rows in batches of ``size`` in order."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def strided(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """Every floor(n / most)-th row of each group in order, the first ``most`` of them (a sampling operator)."""
    w = Window.partitionBy(by).orderBy(order)
    n = F.count("*").over(Window.partitionBy(by))
    numbered = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_step", F.greatest(F.lit(1), F.floor(n / most)))
    return numbered.where((F.col("_i") % F.col("_step") == 0) & (F.col("_i") / F.col("_step") < most)).drop("_i", "_step")
