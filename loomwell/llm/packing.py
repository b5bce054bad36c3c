"""Problem 8: documents into containers of fixed token capacity, by hierarchical residual packing.

Round 0 deals the items into buckets of about BUCKET_ITEMS by a hash and packs each bucket by best fit, largest first.
Containers filled to the round's share are final, and so are those whose space is below the smallest one still open; the
others go on as single items of their size and are dealt into as many buckets of BUCKET_ITEMS as they need. The share
asked for falls from round to round down to a half, and best fit leaves at most one container of a bucket less than half
full, so few go on, no bucket grows, and in the end there is one bucket a target. What became of each container is kept
as a mapping and joined back to the documents at the end.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.session import broadcast_if_small, materialise, spread

#: Parameters.
TOKENIZER_PATH, TOKENIZER = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
BUCKET_ITEMS, TARGETS_AT_ONCE = 20_000, 1_000
FULL = (0.985, 0.96, 0.9, 0.75, 0.5)
# Fixed value: the published splitting pattern of this byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(text: str | None, path: str = f"{TOKENIZER_PATH}/{TOKENIZER}") -> int:
    return len(_encoder(path).encode_ordinary(text)) if text else 0


def token_counts(documents: DataFrame, path: str = f"{TOKENIZER_PATH}/{TOKENIZER}") -> DataFrame:
    """(doc_id, tokens); null and empty texts have 0."""

    @F.pandas_udf(T.LongType())
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count_tokens(t, path)).astype("int64")

    return spread(documents.select("doc_id", "text"), "doc_id").select("doc_id", tokens("text").alias("tokens"))


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each size, largest first into the fullest container that still takes it."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    free: dict[int, list[int]] = {}
    levels: list[int] = []
    out, made = [0] * len(sizes), 0
    for i in order:
        size = sizes[i]
        at = bisect_left(levels, size)
        if at < len(levels):
            level = levels[at]
            number = free[level].pop()
            if not free[level]:
                del free[level], levels[at]
        else:
            level, number, made = capacity, made, made + 1
        out[i] = number
        rest = level - size
        if rest not in free:
            free[rest] = []
            insort(levels, rest)
        free[rest].append(number)
    return out


def _pack(number: int):
    """Pack the rows (bin, tokens) of one bucket; gives each its container, ``into``."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin", kind="stable")
        bucket = int(rows["bucket"].iloc[0])
        into = best_fit(rows["tokens"].tolist(), int(rows["capacity"].iloc[0]))
        return rows.assign(into=[f"{number}-{bucket}-{k}" for k in into])

    return pack


def pack_documents(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, container_id, doc_id, part, tokens) for sizes (doc_id, tokens) and targets (target_id, capacity_tokens).

    A document larger than a capacity gives full containers of its own and a last part that is packed like any other
    item; every other document stays whole (part 0). Null sizes count as 0; repeated rows are packed as often as they
    come; targets with a null or non-positive capacity are left out. Targets beyond TARGETS_AT_ONCE are packed in turn.
    """
    goals = targets.where("capacity_tokens > 0").select("target_id", F.col("capacity_tokens").cast("long").alias("capacity")).orderBy("target_id", "capacity").collect()
    sized = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.monotonically_increasing_id().alias("_u"))
    sized = materialise(sized, "pack-items")
    out = None
    for k in range(0, max(1, len(goals)), TARGETS_AT_ONCE):
        part = _pack_for(sized, goals[k : k + TARGETS_AT_ONCE])
        out = part if out is None else out.unionByName(part)
    return out


def _pack_for(sized: DataFrame, goals: list) -> DataFrame:
    kinds = [F.struct(F.lit(g.target_id).alias("target_id"), F.lit(g.capacity).alias("capacity")) for g in goals]
    each = F.array(*kinds) if kinds else F.array().cast("array<struct<target_id:bigint,capacity:bigint>>")
    crossed = sized.select("*", F.inline(each))  # every document goes into a container of every target
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("tokens") / F.col("capacity")) - 1, F.lit(0).cast("long")))
    items = crossed.withColumn("part", F.explode(parts)).withColumn("tokens", F.least("capacity", F.col("tokens") - F.col("part") * F.col("capacity")))
    items = items.withColumn("bin", F.concat_ws(":", "doc_id", "part", "_u"))
    whole = F.col("tokens") == F.col("capacity")
    named = ["target_id", "container_id", "doc_id", "part", "tokens"]
    full = items.where(whole).withColumn("container_id", F.concat(F.lit("w-"), "bin")).select(*named)
    # round 0 takes documents and keeps them beside their container; later rounds take containers
    rest = items.where(~whole).select("target_id", "capacity", "bin", "tokens", "doc_id", "part")
    number, opened, placed = 0, rest, None
    maps: list[DataFrame] = []
    while True:
        buckets = max(1, -(-(sized.count() if not number else opened.groupBy("target_id").count().agg(F.max("count")).first()[0] or 0) // BUCKET_ITEMS))
        dealt = opened.withColumn("bucket", F.pmod(F.xxhash64("bin", F.lit(number)), F.lit(buckets)).cast("long"))
        schema = T.StructType([*dealt.schema.fields, T.StructField("into", T.StringType())])
        packed = materialise(dealt.groupBy("target_id", "bucket").applyInPandas(_pack(number), schema), f"pack-round{number}")
        if placed is None:
            placed = packed.select("target_id", "doc_id", "part", "tokens", F.col("into").alias("container_id"))
        else:
            maps.append(packed.select("target_id", "bin", "into"))
        if buckets == 1:
            break
        bins = materialise(packed.groupBy("target_id", "capacity", F.col("into").alias("bin")).agg(F.sum("tokens").alias("tokens")), f"pack-bins{number}")
        least = bins.groupBy(F.col("target_id").alias("_t")).agg(F.min("tokens").alias("_least"))  # TARGETS_AT_ONCE rows at most
        bins = bins.join(F.broadcast(least), F.col("target_id").eqNullSafe(F.col("_t")))
        done = (F.col("tokens") >= FULL[min(number, len(FULL) - 1)] * F.col("capacity")) | (F.col("capacity") - F.col("tokens") < F.col("_least"))
        opened, number = bins.where(~done).drop("_t", "_least"), number + 1
        if opened.isEmpty():
            break
    out = placed
    for m in maps:  # a container that went on is what it went into
        side = m.select("target_id", F.col("bin").alias("container_id"), F.col("into").alias("_into"))
        out = out.join(broadcast_if_small(side), ["target_id", "container_id"], "left").withColumn("container_id", F.coalesce("_into", "container_id")).drop("_into")
    return full.unionByName(out.select(*named))


def packing_report(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, containers, tokens, least, fill): containers used, the least number possible, and the share of space used."""
    per = packed.groupBy("target_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    joined = per.join(targets.select("target_id", "capacity_tokens"), "target_id")
    return joined.select("target_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))
