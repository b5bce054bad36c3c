"""Shared by the text operators: counts over all rows, word splitting."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+", re.U)


#: Names whose counts a task holds before it hands them on.
HELD = 100_000


def added_up(rows: DataFrame, counted: Callable[[Iterator[tuple]], Iterable[tuple[str, list[float]]]], width: int) -> DataFrame:
    """(name, counts): what ``counted`` yields for all rows, added up by name. A task adds up what it yields in Python, and
    hands it on whenever it holds HELD names, so neither its memory nor the shuffle grows with the rows."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held: dict[str, list[float]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["name", "counts"])

        for name, more in counted(each):
            have = held.get(name)
            if have is None:
                held[name] = list(more)
            else:
                for i, x in enumerate(more):
                    if x:
                        have[i] += x
            if len(held) >= HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    found = rows.mapInArrow(parts, "name string, counts array<double>")
    sums = F.array(*(F.sum(F.element_at("counts", i + 1)) for i in range(width)))
    return found.groupBy("name").agg(sums.alias("counts"))
