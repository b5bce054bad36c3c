from datetime import UTC, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwell.functions.instants import parse_instant
from loomwell.operators.timestamps import TimestampDictionary, instants_found, normalise_timestamps


def us(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("raw", "tz", "locale", "want"),
    [
        ("2024-01-01T00:30:00+05:00", "UTC", "en-US", us(2023, 12, 31, 19, 30)),
        ("2024-07-01 12:00:00", "Europe/Berlin", "de-DE", us(2024, 7, 1, 10)),
        ("20240701T120000Z", "Asia/Tokyo", "en-US", us(2024, 7, 1, 12)),
        ("2024-07-01", "America/New_York", "en-US", us(2024, 7, 1, 4)),
        ("03/04/2024 1:05 PM", "UTC", "en-US", us(2024, 3, 4, 13, 5)),
        ("03/04/2024 13:05", "UTC", "en-GB", us(2024, 4, 3, 13, 5)),
        ("Tue, 05 Mar 2024 10:00:00 EST", "UTC", "fr-FR", us(2024, 3, 5, 15)),
        ("2024-03-05T10:00:00-05:00[America/New_York]", "UTC", "en-US", us(2024, 3, 5, 15)),
        ("5. März 2024, 08:00 Uhr", "Europe/Berlin", "de-DE", us(2024, 3, 5, 7)),
        ("5 mars 2024 à 08h30", "Europe/Paris", "fr-FR", us(2024, 3, 5, 7, 30)),
        ("5 de marzo de 2024, 08:30", "Europe/Madrid", "es-ES", us(2024, 3, 5, 7, 30)),
        ("5 stycznia 2024, 08:30", "Europe/Warsaw", "pl-PL", us(2024, 1, 5, 7, 30)),
        ("5 мая 2024, 08:30", "UTC", "ru-RU", us(2024, 5, 5, 8, 30)),
        ("March 5, 2024 12:00 am", "UTC", "en-US", us(2024, 3, 5)),
        ("1709632800", "UTC", "en-US", 1709632800 * 10**6),
        ("1709632800123", "UTC", "en-US", 1709632800123 * 10**3),
        # the clock that strikes twice means the first; the skipped one is read with the offset before the gap
        ("2024-11-03 01:30:00", "America/New_York", "en-US", us(2024, 11, 3, 5, 30)),
        ("2024-03-10 02:30:00", "America/New_York", "en-US", us(2024, 3, 10, 7, 30)),
    ],
)
def test_notations(raw, tz, locale, want):
    assert parse_instant(raw, tz, locale) == want


@pytest.mark.parametrize("raw", [None, "", "  ", "n/a", "soon", "0000-00-00 00:00:00", "1970-01-01T00:00:00Z", "1994-12-31", "2024-13-01", "2024-02-30", "0", "12:30", "2024-01-01T00:00:00 nowhere else"])
def test_placeholders(raw):
    assert parse_instant(raw, "UTC", "en-US") is None


@given(st.text(max_size=40))
def test_never_raises(text):
    parse_instant(text, "Europe/Berlin", "de-DE")


def test_found_and_edges(spark, make_posts, make_blogs):
    rows = [{"date": "2024-07-01 12:00:00", "modified": None}, {"date": "", "modified": "2024-07-01T10:00:00Z"}, {"blog_id": None, "date": "2024-07-01T10:00:00Z"}, {"date": "x" * 100_000}]
    posts = make_posts(rows).withColumn("raw", F.lit("clash")).withColumn("zone", F.lit(1)).withColumn("_row", F.lit(2))
    got = {tuple(r) for r in instants_found(posts, make_blogs()).collect()}
    want = us(2024, 7, 1, 10)
    assert got == {(0, "date", want), (1, "modified", want), (2, "date", want)}
    assert instants_found(posts.limit(0), make_blogs()).count() == 0


def test_dictionary_parses_a_value_once(spark, tmp_path):
    d = TimestampDictionary(spark, str(tmp_path / "d"))
    one = spark.createDataFrame([("2024-07-01", None, None), ("2024-07-01", None, None), ("n/a", "UTC", None)], "raw string, zone string, locale string")
    two = spark.createDataFrame([("2024-07-01", None, None), ("2024-07-02", "UTC", None)], "raw string, zone string, locale string")
    assert d.update(one).count() == 1
    assert d.update(two).count() == 2
    out = normalise_timestamps(two, "raw", "zone", "locale", dictionary=d)
    assert sorted(r.utc_us for r in out.collect()) == [us(2024, 7, 1), us(2024, 7, 2)]
    assert out.columns == ["raw", "zone", "locale", "utc_us"]


def test_dictionary_survives_dead_batches_and_other_writers(spark, tmp_path):
    path, rows = str(tmp_path / "d"), lambda v: spark.createDataFrame([(v, None, None)], "raw string, zone string, locale string")
    d = TimestampDictionary(spark, path)
    rows("2024-07-09").write.parquet(d.log.stage())  # a batch that died before its marker
    assert d.update(rows("2024-07-01")).count() == 1
    other, numbers = TimestampDictionary(spark, path), d.log.numbers
    assert other.update(rows("2024-07-02")).count() == 2
    first = [True]

    def stale():
        if first:
            first.clear()
            return [0]  # as listed before the other writer's commit
        return numbers()

    d.log.numbers = stale
    assert sorted(r.raw for r in d.update(rows("2024-07-03")).collect()) == ["2024-07-01", "2024-07-02", "2024-07-03"]


def test_clock_as_written(spark, make_posts, make_blogs):
    from loomwell.functions import dates
    from loomwell.operators.timestamps import post_clocks

    want = {
        "2024-01-01T00:30:00+02:00": ("2024", "2024-01", us(2023, 12, 31, 22, 30)), "31. Dezember 2023 23:30": ("2023", "2023-12", us(2023, 12, 31, 22, 30)), "Sun, 31 Dec 2023 23:30:00 -0500": ("2023", "2023-12", us(2024, 1, 1, 4, 30)),
        "1704061800": ("2023", "2023-12", us(2023, 12, 31, 22, 30)), "n/a": ("Undated", "Undated", None), None: ("Undated", "Undated", None), "0001-01-01": ("Undated", "Undated", None),
    }
    posts = post_clocks(make_posts([{"date": d} for d in want]), make_blogs(), "date")
    got = posts.select("date", dates.wall_year("wall_us").alias("y"), dates.wall_month("wall_us").alias("m"), "utc_us").collect()
    assert {r.date: (r.y, r.m, r.utc_us) for r in got} == want
