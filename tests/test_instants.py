from datetime import datetime, timedelta

from veriplane.operators.instants import append_dictionary, normalize_instants

SOURCES = [("ny", "America/New_York", False), ("gulf", "America/Chicago", True), ("odd", "Nowhere/Land", None)]


def us(*parts):
    return (datetime(*parts) - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def read(spark, rows):
    df = spark.createDataFrame([(i, t, s, 1) for i, (t, s, _) in enumerate(rows)], "row_id long, at string, source_id string, utc_us int")
    sources = spark.createDataFrame(SOURCES, "source_id string, time_zone string, day_first boolean")
    got = {r.row_id: r.utc_us for r in normalize_instants(df, "row_id", ["at"], "source_id", sources).collect()}
    return [got.get(i) for i in range(len(rows))]


def test_forms_zones_and_edges(spark):
    rows = [
        ("2020-01-02", "ny", us(2020, 1, 2)), ("20200229", "ny", us(2020, 2, 29)), ("2021-02-29", "ny", None), ("00000000", "ny", None),
        ("03/04/2020", "ny", us(2020, 3, 4)), ("03/04/2020", "gulf", us(2020, 4, 3)), ("13/04/2020", "ny", None), ("3.4.69", "ny", us(2069, 3, 4)), ("3.4.70", "ny", us(1970, 3, 4)),
        ("1 Apr 2001", "ny", us(2001, 4, 1)), ("September 9, 2020", "ny", us(2020, 9, 9)), ("31-OCT-1999", "ny", us(1999, 10, 31)),
        ("2023-03-12 02:30", "ny", us(2023, 3, 12, 7, 30)), ("2023-11-05 01:30:00", "ny", us(2023, 11, 5, 5, 30)),
        ("2023-07-01T00:00:00z", "ny", us(2023, 7, 1)), ("20230701T101112Z", "ny", us(2023, 7, 1, 10, 11, 12)),
        ("2023-07-01T00:00:00.1234567+05:30", "ny", us(2023, 6, 30, 18, 30, 0, 123456)), ("2023-07-01T00:00:00-1000", "ny", us(2023, 7, 1, 10)),
        ("2023-07-01 08:00:00 HST", "ny", us(2023, 7, 1, 18)), ("2023-07-01T08:00:00[Pacific/Honolulu]", "ny", us(2023, 7, 1, 18)),
        ("07/01/2023 12:05 AM", "ny", us(2023, 7, 1, 4, 5)), ("07/01/2023 13:05 PM", "ny", None), ("Apr 2, 2006 03:02:22", "ny", us(2006, 4, 2, 8, 2, 22) - 3_600_000_000),
        ("1540292966", "ny", 1540292966 * 10**6), ("1540292966123", "ny", 1540292966123 * 1000), ("154029296", "ny", None),
        ("2023-07-01 25:00", "ny", None), ("2023-07-01 10:60", "ny", None), ("2023-07-01 10:00:00 XYZ", "ny", None), ("2023-07-01 24:00", "ny", us(2023, 7, 2, 4)),
        ("2023-07-01 10:00", "odd", None), ("2023-07-01", None, us(2023, 7, 1)), ("2023-07-01T10:00:00Z", "none", us(2023, 7, 1, 10)), ("2023-07-01 10:00", None, None),
        ("N/A", "ny", None), ("   ", "ny", None), (None, "ny", None), ("", "ny", None), ("9" * 100_000, "ny", None), ("é2020-01-02", "ny", None),
    ]
    got = read(spark, rows)
    wrong = [(r, g) for r, g in zip(rows, got) if g != r[2]]
    assert not wrong, wrong[:5]


def test_repeats_and_empty(spark):
    schema = "row_id long, at string, source_id string"
    sources = spark.createDataFrame(SOURCES, "source_id string, time_zone string, day_first boolean")
    twice = spark.createDataFrame([(1, "2020-01-02", "ny")] * 3, schema)
    assert normalize_instants(twice, "row_id", ["at"], "source_id", sources).count() == 1
    assert normalize_instants(spark.createDataFrame([], schema), "row_id", ["at"], "source_id", sources).count() == 0


def test_dictionary_grows_by_new_texts_only(spark, tmp_path):
    path = str(tmp_path / "words")
    schema = "raw string, zone string, day_first boolean"
    first = spark.createDataFrame([("2020-01-02", "UTC", False), ("nonsense", "UTC", False)], schema)
    assert append_dictionary(first, path).count() == 2
    more = spark.createDataFrame([("2020-01-02", "UTC", False), ("2020-01-03", "UTC", False)], schema)
    assert append_dictionary(more, path).count() == 3
    assert spark.read.parquet(path).count() == 3
