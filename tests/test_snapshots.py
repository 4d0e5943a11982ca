from veriplane.operators.snapshots import snapshot_changes

SCHEMA = "run_no int, signal_id string, line_no long, reason_code string, confidence double, _run string, _key string"


def changes(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = snapshot_changes(df, "run_no", "signal_id", "line_no", ["reason_code"], {"confidence": 1e-9})
    assert out.columns == ["from_run", "to_run", "signal_id", "change_kind"]
    return sorted(map(tuple, out.collect()))


def test_added_removed_changed_and_gaps(spark):
    rows = [
        (1, "a", 1, "r", 0.5), (3, "a", 1, "r", 0.5 + 1e-12), (7, "a", 1, "r", 0.6),
        (1, "b", 1, "r", 0.5), (7, "b", 1, "r", 0.5),
        (3, "c", 1, None, None), (7, "c", 1, "", None),
        (1, "d", 1, "x", 0.1), (1, "d", 2, "y", 0.1), (3, "d", 5, "y", 0.1),
        (3, "e", 1, "r", None), (7, "e", 1, "r", 0.2),
    ]
    assert changes(spark, rows) == sorted(
        [
            (3, 7, "a", "changed"), (1, 3, "b", "removed"), (3, 7, "b", "added"), (1, 3, "c", "added"),
            (3, 7, "d", "removed"), (1, 3, "e", "added"), (3, 7, "e", "changed"),
        ]
    )


def test_ignored_keys_still_make_a_run(spark):
    assert changes(spark, [(1, "a", 1, "r", 1.0), (2, None, 1, "r", 1.0), (2, "", 2, "r", 1.0), (None, "a", 1, "r", 1.0)]) == [(1, 2, "a", "removed")]


def test_repeats_ties_empty_and_long(spark):
    assert changes(spark, []) == []
    long = "z" * 200_000
    row = (1, long, 1, "r", float("nan"))
    assert changes(spark, [row, row, (2, long, 1, "r", float("nan")), (2, long, 1, "a", 0.0)]) == []
    assert changes(spark, [(1, "k", 1, "é", 0.0)] * 3) == []
