from datetime import datetime

from veriplane.llm.survivors import claim_facts, judged_values, source_quality, surviving_fields

SCHEMA = "record_id long, group_id long, canonical_name string, canonical_state string, npis array<string>, source_id string, observed_at timestamp, value string, probability int"
A, B = "1234567893", "1245319599"


def frames(spark, rows):
    records = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return records, spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "source_id string, trust_rank int")


def chosen(spark, rows):
    return {(r.group_id, r.field_name): r.record_id for r in surviving_fields(*frames(spark, rows)).collect()}


def test_trust_then_recency_and_usability(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = [
        (1, 1, "UNKNOWN", " hi ", [A, "bad"], "s1", t(1)), (2, 1, "ANN DOE", "XX", None, "s2", t(2)), (3, 1, "ANN  DOE", "CA", [], "s2", t(3)), (3, 1, "ANN  DOE", "CA", [], "s2", t(3)),
        (4, 2, "BOB", "HI", [A], "s1", t(1)),
        (5, 3, "n/a", None, ["0000000000"], "s1", None), (6, 3, "XXXX", "", None, None, t(1)),
        (7, 4, "É", "gu", [A + "0"], None, t(1)), (8, 4, "z" * 100_000, "ZZ", [B], "what", t(1)),
        (9, None, "NO GROUP", "HI", [A], "s1", t(1)), (None, 4, "NO ID", "HI", [A], "s1", t(1)),
    ]
    got = chosen(spark, rows)
    assert got[(1, "canonical_name")] == 3 and got[(1, "canonical_state")] == 1 and got[(1, "npis")] == 1
    assert not any(g in (2, 3) for g, _ in got)
    assert got[(4, "canonical_state")] == 7 and got[(4, "npis")] == 8 and (4, "canonical_name") not in got
    assert len(got) == 5


def test_empty(spark):
    assert chosen(spark, []) == {}


def test_quality_is_learnt(spark):
    """Source s3 is wrong half the time; the others agree on the truth."""
    rows, n = [], 0
    for g in range(60):
        truth = f"NAME {chr(65 + g % 26)}{chr(65 + g // 26)} TRUE"
        for s in ("s1", "s2", "s3"):
            n += 1
            rows.append((n, g, truth if s != "s3" or g % 2 else truth.replace("TRUE", "WRONG"), "HI", [A], s, datetime(2024, 1, 1)))
    facts = claim_facts(*frames(spark, rows))
    quality, _ = source_quality(facts)
    q = {(r.field_name, r.source_id): r for r in quality.collect()}
    assert q[("canonical_name", "s1")].sensitivity > 0.9 > q[("canonical_name", "s3")].sensitivity
    assert q[("canonical_name", "s3")].specificity < q[("canonical_name", "s1")].specificity
    values = judged_values(*frames(spark, rows)).where("field_name = 'canonical_name'").collect()
    assert all((r.probability > 0.5) == r.value.endswith("TRUE") for r in values)
    # the same model, fitted over tables
    here = {(r.field_name, tuple(r.pos), tuple(r.neg)): r.probability for r in source_quality(facts)[1].collect()}
    there = {(r.field_name, tuple(r.pos), tuple(r.neg)): r.probability for r in source_quality(facts, most_patterns=0)[1].collect()}
    assert here.keys() == there.keys() and all(abs(here[k] - there[k]) < 1e-9 for k in here)
