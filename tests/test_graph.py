from veriplane.operators.graph import active_cohorts, build_graph, registry_rows

ROWS = (
    "row_id long, name string, npi string, state string, exclusion_date string, reinstatement_date string, source_id string, source_record_id string, "
    "medicaid_provider_id string, provider_type string, indefinite_exclusion boolean, cluster string, n string"
)
REGISTRY = "npi string, entity_id string, active boolean, deactivated string, address string, phone string"


def rows_of(spark, rows):
    full = [(i, name, npi, state, day, None, "leie", str(i), None, None, False, "x", "y") for i, name, npi, state, day in rows]
    return spark.createDataFrame(full, ROWS)


def graph(spark, rows, registry=(), verdicts=()):
    reg = registry_rows(spark.createDataFrame(list(registry), REGISTRY), "entity_id")
    return build_graph(rows_of(spark, rows), reg, spark.createDataFrame(list(verdicts), "entity_a string, entity_b string, verdict string"))


def test_entities_events_and_candidates(spark):
    rows = [
        (1, "MARY JANE WATSON", "111", "HI", "1/2/2010"), (2, "MARY JANE WATSN", None, "HI", None), (3, "MARY JANE WATSON", "111", "CA", "2010-01-01"), (3, "MARY JANE WATSON", "111", "CA", "2010-01-01"),
        (4, "JONATHAN SMITHERS", None, None, "1/2/2011"), (5, "JONATHAN SMITHERZ", None, None, "1/2/2012"), (6, " ", "111", "HI", "1/2/2010"), (7, None, "111", "HI", "1/2/2010"), (None, "X Y", None, None, "1/2/2010"),
        (8, "123", None, None, "1/2/2013"), (9, "ACME HOME HEALTH LLC", "222", None, "1/2/2014"),
    ]
    registry = [("111", "a", True, None, "S1", "P1"), ("111", "b", False, "1/5/2020", "S2", None), ("222", "c", True, None, "S2", "P2"), *[(f"3{i:02}", "d", True, None, "S2", "P2" if i < 3 else None) for i in range(12)], ("400", "e", False, None, "S2", "P2")]
    got = graph(spark, rows, registry)
    entity = {r.entity_id: r for r in got["entity"].collect()}
    assert set(entity) == {"111", "222", "name:JONATHAN SMITHERS", "name:JONATHAN SMITHERZ", "name:"}
    mary = entity["111"]
    assert (mary.canonical_name, mary.npi_active, mary.npi_deactivation_date, mary.practice_address, mary.practice_phone) == ("MARY JANE WATSON", False, "2020-01-05", "S2", None)
    assert (mary.addr_cohort_active, mary.phone_cohort_active, mary.both_cohort_active, len(mary.colocated_sample)) == (12, None, None, 10)
    acme = entity["222"]
    assert (acme.entity_type, acme.addr_cohort_active, acme.phone_cohort_active, acme.both_cohort_active, acme.resolution_confidence) == ("organization", 12, 3, 3, 1.0)
    assert sorted((r.entity_id, str(r.excluded_at)[:4]) for r in got["exclusion_event"].collect()) == [("111", "2010"), ("222", "2014"), ("name:", "2013"), ("name:JONATHAN SMITHERS", "2011"), ("name:JONATHAN SMITHERZ", "2012")]
    links = got["identity_link_candidate"].collect()
    assert [(r.entity_a, r.entity_b) for r in links] == [("name:JONATHAN SMITHERS", "name:JONATHAN SMITHERZ")] and 0.72 <= links[0].confidence < 0.9
    meta = got["meta"].first()
    assert (meta.party_count, meta.merge_count, meta.entity_count, meta.exclusion_event_count, meta.candidate_count) == (7, 2, 5, 5, 1)


def test_verdicts_merge_and_remove(spark):
    rows = [(4, "JONATHAN SMITHERS", None, None, "1/2/2011"), (5, "JONATHAN SMITHERZ", None, None, "1/2/2012"), (6, "ALICE DOE", None, None, None)]
    pair = ("name:JONATHAN SMITHERS", "name:JONATHAN SMITHERZ")
    assert graph(spark, rows, verdicts=[(*pair, "reject")])["identity_link_candidate"].count() == 0
    merged = graph(spark, rows, verdicts=[(*pair, "confirm"), ("name:ALICE DOE", "name:NOBODY", "confirm")])
    assert merged["entity"].count() == 2 and merged["identity_link_candidate"].count() == 0
    assert {r.resolution_confidence for r in merged["entity"].collect()} == {1.0, 0.85}


def test_empty(spark):
    got = graph(spark, [])
    assert all(got[k].count() == 0 for k in ("entity", "exclusion_event", "identity_link_candidate")) and got["meta"].first().party_count == 0
    nothing = spark.createDataFrame([], "npi string")
    assert active_cohorts(registry_rows(spark.createDataFrame([], REGISTRY), "entity_id"), nothing, ["phone"]).count() == 0
