import random
import zipfile

import pytest
from pyspark.sql import functions as F

from veriplane.functions.keys import address_key, first_npi, phone_key, rfc3339_or_us_date
from veriplane.functions.names import normalize_name, phonetic_token
from veriplane.operators.events import build_events, event_profile
from veriplane.operators.places import cohorts, colocated_counts
from veriplane.operators.quality import failure_runs, parse_score
from veriplane.operators.resolution import components, modal, pair_scores, resolve
from veriplane.operators.sealing import load_verified, seal
from veriplane.sources.archives import register
from veriplane.sources.lines import read_graph, read_lines, write_graph
from veriplane.sources.lists import exclusion_list, federal_extract, ownership, positional, registry
from veriplane.sources.pages import licence_records, text_lines
from veriplane.streaming.snapshots import stream_changes


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_names(spark):
    assert one(spark, normalize_name(F.lit("#1 Marketing Service, Inc"))) == "MARKETING SERVICE INC"
    assert one(spark, normalize_name(F.lit("SMITH, JOHN JR."))) == "SMITH JOHN"
    assert one(spark, normalize_name(F.lit("JOSÉ"))) == "JOS"
    assert one(spark, phonetic_token(F.lit("KNIGHT"))) == "NGHT"
    assert one(spark, phonetic_token(F.lit("ANNA"))) == "AN"


def test_keys(spark):
    assert one(spark, phone_key(F.lit("+1 (808) 555-1234"))) == "8085551234"
    assert one(spark, phone_key(F.lit("555-1234"))) is None
    assert one(spark, address_key(F.lit("1 Main St."), F.lit("Hilo"), F.lit("HI"), F.lit("96720-1234"))) == "1 MAIN ST HILO HI 96720"
    assert one(spark, first_npi(F.lit("id 1234567890 x"))) == "1234567890"
    for raw, want in [("2/3/19", "2019-02-03"), ("2/3/70", "1970-02-03"), ("02/30/2019", None), ("2015-01-01", None), ("2015-01-01T00:00:00Z", "2015-01-01"), (None, None)]:
        assert one(spark, F.date_format(rfc3339_or_us_date(F.lit(raw).cast("string")), "yyyy-MM-dd")) == want


def test_resolution(spark):
    rows = [
        (1, "MARY JANE WATSON", None, "HI"), (2, "MARY JANE WATSN", None, "HI"), (3, "JONATHAN SMITHERS", None, None), (4, "JONATHAN SMITHERZ", None, None),
        (5, "ALICE DOE", "1111111111", None), (6, "SOMEBODY ELSE", "1111111111", None), (7, "BOB ROE", "1", None), (8, "BOB ROE", "2", None), (9, "123", None, None), (10, "456", None, None),
    ]
    df = spark.createDataFrame(rows, "idx long, name string, npi string, state string")
    cluster = {r.idx: r.cluster for r in resolve(df).collect()}
    assert cluster[1] == cluster[2] and cluster[5] == cluster[6]
    assert cluster[3] != cluster[4] and cluster[7] != cluster[8] and cluster[9] != cluster[10]
    review = {(r.i, r.j): r.score for r in pair_scores(df).collect()}
    assert 0.72 <= review[(3, 4)] < 0.90 and review[(1, 2)] >= 0.90
    confirmed = spark.createDataFrame([(3, 4)], "i long, j long")
    cluster = {r.idx: r.cluster for r in resolve(df, confirmed).collect()}
    assert cluster[3] == cluster[4]


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def test_modal_ties(spark):
    df = spark.createDataFrame([("k", "bb"), ("k", "a"), ("k", " "), ("j", "b"), ("j", "a")], "k string, v string")
    assert dict(map(tuple, modal(df, "k", "v").collect())) == {"k": "bb", "j": "a"}


def test_events(spark):
    schema = "source_id string, provider_type string, exclusion_date string, reinstatement_date string, indefinite_exclusion boolean, state string, source_record_id string, medicaid_provider_id string, e string"
    rows = [
        ("sam_gov_extract", None, "1/2/2010", "1/2/2015", None, "HI", "1", None, "x"), ("hawaii_dcca_actions", None, "1/2/2016", None, None, "hi", None, "m", "x"),
        ("leie_updates", None, "1/2/2010", "1/2/2015", False, "CA", None, None, "y"), ("leie_updates", None, "bad", None, True, "CA", None, None, "z"),
    ]
    events = build_events(spark.createDataFrame(rows, schema), F.col("e"))
    assert events.count() == 3 and events.select("event_id").distinct().count() == 3
    got = {r.entity_id: r for r in event_profile(events).collect()}
    assert got["x"].excluded_now and got["x"].tiers == "federal,state licensing" and got["x"].n_states == 1
    assert not got["y"].excluded_now and got["y"].n_exclusions == 1


def test_places(spark):
    rows = [("a", "S1", "P1"), ("b", "S1", "P1"), ("c", "S1", None), ("d", None, "P2"), ("e", None, None)]
    df = spark.createDataFrame(rows, "id string, s string, p string")
    got = {r.id: (r.n_colocated, r.phone_shared) for r in colocated_counts(df, "id", "s", "p").collect()}
    assert got == {"a": (2, True), "b": (2, True), "c": (2, False)}
    assert {r.s: (r.n, r.first_ids) for r in cohorts(df, "s", "id", 2).collect()} == {"S1": (3, ["a", "b"])}


def test_quality(spark):
    assert one(spark, parse_score(F.lit("ANN DOE"), F.lit("1/2/2020"))) == 1.0
    assert one(spark, parse_score(F.lit(""), F.lit(None).cast("string"))) == pytest.approx(0.3)
    log = spark.createDataFrame([("k", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1, 0])], "k string, i int, f int")
    assert failure_runs(log, "k", "i", F.col("f") == 1).collect()[0].longest_run == 3


def test_raw_lists(spark, tmp_path):
    path = tmp_path / "list.csv"
    header = "LASTNAME,FIRSTNAME,MIDNAME,BUSNAME,GENERAL,SPECIALTY,UPIN,NPI,DOB,ADDRESS,CITY,STATE,ZIP,EXCLTYPE,EXCLDATE,REINDATE,WAIVERDATE,WAIVERSTATE"
    path.write_bytes(b"\xef\xbb\xbf" + (header + "\nDOE,JANE,,,,,,0000000000,,,,HI,,,20200101,00000000,,\n,,,ACME INC,,,,1234567890,,,,CA,,,20209999,,,\n").encode())
    rows = exclusion_list(spark, str(path), "leie").collect()
    assert [(r.person_or_entity_name, r.npi, r.source_record_id, str(r.exclusion_date)[:10]) for r in rows] == [("DOE JANE", None, "0", "2020-01-01"), ("ACME INC", "1234567890", "1", "None")]

    def raw(width, **at):
        cells = [""] * width
        for k, v in at.items():
            cells[int(k[1:])] = v
        return tuple(cells)

    table = lambda rows, width: spark.createDataFrame(rows, ", ".join(f"_c{i} string" for i in range(width)))
    reg = registry(table([raw(51, c0="1234567890", c1="1", c5="DOE", c6="JANE", c31="HI"), raw(51, c0="1999999999", c1="2", c4="ACME HOME HEALTH LLC", c31="CA", c39="01/01/2020"), raw(51, c0="bad")], 51), "reg")
    assert sorted((r.npi, r.status, r.name) for r in reg.collect()) == [("1234567890", "ACTIVE", "DOE, JANE"), ("1999999999", "DEACTIVATED", "ACME HOME HEALTH LLC")]
    sam = federal_extract(
        table([raw(29, c0="Classification", c27="NPI"), raw(29, c0="Individual", c3="Jane", c4="Q", c6="Doe", c17="HHS", c19="Fraud", c22="Indefinite", c27="npi 1234567890"), raw(29, c0="Firm", c1="Acme", c22="1/2/2020", c27="x")], 29), "sam"
    )
    assert [(r.person_or_entity_name, r.indefinite_exclusion, r.provider_type) for r in sam.collect()] == [("DOE, JANE Q", True, "Fraud — HHS")]
    own = ownership(table([raw(40, c4="I", c8="Al", c10="Roe", c19="5d"), raw(40, c4="O", c12="Acme", c19="12.5"), raw(40)], 40), "snf", "own")
    assert sorted((r.owner_name, r.ownership_pct) for r in own.collect()) == [("ACME", 12.5), ("ROE, AL", None)]


def test_zip_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("npidata_pfile_1.csv", 'a,b\n1,"x,y"\n2\n')
        z.writestr("npidata_pfile_1_fileheader.csv", "a,b\n")
    register(spark)
    rows = spark.read.format("zipcsv").option("width", "2").option("path", str(tmp_path / "*.zip")).option("member", r"npidata_pfile_.*\.csv$").load().collect()
    assert [tuple(r) for r in rows] == [("1", "x,y"), ("2", None)]
    (tmp_path / "c.csv").write_text('h1,h2\n1,"a ""b"""\n')
    assert [tuple(r) for r in positional(spark, str(tmp_path / "c.csv"), 2).collect()] == [("1", 'a "b"')]


def test_pages(spark):
    page = """<h2>BOARD OF NURSING</h2><p>Respondent: Jane Doe aka J. Roe</p><p>Case Number: N-1</p><p>Sanction:</p><p>Revocation &amp; fine</p><p>Effective Date: 8-14-25</p>
    <p>Respondent: Al Poe</p><p>Sanction: Fine</p><h2>BOARD OF VETERINARY MEDICINE</h2><p>Respondent: Vet One</p><p>Sanction: Revoked</p>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    rows = licence_records(text_lines(df, "page_id", "html"), "page_id").collect()
    assert [(r.name, r.board, r.case, r.sanction, r.date) for r in rows] == [("JANE DOE", "BOARD OF NURSING", "N-1", "Revocation & fine", "8-14-25")]


def test_graph_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "g.ndjson").write_text('{"kind":"entity","entity_id":"e1","canonical_name":"A"}\n\n{"kind":"new","x":1}\n{"kind":"identity_link_candidate","entity_a":"a","entity_b":"b","confidence":0.8,"signals":["s"]}\n')
    graph = read_graph(spark, str(folder))
    assert graph["entity"].first().resolution_confidence == 1.0 and graph["exclusion_event"].count() == 0
    write_graph(graph, str(tmp_path / "out"))
    assert read_graph(spark, str(tmp_path / "out"))["identity_link_candidate"].first().signals == ["s"]
    (folder / "bad.ndjson").write_text("{oops\n")
    with pytest.raises(Exception):
        read_graph(spark, str(folder))["entity"].collect()
    assert read_lines(spark, str(folder), "kind string", strict=False).where("kind is not null").count() == 3


def test_seal_and_tamper(spark, tmp_path):
    path, keys = str(tmp_path / "sealed"), {"ann": b"k"}
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, t string")
    seal(df, path, "ann", b"k", "first")
    manifest = seal(df.where("id = 1"), path, "ann", b"k", "second")
    assert manifest["version"] == 2 and load_verified(spark, path, keys).count() == 1
    with pytest.raises(ValueError, match="author"):
        load_verified(spark, path, {"bob": b"k"})
    with pytest.raises(ValueError, match="signature"):
        load_verified(spark, path, {"ann": b"other"})
    df.write.mode("overwrite").parquet(f"{path}/v2")
    with pytest.raises(ValueError, match="content"):
        load_verified(spark, path, keys)
    first = tmp_path / "sealed" / "_manifests" / "000001.json"
    first.write_text(first.read_text().replace("first", "FIRST"))
    with pytest.raises(ValueError):
        load_verified(spark, path, keys)


def test_stream(spark, tmp_path):
    inbox, kept, out, mark = (str(tmp_path / n) for n in ("inbox", "kept", "out", "mark"))
    schema = "run_no int, signal_id string, line_no long, reason_code string, confidence double"
    for run, ids in ((1, "ab"), (2, "bc"), (4, "c")):
        spark.createDataFrame([(run, i, 1, "r", 0.5) for i in ids], schema).write.mode("append").parquet(inbox)
        stream_changes(spark, inbox, schema, kept, out, mark).awaitTermination(120)
    got = sorted((r.from_run, r.to_run, r.signal_id, r.change_kind) for r in spark.read.parquet(out).collect())
    assert got == [(1, 2, "a", "removed"), (1, 2, "c", "added"), (2, 4, "b", "removed")]
