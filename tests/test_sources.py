import json
from types import SimpleNamespace
from urllib.error import HTTPError, URLError

import pytest
from pyspark.sql import functions as F

from veriplane import runtime
from veriplane.functions.keys import fnv1a
from veriplane.operators.sealing import changed_files, check_bounds, file_manifest, load_verified, new_key, record_verdict, seal, seal_report, unsealed_evidence
from veriplane.sources.fetch import Fetcher, absolute, catalogue_files, links, remaining, snapshot, source_table
from veriplane.sources.lines import read_exclusions, read_graph, read_log, read_run, run_name, write_run
from veriplane.sources.lists import exclusion_list, first_rows, numbered, ownership_files
from veriplane.sources.pages import licence_exclusions, licence_records, text_lines

HEADER = "LASTNAME,FIRSTNAME,MIDNAME,BUSNAME,GENERAL,SPECIALTY,UPIN,NPI,DOB,ADDRESS,CITY,STATE,ZIP,EXCLTYPE,EXCLDATE,REINDATE,WAIVERDATE,WAIVERSTATE"


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *a: None)
    session = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=conf)
    with pytest.raises(RuntimeError, match="checkpoint"):
        runtime.shared_root(session("spark://host:7077"))
    assert runtime.shared_root(session("local[4]")).startswith("file://")


def test_dropped_tables_are_gone(spark):
    table = runtime.stored(spark.range(3), "probe")
    assert runtime.exists(spark, table.stored_path)
    runtime.drop_stored(table)
    assert not runtime.exists(spark, table.stored_path)


def test_ordinals_of_split_files(spark, tmp_path):
    """Files are cut into small blocks; every row has its place in its own file."""
    for name, n in (("a", 900), ("b", 350)):
        (tmp_path / f"{name}.csv").write_text("v\n" + "".join(f"{i},{'x' * (i % 37)}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = numbered(spark.read.schema("v long, w string").option("header", True).csv(str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 1250 and all(r.v == r.ordinal for r in rows) and len({r.file for r in rows}) == 2


def test_lists_of_several_files(spark, tmp_path):
    for n in "12":
        (tmp_path / f"s{n}.csv").write_text(f"{HEADER}\nDOE,JANE,,,,,,,,,,HI,,,20200101,,,\n,,,,,,,,,,,,,,,,,\nROE,AL,{n},,,,,,,,,CA,,,,,,\n")
    rows = exclusion_list(spark, [str(tmp_path / "s1.csv"), str(tmp_path / "s2.csv")], "sup", file_manifest(spark, str(tmp_path))).collect()
    assert sorted((r.person_or_entity_name, r.source_record_id) for r in rows) == [("DOE JANE", "0"), ("DOE JANE", "0"), ("ROE AL 1", "2"), ("ROE AL 2", "2")]
    assert len({r.source_snapshot_hash for r in rows}) == 2 and all(len(r.source_snapshot_hash) == 64 for r in rows)


def test_ownership_files_and_limits(spark, tmp_path):
    line = ",".join(["e", "p", "org", "op", "O", "", "", "", "", "", "", "", "{}"] + [""] * 27)
    for kind in ("snf", "hha"):
        (tmp_path / f"{kind}.csv").write_text("\n".join([",".join(f"c{i}" for i in range(40)), *[line.format(f"{kind} {i}") for i in range(5)]]) + "\n")
    rows = ownership_files(spark, {k: str(tmp_path / f"{k}.csv") for k in ("snf", "hha")}, 40, "own")
    assert rows.count() == 10 and first_rows(rows, ["provider_type"], ["owner_name"], 2).count() == 4
    assert {r.provider_type for r in rows.collect()} == {"hha", "snf"}


def test_normalized_lines(spark, tmp_path):
    (tmp_path / "leie_normalized.ndjson").write_text('{"person_or_entity_name":"A","source_id":"leie"}\n{"person_or_entity_name":" ","source_id":"leie"}\n')
    (tmp_path / "sam_exclusions.ndjson").write_text('{"person_or_entity_name":"B","source_id":"sam","indefinite_exclusion":true,"new":1}\n')
    rows = read_exclusions(spark, str(tmp_path)).collect()
    assert sorted((r.person_or_entity_name, r.indefinite_exclusion) for r in rows) == [("A", False), ("B", True)]
    with pytest.raises(FileNotFoundError):
        read_exclusions(spark, str(tmp_path / "none"))
    assert read_log(spark, str(tmp_path / "none"), "a string").count() == 0
    (tmp_path / "run.ndjson").write_text('{"signal_id":"s","confidence":0.5}\n{"signal_id":""}\n{"x":1}\n')
    assert read_run(spark, str(tmp_path / "run.ndjson"), "signal_id string, confidence double").count() == 1


def test_a_body_that_does_not_fit_its_kind_is_an_error(spark, tmp_path):
    (tmp_path / "g.ndjson").write_text('{"kind":"entity","entity_id":"e1","npis":"not a list"}\n')
    with pytest.raises(Exception):
        read_graph(spark, str(tmp_path))["entity"].collect()


def test_runs_are_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i}", i / 10) for i in range(9)], "signal_id string, confidence double").repartition(3)
    write_run("signal", rows, str(tmp_path / "run"), {"n": F.count("*"), "n_high": F.count_if(F.col("confidence") >= 0.7)})
    lines = [json.loads(x) for part in sorted((tmp_path / "run").glob("part-*")) for x in part.read_text().splitlines()]
    assert lines[0] == {"kind": "meta", "n": 9, "n_high": 2} and len(lines) == 10
    assert run_name("signals", "HI", 17) == "signals_hi_17" and run_name("signals", None, 17) == "signals_all_17"


def test_licence_rows_in_the_common_schema(spark):
    page = "<h2>BOARD OF NURSING</h2><p>Respondent: Jane Doe fka J. Roe</p><p>Sanction: {}</p><p>Effective Date: {}</p>"
    df = spark.createDataFrame([(1, page.format("Revocation", "8-14-25")), (2, page.format("Suspension", "08/14/2025")), (3, page.format("Suspended", "soon"))], "page_id long, html string")
    got = licence_exclusions(licence_records(text_lines(df, "page_id", "html"), "page_id"), "page_id", "hawaii_dcca", "HI").collect()
    assert sorted((r.person_or_entity_name, r.exclusion_date or "", r.indefinite_exclusion) for r in got) == [("JANE DOE", "", False), ("JANE DOE", "2025-08-14T00:00:00+00:00", True)]


def test_fetching(tmp_path):
    slept, calls = [], []

    def get(url):
        calls.append(url)
        if url == "gone":
            raise HTTPError(url, 404, "no", None, None)
        if url == "busy" and calls.count("busy") < 3:
            raise HTTPError(url, 503, "wait", None, None)
        if url.startswith("bad"):
            raise URLError("down")
        return url.encode()

    make = lambda **k: Fetcher(get=get, sleep=slept.append, clock=lambda: 0.0, **k)
    assert make().one("busy").data == b"busy" and calls == ["busy"] * 3 and any(s >= 2 for s in slept)
    assert "404" in make().one("gone").error and calls.count("gone") == 1
    log = tmp_path / "done.ndjson"
    log.write_text('{"url": "a", "sha256": "x"}\n{"url": "b", "sh')
    log.write_text(log.read_text() + "\n")
    out = make(retries=0, failures_allowed=2).all(["a", "b", "bad1", "bad2", "c"], str(log))
    assert [(o.url, bool(o.error)) for o in out] == [("b", False), ("bad1", True), ("bad2", True), ("c", True)] and "stopped" in out[-1].error
    assert [o.url for o in make(retries=0).all(["a", "b", "c"], str(log))] == ["c"]
    place, digest = snapshot(make(), "http://x/list.csv?y=1", str(tmp_path / "raw"))
    n = len(calls)
    assert place.name == "list.csv" and snapshot(make(), "http://x/list.csv?y=1", str(tmp_path / "raw"))[1] == digest and len(calls) == n
    with pytest.raises(OSError):
        snapshot(make(retries=0), "bad", str(tmp_path / "raw"))


def test_discovery(spark):
    pages = spark.createDataFrame([("http://h/x/", """<a href="f_2.zip">b</a><A HREF='http://o/f_1.zip'>a</A><a href=other.csv>c</a>"""), ("http://e/", None)], "base string, html string")
    assert [absolute(r.base, r.url) for r in links(pages, "base", "html", r"(?i)\.zip$").orderBy("pos").collect()] == ["http://h/x/f_2.zip", "http://o/f_1.zip"]
    text = json.dumps({"dataset": [{"title": " Owners ", "distribution": [{"downloadURL": "u.json"}, {"downloadURL": "U.CSV"}, {"downloadURL": "v.csv"}]}, {"title": "none", "distribution": []}]})
    assert [tuple(r) for r in catalogue_files(spark.createDataFrame([(text,)], "t string"), "t").collect()] == [("owners", "U.CSV")]
    wanted, done = spark.createDataFrame([("a",), ("b",)], "u string"), spark.createDataFrame([("a",), ("a",)], "u string")
    assert [r.u for r in remaining(wanted, done, "u").collect()] == ["b"]
    assert source_table(spark).where("tier = 'exclusions'").count() == 3


def test_sealed_logs_and_files(spark, tmp_path):
    keys: dict = {}
    key = new_key(keys, "ann")
    with pytest.raises(ValueError, match="already"):
        new_key(keys, "ann")
    path, words = str(tmp_path / "log"), {"decision": {"confirm", "reject"}}
    for decision in ("confirm", "reject"):
        record_verdict(spark, path, {"entity_a": "a", "entity_b": "b", "decision": decision}, words, "ann", key, keys)
    log = load_verified(spark, path, keys)
    assert [(r.log_pos, r.decision) for r in log.orderBy("log_pos").collect()] == [(1, "confirm"), (2, "reject")]
    for bad in ({"entity_a": " ", "decision": "confirm"}, {"entity_a": "a", "decision": "maybe"}):
        with pytest.raises(ValueError):
            record_verdict(spark, path, bad, words, "ann", key, keys)
    assert [ok for _, ok, _ in seal_report(spark, path, keys)] == [True, True]
    assert not any(ok for _, ok, _ in seal_report(spark, path, {"bob": b"x"}))
    manifest = seal(spark.range(1), str(tmp_path / "t"), "ann", key, "m")
    assert check_bounds(json.dumps(manifest)) == manifest
    for text in ("x" * 70_000, "{}", json.dumps(manifest | {"version": "1"}), json.dumps([1]), "{"):
        with pytest.raises(ValueError):
            check_bounds(text)
    raw = tmp_path / "raw"
    raw.mkdir()
    for n in "abc":
        (raw / n).write_text(n)
    sealed = spark.createDataFrame(file_manifest(spark, str(raw)).collect())
    assert changed_files(file_manifest(spark, str(raw)), sealed).count() == 0
    (raw / "a").write_text("A")
    (raw / "b").unlink()
    (raw / "d").write_text("d")
    assert sorted((r.path[-1], r.problem) for r in changed_files(file_manifest(spark, str(raw)), sealed).collect()) == [("a", "changed"), ("b", "missing"), ("d", "unknown")]
    evidence = spark.createDataFrame([(1, sealed.first().sha256), (2, "0" * 64), (3, None)], "id int, source_snapshot_hash string")
    assert {r.id for r in unsealed_evidence(evidence, sealed).collect()} == {2, 3}


def test_fnv(spark):
    got = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "t string").select(fnv1a(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968, None]
