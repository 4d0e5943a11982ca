from veriplane.llm.addresses import Locale, locate, parse_line, parse_street, clean, same_places, zip_key

CLAIM = "claim_id long, address_1 string, address_2 string, city string, state string, zip_code string, place string, record string"
ENTITY = "entity_id string, practice_address string"


def pairs(spark, claims, lines=()):
    c = spark.createDataFrame([(*r, "p", "r") for r in claims], CLAIM)
    e = spark.createDataFrame(list(lines), ENTITY)
    return {(r.record_a, r.record_b) for r in same_places(c, e).collect()}


def test_parse():
    assert parse_street(clean("STE 14C, 51 NORHADLARDUN RD.")) == ("", "51", "", "NORHADLARDUN", "ROAD")
    assert parse_street(clean("Ashglebirfar Blvd E 35")) == ("", "35", "E", "ASHGLEBIRFAR", "BOULEVARD")
    assert parse_street(clean("C/O Bajobosu, 16 No. Fifth St. Apt 3B")) == ("", "16", "N", "5TH", "STREET")
    assert parse_street(clean("Kuni Professional Center, 4 5th Ln")) == ("", "4", "", "5TH", "LANE")
    assert parse_street(clean("P. O. Box 12"))[0] == parse_street(clean("POB 12"))[0] == "12"
    assert zip_key("1265") == "01265" and zip_key(" 01265-6047") == "01265" and zip_key("x") == ""
    assert parse_line("12 ELMHILL DR FL 82978")[0][:8] == ("", "12", "", "ELMHILL", "DRIVE", "", "FL", "82978")


def test_pairs_and_rules(spark):
    claims = [
        (1, "12 N. Elmhillwood Street", "Apt 3", "Mount Hope", "HI", "96701"),
        (2, "12 NORTH ELMHILLWOOD ST., # 9", None, "MT HOPE", "Hawaii", "96701-1234"),
        (3, "12 North Elmhilwood Str", None, None, None, " 96701"),  # a slip in the name
        (4, "12 N Elmhillwood", None, "MOUNT HOPE", "HI", None),  # neither type nor ZIP code
        (5, "12 Elmhillwood Street", None, "Mount Hope", "HI", "96701"),  # no direction
        (6, "12 N Elmhillwood Street", None, "Lake Despair", "HI", "96799"),  # another town
        (7, "14 N Elmhillwood Street", None, "Mount Hope", "HI", "96701"),
        (8, "PO Box 7", None, "Mount Hope", "HI", "96701"), (9, "P.O. BOX 7", None, "Mt. Hope", None, "96701"), (10, "Box 7", None, "Elsewhere", "CA", "90001"),
        (11, "N/A", "Apt 3", "Mount Hope", "HI", "96701"), (12, None, None, None, None, None), (13, "", "", "", "", ""), (1, "12 N. Elmhillwood Street", "Apt 3", "Mount Hope", "HI", "96701"),
        (None, "12 N. Elmhillwood Street", None, "Mount Hope", "HI", "96701"), (14, "é" * 20_000, None, None, None, None),
    ]
    lines = [("7000", "12 N ELMHILLWOOD ST MOUNT HOPE HI 96701"), ("7001", "POB 7 MOUNT HOPE HI 96701"), ("7002", None), ("7003", "UNKNOWN")]
    got = pairs(spark, claims, lines)
    building = ["c:1", "c:2", "c:3", "c:4", "e:7000"]
    box = ["c:8", "c:9", "e:7001"]
    assert got == {(a, b) for group in (building, box) for a in group for b in group if a < b}


def test_empty(spark):
    assert pairs(spark, []) == set()
    assert locate(spark.createDataFrame([], CLAIM), spark.createDataFrame([], ENTITY)).count() == 0


def test_types_tell_apart_and_a_missing_one_follows_the_usual(spark):
    claims = [(i, "5 Oakridgelane St", None, "Hope", "HI", "96701") for i in (1, 2, 3, 4)] + [(5, "5 Oakridgelane Ave", None, "Hope", "HI", "96701"), (6, "5 Oakridgelane", None, "Hope", "HI", "96701")]
    got = pairs(spark, claims)
    assert ("c:1", "c:6") in got and ("c:5", "c:6") not in got and ("c:1", "c:5") not in got


def test_one_line_readings():
    first = lambda text: [r[:8] for r in parse_line(text) if r[8]][0]
    assert first("26A 390 Penwilcar Ct Filudoke FL 04703") == ("", "390", "", "PENWILCAR", "COURT", "FILUDOKE", "FL", "04703")
    assert first("37 Jaturebke 706 Fort Hanho ID 69670") == ("", "37", "", "JATUREBKE", "", "FORT HANHO", "ID", "69670")
    assert first("Briho Bldg Turced Street 50 Jalronu CO 31540") == ("", "50", "", "TURCED", "STREET", "JALRONU", "CO", "31540")
    assert first("9B 1977 Arhad Ct Kuorn Professional Center Saint Hogu 61191") == ("", "1977", "", "ARHAD", "COURT", "SAINT HOGU", "", "61191")
    assert first("9TH PLACE 112 DOEXADDO CO 44618") == ("", "112", "", "9TH", "PLACE", "DOEXADDO", "CO", "44618")
    assert first("3341 NORTH ALDGLE ST CEMADRU 6285") == ("", "3341", "N", "ALDGLE", "STREET", "CEMADRU", "", "06285")
    assert parse_line(None) == parse_line("N/A") == parse_line("") == parse_line(" - ") == []


def test_street_names_that_hold_building_words():
    street = lambda text: parse_street(clean(text))[1:]
    first = lambda text: [r[:8] for r in parse_line(text) if r[8]][0]
    assert first("1 Medical Center Dr, Lebanon, NH 03756") == ("", "1", "", "MEDICAL CENTER", "DRIVE", "LEBANON", "NH", "03756")
    assert first("100 N Center St, Springfield, IL 62701") == first("100 North Center Street Springfield IL 62701") == ("", "100", "N", "CENTER", "STREET", "SPRINGFIELD", "IL", "62701")
    assert street("12 Old Mall Rd") == ("12", "", "OLD MALL", "ROAD") and street("200 Shopping Plaza Blvd") == street("200 Shopping Plz Boulevard") == ("200", "", "SHOPPING PLAZA", "BOULEVARD")
    assert street("3300 Health Center Blvd") == ("3300", "", "HEALTH CENTER", "BOULEVARD") and street("100 Town Center") == ("100", "", "TOWN CENTER", "")
    assert first("93 W Elm Blvd Rm 11D Kuorn Professional Center St Hogu TX 75001") == ("", "93", "W", "ELM", "BOULEVARD", "SAINT HOGU", "TX", "75001")
    assert street("7 Elm Ct, Kuorn Professional Center") == street("7 Elm Ct Kuorn Center St Hogu") == ("7", "", "ELM", "COURT")


def test_numbered_roads_ranges_and_fractions():
    street = lambda text: parse_street(clean(text))[1:]
    assert street("100 COUNTY ROAD 12") == street("100 Cty Rd #12") == street("100 CR 12") == ("100", "", "COUNTY_12", "ROAD") != street("100 County Road 14")
    assert street("100 Highway 61 S") == ("100", "S", "NO_61", "HIGHWAY") and street("5 US Hwy 1") == ("5", "", "US_1", "HIGHWAY") and street("5 State Route 9") == ("5", "", "STATE_9", "ROUTE")
    assert street("12-14 Main St") == street("12 Main Street")[:1] + street("12 - 14 MAIN ST")[1:] == ("12", "", "MAIN", "STREET")
    assert street("94-1021 Farrington Hwy") == ("94_1021", "", "FARRINGTON", "HIGHWAY") != street("1021 Farrington Hwy")
    assert street("12 1/2 Main St") == street("12½ Main St") == ("12_1/2", "", "MAIN", "STREET")
    assert street("4 Elm Trce") == ("4", "", "ELM", "TRACE") and street("4 Oak Hl Xing") == ("4", "", "OAK HILL", "CROSSING")


def test_places_of_such_addresses(spark):
    claims = [
        (1, "1 Medical Center Dr", None, "Lebanon", "NH", "03756"), (2, "1 Medical Center Drive, Suite 4", None, "Lebanon", "NH", "03756"),
        (3, "100 County Road 12", None, "Hope", "HI", "96701"), (4, "100 County Road 14", None, "Hope", "HI", "96701"), (5, "100 CR 12", None, "Hope", "HI", "96701"),
        (6, "9 Elm St", "PO Box 5", "Hope", "HI", "96701"), (7, "9 Elm Street", None, "Hope", "HI", "96701"), (8, "POB 5", None, "Hope", "HI", "96701"),
    ]
    assert pairs(spark, claims) == {("c:1", "c:2"), ("c:3", "c:5"), ("c:6", "c:7"), ("c:6", "c:8")}


def test_another_locale():
    """Streets whose type is told by other words."""
    islands = Locale(street_types={"CALLEJON": "CLJ", "PASEO": "PSO"}, building_words=["EDIFICIO"], building_uses=["MEDICO"], unit_words=["PISO", "APTO"], states={"PR": "PUERTO RICO"})
    assert parse_street(clean("12 Luna Pso, Piso 3"), islands) == parse_street(clean("12 LUNA PASEO APTO 9"), islands) == ("", "12", "", "LUNA", "PASEO")
    assert parse_line("12 Luna Clj, Ponce, Puerto Rico 00716", islands)[0][:8] == ("", "12", "", "LUNA", "CALLEJON", "PONCE", "PR", "00716")


def test_a_place_of_many_records(spark):
    """Slices of a hot place give every pair once."""
    got = pairs(spark, [(i, f"5 Elm St, Apt {i % 50}", None, "Hope", "HI", "96701") for i in range(2100)])
    assert len(got) == 2100 * 2099 // 2
