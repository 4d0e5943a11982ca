import itertools
import random

import numpy as np

from veriplane.llm.crossmatch import assign, best_assignment, clean, match_parties, neighbours, organization, person, slip, sparse_assignment, usual_readings

OWNER = "owner_pac_id string, owner_name string, owner_state string, owner_type string, name string, form string"
EXCL = "row_id long, person_or_entity_name string, state string, npi string, name string, party string"


def matched(spark, owners, excluded):
    o = spark.createDataFrame([(*r, "x", "y") for r in owners], OWNER)
    e = spark.createDataFrame([(*r, "x", "y") for r in excluded], EXCL)
    return {(r.owner_pac_id, r.row_id) for r in match_parties(o, e).collect()}


def test_parsing():
    assert person(clean("O'Brien-Smith, ANN MARIE, M.D."))[0][:3] == ("OBRIENSMITH", "ANN", "MARIE")
    assert ("DOE", "ANN", "B", False) in person(clean("Ann B Doe aka Roe"))
    assert organization(clean("THE Golden Spring Cuingudu Med Assoc, L.L.C.")) == (["GOLDEN", "SPRING", "CUINGUDU"], "ASSOCIATES MEDICAL")
    assert slip("MARTHA", "MARHTA") and slip("ABCD", "ABD") and slip("ABCD", "ABXD") and not slip("ABCD", "AXYD")


def test_usual_readings():
    spellings = [("DOE, ANN MARIE", "I", "HI", 3), ("DOE, ANN", "I", "HI", 9), ("DEO, ANN", "I", "CA", 2), ("DOE, A", "I", None, 5), ("UNKNOWN", "O", "TX", 1)]
    assert usual_readings(spellings) == [(False, "", "DOE", "ANN", "MARIE", "", "HI")]
    assert [r[2:4] for r in usual_readings([("ANN DOE", None, None, 1)])] == [("ANN", "DOE"), ("DOE", "ANN")]
    assert usual_readings([("ACME HOSPICE LLC", None, None, 1), ("ACME HOME HOSPICE", "O", "NY", 1)]) == [(True, "ACME", "", "", "", "HOSPICE", "NY")]
    assert usual_readings([]) == usual_readings([("NONE", "O", None, 4), ("", "I", None, 1)]) == []


def test_people_and_organizations(spark):
    owners = [
        ("1", "VELNOGOCOR, SILFIL ANVIN", "HI", "I"), ("1", "VELNOGOCOR, SILFIL A", "HI", "I"), ("2", "RAFALAVANE, NELUN", "TX", "I"), ("3", "DESNUJESAN SUMMIT HOLLOW PHARMACY INC", "GU", "O"),
        ("4", "KELTAUFEN, IMDOSA PATUL", "NY", "I"), ("5", "TODREDREO, GATRENA", "OR", "I"), (None, "RAFALAVANE, NELUN", "TX", "I"), ("", "X", None, None), ("6", None, None, None), ("7", "z" * 50_000, None, None), ("8", "UNKNOWN", None, "I"),
    ]
    excluded = [
        (1, "Silfil Anvin Velnogocor", "CA", None),  # moved, but the full middle name agrees
        (2, "VELNOGOCRO SILFIL A", "HI", ""), (3, "NELUN RAFALAVANE", " tx ", None), (4, "RAFALAVANE, NELUN", "CA", None),
        (5, "SUMMIT HOLLOW DESNUJESAN PHARMACY, INC.", None, None), (6, "DESNUJESAN SUMMIT HOLLOW HOSPICE INC", "GU", None),
        (7, "KELTAUFEN, IMDOSA REMFIR", "NY", None), (8, "Gatrena Todredreo", "Oregon", "1234567893"), (9, "TODREDREO GATRENA", None, "1234567893"),
        (10, None, "HI", None), (None, "NELUN RAFALAVANE", "TX", None), (3, "NELUN RAFALAVANE", " tx ", None), (11, "", None, None), (12, "é", None, None),
    ]
    assert matched(spark, owners, excluded) == {("1", 1), ("1", 2), ("2", 3), ("3", 5), ("5", 8), ("5", 9)}


def test_hot_names_lose_nothing(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ABCDEF") for _ in range(n))

    def slipped(w):
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("AXZ") + w[i:], w[:i] + "Q" + w[i + 1 :]])
        return w

    firsts, leads = ({word(rng.randint(4, 9)) for _ in range(120)} for _ in range(2))
    mine = [("HOT", f) for f in firsts] + [(x, "ANNA") for x in leads] + [("HOT", "J"), ("COOL", "PATRICIA")]
    theirs = [("HOT", slipped(f)) for f in firsts] + [(slipped(x), "ANNA") for x in leads] + [("HOT", f[0]) for f in firsts] + [("HOT", "JOHN"), ("COOL", "PATRIZIA"), ("COOL", "P")]
    sides = {}
    for who, names in enumerate((mine, theirs)):
        for n in names:
            sides.setdefault(n, [False, False])[who] = True
    near = neighbours(spark.createDataFrame([(False, *n, *f) for n, f in sides.items()], "org boolean, lead string, second string, is_o boolean, is_x boolean"), 6)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    alike = lambda a, b: a == b or (max(len(a), len(b)) >= 5 and edits(a, b) <= 2)
    initial = lambda a, b: min(len(a), len(b)) == 1 and a[0] == b[0]
    want = {(a, b) for a in mine for b in theirs if (a[0] == b[0] and (alike(a[1], b[1]) or initial(a[1], b[1]))) or (a[1] == b[1] and alike(a[0], b[0]))}
    got = [((r.lead, r.second), (r.x_lead, r.x_second)) for r in near.collect()]
    assert set(got) == want and len(got) == len(want)


def test_slips_and_initials_among_ten_thousand_neighbours(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOP") for _ in range(n))
    firsts = sorted({word(rng.randint(5, 9)) for _ in range(10_000)})
    rows = {("SMITH", f): [i % 2 == 0, i % 2 == 1] for i, f in enumerate(firsts)}
    want = set()
    for n, f in enumerate(firsts[:120:2]):  # even ones are owners'
        i = rng.randrange(len(f))
        other = [("SMITH", f[:i] + "Z" + f[i + 1 :]), ("SMITH", f[:i] + "ZZ" + f[i:]), ("SMITH", f[0]), ("SMYTH", f)][n % 4]
        rows.setdefault(other, [False, True])[1] = True
        want.add((("SMITH", f), other))
    rows |= {("SMITH", "QQQQQZ"): [True, False], ("SMYTHE", "QQQQQY"): [False, True]}  # slips in both parts are too far
    names = spark.createDataFrame([(False, *k, *v) for k, v in rows.items()], "org boolean, lead string, second string, is_o boolean, is_x boolean")
    got = {((r.lead, r.second), (r.x_lead, r.x_second)) for r in neighbours(names, 64).collect()}
    assert want <= got and (("SMITH", "QQQQQZ"), ("SMYTHE", "QQQQQY")) not in got


def test_empty(spark):
    assert matched(spark, [], []) == set()
    assert matched(spark, [("1", "A B", None, "I")], []) == set()


def test_best_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for n, m in itertools.product((1, 2, 3, 4), (1, 2, 3, 4)):
        for _ in range(15):
            gain = rng.random((n, m)) * (rng.random((n, m)) > 0.3)
            got = best_assignment(gain)
            assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
            wide = np.hstack([gain, np.zeros((n, n))])
            best = max(sum(wide[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m + n), n))
            assert abs(sum(gain[i, j] for i, j in got) - best) < 1e-9


def test_assign_small_and_large_components(spark):
    rng = random.Random(4)
    edges = [(f"o{i}", f"p{j}", round(rng.random(), 3)) for i in range(6) for j in range(6)] + [("lone", "solo", 0.5)]
    df = spark.createDataFrame(edges, "owner string, party string, confidence double")
    exact = assign(df).collect()
    rough = assign(df, largest=3).collect()
    for rows in (exact, rough):
        assert len({r.owner for r in rows}) == len(rows) == len({r.party for r in rows}) == 7
    assert 0.5 * sum(r.confidence for r in exact) <= sum(r.confidence for r in rough) <= sum(r.confidence for r in exact) + 1e-9


def test_large_components_are_solved_exactly(spark):
    rng = np.random.default_rng(6)
    for _ in range(60):
        n, m = rng.integers(1, 12, 2)
        gain = rng.integers(1, 6, (n, m)) / 5 * (rng.random((n, m)) > 0.5)
        i, j = np.nonzero(gain)
        got = sparse_assignment(i.tolist(), j.tolist(), gain[i, j].tolist())
        assert len({a for a, _, _ in got}) == len(got) == len({b for _, b, _ in got}) and all(gain[a, b] == g for a, b, g in got)
        assert abs(sum(g for _, _, g in got) - sum(gain[a, b] for a, b in best_assignment(gain))) < 1e-9
    # a chain in which the mutually best pairs come to 0.9 * 250 of the best total 0.8 * 500
    edges = [e for k in range(250) for e in ((f"a{k}", f"q{k}", 0.8), (f"b{k}", f"q{k}", 0.9), (f"b{k}", f"r{k}", 0.8), (f"b{k}", f"q{(k + 1) % 250}", 0.01))]
    rows = assign(spark.createDataFrame(edges, "owner string, party string, confidence double")).collect()
    assert len({r.owner for r in rows}) == len(rows) == len({r.party for r in rows}) == 500
    assert abs(sum(r.confidence for r in rows) - 400) < 1e-6
