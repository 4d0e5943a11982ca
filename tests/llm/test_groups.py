import random

from veriplane.llm.groups import contract, link_groups


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_contract_matches_union_find(spark):
    rng = random.Random(3)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)]
    star = [("hub", f"s{i}") for i in range(200)] * 2
    rest = [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(70)]
    edges = chain + star + rest + [(b, a) for a, b in rest] + [("x", None), (None, "x"), ("x", "x"), ("", "é" * 50_000)]
    df = spark.createDataFrame([(*e, 1, 2) for e in edges], "a string, b string, u int, id int")
    got = {r.id: r.group_id for r in contract(df, "a", "b").collect()}
    assert got == union_find(edges)


def test_contract_empty(spark):
    none = contract(spark.createDataFrame([], "a string, b string"), "a", "b")
    assert none.columns == ["id", "group_id"] and none.count() == 0


def test_verdicts_and_thresholds(spark):
    cand = spark.createDataFrame(
        [("a", "b", 0.95), ("b", "a", None), ("c", "d", 0.95), ("e", "f", 0.2), ("g", "h", 0.90), ("i", "j", 0.89), ("k", "k", 1.0), ("a", "ghost", 1.0), ("l", "m", 0.99), (None, "a", 1.0)],
        "entity_a string, entity_b string, confidence double",
    )
    dec = spark.createDataFrame(
        [
            (1, "d", "c", "reject", "2023-01-02T00:00:00Z"), (2, "c", "d", "confirm", "2023-01-01T00:00:00Z"), (3, "f", "e", " Confirm ", "2023-01-01T00:00:00Z"),
            (4, "l", "m", "reject", "2023-01-01T00:00:00Z"), (5, "m", "l", "defer", "2023-02-01T00:00:00Z"), (6, "n", "o", "CONFIRM", "2023-01-01T00:00:00Z"), (7, "a", "b", None, None),
        ],
        "log_pos long, entity_a string, entity_b string, decision string, decided_at string",
    )
    ents = spark.createDataFrame([(c,) for c in "abcdefghijklmno"] + [("a",), (None,)], "entity_id string")
    got = {r.entity_id: r.group_id for r in link_groups(cand, dec, ents).collect()}
    assert got == {"a": "a", "b": "a", "e": "e", "f": "e", "g": "g", "h": "g", "l": "l", "m": "l", "n": "n", "o": "n"}
