import random
import re
from datetime import date

import pytest

from veriplane.operators.rowparse import LEIE, OWNERS, REGISTRY, check_rows, split_rows

LAYOUTS = [LEIE, REGISTRY, OWNERS]
GOOD = "7000000000"


def luhn(n):
    total = 24
    for i, c in enumerate(n):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


NPI = next(str(n) for n in range(7000000000, 7000000010) if luhn(str(n)))


def fields_of(line):
    field, at, out = re.compile(r'"(?:[^"]|"")*"|[^",\r\n]*'), 0, []
    while True:
        m = field.match(line, at)
        out.append(m.group()[1:-1].replace('""', '"') if m.group()[:1] == '"' else m.group())
        at = m.end()
        if at == len(line):
            return out
        if line[at] != ",":
            return None
        at += 1


def expected(layout, line):
    if line is None:
        return "column_count"
    line = re.sub(r"\r?\n?\Z", "", line)
    f = fields_of(line)
    width = {"leie": 18, "registry": 51, "owners": 40}[layout]
    if f is None:
        return "quoting"
    if len(f) != width:
        return "column_count"
    ok = lambda v: bool(re.fullmatch("[0-9]{10}", v)) and luhn(v)
    if layout == "leie":
        v = f[7].strip()
        if v not in ("", "0000000000") and not ok(v):
            return "bad_npi"
        for d in (f[14], f[15]):
            if d.strip() and d != "00000000":
                try:
                    assert re.fullmatch("[0-9]{8}", d)
                    date(int(d[:4]), int(d[4:6]), int(d[6:]))
                except (AssertionError, ValueError):
                    return "bad_date"
    if layout == "registry" and not ok(f[0].strip()):
        return "bad_npi"
    if layout == "owners":
        v = f[19].strip()
        if v and not (re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", v) and float(v) <= 100):
            return "bad_pct"
    return None


def line(layout, **at):
    width = {"leie": 18, "registry": 51, "owners": 40}[layout]
    cells = [""] * width
    cells[{"leie": 7, "registry": 0, "owners": 1}[layout]] = NPI
    for k, v in at.items():
        cells[int(k[1:])] = v
    return ",".join(cells)


def cases():
    out = [("leie", None), ("leie", ""), ("leie", line("leie") + "\r"), ("leie", line("leie", c0='"A, ""B"" C"')), ("leie", line("leie", c0='"open'))]
    out += [("leie", line("leie", c0='x"y')), ("leie", line("leie") + ","), ("leie", line("leie", c0='"a\nb"')), ("leie", line("leie", c0="a\nb"))]
    out += [("leie", line("leie", c7=v)) for v in ("", " ", "0000000000", f" {NPI} ", f'"{NPI}"', "123", "1234567890", "0")]
    out += [("leie", line("leie", c14=v)) for v in ("20240229", "20230229", "00000000", " ", "19000229", "20000229", "2024-01-01", "00010101", "00000101", " 20200101")]
    out += [("leie", line("leie", c7="12", c15="bad")), ("leie", line("leie", c7="1234567890", c15="bad"))]
    out += [("registry", line("registry", c0=v)) for v in ("", "0000000000", NPI, f"{NPI} ", f'"{NPI}"', "x")]
    out += [("owners", line("owners", c19=v)) for v in ("", " 25 ", "100", "100.0", "100.01", ".5", "5.", ".", "007.5", "-1", "1e1", "NaN", '"97.5"', "1000", "0")]
    out.append(("owners", line("owners", c2='"' + 'ab""' * 50_000 + '"')))
    rng = random.Random(5)
    for _ in range(300):
        layout = rng.choice(["leie", "registry", "owners"])
        text = list(line(layout, c3="abc"))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randint(0, 1)] = rng.choice(['"', ",", "a", '""', "\n", ""])
        out.append((layout, "".join(text)))
    return out


def test_reasons_match_brute_force(spark):
    rows = [(i, layout, text, "clash") for i, (layout, text) in enumerate(cases())]
    df = spark.createDataFrame(rows, "record_id long, layout string, raw_line string, reason string")
    got = {r.record_id: r.reason for r in check_rows(df, "raw_line", "layout", LAYOUTS).collect()}
    wrong = [(r[1], r[2] and r[2][:80], got[r[0]], expected(r[1], r[2])) for r in rows if got[r[0]] != expected(r[1], r[2])]
    assert not wrong, wrong[:5]


def test_first_broken_field_and_values(spark):
    df = spark.createDataFrame(
        [(1, "leie", line("leie", c14="bad")), (2, "leie", line("leie", c3='"a""b"')), (3, "other", "x"), (4, None, "x"), (5, "leie", line("leie", c2='a"b'))],
        "record_id long, layout string, raw_line string",
    )
    good, bad = split_rows(df, "raw_line", "layout", LAYOUTS)
    assert [(r.record_id, r.fields[3], len(r.fields)) for r in good.collect()] == [(2, 'a"b', 18)]
    assert sorted((r.record_id, r.reason, r.broken_field) for r in bad.collect()) == [(1, "bad_date", 15), (3, "column_count", None), (4, "column_count", None), (5, "quoting", 3)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "record_id long, layout string, raw_line string")
    assert check_rows(empty, "raw_line", "layout", LAYOUTS).count() == 0


@pytest.mark.parametrize("n", [GOOD])
def test_luhn_helper(n):
    assert luhn(NPI) and len(n) == 10
