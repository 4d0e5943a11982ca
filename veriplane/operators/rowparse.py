"""Rows that fail to parse: one anchored pattern per layout, then field prefixes for the failures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriplane.functions.codes import npi_check

# Every group is possessive: the matcher loops instead of recursing, so neither
# backtracking nor stack depth grows with the length of a line.
FIELD = r'(?:"(?:[^"]++|"")*+"|[^",\r\n]*+)'
ROW = rf"\A{FIELD}(?:,{FIELD})*+\z"


def _cell(value: str) -> str:
    return rf'(?:"\s*+(?:{value})\s*+"|[^\S\r\n]*+(?:{value})[^\S\r\n]*+)'


_BLANK = r'(?:"\s*+"|[^\S\r\n]*+)'
_YMD = (
    r"(?!0000)(?:[0-9]{4}(?:(?:0[13578]|1[02])(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)(?:0[1-9]|[12][0-9]|30)|02(?:0[1-9]|1[0-9]|2[0-8]))"
    r"|(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)0229)"
)
_PERCENT = r"(?=\.?[0-9])0*+(?:100(?:\.0*)?|[0-9]{0,2}(?:\.[0-9]*)?)"

#: Field kinds: the pattern of a good cell (quotes included) and the reason of a bad one.
KINDS = {
    "any": (FIELD, "quoting"),
    "npi": (_cell(r"[0-9]{10}"), "bad_npi"),
    "npi_or_none": (rf"(?:{_cell(r'[0-9]{10}')}|{_BLANK})", "bad_npi"),
    "ymd": (rf'(?:"(?:{_YMD}|00000000)"|(?:{_YMD}|00000000)|{_BLANK})', "bad_date"),
    "percent": (rf"(?:{_cell(_PERCENT)}|{_BLANK})", "bad_pct"),
}


@dataclass(frozen=True)
class Layout:
    """A headerless comma-separated layout: its width and the kinds of its checked fields (0-based)."""

    name: str
    width: int
    kinds: dict[int, str] = field(default_factory=dict)

    def kind(self, place: int) -> str:
        return self.kinds.get(place, "any")

    def cells(self) -> list[str]:
        return [KINDS[self.kind(i)][0] for i in range(self.width)]

    def whole(self) -> str:
        """Anchored pattern of a whole good row."""
        return r"\A" + ",".join(self.cells()) + r"\z"

    def prefix(self) -> str:
        """Pattern of the longest run of good leading fields, each with its separator.

        One nested pattern stands for the prefixes of 1, 2, ... fields:
        ``\\A(?:f1(?:,|\\z)(?:f2(?:,|\\z)(?: ... )?)?)?``.
        """
        out = ""
        for cell in reversed(self.cells()):
            out = rf"(?:{cell}(?:,|\z){out})?+"
        return r"\A" + out


def _separators(text: Column) -> Column:
    """Number of separators outside quotes in a well-formed run of fields."""
    return F.length(F.regexp_replace(text, FIELD, ""))


def _fields(line: Column) -> Column:
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f",({FIELD})"), F.lit(1))
    inner = lambda x: F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda x: F.when(F.startswith(x, F.lit('"')), inner(x)).otherwise(x))


def check_rows(rows: DataFrame, line: str, layout: str, layouts: list[Layout]) -> DataFrame:
    """``rows`` with columns ``reason`` (null for a good row), ``broken_field`` and ``fields``.

    A line is compared with the anchored pattern of its layout. A line that fails is
    matched against the pattern of its leading fields, which gives the number of the
    first broken field (1-based) and, by that field's kind, the reason. The first
    that applies: ``quoting`` (no sequence of RFC 4180 fields), ``column_count``,
    then the reason of the first bad checked field. Check digits are no regular
    language in practice; they are computed for rows whose pattern matched.

    Defined cases: one trailing carriage return or line end is ignored; a null line
    and an unknown or null layout have reason ``column_count``; an empty line is one
    empty field. ``fields`` is the array of unquoted values of a good row, null
    otherwise. Repeated rows are judged alike, each for itself. Columns of ``rows``
    named like the three results are replaced.

    Scale: a map without any shuffle, in the JVM, linear in the text.
    """
    rows = rows.drop(*[c for c in ("reason", "broken_field", "fields") if c in rows.columns])
    for spec in layouts:
        numbers = [i for i, k in spec.kinds.items() if k.startswith("npi")]
        assert len(numbers) < 2 and numbers[:1] == sorted(spec.kinds)[: len(numbers)], "a layout has one number at most, before its other checked fields"

    def by_layout(value, default: Column) -> Column:
        out = default
        for spec in layouts:
            out = F.when(F.col("_kind") == spec.name, value(spec)).otherwise(out)
        return out

    number = lambda spec: next((i for i, k in spec.kinds.items() if k.startswith("npi")), None)
    no, none, text = F.lit(False), F.lit(None).cast("int"), F.col("_text")
    # Separate projections: each pattern and the check digit appear once in the plan.
    judged = rows.withColumns({"_text": F.regexp_replace(F.col(line), r"\r?\n?\z", ""), "_kind": F.lower(F.trim(F.col(layout)))})
    judged = judged.withColumns(
        {
            "_whole": F.coalesce(by_layout(lambda s: text.rlike(s.whole()), no), no),
            "_number": by_layout(
                lambda s: F.lit(None).cast("string") if number(s) is None
                else F.regexp_extract(text, rf'\A(?:{FIELD},){{{number(s)}}}"?\s*+([0-9]{{10}})\s*+"?(?:,|\z)', 1),
                F.lit(None).cast("string"),
            ),
            "_width": by_layout(lambda s: F.lit(s.width), none),
        }
    )
    free = by_layout(lambda s: F.col("_number").isin("", "0000000000") if s.kinds.get(number(s)) == "npi_or_none" else no, no)
    judged = judged.withColumns({"_sound": F.col("_number").isNull() | free | npi_check(F.col("_number"))})
    fails = ~(F.col("_whole") & F.col("_sound"))
    judged = judged.withColumns(
        {
            "_row": F.when(fails, F.coalesce(text.rlike(ROW), no)),
            "_count": F.when(fails, _separators(text) + 1),
            "_ahead": F.when(fails, by_layout(lambda s: F.regexp_extract(text, s.prefix(), 0), F.lit(None).cast("string"))),
            "_plain": F.when(fails, F.regexp_extract(text, rf"\A(?:{FIELD},)*+", 0)),
        }
    )
    judged = judged.withColumns({"_first": _separators(F.col("_ahead")) + 1, "_cut": _separators(F.col("_plain")) + 1})
    place = by_layout(lambda s: none if number(s) is None else F.lit(number(s) + 1), none)
    # a wrong check digit breaks the number's field even where its digits fit the pattern
    judged = judged.withColumns({"_first": F.when(~F.col("_sound") & (F.col("_number") != ""), F.least(place, "_first")).otherwise(F.col("_first"))})
    reasons = by_layout(lambda s: F.element_at(F.array(*[F.lit(KINDS[s.kind(i)][1]) for i in range(s.width)]), F.least("_first", F.lit(s.width))), F.lit(None).cast("string"))
    judged = judged.withColumns(
        {
            "reason": F.when(text.isNull() | F.col("_width").isNull(), F.lit("column_count"))
            .when(F.col("_row").isNull(), F.lit(None).cast("string"))
            .when(~F.col("_row"), F.lit("quoting"))
            .when(F.col("_count") != F.col("_width"), F.lit("column_count"))
            .otherwise(reasons),
            "broken_field": F.when(text.isNull() | F.col("_width").isNull() | F.col("_row").isNull(), none)
            .when(~F.col("_row"), F.col("_cut"))
            .when(F.col("_count") != F.col("_width"), F.least("_count", "_width") + 1)
            .otherwise(F.col("_first")),
        }
    )
    fields = F.when(F.col("reason").isNull(), _fields(text))
    # inline() keeps a filter on the results from being pushed below, which would copy the whole chain into it
    return judged.select(*rows.columns, F.inline(F.array(F.struct("reason", "broken_field", fields.alias("fields")))))


def split_rows(rows: DataFrame, line: str, layout: str, layouts: list[Layout]) -> tuple[DataFrame, DataFrame]:
    """The good rows with their ``fields``, and the bad ones with ``reason`` and ``broken_field``."""
    judged = check_rows(rows, line, layout, layouts)
    return judged.where("reason is null").drop("reason", "broken_field"), judged.where("reason is not null").drop("fields")


LEIE = Layout("leie", 18, {7: "npi_or_none", 14: "ymd", 15: "ymd"})
REGISTRY = Layout("registry", 51, {0: "npi"})
OWNERS = Layout("owners", 40, {19: "percent"})
