"""Identifiers and codes: NPI check digit, US state codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# USPS codes of the states, the federal district and the territories.
STATE_NAMES = {
    "AL": "ALABAMA", "AK": "ALASKA", "AZ": "ARIZONA", "AR": "ARKANSAS", "CA": "CALIFORNIA", "CO": "COLORADO",
    "CT": "CONNECTICUT", "DE": "DELAWARE", "DC": "DISTRICT OF COLUMBIA", "FL": "FLORIDA", "GA": "GEORGIA",
    "HI": "HAWAII", "ID": "IDAHO", "IL": "ILLINOIS", "IN": "INDIANA", "IA": "IOWA", "KS": "KANSAS",
    "KY": "KENTUCKY", "LA": "LOUISIANA", "ME": "MAINE", "MD": "MARYLAND", "MA": "MASSACHUSETTS",
    "MI": "MICHIGAN", "MN": "MINNESOTA", "MS": "MISSISSIPPI", "MO": "MISSOURI", "MT": "MONTANA",
    "NE": "NEBRASKA", "NV": "NEVADA", "NH": "NEW HAMPSHIRE", "NJ": "NEW JERSEY", "NM": "NEW MEXICO",
    "NY": "NEW YORK", "NC": "NORTH CAROLINA", "ND": "NORTH DAKOTA", "OH": "OHIO", "OK": "OKLAHOMA",
    "OR": "OREGON", "PA": "PENNSYLVANIA", "RI": "RHODE ISLAND", "SC": "SOUTH CAROLINA", "SD": "SOUTH DAKOTA",
    "TN": "TENNESSEE", "TX": "TEXAS", "UT": "UTAH", "VT": "VERMONT", "VA": "VIRGINIA", "WA": "WASHINGTON",
    "WV": "WEST VIRGINIA", "WI": "WISCONSIN", "WY": "WYOMING",
    "AS": "AMERICAN SAMOA", "GU": "GUAM", "MP": "NORTHERN MARIANA ISLANDS", "PR": "PUERTO RICO", "VI": "VIRGIN ISLANDS",
}


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def state_code(raw: Column) -> Column:
    """USPS code of a state given by code or name, any case and blanks; null if it is neither."""
    word = F.upper(F.regexp_replace(F.trim(raw), r"[^A-Za-z]+", " "))
    by_name = F.try_element_at(literal_map({name: code for code, name in STATE_NAMES.items()}), word)
    return F.when(word.isin(*STATE_NAMES), word).otherwise(by_name)


def npi_check(digits: Column) -> Column:
    """Whether a text of exactly ten digits has the right check digit (Luhn over 80840 + number)."""
    doubled = "0246813579"
    total = F.lit(24)  # what the prefix 80840 adds
    for place in range(1, 11):
        digit = F.substring(digits, place, 1)
        total = total + (F.translate(digit, "0123456789", doubled) if place % 2 else digit).try_cast("int")
    return F.coalesce(total % 10 == 0, F.lit(False))


def valid_npi(raw: Column) -> Column:
    """True for ten digits (blanks around ignored) with the right check digit; false for null."""
    text = F.trim(raw)
    return F.when(text.rlike(r"^[0-9]{10}$"), npi_check(text)).otherwise(F.lit(False))
