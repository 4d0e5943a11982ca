"""Same postal address written differently: parsed components, expanded abbreviations, hierarchical keys."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriplane.functions.codes import STATE_NAMES
from veriplane.runtime import drop_stored, ship, stored

# Street types and the ways they are abbreviated; words that towns begin or end with are not among them.
STREET_TYPES = {
    "ALLEY": "ALY ALLEE ALLY", "ARCADE": "ARC", "AVENUE": "AV AVE AVEN AVENU AVN AVNUE", "BEND": "BND", "BOULEVARD": "BL BLVD BOUL BOULV",
    "BYPASS": "BYP BYPA BYPAS BYPS", "CAUSEWAY": "CSWY CAUSWA", "CIRCLE": "CIR CIRC CIRCL CRCL CRCLE", "CONCOURSE": "", "COURT": "CT CRT", "COURTS": "CTS",
    "COVE": "CV", "CRESCENT": "CRES CRSENT CRSNT", "CROSSING": "XING CRSSNG", "CROSSROAD": "XRD", "CURVE": "CURV", "DRIVE": "DR DRV DRIV",
    "EXPRESSWAY": "EXPY EXP EXPR EXPW", "EXTENSION": "EXT EXTN", "FREEWAY": "FWY FREEWY FRWAY", "GATEWAY": "GTWY GATEWY GTWAY", "HIGHWAY": "HWY HIGHWY HIWAY HIWY HWAY",
    "LANE": "LA LN", "LOOP": "LOOPS", "MEWS": "", "MOTORWAY": "MTWY", "OVERPASS": "OPAS", "PARKWAY": "PKWY PKY PARKWY PKWAY", "PASSAGE": "PSGE", "PIKE": "",
    "PLACE": "PL", "PROMENADE": "", "ROAD": "RD", "ROUTE": "RTE RT", "ROW": "", "SKYWAY": "", "SPUR": "", "SQUARE": "SQ SQR SQRE", "STREET": "ST STR STRT STREETS",
    "TERRACE": "TER TERR", "THROUGHWAY": "TRWY", "TRACE": "TRCE", "TRACK": "TRAK TRK", "TRAFFICWAY": "TRFY", "TRAIL": "TRL TR TRAILS TRLS", "TUNNEL": "TUNL",
    "TURNPIKE": "TPKE TRNPK TURNPK", "UNDERPASS": "UPAS", "VIADUCT": "VIA VDCT", "WALK": "", "WAY": "WY",
}
# Words within street names that are abbreviated.
NAME_WORDS = {
    "HL": "HILL", "HLS": "HILLS", "HTS": "HEIGHTS", "SPG": "SPRING", "SPGS": "SPRINGS", "MTN": "MOUNTAIN", "VLY": "VALLEY", "BCH": "BEACH", "HBR": "HARBOR", "ISL": "ISLAND",
    "CTR": "CENTER", "CNTR": "CENTER", "CENTRE": "CENTER", "PLZ": "PLAZA", "GRV": "GROVE", "GDNS": "GARDENS", "RDG": "RIDGE", "MED": "MEDICAL", "PK": "PARK",
}
# Compass directions.
DIRECTIONS = {
    "N": "N NO NORTH", "S": "S SO SOUTH", "E": "E EAST", "W": "W WEST",
    "NE": "NE NORTHEAST", "NW": "NW NORTHWEST", "SE": "SE SOUTHEAST", "SW": "SW SOUTHWEST",
}
# First words of towns that are abbreviated.
TOWN_WORDS = {
    "N": "NORTH", "NO": "NORTH", "S": "SOUTH", "SO": "SOUTH", "E": "EAST", "W": "WEST", "ST": "SAINT", "STE": "SAINTE",
    "MT": "MOUNT", "FT": "FORT", "LK": "LAKE", "PT": "PORT",
}
# Number words.
ORDINALS = "FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH TENTH ELEVENTH TWELFTH".split()
# What names a part of a building, and a building; what a numbered road is called, and its short forms.
UNIT_WORDS = "APT APARTMENT STE SUITE UNIT RM ROOM FL FLR FLOOR SPC SPACE LOT DEPT".split()
BUILDING_WORDS = "BLDG BUILDING CENTER CENTRE CTR PLAZA TOWER TOWERS COMPLEX PAVILION MALL".split()
BUILDING_USES = "PROFESSIONAL MEDICAL OFFICE HEALTH BUSINESS".split()
ROAD_OWNERS = {"COUNTY": "COUNTY CTY CO CNTY", "STATE": "STATE", "US": "US", "TOWNSHIP": "TOWNSHIP TWP", "OLD": "OLD", "FARM": "FARM", "RANCH": "RANCH"}
NUMBERED = {"HIGHWAY": "HIGHWAY HWY", "ROUTE": "ROUTE RTE RT", "ROAD": "ROAD RD", "AVENUE": "AVENUE AVE"}
SHORT_ROADS = {"CR": "COUNTY ROAD", "SR": "STATE ROUTE", "FM": "FARM ROAD", "RR": "RANCH ROAD"}
# Names of a postal box, and words before a name that the mail is in care of.
BOX_WORDS = [r"P\s*O\s*(?:BOX|BX)", r"POST\s+OFFICE\s+BOX", r"POSTAL\s+BOX", "POBOX", "POB", "BOX"]
# Texts that stand for no address or town.
FILLERS = {"", "NA", "N A", "NONE", "UNKNOWN", "UNK", "NULL", "TBD", "NOT AVAILABLE", "NOT ON FILE", "SAME", "SEE ABOVE", "PENDING", "X", "XX", "XXX"}

#: Records of one place that a task joins with the others of it.
_SLICE = 1_000
HOUSE = r"[0-9]+[A-Z]?(?:_[0-9]+(?:/[0-9]+)?)?"


def _forms(words: dict[str, str]) -> dict[str, str]:
    return {short: full for full, shorts in words.items() for short in [full, *shorts.split()]}


class Locale:
    """The dictionaries by which addresses of a country are read, and the patterns made of them.

    Each argument replaces a dictionary of the United States; states are codes with names.
    """

    def __init__(
        self, street_types=STREET_TYPES, name_words=NAME_WORDS, directions=DIRECTIONS, town_words=TOWN_WORDS, ordinals=ORDINALS, unit_words=UNIT_WORDS,
        building_words=BUILDING_WORDS, building_uses=BUILDING_USES, road_owners=ROAD_OWNERS, numbered=NUMBERED, short_roads=SHORT_ROADS, box_words=BOX_WORDS, fillers=FILLERS, states=STATE_NAMES,
    ):
        self.types, self.directions, self.name_words, self.town_words, self.fillers = _forms(street_types), _forms(directions), name_words, town_words, fillers
        self.ordinals, self.building_words = {w: f"{n}TH" for n, w in enumerate(ordinals, 1)}, building_words
        self.states, self.state_of = states, {name: code for code, name in states.items()}
        self.owners, self.roads, self.short_roads = _forms(road_owners), _forms(numbered), short_roads
        either = "|".join
        units, buildings = either(unit_words), either(building_words)
        self.unit = re.compile(rf"(?<![A-Z0-9])(?:(?:{units})\s*#?|#)\s*(?:[0-9]+[A-Z]?|[A-Z]?[0-9]+|[A-Z])(?![A-Z0-9])")
        self.box = re.compile(rf"(?<![A-Z0-9])(?:{either(box_words)})\s*#?\s*([0-9]+[A-Z]?)(?![A-Z0-9])")
        self.care = re.compile(
            r"(?:(?<![A-Z0-9])C\s*/\s*O|^\s*C\s*O|(?<![A-Z0-9])CARE\s+OF|ATTN:?)\s+[^,]*?(?:,|(?=(?<![A-Z0-9])(?:[0-9]|#|P\s*O\s+BOX|POB|BOX|POST\s+OFFICE|(?:APT|STE|SUITE|UNIT|RM|FL)\s+[0-9])))"
        )
        self.named = re.compile(rf"^[^,0-9#]*?(?<![A-Z0-9])(?:{buildings})\s+(?=[0-9#]|(?:APT|STE|SUITE|UNIT|RM|ROOM|FL|FLOOR)\s+#?[0-9])")
        self.building = re.compile(rf"(?<![A-Z0-9])[A-Z]+ (?:(?:{either(building_uses)}) )?(?:{buildings})(?![A-Z0-9])")
        self.road = re.compile(
            rf"(?<![A-Z0-9])({HOUSE} (?:(?:{either(self.directions)}) )?)(?:((?:(?:{either(self.owners)}) )*)({either(self.roads)})|({either(short_roads)})) ?#? ?([0-9]+[A-Z]?)(?![A-Z0-9])"
        )
        self.ending_zip = re.compile(r"[ ,]+([0-9]{5})(?:[- ]?[0-9]{4})?$")
        self.short_zip = re.compile(rf"[ ,](?:{either(states)})[ ,]+([0-9]{{4}})$")
        self.ending_state = re.compile(rf"[ ,]+({either([*states, *sorted(self.state_of, key=len, reverse=True)])})$")


EN_US = Locale()


def _numbered_house(found: re.Match) -> str:
    """A range of house numbers by its first; other numbers with a dash are one number."""
    low, high = found.group(1), found.group(2)
    if len(low) == len(high) and 0 < int(high) - int(low) < 100 and (int(high) - int(low)) % 2 == 0:
        return low
    return f"{low}_{high}"


def _numbered_road(g: Locale):
    def name(found: re.Match) -> str:
        before, owners, road, short, number = found.groups()
        if short:
            owners, road = g.short_roads[short].rsplit(" ", 1)
        words = [g.owners[w] for w in (owners or "").split()]
        return f"{before}{'-'.join(words) or 'NO'}_{number} {g.roads[road]}"

    return name


def clean(text: str | None) -> str:
    """Upper case without accents and dots, single blanks; a house number with a dash or a fraction is one word."""
    if not text:
        return ""
    for sign, fraction in (("½", " 1/2"), ("¼", " 1/4"), ("¾", " 3/4")):
        text = text.replace(sign, fraction)
    flat = unicodedata.normalize("NFKD", text)
    flat = "".join(c for c in flat if not unicodedata.combining(c)).upper()
    flat = re.sub(r"[.'`_]", "", flat)
    flat = re.sub(r"(?<![A-Z0-9-])([0-9]+) ?- ?([0-9]+)(?= +[A-Z])", _numbered_house, flat)
    flat = re.sub(r"(?<![A-Z0-9/])([0-9]+) +([0-9]/[0-9])(?= )", r"\1_\2", flat)
    flat = re.sub(r"[^A-Z0-9#/,:_]+", " ", flat)
    return " ".join(flat.split())


def filler(text: str, g: Locale = EN_US) -> bool:
    return re.sub(r"[^A-Z0-9]+", " ", text).strip() in g.fillers


def town_key(text: str, g: Locale = EN_US) -> str:
    """A town with its first word spelled out."""
    words = re.sub(r"[^A-Z0-9 ]+", " ", text).split()
    if len(words) > 1:
        words[0] = g.town_words.get(words[0], words[0])
    return " ".join(words)


def zip_key(text: str | None) -> str:
    """The first five digits of a ZIP code; a lost leading zero is restored, a box number or filler gives nothing."""
    digits = re.sub(r"[\s-]+", "", text or "")
    if not digits.isdigit() or not digits.isascii():
        return ""
    if len(digits) in (4, 8):
        digits = "0" + digits
    return digits[:5] if len(digits) in (5, 9) else ""


def parse_street(text: str, g: Locale = EN_US) -> tuple[str, str, str, str, str]:
    """(box, house, direction, name, type) of a cleaned street line; parts that aren't there are empty.

    Care-of names, units, floors and named buildings are left out. A direction may stand before the
    name or at the end; the house number may stand first or last.
    """
    box, text = _strip(text, g)
    best: tuple[str, str, str, str, str] = ("", "", "", "", "")
    for part in text.split(","):
        words = _unnamed(part.split(), g)
        if not words:
            continue
        found = _street_words(words, g)
        if sum(map(bool, found)) > sum(map(bool, best[1:])):
            best = ("", *found)
    return (box, *best[1:])


def _unnamed(words: list[str], g: Locale) -> list[str]:
    """Without a building named after the street; nothing is left of a part that only names one. A house number alone before it makes it a street."""
    if not words or words[-1] not in g.building_words:
        return words
    at = next((i for i, w in enumerate(words) if i > 1 and w in g.types), 0)
    if not re.fullmatch(HOUSE, words[0]):
        return []
    return words[: at + 1] if at else words


def _strip(text: str, g: Locale) -> tuple[str, str]:
    """The box number, and the text without care-of names, with commas in the place of boxes, units and buildings."""
    text = g.named.sub(" ", g.care.sub(" ", text).strip())
    box = g.box.search(text)
    text = g.unit.sub(" , ", g.box.sub(" , ", g.road.sub(_numbered_road(g), text)))
    text = g.building.sub(lambda m: _building(m, g), text)
    # a unit without a word for it: digits and one letter after the street
    return (box.group(1) if box else "", re.sub(r"(?<=[A-Z0-9] )[0-9]+[A-Z](?![A-Z0-9_])", ",", text))


def _building(found: re.Match, g: Locale) -> str:
    """A comma in the place of a building's name, unless the name is that of a street.

    It is if a street type follows, or if it ends its part and nothing but a house number stands before it; not if a whole
    street with its type does.
    """
    *earlier, before = [p.split() for p in found.string[: found.start()].split(",")]
    after = found.string[found.end() :].split(",", 1)[0].split()
    if any(w in g.types for w in before[1:]) or any(any(w in g.types for w in p[1:]) and any(w[0].isdigit() for w in p) for p in earlier):
        return " , "
    if after and after[0] in g.types:
        saint = g.town_words.get(after[0]) and len(after) > 1 and len(after[1]) > 2 and after[1].isalpha() and after[1] not in g.directions
        return " , " if saint and len(before) > 1 else found.group(0)
    alone = before and re.fullmatch(HOUSE, before[0]) and all(w in g.directions for w in before[1:])
    return found.group(0) if alone and not after else " , "


def state_key(text: str | None, g: Locale = EN_US) -> str:
    """The code of a state given by code or name; empty if it is neither."""
    words = re.sub(r"[^A-Z]+", " ", clean(text)).strip()
    return words if words in g.states else g.state_of.get(words, "")


PARTS = ["box", "house", "direction", "street", "kind", "town", "state", "zip"]


def parse_line(text: str | None, g: Locale = EN_US) -> list[tuple]:
    """Readings ``(*PARTS, plain)`` of an address in one line; several where street and town can't be told apart.

    ``plain`` marks a reading whose street ends in its type or direction.
    """
    line = re.sub(r"(?<=[0-9])-(?=[0-9]{4}$)", "", re.sub(r"\s+", " ", (text or "").strip()))
    line = clean(line)
    if filler(line, g):
        return []
    found = g.ending_zip.search(line)
    last = line.split()[-2:]
    if not found and line[0].isdigit() and len(last) == 2 and re.fullmatch("[0-9]{4}", last[1]) and last[0].isalpha() and last[0] not in {*g.types, *g.directions, *g.states}:
        code, line = "0" + last[1], line[:-5]  # a short ZIP code straight after the town
    elif not found and (short := g.short_zip.search(line)):
        code, line = "0" + short.group(1), line[: short.start(1)].rstrip(" ,")
    else:
        code, line = (found.group(1), line[: found.start()]) if found else ("", line)
    found = g.ending_state.search(line)
    state = state_key(found.group(1), g) if found else ""
    line = line[: found.start()] if found else line
    box, line = _strip(line, g)
    parts = [p.split() for p in line.split(",") if p.split()]
    parts = [p for p in (_unnamed(p, g) for p in parts) if p]
    if not parts:
        return [(box, "", "", "", "", "", state, code, True)] if box else []
    if box and len(parts) == 1 and not any(c.isdigit() for c in parts[0][0]):
        return [(box, "", "", "", "", town_key(" ".join(parts[0]), g), state, code, True)]
    if len(parts) > 1 and not any(c.isdigit() for w in parts[-1] for c in w):
        street = max((_street_words(p, g) for p in parts[:-1]), key=lambda s: sum(map(bool, s)))
        return [(box, *street, town_key(" ".join(parts[-1]), g), state, code, True)]
    words = max(parts, key=len)
    if not re.fullmatch(HOUSE, words[0]):
        at = next((i for i, w in enumerate(words) if i and w[0].isdigit()), None)
        if at is not None:
            return [(box, *_street_words(words[: at + 1], g), town_key(" ".join(w for w in words[at + 1 :] if not w[0].isdigit()), g), state, code, True)]
    # a bare number behind the street is a unit, what follows it the town
    start = 2 if len(words) > 2 and words[1].isdigit() and words[2] not in g.types else 1
    unit = next((i for i in range(start + 1, len(words)) if words[i].isdigit()), None)
    if unit is not None:
        return [(box, *_street_words(words[:unit], g), town_key(" ".join(w for w in words[unit + 1 :] if not w[0].isdigit()), g), state, code, True)]
    out = []
    for k in range(0, min(8, len(words) - 1)):
        street, town = words[: len(words) - k], words[len(words) - k :]
        parsed = _street_words(street, g)
        plain = bool(parsed[3]) and (street[-1] in g.types or street[-1] in g.directions and street[-2] in g.types)
        if parsed[2] and parsed[2] not in g.directions:
            out.append((box, *parsed, town_key(" ".join(town), g), state, code, plain))
    return out


def _street_words(words: list[str], g: Locale) -> tuple[str, str, str, str]:
    house = ""
    if len(words) > 2 and re.fullmatch(HOUSE, words[0]) and words[1].isdigit() and words[2] not in g.types:
        words = words[1:]  # a unit number, then the house
    if re.fullmatch(HOUSE, words[0]) and len(words) > 1:
        house, words = words[0], words[1:]
    elif re.fullmatch(HOUSE, words[-1]) and len(words) > 1:
        house, words = words[-1], words[:-1]
    direction = kind = ""
    if len(words) > 1 and words[-1] in g.directions:
        direction, words = g.directions[words[-1]], words[:-1]
    if len(words) > 1 and words[0] in g.directions and not (len(words) == 2 and words[1] in g.types and direction):
        direction, words = g.directions[words[0]], words[1:]
    for i in range(len(words) - 1, 0, -1):
        if words[i] in g.types:
            kind = g.types[words[i]]
            # what follows the type is a direction or a unit without a word for it
            after = words[i + 1 :]
            if after and after[0] in g.directions and not direction:
                direction = g.directions[after[0]]
            words = words[:i]
            break
    else:
        while len(words) > 1 and re.fullmatch(r"[0-9]+[A-Z]", words[-1]) and not re.fullmatch(r"[0-9]+(?:ST|ND|RD|TH)", words[-1]):
            words = words[:-1]
    name = " ".join(_name_word(w, g) for w in words)
    return house, direction, name, kind


def _name_word(word: str, g: Locale) -> str:
    number = re.fullmatch(r"([0-9]+)(?:ST|ND|RD|TH)?", word)
    return f"{number.group(1)}TH" if number else g.ordinals.get(word) or g.name_words.get(word, word)


def _apart(record: str, reading: tuple) -> list[tuple]:
    """A reading with both a box and a building as one of each; none if it has neither."""
    box, house, _, street = reading[:4]
    rest = reading[5:]
    out = [(record, box, "", "", "", "", *rest)] if box else []
    return [*out, (record, "", *reading[1:])] if house and street else out


def _parse_claims(g: Locale):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record, one, two, city, state, code in batch.itertuples(index=False, name=None):
                first, second = ("" if filler(x, g) else x for x in (clean(one), clean(two)))
                town = clean(city)
                parsed = parse_street(f"{first} , {second}", g)
                rows += _apart(record, (*parsed, "" if filler(town, g) else town_key(town, g), state_key(state, g), zip_key(code), True))
            yield pd.DataFrame(rows, columns=["record", *PARTS, "plain"])

    return run


def _parse_lines(g: Locale):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [x for record, line in batch.itertuples(index=False, name=None) for r in parse_line(line, g) for x in _apart(record, r)]
            yield pd.DataFrame(rows, columns=["record", *PARTS, "plain"])

    return run


_SCHEMA = "record string, " + ", ".join(f"{p} string" for p in PARTS) + ", plain boolean"


def _close(a: str, b: str):
    """Same but for slips: distance up to a quarter of the longer text, three at most; numbered streets and roads must be equal."""
    numbered = F.col(a).rlike("^[0-9]|_[0-9]") | F.col(b).rlike("^[0-9]|_[0-9]")
    room = F.least(F.lit(3), F.floor(F.greatest(F.length(a), F.length(b)) / 4).cast("int"))
    return (F.col(a) == F.col(b)) | (~numbered & (F.levenshtein(F.col(a), F.col(b)) <= room))


def _deletes(column: str):
    """The text and every text with one character less; two texts share one of them if one edit or swap parts them."""
    size = F.length(column)
    less = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.concat(F.substr(F.col(column), F.lit(1), i - 1), F.substr(F.col(column), i + 1)))
    return F.array_distinct(F.concat(F.array(column), less))


def parse_records(claims: DataFrame, entities: DataFrame, locale: Locale = EN_US) -> DataFrame:
    """One reading ``(record, *PARTS)`` for each distinct address of each record.

    Where the end of a street and the start of a town can't be told apart, the towns that
    other records have with the same ZIP code decide; without one, a town that occurs
    anywhere; without that, a street that ends in its type.
    """
    ship(claims.sparkSession)
    given = (
        claims.where("claim_id is not null")
        .select(F.concat(F.lit("c:"), F.col("claim_id").cast("string")), "address_1", "address_2", "city", "state", "zip_code")
        .mapInPandas(_parse_claims(locale), _SCHEMA)
    )
    lines = (
        entities.where("entity_id is not null and practice_address is not null")
        .select(F.concat(F.lit("e:"), F.col("entity_id")), "practice_address")
        .distinct()
        .mapInPandas(_parse_lines(locale), _SCHEMA)
    )
    read = stored(given.withColumn("one_line", F.lit(False)).unionByName(lines.withColumn("one_line", F.lit(True))), "addresses")
    sure = read.where(~F.col("one_line")).select(*PARTS, "record", "plain")
    towns = _zip_towns(sure, F.count("*"))
    anywhere = sure.where("town <> ''").select(F.col("town").alias("seen")).distinct()
    options = (
        read.where("one_line")
        .join(towns.withColumnRenamed("zip", "_zip"), F.col("zip") == F.col("_zip"), "left")
        .join(anywhere, F.col("town") == F.col("seen"), "left")
        .withColumn("away", F.when(F.col("main_town").isNotNull(), F.when(F.levenshtein("town", "main_town") <= 3, F.levenshtein("town", "main_town")).otherwise(50)).otherwise(F.when(F.col("seen").isNotNull(), 0).otherwise(50)))
    )
    order = F.struct("away", (~F.col("plain")).alias("p"), F.when(F.col("away") < 50, -F.length("town")).otherwise(F.length("town")).alias("l"), *PARTS)
    chosen = options.groupBy("record", "state", "zip", "box").agg(F.min(order).alias("o")).select("record", *[F.col(f"o.{p}").alias(p) for p in PARTS])
    return sure.select("record", *PARTS).unionByName(chosen).distinct()


def _zip_towns(records: DataFrame, weight: Column) -> DataFrame:
    """The most frequent town of each ZIP code."""
    counted = records.where("zip <> '' and town <> ''").groupBy("zip", "town").agg(weight.alias("n"))
    return counted.groupBy("zip").agg(F.max(F.struct("n", "town"))["town"].alias("main_town"))


def locate(claims: DataFrame, entities: DataFrame, locale: Locale = EN_US) -> DataFrame:
    """``(record, place)``: the building or postal box of every record that has one.

    Keys form a hierarchy. A building is ZIP code, house number, direction, street name and
    street type; a box is ZIP code and number. Missing parts follow explicit rules:

    - no ZIP code: those of the town (spelled as elsewhere, or one slip away from it) in the
      record's state, unless it has none, are tried. The record takes the one where its
      building or box is known; if there is none, or there are several, town and state replace
      the ZIP code;
    - neither ZIP code nor town: the only place of the same house, direction, name and type (in the
      state, if given) that is known by ZIP code; otherwise the record stays alone;
    - no street type: the type that others have at this house and name, if it is the only one or at
      least twice as frequent as the next; otherwise none;
    - no direction is a value of its own: with and without one are different streets.

    Within ZIP code, house and direction a name takes the spelling of the most frequent name
    that differs from it by slips only. Units, floors, care-of and building names don't count.

    Words are read by the dictionaries of ``locale``. Of a range of house numbers the first counts; numbers with
    a dash or a fraction are numbers of their own; numbered roads are told apart by their number.

    Defined cases: records without an address line, and those with neither a box nor both a house
    number and a street, have no place. Repeated rows count once; a record with two
    addresses, or with a box and a building, has two places. Null parts are missing parts. Other columns play no part.

    Scale: all joins are over distinct parsed addresses with their number of records, so a place that a
    third of all records share is one row there; records come back in one last join. The parse is one pass in Arrow batches.
    """
    read = stored(parse_records(claims, entities, locale).withColumn("pid", F.md5(F.concat_ws("\x00", *PARTS))), "parsed")
    parts = stored(read.groupBy("pid", *PARTS).agg(F.count("*").alias("n")), "parts")
    core = ["house", "direction", "street", "kind", "box"]
    coded = parts.where("zip <> ''")
    towns = stored(_zip_towns(coded, F.sum("n")), "towns")
    spelled = coded.where("town <> ''").select("zip", "town").distinct()
    main_state = coded.where("state <> ''").groupBy("zip", "state").agg(F.sum("n").alias("n")).groupBy("zip").agg(F.max(F.struct("n", "state"))["state"].alias("zip_state"))

    # addresses without a ZIP code come as candidates for the codes of their town
    bare = parts.where("zip = '' and town <> ''")
    names = bare.select("town", "state").distinct()
    exact = names.join(spelled, "town").select("town", "state", "zip")
    unknown = names.join(spelled.select("town").distinct(), "town", "left_anti")
    variants = towns.select("zip", F.explode(_deletes("main_town")).alias("v"))
    slips = unknown.select("town", "state", F.explode(_deletes("town")).alias("v")).join(variants, "v").select("town", "state", "zip").distinct()
    codes = (
        exact.unionByName(slips).join(main_state, "zip", "left")
        .where("state = '' or zip_state is null or state = zip_state")
        .select("town", "state", F.col("zip").alias("code")).distinct()
    )
    codes = stored(codes, "codes")
    by_town = bare.join(codes, ["town", "state"])
    placeless = parts.where("zip = '' and town = '' and house <> ''")
    known_streets = coded.where("house <> ''").select("zip", "house", "direction", "street", "kind").distinct().join(main_state, "zip", "left")
    by_street = (
        placeless.join(known_streets.withColumnRenamed("zip", "code"), ["house", "direction", "street", "kind"])
        .where("state = '' or zip_state is null or state = zip_state")
        .drop("zip_state")
    )
    asked = stored(by_town.unionByName(by_street, allowMissingColumns=True).select("pid", *core, "code", "n"), "asked")

    all_parts = coded.select(F.col("zip").alias("code"), *core, "n").withColumn("sure", F.col("n")).unionByName(asked.select("code", *core, "n").withColumn("sure", F.lit(0).cast("long")))
    names_at = all_parts.where("house <> ''").groupBy("code", "house", "direction", "street").agg(F.sum("n").alias("n"), F.sum("sure").alias("sure"))
    spelling = stored(_spellings(names_at), "spelling")
    # types known by ZIP code count before those of candidates
    typed = (
        all_parts.where("house <> '' and kind <> ''").join(spelling, ["code", "house", "direction", "street"])
        .groupBy("code", "house", "direction", "name", "kind").agg(F.sum("sure").alias("s"), F.sum("n").alias("n"))
        .groupBy("code", "house", "direction", "name")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), (-F.col("n")).alias("n"), "kind"))).alias("k"))
    )
    first, second = F.col("k")[0], F.get(F.col("k"), 1)
    leads = F.when(first["s"] < 0, first["s"] <= 2 * second["s"]).otherwise(first["n"] <= 2 * second["n"])
    kinds = typed.select(
        "code", "house", "direction", "name", F.when((F.size("k") == 1) | leads, first["kind"]).alias("usual"),
        F.transform(F.filter("k", lambda x: x["s"] < 0), lambda x: x["kind"]).alias("kinds"),
    )
    kinds = stored(kinds, "kinds")

    def place(rows: DataFrame) -> DataFrame:
        """``rows`` (with code) with the place of that code and whether it is known there."""
        named = rows.join(spelling, ["code", "house", "direction", "street"], "left").join(kinds, ["code", "house", "direction", "name"], "left")
        kind = F.when(F.col("kind") != "", F.col("kind")).otherwise(F.coalesce("usual", F.lit("")))
        building = F.concat_ws("|", "code", "house", "direction", F.coalesce("name", "street"), kind)
        known = F.coalesce(F.col("known"), F.lit(False)) & ((F.col("kind") == "") | (F.coalesce(F.size("kinds"), F.lit(0)) <= 0) | F.array_contains("kinds", F.col("kind")))
        return named.select(*rows.columns, F.when(F.col("box") != "", F.concat_ws("|", "code", F.lit("BOX"), "box")).otherwise(building).alias("place"), known.alias("found"))

    placed = place(coded.withColumn("code", F.col("zip")))
    boxes = coded.where("box <> ''").select(F.col("zip").alias("code"), "box").distinct().withColumn("box_known", F.lit(True))
    tried = place(asked).join(boxes, ["code", "box"], "left").withColumn("found", F.when(F.col("box") != "", F.coalesce("box_known", F.lit(False))).otherwise(F.col("found")))
    settled = tried.where("found").groupBy("pid").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo = hi").select("pid", F.col("lo").alias("place"))
    settled = stored(settled, "settled")
    rest = parts.where("zip = ''").join(settled.select("pid"), "pid", "left_anti")
    main_town = codes.join(towns.withColumnRenamed("zip", "code"), "code").groupBy("town", "state").agg(F.min("main_town").alias("as_main"))
    local = rest.where("town <> ''").join(main_town, ["town", "state"], "left").withColumn("code", F.concat_ws("/", F.coalesce("as_main", "town"), "state"))
    lone = rest.where("town = ''").select("pid", F.lit("alone|").alias("place"))
    found = placed.select("pid", "place").unionByName(settled).unionByName(place_by_name(local)).unionByName(lone)
    named = F.when(F.col("place") == "alone|", F.concat("place", "record")).otherwise(F.col("place"))
    out = stored(read.select("record", "pid").join(found, "pid").select("record", named.alias("place")).distinct(), "located")
    drop_stored(read, parts, towns, codes, asked, spelling, kinds, settled)
    return out


def place_by_name(rows: DataFrame) -> DataFrame:
    """Places of addresses known by town and state only: equal parts, or a missing type, make the same place."""
    kinds = (
        rows.where("kind <> ''").groupBy("code", "house", "direction", "street")
        .agg(F.min("kind").alias("lo"), F.max("kind").alias("hi")).where("lo = hi").drop("hi")
    )
    named = rows.join(kinds, ["code", "house", "direction", "street"], "left")
    kind = F.when(F.col("kind") != "", F.col("kind")).otherwise(F.coalesce("lo", F.lit("")))
    building = F.concat_ws("|", "code", "house", "direction", "street", kind)
    return named.select("pid", F.when(F.col("box") != "", F.concat_ws("|", "code", F.lit("BOX"), "box")).otherwise(building).alias("place"))


def _spellings(names_at: DataFrame) -> DataFrame:
    """``(code, house, direction, street, name, known)``: the usual spelling of each name at its house.

    Of the names within slips the most frequent, then the first; applied twice, so that a slip of
    a slip arrives too. ``known``: some record with a ZIP code has that spelling.
    """
    block = ["code", "house", "direction"]
    other = names_at.select(*block, F.col("street").alias("near"), F.col("n").alias("near_n"), F.col("sure").alias("near_sure"))
    linked = names_at.join(other, block).where(_close("street", "near"))
    best = F.min(F.struct((F.col("near_sure") == 0).alias("a"), (-F.col("near_n")).alias("b"), F.col("near").alias("to"))).alias("best")
    step = linked.groupBy(*block, "street").agg(best).select(*block, "street", F.col("best.to").alias("to"), (~F.col("best.a")).alias("known"))
    again = step.select(*block, F.col("street").alias("to"), F.col("to").alias("name"), F.col("known").alias("_k"))
    return step.join(again, [*block, "to"]).select(*block, "street", "name", "known")


def same_places(claims: DataFrame, entities: DataFrame, locale: Locale = EN_US) -> DataFrame:
    """Distinct pairs ``(record_a, record_b)``, smaller key first, of different records at one place; see ``locate``.

    A place of many records is cut into slices on one side, and each slice meets a copy of the other side.
    """
    at = locate(claims, entities, locale).where("not startswith(place, 'alone|')")
    sizes = at.groupBy("place").agg(F.ceil(F.count("*") / _SLICE).cast("int").alias("slices"))
    at = at.join(sizes.where("slices > 1"), "place", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    one = at.select("place", F.col("record").alias("record_a"), F.pmod(F.xxhash64("record"), F.col("slices")).cast("int").alias("slice"))
    two = at.select("place", F.col("record").alias("record_b"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    return one.join(two, ["place", "slice"]).where("record_a < record_b").select("record_a", "record_b").distinct()
