"""Matching parties across sources without keys: sorted neighbourhoods, weighted similarities, one-to-one assignment."""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriplane.functions.codes import state_code, valid_npi
from veriplane.llm.groups import contract
from veriplane.runtime import ship, stored

# Words of legal form, kinds of business, their abbreviations, and titles after a person's name.
LEGAL_WORDS = "LLC LC LLP LP PLLC PC INC INCORPORATED CORP CORPORATION CO COMPANY LTD LIMITED PA".split()
KIND_WORDS = (
    "ASSOCIATES CARE CENTER CLINIC DENTAL GROUP HEALTH HOME HOSPICE HOSPITAL IMAGING LABORATORY MANAGEMENT MEDICAL NURSING "
    "PHARMACY REHABILITATION SERVICES SUPPLY THERAPY TRANSPORT"
).split()
SHORT_WORDS = {
    "ASSOC": "ASSOCIATES", "ASSN": "ASSOCIATES", "ASSOCS": "ASSOCIATES", "CTR": "CENTER", "CNTR": "CENTER", "CENTRE": "CENTER",
    "DENT": "DENTAL", "GRP": "GROUP", "HLTH": "HEALTH", "HOSP": "HOSPITAL", "IMG": "IMAGING", "LAB": "LABORATORY", "LABS": "LABORATORY",
    "MED": "MEDICAL", "MGMT": "MANAGEMENT", "MGT": "MANAGEMENT", "NURS": "NURSING", "PHARM": "PHARMACY", "RX": "PHARMACY",
    "REHAB": "REHABILITATION", "SVC": "SERVICES", "SVCS": "SERVICES", "SERV": "SERVICES", "SERVICE": "SERVICES", "TRANS": "TRANSPORT", "TRANSP": "TRANSPORT",
}
TITLES = set("JR SR II III IV MD DDS DMD DO RN LPN NP PHD PSYD DC OD DPM PT ESQ MR MRS MS DR".split())
FILLERS = set("NONE NA UNKNOWN TBD TEST".split())

#: In a run of o names of one side and x of the other all o * x pairs are compared if that is at most so many for each name.
_FEW = 16

_TAIL = re.compile(r"\b(?:AKA|FKA|NKA|DBA|A/K/A|F/K/A|D/B/A)\b.*$")


def clean(text: str) -> str:
    flat = text.upper()
    if not flat.isascii():
        flat = "".join(c for c in unicodedata.normalize("NFKD", flat) if not unicodedata.combining(c))
    return _TAIL.sub("", re.sub(r"[.'`’]", "", flat))


def slip(a: str, b: str) -> bool:
    """Whether two different words differ by one character, or by two neighbours swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[1::-1] == y[:2] and x[2:] == y[2:])


@lru_cache(100_000)
def _kind(word: str) -> str:
    word = SHORT_WORDS.get(word, word)
    if word in KIND_WORDS:
        return word
    return _near(word, KIND_WORDS)


def _near(word: str, known: list[str]) -> str:
    """The long known word that differs from ``word`` by a slip."""
    return next((k for k in known if len(k) > 5 and len(word) > 4 and slip(word, k)), "")


@lru_cache(100_000)
def _legal(word: str) -> bool:
    return word in LEGAL_WORDS or bool(_near(word, LEGAL_WORDS))


def organization(text: str) -> tuple[list[str], str]:
    """Words of the proper name, and the kinds of business in order."""
    words = [w for w in re.sub(r"[^A-Z0-9]+", " ", text).split() if w != "THE" and len(w) > 1 and not _legal(w)]
    kinds = [_kind(w) for w in words]
    core = [w for w, k in zip(words, kinds) if not k]
    return core or words, " ".join(sorted({k for k in kinds if k})) if core else ""


def is_organization(text: str, given: str | None) -> bool:
    if given in ("O", "I"):
        return given == "O"
    words = set(re.sub(r"[^A-Z0-9]+", " ", text).split())
    return bool(words & set(LEGAL_WORDS) - {"PA", "CO"}) or any(SHORT_WORDS.get(w, w) in KIND_WORDS for w in words)


def person(text: str) -> list[tuple[str, str, str, bool]]:
    """Readings (surname, first, middle, by comma) of a person's name; without a comma either end may be the surname."""
    parts = [[w for w in re.sub(r"[^A-Z ]+", "", p.replace("-", "")).split() if w not in TITLES] for p in text.split(",")]
    parts = [p for p in parts if p]
    if not parts:
        return []
    middle = lambda words: words[0] if words else ""
    if len(parts) > 1:
        return [("".join(parts[0]), parts[1][0], middle(parts[1][1:]), True)]
    w = parts[0]
    if len(w) < 2:
        return []
    out = [(w[0], w[1], middle(w[2:]), False), (w[-1], w[0], middle(w[1:-1]), False)]
    if len(w) > 2:  # a surname in two words
        out += [(w[0] + w[1], w[2], middle(w[3:]), False), (w[-2] + w[-1], w[0], middle(w[1:-2]), False)]
    return list(dict.fromkeys(out))


_READING = "org boolean, core string, lead string, second string, middle string, kind string, comma boolean, reading int"


def readings(name: str, given: str | None) -> list[tuple]:
    """The readings of a name, with the columns of ``_READING``; none of a filler.

    A person's reading has lead (surname), second (first name) and middle; an organization's has
    core (its proper words in alphabetical order) and kind, its lead comes later.
    """
    text = clean(name)
    if is_organization(text, given):
        core, kind = organization(text)
        return [(True, " ".join(sorted(set(core))), "", "", "", kind, False, 0)] if core and not set(core) <= FILLERS else []
    return [(False, "", surname, first, middle, "", comma, n) for n, (surname, first, middle, comma) in enumerate(person(text))]


def read_names(rows: DataFrame) -> DataFrame:
    """``rows`` (with name and given type) with their readings."""
    ship(rows.sparkSession)
    others = [c for c in rows.columns if c not in ("name", "given")]
    columns = [*others, *[x.split()[0] for x in _READING.split(", ")]]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rest = batch[others].itertuples(index=False, name=None)
            yield pd.DataFrame([(*r, *reading) for name, given, r in zip(batch["name"], batch["given"], rest) for reading in readings(name, given)], columns=columns)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in others)
    return rows.mapInPandas(parse, f"{kept}, {_READING}")


def telling_words(cores: DataFrame) -> DataFrame:
    """``(core, lead, second)``: an organization's words led by its rarest word, and again by the next.

    Rarity counts the distinct names of both tables. A slip makes any word rare; then the second reading holds.
    """
    words = cores.select("core", F.explode(F.split("core", " ")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct("n", (-F.length("word")).alias("l"), "word")))
    rare = words.join(counts, "word").groupBy("core").agg(order.alias("w")).select("core", F.explode(F.slice(F.transform("w", lambda x: x["word"]), 1, 2)).alias("lead"))
    return rare.select("core", "lead", F.array_join(F.array_remove(F.split("core", " "), F.col("lead")), " ").alias("second"))


def _pieces(run: Column, text: Column) -> Column:
    """Codes of the three parts of a text in a run; one of them is among the ``_probes`` of any text there within two edits of it."""
    n = F.length(text)
    one, two = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    return F.array(
        F.xxhash64(run, F.lit(1), n, F.substring(text, F.lit(1), one)),
        F.xxhash64(run, F.lit(2), n, F.substring(text, one + 1, two - one)),
        F.xxhash64(run, F.lit(3), n, F.substring(text, two + 1, n - two)),
    )


def _probes(run: Column, text: Column) -> Column:
    """Codes of the places where a text can hold a part of another that is within two edits of it, by the other's length; null where there is none."""
    out = []
    for more in range(-2, 3):  # characters that this text has more
        n = F.length(text) - more
        one, two = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
        fits = (n >= 3) & (F.greatest(n, F.length(text)) >= 5)
        places = [(1, F.lit(1), one), *[(2, one + 1 + d, two - one) for d in range(max(-1, more - 1), min(1, more + 1) + 1)], (3, two + 1 + more, n - two)]
        out += [F.when(fits, F.xxhash64(run, F.lit(part), n, F.substring(text, start, size))) for part, start, size in places]
    return F.array(*out)


def _alike(a: Column, b: Column) -> Column:
    """1 for equal texts; for long ones with a slip (two from eight characters) one less the share of it; 0 otherwise."""
    d, size = F.levenshtein(a, b, 2), F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((size >= 5) & (d >= 0), 1 - d / size).otherwise(0.0)


def _initial(a: Column, b: Column) -> Column:
    return ((F.length(a) == 1) | (F.length(b) == 1)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))


def neighbours(names: DataFrame, window: int) -> DataFrame:
    """Similar names of the two sides: ``(org, lead, second)`` of an owner and ``(x_lead, x_second)``, with similarities.

    ``names`` has org, lead, second, is_o, is_x; each name occurs once. Names are similar if one part is equal and the
    other alike or, under an equal lead, shortened to its initial; names with slips in both parts are not. Names are
    sorted by two composite keys, lead before second and second before lead, so those with an equal part stand
    in one run, and a window slides over the runs: names less than ``window`` ranks apart are compared. In runs longer than
    that, whatever their length, no pair is lost either: where the names of one side are few, each meets all of the
    other; in the rest names are joined exactly on pieces of the other part (see ``_long_runs``).
    """
    names = stored(names.select("org", "lead", "second", "is_o", "is_x", F.monotonically_increasing_id().alias("nid")), "names")
    key = lambda first, part, other: F.struct(F.lit(first).alias("by_lead"), F.xxhash64(F.lit(first), "org", part).alias("run"), F.col(other).alias("other"))
    keyed = names.select("nid", "org", "is_o", "is_x", F.explode(F.array(key(True, "lead", "second"), key(False, "second", "lead"))).alias("k")).select("nid", "org", "is_o", "is_x", "k.*")
    runs = keyed.groupBy("run").agg(F.count("*").alias("n"), F.count_if("is_o").alias("o"), F.count_if("is_x").alias("x")).where("o > 0 and x > 0 and n > 1")
    how = F.when(F.col("n") <= window, "window").when(F.col("o") * F.col("x") <= _FEW * (F.col("o") + F.col("x")), "few").otherwise("pieces")
    runs = stored(keyed.join(runs.select("run", how.alias("how")), "run"), "runs")
    similar = lambda a, b: (_alike(a, b) > 0) | (F.col("by_lead") & ~F.col("org") & _initial(a, b))

    order = Window.partitionBy("run").orderBy("other", "nid")
    one = F.struct("nid", "other", "is_o", "is_x")
    ahead = runs.where("how = 'window'").select("org", "by_lead", one.alias("n"), F.array(*[F.lead(one, j).over(order) for j in range(1, window)]).alias("m"))
    two = ahead.select("org", "by_lead", "n", F.explode("m").alias("m")).where(F.col("m").isNotNull() & similar(F.col("n.other"), F.col("m.other")))
    # either may be the owner's
    sides = [(F.col(f"{a}.is_o") & F.col(f"{b}.is_x"), F.struct(F.col(f"{a}.nid").alias("o_nid"), F.col(f"{b}.nid").alias("x_nid"))) for a, b in ("nm", "mn")]
    slid = two.select(F.inline(F.array_compact(F.array(*[F.when(ok, pair) for ok, pair in sides]))))

    mine = lambda how: runs.where(F.col("how") == how).where("is_o").select("run", "org", "by_lead", F.col("nid").alias("o_nid"), "other")
    theirs = lambda how: runs.where(F.col("how") == how).where("is_x").select("run", F.col("nid").alias("x_nid"), F.col("other").alias("x_other"), *([] if how == "few" else ["org", "by_lead"]))
    few = mine("few").join(theirs("few"), "run").where(similar(F.col("other"), F.col("x_other"))).select("o_nid", "x_nid")
    same = names.where("is_o and is_x").select(F.col("nid").alias("o_nid"), F.col("nid").alias("x_nid"))
    found = same.unionByName(slid).unionByName(few).unionByName(_long_runs(mine("pieces"), theirs("pieces"))).distinct()
    pairs = found.join(names.select(F.col("nid").alias("o_nid"), "org", "lead", "second"), "o_nid").join(names.select(F.col("nid").alias("x_nid"), F.col("lead").alias("x_lead"), F.col("second").alias("x_second")), "x_nid")
    short = ~F.col("org") & _initial(F.col("second"), F.col("x_second"))
    second = F.when(F.col("second") == F.col("x_second"), 1.0).when(short & (F.col("lead") == F.col("x_lead")), 0.8).otherwise(_alike(F.col("second"), F.col("x_second")))
    scored = pairs.select("org", "lead", "second", "x_lead", "x_second", _alike(F.col("lead"), F.col("x_lead")).alias("lead_sim"), second.alias("second_sim"))
    return scored.where("(lead = x_lead or second = x_second) and lead_sim > 0 and second_sim > 0")


def _long_runs(o: DataFrame, x: DataFrame) -> DataFrame:
    """Pairs of an owner's and an exclusion's name in one run whose other parts are alike, or the one's initial if that is a first name.

    Two edits leave one of three parts of a text whole, so names are joined on the parts, not with their whole
    run. The join is on one number, a code of run and part; the texts are compared where they meet.
    """
    text, other = F.col("other"), F.col("x_other")
    mine = o.select("o_nid", "other", F.explode(_probes(F.col("run"), text)).alias("code")).where("code is not null")
    theirs = x.where(F.length(other) >= 3).select("x_nid", "x_other", F.explode(_pieces(F.col("run"), other)).alias("code"))
    pairs = mine.join(theirs, "code").where(_alike(text, other) > 0).select("o_nid", "x_nid")
    first = lambda side, c: side.where("by_lead and not org").withColumn("code", F.xxhash64("run", F.substring(c, 1, 1))).drop("run", "org", "by_lead")
    mine, theirs = first(o, "other"), first(x, "x_other")
    for a, b in ((mine.where(F.length(text) == 1), theirs), (mine, theirs.where(F.length(other) == 1))):
        pairs = pairs.unionByName(a.join(b, "code").where(_initial(text, other)).select("o_nid", "x_nid"))
    return pairs


def usual_readings(spellings: list[tuple[str, str | None, str | None, int]]) -> list[tuple]:
    """The most frequent reading ``(org, core, lead, second, middle, kind, state)`` of an owner's spellings (name, given type, state, rows); two where the surname is unsure.

    A reading with a comma counts twice as much, one with a whole first name too. State and kind are the most frequent
    ones. A middle name may only be given with a slip or an initial of the first name, so there the surname decides.
    """
    found: dict[tuple, list] = {}
    states: dict[str, int] = {}
    kinds: dict[str, int] = {}
    for name, given, state, n in spellings:
        for org, core, lead, second, middle, kind, comma, reading in readings(name, given):
            seen = found.setdefault((org, core, lead, second, middle), [0, reading, False])
            seen[0], seen[1], seen[2] = seen[0] + n, min(seen[1], reading), seen[2] or comma
            if state is not None:
                states[state] = states.get(state, 0) + n
            if kind:
                kinds[kind] = kinds.get(kind, 0) + n
    counted: dict[tuple, list] = {}
    by_lead: dict[str, tuple] = {}
    for (org, core, lead, second, middle), (n, reading, comma) in found.items():
        whole = counted.setdefault((org, core, lead, second), [0, reading, False, (False, 0, "")])
        whole[0] += n * (4 if comma else 2) * (1 if len(second) == 1 else 2)
        whole[1], whole[2] = min(whole[1], reading), whole[2] or comma
        if middle:
            rank = (len(middle) > 1, n, middle)
            whole[3], by_lead[lead] = max(whole[3], rank), max(by_lead.get(lead, rank), rank)
    sure = any(comma or key[0] for key, (_, _, comma, _) in counted.items())
    best = sorted(counted, key=lambda k: (-counted[k][0], counted[k][1], *k[1:]))[: 1 if sure else 2]
    usual = lambda counts: max(counts, key=lambda v: (counts[v], v), default=None)
    out = []
    for org, core, lead, second in best:
        middle = counted[org, core, lead, second][3][2]
        middle = middle if len(middle) > 1 else by_lead.get(lead, (0, 0, ""))[2]
        out.append((org, core, lead, second, "" if org else middle, usual(kinds) or "", usual(states)))
    return out


def owner_entries(owners: DataFrame) -> DataFrame:
    """One row per owner id (two where its surname is unsure) with its usual reading; see ``usual_readings``.

    Equal spellings are counted before an owner's come together, so an owner with a third of all rows brings its
    different spellings only. They are read and weighed in one pass over rows in the order of owners.
    """
    ship(owners.sparkSession)
    rows = (
        owners.where("owner_pac_id is not null and trim(owner_pac_id) <> '' and owner_name is not null")
        .select(F.col("owner_pac_id").alias("owner"), F.col("owner_name").alias("name"), F.col("owner_type").alias("given"), state_code(F.col("owner_state")).alias("state"))
        .groupBy("owner", "name", "given", "state").agg(F.count("*").alias("n"))
    )
    columns = ["owner", "org", "core", "lead", "second", "middle", "kind", "state"]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, spellings = None, []
        for batch in batches:
            out = []
            for mine, *spelling in batch[["owner", "name", "given", "state", "n"]].itertuples(index=False, name=None):
                if mine != owner:
                    out += [(owner, *r) for r in usual_readings(spellings)]
                    owner, spellings = mine, []
                spellings.append(spelling)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([(owner, *r) for r in usual_readings(spellings)], columns=columns)

    kind = rows.schema["owner"].dataType.simpleString()
    return rows.repartition("owner").sortWithinPartitions("owner").mapInPandas(choose, f"owner {kind}, org boolean, core string, lead string, second string, middle string, kind string, state string")


def match_parties(owners: DataFrame, exclusions: DataFrame, window: int = 6, least: float = 0.75) -> DataFrame:
    """``(owner_pac_id, row_id, confidence)``: excluded parties among the owners.

    Names are read into surname and first name, or telling word and other words. The names of both tables
    together are sorted by two composite keys and compared within a sliding ``window``, or joined exactly
    where more names than that share a part (see ``neighbours``). Exclusion rows
    that look like one owner are put together into parties (same valid number, or compatible names, middle names,
    kinds and states), whose middle names, kinds and states count together. The confidence weighs lead 0.45,
    second 0.30, middle or kind 0.15, state 0.10, an unknown part counting half. A pair of owner and
    party below ``least``, with differing full middle names, kinds of business, or states (unless a full
    middle name agrees) is dropped; of the rest a one-to-one assignment of greatest total confidence
    is taken (see ``assign``).

    Defined cases: rows without owner id, row id or name, and fillers for names, match nothing; an unknown
    state, middle name or kind is compatible with any; repeated rows count once, but the most frequent
    spelling stands for an owner. Empty tables give no rows. Other columns play no part.
    Names are read up to a mark AKA, FKA, NKA or DBA: a party listed under its other name alone is not found.

    Scale: an owner with a third of all rows is one entry, and rows of equal name, state and number are one
    form, before anything is compared; the comparisons are at most twice ``window`` per distinct name, and in
    longer runs a bounded number or those of names with an equal piece of the differing word.
    """
    number = F.when(valid_npi(F.col("npi")), F.trim("npi"))
    excluded = exclusions.where("row_id is not null and person_or_entity_name is not null").select(
        "row_id", F.col("person_or_entity_name").alias("name"), state_code(F.col("state")).alias("state"), number.alias("npi")
    )
    forms = excluded.select("name", "state", "npi").distinct().withColumn("given", F.lit(None).cast("string"))
    forms = stored(forms.withColumn("form", F.monotonically_increasing_id()), "forms")
    x = stored(read_names(forms.select("name", "given", "form", "state", "npi")), "readings").drop("comma", "reading")
    o = stored(owner_entries(owners), "owners")

    cores = o.where("org").select("core").unionByName(x.where("org").select("core")).distinct()
    leads = stored(telling_words(cores), "telling")
    led = lambda side: side.where(~F.col("org")).unionByName(side.where("org").drop("lead", "second").join(leads, "core"), allowMissingColumns=True).drop("core")
    x, o = led(x), led(o)
    flags = o.select("org", "lead", "second", F.lit(True).alias("is_o"), F.lit(False).alias("is_x")).unionByName(x.select("org", "lead", "second", F.lit(False).alias("is_o"), F.lit(True).alias("is_x")))
    names = flags.groupBy("org", "lead", "second").agg(F.max("is_o").alias("is_o"), F.max("is_x").alias("is_x"))
    near = stored(neighbours(names, window), "near")

    # candidates: an owner, and a form read like it
    mine = o.select("owner", "org", "lead", "second", *[F.col(c).alias(f"{c}_o") for c in ("middle", "kind", "state")])
    theirs = x.select("form", "npi", "org", F.col("lead").alias("x_lead"), F.col("second").alias("x_second"), "middle", "kind", "state")
    cross = stored(near.join(mine, ["org", "lead", "second"]).join(theirs, ["org", "x_lead", "x_second"]), "cross")
    full = (F.length("middle") > 1) & (F.length("middle_o") > 1)
    agree = full & (_alike(F.col("middle"), F.col("middle_o")) > 0)
    middle = F.when((F.col("middle") == "") | (F.col("middle_o") == ""), 0.5).when(agree, 1.0).when(~full & _initial(F.col("middle"), F.col("middle_o")), 0.8).otherwise(0.0)
    kind = F.when((F.col("kind") == "") | (F.col("kind_o") == ""), 0.5).when(F.col("kind") == F.col("kind_o"), 1.0).otherwise(0.0)
    state = F.when(F.col("state").isNull() | F.col("state_o").isNull(), 0.5).when(F.col("state") == F.col("state_o"), 1.0).otherwise(0.0)
    confidence = 0.45 * F.col("lead_sim") + 0.30 * F.col("second_sim") + 0.15 * F.when(F.col("org"), kind).otherwise(middle) + 0.10 * state
    judged = cross.select("*", confidence.alias("confidence"), agree.alias("agree"), (full & ~agree).alias("against"))

    parties = stored(_parties(cross), "parties")
    close = judged.join(parties, "form").groupBy("owner", "party").agg(
        F.max("confidence").alias("confidence"), F.max("middle_o").alias("middle"), F.max("kind_o").alias("kind"), F.max("state_o").alias("state"),
        F.max("agree").alias("agrees"),
        *[F.collect_set(F.when(F.col(c) != "", F.col(c))).alias(f"{c}s") for c in ("middle", "kind", "state")],
    )
    given = F.filter("middles", lambda m: F.length(m) > 1)
    differs = (F.length("middle") > 1) & (F.size(given) > 0) & ~F.col("agrees")
    initials = (F.col("middle") != "") & (F.size("middles") > 0) & ~F.exists("middles", lambda m: F.substring(m, 1, 1) == F.substring("middle", 1, 1))
    kinds = (F.col("kind") != "") & (F.size("kinds") > 0) & ~F.array_contains("kinds", F.col("kind"))
    apart = F.col("state").isNotNull() & (F.size("states") > 0) & ~F.coalesce(F.array_contains("states", F.col("state")), F.lit(False)) & ~F.col("agrees")
    sound = close.where(~(differs | initials & ~F.col("agrees") | kinds | apart) & (F.col("confidence") >= least))
    pairs = assign(sound.select("owner", F.col("party").cast("string").alias("party"), "confidence"))
    # a form whose own full middle name contradicts the owner's stays out of the party's match
    fit = judged.groupBy("owner", "form").agg(F.min("against").alias("against")).where("not against").select("owner", "form")
    found = (
        pairs.withColumn("party", F.col("party").cast("long")).join(parties, "party").join(fit, ["owner", "form"])
        .join(forms, "form").select(F.col("owner").alias("owner_pac_id"), "name", "state", "npi", "confidence")
    )
    keys = [F.coalesce(c, F.lit("")) for c in ("state", "npi")]
    rows = excluded.select("row_id", "name", keys[0].alias("state"), keys[1].alias("npi"))
    return found.select("owner_pac_id", "name", keys[0].alias("state"), keys[1].alias("npi"), "confidence").join(rows, ["name", "state", "npi"]).groupBy("owner_pac_id", "row_id").agg(F.max("confidence").alias("confidence"))


def _parties(cross: DataFrame) -> DataFrame:
    """``(form, party)``: forms that look like one owner, linked by number or by compatible profiles.

    A profile is a reading's middle name, kind and state; profiles rather than forms are compared, and
    forms hang on their profile, so that many forms of one profile make as many links, not pairs.
    """
    profile = F.concat_ws("\x00", "owner", "x_lead", "x_second", "middle", "kind", F.coalesce("state", F.lit("")))
    same = (F.length("middle") > 1) & (F.length("middle_o") > 1) & (_alike(F.col("middle"), F.col("middle_o")) > 0)
    fits = (F.col("middle") == "") | (F.col("middle_o") == "") | _initial(F.col("middle"), F.col("middle_o"))
    sure = same | (fits & F.coalesce(F.col("state") == F.col("state_o"), F.lit(False)) & ~F.col("org"))
    seen = cross.select("owner", "form", "npi", "middle", "kind", "state", "org", profile.alias("profile"), sure.alias("sure"))
    profiles = seen.select("owner", "profile", "org", "middle", "kind", "state", "sure").distinct()
    other = profiles.select("owner", *[F.col(c).alias(f"{c}_2") for c in ("profile", "middle", "kind", "state", "sure")])
    both = profiles.join(other, "owner").where("profile < profile_2")
    full = (F.length("middle") > 1) & (F.length("middle_2") > 1)
    agree = full & (_alike(F.col("middle"), F.col("middle_2")) > 0)
    middles = (F.col("middle") == "") | (F.col("middle_2") == "") | agree | (~full & _initial(F.col("middle"), F.col("middle_2")))
    kinds = (F.col("kind") == "") | (F.col("kind_2") == "") | (F.col("kind") == F.col("kind_2"))
    states = F.col("state").isNull() | F.col("state_2").isNull() | (F.col("state") == F.col("state_2")) | agree
    # two that each match the owner, by full middle name or by state, are one party with it
    linked = both.where((middles & kinds & states) | (F.col("sure") & F.col("sure_2")))
    # as texts: forms by their number, profiles and numbers by hash
    name = lambda c: F.concat(F.lit("p"), F.md5(c))
    form = F.concat(F.lit("f"), F.col("form").cast("string"))
    edges = (
        seen.select(form.alias("u"), name(F.col("profile")).alias("v"))
        .unionByName(linked.select(name(F.col("profile")).alias("u"), name(F.col("profile_2")).alias("v")))
        .unionByName(seen.where("npi is not null").select(form.alias("u"), F.concat(F.lit("n"), "npi", "owner").alias("v")))
    )
    groups = contract(edges, "u", "v").where("startswith(id, 'f')")
    return groups.select(F.substring("id", 2, 30).cast("long").alias("form"), F.substring("group_id", 2, 30).cast("long").alias("party"))


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total gain, each row and column once; zero gains are no pairs. Shortest augmenting paths."""
    n, m = gain.shape
    cost = np.zeros((n, m + n))
    cost[:, :m] = -gain
    u, v, match = np.zeros(n + 1), np.zeros(m + n + 1), np.zeros(m + n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + n + 1, np.inf), np.zeros(m + n + 1, dtype=int), np.zeros(m + n + 1, dtype=bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j] and gain[match[j] - 1, j - 1] > 0]


def sparse_assignment(rows: list[int], columns: list[int], gains: list[float]) -> list[tuple[int, int, float]]:
    """As ``best_assignment``, for the gains of some pairs only, each given once; memory in proportion to the pairs."""
    near: list[list[tuple[int, float]]] = [[] for _ in range(max(rows, default=-1) + 1)]
    for i, j, g in zip(rows, columns, gains):
        if g > 0:
            near[i].append((j, -g))
    m = max(columns, default=-1) + 1
    for i, own in enumerate(near):
        own.append((m + i, 0.0))  # to remain alone
    u, v, column_of, row_of = [0.0] * len(near), [0.0] * (m + len(near)), [-1] * len(near), [-1] * (m + len(near))
    for i in range(len(near)):
        far, way, done, heap, row, base = {}, {}, {}, [], i, 0.0
        while True:
            for j, cost in near[row]:
                if j not in done and (d := base + cost - u[row] - v[j]) < far.get(j, np.inf):
                    far[j], way[j] = d, row
                    heapq.heappush(heap, (d, j))
            base, j = heapq.heappop(heap)
            while j in done:
                base, j = heapq.heappop(heap)
            done[j] = base
            if row_of[j] < 0:
                break
            row = row_of[j]
        for k, d in done.items():
            if row_of[k] >= 0:
                u[row_of[k]] += base - d
            v[k] -= base - d
        u[i] += base
        while True:
            row = way[j]
            row_of[j], column_of[row], j = row, j, column_of[row]
            if row == i:
                break
    return [(i, j, -cost) for i, own in enumerate(near) for j, cost in own if j == column_of[i] and j < m]


def assign(edges: DataFrame, largest: int = 400) -> DataFrame:
    """One-to-one pairs of ``edges`` (owner, party, confidence) of greatest total confidence.

    Pairs without a rival are taken at once. Rivals are split into connected components, and each is
    solved exactly, by a task: one of up to ``largest`` edges as a matrix, a larger one by the edges alone.
    """
    w = lambda c: Window.partitionBy(c)
    degrees = edges.withColumns({"_o": F.count("*").over(w("owner")), "_p": F.count("*").over(w("party"))})
    degrees = stored(degrees, "edges")
    clear = degrees.where("_o = 1 and _p = 1").select("owner", "party", "confidence")
    rivals = degrees.where("_o > 1 or _p > 1").select("owner", "party", "confidence")
    if rivals.isEmpty():
        return clear
    groups = contract(rivals, "owner", "party").withColumnRenamed("id", "owner")
    rivals = stored(rivals.join(groups, "owner"), "rivals")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        # a pair that is given twice counts with its greatest confidence
        pdf = pdf.groupby(["owner", "party"], as_index=False, sort=True)["confidence"].max()
        rows, owners = pd.factorize(pdf["owner"])
        cols, parties = pd.factorize(pdf["party"])
        if len(pdf) > largest:
            picked = sparse_assignment(rows.tolist(), cols.tolist(), pdf["confidence"].tolist())
        else:
            gain = np.zeros((len(owners), len(parties)))
            gain[rows, cols] = pdf["confidence"]
            picked = [(i, j, gain[i, j]) for i, j in best_assignment(gain)]
        return pd.DataFrame([(owners[i], parties[j], g) for i, j, g in picked], columns=["owner", "party", "confidence"])

    return clear.unionByName(rivals.groupBy("group_id").applyInPandas(solve, "owner string, party string, confidence double"))
