"""Name normalisation, phonetic keys and similarities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens dropped from names.
NOISE_TOKENS = ["AKA", "OR", "DBA", "JR", "SR", "III", "II", "IV", "THE", "AND"]

# Tokens that mark an organization.
ORG_TOKENS = [
    "INC", "LLC", "LLP", "CORP", "CO", "COMPANY", "CENTER", "CENTERS", "SERVICE", "SERVICES", "HOSPITAL", "CLINIC",
    "PHARMACY", "LAB", "LABS", "LABORATORY", "GROUP", "ASSOC", "ASSOCIATES", "HEALTH", "HOME", "AGENCY", "FOUNDATION",
    "SYSTEMS", "SOLUTIONS", "ENTERPRISES", "MARKETING",
]


def normalize_name(name: Column) -> Column:
    """ASCII letters in upper case, single blanks, without noise tokens; null stays null."""
    letters = F.upper(F.regexp_replace(name, r"[^A-Za-z]+", " "))
    return F.array_join(F.filter(F.split(F.trim(letters), " +"), lambda t: ~t.isin(*NOISE_TOKENS, "")), " ")


def tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


def phonetic_token(word: Column) -> Column:
    """First letter, then consonants with repeats collapsed, six characters; a silent first letter is dropped."""
    silent = F.substring(word, 1, 2).isin("AE", "GN", "KN", "PN", "WR")
    stem = F.when(silent, F.substr(word, F.lit(2))).otherwise(word)
    bare = F.concat(F.substring(stem, 1, 1), F.regexp_replace(F.substr(stem, F.lit(2)), "[AEIOU]", ""))
    return F.substring(F.regexp_replace(bare, r"([A-Z])\1+", "$1"), 1, 6)


def phonetic_keys(norm: Column) -> Column:
    """Distinct phonetic tokens of the words of two letters or more."""
    return F.array_distinct(F.transform(F.filter(tokens(norm), lambda t: F.length(t) > 1), phonetic_token))


def entity_type(norm: Column) -> Column:
    marks = F.array(*[F.lit(t) for t in ORG_TOKENS])
    return F.when(F.arrays_overlap(tokens(norm), marks), "organization").otherwise("individual")


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def token_similarity(a: Column, b: Column) -> Column:
    """The greater of Jaccard and 0.9 times the containment in the smaller set; ``a`` and ``b`` hold no repeats."""
    smaller = F.least(F.size(a), F.size(b))
    inside = F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(0.0)
    return F.greatest(jaccard(a, b), 0.9 * inside)
