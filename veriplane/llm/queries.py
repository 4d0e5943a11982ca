"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriplane.functions.codes import STATE_NAMES
from veriplane.llm.addresses import locate, same_places
from veriplane.llm.crossmatch import match_parties
from veriplane.llm.groups import link_groups
from veriplane.llm.leaks import find_leaks
from veriplane.llm.packing import TOKENIZER, pack_documents
from veriplane.llm.spans import SharedSpans
from veriplane.llm.survivors import FILLER_WORDS, judged_values, surviving_fields
from veriplane.runtime import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: table(spark, folder, name)
    return link_groups(t("link_candidates"), t("decisions"), t("entities"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_places(table(spark, folder, "address_claims"), table(spark, folder, "entities"))


def p3_places(spark: SparkSession, folder: str) -> DataFrame:
    """The building or postal box of every address record."""
    return locate(table(spark, folder, "address_claims"), table(spark, folder, "entities"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return surviving_fields(table(spark, folder, "entity_records"), table(spark, folder, "sources"))


def p4_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct usable value of a group, its probability and whether the surviving record holds it."""
    values = judged_values(table(spark, folder, "entity_records"), table(spark, folder, "sources"))
    return values.withColumn("probability", F.round("probability", 6))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_matches(spark, folder).select("owner_pac_id", "row_id")


def p6_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Owners who are excluded parties, with the confidence of each match."""
    return match_parties(table(spark, folder, "owners"), table(spark, folder, "exclusions"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text, or piece of one above the capacity, with its container of 2,048 tokens of the tokenizer that spark.veriplane.tokenizer names."""
    return pack_documents(table(spark, folder, "documents"), 2048, spark.conf.get("spark.veriplane.tokenizer", TOKENIZER))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    leaks = find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return leaks.where("run_words >= 12").select("doc_id", "item_id")


def p9_paraphrases(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with most of an item in its order, however reworded in between, and how much of its answer part."""
    leaks = find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return leaks.where("lcs_share >= 0.6 and answer_share >= 0.5")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return SharedSpans(table(spark, folder, "documents")).pairs()


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document the characters that also occur, in spans of 400 or more, elsewhere."""
    documents = table(spark, folder, "documents")
    return SharedSpans(documents).shares(documents)


QUERIES = {
    "p1_found": p1_found, "p3_found": p3_found, "p3_places": p3_places, "p4_found": p4_found, "p4_values": p4_values, "p6_found": p6_found, "p6_matches": p6_matches, "p8_containers": p8_containers,
    "p9_found": p9_found, "p9_paraphrases": p9_paraphrases, "p10_found": p10_found, "p10_shares": p10_shares,
}

_FILLERS = ", ".join(f"'{w}'" for w in FILLER_WORDS)
_STATES = ", ".join(f"'{c}'" for c in STATE_NAMES)
_NPI_OK = """(regexp_full_match(trim(x), '[0-9]{10}') AND (24 + list_sum(list_transform(generate_series(1, 10), lambda i:
    CASE WHEN i % 2 = 1 THEN (2 * ord(substr(trim(x), i, 1)) - 96) // 10 + (2 * ord(substr(trim(x), i, 1)) - 96) % 10
         ELSE ord(substr(trim(x), i, 1)) - 48 END))) % 10 = 0)"""
_GRAMS = "list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))"

_ROUND = """quality{1} AS MATERIALIZED (SELECT v.field_name, source_id, (sum(CASE WHEN says = 1 THEN v.n * p ELSE 0 END) + 8) / (sum(v.n * p) + 10) AS sens,
            (sum(CASE WHEN says = 0 THEN v.n * (1 - p) ELSE 0 END) + 9) / (sum(v.n * (1 - p)) + 10) AS spec
          FROM votes v JOIN belief{0} b ON b.field_name = v.field_name AND b.pos = v.pos AND b.neg = v.neg GROUP BY 1, 2),
        prior{1} AS (SELECT field_name, (sum(p * n) + 1) / (sum(n) + 2) AS prior FROM belief{0} GROUP BY 1),
        belief{1} AS MATERIALIZED (SELECT field_name, pos, neg, n, 1 / (1 + exp(-(llr + ln(prior / (1 - prior))))) AS p FROM (
            SELECT field_name, pos, neg, any_value(n) AS n, sum(CASE WHEN says = 1 THEN ln(sens / (1 - spec)) ELSE ln((1 - sens) / spec) END) AS llr
            FROM votes JOIN quality{1} USING (field_name, source_id) GROUP BY 1, 2, 3) JOIN prior{1} USING (field_name))"""
_ROUNDS = ",\n        ".join(_ROUND.format(i, i + 1) for i in range(8))

#: Where no SQL is given: p3 and p6 (readings of free text), p8 (a packing) and the measures of p9_paraphrases
#: are held against brute force or by their properties in the tests.
SQL = {
    "p1_found": """
        WITH RECURSIVE verdicts AS (
          SELECT u, v, arg_max(verdict, struct_pack(t := t, p := log_pos)) AS verdict FROM (
            SELECT least(entity_a, entity_b) AS u, greatest(entity_a, entity_b) AS v, try_cast(decided_at AS TIMESTAMPTZ) AS t, log_pos,
                   coalesce(lower(trim(decision)), '') AS verdict
            FROM decisions WHERE entity_a <> entity_b) GROUP BY 1, 2),
        scored AS (SELECT least(entity_a, entity_b) AS u, greatest(entity_a, entity_b) AS v, max(confidence) AS c
                   FROM link_candidates WHERE entity_a <> entity_b GROUP BY 1, 2),
        links AS (SELECT u, v FROM scored FULL JOIN verdicts USING (u, v)
                  WHERE (coalesce(verdict, '') = 'confirm' OR (coalesce(verdict, '') NOT IN ('confirm', 'reject') AND c >= 0.9))
                    AND u IN (SELECT entity_id FROM entities) AND v IN (SELECT entity_id FROM entities)),
        ends AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
        reach AS (SELECT u AS id, u AS r FROM ends UNION SELECT reach.id, ends.v FROM reach JOIN ends ON reach.r = ends.u)
        SELECT id AS entity_id, min(r) AS group_id FROM reach GROUP BY 1""",
    "p4_found": f"""
        WITH rec AS (
          SELECT *, trim(upper(regexp_replace(canonical_name, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS words FROM entity_records
          WHERE group_id IS NOT NULL AND record_id IS NOT NULL),
        usable AS (
          SELECT group_id, record_id, source_id, observed_at, unnest([
            CASE WHEN regexp_matches(words, '\\p{{L}}') AND replace(replace(words, ' ', ''), left(words, 1), '') <> ''
                  AND NOT list_bool_and(list_transform(string_split(words, ' '), lambda t: t IN ({_FILLERS}) OR regexp_full_match(t, '[0-9]+'))) THEN 'canonical_name' END,
            CASE WHEN upper(regexp_replace(canonical_state, '[ ]+', '', 'g')) IN ({_STATES}) THEN 'canonical_state' END,
            CASE WHEN len(list_filter(npis, lambda x: {_NPI_OK})) > 0 THEN 'npis' END]) AS field_name FROM rec),
        plural AS (SELECT group_id FROM rec GROUP BY 1 HAVING count(DISTINCT record_id) > 1)
        SELECT group_id, field_name, record_id FROM (
          SELECT u.*, row_number() OVER (PARTITION BY group_id, field_name ORDER BY trust_rank NULLS LAST, observed_at DESC NULLS LAST, record_id) AS rn
          FROM usable u LEFT JOIN sources s USING (source_id) WHERE field_name IS NOT NULL AND group_id IN (SELECT group_id FROM plural)) WHERE rn = 1""",
    "p4_values": f"""
        WITH rec AS (
          SELECT DISTINCT group_id, record_id, coalesce(source_id, '') AS source_id, observed_at, npis, canonical_state,
                 trim(upper(regexp_replace(canonical_name, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS words
          FROM entity_records WHERE group_id IS NOT NULL AND record_id IS NOT NULL),
        plural AS (SELECT group_id FROM rec GROUP BY 1 HAVING count(DISTINCT record_id) > 1),
        claims AS (
          SELECT group_id, record_id, source_id, observed_at, 'canonical_name' AS field_name,
                 CASE WHEN regexp_matches(words, '\\p{{L}}') AND replace(replace(words, ' ', ''), left(words, 1), '') <> ''
                       AND NOT list_bool_and(list_transform(string_split(words, ' '), lambda t: t IN ({_FILLERS}) OR regexp_full_match(t, '[0-9]+'))) THEN words END AS value FROM rec
          UNION ALL SELECT group_id, record_id, source_id, observed_at, 'canonical_state',
                 CASE WHEN upper(regexp_replace(canonical_state, '[ ]+', '', 'g')) IN ({_STATES}) THEN upper(regexp_replace(canonical_state, '[ ]+', '', 'g')) END FROM rec
          UNION ALL SELECT group_id, record_id, source_id, observed_at, 'npis', unnest(list_distinct(list_transform(list_filter(npis, lambda x: {_NPI_OK}), lambda x: trim(x)))) FROM rec),
        ranked AS (SELECT c.*, coalesce(trust_rank, 4611686018427387904) AS rank, coalesce(-epoch_us(observed_at), 4611686018427387904) AS age
                   FROM claims c LEFT JOIN sources s USING (source_id) WHERE value IS NOT NULL AND group_id IN (SELECT group_id FROM plural)),
        vals AS (SELECT group_id, field_name, value, min(struct_pack(rank := rank, age := age, record_id := record_id)) AS best, list_sort(list(DISTINCT source_id)) AS pos FROM ranked GROUP BY 1, 2, 3),
        speak AS (SELECT group_id, field_name, list_sort(list(DISTINCT source_id)) AS every FROM ranked GROUP BY 1, 2),
        facts AS MATERIALIZED (SELECT v.*, list_filter(every, lambda s: NOT list_contains(pos, s)) AS neg FROM vals v JOIN speak USING (group_id, field_name)),
        patterns AS MATERIALIZED (SELECT field_name, pos, neg, count(*)::DOUBLE AS n FROM facts GROUP BY 1, 2, 3),
        votes AS MATERIALIZED (SELECT field_name, pos, neg, n, unnest(pos) AS source_id, 1 AS says FROM patterns
                               UNION ALL SELECT field_name, pos, neg, n, unnest(neg), 0 FROM patterns),
        belief0 AS MATERIALIZED (SELECT field_name, pos, neg, n, least(0.95::DOUBLE, greatest(0.05::DOUBLE, len(pos)::DOUBLE / (len(pos) + len(neg)))) AS p FROM patterns),
        {_ROUNDS},
        scored AS (SELECT f.*, p AS probability FROM facts f JOIN belief8 b ON b.field_name = f.field_name AND b.pos = f.pos AND b.neg = f.neg),
        top AS (SELECT group_id, field_name, best AS top_best, value AS top_value FROM scored
                QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY best.rank, best.age, -round(probability, 9), best.record_id, value) = 1)
        SELECT group_id, field_name, value, best.record_id AS value_record_id, top_best.record_id AS record_id, round(probability, 6) AS probability, len(pos) AS n_sources,
               CASE WHEN field_name <> 'npis' THEN value = top_value ELSE probability >= 0.5 OR best = top_best END AS retained
        FROM scored JOIN top USING (group_id, field_name)""",
    "p9_found": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
        q AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
        dg AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM d WHERE len(w) >= 12),
        qg AS (SELECT item_id, unnest({_GRAMS}) AS g FROM q WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN qg USING (g)""",
    "p10_found": """
        WITH places AS (SELECT doc_id, text, unnest(generate_series(1, length(text) - 399)) AS i FROM documents WHERE length(text) >= 400),
        grams AS (SELECT DISTINCT doc_id, md5_number(substr(text, i, 400)) AS g FROM places),
        busy AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1),
        kept AS (SELECT * FROM grams WHERE g IN (SELECT g FROM busy))
        SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM kept a JOIN kept b ON a.g = b.g AND a.doc_id < b.doc_id""",
    "p10_shares": """
        WITH places AS (SELECT doc_id, i, md5_number(substr(text, i, 400)) AS g FROM (
            SELECT doc_id, text, unnest(generate_series(1, length(text) - 399)) AS i FROM documents WHERE length(text) >= 400)),
        busy AS (SELECT g FROM places GROUP BY g HAVING min(doc_id) <> max(doc_id)),
        kept AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM places WHERE g IN (SELECT g FROM busy)),
        covered AS (SELECT doc_id, sum(least(400, coalesce(following - i, 400)))::BIGINT AS shared_chars FROM kept GROUP BY 1)
        SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(shared_chars, 0) AS shared_chars,
               CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0) / length(text) ELSE 0::DOUBLE END AS shared_share
        FROM documents LEFT JOIN covered USING (doc_id)""",
}
