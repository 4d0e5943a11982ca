"""Filling fixed-capacity containers: minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriplane.runtime import ship, stored

# Fixed value: the split pattern that belongs to the 50k byte-level vocabularies.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_ENCODINGS: dict = {}


def _encoding(ranks_file: bytes):
    """The tokenizer of a rank file, built once per Python worker."""
    if ranks_file not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        _ENCODINGS[ranks_file] = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[ranks_file]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` per row; a null or empty text has no tokens.

    The rank file (under a megabyte) is read by the driver and broadcast, so executors
    need no tokenizer folder. Whole texts are encoded, strings of special tokens as ordinary text.
    """
    ship(documents.sparkSession)
    with open(tokenizer, "rb") as file:
        ranks = documents.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(ranks.value).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": np.asarray(sizes, dtype=np.int64)})

    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(count, f"doc_id {kind}, n_tokens long")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination ``[(length, how many)]`` of available lengths that fills ``room`` best.

    Bit s of the set tells whether the sum s can be reached; multiplicities are
    split into powers of two. ``lengths`` are in descending order; the search stops at an exact fill.
    """
    mask, sums = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            grown = sums | (sums << (take * length)) & mask
            if grown != sums:
                steps.append((length, take, sums))
                sums = grown
            left -= take
            part *= 2
        if sums >> room & 1:
            break
    target, chosen = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + take
            target -= take * length
    return sorted(chosen.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Container patterns ``(first container, how many containers, [(length, items of it per container)])``.

    Minimum bin slack: the longest item left opens a container, the fullest
    combination of the rest completes it and is removed. The same combination
    is taken as often as the counts allow at once, so the work depends on the number of
    different lengths (at most the capacity), not on the number of items.
    """
    counts = {n: c for n, c in histogram.items() if 0 < n <= capacity and c}
    lengths = sorted(counts, reverse=True)
    plan, first = [], 0
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        need = dict(fullest(lengths, counts, capacity - top))
        counts[top] += 1
        need[top] = need.get(top, 0) + 1
        times = min(counts[n] // q for n, q in need.items())
        plan.append((first, times, sorted(need.items(), reverse=True)))
        first += times
        for n, q in need.items():
            counts[n] -= times * q
        lengths = [n for n in lengths if counts[n]]
    return plan


def pack(items: DataFrame, capacity: int, size: str = "n_tokens", key: str = "doc_id", bucket_rows: int = 500_000) -> DataFrame:
    """``(<key>, piece_no, first_token, n_tokens, container_id)``: every item, or every piece of one above the capacity.

    An item above the capacity is cut into full pieces and a rest; no other item is split.
    Containers are numbered from 0.

    Defined cases: an item of null, zero or negative size takes no room and lies in
    container 0; rows with a repeated key are items of their own; an empty table gives no rows.

    Scale: the driver sees the histogram of piece lengths, at most ``capacity`` rows, and
    broadcasts the patterns made from it: as each use of a pattern leaves less of some
    length than one container of it holds, they are bounded by the capacity as well
    (under capacity * (1 + ln capacity) patterns of under sqrt(2 * capacity) lengths).
    Items are numbered within their length in salted buckets of about ``bucket_rows``
    rows, so a length that a third of all items have is spread over many tasks.
    """
    spark = items.sparkSession
    ship(spark)
    whole = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("whole")
    pieces = (
        items.select(F.col(key).alias("doc_id"), whole)
        .select("doc_id", "whole", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(whole - 1) div {int(capacity)}"), F.lit(0)))).alias("piece_no"))
        .select("doc_id", "piece_no", (F.col("piece_no") * capacity).alias("first_token"), F.least(F.col("whole") - F.col("piece_no") * capacity, F.lit(capacity)).alias("n_tokens"))
    )
    pieces = stored(pieces, "pieces")
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, sum(histogram.values()) // bucket_rows)
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    for first, times, need in plan_bins(histogram, capacity):
        for n, q in need:
            ranges.setdefault(n, []).append((used.get(n, 0), first, q))
            used[n] = used.get(n, 0) + times * q
    shared = spark.sparkContext.broadcast({n: np.asarray(r, dtype=np.int64) for n, r in ranges.items()})

    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)))
    sizes = salted.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("n_tokens", "bucket", before.alias("offset"))
    within = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece_no"))
    ranked = (
        salted.withColumn("rank", within.cast("long") - 1)
        .join(offsets, ["n_tokens", "bucket"])
        .select("doc_id", "piece_no", "first_token", "n_tokens", (F.col("rank") + F.col("offset")).alias("rank"))
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for batch in batches:
            sizes, ranks = batch["n_tokens"].to_numpy(), batch["rank"].to_numpy()
            bins = np.zeros(len(batch), dtype=np.int64)
            order = np.argsort(sizes, kind="stable")
            cuts = np.flatnonzero(np.diff(sizes[order])) + 1
            for group in np.split(order, cuts):
                if len(group) and sizes[group[0]]:
                    spans = table[int(sizes[group[0]])]
                    at = np.searchsorted(spans[:, 0], ranks[group], side="right") - 1
                    bins[group] = spans[at, 1] + (ranks[group] - spans[at, 0]) // spans[at, 2]
            yield batch[["doc_id", "piece_no", "first_token", "n_tokens"]].assign(container_id=bins)

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"doc_id {kind}, piece_no long, first_token long, n_tokens long, container_id long").withColumnRenamed("doc_id", key)


def pack_documents(documents: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """Containers of ``capacity`` tokens filled with whole texts; see ``pack``."""
    return pack(token_counts(documents, tokenizer), capacity)
