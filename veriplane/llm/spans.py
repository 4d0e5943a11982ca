"""Long exact spans shared between records: winnowed anchors, joined, then extended both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriplane.runtime import ship, stored

_BASE = 1099511628211
_INVERSE = pow(_BASE, -1, 2**64)
_TOP = np.uint64(2**64 - 1)
#: Characters hashed at a time; bounds the memory of a Python worker whatever the texts are.
_CHUNK = 1_000_000
#: Documents of one class that a task joins with the others of it.
_SLICE = 1_000


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, dtype=np.uint64)) if n else np.empty(0, dtype=np.uint64)


_FORWARD, _BACKWARD = _powers(_BASE, 1), _powers(_INVERSE, 1)


def _sliding(values: np.ndarray, w: int, op: np.ufunc, pad: np.uint64) -> np.ndarray:
    """``op`` over every ``w`` neighbours, in time independent of ``w``: block-wise running values from both sides."""
    n = len(values)
    blocks = np.full(-(-n // w) * w, pad, dtype=np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - w + 1], ahead[w - 1 : n])


def winnow(codes: np.ndarray, ends: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected positions of the concatenated texts ``codes`` (ending at ``ends``) and the hashes of their ``k`` characters.

    Of any ``w`` neighbouring k-grams of one text at least one is selected; equal
    texts select equal places. Every minimum of a tie is selected.
    """
    global _FORWARD, _BACKWARD
    n = len(codes)
    if n < k + w - 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    if len(_FORWARD) < n:
        _FORWARD, _BACKWARD = _powers(_BASE, n), _powers(_INVERSE, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _FORWARD[:n], out=total[1:])
    h = (total[k:] - total[:-k]) * _BACKWARD[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    inside, whole = np.ones(n - k + 1, dtype=bool), np.ones(n - k - w + 2, dtype=bool)
    for end in ends[:-1]:
        inside[max(0, end - k + 1) : end] = False
        whole[max(0, end - k - w + 2) : end] = False
    masked = np.where(inside, h, _TOP)
    low = np.where(whole, _sliding(masked, w, np.minimum, _TOP), np.uint64(0))
    edge = np.zeros(w - 1, dtype=np.uint64)
    best = _sliding(np.concatenate([edge, low, edge]), w, np.maximum, np.uint64(0))
    at = np.flatnonzero(inside & (best == masked))
    return at, h[at]


def _anchors(k: int, w: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, starts, pieces, size = [], [], [], 0
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def flush(ids: list, starts: list, pieces: list, out: list) -> None:
                if not pieces:
                    return
                codes = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32)
                ends = np.cumsum([len(p) for p in pieces])
                at, h = winnow(codes, ends, k, w)
                which = np.searchsorted(ends, at, side="right")
                begin = np.concatenate([[0], ends[:-1]])[which]
                out.append((np.asarray(ids)[which], at - begin + np.asarray(starts, dtype=np.int64)[which], h))

            for doc, text in zip(batch["doc_id"].to_numpy(), batch["text"]):
                for s in range(0, max(1, len(text) - (k + w - 2)), _CHUNK):
                    piece = text[s : s + _CHUNK + k + w - 2]
                    ids.append(doc)
                    starts.append(s)
                    pieces.append(piece)
                    size += len(piece)
                    if size >= _CHUNK:
                        flush(ids, starts, pieces, out)
                        ids, starts, pieces, size = [], [], [], 0
            flush(ids, starts, pieces, out)
            if out:
                yield pd.DataFrame(
                    {
                        "doc_id": np.concatenate([x[0] for x in out]),
                        "pos": np.concatenate([x[1] for x in out]).astype(np.int64),
                        "h": np.concatenate([x[2] for x in out]).view(np.int64),
                    }
                )

    return run


def _lcp(a: str, b: str) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@F.pandas_udf(T.IntegerType())
def _common_start(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcp(x, y) for x, y in zip(a, b)], dtype="int32")


def _meet(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(a, b, one_a, one_b)``: for each link (a, b) every member ``one`` of a with every one of b; what has no members is its own.

    A large group is cut into slices on one side, and each slice meets a copy of the other side, so that no task makes all its pairs.
    """
    sizes = members.groupBy("of").agg(F.ceil(F.count("*") / _SLICE).cast("int").alias("slices")).where("slices > 1")
    own = lambda one, of: F.coalesce(one, of) if links.schema["a"].dataType == members.schema["one"].dataType else F.col(one)
    first = links.join(members.select(F.col("of").alias("a"), F.col("one").alias("one_a")), "a", "left").withColumn("one_a", own("one_a", "a"))
    first = first.join(sizes.select(F.col("of").alias("b"), "slices"), "b", "left")
    first = first.withColumn("slice", F.pmod(F.xxhash64("one_a"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    second = members.join(sizes, "of", "left").select(F.col("of").alias("b"), F.col("one").alias("one_b"), F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice"))
    return first.join(second, ["b", "slice"], "left").select("a", "b", "one_a", own("one_b", "b").alias("one_b"))


class SharedSpans:
    """Spans of at least ``least`` characters that occur verbatim in more than one document.

    ``anchors`` of ``k`` characters are winnowed so densely that every span of ``least``
    characters holds one at the same place in each document. Only anchors that two
    documents have are looked at again: the text around them, ``least - k``
    characters on either side, is all that can decide whether they lie in a long
    enough span. Anchors with equal surroundings form a class; only classes are
    compared with each other, and only those that agree on enough of the surroundings:
    if both sides together extend by ``least - k``, then for some multiple d of ``step``
    the left agrees on d characters and the right on ``least - k - step - d`` at least. Where more than
    ``busy`` classes agree on that, exact codes of both sides take the place of pairs (see ``_candidates``); the result is the same.

    Defined cases: documents with null id or null text, and those shorter than ``least``,
    share nothing. Characters are Unicode code points. A document that repeats a span
    in itself alone shares nothing. Repeated rows of one doc_id count as one document.
    Other columns play no part. Texts of any length are hashed in bounded pieces.

    Scale: the corpus is read twice, its text shuffled once and only by the surroundings
    step; anchors are two per ``least - k + 2`` characters. Copies in any number make one class. Classes that share
    less than ``least`` are never paired in number, and pairs are made for ``pairs`` alone, which owes them.
    """

    def __init__(self, documents: DataFrame, least: int = 400, k: int = 200, step: int = 50, doc_id: str = "doc_id", text: str = "text", busy: int = 64):
        assert 0 < step <= least - k and k > 0
        ship(documents.sparkSession)
        self.least, self.k, self.side, self.step, self.busy = least, k, least - k, step, busy
        docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(
            (F.col("doc_id").isNotNull()) & (F.length("text") >= least)
        )
        kind = docs.schema["doc_id"].dataType.simpleString()
        # equal texts are one record from here on; an id with several texts stays out of this
        single = docs.groupBy("doc_id").agg(F.min(F.md5("text")).alias("t"), F.max(F.md5("text")).alias("u")).where("t = u").select("doc_id", "t")
        copied = single.groupBy("t").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last")
        self.copies = stored(single.join(copied, "t").select("doc_id", "rep", "last"), "copies")
        anchors = docs.mapInPandas(_anchors(k, self.side + 1), f"doc_id {kind}, pos long, h long")
        anchors = stored(anchors.join(self.copies.where("doc_id <> rep").select("doc_id"), "doc_id", "left_anti"), "anchors")
        lasts = self.copies.where("doc_id = rep").select("doc_id", "last")
        common = anchors.join(lasts, "doc_id", "left").groupBy("h").agg(F.min("doc_id").alias("lo"), F.max(F.coalesce("last", "doc_id")).alias("hi")).where("lo <> hi").select("h")
        wanted = anchors.join(common, "h", "left_semi").distinct()
        places = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("h", "pos")).alias("at"))  # as many as a text has anchors
        places = places.join(lasts, "doc_id", "left").withColumn("last", F.coalesce("last", "doc_id"))
        around = docs.join(places, "doc_id").select("doc_id", "last", "text", F.explode("at").alias("at"))
        first = F.col("at.pos").cast("int") + 1
        left_start = F.greatest(F.lit(1), first - self.side)
        self.seeds = stored(
            around.select(
                "doc_id", "last", F.col("at.h").alias("h"), F.col("at.pos").alias("pos"),
                F.substr("text", left_start, first - left_start).alias("left"),
                F.substr("text", first, F.lit(k)).alias("seed"),
                F.substr("text", first + k, F.lit(self.side)).alias("right"),
            ).withColumn("cls", F.md5(F.concat_ws("\x00", "left", "seed", "right"))),
            "seeds",
        )

    def classes(self) -> DataFrame:
        """One row per anchor and surroundings: its text, and the first and last document that has it."""
        return self.seeds.groupBy("h", "cls").agg(
            F.min("left").alias("left"), F.min("seed").alias("seed"), F.min("right").alias("right"),
            F.min("doc_id").alias("lo"), F.max("last").alias("hi"),
        )

    def _candidates(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Classes; pairs ``(h, cls_a, cls_b)`` that may extend far enough; and the classes under busy keys, cut exactly.

        A key that more than ``self.busy`` classes have is not paired: each of its classes is cut at every place
        ``at`` that the key stands for, with the exact characters on both sides (``code``), so that classes with
        equal codes share a long enough span for certain, however many classes miss it by a character. ``ahead`` is the character that follows on the left.
        """
        classes = stored(self.classes().withColumn("back", F.reverse("left")), "classes")
        need = self.side - self.step
        keys = [
            F.when(
                (F.length("back") >= d) & (F.length("right") >= need - d),
                F.struct(F.xxhash64("h", F.lit(d), F.substring("back", 1, d), F.substring("right", 1, need - d)).alias("key"), F.lit(d).alias("d")),
            )
            for d in range(0, need + 1, self.step)
        ]
        # a left side that agrees on more than `need` characters needs nothing on the right
        whole = F.when(F.length("back") >= self.side, F.struct(F.xxhash64("h", F.lit(-1), F.col("back")).alias("key"), F.lit(self.side).alias("d")))
        keyed = classes.select("h", "cls", F.explode(F.array_compact(F.array(*keys, whole))).alias("k")).select("h", "cls", "k.key", "k.d")
        shared = keyed.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", (F.col("n") > self.busy).alias("crowded"))
        keyed = stored(keyed.join(shared, "key"), "keys")
        few = keyed.where("not crowded")
        pairs = (
            few.select("key", "h", F.col("cls").alias("cls_a"))
            .join(few.select("key", "h", F.col("cls").alias("cls_b")), ["key", "h"])
            .where("cls_a < cls_b")
            .select("h", "cls_a", "cls_b")
        )
        spread = F.sequence(F.col("d"), F.least(F.col("d") + self.step - 1, F.lit(self.side)))
        places = keyed.where("crowded").select("h", "cls", F.explode(F.when(F.col("d") == self.side, F.array(F.lit(self.side))).otherwise(spread)).alias("at")).distinct()
        left, right = F.substr("back", F.lit(1), F.col("at")), F.substr("right", F.lit(1), self.side - F.col("at"))
        cut = (
            places.join(classes, ["h", "cls"]).where((F.length("back") >= F.col("at")) & (F.length("right") >= self.side - F.col("at")))
            .select("h", "cls", "lo", "hi", "at", F.xxhash64("h", "at", left, right).alias("code"), F.substr("back", F.col("at") + 1, F.lit(1)).alias("ahead"))
        )
        return classes, pairs, cut

    def class_pairs(self) -> DataFrame:
        """``(h, cls_a, cls_b, before, after)``: classes whose anchors extend to a long enough common span, and by how much.

        Also the first and last document of each. The places of both may all lie in one document.
        """
        classes, pairs, cut = self._candidates()
        cut = stored(cut.select("h", "cls", "code", F.when(F.col("at") == self.side, "").otherwise(F.col("ahead")).alias("ahead")), "cuts")
        # a pair is made where its left sides part: between classes of different next characters, or where the text ends
        heads = cut.groupBy("h", "code", "ahead").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
        other = heads.select("h", "code", F.col("ahead").alias("ahead_b"))
        parted = heads.join(other, ["h", "code"]).where("ahead < ahead_b or (ahead = '' and ahead_b = '' and lo <> hi)")
        member = lambda s, ahead: cut.select("h", "code", F.col("ahead").alias(ahead), F.col("cls").alias(f"cls_{s}"))
        exact = parted.select("h", "code", "ahead", "ahead_b").join(member("a", "ahead"), ["h", "code", "ahead"]).join(member("b", "ahead_b"), ["h", "code", "ahead_b"])
        exact = exact.where("cls_a <> cls_b").select("h", F.least("cls_a", "cls_b").alias("cls_a"), F.greatest("cls_a", "cls_b").alias("cls_b"))
        return self._extended(classes, pairs.unionByName(exact).distinct())

    def _extended(self, classes: DataFrame, pairs: DataFrame) -> DataFrame:
        side = lambda s: classes.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "back", "seed", "right", "lo", "hi")])
        both = pairs.join(side("a"), ["h", "cls_a"]).join(side("b"), ["h", "cls_b"]).where("seed_a = seed_b")
        return both.select(
            "h", "cls_a", "cls_b", "lo_a", "hi_a", "lo_b", "hi_b", _common_start("back_a", "back_b").alias("before"), _common_start("right_a", "right_b").alias("after")
        ).where(F.col("before") + F.col("after") >= self.side)

    def _reaches(self) -> DataFrame:
        """``(h, cls, before, after, lo, hi)``: how far spans shared with another class reach around an anchor, and the first and last document that shares them.

        Under busy keys no pairs are made: classes of one code share that stretch, and as all stretches of
        a class hold its anchor, the outermost ends of those that two documents have are what they cover together.
        """
        classes, pairs, cut = self._candidates()
        known = stored(self._extended(classes, pairs.distinct()), "class-pairs")
        reach = lambda s, o: known.select("h", F.col(f"cls_{s}").alias("cls"), "before", "after", F.col(f"lo_{o}").alias("lo"), F.col(f"hi_{o}").alias("hi"))
        cut = stored(cut, "cuts")
        busy = cut.groupBy("h", "code").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
        wide = cut.select("h", "cls", "code", "at").join(busy, ["h", "code"]).groupBy("h", "cls").agg(
            F.max("at").alias("before"), (self.side - F.min("at")).alias("after"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        )
        return reach("a", "b").unionByName(reach("b", "a")).unionByName(wide)

    def _within(self) -> DataFrame:
        return self.classes().where((F.col("lo") != F.col("hi")) & (F.length("left") + F.length("right") >= self.side)).select("h", "cls")

    def pairs(self) -> DataFrame:
        """Distinct ``(doc_a, doc_b)``, doc_a < doc_b, that share a long enough span."""
        alike = self._within().select(F.col("cls").alias("a"), F.col("cls").alias("b"))
        linked = self.class_pairs().select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).unionByName(alike)
        members = self.seeds.select(F.col("cls").alias("of"), F.col("doc_id").alias("one")).distinct()
        texts = _meet(linked, members).where("one_a <> one_b").select(F.least("one_a", "one_b").alias("a"), F.greatest("one_a", "one_b").alias("b")).distinct()
        same = self.copies.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()
        docs = self.copies.select(F.col("rep").alias("of"), F.col("doc_id").alias("one"))
        found = _meet(texts.unionByName(same), docs).where("a <> b or one_a < one_b")
        return found.select(F.least("one_a", "one_b").alias("doc_a"), F.greatest("one_a", "one_b").alias("doc_b")).distinct()

    def stretches(self) -> DataFrame:
        """``(doc_id, start, stop)``: the maximal stretches of each text made up of shared spans, not overlapping; of copies the first stands for all."""
        k = F.lit(self.k)
        within = self._within().join(self.classes().select("h", "cls", F.length("left").alias("before"), F.length("right").alias("after"), "lo", "hi"), ["h", "cls"])
        reaches = self._reaches().unionByName(within).distinct()
        spans = self.seeds.select("h", "cls", "doc_id", "pos").join(reaches, ["h", "cls"])
        # the other side must have a document besides this one
        spans = spans.where((F.col("lo") != F.col("doc_id")) | (F.col("hi") != F.col("doc_id")))
        shared = spans.select("doc_id", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + k + F.col("after")).alias("stop")).distinct()
        order = Window.partitionBy("doc_id").orderBy("start", "stop")
        fresh = F.coalesce(F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
        island = shared.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(order))
        return island.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")

    def shares(self, documents: DataFrame) -> DataFrame:
        """``(doc_id, n_chars, shared_chars, shared_share)`` for every row of ``documents``; a null text has no characters."""
        covered = self.stretches().groupBy("doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("shared_chars"))
        others = self.copies.where("doc_id <> rep").join(covered.withColumnRenamed("doc_id", "rep"), "rep").select("doc_id", "shared_chars")
        covered = covered.unionByName(others)
        sizes = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
        shared: Column = F.coalesce("shared_chars", F.lit(0).cast("long"))
        return sizes.join(covered, "doc_id", "left").select(
            "doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared_share")
        )
