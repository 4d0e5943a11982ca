"""Evaluation texts leaking into training text: latent semantic retrieval, then word runs, subsequences and answers."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriplane.runtime import drop_stored, ship, stored

_WORD_BYTES = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_MEMO: dict[bytes, int] = {}
_MEMO_ROOM = 1_000_000
#: Words projected at a time; bounds the memory of a Python worker whatever the texts are.
_CHUNK = 100_000
#: Item windows in a shard of the index, and tasks that the sample of passages is spread over.
_SHARD, _SAMPLE_TASKS = 2_000, 16


def split_words(text: str) -> list[bytes]:
    """Maximal runs of a-z and 0-9 after lower-casing."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def word_codes(words: list[bytes]) -> list[int]:
    if len(_MEMO) > _MEMO_ROOM:
        _MEMO.clear()
    memo, out = _MEMO, []
    for w in words:
        i = memo.get(w)
        if i is None:
            i = memo[w] = zlib.crc32(w)
        out.append(i)
    return out


def bucket_ids(words: list[bytes], buckets: int) -> list[int]:
    return [i % buckets for i in word_codes(words)]


def run_codes(codes: np.ndarray, length: int) -> np.ndarray:
    """A code of each run of ``length`` neighbouring words; equal runs have equal codes."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(length):  # modulo 2**64
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64)
    return out


def item_runs(texts: list[list[bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the items' runs of ``length`` words in ascending order and, for each, the index of its item."""
    each = [np.unique(run_codes(np.asarray(word_codes(words), dtype=np.uint64), length)) for words in texts]
    codes = np.concatenate(each)
    whose = np.repeat(np.arange(len(each)), [len(e) for e in each])
    order = np.argsort(codes, kind="stable")
    return codes[order], whose[order]


def longest_run(words: list[bytes], item: list[bytes]) -> int:
    """Length of the longest sequence of consecutive words that both contain."""
    places: dict[bytes, list[int]] = {}
    for j, w in enumerate(item):
        places.setdefault(w, []).append(j)
    best, before = 0, {}
    for w in words:
        now = {j: before.get(j - 1, 0) + 1 for j in places.get(w, ())}
        if now:
            best = max(best, max(now.values()))
        before = now
    return best


def common_subsequence(words: list[bytes], item: list[bytes]) -> int:
    """Length of the longest common subsequence; one long-integer step per word (bit-parallel)."""
    masks: dict[bytes, int] = {}
    for j, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << j
    every = (1 << len(item)) - 1
    row = every
    for w in words:
        m = masks.get(w)
        if m is not None:
            hit = row & m
            row = ((row + hit) | (row & ~m)) & every
    return len(item) - row.bit_count()


def stretches(numbers: set[int]) -> list[tuple[int, int]]:
    """First and last of each run of neighbouring numbers."""
    out: list[tuple[int, int]] = []
    for n in sorted(numbers):
        if out and n == out[-1][1] + 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


class LatentSpace:
    """Terms in hashed buckets, their inverse document frequencies, and a basis of the latent space.

    ``fit`` counts documents per bucket over all texts and finds the leading singular
    directions of the TF-IDF matrix of passages by a randomised range finder with power
    iterations. Its products run on the executors, a partition of passages at a time;
    the driver orthonormalises. The matrix holds the windows of the evaluation items
    and the passages of a sample of documents drawn by hash, of expected size
    ``sample_documents``: an index fitted on a bounded sample, applied to every text.
    """

    def __init__(self, idf: np.ndarray, basis: np.ndarray):
        self.idf, self.basis = idf, basis

    @property
    def buckets(self) -> int:
        return len(self.idf)

    @staticmethod
    def document_frequencies(texts: DataFrame, buckets: int) -> tuple[np.ndarray, float]:
        """Inverse document frequency of each bucket, and the number of documents; ``texts`` has one column, text."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, docs = np.zeros(buckets, dtype=np.int64), 0
            for batch in batches:
                for text in batch["text"]:
                    if text:
                        total[list(set(bucket_ids(list(set(split_words(text))), buckets)))] += 1
                docs += len(batch)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], docs)})

        rows = texts.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
        seen = np.zeros(buckets)
        inner = rows[rows["bucket"] >= 0]
        seen[inner["bucket"].to_numpy()] = inner["n"].to_numpy()
        n_docs = float(rows.loc[rows["bucket"] < 0, "n"].sum())
        return (np.log((n_docs + 1) / (seen + 1)) + 0.1).astype(np.float32), n_docs

    @classmethod
    def fit(
        cls, documents: DataFrame, windows: list[list[int]], buckets: int, rank: int, window: int, sample_documents: int, power: int = 2
    ) -> LatentSpace:
        idf, n_docs = cls.document_frequencies(documents.select("text"), buckets)
        share = min(1.0, sample_documents / max(1.0, n_docs))
        drawn = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
        drawn = stored(drawn.repartition(_SAMPLE_TASKS), "passages")
        width = rank + 10
        sc = documents.sparkSession.sparkContext
        rng = np.random.default_rng(7)
        probe = rng.standard_normal((buckets, width)).astype(np.float32)

        def multiply(rows: list[np.ndarray], right: np.ndarray, weight: float) -> np.ndarray:
            """A'(A right) for the unit TF-IDF rows of some passages."""
            out = np.zeros_like(right)
            if not rows:
                return out
            ids = np.concatenate(rows)
            starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
            values = idf[ids]
            norm = np.sqrt(np.add.reduceat(values**2, starts)) + 1e-9
            values = values / np.repeat(norm, [len(r) for r in rows])
            left = np.add.reduceat(values[:, None] * right[ids], starts, axis=0)
            spread = values[:, None] * np.repeat(left, [len(r) for r in rows], axis=0) * np.float32(weight)
            order = np.argsort(ids, kind="stable")
            firsts = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
            out[ids[order][firsts]] = np.add.reduceat(spread[order], firsts, axis=0)
            return out

        evaluation = [np.asarray(w, dtype=np.int64) for w in windows if len(w)]
        for _ in range(power + 1):
            shared = sc.broadcast(probe)

            def partial(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                right, total, n = shared.value, None, 0
                for batch in batches:
                    rows = []
                    for text in batch["text"]:
                        ids = np.asarray(bucket_ids(split_words(text), buckets) if text else [], dtype=np.int64)
                        rows += [ids[s : s + window] for s in range(0, len(ids), window)]
                        if len(rows) * window > _CHUNK:
                            part = multiply(rows, right, 1.0)
                            total, n, rows = part if total is None else total + part, n + len(rows), []
                    part = multiply(rows, right, 1.0)
                    total, n = part if total is None else total + part, n + len(rows)
                if n:
                    touched = np.flatnonzero(total.any(axis=1))
                    yield pd.DataFrame({"n": [n], "touched": [touched.astype(np.int64).tobytes()], "part": [total[touched].tobytes()]})

            sums, passages = np.zeros_like(probe), 0
            for row in drawn.mapInPandas(partial, "n long, touched binary, part binary").toLocalIterator():
                touched = np.frombuffer(row["touched"], dtype=np.int64)
                sums[touched] += np.frombuffer(row["part"], dtype=np.float32).reshape(len(touched), -1)
                passages += row["n"]
            # the evaluation side has four times the weight of the corpus side
            for s in range(0, len(evaluation), _SHARD):
                sums += multiply(evaluation[s : s + _SHARD], probe, 4.0 * max(1, passages) / len(evaluation))
            probe = np.linalg.qr(sums)[0].astype(np.float32)
            shared.destroy()
        drop_stored(drawn)
        return cls(idf, np.ascontiguousarray(probe[:, :rank]))


def unit_rows(windows: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of some windows, and the windows as unit TF-IDF rows over them."""
    terms = np.unique(np.concatenate(windows))
    dense = np.zeros((len(windows), len(terms)), dtype=np.float32)
    for n, w in enumerate(windows):
        ids, tf = np.unique(w, return_counts=True)
        dense[n, np.searchsorted(terms, ids)] = tf * idf[ids]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True) + 1e-9
    return terms, dense


class Shard:
    """Some windows of items as queries, in the latent space and the further directions that it takes for each to keep ``keep`` of its length.

    Without those the windows of a varied query set would fall outside the space, and be found by nothing. The
    further directions are ``own`` over the windows' ``terms`` less what the basis has of them (``mix``), so a shard
    is as small as its vocabulary.
    """

    def __init__(self, space: LatentSpace, windows: list[np.ndarray], whose: list[int], keep: float = 0.85):
        self.terms, rows = unit_rows(windows, space.idf)
        inside = space.basis[self.terms]
        base = rows @ inside
        own, mix = np.zeros((len(self.terms), 0), dtype=np.float32), np.zeros((inside.shape[1], 0), dtype=np.float32)
        for _ in range(8):
            further = rows @ own - base @ mix
            short = np.einsum("ij,ij->i", base, base) + np.einsum("ij,ij->i", further, further) < keep**2
            if not short.any():
                break
            lost = rows[short] - base[short] @ inside.T - further[short] @ (own - inside @ mix).T
            own = np.hstack([own, _leading(lost, keep**2)])
            mix = inside.T @ own
            # orthonormal outside the basis
            size, turn = np.linalg.eigh(own.T @ own - mix.T @ mix)
            good = size > 1e-4
            own = (own @ (turn[:, good] / np.sqrt(size[good]))).astype(np.float32)
            mix = inside.T @ own
        self.own, self.mix = _with_none(own * space.idf[self.terms][:, None]), mix
        self.queries = np.ascontiguousarray(np.hstack([base, rows @ own - base @ mix]).astype(np.float32))
        self.first_of = np.flatnonzero(np.r_[True, np.diff(whose) > 0])
        self.item_of = np.asarray(whose)[self.first_of]


def _with_none(table: np.ndarray) -> np.ndarray:
    """``table`` with a last row of zeros."""
    return np.concatenate([table, np.zeros_like(table[:1])])


def _leading(rows: np.ndarray, share: float) -> np.ndarray:
    """The leading right singular directions of ``rows`` that hold ``share`` of its energy, as columns."""
    sizes, left = np.linalg.eigh(rows @ rows.T)
    order = np.argsort(-sizes)
    sizes, left = np.maximum(sizes[order], 0), left[:, order]
    need = min(int(np.searchsorted(np.cumsum(sizes), share * sizes.sum())) + 1, int((sizes > 1e-6).sum()) or 1)
    return rows.T @ left[:, :need] / np.sqrt(np.maximum(sizes[:need], 1e-9))


def make_shards(documents: DataFrame, space: LatentSpace, windows: list[list[int]], whose: list[int]) -> list[Shard]:
    """The windows in shards of ``_SHARD``, each made by a task."""
    spark = documents.sparkSession
    rows = [(pickle.dumps((windows[s : s + _SHARD], whose[s : s + _SHARD])),) for s in range(0, len(windows), _SHARD)]
    shared = spark.sparkContext.broadcast(space)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch["part"]:
                some, items = pickle.loads(part)
                yield pd.DataFrame({"shard": [pickle.dumps(Shard(shared.value, [np.asarray(w, dtype=np.int64) for w in some], items))]})

    parts = spark.createDataFrame(rows, "part binary").repartition(len(rows))
    return [pickle.loads(r["shard"]) for r in parts.mapInPandas(build, "shard binary").toLocalIterator()]


def item_windows(items: list[tuple], buckets: int, window: int, stride: int) -> tuple[list[list[int]], list[int]]:
    """Windows of bucket ids of the items and, for each, the index of its item."""
    out, whose = [], []
    for n, (_, text) in enumerate(items):
        ids = bucket_ids(split_words(text), buckets)
        last = max(0, len(ids) - window)
        for s in sorted({*range(0, last + 1, stride), last}):
            if ids:
                out.append(ids[s : s + window])
                whose.append(n)
    return out, whose


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    least_words: int = 12,
    similarity: float = 0.3,
    rank: int = 64,
    buckets: int = 1 << 15,
    sample_documents: int = 2000,
    block_items: int = 20_000,
) -> DataFrame:
    """``(doc_id, item_id, cosine, run_words, lcs_share, answer_share)`` for documents near an item.

    Documents are cut into passages of two blocks of ``least_words`` words, overlapping by one, so
    that any run of ``least_words`` words lies whole in a passage. Passages and windows of the
    items are compared by cosine in the latent space (see ``LatentSpace``), divided by the
    norms in the full space; the space has ``rank`` latent directions, and those that it takes
    for every window of the items to keep 0.85 of its length (see ``Shard``). A pair with ``similarity`` or more is a candidate, and
    so is, whatever its cosine, one that shares a run of ``least_words`` words: the cosine of a run falls as its
    words get frequent, so an item that leaked often would be lost. Around its
    candidate passages the document is then compared exactly: ``run_words`` is the longest
    run of consecutive words it shares with the item, ``lcs_share`` the longest common
    subsequence as a share of the item's words, and ``answer_share`` that of the words
    after the item's last question mark (of the whole item if there are none).

    Defined cases: null and empty texts, and texts without words, match nothing; rows with
    a null id are ignored; a doc_id or item_id that occurs in several rows gives the best
    of them in each column; an empty table gives no rows. Other columns play no part.

    Scale: three scans of all texts, whatever the number of items up to ``block_items``: one counts, one keeps the
    sample that the basis is fitted on, one searches; no text is shuffled. More items are worked off in blocks, with
    a search each. Broadcast are the basis (buckets * rank numbers) and the items' windows in shards of a fixed
    number of windows, each with its own directions. Words are projected in bounded pieces.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    wanted = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    kinds = [docs.schema["doc_id"].dataType.simpleString(), wanted.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, run_words long, lcs_share double, answer_share double"
    blocks = max(1, -(-wanted.count() // block_items))
    found = spark.createDataFrame([], schema)
    space = None
    for b in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        rows = [(r["item_id"], r["text"]) for r in block.collect()]
        windows, whose = item_windows(rows, buckets, 2 * least_words, max(1, least_words // 3))
        if not windows:
            continue
        if space is None:
            space = LatentSpace.fit(docs, windows, buckets, rank, 2 * least_words, sample_documents)
        shards = make_shards(docs, space, windows, whose)
        found = found.unionByName(_search(docs, rows, shards, space, least_words, similarity, schema))
    best = [F.max(c).alias(c) for c in ("cosine", "run_words", "lcs_share", "answer_share")]
    return found.groupBy("doc_id", "item_id").agg(*best)


def _search(docs: DataFrame, rows: list, shards: list[Shard], space: LatentSpace, block: int, similarity: float, schema: str) -> DataFrame:
    buckets, idf = space.buckets, space.idf
    texts = []
    for item_id, text in rows:
        words = split_words(text)
        answer = split_words(re.split(r"\?", text)[-1])
        texts.append((item_id, words, answer or words))
    runs = item_runs([words for _, words, _ in texts], block)
    base = _with_none((space.basis * idf[:, None]).astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast((base, _with_none(idf**2), shards, texts, runs))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out: list[tuple] = []
            group: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = split_words(text)
                # a long text goes in pieces that overlap by one passage
                for s in range(0, max(1, len(words) - block), _CHUNK):
                    piece = words[s : s + _CHUNK + 2 * block]
                    if piece:
                        group.append((doc_id, piece))
                        size += len(piece)
                    if size >= _CHUNK:
                        scan(group, out, *known)
                        group, size = [], 0
            scan(group, out, *known)
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "run_words", "lcs_share", "answer_share"])

    def scan(group: list, out: list, base, idf2, shards, texts, runs) -> None:
        if not group:
            return
        codes = np.asarray([i for _, words in group for i in word_codes(words)])
        ids = codes % buckets
        lengths = np.asarray([len(words) for _, words in group])
        starts = np.cumsum(lengths) - lengths
        per_doc = -(-lengths // block)
        doc_of = np.repeat(np.arange(len(group)), per_doc)
        nth = np.arange(len(doc_of)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        cuts = starts[doc_of] + nth * block
        # a passage is a block and the next one of the same text
        follows = (doc_of[1:] == doc_of[:-1]).astype(np.float32)

        def passages(sums: np.ndarray) -> np.ndarray:
            sums[:-1] += sums[1:] * follows.reshape((-1,) + (1,) * (sums.ndim - 1))
            return sums

        # the words of each block, side by side; the last row of every table is for those that are not there
        block_of = np.repeat(np.arange(len(cuts)), np.diff(np.r_[cuts, len(ids)]))
        grid = np.full((block, len(cuts)), buckets, dtype=np.int32)
        grid[np.arange(len(ids)) - cuts[block_of], block_of] = ids

        def sums_of(table: np.ndarray, places: np.ndarray) -> np.ndarray:
            total = table[places[0]]
            for row in places[1:]:
                total += table[row]
            return total

        vectors = passages(sums_of(base, grid))
        scale = np.sqrt(passages(sums_of(idf2, grid))) + 1e-9
        length = np.einsum("ij,ij->i", vectors, vectors)
        # passages that begin a run of an item, and the item
        seen, (known, owner) = run_codes(codes, block), runs
        low = np.searchsorted(known, seen)
        at = np.flatnonzero(low < len(known))
        at = at[known[low[at]] == seen[at]]
        text_of = np.repeat(np.arange(len(group)), lengths)
        at = at[text_of[at] == text_of[at + block - 1]]
        many = np.searchsorted(known, seen[at], side="right") - low[at]
        place = np.repeat(low[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        passage = np.repeat(np.searchsorted(cuts, at, side="right") - 1, many)
        equal = np.unique(np.stack([passage, owner[place]], axis=1), axis=0)
        pairs: dict[tuple[int, int], float] = {(int(p), int(n)): 0.0 for p, n in equal}
        for shard in shards:
            slot = np.full(buckets + 1, len(shard.terms), dtype=np.int32)
            slot[shard.terms] = np.arange(len(shard.terms), dtype=np.int32)
            further = passages(sums_of(shard.own, slot[grid])) - vectors @ shard.mix
            # no query is longer than 1, so a shorter projection cannot reach the similarity
            close = length + np.einsum("ij,ij->i", further, further) >= (similarity * scale) ** 2
            mine = equal[np.isin(equal[:, 1], shard.item_of)]
            close[mine[:, 0]] = True
            near = np.flatnonzero(close)
            if not len(near):
                continue
            cosines = np.maximum.reduceat(np.hstack([vectors[near], further[near]]) @ shard.queries.T, shard.first_of, axis=1) / scale[near, None]
            wanted = cosines >= similarity
            wanted[np.searchsorted(near, mine[:, 0]), np.searchsorted(shard.item_of, mine[:, 1])] = True
            for r, c in zip(*np.nonzero(wanted)):
                pair = (int(near[r]), int(shard.item_of[c]))
                pairs[pair] = max(pairs.get(pair, 0.0), float(cosines[r, c]))
        hits: dict[tuple[int, int], list] = {}
        for (at, n), cosine in pairs.items():
            hit = hits.setdefault((int(doc_of[at]), n), [0.0, set()])
            hit[0] = max(hit[0], cosine)
            hit[1].update(range(int(nth[at]) - 2, int(nth[at]) + 4))
        for (d, n), (cosine, around) in hits.items():
            doc_id, words = group[d]
            item_id, item, answer = texts[n]
            run = lcs = said = 0
            for first, last in stretches(around):
                near_words = words[max(0, first) * block : (last + 1) * block]
                run = max(run, longest_run(near_words, item))
                lcs = max(lcs, common_subsequence(near_words, item))
                said = max(said, common_subsequence(near_words, answer))
            out.append((doc_id, item_id, min(1.0, cosine), run, lcs / len(item), said / len(answer)))

    return docs.mapInPandas(look, schema)
