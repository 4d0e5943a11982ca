import itertools
import os
import random

import pytest

from veriplane.llm.packing import TOKENIZER, fullest, pack, pack_documents, plan_bins


def test_fullest_is_optimal():
    rng = random.Random(6)
    for _ in range(60):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 40)
        got = fullest(sorted(counts, reverse=True), counts, room)
        assert all(q <= counts[n] for n, q in got)
        best = max(s for q in itertools.product(*[range(c + 1) for c in counts.values()]) if (s := sum(n * k for n, k in zip(counts, q))) <= room)
        assert sum(n * q for n, q in got) == best


def test_plan_uses_everything():
    rng = random.Random(7)
    hist = {n: rng.randint(1, 40) for n in rng.sample(range(1, 101), 60)}
    plan = plan_bins(hist, 100)
    used = {}
    for _, times, need in plan:
        assert sum(n * q for n, q in need) <= 100
        for n, q in need:
            used[n] = used.get(n, 0) + times * q
    assert used == hist
    first_fit: list[int] = []
    for n in sorted((n for n, c in hist.items() for _ in range(c)), reverse=True):
        at = next((i for i, room in enumerate(first_fit) if room >= n), None)
        if at is None:
            first_fit.append(100 - n)
        else:
            first_fit[at] -= n
    assert sum(t for _, t, _ in plan) <= len(first_fit)


def test_pack_pieces_ties_and_buckets(spark):
    rows = [(i, n) for i, n in enumerate([5] * 200 + [3, 0, None, -4, 25, 10, 7, 7])] + [(0, 5)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, n_tokens long, container_id int")
    for bucket_rows in (10, 500_000):
        out = pack(df, 10, bucket_rows=bucket_rows).collect()
        fill = {}
        for r in out:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert max(fill.values()) <= 10 and set(fill) == set(range(len(fill)))
        assert sum(fill.values()) == 5 * 201 + 3 + 25 + 10 + 14
        assert sorted((r.piece_no, r.first_token, r.n_tokens) for r in out if r.doc_id == 204) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
        assert len(fill) <= (5 * 201 + 3 + 25 + 10 + 14) // 10 + 2


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 10).count() == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer")
def test_texts(spark):
    df = spark.createDataFrame([(1, "a b c", 1), (2, "", 1), (3, None, 1), (4, "word " * 3000, 1), (5, "<|endoftext|> é", 1)], "doc_id long, text string, piece_no int")
    out = pack_documents(df, 64).collect()
    size = {}
    for r in out:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
    assert size[1] == 3 and size[2] == size[3] == 0 and size[4] > 2990 and size[5] > 3
