import random

import numpy as np

from veriplane.llm.spans import SharedSpans, winnow

LEAST = 60


def sharing(texts):
    seen = {}
    for d, t in texts.items():
        for i in range(len(t) - LEAST + 1):
            seen.setdefault(t[i : i + LEAST], set()).add(d)
    pairs, covered = set(), {d: set() for d in texts}
    for gram, docs in seen.items():
        if len(docs) > 1:
            pairs |= {(a, b) for a in docs for b in docs if a < b}
            for d in docs:
                at = texts[d].find(gram)
                while at >= 0:
                    covered[d].update(range(at, at + LEAST))
                    at = texts[d].find(gram, at + 1)
    return pairs, {d: len(c) for d, c in covered.items()}


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(3, 9)))
    text = lambda n: "".join(word() for _ in range(n))[: n * 5]
    shared = [text(40) for _ in range(6)]
    out = {}
    for d in range(60):
        parts = [text(rng.randint(2, 60))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            n = rng.choice([LEAST - 1, LEAST, LEAST + 1, 150])
            at = rng.randrange(max(1, len(s) - n))
            parts += [s[at : at + n], text(rng.randint(1, 20))]
        out[d] = "".join(parts)
    out[100] = out[101] = out[102] = text(50)
    out[103] = "a" * 500
    out[104] = "b" + "a" * LEAST
    out[105] = "a" * (LEAST - 1)
    out[106] = (text(30) + "|") * 2
    return out


def test_pairs_and_shares_match_brute_force(spark):
    texts = corpus()
    rows = [(d, t, "x", 1) for d, t in texts.items()] + [(200, None, "x", 1), (201, "", "x", 1), (None, texts[100], "x", 1), (5, texts[5], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, left string, h int")
    pairs, covered = sharing(texts)
    assert len(pairs) > 20
    for k, step in ((30, 10), (20, 40), (59, 1)):
        found = SharedSpans(df, LEAST, k, step)
        got = found.pairs().collect()
        assert {tuple(r) for r in got} == pairs and len(got) == len(pairs)
    # the same where every key counts as busy
    crowded = SharedSpans(df, LEAST, 20, 8, busy=0)
    assert {tuple(r) for r in crowded.pairs().collect()} == pairs
    shares = {r.doc_id: r.shared_chars for r in crowded.shares(df.where("doc_id is not null")).collect()}
    assert {d: shares[d] for d in covered} == covered
    shares = {r.doc_id: r.shared_chars for r in SharedSpans(df, LEAST, 30, 10).shares(df.where("doc_id is not null")).collect()}
    assert {d: shares[d] for d in covered} == covered and shares[200] == shares[201] == 0


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert SharedSpans(empty).pairs().count() == 0 and SharedSpans(empty).shares(empty).count() == 0


def test_every_window_has_an_anchor():
    rng = np.random.default_rng(1)
    codes = rng.integers(97, 100, 3000).astype(np.uint32)
    ends = np.asarray([700, 705, 1600, 3000])
    at, h = winnow(codes, ends, 10, 25)
    picked = set(at.tolist())
    start = 0
    for end in ends:
        for i in range(start, end - 10 - 25 + 2):
            assert picked & set(range(i, i + 25))
        assert all(p + 10 <= end for p in picked if start <= p < end)
        start = end
    again, g = winnow(codes[705:1600], np.asarray([895]), 10, 25)
    assert dict(zip((again + 705).tolist(), g.tolist())) == {p: x for p, x in zip(at.tolist(), h.tolist()) if 705 <= p < 1600}


def test_near_misses_are_not_paired(spark):
    """A stretch one character too short in every document, between characters of its own: no two documents are compared for it."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    short, n = text(LEAST - 1), 3000
    rows = [(d, f"{text(80)}{chr(0x4E00 + d)}{short}{chr(0x4E00 + d)}{text(80)}") for d in range(n)]
    long = text(LEAST + 3)
    rows[5], rows[6] = (5, f"x{long}y{short}"), (6, f"z{long}w{short}")
    found = SharedSpans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), LEAST, 30, 10)
    _, pairs, cut = found._candidates()
    assert pairs.count() < 100 and 10 * n < cut.count() < 500 * n
    assert {tuple(r) for r in found.pairs().collect()} == {(5, 6)}
    assert {r.doc_id: r.shared_chars for r in found.shares(spark.createDataFrame(rows, "doc_id long, text string")).where("shared_chars > 0").collect()} == {5: LEAST + 3, 6: LEAST + 3}


def test_a_large_class(spark):
    """Copies in slices: every pair once."""
    text = "".join(random.Random(4).choice("abcdefghij ") for _ in range(90))
    rows = [(d, text) for d in range(2300)] + [(3000, "x" + text)]
    got = SharedSpans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), LEAST, 30, 10).pairs()
    assert got.count() == 2301 * 2300 // 2
