import random
import re

from veriplane.llm.leaks import common_subsequence, find_leaks, longest_run, split_words

VOCAB = [f"w{i}" for i in range(400)]


def test_exact_measures():
    rng = random.Random(8)
    for _ in range(60):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 14))] for _ in range(2))
        run = max((k for k in range(len(b) + 1) for i in range(len(b) - k + 1) if k == 0 or any(a[j : j + k] == b[i : i + k] for j in range(len(a) - k + 1))), default=0)
        assert longest_run(a, b) == run
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_subsequence(a, b) == table[-1][-1]


def test_words():
    assert split_words("Ab-1é K'x\n") == [b"ab", b"1", b"k", b"x"]


def test_recall_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(VOCAB) for _ in range(40)) + "? Answer in one line.") for i in range(12)]
    words = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in items}
    docs = []
    for d in range(150):
        body = [rng.choice(VOCAB[200:]) + str(rng.randrange(3)) for _ in range(rng.randint(5, 400))]
        if d % 3 == 0:
            i, n = rng.randrange(12), rng.choice([8, 11, 12, 13, 30])
            s = rng.randrange(len(words[i]) - n + 1)
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() if d % 2 else w for w in words[i][s : s + n]]
        docs.append((d, ", ".join(body), "x", 1))
    docs += [(900, None, "x", 1), (901, "", "x", 1), (902, "!!", "x", 1), (None, items[0][1], "x", 1), (903, items[0][1] * 2, "x", 1), (903, items[0][1], "x", 1), (904, "long " * 120_000 + items[1][1], "x", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, cosine string, item_id int")
    q = spark.createDataFrame([(*r, 1) for r in items] + [items[0] + (1,), (None, "x", 1), (77, None, 1), (78, "", 1)], "item_id long, text string, cosine int")
    grams = {}
    for i, w in words.items():
        for j in range(len(w) - 11):
            grams.setdefault(tuple(w[j : j + 12]), set()).add(i)
    want = set()
    for doc, text, *_ in docs:
        if doc is not None and text:
            w = re.findall("[a-z0-9]+", text.lower())
            for j in range(len(w) - 11):
                want |= {(doc, i) for i in grams.get(tuple(w[j : j + 12]), ())}
    for block in (2000, 4):
        got = find_leaks(d, q, block_items=block).where("run_words >= 12").collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_recall_of_a_passage_in_a_third_of_the_documents(spark):
    rng = random.Random(10)
    items = [(i, " ".join(f"i{i}x{j}" for j in range(40))) for i in range(4)]
    hot = items[0][1].split()
    rare = lambda n: [f"r{rng.randrange(10**9)}" for _ in range(n)]
    docs = [(d, " ".join(rare(50) + hot + rare(50) if d % 3 == 0 else rare(120))) for d in range(300)]
    want = {d for d in range(0, 300, 3)}
    for d in range(1, 300, 6):  # just a run, at any place of a passage
        s, before = rng.randrange(len(hot) - 11), rng.randrange(40)
        docs[d] = (d, " ".join(rare(before) + hot[s : s + 12] + rare(60)))
        want.add(d)
    docs[2] = (2, " ".join(rare(30) + hot[:11] + ["x"] + hot[12:23]))
    out = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = out.where("run_words >= 12").collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, 0) for d in want} and len(got) == len(want)


def test_paraphrase_and_answer(spark):
    item = "the quiet lodger keeps nine stamps in a blue tin beside the east window of the old mill? reply with a number only"
    near = item.replace("quiet", "silent").replace("blue", "green").replace("mill", "barn").replace("nine", "some nine")
    rows = [(1, near), (2, "nothing of the kind happens in this entirely different sentence about harbour fees and weather reports")]
    out = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    got = {r.doc_id: r for r in out}
    assert got[1].lcs_share > 0.8 and got[1].answer_share == 1.0 and got[1].run_words < 12
    assert 2 not in got or got[2].lcs_share < 0.4


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert find_leaks(empty, items).count() == 0
    assert find_leaks(items.withColumnRenamed("item_id", "doc_id"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_many_items_take_one_scan(spark):
    rng = random.Random(12)
    words = [f"v{i}" for i in range(6000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(3000)]
    docs = []
    for d in range(240):
        body = [rng.choice(words) for _ in range(80)]
        if d % 4 == 0:
            w = items[d * 12][1].split()
            body[30:30] = w[5:20] if d % 8 else [x if n % 7 else rng.choice(words) for n, x in enumerate(w)]  # a run, or the whole item reworded here and there
        docs.append((d, " ".join(body)))
    out = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    got = {(r.doc_id, r.item_id): r for r in out.where("run_words >= 12 or lcs_share >= 0.6").collect()}
    want = {(d, d * 12) for d in range(0, 240, 4)}
    assert set(got) == want and all(got[d, i].run_words >= 12 for d, i in want if d % 8) and all(got[d, i].lcs_share > 0.75 for d, i in want if not d % 8)
