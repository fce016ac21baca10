"""The Jaccard join against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quillweave.llm import jaccard_join
from tests.llm.conftest import TEXTS


def brute(rows, words=5, percent=80):
    """key -> sorted [(size, component)], by comparing every pair of sets of word tuples."""
    sets = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append({tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both) and sets[j]:
                up[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (key, _) in enumerate(rows):
        low.setdefault(top(i), []).append(key)
    least = {t: min((k for k in ks if k is not None), default=None) for t, ks in low.items()}
    return sorted(((key, len(sets[i]), least[top(i)]) for i, (key, _) in enumerate(rows)), key=repr)


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(seed, n=70):
    """Groups of near copies about the threshold, passages that many share, short texts, chains."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(n):
        size = r.choice([1, 2, 3, 4, 5, 6, 9, 14, 20, 30, 60, 150])
        base = [r.choice(vocabulary) for _ in range(size)]
        if r.random() < 0.4:
            at = r.randint(0, size)
            base[at:at] = passage
        texts.append(base)
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            near = list(r.choice(texts[-4:]))
            for _ in range(r.randint(0, max(1, len(near) // 25))):
                near[r.randrange(len(near))] = r.choice(vocabulary)
            texts.append(near)
    return [(i * 7 % 10_007, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_linked_by_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute(rows)
    assert as_rows(jaccard_join.linked(df)) == want
    assert len({c for _, _, c in want}) < len(rows)


@pytest.mark.parametrize("boundary", [15, 40, 10_000])
def test_any_boundary_is_right(spark, monkeypatch, boundary):
    """Lists only, both, and subsets for nearly all give the same links."""
    monkeypatch.setattr(jaccard_join, "_boundary", lambda classes, percent: boundary)
    rows = corpus(3, 40)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert as_rows(jaccard_join.linked(df)) == brute(rows)


def apart(n, words, changed, seed, vocabulary=None):
    """Texts of one base with some words changed: few of them link, all share most n-grams."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(n):
        near = list(base)
        for k in range(changed):
            near[r.randrange(words)] = r.choice(vocabulary) if vocabulary else f"x{i}.{k}"
        rows.append((i, " ".join(near)))
    return rows


def verified(monkeypatch):
    """The number of pairs that are compared from now on, as a list of counts."""
    counts, old = [], jaccard_join._verified

    def counted(pairs, sets, percent):
        counts.append(pairs.count())
        return old(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    return counts


@pytest.mark.parametrize("light", [2])
def test_heavy_lists_by_differences(spark, monkeypatch, light):
    """With nearly every open list heavy, the differences give the same links."""
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    calls, old = [], jaccard_join._differences
    monkeypatch.setattr(jaccard_join, "_differences", lambda *a: calls.append(1) or old(*a))
    r = random.Random(light)
    rows = [(1000 + k, t) for k, t in corpus(4, 25)]
    rows += [(k, t) for k, t in apart(40, 60, 1, 3)] + [(100 + k, t + " " + " ".join(f"z{k}.{j}" for j in range(r.randint(0, 9)))) for k, t in apart(40, 40, 1, 5)]
    rows += [(200 + k, t) for k, t in apart(40, 90, 2, 7, vocabulary=["u", "v", "w"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    assert as_rows(jaccard_join.linked(df)) == brute(rows)
    assert calls


@pytest.mark.parametrize("words, changed", [(60, 1), (60, 3)])
def test_compared_pairs_grow_in_proportion(spark, monkeypatch, words, changed):
    """A base that ever more texts share: pairs to compare grow with the texts, not with their square."""
    vocabulary = [f"v{i}" for i in range(3000)]
    most = []
    for n in (200, 400):
        counts = verified(monkeypatch)
        rows = apart(n, words, changed, n, vocabulary)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
        assert as_rows(jaccard_join.linked(df)) == brute(rows)
        most.append(sum(counts))
    assert most[1] <= 2.6 * most[0] + 100, most


def test_large_group_of_near_copies(spark):
    """One group with most rows: hubs link it without pairing it out."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        near = list(base)
        near[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(near)))
    rows += [(1000 + i, f"other text number {i} stands quite alone here {i} and {i} again") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {k: c for k, _, c in jaccard_join.linked(df).collect()}
    assert all(got[i] == 0 for i in range(400)) and all(got[1000 + i] == 1000 + i for i in range(50))


def test_repeated_row_alone_in_two_partitions(spark):
    """Blocks with the same rows stay apart: the row's n-grams count once, and its near copy is linked."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:59], "other"])
    rows = [(5, " ".join(words)), (5, " ".join(words)), (3, near)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id bigint, text string")
    assert df.rdd.glom().map(len).collect() == [1, 1, 1]
    assert as_rows(jaccard_join.linked(df)) == brute(rows)
    assert [r["doc_id"] for r in jaccard_join.one_of_each(df).collect()] == [3]


def test_blocks_are_cut_by_bytes(spark, monkeypatch):
    """A long text is a block of its own; small blocks and large keys give the same groups."""
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 400)
    monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", 0)
    long = " ".join(f"w{i % 97}.{i % 89}" for i in range(3000))
    rows = corpus(6, 12) + [(5001, long), (5002, long + " more"), (5003, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    assert as_rows(jaccard_join.linked(df)) == brute(rows)


def test_linked_odd_rows(odd_documents, no_documents):
    assert as_rows(jaccard_join.linked(odd_documents)) == brute(TEXTS)
    assert jaccard_join.linked(no_documents).collect() == []


def test_one_of_each(odd_documents, no_documents):
    kept = jaccard_join.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    keys = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    # 2 and its repetition repeat 1, and 8 repeats 7; texts without words stay
    want = sorted([1, 3, 4, 5, 6, 7, 9, 10, 11, 12, None, None], key=repr)
    assert keys == want
    twice = odd_documents.unionByName(odd_documents)
    counts = {r["doc_id"]: r["count"] for r in jaccard_join.one_of_each(twice).groupBy("doc_id").count().collect()}
    assert counts.pop(3) == counts.pop(4) == counts.pop(5) == 2 and counts.pop(None) == 3 and set(counts.values()) == {1}
    assert jaccard_join.one_of_each(no_documents).collect() == []


def test_formulas_agree():
    for n in range(1, 3000):
        need = jaccard_join.least_common(n, 80)
        assert need == -(-n * 4 // 5)
        assert jaccard_join.least_shared(n, 80) <= jaccard_join.slack(n)


def test_sql_formulas(spark):
    df = spark.range(1, 500).select("id", *[F.expr(jaccard_join._sql(f, "id", 80)).alias(f.__name__) for f in (jaccard_join.prefix, jaccard_join.least_shared)])
    for r in df.collect():
        assert r["prefix"] == min(r["id"], jaccard_join.prefix(r["id"], 80)) and r["least_shared"] == jaccard_join.least_shared(r["id"], 80)
