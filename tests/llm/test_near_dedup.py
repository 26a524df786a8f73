"""Near-duplicates against comparisons of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanwork.llm import near_dedup, words


def corpus(n, seed):
    """Families of edited texts of all degrees, and groups that share long passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    fresh = lambda k: rng.choices(vocabulary, k=k)
    passage = fresh(60)
    rows = []
    while len(rows) < n:
        base = fresh(rng.choice([3, 6, 40, 120, 300]))
        if rng.random() < 0.3:
            base = passage + base[:20]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    return rows[:n]


def bag(text, weight):
    return near_dedup.bags(pa.array([text]), weight)[0]


def test_shared_weights_are_those_of_pairs():
    rng = random.Random(3)
    weight = np.random.default_rng(1).uniform(0.75, 1, 1 << near_dedup.SLOT_BITS).astype(np.float32)
    texts = [" ".join(rng.choices(["a", "b", "c"], k=rng.choice([1, 4, 9, 60, 300]))) for _ in range(30)] + ["", "x " * 5000, "x " * 70000]
    (_, _, rows, terms, counts), = near_dedup.shingle_terms(pa.array(texts))
    few, many = np.arange(0, 33, 2), np.arange(33)
    found = near_dedup.shared_weights(rows, terms, counts, weight, few, many)
    whole = [near_dedup.bags(pa.array([t]), weight)[0] for t in texts]
    total = np.array([w.sum() for _, w in whole])
    for i, a in enumerate(few):
        for b in many[many != a]:
            joint = total[a] + total[b] - found[i, b]
            assert abs((found[i, b] / joint if joint else 0.0) - near_dedup.weighted_jaccard(whole[a], whole[b])) < 1e-6


@pytest.mark.parametrize("members", [512, 5])
def test_classes_of_a_thousand_texts(spark, monkeypatch, members):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", members)
    rows = corpus(1000, 11)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    weight = near_dedup.frequency_table(docs)
    whole = [bag(t, weight) for _, t in rows]
    links = lost = 0
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders: dict = {}
    for i, (terms, _) in enumerate(whole):
        for t in terms.tolist():
            holders.setdefault(t, []).append(i)
    pairs = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    for a, b in pairs:
        if near_dedup.weighted_jaccard(whole[a], whole[b]) >= near_dedup.SIMILARITY:
            links += 1
            lost += found[a] != found[b]
            parent[max(top(a), top(b))] = min(top(a), top(b))
    assert links > 800 and lost <= links // 100
    # nothing is joined that the pairs do not join
    assert all(top(i) == top(found[i]) for i in range(len(rows)))


def test_ids_sort_by_the_least_document(spark):
    rows = [(5, b"a" * 16), (-7, b"b" * 16), (None, b"c" * 16), (-(1 << 63), b"d" * 16), ((1 << 63) - 1, b"e" * 16), (0, b"f" * 16)]
    df = spark.createDataFrame(rows, "least long, node binary").withColumn("id", near_dedup.node_id(F.col("least"), F.col("node")))
    back = df.select("least", near_dedup.least_of(F.col("id")).alias("l"), F.col("node"), near_dedup.digest_of(F.col("id")).alias("d"), "id").orderBy("id").collect()
    assert [r.least for r in back] == [-(1 << 63), -7, 0, 5, (1 << 63) - 1, None]
    assert all(r.least == r.l and r.node == r.d and len(r.id) == 25 for r in back)


def test_class_without_ids_keeps_one(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(None, base), (None, base + " end"), (None, base + " tail"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_dedup.drop_near_duplicates(docs).count() == 1


def test_words_made_by_doubling_differ():
    a, b = "a", "b"
    for _ in range(13):
        a, b = a + b, b + a
    hashes, counts = words.word_hashes(pa.array([f"{a} {b} {a}", b]))
    assert counts.tolist() == [3, 1]
    assert hashes[0] == hashes[2] != hashes[1] == hashes[3]
