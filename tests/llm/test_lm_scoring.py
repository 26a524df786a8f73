"""Cross-entropy differences against a plain count of all other documents."""

import math
import random
from collections import Counter

import pytest

from gleanwork.llm import lm_scoring


def brute(rows, target):
    """(n_words, target loss, background loss) of each row by dictionaries of words and pairs of all other rows."""
    split = [(t or "").lower().replace("\x0b", " ").split() for _, t in rows]
    vocabulary = len({w for words in split for w in words}) or 1
    out = []
    for i, words in enumerate(split):
        loss = []
        for model in (target, None):
            one, two, total = Counter(), Counter(), 0
            for k, others in enumerate(split):
                if k != i and (model is None or rows[k][0] in model):
                    one.update(others)
                    two.update(zip(others, others[1:]))
                    total += len(others)
            here = 0.0
            for k, w in enumerate(words):
                single = (one[w] + 1 / vocabulary) / (total + 1)
                before = one[words[k - 1]] if k else 0
                here -= math.log(0.6 * two[words[k - 1], w] / before + 0.4 * single if before else single)
            loss.append(here / max(1, len(words)))
        out.append((len(words), *loss))
    return out


@pytest.mark.parametrize("block_bytes, ranges", [(8 << 20, 32), (700, 3)])
def test_equals_the_plain_count(spark, monkeypatch, block_bytes, ranges):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(lm_scoring, "MIN_RANGES", ranges)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "日本", "ÉTÉ"]
    rows = [(i, " ".join(rng.choices(vocabulary[i % 3 * 15 :], k=rng.choice([0, 1, 2, 30, 200])))) for i in range(70)]
    rows += [(70, None), (None, "w1 w2 w3"), (71, rows[5][1]), (71, rows[5][1]), (72, "only here once")]
    target = {1, 4, 7, 10, 71, 999}
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, difference string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in [*target, 4, None]], "doc_id long")
    found = lm_scoring.cross_entropy_difference(docs, ids)
    assert found.columns == ["doc_id", "difference_in", "n_words", "target_loss", "background_loss", "difference"]
    key = lambda r: (r[0] is None, r[0], r[1:])
    found = sorted(((r.doc_id, r.n_words, round(r.target_loss, 9), round(r.background_loss, 9)) for r in found.collect()), key=key)
    wanted = sorted(((doc, n, round(a, 9), round(b, 9)) for (doc, _), (n, a, b) in zip(rows, brute(rows, target), strict=True)), key=key)
    assert [r[:2] for r in found] == [r[:2] for r in wanted]
    assert all(abs(x - y) < 1e-6 for a, b in zip(found, wanted, strict=True) for x, y in zip(a[2:], b[2:], strict=True))


def test_a_copy_makes_a_text_known(spark):
    rng = random.Random(3)
    fresh = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80))
    texts = [fresh() for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.background_loss for r in lm_scoring.cross_entropy_difference(docs, docs.where("doc_id % 7 = 6").select("doc_id")).collect()}
    twice = [found[i] for i in (*range(5), *range(60, 65))]
    assert max(twice) < min(found[i] for i in range(5, 60))
