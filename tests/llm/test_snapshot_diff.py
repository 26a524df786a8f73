"""Snapshot difference against a plain version: unique and repeated keys, hot groups, nulls, empty tables."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleanwork.llm import snapshot_diff

SCHEMA = "doc_id long, text string, lang string, source string, key string"
COLUMNS = ["text", "lang", "source"]


def digests(row):
    return b"".join(bytes(16) if v is None else hashlib.sha256(v.encode()).digest()[:16] for v in row[1:4])


def plain(old, new):
    """All rows by plain loops over whole groups."""

    def sha(row):
        return hashlib.sha256("\n".join("~" if v is None else v for v in row[1:4]).encode()).hexdigest()

    def pairs(olds, news, group, order):
        sides = defaultdict(lambda: ([], []))
        for side, rows in enumerate((olds, news)):
            for r in rows:
                sides[group(r)][side].append(r)
        for a, b in sides.values():
            a.sort(key=lambda r: order(0, r))
            b.sort(key=lambda r: order(1, r))
            for i in range(max(len(a), len(b))):
                yield a[i] if i < len(a) else None, b[i] if i < len(b) else None

    number = lambda r: snapshot_diff.of_key(r[0])
    met, olds, news = [], [], []
    for a, b in pairs(old, new, number, lambda side, r: digests(r)):
        if a and b:
            changed = [c for i, c in enumerate(COLUMNS, 1) if a[i] != b[i]]
            met.append((b[0], a[0], "update" if changed else "same", ",".join(changed), sha(b)))
        else:
            (olds if a else news).append(a or b)
    for a, b in pairs(olds, news, digests, lambda side, r: number(r) if side == 0 else -number(r)):
        met.append((b[0], a[0], "rekey", "", sha(b)) if a and b else (b[0], None, "insert", "", sha(b)) if b else (a[0], a[0], "delete", "", None))
    return Counter(met)


def made(seed, n, keys):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, "", "~", "a", "b\n", "a"])
    old = [(keys(rng, i), rng.choice([None, "hot", "hot", f"t{rng.randrange(9)}"]), value(), rng.choice(["s", None]), "x") for i in range(n)]
    new = [(r[0] if rng.random() < 0.6 else keys(rng, n + i), rng.choice([r[1], "hot", "new"]), r[2], r[3], "y") for i, r in enumerate(old)]
    return old, new


KEYS = {
    "unique": lambda rng, i: i,
    "repeated": lambda rng, i: rng.choice([None, rng.randrange(12)]),
    "hot": lambda rng, i: 7 if rng.random() < 0.4 else None if rng.random() < 0.2 else i,
    "all_null": lambda rng, i: None,
    "far": lambda rng, i: rng.choice([-(1 << 63), (1 << 63) - 1, -1 - i, i]),
}


@pytest.mark.parametrize("name", KEYS)
@pytest.mark.parametrize("n", [0, 1, 300])
def test_equals_the_plain_version(spark, monkeypatch, name, n):
    monkeypatch.setattr(snapshot_diff, "ROWS_PER_PARTITION", 40)
    monkeypatch.setattr(snapshot_diff, "BLOCK", 4)
    old, new = made(len(name), n, KEYS[name])
    found = snapshot_diff.diff_snapshots(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA), "doc_id", COLUMNS)
    assert Counter(map(tuple, found.collect())) == plain(old, new)


@pytest.mark.parametrize("one", [True, False])
def test_one_snapshot_empty(spark, one):
    rows, none = spark.createDataFrame([(1, "a", None, "s", "x"), (1, "a", None, "s", "x"), (None, None, None, None, "x")], SCHEMA), spark.createDataFrame([], SCHEMA)
    found = snapshot_diff.diff_snapshots(*((rows, none) if one else (none, rows)), "doc_id", COLUMNS)
    assert {r.op for r in found.collect()} == {"delete" if one else "insert"} and found.count() == 3


def test_hot_groups_are_cut():
    sample = [(5, 0, bytes([i])) for i in range(60)] + [(i, 0, b"") for i in range(100, 130)]
    cuts, hot = snapshot_diff.cuts_of(sample, 9)
    assert hot == {5} and cuts == sorted(cuts) and len([c for c in cuts if c[0] == 5]) >= 5
    assert all(len(c) == 1 for c in cuts if c[0] != 5)


def test_later_snapshot_follows_the_checksum(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", "x") for i in range(200)] + [(None, None, None, None, "x")], SCHEMA)
    later = Counter(map(tuple, snapshot_diff.later_snapshot(docs).collect()))
    cases = {r[0]: r[1] for r in docs.select("doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10).collect()}
    want = Counter({(None, None, None, None): 1})
    for i, case in cases.items():
        if i is None:
            continue
        row = (i, f"t{i}", "en", "s")
        want.update({0: [], 1: [(i, f"t{i}+", "en", "s")], 2: [(i, f"t{i}", "s", "en")], 3: [(-1 - i, *row[1:])], 4: [(-1 - i, f"t{i}", "en", None)], 5: [row, (-1 - i, *row[1:])]}.get(case, [row]))
    assert later == want
