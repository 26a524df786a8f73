"""Alignment against a plain version that walks over the bytes of each text."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import cache

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gleanwork.llm import alignment
from gleanwork.llm.bpe import byte_of_char

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
WORDS = "the model,  of   naïve café\tline\nlines  Ω日本語 x=1; don't it's 12345 <|endoftext|> <s> </s> <0x41> __init__ \r\n …    é́ 　 \x00 a​b ﬁ 𝔘😀😀".split(" ")


@cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def tokens(text):
    a, b = libraries()
    back = byte_of_char()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    raw_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    return list(zip(ids_a, raw_a, strict=True)), list(zip(ids_b, raw_b, strict=True))


def plain(texts):
    links, rows = [], []
    for text in texts:
        a, b = tokens(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(r for _, r in a) != whole or b"".join(r for _, r in b) != whole:
            links.append([])
            rows.append([0, 0, 0, 0, ""])
            continue
        owner = []
        for side in (a, b):
            owner.append([i for i, (_, r) in enumerate(side) for _ in r])
        pairs = list(dict.fromkeys(zip(*owner, strict=True)))
        groups, ga, gb = [], [], []
        for p in range(len(whole)):
            i, j = owner[0][p], owner[1][p]
            if p + 1 == len(whole) or owner[0][p + 1] != i:
                ga.append(a[i][0])
            if p + 1 == len(whole) or owner[1][p + 1] != j:
                gb.append(b[j][0])
            if p + 1 == len(whole) or (owner[0][p + 1] != i and owner[1][p + 1] != j):
                groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                ga, gb = [], []
        links.append([(a[i][0], b[j][0]) for i, j in pairs])
        rows.append([len(a), len(b), len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    count = Counter(x for own in links for x in own)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(*r[:4], sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own), r[4]) for r, own in zip(rows, links, strict=True)]


def made(seed, n=40):
    rng = random.Random(seed)
    texts = ["", None, " ", "  ", "a", "a ", "\n", "x▁y", "▁", "it's  \n  so", "a" * 3000, "日本" * 500]
    for _ in range(n):
        texts.append("".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "", "  ", "\n"]) for _ in range(rng.randrange(60))))
    return texts + texts[-5:]


@pytest.mark.parametrize("links", [300, 2_000_000])
@pytest.mark.parametrize("size", [200, 1 << 20])
def test_equals_the_plain_version(spark, monkeypatch, links, size):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", links)
    monkeypatch.setattr(alignment, "SLICE", size)
    texts = made(links + size)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    # the size of slices stays in this process, so that of documents() below is what tests it
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokenizers(docs, A, B).collect()}
    want = plain(texts)
    assert [found[i] for i in range(len(texts))] == want
    own = alignment.aligner(A, B)
    for (counts, parts, digest), row in zip(own.documents([(t or "").encode() for t in texts]), want, strict=True):
        assert (*counts[:4].tolist(), digest) == (*row[:4], row[6]) and sum(map(len, parts)) == row[3]


@pytest.mark.parametrize("seed", range(4))
def test_long_texts_are_aligned_in_slices(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", ""]) for _ in range(900))
    parts = list(alignment.slices(text.encode(), 300))
    assert len(parts) > 5 and b"".join(parts) == b" " + text.encode()
    a, b = libraries()
    whole = tokens(text)
    split = [tokens(p[1:].decode()) for p in parts]
    for side in (0, 1):
        assert [x for p in split for x in p[side]] == whole[side]


def test_packed_entries():
    import numpy as np

    for places, times in (([], []), ([0], [1]), ([3, 4, 70_000, 70_001], [1, 300, 2, 70_000])):
        back = alignment.unpacked(alignment.packed(np.array(places, np.int64), np.array(times, np.int64)))
        assert back[0].tolist() == places and back[1].tolist() == times


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a text", 3, "b"), (None, None, 4, None)], "doc_id long, text string, n_a int, block_ string")
    found = alignment.align_tokenizers(docs, A, B)
    assert found.columns == ["doc_id", "n_a_in", "block__in", *alignment.OUTPUT]
    assert sorted(found.select("n_a_in", "block__in", "n_links").collect()) == [(3, "b", 2), (4, None, 0)]
    assert alignment.align_tokenizers(docs.limit(0), A, B).collect() == []


def test_groups_as_rows(spark):
    docs = spark.createDataFrame([(1, "tokenization of naïve words"), (2, None), (3, "x▁y")], "doc_id long, text string")
    rows = alignment.token_groups(docs, A, B).orderBy("group_place").collect()
    text = ";".join(f"{','.join(map(str, r.a_ids))}|{','.join(map(str, r.b_ids))}" for r in rows)
    assert {r.doc_id for r in rows} == {1} and hashlib.sha256(text.encode()).hexdigest() == plain(["tokenization of naïve words"])[0][6]
    assert sum(len(r.a_ids) * len(r.b_ids) for r in rows) == alignment.align_tokenizers(docs, A, B).where("doc_id = 1").head().n_products
