"""Encoding held against the library: colliding words, all scripts, joins inside anything."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleanwork.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
#: Characters of one to four bytes: letters, marks, digits, signs, white space of all kinds, unassigned and private ones.
SCRIPTS = [
    "abc XYZ 019 .,!?'\"-_\t\n\r", "éàüßøıŀſ", "ΑΒΓαβγό", "Приветмир", "שלום", "مرحبا٠١٢", "नमस्ते१२", "日本語中文漢字", "ひらがなカタカナ", "한국어",
    "“”‘’—–…•€™©", "  　  \u0085  ", "😀👍🏽🇩🇪👨‍👩‍👧", "𝒜𝟙𝟚𐍈𠀀", "\x00\x1c\x1d\x1e\x1f\x7f", "①Ⅳ½²३", "̧́⃝", "͸\U000e0001￿", "'s't're've'm'll'd'S'LL",
]


def text(rng, n):
    out = []
    while len(out) < n:
        own = rng.choice(SCRIPTS)
        out += rng.choices(own, k=rng.randint(1, 12))
        out += rng.choice(["", " ", "  ", "\n", " '", "'s ", "   　 ", "’s "])
    return "".join(out)


def expected(texts):
    return [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def ids(own, texts):
    return [x.tolist() for x in own.encode_all([t.encode() for t in texts])]


@pytest.mark.parametrize("seed", range(6))
def test_all_scripts_equal_the_library(seed):
    rng = random.Random(seed)
    texts = [text(rng, rng.choice([1, 3, 30, 300, 4000])) for _ in range(120)]
    own = bpe.Encoder(PATH)
    assert ids(own, texts) == expected(texts)
    assert own.repaired > 20  # long texts went through chunks and joins


def test_shared_chunks_of_any_script_are_reused():
    rng = random.Random(9)
    passage = text(rng, 30_000)
    texts = [text(rng, 200) + passage + text(rng, 300) for _ in range(8)]
    own = bpe.Encoder(PATH)
    assert ids(own, texts) == expected(texts)
    assert own.reused > 0.7 * (own.reused + own.encoded)


def test_every_assigned_character_class():
    rng = random.Random(2)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng.shuffle(codes)
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}'" for c in codes[i : i + 400]) for i in range(0, 40_000, 400)]
    assert ids(bpe.Encoder(PATH), texts) == expected(texts)


@pytest.mark.parametrize("letters", ["ab", "xy", "qz"])
@pytest.mark.parametrize("doublings", [10, 12])
def test_words_of_one_hash(letters, doublings):
    a, b = letters
    for _ in range(doublings):
        a, b = a + b, b + a
    own = bpe.Encoder(PATH)
    assert ids(own, [a, b, f"{a} {b}"]) == expected([a, b, f"{a} {b}"])
    assert own.words.exact  # they do share a hash in one call
    late = bpe.Encoder(PATH)
    assert [ids(late, [x])[0] for x in (a, b, a)] == expected([a, b, a])  # and with what is cached


def test_small_caches(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CACHED_BYTES", 250_000)
    monkeypatch.setattr(bpe, "MAX_CACHED_WORDS", 50)
    rng = random.Random(4)
    texts = [text(rng, 2500) for _ in range(6)]
    own = bpe.Encoder(PATH)
    for _ in range(3):
        rng.shuffle(texts)
        assert [ids(own, [t])[0] for t in texts] == expected(texts)
    assert own.reused


def test_bytes_that_are_not_utf8():
    own = bpe.Encoder(PATH)
    for data in (b"a\xff b", b"\xc3", b"abc \xe2\x82", b"\xf0\x9f\x98 x" * 300):
        assert own.encode(data) == expected([data.decode("utf-8", "replace")])[0]
