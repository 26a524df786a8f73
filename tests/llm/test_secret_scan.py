"""Keys against a brute-force version, keys in longer runs, and time that grows with the text."""

import base64
import json
import random
import re
import time

import pytest

from gleanwork.llm import secret_scan
from test_pure import OPENSSH, RSA, SSH, WRAPPED

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
KEYS = [RSA, WRAPPED, SSH]


def spans(text):
    return [x for x in secret_scan.confirmed_spans(text) if x[0] != "token"]


def plain64(text):
    """Every run, every length: all of the run if it is a key, else the shortest stretch that is one and no byte more."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/]{40,}(={0,2})", text):
        run = m[0].rstrip("=")
        if not run.startswith(secret_scan.BASE64_STARTS):
            continue
        best = None
        for n in [len(run), *range(40, len(run))]:
            part = run[: n - (n % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            whole = n == len(run)
            if secret_scan.der_key(data) and (whole or secret_scan.der_size(data) == len(data)):
                best = ("der", n)
            elif whole and secret_scan.ssh_key(data):
                best = ("ssh", n)
            if best:
                break
        if best:
            found.append((best[0], m.start(), m.start() + best[1] + (len(m[1]) if best[1] == len(run) else 0)))
    return found


def plainhex(text):
    """Every start and every length in runs of digits; the whole rest if it is a key, else the shortest."""
    found = []
    for m in re.finditer(r"[0-9a-fA-F]{24,}", text):
        at = m.start()
        while at < m.end():
            size = (m.end() - at) // 2
            best = None
            for n in [size, *range(16, size)]:
                data = bytes.fromhex(text[at : at + 2 * n])
                if secret_scan.der_key(data) and (n == size or secret_scan.der_size(data) == n):
                    best = ("der", n)
                elif n == size and secret_scan.ssh_key(data):
                    best = ("ssh", n)
                if best:
                    break
            if best:
                found.append((best[0], at, at + 2 * best[1]))
            at += 2 * best[1] if best else 1
    return found


@pytest.mark.parametrize("seed", range(60))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choices(ALPHABET, k=n))
    parts = []
    for _ in range(5):
        key = rng.choice(KEYS)
        broken = bytearray(key)
        broken[rng.randrange(len(key))] ^= rng.choice([1, 4, 64])
        code = base64.b64encode(rng.choice([key, bytes(broken), key + b"\0" * rng.randrange(4), key[: rng.randrange(len(key))]])).decode()
        parts.append(rng.choice([code, code.rstrip("="), code.rstrip("=") + noise(rng.randrange(1, 9)), "M" + noise(60), "k=" + code + "." + noise(50)]))
    text = " ".join(parts)
    assert [x for x in spans(text) if x in plain64(text) or not re.fullmatch("[0-9a-fA-F]+", text[x[1] : x[2]])] == plain64(text)
    digits = rng.choice(KEYS).hex()
    for own in (f"00{digits}", f"a{digits}ff00ff00", f"{'0' * rng.randrange(9)}{digits} {'30' * 40}", digits[: rng.randrange(len(digits))]):
        assert [(k, a, b) for k, a, b in secret_scan.hex_spans(own)] == plainhex(own)


def test_keys_in_longer_runs():
    for data in (RSA, WRAPPED, OPENSSH[:-90] + b"\0\0\0\4abcd\0\0\0\4wxyz"):
        key = base64.b64encode(data).decode().rstrip("=")
        found = spans(f"k={key}tailtail next")
        assert found and found[0][1] == 2 and found[0][2] == 2 + len(key)
    assert [x[1:] for x in spans(f"00{RSA.hex()}")] == [(2, 2 + 2 * len(RSA))]


def test_tokens_by_their_parsed_header():
    for header in ('{"alg": "HS256"}', '{\n  "typ": "JWT",\n  "alg": "RS256"\n}', ' {"alg":"none"}', '\n{"alg":"ES256"}'):
        part = base64.urlsafe_b64encode(header.encode()).decode().rstrip("=")
        for before in ("", "Container.", "a/", "Cexample.", "x=Iiiiiiiii."):
            text = f"{before}{part}.eyJzdWIiOiIxIn0.c2ln"
            assert ("token", len(before), len(text)) in secret_scan.confirmed_spans(text)
    other = base64.urlsafe_b64encode(json.dumps({"a": 1}).encode()).decode().rstrip("=")
    assert secret_scan.confirmed_spans(f"{other}.abcdef.ghijk www.example.organisation.com") == []


def wrapped(n, rng):
    data = base64.b64encode(rng.randbytes(n * 3 // 4)).decode()
    return "\n".join(data[i : i + 64] for i in range(0, len(data), 64))


HARD = {
    "wrapped": lambda n, rng: wrapped(n, rng),
    "words": lambda n, rng: "ssh-rsa " + base64.b64encode(b"\0\0\0\7ssh-rsa\0\0\0\3").decode() + "A" * 40 + "\n" + "\n".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n // 7)),
    "headers": lambda n, rng: "\n".join("MIIEpAIBAAKCAQEA" + "A" * 48 for _ in range(n // 65)),
    "long line": lambda n, rng: base64.b64encode(rng.randbytes(n * 3 // 4)).decode(),
    "hex": lambda n, rng: "3082" * (n // 4),
    "zeros": lambda n, rng: "0" * n,
    "dots": lambda n, rng: "eyJhbGciO." * (n // 10),
}


@pytest.mark.parametrize("name", HARD)
def test_time_grows_with_the_text(name):
    took = []
    for n in (125_000, 500_000, 2_000_000):
        text = HARD[name](n, random.Random(1))
        began = time.process_time()
        secret_scan.scan(text)
        took.append(time.process_time() - began)
    assert took[2] < 8 * max(took[1], 0.2) and took[2] < 20, took
