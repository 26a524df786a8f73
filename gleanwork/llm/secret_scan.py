"""Secret scans with structural confirmation.

Pattern spans (assignments, access-key ids, hex runs) are always kept. On top
of them, base64 and hex candidates are reported only if their bytes parse: DER
key encodings with nested lengths that add up, OpenSSH key blobs, and
signed-token headers. Only the bytes that hold lengths are decoded, at each
place where a key may begin, so time grows in proportion to the text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanwork.llm._shared import bound_batches, own_columns, text_values

#: Order of kinds with the same start; base kinds come first.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "der", "ssh")
RANK = {kind: i for i, kind in enumerate(KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Any text with an assignment holds one of these in some letter case.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Dotted parts, at every place where one may begin; a JSON header begins with a brace or white space, so with one of these characters.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([eICD][A-Za-z0-9_-]{7,})\.[A-Za-z0-9_-]{4,}\.([A-Za-z0-9_-]*))")
DOTTED = re.compile(r"\.[A-Za-z0-9_-]{4,}\.")
#: Between the lines of a key: a line end and what indents the next line, or the escapes of a line end in a quoted string.
LINE_END = re.compile(r"\r?\n[ \t]*|(?:\\r)?\\n")
#: First characters of base64 whose bytes begin a DER sequence or an OpenSSH key; the first line of a key has 40 characters, later ones 4.
BASE64_STARTS = ("M", "b3BlbnNzaC1rZXktdjEA", "AAAA")
FIRST_LINE, OTHER_LINE = 40, 4
FIRST_LINES = tuple(re.compile(rf"{x}[A-Za-z0-9+/]{{{FIRST_LINE - len(x)},}}") for x in BASE64_STARTS)
#: The same in the alphabet of URLs, on one line.
URL_LINES = tuple(re.compile(rf"{x}[A-Za-z0-9_-]{{{FIRST_LINE - len(x)},}}") for x in BASE64_STARTS)
#: A first line begins where no character of its alphabet is in front, or only the escape of a line end.
BEFORE, URL_BEFORE = re.compile(r"(?<![A-Za-z0-9+/])|(?<=\\n)"), re.compile(r"(?<![A-Za-z0-9_-])|(?<=\\n)")
PADDING = re.compile("={0,2}")
NEXT_LINE = re.compile(rf"(?:{LINE_END.pattern})([A-Za-z0-9+/]{{{OTHER_LINE},}})(={{0,2}})")
HEX_CANDIDATE = re.compile(r"[0-9A-Fa-f]{24,}")
#: Members of a key structure at most; real ones have ten.
MAX_MEMBERS = 40
KEY_NAME = re.compile(rb"(ssh|ecdsa)-[a-z0-9@.-]+")
#: Fields of a public key blob; a private one has more. Keys on hardware tokens hold no secret.
PUBLIC_FIELDS = {b"ssh-ed25519": 2, b"ssh-ed448": 2, b"ssh-rsa": 3, b"ssh-dss": 5}
#: A sequence, its length and the tag of a number or sequence; the two beginnings of OpenSSH keys.
HEX_START = re.compile(r"(?=30(?:[1-7][0-9a-f]|81..|82.{4}|83.{6}|84.{8})(?:02|30)|6f70656e7373682d6b65792d7631|000000[0-4][0-9a-f](?:73|65))", re.IGNORECASE)
MAGIC = b"openssh-key-v1\0"

Span = tuple[str, int, int]


def _decoded64(text: str) -> bytes | None:
    text = LINE_END.sub("", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        text = text[:-1]
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der(data: Bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the element at ``at``; None if its length does not fit."""
    if at + 2 > end:
        return None
    tag, first = data[at], data[at + 1]
    at += 2
    if first < 0x80:
        size = first
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        if size < 0x80:
            return None
        at += n
    return (tag, at, at + size) if at + size <= end else None


class Coded:
    """Bytes of a stretch of base64 (unpadded) or hex, decoded only where they are looked at."""

    def __init__(self, text: str, begin: int, digits: int) -> None:
        #: Characters of a whole group, and bytes that they make.
        self.text, self.begin, self.chars, self.bytes = text, begin, (4 if digits == 64 else 2), (3 if digits == 64 else 1)
        left = len(text) - begin
        self.size = (left - (left % 4 == 1)) * 3 // 4 if digits == 64 else left // 2

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int | slice) -> int | bytes:
        if isinstance(at, int):
            return self[at : at + 1][0]
        first, last = at.start or 0, self.size if at.stop is None else min(at.stop, self.size)
        group = first // self.bytes
        part = self.text[self.begin + group * self.chars : self.begin + -(-last // self.bytes) * self.chars]
        if self.chars == 2:
            return bytes.fromhex(part)
        part = part[: len(part) - (len(part) % 4 == 1)]
        return base64.b64decode(part + "=" * (-len(part) % 4))[first - group * 3 : last - group * 3]

    def chars_of(self, n: int) -> int:
        """Characters that hold the first n bytes."""
        return -(-n * self.chars // self.bytes)


Bytes = bytes | Coded


def nested(data: Bytes, at: int, end: int) -> bool:
    """Whether the stretch is one octet string or number, or one sequence that its members fill."""
    own = _der(data, at, end)
    if not own or own[2] != end or own[1] == end:
        return False
    if own[0] in (0x02, 0x04):
        return True
    at = own[1]
    for _ in range(MAX_MEMBERS if own[0] == 0x30 else 0):
        if at >= end:
            break
        x = _der(data, at, end)
        if not x:
            return False
        at = x[2]
    return at == end


def der_size(data: Bytes) -> int | None:
    """Bytes of the key structure that the data begin with: an outer sequence whose members fill it exactly; None if it is none."""
    outer = _der(data, 0, len(data))
    if not outer or outer[0] != 0x30 or outer[2] - outer[1] < 16:
        return None
    members, at = [], outer[1]
    while at < outer[2]:
        x = _der(data, at, outer[2])
        if not x or len(members) == MAX_MEMBERS:
            return None
        members.append(x)
        at = x[2]
    tags = [x[0] for x in members]

    def has_oid(x: tuple[int, int, int]) -> bool:
        inner = _der(data, x[1], x[2])
        return bool(inner and inner[0] == 0x06 and inner[2] > inner[1])

    if len(tags) >= 9 and set(tags) == {0x02}:  # version and the numbers of an RSA key
        good = True
    elif len(tags) >= 3 and tags[:3] == [0x02, 0x30, 0x04] and has_oid(members[1]):  # wrapped private key, itself an element
        good = nested(data, *members[2][1:])
    elif len(tags) >= 2 and tags[:2] == [0x02, 0x04] and set(tags[2:]) <= {0xA0, 0xA1}:  # elliptic-curve private key
        good = members[0][2] - members[0][1] == 1 and data[members[0][1]] == 1
    elif tags == [0x30, 0x04] and has_oid(members[0]):  # encrypted private key
        good = True
    else:  # DSA
        good = len(tags) in (5, 6) and set(tags) == {0x02} and members[1][2] - members[1][1] >= 16
    return outer[2] if good else None


def der_key(data: Bytes) -> bool:
    """Whether the bytes are a key structure and at most two more."""
    size = der_size(data)
    return size is not None and len(data) - size <= 2


def fields_of(data: Bytes, at: int, most: int) -> list[tuple[int, int]]:
    """Begin and end of the length-prefixed fields from ``at`` on, as far as they fit."""
    found = []
    while at + 4 <= len(data) and len(found) < most:
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            break
        found.append((at + 4, at + 4 + n))
        at += 4 + n
    return found


def openssh_size(data: Bytes) -> int | None:
    """Bytes of an OpenSSH private key as its lengths state them; all bytes where they do not fit; None if it is none."""
    head = fields_of(data, len(MAGIC), 3) if data[: len(MAGIC)] == MAGIC else []
    if len(head) < 3 or head[-1][1] + 4 > len(data):
        return None
    at = head[-1][1]
    n = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= n <= 64:
        return None
    rest = fields_of(data, at + 4, n + 1)
    return rest[-1][1] if len(rest) == n + 1 else len(data)


def ssh_ends(data: Bytes) -> list[int]:
    """Where a private key blob may end: after each field beyond those that a public key has."""
    first = int.from_bytes(data[:4], "big") if len(data) >= 4 else 0
    if not 5 <= first <= 64 or not KEY_NAME.fullmatch(data[4 : 4 + first]):
        return []
    return [end for _, end in fields_of(data, 0, 12)[PUBLIC_FIELDS.get(data[4 : 4 + first], 3) :]]


def ssh_key(data: Bytes) -> bool:
    """Whether the bytes are an OpenSSH private key, or a blob of more fields than a public key has, whose lengths nest."""
    return openssh_size(data) is not None or len(data) in ssh_ends(data)


def token_header(part: str) -> bool:
    """Whether a dotted token's first part is a JSON header that names an algorithm."""
    data = _decoded64(part)
    if not data:
        return False
    try:
        header = json.loads(data)
    except ValueError:
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches of each base kind."""
    spans: list[Span] = []
    low = text.lower()
    if any(x in low for x in ASSIGN_HINTS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return spans


def key_at(data: Coded, ends: Callable[[int, int], int | None]) -> tuple[str, int] | None:
    """Kind of the key that the data begin with, and how many characters it takes.

    ``ends(low, high)`` gives the largest number of bytes between both at
    which a line or the data end. A key of stated length takes what follows it
    on its last line if that is two bytes at most, and else ends where stated.
    """
    kind, size = "der", der_size(data)
    if size is None:
        kind, size = "ssh", openssh_size(data)
    if size is not None:
        upto = ends(size, size + 2)
        return kind, data.chars_of(size if upto is None else upto)
    whole = [n for n in ssh_ends(data) if ends(n, n) is not None]
    return ("ssh", data.chars_of(whole[-1])) if whole else None


def first_lines(text: str, patterns: tuple[re.Pattern, ...], before: re.Pattern) -> list[tuple[int, str]]:
    """Place and characters of the lines with which a key may begin, in order."""
    return sorted((m.start(), m[0]) for p in patterns for m in p.finditer(text) if before.match(text, m.start()))


def base64_lines(text: str) -> Iterator[list[tuple[int, str, int]]]:
    """Lines of base64 that follow a possible first line, up to one with padding: place, characters and padding of each."""
    upto = -1
    for begin, own in first_lines(text, FIRST_LINES, BEFORE):
        if begin < upto:  # among the lines before
            continue
        upto = begin + len(own)
        pad = PADDING.match(text, upto)[0]
        lines = [(begin, own, len(pad))]
        upto += len(pad)
        while not lines[-1][2] and (m := NEXT_LINE.match(text, upto)):
            lines.append((m.start(1), m[1], len(m[2])))
            upto = m.end()
        yield lines


def keys_in_lines(lines: list[tuple[int, str, int]]) -> Iterator[Span]:
    """Keys that begin with a line; each character is looked at a bounded number of times."""
    chars = "".join(x for _, x, _ in lines)
    stops = list(accumulate(len(x) for _, x, _ in lines))
    line = 0
    while line < len(lines):
        begin, own, _ = lines[line]
        found = None
        if len(own) >= FIRST_LINE and own.startswith(BASE64_STARTS):
            first = stops[line] - len(own)
            data = Coded(chars, first, 64)

            def ends(low: int, high: int, first: int = first, data: Coded = data) -> int | None:
                last = first + data.chars_of(high) + 1  # one more character can hold no byte
                i = bisect_right(stops, last) - 1
                bytes_ = lambda n: (n - (n % 4 == 1)) * 3 // 4
                while i >= 0 and stops[i] > first and (n := bytes_(stops[i] - first)) >= low:
                    if n <= high:
                        return n
                    i -= 1
                return None

            found = key_at(data, ends)
        if found is None:
            line += 1
            continue
        upto = first + found[1]
        i = bisect_left(stops, upto)
        start, part, pad = lines[i]
        inside = upto - (stops[i] - len(part))
        if len(part) - inside == 1 and (stops[i] - first) % 4 == 1:
            inside += 1
        yield found[0], begin, start + inside + (pad if inside == len(part) else 0)
        line = i + 1


def base64_spans(text: str) -> list[Span]:
    """Keys in base64: lines that follow each other, and single lines in the alphabet of URLs."""
    spans = [x for lines in base64_lines(text) for x in keys_in_lines(lines)]
    for begin, own in first_lines(text, URL_LINES, URL_BEFORE):
        if "-" in own or "_" in own:
            spans += keys_in_lines([(begin, own.replace("-", "+").replace("_", "/"), len(PADDING.match(text, begin + len(own))[0]))])
    return spans


def hex_spans(text: str) -> Iterator[Span]:
    """Keys anywhere in runs of hex digits of either letter case."""
    for run in HEX_CANDIDATE.finditer(text):
        digits, at = run[0], 0
        while m := HEX_START.search(digits, at):
            data = Coded(digits, m.start(), 16)
            found = key_at(data, lambda low, high, n=len(data): n if low <= n <= high else None)
            at = m.start() + (found[1] if found else 1)
            if found:
                yield found[0], run.start() + m.start(), run.start() + at


def confirmed_spans(text: str) -> list[Span]:
    """Candidates that decode to a key or signed-token structure."""
    tokens = [("token", m.start(), m.end(2)) for m in TOKEN.finditer(text) if token_header(m[1])] if DOTTED.search(text) else []
    return [*tokens, *base64_spans(text), *hex_spans(text)]


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans; both by start, then kind."""
    base = sorted(base_spans(text), key=lambda x: (x[1], RANK[x[0]]))
    return base, sorted(base + confirmed_spans(text), key=lambda x: (x[1], RANK[x[0]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with each stretch covered by spans replaced once."""
    out, at, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if a >= end:
            if end >= 0:
                at = end
            out += [text[at:a], mark]
        end = max(end, b)
    return "".join([*out, text[max(end, 0) :]])


OUTPUT = "n_assign long, n_access long, n_hex long, base_spans string, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, text_col: str = "text", redact_to: str | None = None) -> DataFrame:
    """Add the secrets of each row's whole text; one output row for each input row.

    Adds ``n_assign, n_access, n_hex`` (long), ``base_spans`` and ``spans``
    (``kind:start:end`` in code points, end exclusive, comma-joined), and
    ``base_sha256``. With ``redact_to``, that column gets the text with every
    span replaced. Null texts count as empty; empty texts have no spans; texts of
    any length are scanned whole; input columns that clash with output names
    get the suffix ``_in``; rows repeat as they come, and an empty table gives
    an empty result. Public keys are no secrets. No shuffle: each row is judged
    alone.
    """
    bound_batches(docs.sparkSession)
    added = [x.split()[0] for x in OUTPUT.split(", ")]
    clash = [x for x in [*added, redact_to] if x and x != text_col]
    docs = own_columns(docs, clash)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != redact_to]
    schema = ", ".join([*fields, OUTPUT, *([f"`{redact_to}` string"] if redact_to else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            counts: dict[str, list[int]] = {k: [] for k in BASE_KINDS}
            base_list, all_list, digests, clean = [], [], [], []
            for text in text_values(columns[text_col]):
                base, every = scan(text)
                for k in BASE_KINDS:
                    counts[k].append(sum(x[0] == k for x in base))
                base_list.append(joined(base))
                digests.append(hashlib.sha256(base_list[-1].encode()).hexdigest())
                all_list.append(joined(every))
                if redact_to:
                    clean.append(redacted(text, every))
            if redact_to:
                nulls = columns[text_col].is_null().to_pylist()
                columns.pop(redact_to, None)
            columns |= {f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}
            columns |= {"base_spans": pa.array(base_list, pa.string()), "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(all_list, pa.string())}
            if redact_to:
                columns[redact_to] = pa.array([None if n else x for n, x in zip(nulls, clean, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, schema)
