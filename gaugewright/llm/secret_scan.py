"""Secret scan with structural confirmation.

Base patterns find assignments, access keys and long hex runs. On top, base64 and hex runs are decoded
and reported only if their structure holds: `key` for a private key whose encoding parses (nested
ASN.1 lengths that add up, as PKCS#1, PKCS#8 or SEC 1; or the OpenSSH container), `jwt` for a signed
token whose header decodes to a JSON object with an algorithm and whose other parts are base64url.
A run may be broken by line ends, as in PEM bodies; a key in it may start at any line and ends where
its own lengths say, so lines of plain text before and after it don't matter.

Spans are code points of the text, end excluded. Per kind they are leftmost and don't overlap; kinds
may overlap. Null counts as empty; texts of any length are scanned whole; repeated rows give repeated
results; an empty table gives none; columns other than id and text play no part.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame

from gaugewright.llm.common import map_batches, two_columns

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "key", "jwt")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Either alphabet: + and /, or - and _.
BASE64 = re.compile(r"[A-Za-z0-9+/_-](?:[A-Za-z0-9+/_-]|\r?\n(?=[A-Za-z0-9+/=_-])){38,}(?:(?:\r?\n)?={1,2})?")
LINE_END = re.compile(r"\r?\n")
#: What may follow a key, by the number of characters that its last group of four lacks.
PADDING = [re.compile(""), *(re.compile(rf"(?:\r?\n)?={{1,{n}}}") for n in (1, 2, 3))]
OPENSSH = "b3BlbnNzaC1rZXktdjE"
ANY_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
#: A header starts with a brace or with JSON's white space, whose base64url begins with one of four letters.
JWT_HEAD = re.compile(r"(?<![A-Za-z0-9_-])[eICD][A-Za-z0-9_-]++(?=(\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+))")

Span = tuple[int, int]
SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06


def assigned(text: str) -> list[Span]:
    return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8]


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, and start and end of the value, of the DER element at `at`; None if it doesn't fit before `end`."""
    if at + 2 > end:
        return None
    n, start = data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or start + size > end:
            return None
        n, start = int.from_bytes(data[start : start + size], "big"), start + size
    return (data[at], start, start + n) if start + n <= end else None


def elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """All elements between start and end, or None if their lengths don't add up."""
    out = []
    while start < end:
        e = tlv(data, start, end)
        if e is None:
            return None
        out.append(e)
        start = e[2]
    return out


def private_key(data: bytes) -> str | None:
    """The encoding if data begins with a private key, by its structure alone."""
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):  # cipher, derivation, its options
            size = int.from_bytes(data[at : at + 4], "big")
            if len(data) < at + 4 + size:
                return None
            at += 4 + size
        return "openssh" if 1 <= int.from_bytes(data[at : at + 4], "big") <= 64 else None
    whole = tlv(data, 0, len(data))
    if whole is None or whole[0] != SEQUENCE or len(data) - whole[2] > 2:
        return None
    parts = elements(data, whole[1], whole[2])
    if not parts or len(parts) < 2 or parts[0][0] != INTEGER or not 1 <= parts[0][2] - parts[0][1] <= 2:
        return None
    version = int.from_bytes(data[parts[0][1] : parts[0][2]], "big")
    if version in (0, 1) and len(parts) == 9 and all(p[0] == INTEGER and p[2] > p[1] for p in parts):
        return "pkcs1"
    if version in (0, 1) and len(parts) >= 3 and parts[1][0] == SEQUENCE and parts[2][0] == OCTETS:
        algorithm = elements(data, parts[1][1], parts[1][2])
        return "pkcs8" if algorithm and algorithm[0][0] == OID else None
    if version == 1 and parts[1][0] == OCTETS and 16 <= parts[1][2] - parts[1][1] <= 72 and all(p[0] in (0xA0, 0xA1) for p in parts[2:]):
        return "sec1"
    return None


def unbase64(run: str) -> bytes | None:
    run = re.sub(r"\s+", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run[: len(run) // 4 * 4 + (len(run) % 4 if len(run) % 4 > 1 else 0)] + "=" * (-len(run) % 4 % 3), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_chars(body: str, at: int) -> int | None:
    """How many base64 characters, without padding, the private key at `at` has; None if there is none."""
    if body.startswith(OPENSSH, at):
        data = unbase64(body[at:])
        return -(-openssh_size(data) * 4 // 3) if data and private_key(data) else None
    first = unbase64(body[at : at + 12]) if body.startswith("M", at) else None
    if not first or len(first) < 9 or first[0] != SEQUENCE:
        return None
    # the length in the first bytes says how much to decode; the version must follow
    size = first[1] & 0x7F if first[1] & 0x80 else 0
    if size > 4 or first[2 + size] != INTEGER:
        return None
    n = 2 + size + (int.from_bytes(first[2 : 2 + size], "big") if size else first[1])
    chars = -(-n * 4 // 3)
    if at + chars > len(body):
        return None
    data = unbase64(body[at : at + chars])
    return chars if data and private_key(data) else None


def openssh_size(data: bytes) -> int:
    """Bytes of the OpenSSH container at the start of data; all of data if its lengths don't add up."""
    at, left = 15, 3
    while left:
        at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
    at, left = at + 4, int.from_bytes(data[at : at + 4], "big") + 1  # the public keys and the private part
    while left:
        if at + 4 > len(data):
            return len(data)
        at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
    return at if at <= len(data) else len(data)


def keys_in(text: str, start: int, end: int) -> Iterator[Span]:
    """The private keys that begin at a line of the base64 run between start and end."""
    places, lines = [start], []
    for m in LINE_END.finditer(text, start, end):
        lines.append(text[places[-1] : m.start()])
        places.append(m.end())
    lines.append(text[places[-1] : end].rstrip("="))
    begins = [0, *accumulate(len(x) for x in lines)]
    body, done = "".join(lines), 0
    for k, line in enumerate(lines):
        if begins[k] < done or not line.startswith(("M", "b")):
            continue
        chars = key_chars(body, begins[k])
        if chars:
            done = begins[k] + chars
            last = bisect_left(begins, done) - 1
            stop = places[last] + done - begins[last]
            pad = PADDING[-chars % 4].match(text, stop)
            yield places[k], pad.end() if pad else stop


def keys(text: str) -> list[Span]:
    found = [span for m in BASE64.finditer(text) for span in keys_in(text, *m.span())]
    for m in ANY_HEX.finditer(text):
        if m[0][:2] in ("30", "6f", "6F") and private_key(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])):
            found.append(m.span())
    out: list[Span] = []
    for a, b in sorted(found):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def tokens(text: str) -> list[Span]:
    out: list[Span] = []
    for m in JWT_HEAD.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        head, (body, sign) = m[0], m[1][1:].split(".")
        try:
            header = base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)).decode()
            if not header.lstrip(" \t\n\r").startswith("{"):
                continue
            header = json.loads(header)
            base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)), base64.urlsafe_b64decode(sign + "=" * (-len(sign) % 4))
        except (binascii.Error, ValueError, RecursionError):
            continue
        if isinstance(header, dict) and isinstance(header.get("alg"), str):
            out.append((m.start(), m.end(1)))
    return out


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end), by start and then by kind."""
    hexes = [m.span() for m in HEX.finditer(text)]
    access = [m.span() for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found = (assigned(text), access, hexes, keys(text), tokens(text))
    return [(KINDS[k], a, b) for a, k, b in sorted((a, k, b) for k, spans in enumerate(found) for a, b in spans)]


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id and spans, an array of (kind, start, end)."""
    rows = two_columns(docs, id_col, text_col)

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t or "")] for t in b["text"]]}

    return map_batches(rows, scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(listed([s for s in spans if s[0] in KINDS[:3]]).encode()).hexdigest()
