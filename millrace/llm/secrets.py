"""Secret scan with structural confirmation.

Three base kinds are plain patterns. The others report a candidate only once its structure holds: base64 (also wrapped in
lines, or with escaped line ends) or hex is decoded, DER lengths must nest at every level and fill the value, whose shape must be that of a
private key (also an encrypted one), an OpenSSH key must carry its length-prefixed fields, a PEM key encrypted by its headers must
name a cipher and an IV and hold whole blocks, a signed token must have a JSON header with an algorithm and a JSON body. Public keys
aren't secrets. Where a value ends follows from its own lengths; it must end where its base64 does.

Null or empty text: no spans. Very long texts are scanned whole. Repeated rows give repeated rows; spans at the same place
are ordered by kind. Only doc_id and text are read, so other columns, whatever their names, do no harm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "ssh_key", "signed_token")
RANK = {k: i for i, k in enumerate(KINDS)}

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----)[\s\S])*)-----END \1-----")
DEK = re.compile(r"[A-Z0-9-]+,((?:[0-9A-Fa-f]{2}){8,16})")
#: A JSON object that starts with a quote, a space or a line end.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
#: Base64 of a DER sequence or of the OpenSSH magic; what goes before may be a path or a quote, but no letter or digit.
KEY64 = re.compile(r"(?<![A-Za-z0-9])(?:M[A-P][A-Za-z0-9+/]{30}|b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/]{20})")
LINE64 = re.compile(r"([A-Za-z0-9+/]+)((?:(?:\\r)?\\n|\r?\n[ \t]*)?)")
HEXES = re.compile(r"(?<![0-9A-Fa-f])(?:30[0-9A-Fa-f]{62,}+|6f70656e7373682d[0-9A-Fa-f]{48,}+)")
SSH, DEPTH = b"openssh-key-v1\0", 16

Span = tuple[str, int, int]


def base_spans(text: str) -> Iterator[Span]:
    """Leftmost matches that don't overlap, for each base kind. A run of at least 32 hex digits is the leftmost match of
    the pattern without a least length, too, as runs are maximal."""
    for m in ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= LEAST_ASSIGN:
            yield "assign", m.start(), m.end()
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST_ACCESS:
            yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def unbase64(text: str, urlsafe: bool = False) -> bytes | None:
    text = "".join(text.split()).rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if urlsafe else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER value at a place; None if its length is malformed or passes the end."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end or data[at] == 0:
            return None
        n = int.from_bytes(data[at : at + size], "big")
        at += size
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def der_nests(data: bytes, at: int, end: int, depth: int = DEPTH) -> bool:
    """Whether items fill a range, and those in them likewise."""
    while at < end:
        item = der_item(data, at, end)
        if not item or item[0] & 0x20 and (not depth or not der_nests(data, item[1], item[2], depth - 1)):
            return False
        at = item[2]
    return True


def der_tags(data: bytes, at: int, end: int) -> list[int]:
    tags = []
    while at < end:
        item = der_item(data, at, end)
        if not item:
            return []
        tags.append(item[0])
        at = item[2]
    return tags


def der_key(data: bytes) -> bool:
    """A private key: an outer SEQUENCE that fills the data, nested well at every level, of a shape that private keys have:
    integers (RSA, DSA; public ones have two at most), version and octets (EC), version, algorithm and octets (PKCS 8), algorithm and octets (encrypted)."""
    outer = der_item(data, 0, len(data))
    if not outer or outer[0] != 0x30 or outer[2] != len(data) or not der_nests(data, 0, len(data)):
        return False
    tags = der_tags(data, outer[1], outer[2])
    if tags == [0x30, 0x04]:
        first = der_item(data, outer[1], outer[2])
        return der_tags(data, first[1], first[2])[:1] == [0x06] and len(data) >= 48
    numbers = len(tags) >= 6 and all(t == 0x02 for t in tags)
    return numbers and len(data) >= 48 or tags[:2] == [0x02, 0x04] or tags[:3] == [0x02, 0x30, 0x04]


def der_size(head: bytes) -> int | None:
    """The size of a DER sequence, from its first bytes."""
    if len(head) < 6 or head[0] != 0x30:
        return None
    if head[1] < 0x80:
        return head[1] + 2
    n = head[1] & 0x7F
    return int.from_bytes(head[2 : 2 + n], "big") + 2 + n if 1 <= n <= 4 else None


def ssh_key(data: bytes) -> bool:
    """OpenSSH private key: the magic, then cipher, KDF and options with lengths, and a count of keys. What follows may be cut
    off: the head alone tells what it is."""
    return ssh_parts(data) is not None


def ssh_parts(data: bytes) -> int | None:
    """Where the public and private parts of an OpenSSH private key end by their lengths, or the end of the data if they don't fit."""
    if not data.startswith(SSH):
        return None
    at = len(SSH)
    for _ in range(3):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data) or not 1 <= (n := int.from_bytes(data[at : at + 4], "big")) <= 16:
        return None
    at += 4
    for _ in range(n + 1):
        if at + 4 > len(data):
            return len(data)
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else len(data)


def gathered(text: str, start: int, need: int | None) -> tuple[str, int]:
    """Base64 from a place on, over line ends, `need` characters of it or all; and where it ends. "" if it goes on behind."""
    parts, have, at = [], 0, start
    while m := LINE64.match(text, at):
        part = m[1] if need is None else m[1][: need - have]
        parts.append(part)
        have, end = have + len(part), m.start() + len(part)
        if len(part) < len(m[1]):
            return "", end
        if have == need or not m[2]:
            break
        at = m.end()
    if not parts or need is not None and have < need:
        return "", start
    for _ in range(2):
        end += text[end : end + 1] == "="
    return "".join(parts), end


def key64(text: str, start: int) -> tuple[str, int] | None:
    """Kind and end of the private key whose base64 starts at a place."""
    if text.startswith("M", start):
        size = der_size(unbase64(text[start : start + 8]) or b"")
        if not size or size < 32:
            return None
        found, end = gathered(text, start, -(-size * 4 // 3))
        return ("der_key", end) if found and der_key(unbase64(found) or b"") else None
    found, end = gathered(text, start, None)
    data = unbase64(found) or unbase64(found[: len(found) // 4 * 4]) or b""
    size = ssh_parts(data)
    if not size:
        return None
    exact, at = gathered(text, start, -(-size * 4 // 3))
    return "ssh_key", at if exact else end


def pem_key(body: str) -> bool:
    """The body of a PEM private key: base64 of a key, or headers of an encryption and whole blocks."""
    lines = body.replace("\\r", "").replace("\\n", "\n").split("\n")
    headers = {k.strip(): v.strip() for k, mark, v in (x.partition(":") for x in lines) if mark}
    data = unbase64("".join(x for x in lines if ":" not in x))
    if headers:
        iv = DEK.fullmatch(headers.get("DEK-Info", "").replace(" ", ""))
        return bool(data and iv and headers.get("Proc-Type", "").replace(" ", "") == "4,ENCRYPTED" and len(data) >= 32 and len(data) % (len(iv[1]) // 2) == 0)
    return bool(key_kind(data))


def signed_token(text: str) -> bool:
    """A header with an algorithm and a body, both JSON objects."""
    head, body, _ = text.split(".", 2)
    try:
        parts = [json.loads(unbase64(x, urlsafe=True) or b"") for x in (head, body)]
    except (ValueError, RecursionError):
        return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "ssh_key" if ssh_key(data) else "der_key" if der_key(data) else None


def confirmed_spans(text: str) -> Iterator[Span]:
    """Candidates whose decoded structure holds."""
    for m in PEM.finditer(text):
        if pem_key(m[2]):
            yield "pem_key", m.start(), m.end()
    for m in TOKEN.finditer(text):
        if signed_token(m[0]):
            yield "signed_token", m.start(), m.end()
    for m in KEY64.finditer(text):
        if found := key64(text, m.start()):
            yield found[0], m.start(), found[1]
    for m in HEXES.finditer(text):
        if kind := key_kind(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])):
            yield kind, m.start(), m.end()


def listed(spans: list[Span]) -> str:
    spans = sorted(set(spans), key=lambda s: (s[1], RANK[s[0]], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scanned(text: str) -> tuple[list[Span], list[Span]]:
    return list(base_spans(text)), list(confirmed_spans(text))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def _batch(b: pa.RecordBatch) -> dict:
    out = {"doc_id": b.column(0), "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_confirmed": []}
    for text in b.column(1).to_pylist():
        base, more = scanned(text or "")
        for kind in KINDS[:3]:
            out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
        out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
        out["spans"].append(listed(base + more))
        out["n_confirmed"].append(len(more))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """The digest of each document's spans; one pass, no shuffle."""
    return common.mapped(common.narrowed(docs, "doc_id", "text"), _batch, SCHEMA)


def found(docs: DataFrame) -> DataFrame:
    """One row for each secret: doc_id, kind, start and end in code points, the text of the span."""

    def batch(b: pa.RecordBatch) -> dict:
        rows = [(i, k, a, e, t[a:e]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for k, a, e in sum(scanned(t), [])]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        cols = list(zip(*rows)) or [()] * 5
        return {n: pa.array(c, t) for n, c, t in zip(("doc_id", "kind", "start", "end", "value"), cols, kinds)}

    return common.mapped(common.narrowed(docs, "doc_id", "text"), batch, "doc_id long, kind string, start long, end long, value string")
