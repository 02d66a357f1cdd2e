"""Secrets in texts: fixed patterns, and encoded keys and tokens confirmed by their structure.

The patterns give the base spans: assignments to telling names, access key ids, long hex runs. Base64
(either alphabet, in one line or wrapped) and hex (either case) that starts as a key or a token may
start is then decoded and parsed, and reported only if the parts fit:

- `key`: DER whose nested lengths fill each other to the last byte and whose parts are those of a
  private key: PKCS#1 (the modulus is the product of the primes), DSA (q divides p - 1), SEC1, PKCS#8,
  encrypted PKCS#8, PKCS#12; or an OpenSSH key, field by field. An encoded length says where a key
  must end, so nothing beyond it is decoded. Public keys and certificates are no secrets.
- `token`: a signed web token: header and claims are JSON objects, the header names an algorithm, and the
  signature has that algorithm's length; or an encrypted one of five parts.

A DER key is at most 65,535 bytes long by definition here (a length of two bytes). An added span that
lies wholly in a base span isn't added again; one that only overlaps is.

Nulls and odd inputs: a null text is empty; repeated rows get equal results; other columns are ignored;
empty tables give empty results.
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

Span = tuple[str, int, int]
#: The kinds in order; the first three are the base ones, with their patterns.
KINDS = ("assign", "access", "hex", "key", "token")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What DER of a sequence looks like in base64 and hex, the start of an OpenSSH key, and of a JSON object.
_DER64 = re.compile(r"M(?=([A-P][A-Za-z0-9+/_-]{6}))")
_DER16 = re.compile(r"30(?:[0-9A-Fa-f]{2}){23,}")
_SSH_MAGIC = b"openssh-key-v1\0"
_SSH64 = re.compile(r"b3BlbnNzaC1rZXktdjEA")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[w-z0-9_-][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?(?![A-Za-z0-9_-]|\.[A-Za-z0-9_-])")
_ANY, _STANDARD = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[A-Za-z0-9+/]+")
_HEXES = re.compile(r"[0-9A-Fa-f]")
_BREAK = re.compile(r"\r?\n[ \t]*|(?:\\r)?\\n")
#: Object identifiers (DER bodies) of password-based encryption and of PKCS#7 data.
_PBE, _DATA = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c")), bytes.fromhex("2a864886f70d010701")
#: Bytes of a signature by algorithm; those of RSA have the size of the key.
_SIGNED = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
_RSA = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost first and none overlapping within a kind."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    # a run that is long enough is found from its first character, so the least length can be part of the pattern
    out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def elements(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill b[at:end] exactly; None if they don't."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = b[at], b[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            n = int.from_bytes(b[at : at + k])
            if not 1 <= k <= 2 or at + k > end or n < (0x80 if k == 1 else 0x100):  # the shortest form is the only one
                return None
            at += k
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def _known_as(b: bytes, part: tuple[int, int, int], *ids: bytes) -> bool:
    """Whether a sequence starts with an object identifier, one of those that begin with `ids` if any are named."""
    inner = elements(b, *part[1:])
    return bool(inner) and inner[0][0] == 6 and inner[0][1] < inner[0][2] and (not ids or b[inner[0][1] : inner[0][2]].startswith(ids))


def der_key(b: bytes) -> bool:
    """Whether b is the DER of a private key, or of a store of keys, to its last byte."""
    outer = elements(b, 0, len(b))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = elements(b, *outer[0][1:])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    number = lambda k: int.from_bytes(b[parts[k][1] : parts[k][2]], signed=True)
    if tags == [0x30, 4]:
        return _known_as(b, parts[0], *_PBE) and parts[1][2] - parts[1][1] >= 16
    if tags[0] != 2 or parts[0][2] - parts[0][1] != 1:
        return False
    version = number(0)
    if tags[1:9] == [2] * 8 and version in (0, 1):
        several = tags[9:] == [0x30] * version
        return several and number(1) > 1 and (number(1) == number(4) * number(5) if not version else number(1) % (number(4) * number(5) or 1) == 0)
    if tags == [2] * 6:
        return version == 0 and number(2) > 1 and (number(1) - 1) % number(2) == 0
    if tags[1:2] == [4]:
        return version == 1 and parts[1][2] - parts[1][1] >= 16 and all(t in (0xA0, 0xA1) and elements(b, *p[1:]) for t, p in zip(tags[2:], parts[2:], strict=True))
    if tags[1:3] == [0x30, 4] and version in (0, 1):
        inside = elements(b, *parts[2][1:])
        return _known_as(b, parts[1]) and bool(inside) and len(inside) == 1 and inside[0][0] in (0x30, 4, 2) and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:])
    return tags[1:] in ([0x30], [0x30, 0x30]) and version == 3 and _known_as(b, parts[1], _DATA)


def ssh_size(b: bytes) -> int | None:
    """Bytes of the OpenSSH private key that b starts with: cipher, kdf and its options, public keys, private part."""
    at = len(_SSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(b[at : at + 4])
        at += 4 + n
        return b[at - n : at] if at <= len(b) else None

    names = [field() for _ in range(3)]
    keys = int.from_bytes(b[at : at + 4])
    at += 4
    if not b.startswith(_SSH_MAGIC) or None in names or not names[0] or not names[1] or not 1 <= keys <= len(b):
        return None
    for _ in range(keys):
        public = field()
        if not public or int.from_bytes(public[:4]) + 4 > len(public):
            return None
    private = field()
    return at if private and len(private) % 8 == 0 else None


def _decoded(chars: str) -> bytes | None:
    """Base64 of either alphabet without its padding; None if it isn't what an encoder writes."""
    chars = chars.replace("-", "+").replace("_", "/")
    try:
        out = base64.b64decode(chars + "=" * (-len(chars) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    return out if base64.b64encode(out).decode().rstrip("=") == chars else None


def _gathered(text: str, at: int, letters: re.Pattern, need: int | None = None) -> tuple[str, int] | None:
    """The letters from `at` on, over line breaks, and where they and their padding end; None if they aren't `need` many."""
    parts, n = [], 0
    while m := letters.match(text, at, len(text) if need is None else min(len(text), at + need - n + 1)):
        parts.append(m[0])
        n, at = n + len(m[0]), m.end()
        if need is not None and n >= need:
            break
        gap = _BREAK.match(text, at)
        if not gap or not letters.match(text, gap.end(), gap.end() + 1):
            break
        at = gap.end()
    if need is not None and n != need:
        return None
    pads = 0
    while pads < 2 and text.startswith("=", at):
        at, pads = at + 1, pads + 1
    return "".join(parts), at


def _size(head: bytes) -> int | None:
    """Bytes of the DER whose first ones are `head`, if its first part can be that of a key."""
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    if k > 2 or head[1] == 0x80 or head[2 + k] not in (2, 0x30):
        return None
    return 2 + k + (int.from_bytes(head[2 : 2 + k]) if k else head[1])


def keys(text: str) -> Iterator[Span]:
    """Spans of encoded private keys."""
    after = 0
    # what comes before is looked at here: a pattern that begins with a letter is searched fast
    first = lambda m, letters: not (m.start() and letters.match(text, m.start() - 1, m.start()))
    for m in _DER64.finditer(text):
        if m.start() < after or not first(m, _STANDARD):
            continue
        size = _size(base64.b64decode(("M" + m[1]).replace("-", "+").replace("_", "/")))
        if size is None:
            continue
        found = _gathered(text, m.start(), _ANY, -(-size * 4 // 3))
        b = found and _decoded(found[0])
        if b and der_key(b):
            after = found[1]
            yield "key", m.start(), after
    for m in _SSH64.finditer(text):
        if not first(m, _STANDARD):
            continue
        chars, _ = _gathered(text, m.start(), _STANDARD)
        size = ssh_size(base64.b64decode(chars[: len(chars) - (len(chars) % 4 == 1)] + "==="))  # the fields say where it ends
        found = size and _gathered(text, m.start(), _STANDARD, -(-size * 4 // 3))
        if found and _decoded(found[0]):
            yield "key", m.start(), found[1]
    for m in _DER16.finditer(text):
        b = bytes.fromhex(m[0])
        if first(m, _HEXES) and not _HEXES.match(text, m.end()) and len(b) == _size(b) and der_key(b):
            yield "key", *m.span()


def _object(chars: str) -> dict | None:
    """The JSON object that a part of a token holds."""
    b = _decoded(chars)
    try:
        out = json.loads(b.decode()) if b else None
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def signed(token: str) -> bool:
    """Whether a dotted string is a signed or encrypted web token."""
    parts = token.split(".")
    header = _object(parts[0])
    rest = [_decoded(p) for p in parts[1:]]
    if not header or None in rest or not isinstance(header.get("alg"), str):
        return False
    if len(parts) == 5:
        return isinstance(header.get("enc"), str) and len(rest[1]) in (12, 16) and len(rest[3]) in (16, 24, 32)
    n, alg = len(rest[1]), header["alg"]
    return _object(parts[1]) is not None and (n >= 128 and n % 8 == 0 if alg in _RSA else n == _SIGNED.get(alg))


def added(text: str, found: list[Span]) -> list[Span]:
    """Confirmed spans that no base span holds already."""
    more = [*keys(text), *(("token", *m.span()) for m in _TOKEN.finditer(text) if signed(m[0]))]
    return [s for s in more if not any(a <= s[1] and s[2] <= b for _, a, b in found)]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256, all spans of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                own = base(text or "")
                spans = own + added(text or "", own)
                rows.append((doc, *(sum(s[0] == k for s in own) for k in KINDS[:3]), hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
