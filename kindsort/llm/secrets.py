"""Secret scan with structural confirmation.

Patterns give the base spans.  What looks like encoded data is decoded and must have
the structure of a secret before it is reported: a signed token's header must be
JSON that names an algorithm, a private key's nested DER lengths must add up, an
OpenSSH key's length-prefixed fields must fit.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: base patterns and least lengths of the contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18
# END FIXED VALUES
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Overlapping candidates: three base64url parts, the first decoding to a brace or white space.
TOKEN = re.compile(r"(?:(?<=\\[nrt])|(?<![A-Za-z0-9_-]))(?=([eICD][A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*))")
#: A string that goes on in another literal of the source; escapes of JSON and source.
GOES_ON, ESCAPE = r"""["']\s*(?:[+.\\]\s*)?["']""", r"\\+(?:[nrt/]|u00(?:2[bBfF]|3[dD]))"
PEM = re.compile(rf"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s:,.]|-(?!----(?:BEGIN|END) )|{ESCAPE}|{GOES_ON})*+)-----END \1-----")
#: Where base64 starts, also after an escaped line break, whose letter is none of it.
START = r"(?:(?<=\\[nrt])|(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nrt]))"
BASE64 = re.compile(START + r"[A-Za-z0-9+/_-]{40,}={0,2}")
#: Between two lines of wrapped base64.
EOL = re.compile(r"""(?:["'][ \t]*(?:[+.\\][ \t]*)?)?\r?\n[ \t]*(?:[+.][ \t]*)?["']?|(?:\\+r)?\\+n(?:["']\s*(?:[+.\\]\s*)?["'])?""")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "signed_token", "pem_key", "base64_key", "hex_key")


def unbase64(s: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it isn't."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list[tuple[int, object]] | None:
    """(tag, content) of the DER values that fill ``data[at:end]`` exactly; None if lengths don't add up.

    The content of SEQUENCE and SET is parsed too, other contents are bytes.
    """
    end, out = len(data) if end is None else end, []
    while at < end:
        if at + 2 > end or depth > 16:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80 or size >> (8 * (n - 1)) == 0:  # not the shortest form
                return None
        if at + size > end:
            return None
        if tag in (0x30, 0x31):
            inner = der(data, at, at + size, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """A PKCS#1, PKCS#8 (plain or encrypted) or SEC1 private key."""
    if len(data) < 32 or data[0] != 0x30:
        return False
    top = der(data)
    if not top or len(top) != 1:
        return False
    tags, values = [t for t, _ in top[0][1]], [v for _, v in top[0][1]]
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:  # PKCS#1: version and eight integers
        return values[0] in (b"\0", b"\1") and len(values[1]) >= 32
    if len(tags) >= 3 and tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8
        return values[0] in (b"\0", b"\1") and bool(values[1]) and values[1][0][0] == 0x06
    if len(tags) >= 2 and tags[:2] == [0x02, 0x04]:  # SEC1
        return values[0] == b"\1" and 16 <= len(values[1]) <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags == [0x30, 0x04]:  # PKCS#8, encrypted
        return bool(values[0]) and values[0][0][0] == 0x06 and len(values[1]) >= 16
    return False


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: its magic, then length-prefixed cipher, derivation and options, a count, and keys."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), []
    for i in range(5):
        if i == 3:
            if at + 4 > len(data) or not 1 <= int.from_bytes(data[at : at + 4], "big") <= 16:
                return False
            at += 4
        if at + 4 > len(data):
            return False
        size, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if at + size > len(data):
            return False
        fields.append(data[at : at + size])
        at += size
    return bool(fields[0]) and fields[0].isascii() and len(fields[4]) >= 16


def is_signed_token(s: str) -> bool:
    """Three parts, of which the first is a JSON object with ``alg`` and the second a JSON object."""
    head, body, _ = s.split(".")
    try:
        h, b = (json.loads(unbase64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(b, dict)


def unescape(body: str) -> str:
    """A PEM body with the line breaks and signs that its escapes stand for."""
    body = re.sub(GOES_ON, "", body) if '"' in body or "'" in body else body
    return re.sub(ESCAPE, lambda m: {"n": "\n", "/": "/", "b": "+", "f": "/", "d": "="}.get(m[0][-1].lower(), " "), body) if "\\" in body else body


def is_pem_key(label: str, body: str) -> bool:
    body = unescape(body)
    lines = [x.strip() for x in body.split("\n")]
    encrypted = any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in lines)
    data = unbase64("".join("".join(x.split()) for x in lines if ":" not in x and "," not in x))
    if not data:
        return False
    return (encrypted and len(data) >= 32) or is_der_key(data) or is_ssh_key(data)


def may_be_key(tags: list[int]) -> bool:
    """Whether the first elements of a DER sequence can be those of a key (see :func:`is_der_key`)."""
    def begins(*shape: int) -> bool:
        return all(a == b for a, b in zip(tags, shape, strict=False))

    pkcs1, pkcs8, encrypted = begins(*[0x02] * 9), begins(0x02, 0x30, 0x04), begins(0x30, 0x04) and len(tags) <= 2
    return pkcs1 or pkcs8 or encrypted or (begins(0x02, 0x04) and set(tags[2:]) <= {0xA0, 0xA1})


class Wrapped:
    """Base64 over lines of one width, from a line on: any byte of what it decodes to, without decoding the rest.

    Lines are looked for once a text: those after a line are the same whichever key begins before them."""

    def __init__(self, text: str):
        self.text = text
        self.after: dict[int, tuple[list[tuple[int, int]], int]] = {}  # start of a line: its stretch, place in it

    def stretch(self, m: re.Match) -> tuple[list[tuple[int, int]], int]:
        """(start, end) of the lines of the width of ``m`` that follow each other, the last perhaps shorter, and the place of ``m``."""
        known = self.after.get(m.start())
        if known and known[0][known[1]][1] == m.end():
            return known
        width, lines, end = m.end() - m.start(), [(m.start(), m.end())], m.end()
        while (gap := EOL.match(self.text, end)) and (line := LINE.match(self.text, gap.end())):
            size = line.end() - line.start()
            if size > width:
                break
            lines.append((line.start(), line.end()))
            end = line.end()
            if size < width or line[0].endswith("="):
                break
        for i, (a, b) in enumerate(lines):
            if b - a == width:  # a shorter one ends this stretch, but may begin another
                self.after[a] = (lines, i)
        return lines, 0

    def chars(self, lines: list[tuple[int, int]], first: int, at: int, n: int) -> str:
        """``n`` characters from the ``at``-th of the lines joined from ``first`` on."""
        width, out = lines[first][1] - lines[first][0], []
        i, skip = first + at // width, at % width
        while n > 0 and i < len(lines):
            a, b = lines[i]
            out.append(self.text[a + skip : min(b, a + skip + n)])
            n -= len(out[-1])
            i, skip = i + 1, 0
        return "".join(out)

    def data(self, lines: list[tuple[int, int]], first: int, at: int, n: int) -> bytes:
        """Bytes ``at`` to ``at + n`` of what the lines decode to, fewer past the end or where it is no base64."""
        start = at // 3 * 4
        got = self.chars(lines, first, start, (at % 3 + n + 2) // 3 * 4).rstrip("=")
        whole = unbase64(got[: len(got) - (len(got) % 4 == 1)]) or b""
        return whole[at % 3 : at % 3 + n]

    def promised(self, lines: list[tuple[int, int]], first: int) -> int | None:
        """Bytes of the key that begins with a line, by its nested lengths; None if they cannot be those of a key.

        Only headers are read: the outer length and up to nine elements of a DER sequence,
        or the five fields of an OpenSSH key."""
        room = sum(b - a for a, b in (lines[first], lines[-1])) + (len(lines) - first - 2) * (lines[first][1] - lines[first][0]) if len(lines) - first > 1 else lines[first][1] - lines[first][0]
        most = room * 3 // 4
        head = self.data(lines, first, 0, 15)
        if head == b"openssh-key-v1\0":
            at = 15
            for i in range(5):
                at += 4 * (i == 3)
                size = self.data(lines, first, at, 4)
                at += 4 + int.from_bytes(size, "big")
                if len(size) < 4 or at > most:
                    return None
            return at
        if head[:1] != b"0" or (outer := self._header(head[:6])) is None or sum(outer) > most:
            return None
        end, at, tags = sum(outer), outer[0], []
        while at < end and len(tags) < 9:
            cell = self.data(lines, first, at, 6)
            inner = self._header(cell)
            if inner is None or at + sum(inner) > end:
                return None
            tags.append(cell[0])
            at += sum(inner)
            if not may_be_key(tags):
                return None
        return end

    @staticmethod
    def _header(data: bytes) -> tuple[int, int] | None:
        """Bytes of a DER header and of its content."""
        if len(data) < 2:
            return None
        if data[1] < 0x80:
            return 2, data[1]
        n = data[1] & 0x7F
        return (2 + n, int.from_bytes(data[2 : 2 + n], "big")) if 1 <= n <= 4 and len(data) >= 2 + n else None


def wrapped_key(text: str, m: re.Match, wrapped: Wrapped | None = None) -> int | None:
    """End of the key whose first line is ``m``: lines of one width, the last may be shorter.

    Nothing is decoded whole unless the lengths at its beginning can be those of a key."""
    if m[0][0] not in "Mb" or m[0].endswith("="):
        return None
    wrapped = wrapped or Wrapped(text)
    lines, first = wrapped.stretch(m)
    if len(lines) - first < 2 or (size := wrapped.promised(lines, first)) is None:
        return None
    width, chars = lines[first][1] - lines[first][0], (size + 2) // 3 * 4
    # the key ends in the line that holds its last character; a line that is cut short by padding ends it too
    last = min(first + max(0, (chars - 1) // width), len(lines) - 1)
    for stop in (last, last - 1):
        body = "".join(text[a:b] for a, b in lines[first : stop + 1])
        if stop > first and (data := unbase64(body)) and (is_der_key(data) or is_ssh_key(data)):
            return lines[stop][1]
    return None


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text, in order; kinds by their place in ``KINDS``."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(c in low for c in CUES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    for m in HEX.finditer(text):
        out.append((m.start(), 2, m.end()))
        if len(m[0]) >= 64 and len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            out.append((m.start(), 6, m.end()))
    for m in HEX_KEY.finditer(text):
        if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])) and (m.start(), 6, m.end()) not in out:
            out.append((m.start(), 6, m.end()))
    if "." in text:
        end = 0
        for m in TOKEN.finditer(text):
            if m.start() >= end and is_signed_token(m[1]):
                end = m.end(1)
                out.append((m.start(), 3, end))
    armoured = []
    if "-----BEGIN " in text:
        armoured = [(m.start(), 4, m.end()) for m in PEM.finditer(text) if is_pem_key(m[1], m[2])]
        out += armoured
    done, wrapped = 0, Wrapped(text)
    for m in BASE64.finditer(text):
        if (data := unbase64(m[0])) and (is_der_key(data) or is_ssh_key(data)):
            out.append((m.start(), 5, m.end()))
        elif m.start() >= done and not any(a < m.start() < b for a, _, b in armoured) and (end := wrapped_key(text, m, wrapped)):
            out.append((m.start(), 5, end))
            done = end
    return sorted(out)


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def report(text: str | None) -> tuple[int, int, int, str, str]:
    found = spans(text)
    said = [(k, f"{KINDS[k]}:{a}:{b}") for a, k, b in found]
    base = ",".join(s for k, s in said if k < 3)
    count = [sum(k == i for k, _ in said) for i in range(3)]
    return *count, hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s in said)


def secrets(text: Column) -> Column:
    """Struct column of the counts, the digest of the base spans and all ``spans`` of a text.

    A null text is empty: no spans, the digest of nothing.
    """

    @F.arrow_udf(RESULT)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
        for batch in texts:
            columns = list(zip(*(report(t.as_py()) for t in batch), strict=True)) or [[]] * len(kinds)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return scan.asNondeterministic()(text)
