"""Secret scan: pattern matches, plus keys and tokens confirmed by their structure.

Base kinds are matches of fixed patterns.  The structural kinds start from base64 or
hex candidates that are decoded and parsed before anything is reported: a signed
token needs a JSON header that names an algorithm and a JSON body, a DER private key
needs nested lengths that fill its outer length exactly and the fields of a known key
form, an OpenSSH key needs its magic and a chain of length-prefixed strings.  A key's
extent is what its own lengths say, not how far the alphabet happens to run.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from .batches import append_columns

# The kinds, in the order that breaks ties between equal starts.
BASE_KINDS = ("assign", "access", "hex")
STRUCTURAL_KINDS = ("jwt", "der", "openssh")
KINDS = BASE_KINDS + STRUCTURAL_KINDS

# Letters in either case, spelled out: a leading class lets the search skip ahead.
ASSIGN = re.compile(
    r"""[pPsStTaA](?:(?<=[pP])[aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|(?<=[sS])[eE][cC][rR][eE][tT]"""
    r"""|(?<=[tT])[oO][kK][eE][nN]|(?<=[aA])[pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# An object's brace encodes to "e" and one of w-z.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[w-z][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.[A-Za-z0-9_-]*")
# Lines of a key may be wrapped, indented, quoted and their ends escaped, as in JSON.
BREAK = re.compile(r"""(?:[ \t"'>#]*+(?:\r?\n|(?:\\+r)?\\+n))++[ \t"'>#]*+""")
# A DER sequence (0x30) encodes to "M" and one of A-P.
DER_BASE64 = re.compile(
    rf"M[A-P](?:(?<![A-Za-z0-9+/_-]..)|(?<=\\[nrt]..)|(?<=-----..))(?:[A-Za-z0-9+/_-]|{BREAK.pattern}(?=[A-Za-z0-9+/_-])){{30,}}={{0,2}}"
)
DER_BEGIN, OPENSSH_BEGIN = re.compile("M[A-P]"), re.compile("b3BlbnNzaC1rZXktdj")
DER_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}")
OPENSSH_MAGIC = b"openssh-key-v1\0"
OPENSSH = re.compile(rf"b3BlbnNzaC1rZXktdj(?:[A-Za-z0-9+/]|{BREAK.pattern}(?=[A-Za-z0-9+/]))+={{0,2}}")


def _bytes_of(candidate: str) -> bytes:
    """Decoded base64 of either alphabet, missing padding allowed."""
    flat = candidate.replace("=", "").replace("-", "+").replace("_", "/")
    flat = flat[: len(flat) - (len(flat) % 4 == 1)]
    try:
        return base64.b64decode(flat + "=" * (-len(flat) % 4))
    except binascii.Error:
        return b""


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of the DER element at ``at``."""
    if at + 2 > end:
        return None
    tag, length, body = data[at], data[at + 1], at + 2
    if length & 128:
        n = length & 127
        if not 1 <= n <= 4 or body + n > end or data[body] == 0:
            return None
        length, body = int.from_bytes(data[body : body + n], "big"), body + n
        if length < 128:
            return None
    return (tag, body, body + length) if body + length <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``at`` to ``end`` exactly."""
    found = []
    while at < end:
        e = _element(data, at, end)
        if e is None:
            return None
        found.append(e)
        at = e[2]
    return found


def der_private_key(data: bytes) -> int | None:
    """Bytes of the DER private key that ``data`` starts with: PKCS#1, PKCS#8 (plain or
    encrypted), SEC1 or DSA."""
    outer = _element(data, 0, len(data))
    if not outer or outer[0] != 0x30:
        return None
    inner = _elements(data, outer[1], outer[2])
    if not inner:
        return None
    tags = [t for t, _, _ in inner]
    first = data[inner[0][1] : inner[0][2]]
    nested = lambda e: _elements(data, e[1], e[2]) or []
    starts_with_id = lambda e: [t for t, _, _ in nested(e)][:1] == [0x06]
    known = (
        (tags[:9] == [2] * 9 and first in (b"\0", b"\1"))
        or (tags == [2] * 6 and first == b"\0")
        or (tags[:3] == [2, 0x30, 4] and first in (b"\0", b"\1") and starts_with_id(inner[1]))
        or (tags[:2] == [2, 4] and first == b"\1" and inner[1][2] - inner[1][1] >= 20)
        or (tags == [0x30, 4] and starts_with_id(inner[0]))
    )
    return outer[2] if known else None


def openssh_private_key(data: bytes) -> int | None:
    """Bytes of the OpenSSH private key that ``data`` starts with."""
    at = len(OPENSSH_MAGIC)
    if not data.startswith(OPENSSH_MAGIC):
        return None

    def skip(at: int | None) -> int | None:
        if at is None or at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if end <= len(data) else None

    for _ in range(3):  # cipher, derivation, its options
        at = skip(at)
    if at is None or at + 4 > len(data):
        return None
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 64:
        return None
    for _ in range(keys + 1):  # public keys, then the private block
        at = skip(at)
    return at


def _der_size(data: bytes) -> int:
    """Bytes that the DER sequence at the start of ``data`` says it has; 0 if it is none."""
    if len(data) < 6 or data[0] != 0x30:
        return 0
    n = data[1] & 127
    if data[1] < 128:
        return 2 + n
    return 2 + n + int.from_bytes(data[2 : 2 + n], "big") if 1 <= n <= 4 else 0


def _keys(text: str, pattern: re.Pattern, begin: re.Pattern, parse) -> Iterator[tuple[int, int]]:
    """Start and end of the keys in the base64 candidates of ``pattern``: at the start of a
    candidate or of one of its lines, and after a key from that key's own end."""
    for m in pattern.finditer(text):
        lines, at = [], m.start()
        for gap in BREAK.finditer(text, m.start(), m.end()):
            lines.append((at, gap.start()))
            at = gap.end()
        lines.append((at, m.end()))
        done = m.start()
        for i, (start, stop) in enumerate(lines):
            if start < done or not begin.match(text, start, stop):
                continue
            size = None
            if parse is der_private_key and not (size := _der_size(_bytes_of(text[start : min(stop, start + 8)]))):
                continue
            wanted = None if size is None else -(-size * 8 // 6)
            parts, have = [], 0
            for a, b in lines[i:]:
                parts.append(text[a:b])
                have += b - a
                if wanted is not None and have >= wanted:
                    break
            if n := parse(_bytes_of("".join(parts))):
                done = _extent(text, lines[i:], n)
                yield start, done


def _extent(text: str, lines: list[tuple[int, int]], n_bytes: int) -> int:
    """Where the base64 of ``n_bytes`` bytes that fill ``lines`` ends, padding included."""
    left, end = -(-n_bytes * 8 // 6), 0
    for a, b in lines:
        end = a + min(left, b - a)
        left -= end - a
        if not left:
            break
    pad = -n_bytes % 3
    return end + pad if text[end : end + pad] == "=" * pad else end


def _signed_token(header: str, body: str) -> bool:
    try:
        head, claims = json.loads(_bytes_of(header)), json.loads(_bytes_of(body))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(claims, dict)


def _structural(text: str) -> Iterator[tuple[str, int, int]]:
    for m in JWT.finditer(text):
        if _signed_token(m[1], m[2]):
            yield "jwt", m.start(), m.end()
    yield from (("der", a, b) for a, b in _keys(text, DER_BASE64, DER_BEGIN, der_private_key))
    yield from (("openssh", a, b) for a, b in _keys(text, OPENSSH, OPENSSH_BEGIN, openssh_private_key))
    for m in DER_HEX.finditer(text):
        if n := der_private_key(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])):
            yield "der", m.start(), m.start() + 2 * n


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of every find in the whole text, in code points with the end
    exclusive, by start and then in the order of ``KINDS``."""
    if not text:
        return []
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found += _structural(text)
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with every maximal run of overlapping spans replaced by ``mark``."""
    if not spans:
        return text
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def find_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds ``secrets``, an array of ``(kind, start, end)``.

    Null and empty texts have none.  Each row is scanned by itself in one narrow pass, so
    repeated rows give repeated results; a column named ``secrets`` is replaced.
    """

    def make():
        row = lambda t: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(t)]
        return lambda texts: {"secrets": [row(t) for t in texts]}

    return append_columns(docs, ["text"], [("secrets", SPANS)], make, keep)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every find replaced by ``mark`` in ``text``; clean and
    null texts stay as they are.  ``n_chars``, if there is one, follows the text."""
    make = lambda: lambda texts: {"text": [redact(t, scan(t), mark) for t in texts]}
    out = append_columns(docs, ["text"], [("text", T.StringType())], make)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[out[f"`{c}`"] for c in docs.columns])


def joined(spans: str, kinds: tuple[str, ...] | None = None):
    """``kind:start:end`` of the spans, comma-joined; only of ``kinds`` if given."""
    items = F.col(spans)
    if kinds:
        items = F.filter(items, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
