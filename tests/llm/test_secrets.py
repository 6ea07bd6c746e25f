import base64
import hashlib
import json
import random
import re
import string

import pytest

from driftline.llm import queries, secrets

BASE = [
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
]


def slow_base(text):
    found = []
    for order, (kind, pattern) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]():
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(found))


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([128 | (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k, "big")
    return bytes([tag]) + size + body


RNG = random.Random(5)
INTEGER = lambda n: der(2, b"\1" + RNG.randbytes(n))
RSA = der(0x30, der(2, b"\0"), *[INTEGER(n) for n in (128, 3, 128, 64, 64, 64, 64, 64)])
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, RSA))
SEC1 = der(0x30, der(2, b"\1"), der(4, RNG.randbytes(32)), der(0xA0, der(6, b"\x2a\x86")))
PUBLIC = der(0x30, der(0x30, der(6, b"\x2a\x86"), der(5)), der(3, b"\0" + RNG.randbytes(64)))
LENGTHED = lambda *xs: b"".join(len(x).to_bytes(4, "big") + x for x in xs)
SSH = secrets.OPENSSH_MAGIC + LENGTHED(b"none", b"none", b"") + (1).to_bytes(4, "big") + LENGTHED(b"pub" * 9, b"private" * 20)
B64 = lambda b: base64.b64encode(b).decode()
URL = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
TOKEN = f"{URL({'alg': 'HS256', 'typ': 'JWT'})}.{URL({'sub': '1'})}.c2lnbmF0dXJl"


def test_base_spans_equal_the_slow_ones():
    rng = random.Random(1)
    bits = ["password", "PASSWD", "Secret", "toKen", "apikey", "API_KEY", "pass", "ſecret", "Key", "toKen", "AKIA", "=", " ", ":", '"', "'", "\n", "é", "ab12cd",
            "AKIA" + "Q" * 16, "AKIA" + "Z9" * 12, "0123456789abcdef", "A1b2-_./+=", "x", "_"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        got = ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.scan(text) if k in secrets.BASE_KINDS)
        assert got == slow_base(text), text


@pytest.mark.parametrize("key", [RSA, PKCS8, SEC1])
@pytest.mark.parametrize("wrap", [0, 64])
def test_der_keys_are_found_with_their_own_extent(key, wrap):
    body = B64(key)
    body = "\n".join(body[i : i + wrap] for i in range(0, len(body), wrap)) if wrap else body
    text = f"é before\n{body}\nfollowing words here"
    assert [s for s in secrets.scan(text) if s[0] == "der"] == [("der", 9, 9 + len(body))]
    text = f"key {key.hex().upper()}FFFF end"
    assert [s for s in secrets.scan(text) if s[0] == "der"] == [("der", 4, 4 + 2 * len(key))]


WRAPPED = lambda k, by: by.join(re.findall(".{1,64}", B64(k)))
PEM = [  # line end of the text around the key
    "\\n", "\\r\\n", "\\\\n", "\n    ", "\r\n\t", '\\n"\n    "', "\n> ",
]


@pytest.mark.parametrize("end", PEM)
@pytest.mark.parametrize("key,kind", [(RSA, "der"), (PKCS8, "der"), (SEC1, "der"), (SSH, "openssh")])
def test_wrapped_keys(key, kind, end):
    body = WRAPPED(key, end)
    text = f'{{"key": "-----BEGIN PRIVATE KEY-----{end}{body}{end}-----END PRIVATE KEY-----{end}"}}'
    assert [(k, text[a:b]) for k, a, b in secrets.scan(text) if k in ("der", "openssh")] == [(kind, body)]


@pytest.mark.parametrize("end", ["\n", "\n  ", "\\n"])
def test_keys_that_follow_each_other(end):
    sizes = [der(0x30, der(2, b"\1"), der(4, RNG.randbytes(n)), der(0xA0, der(6, b"\x2a\x86"))) for n in range(32, 44)]
    whole = [B64(k).rstrip("=") for k in sizes]
    text = end.join(["MABC" + "x" * 60, *whole, "MIIE" + "y" * 60, whole[0]])
    assert [text[a:b] for k, a, b in secrets.scan(text) if k == "der"] == [*whole, whole[0]]
    unpadded = secrets.OPENSSH_MAGIC + LENGTHED(b"none", b"none", b"") + (1).to_bytes(4, "big") + LENGTHED(b"pub" * 9, b"p" * 162)
    ssh = B64(unpadded).rstrip("=")
    text = end.join([ssh, ssh])
    assert [text[a:b] for k, a, b in secrets.scan(text) if k == "openssh"] == [ssh, ssh]


def test_what_has_no_key_structure_is_not_reported():
    broken = bytearray(RSA)
    broken[6] ^= 0x55  # a nested length that no longer fits
    noise = "M" + "A" + "".join(RNG.choices(string.ascii_letters + string.digits, k=300))
    for text in (B64(PUBLIC), B64(bytes(broken)), noise, B64(RSA)[:200], f"{URL({'typ': 'x'})}.{URL({})}.s", f"{URL([1])}.{URL({})}.s", "e" * 200):
        assert not [s for s in secrets.scan(text) if s[0] in secrets.STRUCTURAL_KINDS]


def test_tokens_and_openssh_keys():
    text = f"auth {TOKEN}, key {B64(SSH)} end"
    spans = {k: text[a:b] for k, a, b in secrets.scan(text)}
    assert spans == {"jwt": TOKEN, "openssh": B64(SSH)}


def test_redaction_merges_overlaps():
    text = f"x token = {'ab12' * 8}; y {TOKEN}"
    assert secrets.redact(text, secrets.scan(text)) == "x [SECRET]; y [SECRET]"
    assert secrets.redact(None, []) is None


def test_frames(spark):
    rows = [(1, None, 0, "a"), (2, "", 0, "b"), (3, f"k {TOKEN}", 9, "c"), (3, f"k {TOKEN}", 9, "c"), (None, "clean words", 11, None),
            (5, "word " * 200_000 + "ab12" * 9, 0, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, secrets string")
    got = {(r.doc_id): [s.kind for s in r.secrets] for r in secrets.find_secrets(frame).collect()}
    assert got == {1: [], 2: [], 3: ["jwt"], None: [], 5: ["hex"]}
    out = secrets.redact_secrets(frame)
    assert out.columns == frame.columns and out.count() == len(rows)
    assert {r.doc_id: r.n_chars for r in out.collect()} == {1: None, 2: 0, 3: 10, None: 11, 5: 1_000_008}
    assert secrets.find_secrets(frame.limit(0)).count() == 0


def test_query_against_the_slow_base(spark):
    d = "/root/testdata/sf0.01"
    texts = dict(map(tuple, spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()))
    for r in queries.op9_secret_structure(spark, d).collect():
        base = slow_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [base.count(f"{k}:") for k in secrets.BASE_KINDS]
