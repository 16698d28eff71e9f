"""Secret scan: base spans against the contract's patterns, confirmations on built keys."""

import base64
import hashlib
import json
import random
import time
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from kindsort.llm import secrets
from kindsort.llm.queries import op10_secrets

WORDS = "password|passwd|secret|token|api_?key"
EITHER = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in WORDS)


def plain_base(text):
    """The contract's patterns, unoptimised, letter case spelled out."""
    out = []
    for m in re.finditer(rf"""({EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return sorted(out)


def base_of(text):
    return [s for s in secrets.spans(text) if s[1] < 3]


def kinds(text):
    return [secrets.KINDS[k] for _, k, _ in secrets.spans(text) if k >= 3]


PARTS = st.sampled_from(["password", "Token", "SECRET", "api_key", "apikey", "=", ": ", ' = "', "'", '"', "abcdef123456", "AKIA", "ABCDEFGH1234567890", "0123456789abcdef", "AKIAAKIA", "é", " ", "\n", "-", "ſecret=", "toKen=", "x" * 13, "==", "deadbeef"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_base_spans(text):
    assert base_of(text) == plain_base(text)


def tlv(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def keys():
    rng = random.Random(1)
    num = lambda n: tlv(2, b"\x01" + rng.randbytes(n))
    pkcs1 = tlv(0x30, tlv(2, b"\0") + b"".join(num(k) for k in (128, 2, 128, 64, 64, 64, 64, 64)))
    pkcs8 = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, rng.randbytes(9)) + tlv(5, b"")) + tlv(4, pkcs1))
    sec1 = tlv(0x30, tlv(2, b"\1") + tlv(4, rng.randbytes(32)) + tlv(0xA0, tlv(6, rng.randbytes(8))))
    s = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(s(b"ssh-ed25519") + s(rng.randbytes(32))) + s(rng.randbytes(128))
    return {"pkcs1": pkcs1, "pkcs8": pkcs8, "sec1": sec1, "ssh": ssh}


def test_keys_are_confirmed_and_damaged_ones_not():
    for name, key in keys().items():
        one = base64.b64encode(key).decode()
        assert kinds(f"é key {one} end") == ["base64_key"], name
        assert kinds(f"x\n-----BEGIN PRIVATE KEY-----\n{one}\n-----END PRIVATE KEY-----\n").count("pem_key") == 1
        if name != "ssh":
            assert kinds(key.hex()) == ["hex_key"]
        assert kinds(base64.b64encode(key[:-1]).decode()) == []
        assert kinds(base64.b64encode(key + b"\0\0\0").decode()) in ([], ["base64_key"][: name == "ssh"])
    assert kinds(base64.b64encode(random.Random(3).randbytes(600)).decode()) == []
    assert kinds("-----BEGIN PRIVATE KEY-----\nbm90IGEga2V5\n-----END PRIVATE KEY-----") == []


def test_signed_tokens():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    good = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2ln"
    text = f"see {good} here"
    assert [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.spans(text) if k == 3] == [("signed_token", good)]
    assert kinds(f"{part({'typ': 'x'})}.{part({})}.c2ln") == []
    assert kinds("eyJub3Q.anNvbg.x") == []
    assert kinds(f"{part({'alg': 'none'})}.bm90anNvbg.") == []


def test_query(spark):
    got = {r["doc_id"]: r for r in op10_secrets(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base = plain_base(d["text"])
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        r = got[d["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")] == said.split(",") * bool(said) or (not said and not base)


def test_odd_rows(make):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (None, "token=abcdefghijkl"), (4, "token=abcdefghijkl"), (4, "token=abcdefghijkl"), (5, "a1 " * 100_000 + "f" * 200_000)]
    out = make(rows, "doc_id long, text string").withColumn("spans", F.lit("mine")).withColumn("s", secrets.secrets(F.col("text"))).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert [r["s"]["base_sha256"] == nothing for r in out] == [True, True, False, False, False, False]
    assert out[-1]["s"]["spans"] == "hex:300000:500000"
    assert make([], "doc_id long, text string").withColumn("s", secrets.secrets(F.col("text"))).count() == 0


def test_keys_in_json_source_and_wrapped_lines():
    import textwrap

    for name, key in keys().items():
        for width in (64, 76):
            body = "\n".join(textwrap.wrap(base64.b64encode(key).decode(), width))
            pem = f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----\n"
            assert kinds(pem) == ["pem_key"] or name == "sec1", name
            for text in (json.dumps({"private_key": pem}), json.dumps(json.dumps({"k": pem})), json.dumps(pem).replace("/", "\\/").replace("=", "\\u003d"), "k = (" + "\n  ".join(json.dumps(x + "\n") for x in pem.splitlines()) + ")", " +\n".join(json.dumps(x + "\n") for x in pem.splitlines())):
                assert "pem_key" in kinds(text), (name, text)
            for text in (body, f"The key:\n{body}\n\nend", f"x\r\n{body}\r\nend of it".replace("\n", "\r\n").replace("\r\r", "\r"), textwrap.indent(body, "    "), json.dumps(f"k\n{body}\n")):
                assert kinds(text) == ["base64_key"], (name, text)
            if name != "ssh":
                assert kinds(body[:-8] + "\n") == []
    first = textwrap.wrap(base64.b64encode(keys()["pkcs8"]).decode(), 64)[0]
    assert kinds(f"-----BEGIN PRIVATE KEY-----\n{first}\n{pem}") == ["pem_key"]


def test_upper_case_hex_and_any_header():
    for name in ("pkcs1", "pkcs8", "sec1"):
        assert kinds(f"0x{keys()[name].hex().upper()}") == ["hex_key"]
    for head in (b'{ "alg": "HS256"}', b'{\n "alg": "HS256"}', b' {"alg":"HS256"}', b'\n{"alg":"HS256"}'):
        part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
        token = f"{part(head)}.{part(b'{}')}.c2ln"
        for text in (token, f"see example.{token}", f'"a\\n{token}"'):
            assert [text[a:b] for a, k, b in secrets.spans(text) if k == 3] == [token]


def test_many_beginnings_of_wrapped_keys_take_time_in_proportion():
    """Heads of keys without their bodies, thousands of lines: each is told by its lengths."""
    ssh = base64.b64encode(b"openssh-key-v1\0" + b"\0\0\0\4none" * 2 + b"\0\0\0\0\0\0\0\1\0\0\0\x33" + b"k" * 9).decode()[:64]
    rsa = base64.b64encode(b"0\x82\x7f\xf0\2\1\0\2\x82\1\1" + b"k" * 40).decode()[:64]
    for line in (ssh, rsa):
        seconds = []
        for n in (4000, 16000):
            text = (line + "\n") * n
            t0 = time.perf_counter()
            secrets.spans(text)
            seconds.append(time.perf_counter() - t0)
        assert seconds[1] < 8 * seconds[0] + 0.2 and seconds[1] < 5
