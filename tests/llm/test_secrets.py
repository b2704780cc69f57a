import base64
import hashlib
import json
import re

from cases import by_id, documents, empty_documents, odd_documents
from conftest import SF_MID
from keelson.llm import queries, secrets


def plain_base(text):
    found = []
    for m in re.finditer(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, pattern, least) in enumerate([("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)], start=1):
        for m in re.finditer(pattern, text or ""):
            if len(m[0]) >= least:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def test_query_equals_brute_force(spark):
    texts = documents(SF_MID)
    got = by_id(queries.op1_secret_scan(spark, SF_MID))
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        base = plain_base(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert got[i]["n_assign"] == sum(x.startswith("assign") for x in base)
        assert set(base) <= set(got[i]["spans"].split(",")) | {""}
    assert any(r["n_hex"] for r in got.values())


def test_base_spans_of_made_texts():
    for text in ["ToKeN = 'abcdef' password:12345 api_key=Zz.Zz.Zz", "AKIA" + "Q" * 16 + "AKIA" + "0" * 40 + " AKIAQ",
                 "xy" + "0f" * 12 + "g" + "0" * 23, "é secret : \"ſecret\" passwd=longenough", "token      = "]:
        own = [f"{k}:{s}:{e}" for k, s, e in secrets.find_secrets(text) if k in secrets.BASE_KINDS]
        assert own == plain_base(text)


def der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([128 + len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def rsa_key() -> bytes:
    integers = [b"\0", b"\x7f" * 64, b"\1\0\1", b"\x55" * 64, *[b"\x33" * 32] * 5]
    return der(0x30, *[der(2, x) for x in integers])


def openssh_key(extra: bytes = b"") -> bytes:
    s = lambda b: len(b).to_bytes(4, "big") + b      # noqa: E731
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") \
        + s(s(b"ssh-ed25519") + s(b"k" * 32)) + s(b"p" * 64) + extra


def token(header=None, payload=None, sign: bytes = b"s" * 32) -> str:
    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")      # noqa: E731
    return ".".join([part(json.dumps({"alg": "HS256"} if header is None else header).encode()),
                     part(json.dumps({"sub": "x"} if payload is None else payload).encode()), part(sign)])


def kinds(text: str) -> list:
    return [(k, text[s:e]) for k, s, e in secrets.find_secrets(text) if k not in secrets.BASE_KINDS]


def test_structures_are_confirmed():
    rsa, ssh, jwt = base64.b64encode(rsa_key()).decode(), base64.b64encode(openssh_key()).decode(), token()
    assert kinds(f"key {rsa} end") == [("der", rsa)]
    assert kinds(f"key {rsa_key().hex()} end") == [("der", rsa_key().hex())]
    assert kinds(f"<{ssh}>") == [("openssh", ssh)]
    assert kinds(f"bearer {jwt}, ok") == [("jwt", jwt)]
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{rsa[:64]}\n{rsa[64:]}\n-----END RSA PRIVATE KEY-----"
    assert ("pem", pem) in kinds(f"x\n{pem}\ny")


def test_structures_with_faults_are_not_reported():
    bad_length = bytearray(rsa_key())
    bad_length[-70] ^= 0x7F
    for blob in [rsa_key()[:-1], rsa_key() + b"x", bytes(200), b"\x30\x03\x02\x01\x00" * 20, openssh_key(b"x"), openssh_key()[:-1]]:
        assert kinds(base64.b64encode(blob).decode()) == []
    assert kinds(token(header={"typ": "JWT"})) == [] and kinds(token(payload=[1])) == []
    assert kinds("eyJhbGciOi.notjson.xxxx") == [] and kinds("A" * 5000) == []


def test_odd_rows(spark):
    df = odd_documents(spark)
    out = secrets.scan_secrets(df)
    assert out.count() == df.count() and set(out.columns) == {"doc_id", "spans"}
    assert secrets.scan_secrets(empty_documents(spark)).count() == 0
    cleaned = secrets.redact_secrets(df, length_col="n_chars")
    assert cleaned.columns == df.columns and cleaned.count() == df.count()


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a token=abcdefgh b", 18), (2, "clean", 5), (3, None, None)],
                               "doc_id long, text string, n_chars long")
    got = by_id(secrets.redact_secrets(df, length_col="n_chars"))
    assert got[1]["text"] == "a [SECRET] b" and got[1]["n_chars"] == 12
    assert got[2]["text"] == "clean" and got[3]["text"] is None
