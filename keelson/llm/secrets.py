"""Secret scan with structural confirmation.

Base findings come from three patterns.  Encoded candidates (base64, base64url
or hex runs, PEM blocks, three-part tokens) are *decoded and parsed* before
they are reported: a key must be DER whose nested lengths add up exactly, or an
OpenSSH key whose length-prefixed fields fill the blob; a signed token must
carry a JSON header with an algorithm and a JSON object as payload.

Contract for odd input: a null or empty text has no findings; the row stays.
Rows are independent, so ties and repeated rows give equal findings.  Only the
named id and text columns are read, so clashing extra columns do not matter
(``redact_secrets`` rewrites the text column in place and keeps the rest).
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

KINDS = ("assign", "access", "hex", "jwt", "der", "openssh", "pem")
BASE_KINDS = KINDS[:3]
_ORDER = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_BLOB = re.compile(r"[0-9A-Fa-f]{80,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----([^-]*)-----END ([A-Z0-9]+ )*PRIVATE KEY-----")


# ---------------------------------------------------------------- structure

def der_nodes(blob: bytes, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, value start, value end) of the DER values that fill ``blob[start:end]`` exactly, else None."""
    end = len(blob) if end is None else end
    nodes = []
    while start < end:
        if start + 2 > end:
            return None
        tag, length, start = blob[start], blob[start + 1], start + 2
        if length >= 128:
            n = length & 127
            if not 1 <= n <= 4 or start + n > end:
                return None
            length = int.from_bytes(blob[start:start + n], "big")
            if length < 128 or (n > 1 and blob[start] == 0):   # DER takes the shortest form
                return None
            start += n
        if start + length > end:
            return None
        nodes.append((tag, start, start + length))
        start += length
    return nodes


def is_der_key(blob: bytes) -> bool:
    """A private key in DER: PKCS#1, PKCS#8 (plain or encrypted), SEC 1 or DSA."""
    top = der_nodes(blob) if blob[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    nodes = der_nodes(blob, top[0][1], top[0][2])
    if not nodes:
        return False
    tags = [t for t, _, _ in nodes]
    size = [e - s for _, s, e in nodes]
    value = [blob[s:e] for _, s, e in nodes]
    if len(tags) >= 9 and tags[:9] == [2] * 9:                   # RSA: version, n, e, d, p, q, ...
        return value[0] in (b"\0", b"\1") and size[1] >= 32 and size[3] >= 16
    if tags == [2] * 6:                                          # DSA: version, p, q, g, y, x
        return value[0] == b"\0" and size[1] >= 32
    if tags[:3] == [2, 0x30, 4] and value[0] in (b"\0", b"\1"):  # PKCS#8
        inner = der_nodes(blob, nodes[1][1], nodes[1][2])
        return bool(inner) and inner[0][0] == 6 and size[2] >= 16
    if tags[:2] == [2, 4] and value[0] == b"\1" and 16 <= size[1] <= 80:   # SEC 1
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags == [0x30, 4]:                                        # encrypted PKCS#8
        inner = der_nodes(blob, nodes[0][1], nodes[0][2])
        return bool(inner) and inner[0][0] == 6 and size[1] >= 16
    return False


def is_openssh_key(blob: bytes) -> bool:
    """An ``openssh-key-v1`` private key whose nested length-prefixed fields fill it."""
    magic = b"openssh-key-v1\0"
    if not blob.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(blob):
            return None
        n = int.from_bytes(blob[at:at + 4], "big")
        if at + 4 + n > len(blob):
            return None
        at += 4 + n
        return blob[at - n:at]

    if not field() or not field() or field() is None or at + 4 > len(blob):   # cipher, kdf, kdf options
        return False
    keys = int.from_bytes(blob[at:at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return False
    for _ in range(keys):
        public = field()
        if not public or len(public) < 4 or int.from_bytes(public[:4], "big") + 4 > len(public):
            return False
    private = field()
    return private is not None and len(private) >= 16 and at == len(blob)


def decode_base64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_kind(blob: bytes | None) -> str | None:
    if not blob:
        return None
    return "der" if is_der_key(blob) else "openssh" if is_openssh_key(blob) else None


def _json_object(part: str) -> dict | None:
    blob = decode_base64(part)
    if blob is None:
        return None
    try:
        value = json.loads(blob.decode("utf-8"))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(run: str) -> bool:
    """Header is a JSON object naming an algorithm, payload a JSON object, signature decodes."""
    head, body, sign = run.split(".")
    header = _json_object(head)
    if not header or not isinstance(header.get("alg"), str) or _json_object(body) is None:
        return False
    return header["alg"].lower() == "none" if not sign else decode_base64(sign) is not None


# ---------------------------------------------------------------- scanning

def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by start and then kind."""
    if not text:
        return []
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            lines = [x for x in m[2].splitlines() if ":" not in x]      # header lines of older encrypted keys
            body = re.sub(r"\s+", "", "".join(lines))
            legacy_encrypted = len(lines) < len(m[2].splitlines()) and "ENCRYPTED" in m[2]
            blob = decode_base64(body)
            if key_kind(blob) or (legacy_encrypted and blob and len(blob) % 8 == 0 and len(blob) >= 64):
                found.append(("pem", *m.span()))
    for m in _ENCODED.finditer(text):
        kind = key_kind(decode_base64(m[0]))
        if kind:
            found.append((kind, *m.span()))
    for m in _HEX_BLOB.finditer(text):
        kind = key_kind(bytes.fromhex(m[0])) if len(m[0]) % 2 == 0 else None
        if kind:
            found.append((kind, *m.span()))
    if "ey" in text or "ew" in text:
        found += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    return sorted(set(found), key=lambda x: (x[1], _ORDER[x[0]], x[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans: array<struct<kind,start,end>>), one row per input row; no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t)]
                     for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS)], names=["id", "spans"])

    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    out = map_batches(narrow, scan, f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every maximal run of overlapping findings replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in find_secrets(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` with findings in ``text_col`` replaced; ``length_col``, if given, follows the new text."""
    names = df.columns
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t and redact(t) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if length_at is not None:
                columns[length_at] = pa.array([None if t is None else len(t) for t in texts],
                                              b.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_batches(df, clean, df.schema)
