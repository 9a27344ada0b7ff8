"""Secret scan with structural confirmation (operator 9).

Patterns give candidates; a candidate in base64 or hex is then decoded, and is reported under a kind of
its own when the bytes parse as a key encoding (nested DER lengths, length-prefixed public or OpenSSH private
keys, whole cipher blocks behind the headers of a legacy encrypted key) or as a signed token's header.
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
from pyspark.sql import functions as F

from blocktape.llm.common import fresh, in_arrow

KINDS = ("assign", "access", "hex", "pem", "der", "sshkey", "token")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more: what `[0-9a-f]+` gives after its length test
WORDS = ("passw", "secret", "token", "apikey", "api_key")
HEX_CASED = re.compile(r"[0-9A-Fa-f]{24,}")  # runs of either case, decoded only
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
INNER = re.compile(r"(?<=[+/_-])[A-Za-z0-9]")  # where a key may begin that a separator of the alphabet joins to a name
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*(?:PRIVATE KEY|PUBLIC KEY|CERTIFICATE))-----([^-]*+(?:-(?!----)[^-]*+)*+)-----END \1-----")
ESCAPE = re.compile(r"(?<!\\)\\++(?:u([0-9A-Fa-f]{4})|[nrt]|(?=[\s/\"']|$))")
CIPHER = re.compile(r"(Proc-Type|DEK-Info):[^\S\n]*(\S+)")
DOTTED = re.compile(r"[A-Za-z0-9_.-]{18,}")  # the shortest token has 18 characters
ALGORITHM = re.compile(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+")
MAGIC = b"openssh-key-v1\0"


def unbase64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, with or without padding; None if it is not base64."""
    body = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_parts(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data[start:end] exactly, in definite minimal lengths."""
    parts = []
    while start < end:
        if end - start < 2:
            return None
        tag, length, at = data[start], data[start + 1], start + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
            if length < 0x80 or length >> (8 * (n - 1)) == 0:
                return None
        if at + length > end:
            return None
        parts.append((tag, at, at + length))
        start = at + length
    return parts


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that fills the bytes, whose nested elements fill it and hold an integer, bits or octets."""
    top = der_parts(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_parts(data, *top[0][1:])
    if not inner or len(inner) < 2:
        return False
    for tag, a, b in inner:
        if tag & 0x20 and der_parts(data, a, b) is None:
            return False
    return any(tag in (0x02, 0x03, 0x04) and b - a >= 1 for tag, a, b in inner)


def field(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The length-prefixed field at a place, and the place behind it."""
    end = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return (data[at + 4 : end], end) if at + 4 <= end <= len(data) else None


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that fill the bytes; the first names the algorithm."""
    fields, at = [], 0
    while at < len(data):
        if not (told := field(data, at)):
            return False
        fields.append(told[0])
        at = told[1]
    return len(fields) >= 2 and ALGORITHM.fullmatch(fields[0]) is not None


def fields_fit(run: str, at: int, start: int, size: int, most: int | None = None) -> bool:
    """Whether length-prefixed fields from byte ``start`` on fill the size bytes of a base64 run, or the first ``most`` fit; reads only the lengths."""
    n = 0
    while start < size and n != most:
        from_char = at + start // 3 * 4
        prefix = (unbase64(run[from_char : from_char + 8]) or b"")[start % 3 : start % 3 + 4]
        if len(prefix) < 4:
            return False
        start, n = start + 4 + int.from_bytes(prefix, "big"), n + 1
    return start == size or (n == most and start < size)


def may_be_key(run: str, at: int, size: int) -> bool:
    """Whether the bytes from a character of a base64 run on announce a key that ends with the run: only then are all of them decoded."""
    head = unbase64(run[at : at + 32]) or b""
    if head[:1] == b"\x30":
        n = head[1] & 0x7F if head[1] & 0x80 else 0
        return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1]) == size
    if head.startswith(MAGIC):
        return fields_fit(run, at, len(MAGIC), size, 3)
    name = head[4 : 4 + int.from_bytes(head[:4], "big")]
    return ALGORITHM.fullmatch(name) is not None and fields_fit(run, at, 0, size)


def is_openssh_key(data: bytes) -> bool:
    """The magic, cipher, kdf and its options, a count, as many public keys, and the private part, which end with the bytes."""
    if not data.startswith(MAGIC):
        return False
    at = len(MAGIC)
    for _ in range(3):
        if not (told := field(data, at)):
            return False
        at = told[1]
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    for _ in range(min(count, len(data))):
        if not (told := field(data, at)) or not is_ssh_key(told[0]):
            return False
        at = told[1]
    private = field(data, at)
    return count >= 1 and private is not None and len(private[0]) > 0 and private[1] == len(data)


def is_encrypted_key(data: bytes, headers: dict[str, str]) -> bool:
    """Whole blocks of the cipher that the headers of a legacy encrypted key name, with an initial vector of a block."""
    cipher, _, vector = headers.get("DEK-Info", "").partition(",")
    if "ENCRYPTED" not in headers.get("Proc-Type", "") or not cipher or not re.fullmatch("(?:[0-9A-Fa-f]{16}){1,2}", vector):
        return False
    return len(data) % (len(vector) // 2) == 0


def pem_bodies(text: str) -> tuple[dict[str, str], list[str]]:
    """Cipher headers of a PEM body, and its base64 without escapes, white space and headers, as it may be read."""
    text = ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else "\n" if m[0][-1] in "nrt" else "", text)
    lines = CIPHER.sub("", text).splitlines()
    bodies = ["".join("".join(x for x in lines if ":" not in x).split())]
    lines = text.splitlines()
    told = [i for i, x in enumerate(lines) if ":" in x]
    blank = [i for i, x in enumerate(lines) if told and i > told[0] and not x.strip()]
    if blank:  # headers may run over several lines, up to the first blank one
        bodies.append("".join("".join(lines[blank[0] :]).split()))
    return dict(CIPHER.findall(text)), bodies


def is_signed_header(data: bytes | None) -> bool:
    """A JSON object that names an algorithm."""
    if not data or not data.lstrip().startswith(b"{"):
        return False
    try:
        header = json.loads(data)
    except ValueError:
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def confirmed(text: str, hexes: list[tuple[int, int]]) -> Iterator[tuple[int, str, int]]:
    """(start, kind, end) of candidates whose decoded bytes have the structure of a key or signed token."""
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            headers, bodies = pem_bodies(m[2])
            if any((data := unbase64(x)) and (is_der_key(data) or is_openssh_key(data) or is_encrypted_key(data, headers)) for x in bodies):
                yield m.start(), "pem", m.end()
    for start, end in hexes + [m.span() for m in HEX_CASED.finditer(text)]:
        if (end - start) % 2 == 0 and text.startswith("30", start) and is_der_key(bytes.fromhex(text[start:end])):
            yield start, "der", end
    for m in ENCODED.finditer(text):
        run, length = m[0], len(m[0].rstrip("="))
        for at in [0, *(i.start() for i in INNER.finditer(run, 1, len(run) - 31))]:
            if run[at] not in "MAb" or not may_be_key(run, at, (length - at) * 3 // 4):
                continue
            data = unbase64(run[at:])
            if data and is_der_key(data):
                yield m.start() + at, "der", m.end()
            elif data and (is_ssh_key(data) or is_openssh_key(data)):
                yield m.start() + at, "sshkey", m.end()
    for m in DOTTED.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for header, payload, signature in zip(parts, parts[1:], parts[2:]):
            first = (unbase64(header[:4]) or b"x").lstrip() if len(header) >= 8 else b"x"
            if first[:1] in (b"{", b"") and is_signed_header(unbase64(header)) and (unbase64(payload) or b"").lstrip().startswith(b"{"):
                yield at, "token", at + len(header) + len(payload) + len(signature) + 2
            at += len(header) + 1


def secret_spans(text: str) -> list[tuple[int, str, int]]:
    """All (start, kind, end) in code points, by start and then in the order of KINDS."""
    found: list[tuple[int, str, int]] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    hexes = [m.span() for m in HEX.finditer(text)]
    found += [(a, "hex", b) for a, b in hexes]
    found += confirmed(text, hexes)
    return sorted(set(found), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The base kinds (assign, access, hex) are the pattern matches; pem, der, sshkey and token are added
    by decoding and parsing.  A null text is empty: no span, and the hash of an empty list.  Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = fresh(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for value in batch.column(1):
                spans = secret_spans(value.as_py() or "")
                told = [(k, f"{k}:{a}:{b}") for a, k, b in spans]
                base = ",".join(x for k, x in told if k in KINDS[:3])
                values = [sum(k == kind for k, _ in told) for kind in KINDS[:3]]
                values += [hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in told)]
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.string()) for x in out[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return in_arrow(rows, scan, SCHEMA)
