"""Secret scan with structural confirmation.

Base spans come from three plain patterns. Further candidates (base64 and hex runs, armoured keys, dotted tokens) are
decoded and parsed: key encodings must nest with lengths that add up, wire-format keys must be a chain of length-prefixed
strings, and token headers must be JSON objects that name an algorithm. Only then are they reported.

Results for odd input: null text is empty and has no spans; texts are scanned whole; equal rows give equal rows; an empty
table gives an empty table; only the two named columns are read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, raw_bytes, strings

#: Fixed patterns of the base kinds, and the least length that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "armoured_key", "encoded_key", "wire_key", "signed_token"]

HEX_RUN = re.compile(r"[0-9a-f]{16,}")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9]+ )*KEY-----(?P<body>[A-Za-z0-9+/=\s]{32,})-----END ([A-Z0-9]+ )*KEY-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")

_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True
_RUN_BYTES = np.zeros(256, bool)
_RUN_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")] = True


def read_der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of content, end of content) of the element at `at`, or None when its length does not fit."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at:at + width], "big"), at + width
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All elements between at and end, which they must fill exactly."""
    out = []
    while at < end:
        if (x := read_der(data, at, end)) is None:
            return None
        out.append(x)
        at = x[2]
    return out


def is_key_structure(data: bytes) -> bool:
    """A sequence that fills the data and holds what a private or public key holds, with nested lengths that add up."""
    top = read_der(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data) or (inner := children(data, top[1], top[2])) is None:
        return False
    tags = [x[0] for x in inner]
    if len(tags) >= 8 and set(tags) == {0x02}:  # nine integers: version, modulus, exponents, primes
        return True
    if tags[:3] == [0x02, 0x30, 0x04]:  # version, algorithm, wrapped key
        names = children(data, inner[1][1], inner[1][2])
        return bool(names) and names[0][0] == 0x06
    if tags[:2] == [0x02, 0x04] and inner[1][2] - inner[1][1] in (28, 32, 48, 66):  # version, private scalar of a curve
        return True
    if tags == [0x30, 0x03]:  # algorithm, public bits
        names = children(data, inner[0][1], inner[0][2])
        return bool(names) and names[0][0] == 0x06
    if tags == [0x30, 0x04]:  # encrypted key: algorithm with parameters, octets
        names = children(data, inner[0][1], inner[0][2])
        return bool(names) and names[0][0] == 0x06 and len(names) > 1
    return False


def is_wire_key(data: bytes) -> bool:
    """An OpenSSH container or a public key: a chain of length-prefixed strings that starts with a key type."""
    if data.startswith(b"openssh-key-v1\0"):
        at, left = 15, 3  # cipher, key derivation, its options
        while left:
            size = int.from_bytes(data[at:at + 4], "big")
            if at + 4 > len(data) or at + 4 + size > len(data):
                return False
            at, left = at + 4 + size, left - 1
        return at + 4 <= len(data) and 1 <= int.from_bytes(data[at:at + 4], "big") <= 16
    at, parts = 0, []
    while at < len(data):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 > len(data) or at + 4 + size > len(data):
            return False
        parts.append(data[at + 4:at + 4 + size])
        at += 4 + size
    return len(parts) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-[a-z0-9@.-]+", parts[0]) is not None


def from_base64(run: str, url: bool = False) -> bytes | None:
    body = re.sub(r"\s+", "", run).rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    try:
        head, body = (json.loads(from_base64(x, True) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict) and from_base64(signature, True) is not None


def confirmed(data: bytes | None) -> str | None:
    if not data:
        return None
    return "encoded_key" if is_key_structure(data) else "wire_key" if is_wire_key(data) else None


def base_spans(text: str, hex_run: bool = True) -> list[tuple[str, int, int]]:
    """Spans of the plain patterns: leftmost and non-overlapping per kind, then those long enough."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if hex_run:  # a run of enough digits starts where the plain pattern starts: shorter runs fail and touch nothing else
        out += [("hex", m.start(), m.end()) for m in HEX_RUN.finditer(text)]
    return out


def structural_spans(text: str, long_run: bool = True) -> list[tuple[str, int, int]]:
    out = []
    if "-----BEGIN " in text:
        for m in ARMOUR.finditer(text):
            if confirmed(from_base64(m["body"])):
                out.append(("armoured_key", m.start(), m.end()))
    if "eyJ" in text:
        out += [("signed_token", m.start(), m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2], m[3])]
    if long_run:
        inside = [(a, b) for _, a, b in out]
        for m in BASE64_RUN.finditer(text):
            if not any(a <= m.start() and m.end() <= b for a, b in inside) and (kind := confirmed(from_base64(m[0]))):
                out.append((kind, m.start(), m.end()))
        for m in HEX_ANY.finditer(text):
            if kind := confirmed(bytes.fromhex(m[0])):
                out.append((kind, m.start(), m.end()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(set(spans), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def long_runs(data: np.ndarray, ends: np.ndarray, member: np.ndarray, least: int) -> np.ndarray:
    """For each row, whether some run of member bytes of at least that length lies in it or reaches into it."""
    inside = np.flatnonzero(np.diff(member[data].view(np.int8), prepend=0, append=0))
    starts, stops = inside[::2], inside[1::2]
    wide = stops - starts >= least
    flags = np.zeros(len(ends), bool)
    for edge in (starts[wide], stops[wide] - 1):
        flags[np.searchsorted(ends, edge, "right") - 1] = True
    for a, b in zip(starts[wide], stops[wide], strict=True):  # a run may cross rows; rare and harmless
        flags[np.searchsorted(ends, a, "right") - 1:np.searchsorted(ends, b, "left")] = True
    return flags[:-1]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans, and how many the structure confirmed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, ends = raw_bytes(batch.column(1))
        hexes, runs = long_runs(data, ends, _HEX_BYTES, LEAST["hex"]), long_runs(data, ends, _RUN_BYTES, 40)
        rows = []
        for n, text in enumerate(strings(batch.column(1))):
            base = base_spans(text, bool(hexes[n]))
            more = structural_spans(text, bool(runs[n]))
            count = [sum(x[0] == k for x in base) for k in KINDS[:3]]
            rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(set(more))))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(6))],
            names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    key = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), f"`{id_col}` {key}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_confirmed bigint", run)
