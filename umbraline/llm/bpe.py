"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Text is split by a pattern; every piece is spelled in the byte alphabet (one printable character a byte), merged by the
library's BPE model, and its ids are turned back through the reversed byte table. Equal pieces are merged once per
Python worker: a bounded memo holds ids and bytes of short pieces.

Results for odd input: null text is empty; an empty text has no ids; a text of any length is encoded whole; equal rows
give equal rows; an empty table gives an empty table. Other columns are not read by the query and are kept by `encode`.
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, sliced, strings

MEMO_PIECES = 400_000  # pieces held by a task before the memo starts afresh
MEMO_CHARS = 48        # longer pieces are merged each time
SLICE = 8_000_000      # bytes of text worked on at once


def byte_alphabet() -> list[str]:
    """A printable character for every byte: printable Latin-1 stays, the others follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}
    return [shown[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts that each token was merged from: merge its bytes by all lower ranks until two parts are left."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)]
            best, at = min(found)
            if best >= rank:
                raise ValueError(f"token {rank} is not reached by merges")
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Coder:
    """Encodes and decodes one vocabulary; one per Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models

        ranks = read_ranks(ranks_path)
        self.letters = byte_alphabet()
        shown = lambda raw: "".join(self.letters[b] for b in raw)
        self.model = Tokenizer(models.BPE(
            vocab={shown(k): v for k, v in ranks.items()}, merges=[(shown(a), shown(b)) for a, b in merges_of(ranks)], ignore_merges=True))
        self.split = regex.compile(pattern).findall
        # The byte table reversed: character -> byte, token -> bytes.
        byte_of = {c: b for b, c in enumerate(self.letters)}
        self.token_bytes = {v: bytes(byte_of[c] for c in k) for k, v in self.model.get_vocab().items()}
        self.spelling = {b: c for b, c in enumerate(self.letters)}
        self.memo: dict[str, tuple[bytes, str, bytes, bytes, bytes]] = {}

    def spelled(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.spelling)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids; a character split over tokens is whole again once its bytes stand together."""
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def coded(self, pieces: list[str]) -> Iterator[tuple[bytes, str, bytes, bytes, bytes]]:
        """Packed ids, ids in decimal, decoded bytes, and packed first and last-but-one code points of each piece's tokens."""
        for p, x in zip(pieces, self.model.encode_batch([self.spelled(p) for p in pieces], add_special_tokens=False), strict=True):
            ids, spans = x.ids, x.offsets
            if len(p.encode()) != len(p):
                spans = self.spans(p, spans)
            yield array("i", ids).tobytes(), " ".join(map(str, ids)), self.decode(ids), array("i", [a for a, _ in spans]).tobytes(), array("i", [b for _, b in spans]).tobytes()

    @staticmethod
    def spans(piece: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Byte offsets of tokens as code points; a token with part of a character covers that character."""
        char_of = [n for n, c in enumerate(piece) for _ in range(len(c.encode()))]
        return [(char_of[a], char_of[b - 1] + 1) for a, b in spans]

    def encode(self, text: str) -> tuple[bytes, str, bytes, np.ndarray, np.ndarray]:
        """Packed ids, ids in decimal, the bytes that the ids decode to, and start and end of each id in code points."""
        pieces, out = self.split(text), []
        for at in range(0, len(pieces), MEMO_PIECES):  # a vast text of ever new pieces: in parts
            part = pieces[at:at + MEMO_PIECES]
            found = list(map(self.memo.get, part))
            if None in found:
                new = list({p for p, v in zip(part, found, strict=True) if v is None})
                learned = dict(zip(new, self.coded(new), strict=True))
                found = [learned[p] if v is None else v for p, v in zip(part, found, strict=True)]
                if len(self.memo) + len(learned) > MEMO_PIECES:
                    self.memo.clear()
                self.memo.update((p, v) for p, v in learned.items() if len(p) <= MEMO_CHARS)
            out += found
        size = np.fromiter(map(len, pieces), np.int32, len(pieces))
        base = np.repeat(np.cumsum(size, dtype=np.int32) - size, np.fromiter((len(x[0]) // 4 for x in out), np.int32, len(out)))
        starts, ends = (np.frombuffer(b"".join([x[k] for x in out]), np.int32) + base for k in (3, 4))
        return b"".join([x[0] for x in out]), " ".join([x[1] for x in out]), b"".join([x[2] for x in out]), starts, ends


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> Coder:
    return Coder(ranks_path, pattern)


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: number of ids, digest of the ids in decimal, digest of the decoded bytes, digest of the offsets (all
    starts, then all ends, in code points, as 32-bit little-endian numbers), and the ids if asked for."""

    def one(own: Coder, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, ids_sha, raw_sha, spans_sha, packed = [], [], [], [], []
        for text in strings(batch.column(1)):
            ids, decimal, raw, starts, ends = own.encode(text)
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(decimal.encode()).hexdigest())
            raw_sha.append(hashlib.sha256(raw).hexdigest())
            spans_sha.append(hashlib.sha256(starts.tobytes() + ends.tobytes()).hexdigest())
            if with_ids:
                packed.append(ids)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string()), pa.array(spans_sha, pa.string())]
        if with_ids:
            ends = np.cumsum([0, *counts]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path, pattern)
        for batch in batches:
            for part in sliced(batch, 1, SLICE):
                yield one(own, part)
        own.memo.clear()  # a waiting worker should hold little

    key = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256"] + ["ids"] * with_ids
    schema = f"`{id_col}` {key}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, offsets_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", prefix: str = "bpe_") -> DataFrame:
    """All columns of docs, the ids, and the code points (start, end) of each id, as prefix + ids, starts, ends."""
    added = [f"{prefix}{x}" for x in ("ids", "starts", "ends")]
    clash = set(added) & set(docs.columns)
    if clash:
        raise ValueError(f"choose another prefix: {sorted(clash)} are columns already")
    kept = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(ranks_path, pattern)
        out = [own.encode(t) for t in strings(batch.column(kept.index(text_col)))]
        lists = [pa.array([np.frombuffer(x[0], np.int32) for x in out], pa.list_(pa.int32())), *(pa.array([x[i] for x in out], pa.list_(pa.int32())) for i in (3, 4))]
        return pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*kept, *added])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in added)])
    return map_arrow(docs, schema, run)


def decode(ids: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns and the text of the ids; bytes that are no UTF-8 (a cut character) show as U+FFFD; null ids give null."""
    if into in ids.columns:
        raise ValueError(f"{into} is a column already")
    kept = ids.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(ranks_path, pattern)
        texts = [None if x is None else own.decode(x).decode("utf-8", "replace") for x in batch.column(kept.index(ids_col)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, into])

    return map_arrow(ids, T.StructType([*ids.schema.fields, T.StructField(into, T.StringType())]), run)
