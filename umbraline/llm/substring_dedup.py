"""Removal of long byte strings that also start in a document with a smaller id.

Suffixes are sorted bucket by bucket, with a difference cover for long ties.

0. Texts are dealt to document buckets by their digest, compressed. Equal texts of one batch go once; equal texts of a bucket are
   seen there. A whole copy of a text with a smaller id loses all its bytes and takes no further part.
1. Which 50-byte windows can repeat at all? Each window is known by its minimizer, the smallest hash of its GRAM-byte strings;
   equal windows have equal minimizers. A document bucket sends its distinct minimizers to hash buckets, and those
   that two buckets have sent, or that two texts of a bucket hold, come back. All other windows drop out here.
2. Stretches of neighbouring windows with one minimizer go, as at most 80 bytes of context, to the suffix bucket of that
   minimizer. Equal contexts are kept once, for the smallest id; the larger ids lose those windows at once.
3. A bucket's suffixes are sorted on their own, one bucket after the other. First the suffixes at cover positions (byte offset
   in the document modulo COVER_SIZE in COVER) are sorted and ranked. Then all suffixes are sorted by their first COVER_SIZE bytes, and longer
   ties are split around a pivot: of any two suffixes some shift below COVER_SIZE puts both on cover positions,
   whose ranks decide. No string is compared beyond its context, so memory is bounded by the bucket.
4. Neighbours in the sorted order that share 50 bytes form groups; the smallest id of a group keeps the string, and the others'
   bytes are removed. Removed windows go back to their documents.

Results for odd input: null text is empty; texts under 50 bytes and empty ones lose nothing; texts of any length are taken whole; a null
id counts as larger than all ids; rows with equal ids never remove each other's bytes, and equal rows get equal
results; an empty table gives an empty table; only the two named columns are read. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_text as B
from .common import raw_bytes, release, sliced, stored, text_key

WIDTH = 50                      # bytes of a string that must not repeat
GRAM = 20                       # bytes of a minimizer
REACH = WIDTH - GRAM + 1        # grams of a window
STRIDE = 96                     # bytes of a context row, with padding
COVER_SIZE, COVER = 13, (0, 1, 3, 9)   # every difference modulo 13 is one of two members
LATE = 2**63 - 1                # stands for a null id
SLICE = 1_000_000               # bytes hashed at once
BUCKET_BYTES = 4_000_000        # bytes of text per bucket on average

#: shift[a, b]: the least d with (a + d) and (b + d) modulo COVER_SIZE in COVER.
SHIFT = np.array([[next(d for d in range(COVER_SIZE) if (a + d) % COVER_SIZE in COVER and (b + d) % COVER_SIZE in COVER)
                   for b in range(COVER_SIZE)] for a in range(COVER_SIZE)])


def minimizers(data: np.ndarray) -> np.ndarray:
    """For every window start the smallest gram hash inside the window; windows may cross rows here."""
    n = len(data) - GRAM + 1
    if n < REACH:
        return np.zeros(0, np.uint64)
    grams = np.empty(n, np.uint64)
    for at in range(0, n, B.PIECE):
        part = data[at:min(at + B.PIECE, n) + GRAM - 1]
        up, down = B.powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(B._TABLE[part] * up[:len(part)], out=total[1:])
        grams[at:at + len(part) - GRAM + 1] = B.mix((total[GRAM:] - total[:-GRAM]) * down[:len(part) - GRAM + 1])
    span, least = 1, grams
    while span * 2 <= REACH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = REACH - span
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, minimizer) of the runs of windows with one minimizer, at most REACH windows long.
    Minimizers are small numbers, so they are mixed again before they deal out buckets, and cut to 48 bits: they only
    narrow the search, and a chance equality costs work and no result."""
    least = minimizers(data)
    room = np.maximum(np.diff(ends) - WIDTH + 1, 0)  # windows of each row
    row = np.repeat(np.arange(len(room)), room)
    start = np.arange(room.sum()) + np.repeat(ends[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room)
    own = least[start]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    size = np.diff(at, append=len(own))
    parts = -(-size // REACH)  # periodic text: one minimizer over a long stretch
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(at, parts) + step * REACH
    count = np.minimum(REACH, np.repeat(at + size, parts) - first)
    return row[first], start[first], count, B.mix(own[first] + np.uint64(1)) >> np.uint64(16)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the 48-bit key, so the buckets of sorted keys are slices."""
    return ((keys >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte plane by byte plane: high bytes of sorted or small numbers nearly vanish."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(raw: bytes, *kinds: str) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(data) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(data[at:at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LATE).to_numpy(zero_copy_only=False)


Blob = tuple[int, int, bytes, bytes]
BLOBS = ["bucket", "next", "a", "b"]
BLOB_SCHEMA = "bucket bigint, next bigint, a binary, b binary"


def blobs(rows: list[Blob]) -> pa.RecordBatch:
    """bucket: where a row is worked on. next: for finished rows, the document bucket that they are for; else -1. Finished rows
    travel along with the others, so that one pass has both."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=BLOBS)


def slices(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal keys in a sorted array."""
    at = starts_of(keys)
    for a, b in zip(at, [*at[1:], len(keys)][:len(at)], strict=True):
        yield int(keys[a]), slice(int(a), int(b))


def row_hash(raw: memoryview | bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


def deal(docs: DataFrame, buckets: int) -> DataFrame:
    """Open rows by document bucket (ids, text keys, lengths; compressed texts), and finished ones (ids, text keys, lengths of
    whole copies). Texts too short to lose anything are spread by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in sliced(batch, 2, 8 * SLICE):
                data, ends = raw_bytes(part.column(2))
                ids, keys, size = ids_of(part.column(0)), part.column(1).to_numpy(), np.diff(ends)
                view = memoryview(data)
                digest = np.array([row_hash(view[a:b]) if b - a >= WIDTH else 0 for a, b in zip(ends[:-1], ends[1:], strict=True)], np.uint64)
                first: dict[bytes, int] = {}
                order = np.argsort(ids, kind="stable")
                copy = np.zeros(len(ids), bool)
                again = np.isin(digest, np.unique(digest[order])[np.unique(digest, return_counts=True)[1] > 1]) & (size >= WIDTH)
                for n in order[again[order]]:
                    text = view[ends[n]:ends[n + 1]].tobytes()
                    copy[n] = ids[n] > first.setdefault(text, int(ids[n]))
                where = bucket_of(np.where(size >= WIDTH, B.mix(digest), B.mix(ids.view(np.uint64))) >> np.uint64(16), buckets)
                rows = []
                by = np.argsort(where, kind="stable")
                for k, s in slices(where[by]):
                    own = by[s]
                    kept, gone = own[~copy[own]], own[copy[own]]
                    if len(kept):
                        text = press.compress(b"".join(view[ends[n]:ends[n + 1]] for n in kept))
                        rows.append((k, -1, packed(ids[kept], keys[kept], size[kept]), text))
                    if len(gone):  # by id, so that the copies of one text are spread
                        rows.append((int(bucket_of(B.mix(ids[gone[:1]].view(np.uint64)) >> np.uint64(16), buckets)[0]), 0, packed(ids[gone], keys[gone], size[gone]), b""))
                yield blobs(rows)

    return docs.select("id", "k_text", "text").mapInArrow(run, BLOB_SCHEMA)


class Texts:
    """The texts of a document bucket by id and key: equal rows once, whole copies of a smaller id marked."""

    def __init__(self, group: pa.Table):
        opened = [(a, b) for to, a, b in zip(*(group.column(c).to_pylist() for c in BLOBS[1:]), strict=True) if to < 0]
        self.copies = [unpacked(a, "<i8", "<i8", "<i8") for to, a in zip(group.column("next").to_pylist(), group.column("a").to_pylist(), strict=True) if to >= 0]
        press = zstandard.ZstdDecompressor()
        heads = [unpacked(a, "<i8", "<i8", "<i8") for a, _ in opened]
        ids, keys, size = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*heads, strict=True) if heads else ((), (), ())))
        texts = []
        for (_, b), (_, _, own) in zip(opened, heads, strict=True):
            raw, ends = press.decompress(b), np.concatenate([[0], np.cumsum(own)])
            texts += [raw[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
        order = np.lexsort((keys, ids))
        self.ids, self.keys, self.texts = ids[order], keys[order], [texts[n] for n in order]
        # Equal rows have one result and are worked on once; how often each is there is kept.
        lowest: dict[bytes, int] = {}
        self.whole = np.array([len(t) >= WIDTH and lowest.setdefault(t, int(i)) < i for i, t in zip(self.ids, self.texts, strict=True)], bool)
        same = np.zeros(len(self.ids), bool)
        for n in range(1, len(same)):
            same[n] = self.ids[n] == self.ids[n - 1] and self.keys[n] == self.keys[n - 1] and self.texts[n] == self.texts[n - 1]
        self.repeats = np.cumsum(~same) - 1  # row -> its first equal row, counted among the first ones
        self.first = np.flatnonzero(~same)
        self.open = np.flatnonzero(~same & ~self.whole & np.array([len(t) >= WIDTH for t in self.texts], bool))

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers, bytes without gaps, offsets) of the open texts, at most SLICE bytes or one text at a time. The numbers
        count the open texts by id and key, so they are the same whenever and however the bucket is gathered."""
        at = 0
        while at < len(self.open):
            stop, total = at, 0
            while stop < len(self.open) and (stop == at or total + len(self.texts[self.open[stop]]) <= SLICE):
                total += len(self.texts[self.open[stop]])
                stop += 1
            rows = self.open[at:stop]
            yield np.arange(at, stop), np.frombuffer(b"".join(self.texts[n] for n in rows), np.uint8), np.concatenate([[0], np.cumsum([len(self.texts[n]) for n in rows])])
            at = stop


def gather_minimizers(dealt: DataFrame, buckets: int) -> DataFrame:
    """Open rows by hash bucket (minimizers; next is -1 - document bucket), and finished ones with the minimizers that two
    texts of the bucket hold."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        home, texts = key[0].as_py(), Texts(group)
        found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for rows, data, ends in texts.parts():
            row, _, _, least = stretches(data, ends)
            found.append(least)
            owner.append(rows[row])
        keys, owner = np.concatenate(found), np.concatenate(owner)
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        at = starts_of(keys)
        last = np.concatenate([at[1:], [len(keys)]]) - 1 if len(keys) else at
        many = keys[at[owner[at] != owner[last]]]
        out = [(home, home, packed(many), b"")] if len(many) else []
        keys = keys[at]
        out += [(k, -1 - home, packed(keys[s]), b"") for k, s in slices(bucket_of(keys, buckets))]
        return pa.Table.from_batches([blobs(out)])

    return dealt.groupBy("bucket").applyInArrow(run, BLOB_SCHEMA)


def repeated_minimizers(asked: DataFrame) -> DataFrame:
    """By document bucket the minimizers that another bucket or another text holds as well."""

    def run(group: pa.Table) -> pa.Table:
        out, keys, home = [], [], []
        for to, a in zip(group.column("next").to_pylist(), group.column("a").to_pylist(), strict=True):
            if to >= 0:
                out.append((to, to, a, b""))
            else:
                keys.append(unpacked(a, "<u8")[0])
                home.append(np.full(len(keys[-1]), -1 - to, np.int32))
        if keys:
            keys, home = np.concatenate(keys), np.concatenate(home)
            order = np.argsort(keys, kind="stable")
            keys, home = keys[order], home[order]
            at = starts_of(keys)
            size = np.diff(at, append=len(keys))
            many = np.repeat(size > 1, size)
            keys, home = keys[many], home[many]
            by = np.argsort(home, kind="stable")
            out += [(k, k, packed(keys[by][s]), b"") for k, s in slices(home[by])]
        return pa.Table.from_batches([blobs(out)])

    return asked.groupBy("bucket").applyInArrow(run, BLOB_SCHEMA)


def packed_contexts(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rows of STRIDE bytes: the contexts, padded with zeros."""
    size = count + WIDTH - 1
    at = np.minimum(start[:, None] + np.arange(STRIDE), len(data) - 1)
    out = data[at]
    out[np.arange(STRIDE) >= size[:, None]] = 0
    return out


#: Columns of a context: document id, document bucket, row in it, first byte, windows, removed windows as bits.
HEADER = {"id": "<i8", "home": "<i4", "row": "<i4", "at": "<i8", "count": "<i4", "mask": "<u4"}
Head = dict[str, np.ndarray]


def chosen(head: Head, rows: np.ndarray | slice) -> Head:
    return {k: v[rows] for k, v in head.items()}


def packed_head(head: Head) -> bytes:
    return packed(*(head[k].astype(kind) for k, kind in HEADER.items()))


def joined_heads(raws: list[bytes]) -> Head:
    parts = zip(*(unpacked(r, *HEADER.values()) for r in raws), strict=True)
    return {k: np.concatenate(p) for k, p in zip(HEADER, parts, strict=True)}


def distinct_contexts(text: np.ndarray, head: Head) -> tuple[np.ndarray, Head, Head]:
    """(texts, heads) of each different context with its smallest id, and the heads of larger ids, which lose all windows."""
    total = np.zeros(len(text), np.uint64)
    words = text.view(np.uint64)
    for j in range(words.shape[1]):
        total = B.mix(total + words[:, j] * B._TURNS[j])
    total = total + head["count"].astype(np.uint64)
    order = np.lexsort((head["id"], total))
    text, head, total = text[order], chosen(head, order), total[order]
    same = np.zeros(len(order), bool)
    same[1:] = (total[1:] == total[:-1]) & (head["count"][1:] == head["count"][:-1]) & (text[1:] == text[:-1]).all(1)
    beaten = head["id"] > head["id"][np.flatnonzero(~same)][np.cumsum(~same) - 1]
    lost = chosen(head, beaten)
    lost["mask"] = ((np.uint64(1) << lost["count"].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    return text[~beaten], chosen(head, ~beaten), lost


def cut_rows(head: Head) -> list[Blob]:
    """Finished rows: contexts with removed windows, by document bucket."""
    by = np.argsort(head["home"], kind="stable")
    head = chosen(head, by)
    return [(k, k, packed_head(chosen(head, s)), b"") for k, s in slices(head["home"])]


def make_contexts(dealt: DataFrame, seen: DataFrame, buckets: int) -> DataFrame:
    """Open rows by suffix bucket (heads, context bytes), and finished ones."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[Blob] = []
        if left.num_rows and right.num_rows:
            home, texts, press = key[0].as_py(), Texts(left), zstandard.ZstdCompressor(level=3)
            known = np.unique(np.concatenate([unpacked(x.as_py(), "<u8")[0] for x in right.column("a")]))
            held: dict[int, list[tuple[Head, bytes]]] = {}
            for rows, data, ends in texts.parts():
                row, start, count, least = stretches(data, ends)
                pick = np.flatnonzero(known[np.minimum(np.searchsorted(known, least), len(known) - 1)] == least)
                if not len(pick):
                    continue
                row, start, count, least = row[pick], start[pick], count[pick], least[pick]
                text = packed_contexts(data, start, count)
                head = {"id": texts.ids[texts.open[rows[row]]], "home": np.full(len(row), home, np.int32), "row": rows[row].astype(np.int32), "at": start - ends[row],
                        "count": count, "mask": np.arange(len(row)).astype(np.uint32)}
                text, head, lost = distinct_contexts(text, head)
                if len(lost["id"]):
                    out += cut_rows(lost)
                where = bucket_of(least[head["mask"]], buckets)
                by = np.argsort(where, kind="stable")
                text, head = text[by], chosen(head, by)
                head["mask"][:] = 0
                size = head["count"] + WIDTH - 1
                for k, s in slices(where[by]):
                    held.setdefault(k, []).append((chosen(head, s), text[s][np.arange(STRIDE) < size[s][:, None]].tobytes()))
            for k, parts in held.items():
                head = {c: np.concatenate([h[c] for h, _ in parts]) for c in HEADER}
                out.append((k, -1, packed_head(head), press.compress(b"".join(t for _, t in parts))))
        return pa.Table.from_batches([blobs(out)])

    return dealt.groupBy("bucket").cogroup(seen.groupBy("bucket")).applyInArrow(run, BLOB_SCHEMA)


def load(flat: np.ndarray) -> np.ndarray:
    """Eight bytes from every position as one big-endian number; a view."""
    return np.ndarray((len(flat) - 7,), ">u8", flat.data, strides=(1,))


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def dense_ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks by the keys, first key first; equal keys share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def sort_bucket(text: np.ndarray, head: Head) -> np.ndarray:
    """The mask of removed windows of every context of one suffix bucket. text: rows of STRIDE bytes."""
    n, count = len(head["id"]), head["count"].astype(np.int64)
    flat = np.concatenate([text.ravel(), np.zeros(64, np.uint8)])
    eight = load(flat)
    phase = (head["at"] % COVER_SIZE).astype(np.int32)
    # Ranks of the suffixes at cover positions, 56 bytes deep: beyond the 50 that any comparison needs.
    offset = np.arange(REACH + COVER_SIZE)
    on_cover = np.isin((phase[:, None] + offset) % COVER_SIZE, COVER) & (offset < (count + COVER_SIZE)[:, None])
    row, off = np.nonzero(on_cover)
    at = row * STRIDE + off
    ranks = np.full(n * STRIDE, -1, np.int32)
    ranks[at] = dense_ranks([eight[at + j].astype(np.uint64) for j in range(0, 56, 8)])
    # All suffixes by their first COVER_SIZE bytes.
    row = np.repeat(np.arange(n), count)
    off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = row * STRIDE + off
    label = dense_ranks([eight[at].astype(np.uint64), eight[at + 8].astype(np.uint64) >> np.uint64(8 * (16 - COVER_SIZE))])
    mod = (phase[row] + off) % COVER_SIZE
    # Long ties: three-way splits around a pivot of each group, all groups at once; cover ranks compare.
    order = np.argsort(label, kind="stable")
    label = label[order]
    size = np.diff(starts_of(label), append=len(label))
    active = np.flatnonzero(np.repeat(size > 1, size))
    label = label[active]
    while len(active):
        first = starts_of(label)
        size = np.diff(first, append=len(label))
        own, middle = order[active], order[active[np.repeat(first + size // 2, size)]]
        shift = SHIFT[mod[middle], mod[own]]
        side = np.sign(ranks[at[own] + shift] - ranks[at[middle] + shift])
        split = label * 3 + side
        again = np.argsort(split, kind="stable")
        order[active] = own[again]
        split, side = split[again], side[again]
        size = np.diff(starts_of(split), append=len(split))
        still = (side != 0) & np.repeat(size > 1, size)
        active, split = active[still], split[still]
        label = np.cumsum(np.concatenate([[0], (split[1:] != split[:-1]).astype(np.int64)]))[:len(split)]
    # Neighbours that share WIDTH bytes.
    place = at[order]
    equal = np.ones(max(len(place) - 1, 0), bool)
    for j in range(0, WIDTH, 8):
        word = eight[place + j].astype(np.uint64)
        if WIDTH - j < 8:
            word >>= np.uint64(8 * (8 - (WIDTH - j)))
        equal &= word[1:] == word[:-1]
    start = np.flatnonzero(np.concatenate([[True], ~equal]))
    ids = head["id"][row[order]]
    lowest = np.repeat(np.minimum.reduceat(ids, start), np.diff(start, append=len(ids)))
    lost = order[ids > lowest]
    mask = np.zeros(n, np.uint32)
    np.bitwise_or.at(mask, row[lost], np.uint32(1) << off[lost].astype(np.uint32))
    return mask


def sorted_buckets(contexts: DataFrame) -> DataFrame:
    """By document bucket the heads with removed windows; one suffix bucket is sorted after the other."""

    def run(group: pa.Table) -> pa.Table:
        out, heads, texts = [], [], []
        press = zstandard.ZstdDecompressor()
        for to, a, b in zip(*(group.column(c).to_pylist() for c in BLOBS[1:]), strict=True):
            if to >= 0:
                out.append((to, to, a, b))
            else:
                heads.append(a)
                texts.append(np.frombuffer(press.decompress(b), np.uint8))
        if heads:
            head = joined_heads(heads)
            text = np.zeros((len(head["id"]), STRIDE), np.uint8)
            text[np.arange(STRIDE) < (head["count"] + WIDTH - 1)[:, None]] = np.concatenate(texts)
            text, head, lost = distinct_contexts(text, head)
            head["mask"] = sort_bucket(text, head)
            out += cut_rows(lost) + cut_rows(chosen(head, head["mask"] > 0))
        return pa.Table.from_batches([blobs(out)])

    return contexts.groupBy("bucket").applyInArrow(run, BLOB_SCHEMA)


def kept_bytes(text: bytes, windows: np.ndarray) -> tuple[bytes, int, int]:
    """(bytes that stay, bytes removed, maximal runs removed)."""
    if not len(windows):
        return text, 0, 0
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, windows, 1)
    np.add.at(edge, windows + WIDTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return kept, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())


def cut(dealt: DataFrame, cuts: DataFrame, with_text: bool) -> DataFrame:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = Texts(left)
        lost: dict[int, slice] = {}
        if right.num_rows:
            head = joined_heads([x.as_py() for x in right.column("a")])
            head = chosen(head, np.argsort(head["row"], kind="stable"))
            lost = {int(texts.open[k]): s for k, s in slices(head["row"])}

        def windows(n: int) -> np.ndarray:
            own = lost.get(int(texts.first[texts.repeats[n]]))
            if own is None:
                return np.zeros(0, np.int64)
            row, bit = np.nonzero((head["mask"][own, None] >> np.arange(REACH, dtype=np.uint32)) & 1)
            return head["at"][own][row] + bit

        rows = []
        for n, text in enumerate(texts.texts):
            if texts.whole[n]:
                rows.append((len(text), len(text), 1, nothing, b""))
            else:
                kept, removed, spans = kept_bytes(text, windows(n))
                rows.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else b""))
        ids = [texts.ids]
        for gone, _, size in texts.copies:
            ids.append(gone)
            rows += [(int(x), int(x), 1, nothing, b"") for x in size]
        every = np.concatenate(ids)
        columns = [pa.array(every, pa.int64(), mask=every == LATE), *(pa.array([r[i] for r in rows], kinds[1 + i]) for i in range(4 + with_text))]
        return pa.table(columns, names=names)

    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return dealt.groupBy("bucket").cogroup(cuts.groupBy("bucket")).applyInArrow(run, schema)


def find_cuts(own: DataFrame, buckets: int) -> DataFrame:
    dealt = deal(own, buckets)
    seen = repeated_minimizers(gather_minimizers(dealt, buckets))
    return stored(sorted_buckets(make_contexts(dealt, seen, buckets)), "cuts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for."""
    id_key, hashed = text_key(id_col, text_col)
    own = docs.select(id_key.cast("bigint").alias("id"), hashed, F.col(text_col).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, math.ceil(total / BUCKET_BYTES))
    cuts = find_cuts(own, buckets)
    release(docs.sparkSession)
    return cut(deal(own, buckets), cuts, with_text).withColumnRenamed("id", id_col)
