"""N-gram Jaccard join over count vectors.

A document's set holds the hashes of its distinct shingles of `words` words. Documents with equal sets are one class. Two
classes link when the intersection is at least `percent` of the union; then their sets differ in at most
(a + b) * (100 - percent) / (100 + percent) elements. The defaults, 3 words and 90 %, are those of the query op4;
`percent` may be 80 or more, as a partner must lie in the same size class or the next one.

Points: the elements of a set are hashed into VECTOR groups, and the counts of the groups are its point. The overlap of two
sets is at most the sum of the coordinate minima of their points; that bound, per pair and per box of an R-tree, drops
most candidates. What passes meets the same bound with groups of about GROUP elements, as few groups tell long sets
apart badly, and the rest are verified on their exact sets.

Co-location: in a size class whose pairs differ in at most r elements, elements are hashed into r + 1 + SLACK finer
groups or some more. At least one of them is untouched by the difference, so linked sets share the digest of a whole group
(its count and the sum of its elements). Sets with no more groups in use than they may differ from a partner of their own
also emit their unused groups, which keeps the argument exact. Groups shared by two sets or more form runs. To find them,
the digests of a few megabytes of text travel sorted and packed, each once, and only those met elsewhere come back, so the
bulk of the digests, which no other set has, is shuffled once in a few bytes each and never becomes rows.

Runs are joined without listing pairs: each member is verified against LEADERS members of its run, which are then done, and
components are merged; first one leader for each member, then the pairs that are still in different components. Only runs whose other members still lie in different components go
through the R-tree, which looks at pairs across components; large runs are cut into blocks, and a task holds two blocks.
So a group of near copies costs a few verifications per member, and no link between different texts is lost.

Results for odd input: null or empty text, or text without words, has an empty set, links with nothing and is its own component;
with fewer words than a shingle the whole sequence is the one element; a null id is nobody's smallest id (a component of
null ids only has a null id); rows that repeat an id are documents that share the id; an empty table gives an empty
table; only the two named columns are read. Hashes have 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import bytes_text as B
from .common import bounded_broadcast, components, discard, map_arrow, raw_bytes, release, sliced, stored, text_key
from .substring_dedup import packed, unpacked

WORDS = 3           # of a shingle, unless the caller names another width
PERCENT = 90        # of the union, likewise
VECTOR = 32         # groups of a coarse point, for single pairs
GROUP = 8           # elements of a group, at most, in the last bound before the exact sets
FINE = 128          # groups of a fine point, for the R-tree
BROADCAST_ROWS = 300_000  # sets to fetch, up to which their ids are broadcast (16 bytes each)
GROWTH = 1.5        # size classes
BITS = 48           # of a digest; two digests that agree by chance only add a pair to verify
BUCKET = 1_000_000  # digests of a bucket, on average
SLACK = 2
LEADERS = 3         # members of a run that meet all others before the R-tree
BLOCK = 2_048       # points of a block
SLICE = 4_000_000  # bytes of text worked on at once
LEAF = 32           # points of an R-tree box
_SIGNED = np.uint64(1) << np.uint64(63)


def size_class(n: int) -> int:
    return int(math.log(n / 4) / math.log(GROWTH)) if n > 4 else 0


def lower_end(c: int) -> float:
    """Sizes of class c lie from here on; class 0 holds all smaller ones too."""
    return 4 * GROWTH ** c if c else 0


def share_apart(percent: int) -> float:
    """Largest symmetric difference of a linked pair, as a share of its smaller set."""
    return (1 + 100 / percent) * (100 - percent) / (100 + percent)


def most_apart(c: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of a linked pair whose smaller set is of class c."""
    end = 4 * GROWTH ** (c + 1) + 1
    return int(end * share_apart(percent)) + 1


def group_count(c: int, percent: int = PERCENT) -> int:
    """Groups of class c: SLACK more than a difference can touch, and twice as many more as its largest sets leave unused."""
    m = most_apart(c, percent) + 1 + SLACK
    return m + int(2 * m * math.exp(-1 / share_apart(percent)))


def group_digests(own: np.ndarray, c: int, percent: int = PERCENT) -> np.ndarray:
    """Digests of the groups of a sorted set, as a member of size class c."""
    apart = int(len(own) * share_apart(percent) + 1e-6)  # of this set and any partner, smaller or larger
    m = group_count(c, percent)
    group = (own >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)  # rises with the element, so groups are slices
    at = np.flatnonzero(np.diff(group, prepend=np.uint64(m)))
    used = group[at]
    sums = np.add.reduceat(B.mix(own ^ np.uint64(0x5851F42D4C957F2D)), at)
    size = np.diff(at, append=len(own)).astype(np.uint64)
    tag = np.uint64(c * 1_000_003 + 17)
    out = B.mix(sums + B.mix(used * np.uint64(0x9E3779B97F4A7C15) + tag) + size * np.uint64(0xC2B2AE3D27D4EB4F))
    if len(used) <= apart:
        unused = np.setdiff1d(np.arange(m, dtype=np.uint64), used)
        out = np.concatenate([out, B.mix(B.mix(unused * np.uint64(0x9E3779B97F4A7C15) + tag) ^ np.uint64(0x2545F4914F6CDD1D))])
    return out


def all_digests(own: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Those of its own size class, and of the class below when a smaller partner may lie there."""
    c = size_class(len(own))
    out = [group_digests(own, c, percent)]
    if c and len(own) * percent <= 100 * lower_end(c) + 100:
        out.append(group_digests(own, c - 1, percent))
    return np.concatenate(out)


def sets_of(column: pa.Array, width: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    data, ends = raw_bytes(column)
    hashes, starts = B.words(data, ends)
    runs = B.shingles(hashes, width)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= width:
            own = np.sort(runs[a:b - width + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            yield B.shingles(hashes[a:b], int(b - a)) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def list_of(parts: list[np.ndarray], kind: np.dtype) -> pa.Array:
    ends = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)))


def describe(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Rows of documents (id, k_text, n, sid, point, fine, counts): k_text tells texts of one id apart, sid names the set, the
    last three count its groups. Rows of slices (home, n, sids, digests): the sets of at most SLICE bytes of text, and the n
    digests of their groups, sorted, with the set of each; home numbers the slice."""
    names = ["id", "k_text", "n", "sid", "point", "fine", "counts", "home", "sids", "digests"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in sliced(batch, 2, SLICE):
                sizes, sids, points, fine, counts, digests = [], [], [], [], [], []
                for own in sets_of(part.column(2), words):
                    sizes.append(len(own))
                    sids.append(int(signed(B.mix(np.array([B.mix(own).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)))[0]) if len(own) else None)
                    points.append(np.bincount((own >> np.uint64(59)).astype(np.int64), minlength=VECTOR).astype(np.int32))
                    fine.append(np.bincount((own >> np.uint64(57)).astype(np.int64), minlength=FINE).astype("<i4").tobytes())
                    counts.append(group_counts(own).tobytes())
                    digests.append(all_digests(own, percent) >> np.uint64(64 - BITS) if len(own) else np.zeros(0, np.uint64))
                rows = len(sizes)
                kinds = [pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), list_of(points, np.int32), pa.array(fine, pa.binary()),
                     pa.array(counts, pa.binary()), *(pa.nulls(rows, k) for k in kinds)], names=names)
                # One row per slice; a set that the slice holds twice is there once.
                first = {sid: k for k, sid in reversed(list(enumerate(sids))) if sid is not None}
                held = list(first.items())
                many = np.array([len(digests[k]) for _, k in held], np.int64)
                values, owner = np.concatenate([np.zeros(0, np.uint64), *(digests[k] for _, k in held)]), np.repeat(np.arange(len(held), dtype=np.uint32), many)
                order = np.lexsort((owner, values))
                blob = packed(np.diff(values[order], prepend=np.uint64(0)), owner[order])
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, part.column(0).type), pa.nulls(1, pa.int64()), pa.array([len(values)], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())),
                     *[pa.nulls(1, pa.binary())] * 2, pa.array([home], pa.int64()), pa.array([packed(np.array([sid for sid, _ in held], np.int64))], pa.binary()), pa.array([blob], pa.binary())],
                    names=names)
                home += 1

    key = docs.schema[id_col].dataType.simpleString()
    id_key, hashed = text_key(id_col, text_col)
    return docs.select(id_key.alias("id"), hashed, text_col).mapInArrow(
        run, f"id {key}, k_text bigint, n bigint, sid bigint, point array<int>, fine binary, counts binary, home bigint, sids binary, digests binary")


def slice_digests(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(sorted digests, set of each) of a slice."""
    steps, owner = unpacked(blob, "<u8", "<u4")
    return np.cumsum(steps, dtype=np.uint64), owner


def met_elsewhere(slices: DataFrame, buckets: int) -> DataFrame:
    """(home, found): for each slice the digests that other slices hold too. A slice sends each digest once, packed, to the
    bucket of its range, so that a digest of very many sets is one entry per slice."""

    def ask(batch: pa.RecordBatch) -> pa.RecordBatch:
        to, homes, raws = [], [], []
        for home, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            values = np.unique(slice_digests(blob)[0])
            where = ((values >> np.uint64(BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            for bucket, own in ranges(where):
                to.append(bucket)
                homes.append(home)
                raws.append(packed(np.diff(values[own], prepend=np.uint64(0))))
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(homes, pa.int64()), pa.array(raws, pa.binary())], names=["bucket", "home", "raw"])

    def compare(group: pa.Table) -> pa.Table:
        homes = group.column("home").to_numpy()
        parts = [np.cumsum(unpacked(raw, "<u8")[0], dtype=np.uint64) for raw in group.column("raw").to_pylist()]
        values, owner = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        again = values[1:] == values[:-1]
        many = np.concatenate([again, [False]]) | np.concatenate([[False], again])
        values, owner = values[many], owner[many]
        by = np.argsort(owner, kind="stable")
        values = values[by]
        found = [(int(homes[k]), packed(values[s])) for k, s in ranges(owner[by])]
        return pa.table({"home": pa.array([h for h, _ in found], pa.int64()), "found": pa.array([f for _, f in found], pa.binary())})

    asked = map_arrow(slices.select("home", "digests"), "bucket bigint, home bigint, raw binary", ask)
    return asked.groupBy("bucket").applyInArrow(compare, "home bigint, found binary")


def shared_entries(slices: DataFrame, buckets: int) -> DataFrame:
    """(sid, digest) of digests that two slices or two sets of one slice hold. Equal sets of two slices are among them."""
    found = met_elsewhere(slices, buckets).groupBy(F.col("home").alias("to")).agg(F.collect_list("found").alias("found"))  # no more than the slice holds
    joined = slices.join(found, slices["home"] == found["to"], "left").select("sids", "digests", "found")

    def pick(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for sids, blob, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            values, owner = slice_digests(blob)
            again = values[1:] == values[:-1]
            many = np.concatenate([again, [False]]) | np.concatenate([[False], again]) if len(values) else np.zeros(0, bool)
            if found:
                known = np.sort(np.concatenate([unpacked(x, "<u8")[0] for x in found]))
                many |= known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
            names = unpacked(sids, "<i8")[0]
            yield pa.RecordBatch.from_arrays([pa.array(names[owner[many]]), pa.array(values[many].astype(np.int64))], names=["sid", "digest"])

    return map_arrow(joined, "sid bigint, digest bigint", pick)


def ranges(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal keys in a sorted array."""
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    for a, b in zip(at, [*at[1:], len(keys)][:len(at)], strict=True):
        yield int(keys[a]), slice(int(a), int(b))


def group_counts(own: np.ndarray) -> np.ndarray:
    """How many elements lie in each of 2^k equal ranges of hashes, GROUP on average at most."""
    bits = max(0, math.ceil(math.log2(max(1, len(own)) / GROUP)))
    return np.bincount((own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64), minlength=1 << bits).astype("<i4")


def most_common(x: np.ndarray, y: np.ndarray) -> int:
    """Bound of the overlap of two sets from their group counts; the longer list is summed down to the shorter."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.minimum(x, y.reshape(len(x), -1).sum(1)).sum())


def set_table(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(sid, elements): the exact sets of the wanted (sid, rep), worked out again from the text of one document each."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(bounded_broadcast(wanted, wanted.count(), BROADCAST_ROWS), texts["id"].eqNullSafe(wanted["rep"])).select("sid", "text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in sliced(batch, 1, SLICE):
            names, sets = [], []
            for sid, own in zip(part.column(0).to_pylist(), sets_of(part.column(1), words), strict=True):
                name = int(signed(B.mix(np.array([B.mix(own).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)))[0])
                if name == sid:  # another document may share the id
                    names.append(sid)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["sid", "elements"])

    return map_arrow(joined, "sid bigint, elements binary", run)


def verified(pairs: DataFrame, points: DataFrame, exact: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs (a, b) that link: first by the bounds of the points and of the finer counts, then on the exact sets, which are
    worked out only for what is left."""
    one = points.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("p_a"))
    two = points.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("p_b"))
    need = F.expr(f"aggregate(zip_with(p_a, p_b, (x, y) -> least(x, y)), 0L, (s, x) -> s + x) * {100 + percent} >= {percent} * (n_a + n_b)")
    near = cut_lineage(pairs.join(one, "a").join(two, "b").where(need).select("a", "b"))

    def both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
        return pairs.join(sets.select(F.col("sid").alias("a"), F.col(column).alias("s_a")), "a").join(
            sets.select(F.col("sid").alias("b"), F.col(column).alias("s_b")), "b").select("a", "b", "s_a", "s_b")

    def bounded(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), "<i4") for v in (left, right))
            keep.append((100 + percent) * most_common(x, y) >= percent * int(x.sum() + y.sum()))
        return batch.select([0, 1]).filter(pa.array(keep))

    left = cut_lineage(map_arrow(both(near, points, "counts"), "a bigint, b bigint", bounded))
    ends = left.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    sets = stored(exact(points.join(ends, "sid", "left_semi").select("sid", "rep")), "sets")
    release(points.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        return batch.select([0, 1]).filter(pa.array(keep))

    found = cut_lineage(map_arrow(both(left, sets, "elements"), "a bigint, b bigint", run))
    discard(sets)
    return found


class CountTree:
    """An R-tree over points: leaves of LEAF points in the order of a recursive sort, boxes of LEAF boxes above them.
    Only the upper corners are kept, as the bound needs no more."""

    def __init__(self, points: np.ndarray, percent: int = PERCENT):
        self.percent = percent
        self.order = self.packed(points, np.arange(len(points)))
        self.levels = [points[self.order]]
        while len(self.levels[-1]) > 1 and len(self.levels) < 12:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), LEAF), axis=0))

    @staticmethod
    def packed(points: np.ndarray, rows: np.ndarray, axis: int = 0) -> np.ndarray:
        """Sort-tile order: cut along one axis after the other into slabs until a leaf is full."""
        if len(rows) <= LEAF:
            return rows
        rows = rows[np.argsort(points[rows, axis % points.shape[1]], kind="stable")]
        slab = max(LEAF, -(-len(rows) // (4 * LEAF)) * LEAF)
        return np.concatenate([CountTree.packed(points, rows[i:i + slab], axis + 1) for i in range(0, len(rows), slab)])

    def search(self, point: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
        """Rows whose overlap bound with the point suffices. A box is entered when the bound of its upper corner does;
        sizes of rows are at least `percent` of the other's."""
        percent = self.percent
        least = percent * (size + percent * size / 100)
        boxes = np.arange(len(self.levels[-1]))
        for level in range(len(self.levels) - 1, 0, -1):
            bound = np.minimum(self.levels[level][boxes], point).sum(1, dtype=np.int64)
            boxes = boxes[(100 + percent) * bound >= least]
            below = (boxes[:, None] * LEAF + np.arange(LEAF)).ravel()
            boxes = below[below < len(self.levels[level - 1])]
        bound = np.minimum(self.levels[0][boxes], point).sum(1, dtype=np.int64)
        rows = self.order[boxes]
        return rows[(100 + percent) * bound >= percent * (size + sizes[rows])]


def tree_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of each run's members (digest, sid, component, n, fine) in different components that the bound allows."""
    sizes = members.groupBy("digest").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = cut_lineage(sizes)
    split = members.join(sizes, "digest").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    split = split.select("*", other.alias("other")).select(
        "digest", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "sid", "component", "n", "fine")

    def run(group: pa.Table) -> pa.Table:
        sid, part, block, n = (group.column(c).to_numpy() for c in ("sid", "component", "block", "n"))
        points = np.frombuffer(b"".join(group.column("fine").to_pylist()), "<i4").reshape(-1, FINE)
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        inside = np.flatnonzero(block == low)
        tree, local = CountTree(points[inside], percent), n[inside]
        left, right = [], []
        for row in (inside if low == high else np.flatnonzero(block == high)):
            found = inside[tree.search(points[row], int(n[row]), local)]
            found = found[(part[found] != part[row]) & ((sid[found] < sid[row]) if low == high else True)]
            left.append(sid[found])
            right.append(np.full(len(found), sid[row]))
        a, b = np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return split.groupBy("digest", "low", "high").applyInArrow(run, "a bigint, b bigint").distinct()


def links(docs: DataFrame, described: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(node, component) of the sets that link with another set, from the stored description of the documents."""
    spark = docs.sparkSession
    slices = described.where("home IS NOT NULL")
    total = slices.agg(F.sum("n")).first()[0] or 0
    entries = stored(shared_entries(slices.select("home", "sids", "digests"), max(1, -(-total // BUCKET))).distinct(), "entries")
    release(spark)
    shared = entries.groupBy("digest").agg(F.min("sid").alias("least"), F.max("sid").alias("most")).where("least < most").select("digest")
    members = stored(entries.join(shared, "digest"), "members")
    discard(entries)
    wanted = cut_lineage(members.select("sid").distinct())
    points = described.where("home IS NULL AND n > 0").groupBy("sid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in ("point", "fine", "counts")))
    points = stored(points.join(wanted, "sid", "left_semi"), "points")
    release(spark)

    label = wanted.select("sid", F.col("sid").alias("component"))

    def merge(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """Verify the pairs; links between components merge them."""
        found = verified(pairs.distinct(), points, lambda wanted: set_table(docs, wanted, id_col, text_col, words), percent)
        release(spark)
        if found.isEmpty():
            return label
        one, two = (label.select(F.col("sid").alias(x), F.col("component").alias(f"c_{x}")) for x in ("a", "b"))
        into = components(found.join(one, "a").join(two, "b"), "c_a", "c_b").select(F.col("node").alias("component"), F.col("component").alias("into"))
        return cut_lineage(label.join(into, "component", "left").select("sid", F.coalesce("into", "component").alias("component")))

    # Leaders of each run meet all its members, and are done.
    led = members.groupBy("digest").agg(F.array_distinct(F.array(*(F.min_by("sid", F.xxhash64("sid", F.lit(k))) for k in range(LEADERS)))).alias("leaders"))
    led = cut_lineage(members.join(led, "digest"))
    release(spark)
    met = led.select("sid", F.explode("leaders").alias("leader")).where("sid <> leader")
    one = met.groupBy("sid").agg(F.min_by("leader", F.xxhash64("leader")).alias("leader"))
    label = merge(one.select(F.least("sid", "leader").alias("a"), F.greatest("sid", "leader").alias("b")), label)
    met = met.select(F.least("sid", "leader").alias("a"), F.greatest("sid", "leader").alias("b")).distinct()
    ends = (label.select(F.col("sid").alias(x), F.col("component").alias(f"c_{x}")) for x in ("a", "b"))
    label = merge(met.join(next(ends), "a").join(next(ends), "b").where("c_a <> c_b").select("a", "b"), label)
    # Other members that are still in different components.
    left = led.where(~F.array_contains("leaders", F.col("sid"))).select("digest", "sid").join(label, "sid")
    mixed = left.groupBy("digest").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("digest")
    left = cut_lineage(left.join(mixed, "digest", "left_semi"))
    if not left.isEmpty():
        label = merge(tree_pairs(left.join(points.select("sid", "n", "fine"), "sid"), percent), label)
    discard(members, points)
    return label.withColumnRenamed("sid", "node")


def components_of(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, k_text, n, component_id), one row per document."""
    if percent * GROWTH < 100:
        raise ValueError(f"partners at {percent} % may lie two size classes apart")
    described = stored(describe(docs, id_col, text_col, words, percent), "described")
    label = links(docs, described, id_col, text_col, words, percent)
    narrow = described.where("home IS NULL").select("id", "k_text", "n", "sid")
    marked = narrow.join(label, narrow["sid"] == label["node"], "left").select("id", "k_text", "n", F.coalesce("component", "sid").alias("component"))
    marked = cut_lineage(marked)
    discard(described)
    release(docs.sparkSession)
    least = marked.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("many")).where("many > 1").drop("many")
    least = cut_lineage(least.withColumnRenamed("component", "c"))
    return marked.join(least, marked["component"] == least["c"], "left").select("id", "k_text", "n", F.coalesce("least", "id").alias("component_id"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    return components_of(docs, id_col, text_col, words, percent).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents with the smallest id of their component, with all their columns. Documents without words stay, and so
    do those without an id; rows that share id and text stay or go together."""
    gone = components_of(docs, id_col, text_col, words, percent).where("component_id < id").select(F.col("id").alias("gone_id"), F.col("k_text").alias("gone_text")).distinct()
    id_key, hashed = text_key(id_col, text_col)
    return docs.join(gone, (id_key == gone["gone_id"]) & (hashed == gone["gone_text"]), "left_anti")
