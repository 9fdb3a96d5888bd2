"""Filter interaction audit: what each filter removes at every place of every order, per part of the corpus.

Each document gets a mask of the filters it fails. Masks are counted per part, and the counts of a part (32 masks at most)
become a count-weighted decision diagram: a level tests one filter, edges say pass or fail, ends hold the documents of a
mask, and equal sub-diagrams are shared. All orders of the filters are reached one after the other by swapping two adjacent
levels in place. In each order the all-pass path from the root yields the steps: the weight of the fail edge is removed
there, that of the pass edge is kept.

Filters: A few words, B few different words, C many capitals, D a symbol, E the text of a smaller id again. The last is
found over the whole table: the least id of a text's digest does not fail, all its others do. Texts that a third of all rows
share are counted before they are shuffled and are joined on digest and id together, so no key is hot.

Results for odd input: null text is an empty text; a null part is the part ''; a row without an id has no smaller id and is
none, so it never fails E; rows that share id and text pass or fail E together, and each counts; several labels of one id
count as good (toxic) where one of them is; a document without label is neither; an empty table has no parts and no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, map_arrow, stored

FILTERS = "ABCDE"
MIN_WORDS = 50            # A: fewer words
DISTINCT_PERCENT = 65     # B: a smaller share of different words
UPPER_PERCENT = 5         # C: a larger share of A-Z among the code points
SYMBOLS = "[#$%&*|]"      # D: any of these

Weight = tuple[int, int, int]  # documents, good ones, toxic ones


class FailureDiagram:
    """A decision diagram of failure masks. Nodes keep their number when levels are swapped, so what points to them stays."""

    def __init__(self, counts: dict[int, Weight], n_vars: int):
        self.order = list(range(n_vars))
        self.var: list[int] = []
        self.ends: list[tuple[int | None, int | None]] = []   # (pass, fail) child
        self.weight: list[Weight] = []
        self.unique: dict[tuple, int] = {}
        self.root = self._build(counts, 0)

    def _build(self, counts: dict[int, Weight], level: int) -> int | None:
        if not counts:
            return None
        if level == len(self.order):
            return self._end(next(iter(counts.values())))
        bit = 1 << self.order[level]
        return self._node(self.order[level], self._build({m: w for m, w in counts.items() if not m & bit}, level + 1),
                          self._build({m: w for m, w in counts.items() if m & bit}, level + 1))

    def _end(self, weight: Weight) -> int:
        key = (-1, weight)
        if key not in self.unique:
            self.unique[key] = self._add(-1, (None, None), weight)
        return self.unique[key]

    def _add(self, var: int, ends: tuple[int | None, int | None], weight: Weight) -> int:
        self.var.append(var)
        self.ends.append(ends)
        self.weight.append(weight)
        return len(self.var) - 1

    def _node(self, var: int, low: int | None, high: int | None) -> int | None:
        if low is None and high is None:
            return None
        key = (var, low, high)
        if key not in self.unique:
            a, b = self.of(low), self.of(high)
            self.unique[key] = self._add(var, (low, high), (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
        return self.unique[key]

    def of(self, node: int | None) -> Weight:
        return (0, 0, 0) if node is None else self.weight[node]

    def _reached(self) -> list[int]:
        seen, todo = [], [self.root]
        known = {None}
        while todo:
            node = todo.pop()
            if node not in known:
                known.add(node)
                seen.append(node)
                todo += self.ends[node]
        return seen

    def swap(self, level: int) -> None:
        """Exchange the variables of two adjacent levels. Nodes of the upper level are written anew in place."""
        upper, lower = self.order[level], self.order[level + 1]
        self.order[level], self.order[level + 1] = lower, upper
        live = self._reached()
        self.unique = {((-1, self.weight[n]) if self.var[n] < 0 else (self.var[n], *self.ends[n])): n for n in live if self.var[n] != upper}
        for node in [n for n in live if self.var[n] == upper]:
            (a, b), (c, d) = ((None, None) if child is None else self.ends[child] for child in self.ends[node])
            self.var[node], self.ends[node] = lower, (self._node(upper, a, c), self._node(upper, b, d))
            self.unique[(lower, *self.ends[node])] = node

    def all_pass(self) -> list[tuple[int, Weight, Weight]]:
        """(variable, kept, removed) of every level on the path that passes all filters."""
        out, node = [], self.root
        for var in self.order:
            low, high = (None, None) if node is None else self.ends[node]
            out.append((var, self.of(low), self.of(high)))
            node = low
        return out

    def fails_only(self, var: int) -> Weight:
        node = self.root
        for v in self.order:
            node = None if node is None else self.ends[node][v == var]
        return self.of(node)


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places whose swap with the next leads through all orders of n things (Steinhaus, Johnson and Trotter)."""
    things, ahead = list(range(n)), [-1] * n
    while True:
        for thing in range(n - 1, -1, -1):
            at = things.index(thing)
            to = at + ahead[thing]
            if 0 <= to < n and things[to] < thing:
                break
        else:
            return
        things[at], things[to] = things[to], things[at]
        for larger in range(thing + 1, n):
            ahead[larger] = -ahead[larger]
        yield min(at, to)


def steps_of(counts: dict[int, Weight]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step."""
    n = len(FILTERS)
    diagram = FailureDiagram(counts, n)
    found = {tuple(diagram.order): diagram.all_pass()}
    for place in adjacent_swaps(n):
        diagram.swap(place)
        found[tuple(diagram.order)] = diagram.all_pass()
    only = [diagram.fails_only(v)[0] for v in range(n)]
    fails, total = [0] * n, [0] * n
    for path in found.values():
        fails[path[0][0]] = path[0][2][0]
        for var, _, removed in path:
            total[var] += removed[0]
    return [("".join(FILTERS[v] for v in order), step, kept[0], gone[0], fails[var] - gone[0], only[var], gone[1], gone[2], total[var])
            for order in permutations(range(n)) for step, (var, kept, gone) in enumerate(found[order], 1)]


def own_mask(text: Column) -> Column:
    """Bits of the filters that look at one text alone: A 1, B 2, C 4, D 8."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    none = (trimmed == "").cast("int")
    n_words, distinct = F.size(words) - none, F.size(F.array_distinct(words)) - none
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [n_words < MIN_WORDS, 100 * distinct.cast("long") < DISTINCT_PERCENT * n_words.cast("long"),
             100 * upper.cast("long") > UPPER_PERCENT * F.length(text).cast("long"), text.rlike(SYMBOLS)]
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0)).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    judged = stored(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        own_mask(text).alias("own")), "filter-masks")
    rows = judged.groupBy("id", "digest", "part", "own").agg(F.count("*").alias("n"))
    first = judged.where("id IS NOT NULL").groupBy(F.col("digest").alias("first_digest")).agg(F.min("id").alias("first_id"))
    marked = rows.join(first, (rows["id"] == first["first_id"]) & (rows["digest"] == first["first_digest"]), "left")
    marked = marked.select("id", "part", "n", F.when(F.col("id").isNotNull() & F.col("first_id").isNull(), F.col("own") + 16).otherwise(F.col("own")).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 OR toxic = 1")
    joined = marked.join(marks, marked["id"] == marks["label_id"], "left")
    return joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *(F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = mask_counts(docs, labels, id_col, text_col, part_col)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 masks at most
    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = steps_of({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks})
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), *columns], names=["part", *names])

    return map_arrow(parts, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
                            "good_lost bigint, toxic_lost bigint, shapley bigint", run)
