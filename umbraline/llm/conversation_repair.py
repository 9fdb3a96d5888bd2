"""Conversation structure repair by a grammar-compressed dynamic programme.

A conversation should read `(s?(ua)+)?` by the initials of its roles. Every row has at most one fault (blank, duplicate,
truncated); edits keep, rerole, delete or insert turns at a cost, and the cheapest edits are sought, of equal ones the audit
(the initials K R D I in order) that is least in ASCII.

Method. A row's role and fault make one of nine symbols, and a conversation a sequence of them. Re-Pair replaces frequent
pairs of neighbours by new symbols, in rounds counted over all different sequences. Each symbol has one min-plus transfer
matrix over the states of the role pattern: the least cost from state to state, with the audit that achieves it as a rope. The
matrix of a rule is the product of its two, so a rule is evaluated once, bottom-up, and serves all conversations. A
conversation is the product of the few symbols that are left of it.

Ties. A symbol's transfer ends with the letter of its row (insertions come before it), so of two audits over the same rows
neither is a beginning of the other, and state and audit determine the state reached. Hence the order of a row's audits is
kept as ranks, products compare ranks only, and ropes are never read before the end.

Scale. Faults are found on small rows without texts: equal rows are counted first, and the first of equal texts by an
aggregate. Rows are then sorted over the whole table and cut into segments of at most SEGMENT different rows, so one conversation with
a third of all rows is spread over many tasks. A segment's symbols are folded in the order of a conversation in memory that
holds a rope per segment. Only the digest of the repaired text, which is sequential by nature, reads a
conversation's texts in one stream, a batch at a time.

Results for odd input: null roles, texts, ids and turns are one space where they are hashed, compared or written; a null turn
sorts first and has no part in gaps; a null conversation id is a conversation of its own; rows of equal turn are taken by
role, then by the digest of the text; rows that repeat are duplicates of each other; conversations that lose all rows give
zeros, an empty audit and the digest of the empty string; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bounded_broadcast, map_arrow, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3   # costs
SEGMENT = 4_096            # different rows of a segment
ROUNDS = 6                 # of pair counting
MOST_RULES = 256
CANDIDATES = 64            # pairs looked at in a round
BROADCAST_REPEATS = 200_000
FIRST_RULE = 0xE000        # symbols of rules are private characters from here on

# States of the pattern: nothing yet, after s, after u, after a. The first and the last may end it.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
NEXT = [AFTER_U, AFTER_U, AFTER_A, AFTER_U]   # after an inserted or reroled turn
TO_END = ["", "II", "I", ""]
MUST_GO = "x"

Rope = object              # a string, or a pair of ropes
Matrix = list              # rows of [(cost, rank, rope) or None]


def flat(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            todo += [part[1], part[0]]
    return "".join(out)


def terminal(symbol: str) -> Matrix:
    """Transfers of one row: s, u, a or o for another role, in upper case when truncated; x when it must be deleted."""
    initial, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    out = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, letters = start, ""
        for n in range(4):    # insertions before the row
            options = [(DELETE, "D", state)]
            if symbol != MUST_GO:
                options.append((REROLE + extra, "R", NEXT[state]))
                if (state, initial) in KEPT:
                    options.append((KEEP + extra, "K", KEPT[state, initial]))
            for cost, letter, to in options:
                best[to] = min(best.get(to, (1 << 60, "")), (cost + n * INSERT, letters + letter))
            state, letters = NEXT[state], letters + "I"
        rank = {text: k for k, text in enumerate(sorted(text for _, text in best.values()))}
        out.append([(best[q][0], rank[best[q][1]], best[q][1]) if q in best else None for q in range(4)])
    return out


def advance(row: list, matrix: Matrix) -> list:
    """A row of transfers (cost, rank, rope) followed by a matrix."""
    found: list = [None] * 4
    for middle, entry in enumerate(row):
        if entry is not None:
            for to, step in enumerate(matrix[middle]):
                if step is not None:
                    key = (entry[0] + step[0], entry[1])
                    if found[to] is None or key < found[to][0]:
                        found[to] = (key, step[1], (entry[2], step[2]))
    order = {place: k for k, place in enumerate(sorted({(f[0][1], f[1]) for f in found if f is not None}))}
    return [None if f is None else (f[0][0], order[f[0][1], f[1]], f[2]) for f in found]


def product(left: Matrix, right: Matrix) -> Matrix:
    return [advance(row, right) for row in left]


class Grammar:
    """Re-Pair rules in the order they were made, with a matrix for every symbol."""

    def __init__(self, rules: list[str]):
        self.rules = [(pair, chr(FIRST_RULE + k)) for k, pair in enumerate(rules)]
        self.matrix = {s: terminal(s) for s in "suaoSUAO" + MUST_GO}
        for pair, symbol in self.rules:
            self.matrix[symbol] = product(self.matrix[pair[0]], self.matrix[pair[1]])

    def compress(self, symbols: str) -> str:
        for pair, symbol in self.rules:
            symbols = symbols.replace(pair, symbol)
        return symbols

    def follow(self, row: list, symbols: str) -> list:
        for symbol in self.compress(symbols):
            row = advance(row, self.matrix[symbol])
        return row

    def repair(self, segments: list[str]) -> tuple[int, list[str]]:
        """Least cost, and the audit cut into the pieces of the segments."""
        row, trail = [(0, 0, ""), None, None, None], []
        for symbols in segments:
            # The rope of a step is the state the segment was entered in; its own letters start anew.
            entered = self.follow([None if e is None else (e[0], e[1], str(state)) for state, e in enumerate(row)], symbols)
            trail.append(entered)
            row = [None if e is None else (e[0], e[1], "") for e in entered]
        cost, _, state = min((e[0] + INSERT * len(TO_END[q]), e[1], q) for q, e in enumerate(row) if e is not None)
        pieces = []
        ending = TO_END[state]
        for entered in reversed(trail):
            text = flat(entered[state][2])
            pieces.append(text[1:] + ending)
            state, ending = int(text[0]), ""
        return cost, pieces[::-1]


def induce(sequences: DataFrame) -> list[str]:
    """Re-Pair over different sequences (column symbols): pairs made into rules, a few per round that share no symbol."""
    rules: list[str] = []
    for _ in range(ROUNDS):
        grammar = Grammar(rules)

        def count(batch: pa.RecordBatch, grammar: Grammar = grammar) -> pa.RecordBatch:
            found: Counter = Counter()
            for symbols in batch.column(0).to_pylist():
                short = grammar.compress(symbols)
                for pair in {short[k:k + 2] for k in range(len(short) - 1)}:
                    found[pair] += short.count(pair)
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["pair", "n"])

        counts = map_arrow(sequences.select("symbols"), "pair string, n bigint", count).groupBy("pair").agg(F.sum("n").alias("n"))
        taken: set[str] = set()
        before = len(rules)
        for r in counts.where("n > 1").orderBy(F.desc("n"), "pair").limit(CANDIDATES).collect():
            if not taken & set(r.pair) and len(rules) < MOST_RULES:
                taken |= set(r.pair)
                rules.append(r.pair)
        if len(rules) == before:
            break
    return rules


def damaged(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, copies): what is left of every row after the damage; 0 copies of a dropped one."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    kind = F.crc32(key) % 20
    role, text = F.coalesce(F.col(role_col), blank), F.coalesce(F.col(text_col), blank)
    return rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def digest(text: str = "text") -> Column:
    return F.unhex(F.md5(F.col(text)))


ORDER = [F.asc_nulls_first, F.asc_nulls_first, F.asc, F.asc]
KEY = ["conv", "turn", "role", "digest"]


def in_order() -> list[Column]:
    return [f(c) for f, c in zip(ORDER, KEY, strict=True)]


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, symbol, n, dup): different rows, their number, and whether an earlier row equals them."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    shown = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(trimmed == "", MUST_GO).when(trimmed.rlike(r"[.!?]\z"), shown).otherwise(F.upper(shown))
    small = rows.where("copies > 0").select("conv", "turn", "role", digest().alias("digest"), symbol.alias("symbol"), "copies")
    entries = stored(small.groupBy("conv", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.first("symbol").alias("symbol")), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = entries.where(f"symbol <> '{MUST_GO}'").groupBy("conv", "role", "digest").agg(F.min(at).alias("first"), F.count("*").alias("many")).where("many > 1")
    again = stored(again.select(F.col("conv").alias("r_conv"), F.col("role").alias("r_role"), F.col("digest").alias("r_digest"), "first"), "repeats")
    joined = entries.join(
        bounded_broadcast(again, again.count(), BROADCAST_REPEATS),
        entries["conv"].eqNullSafe(again["r_conv"]) & (entries["role"] == again["r_role"]) & (entries["digest"] == again["r_digest"]), "left")
    return joined.select(*KEY, "symbol", "n", F.coalesce(F.col("first") < at, F.lit(False)).alias("dup"))


def segments(entries: DataFrame, most: int = SEGMENT) -> DataFrame:
    """The rows in order over the whole table, as segments of symbols with their counts. The key is that of the first row."""
    fields = {f.name: f.dataType.simpleString() for f in entries.schema.fields}
    schema = (f"conv {fields['conv']}, turn {fields['turn']}, role string, digest binary, symbols string, blank bigint, duplicate bigint, truncated bigint, "
              f"illegal bigint, first string, last string, low {fields['turn']}, high {fields['turn']}, turns bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: pa.Schema | None = None
        ready, now, symbols, size = [], None, [], 0

        def close() -> None:
            if now is not None:
                now["symbols"] = "".join(symbols)
                ready.append(now)
                symbols.clear()

        for batch in batches:
            if kind is None:
                conv, turn = (batch.schema.field(c).type for c in ("conv", "turn"))
                kind = pa.schema([("conv", conv), ("turn", turn), ("role", pa.string()), ("digest", pa.binary()), ("symbols", pa.string()), *(
                    (c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()),
                    ("low", turn), ("high", turn), ("turns", pa.int64())])
            for r in batch.to_pylist():
                initial = r["role"][:1]
                if now is None or now["conv"] != r["conv"] or size >= most:
                    close()
                    size = 0
                    now = {k: r[k] for k in KEY} | {
                        "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": initial, "last": None, "low": None, "high": None, "turns": 0}
                size += 1
                symbol, n = r["symbol"], r["n"]
                if symbol == MUST_GO:
                    now["blank"] += n
                else:
                    now["duplicate"] += n - (not r["dup"])
                    now["truncated"] += (not r["dup"]) and symbol.isupper()
                symbols.append((MUST_GO if r["dup"] else symbol) + MUST_GO * (n - 1))
                now["illegal"] += n - 1 + (now["last"] is not None and now["last"] + initial not in ("su", "ua", "au"))
                now["last"] = initial
                if r["turn"] is not None and r["turn"] != now["high"]:
                    now["turns"] += 1
                    now["high"] = r["turn"]
                    now["low"] = r["turn"] if now["low"] is None else now["low"]
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema=kind)
                ready.clear()
        close()
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=kind)

    return entries.orderBy(*in_order()).mapInArrow(run, schema)


TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def folded(parts: DataFrame, rules: list[str]) -> DataFrame:
    """(key of a segment's first row, piece, totals of the conversation): the audit of every segment."""
    fields = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    schema = f"conv {fields['conv']}, turn {fields['turn']}, role string, digest binary, piece string, " + ", ".join(f"{c} bigint" for c in TOTALS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        whole = lru_cache(maxsize=100_000)(lambda symbols: grammar.repair([symbols]))

        def finish(held: list[dict]) -> list[dict]:
            cost, pieces = whole(held[0]["symbols"]) if len(held) == 1 else grammar.repair([s["symbols"] for s in held])
            total = {c: sum(s[c] for s in held) for c in ("blank", "duplicate", "truncated", "illegal")} | {"cost": cost}
            turns, high, low = 0, None, None
            for k, s in enumerate(held):
                total["illegal"] += k > 0 and held[k - 1]["last"] + s["first"] not in ("su", "ua", "au")
                if s["low"] is not None:
                    turns += s["turns"] - (s["low"] == high)
                    low, high = s["low"] if low is None else low, s["high"]
            total["gaps"] = 0 if low is None else high - low + 1 - turns
            return [{k: s[k] for k in KEY} | {"piece": piece} | total for s, piece in zip(held, pieces, strict=True)]

        held: list[dict] = []
        for batch in batches:
            kind = pa.schema([*(batch.schema.field(c) for c in KEY), ("piece", pa.string()), *((c, pa.int64()) for c in TOTALS)])
            out = []
            for s in batch.to_pylist():
                if held and held[0]["conv"] != s["conv"]:
                    out += finish(held)
                    held = []
                held.append(s)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
        if held:
            yield pa.RecordBatch.from_pylist(finish(held), schema=kind)

    return parts.repartition("conv").sortWithinPartitions(*in_order()).mapInArrow(run, schema)


def written(rows: DataFrame, audits: DataFrame, conv_col: str) -> DataFrame:
    """One row per conversation: the totals, the audit, and the digest of the repaired text, read as a stream in order."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    texts = rows.select("conv", "turn", "role", digest().alias("digest"), F.lit(1).alias("kind"), "copies", F.when(F.col("copies") > 0, F.col("text")).alias("body"),
                        *(F.lit(None).cast("bigint").alias(c) for c in TOTALS))
    pieces = audits.select(*KEY, F.lit(0).alias("kind"), F.lit(0).alias("copies"), F.col("piece").alias("body"), *TOTALS)
    both = texts.unionByName(pieces).repartition("conv").sortWithinPartitions(*in_order(), "kind")
    schema = f"conv {fields['conv']}, " + ", ".join(f"{c} bigint" for c in TOTALS) + ", audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Repaired | None = None
        for batch in batches:
            kind = pa.schema([batch.schema.field("conv"), *((c, pa.int64()) for c in TOTALS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            out = []
            for r in batch.to_pylist():
                if now is None or now.conv != r["conv"]:
                    if now is not None:
                        out.append(now.row())
                    now = Repaired(r["conv"])
                if r["kind"] == 0:
                    now.piece(r)
                elif r["copies"]:
                    now.turn(r["role"], r["body"], r["copies"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema=kind)

    return both.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


class Repaired:
    """A conversation as it is written: the pieces of its audit arrive before the rows they are about."""

    def __init__(self, conv: object):
        self.conv, self.totals, self.pieces, self.at, self.rows_end = conv, dict.fromkeys(TOTALS, 0), [], 0, 0
        self.hash, self.state, self.lines = hashlib.sha256(), START, 0

    def piece(self, r: dict) -> None:
        self.totals = {c: r[c] for c in TOTALS}
        self.pieces.append(r["body"])
        self.at, self.rows_end = 0, len(r["body"].rstrip("I"))

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def added(self) -> str:
        self.state = NEXT[self.state]
        return "assistant" if self.state == AFTER_A else "user"

    def inserted(self) -> None:
        piece = self.pieces[-1]
        while self.at < len(piece) and piece[self.at] == "I":
            self.line(self.added(), "")
            self.at += 1

    def turn(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self.inserted()
            letter = self.pieces[-1][self.at]
            self.at += 1
            if letter == "K":
                self.state = KEPT[self.state, role[:1]]
                self.line(role, text)
            elif letter == "R":
                self.line(self.added(), text)
        if self.at >= self.rows_end:   # insertions behind the last row end the conversation
            self.inserted()

    def row(self) -> dict:
        return {"conv": self.conv, **self.totals, "audit": "".join(self.pieces), "repaired_sha256": self.hash.hexdigest()}


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damage the rows as the query prescribes, and repair every conversation."""
    return repaired(damaged(rows, conv_col, turn_col, role_col, text_col), conv_col)


def repaired(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Repair rows (conv, turn, role, text, copies), none of them null but conv and turn; rows of 0 copies only name their
    conversation."""
    parts = stored(segments(faults(rows)), "segments")
    rules = induce(stored(parts.select("symbols").distinct(), "sequences"))
    return written(rows, folded(parts, rules), conv_col)
