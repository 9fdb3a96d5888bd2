"""URL filter: all glob rules in one bit-parallel automaton.

Rules are packed state by state into words of 64 bits (Shift-And with self loops for wildcards). A whole Arrow batch of
canonical URLs is stepped together, one byte position at a time: D = ((D << 1) & advance[byte]) | (D & stay[byte]), with
carries between words. URLs are sorted by length so that a long one never makes the short ones wait.

A canonical URL is host (A-Z lower-cased), path, and the query if there is one. In a rule, `**` stands for any bytes,
`*` for any bytes but / ? and #, other bytes for themselves.

Host and path rules win over the glob lists; among them the longest that fits, then the first listed. A rule `host/path`
fits its host and all subdomains when the path starts with the rule's. Without such a rule a URL is blocked when one of
the block globs fits, else allowed.

Results for odd input: a null URL, or one without "://", has an empty host and path and no rule, and is allowed; URLs of
any length are judged whole; equal rows give equal rows; an empty table gives an empty table; only the two named columns
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, raw_bytes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Own list: what the filter blocks where no host rule speaks.
BLOCK_GLOBS = [
    "**/login**", "**/signin**", "**/signup**", "**/cart/**", "**/checkout/**", "**/wp-admin/**", "**/wp-login.php**", "**/cgi-bin/**",
    "**.exe", "**.zip", "**.iso", "**.apk", "**.dmg", "**.rar",
    "**?**sessionid=**", "**?**phpsessid=**", "**?**sid=**", "**?**replytocom=**",
    "ads.*/**", "ad.*/**", "*.ads.*/**", "tracker.*/**", "*.doubleclick.*/**", "casino**", "*.casino*/**", "*.xxx/**", "xn--*/**",
]


class GlobAutomaton:
    """Globs compiled into masks over bytes; accepts() tells which globs fit which texts."""

    def __init__(self, globs: list[str]):
        symbols: list[tuple[int, int | None]] = []  # (state, byte that leads to the next state)
        loops: dict[int, str] = {}
        first, last, state = [], [], 0
        for glob in globs:
            first.append(state)
            rest = glob.encode()
            while rest:
                if rest[:2] == b"**":
                    loops[state], rest = "any", rest[2:]
                elif rest[:1] == b"*":
                    loops.setdefault(state, "part")
                    rest = rest[1:]
                else:
                    symbols.append((state, rest[0]))
                    state, rest = state + 1, rest[1:]
            last.append(state)
            state += 1
        self.words = max(1, -(-state // 64))
        self.advance = np.zeros((256, self.words), np.uint64)  # bit k + 1: the byte leads from k to k + 1
        self.stay = np.zeros((256, self.words), np.uint64)
        one = np.uint64(1)
        for at, byte in symbols:
            self.advance[byte, (at + 1) // 64] |= one << np.uint64((at + 1) % 64)
        everything = np.ones(256, bool)
        part = everything.copy()
        part[list(b"/?#")] = False
        for at, kind in loops.items():
            self.stay[everything if kind == "any" else part, at // 64] |= one << np.uint64(at % 64)
        self.start = np.zeros(self.words, np.uint64)
        for at in first:
            self.start[at // 64] |= one << np.uint64(at % 64)
        self.last = last

    def accepts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows x globs: data holds the texts without gaps, ends their offsets."""
        size = np.diff(ends)
        order = np.argsort(-size, kind="stable")
        states = np.tile(self.start, (len(size), 1))
        starts, lengths = ends[:-1][order], size[order]
        one, top = np.uint64(1), np.uint64(63)
        live = len(order)
        for at in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths[:live], -at, "left"))  # rows longer than `at`
            now, byte = states[:live], data[starts[:live] + at]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            states[:live] = (moved & self.advance[byte]) | (now & self.stay[byte])
        out = np.zeros((len(size), len(self.last)), bool)
        for n, bit in enumerate(self.last):
            out[order, n] = (states[:, bit // 64] >> np.uint64(bit % 64)) & one != 0
        return out


def with_parts(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, host, path, canonical): stays in the JVM."""
    url = F.col(url_col)
    scheme = F.instr(url, "://")
    rest = pages.select(id_col, F.when(scheme > 0, F.substring(url, scheme + 3, F.length(url))).otherwise("").alias("rest"))
    host = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract("rest", r"^[^?#]*(\?[^#]*)?", 1)
    return rest.select(id_col, host.alias("host"), path.alias("path"), F.concat(host, path, query).alias("canonical"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], block_globs: list[str] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict. rules: (allow or block, host, path prefix)."""
    ordered = sorted(rules, key=lambda r: -len((r[1] + r[2]).encode()))
    globs = [g for _, host, path in ordered for g in (f"{host}{path}**", f"*.{host}{path}**")] + list(block_globs)
    automaton = GlobAutomaton(globs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fits = automaton.accepts(*raw_bytes(batch.column(3)))
        named = fits[:, :2 * len(ordered)].reshape(len(fits), len(ordered), 2).any(2)
        best = np.where(named.any(1), named.argmax(1), -1)
        blocked = fits[:, 2 * len(ordered):].any(1)
        rule = [None if b < 0 else ordered[b][1] + ordered[b][2] for b in best]
        verdict = [ordered[b][0] if b >= 0 else "block" if bad else "allow" for b, bad in zip(best, blocked, strict=True)]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    key = pages.schema[id_col].dataType.simpleString()
    return map_arrow(with_parts(pages, id_col, url_col), f"`{id_col}` {key}, host string, path string, rule string, verdict string", run)


def glob_regex(glob: str) -> str:
    """The same glob as a regular expression, for the SQL twin and tests."""
    out, rest = "", glob
    while rest:
        if rest.startswith("**"):
            out, rest = out + "(?s:.*)", rest[2:]
        elif rest[0] == "*":
            out, rest = out + "[^/?#]*", rest[1:]
        else:
            out, rest = out + (rest[0] if rest[0].isalnum() else "\\" + rest[0]), rest[1:]
    return f"^{out}$".replace("$", r"\z")
