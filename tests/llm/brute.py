"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def base_secrets(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    assign = [m for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    access = [m for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    hexes = [m for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    spans = sorted((m.start(), k, m.end()) for k, ms in enumerate((assign, access, hexes)) for m in ms)
    names = ("assign", "access", "hex")
    return len(assign), len(access), len(hexes), sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans))


def cut_repeats(docs: list[tuple[int, str | None]], width: int = 50) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (bytes, removed bytes, removed runs, digest of the rest); ids differ."""
    first: dict[bytes, int] = {}
    for key, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1):
            s = raw[i:i + width]
            first[s] = min(first.get(s, key), key)
    out = {}
    for key, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if first[raw[i:i + width]] < key:
                gone[i:i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        out[key] = (len(raw), sum(gone), runs, sha(kept))
    return out


def words(text: str | None, lower: bool = True) -> list[str]:
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingle_set(text: str | None, k: int = 3) -> set[tuple[str, ...]]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def near_components(docs: list[tuple[int, str | None]], percent: int = 90, width: int = 3) -> dict[int, tuple[int, int]]:
    """doc_id -> (size of the set, smallest id of the component)."""
    sets = [(key, shingle_set(text, width)) for key, text in docs]
    root = {key: key for key, _ in docs}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {key: (len(s), find(key)) for key, s in sets}


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], percent: int = 80) -> set[tuple[int, int, int, int]]:
    def grams(text: str | None) -> set[tuple[str, ...]]:
        w = words(text)
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    known = [(i, s) for i, t in items if (s := grams(t))]
    out = set()
    for key, text in docs:
        own = grams(text)
        out |= {(key, i, len(own & s), len(s)) for i, s in known if 100 * len(own & s) >= percent * len(s)}
    return out


def later_lines(docs: list[tuple[int, str | None]], least: int) -> dict[int, set[int]]:
    """doc_id -> deleted lines: lines of runs of `least` words or more that also start earlier."""
    lines = {key: text.split("\n") for key, text in docs if text is not None}
    seen: dict[str, tuple[int, int]] = {}
    runs = []
    for key in sorted(lines):
        own = lines[key]
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                if sum(len(words(x)) for x in own[i:j]) >= least:
                    body = "\n".join(own[i:j])
                    runs.append((key, i, j, body))
                    seen[body] = min(seen.get(body, (key, i)), (key, i))
    out: dict[int, set[int]] = {}
    for key, i, j, body in runs:
        if seen[body] < (key, i):
            out.setdefault(key, set()).update(range(i, j))
    return out
