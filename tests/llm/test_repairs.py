"""Filter audit, quality classifier and conversation repair against plain versions and on odd input."""

import hashlib
import itertools
import random
import re
import zlib

import brute
import numpy as np
import pytest

from umbraline.llm import conversation_repair as repair
from umbraline.llm import filter_audit, pu_quality

SPACE = re.compile(r"[\x20\x09-\x0D]+")


# Filter audit


def plain_audit(rows, labels):
    """Every order applied to the documents, one filter after the other."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = [x for x in SPACE.split(t) if x]
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), bool(set(t) & set("#$%&*|")),
            i is not None and i > least[t]), strict=True) if bad}
        docs.append((part or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine),
                                          sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_applying_every_order(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 30)] + [(4, 1, 1), (None, 1, 1), (5, None, None)]
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in filter_audit.audit(odd_docs, frame).collect()}
    want = plain_audit(rows, labels)
    assert got == want
    assert filter_audit.audit(no_docs, frame).collect() == []
    assert filter_audit.audit(odd_docs, frame.limit(0)).where("good_lost + toxic_lost > 0").isEmpty()


def test_diagram_keeps_its_counts_under_swaps():
    rng = random.Random(3)
    for _ in range(20):
        counts = {m: (rng.randint(1, 9), rng.randint(0, 3), rng.randint(0, 3)) for m in rng.sample(range(32), rng.randint(1, 20))}
        diagram = filter_audit.FailureDiagram(counts, 5)
        seen = {tuple(diagram.order)}
        for place in filter_audit.adjacent_swaps(5):
            diagram.swap(place)
            seen.add(tuple(diagram.order))
            left = dict(counts)
            for var, kept, removed in diagram.all_pass():
                gone = {m: w for m, w in left.items() if m >> var & 1}
                left = {m: w for m, w in left.items() if m not in gone}
                for weight, side in ((kept, left), (removed, gone)):
                    assert weight == tuple(sum(w[k] for w in side.values()) for k in range(3))
            assert len(diagram._reached()) <= 63
        assert len(seen) == 120


# Quality classifier


def auc(scores, truth):
    order = np.argsort(np.argsort(scores, kind="stable"))
    positive = order[np.array(truth) == 1]
    negative = order[np.array(truth) == 0]
    return float((positive[:, None] > negative[None, :]).mean())


def web(rng, n):
    """Prose, and four kinds of poor text."""
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        good = rng.random() < 0.7
        if not good:
            words = rng.choice([lambda w: [x.upper() + "!!" for x in w], lambda w: [x + "$$$" for x in w], lambda w: [w[0]] * len(w), lambda w: " | ".join(w).split(" ")])(words)
        rows.append((i, " ".join(words) + ".", int(good)))
    return rows


def test_classifier_ranks_held_out_documents(spark):
    rows = web(random.Random(9), 1200)
    docs = spark.createDataFrame([(i, t, "src", "en") for i, t, _ in rows] + [(None, None, None, None), (7, "", "a", "b")], "doc_id bigint, text string, id string, score string").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2] + [(None, 1, 0), (1, None, None)], "doc_id bigint, quality int, toxic int")
    got = pu_quality.classify(docs, labels).collect()
    assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) for r in got)
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert len(held) > 150 and auc([r.score for r in held], [truth[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93


def test_held_out_labels_are_not_learnt(spark):
    rows = web(random.Random(4), 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").coalesce(1)
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    honest = [(i, q, 0) for i, _, q in rows if i % 2]
    twisted = [(i, 1 - q if fold[i] else q, t) for i, q, t in honest]
    scores = [[r.score for r in pu_quality.classify(docs, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")).orderBy("doc_id").collect()]
              for x in (honest, twisted)]
    assert scores[0] == scores[1]


def test_classifier_without_anything_to_learn(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert pu_quality.classify(no_docs, none).collect() == []
    assert {(r.score, r.predicted) for r in pu_quality.classify(odd_docs, none).collect()} == {(0.5, 1)}


def test_prior_is_found(spark):
    rng = np.random.default_rng(1)
    positive = np.histogram(rng.beta(5, 2, 4000), 100, (0, 1))[0].astype(float)
    mixed = np.histogram(np.concatenate([rng.beta(5, 2, 6000), rng.beta(2, 9, 4000)]), 100, (0, 1))[0].astype(float)
    assert abs(pu_quality.best_bin_prior(positive, mixed) - 0.6) < 0.08


# Conversation repair


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_best(rows, faults):
    """All paths by Dijkstra's order on (cost, audit): a state is a row number, the pattern's state and what was written."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {(0, "0"): (0, "", ())}
    for at in range(len(rows) + 1):
        for _ in range(4):   # insertions
            for (k, state), (cost, audit, text) in list(best.items()):
                for role in ("user", "assistant"):
                    to = step.get((state, role[0]))
                    if k == at and to:
                        new = (cost + 3, audit + "I", (*text, role + ":"))
                        best[at, to] = min(best.get((at, to), new), new, key=lambda x: x[:2])
        if at == len(rows):
            break
        moved = {}
        for (k, state), (cost, audit, text) in best.items():
            _, role, body = rows[at]
            options = [(4, "D", state, ())]
            if faults[at] in ("", "truncated"):
                extra = 3 if faults[at] else 0
                for new in ("user", "assistant"):
                    if (state, new[0]) in step:
                        options.append((3 + extra, "R", step[state, new[0]], (new + ":" + body,)))
                if (state, role[:1]) in step:
                    options.append((extra, "K", step[state, role[:1]], (role + ":" + body,)))
            for c, letter, to, line in options:
                new = (cost + c, audit + letter, text + line)
                moved[at + 1, to] = min(moved.get((at + 1, to), new), new, key=lambda x: x[:2])
        best = moved
    return min((v for (_, state), v in best.items() if state in "0a"), key=lambda x: x[:2])


def every_audit(rows, faults):
    """The least (cost, audit) by trying all edits of a short conversation."""
    found = []

    def go(at, roles, cost, audit):
        if cost > 22:
            return
        if at == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit))
        else:
            extra = 3 if faults[at] == "truncated" else 0
            go(at + 1, roles, cost + 4, audit + "D")
            if faults[at] in ("", "truncated"):
                go(at + 1, roles + (rows[at][1][:1] or "-"), cost + extra, audit + "K")
                for role in "ua":
                    go(at + 1, roles + role, cost + 3 + extra, audit + "R")
        for role in "ua":
            go(at, roles + role, cost + 3, audit + "I")

    go(0, "", 0, "")
    return min(found)


def plain_repair(rows):
    out = {}
    for conv, kept in plain_damage(rows).items():
        faults = plain_faults(kept)
        turns = {r[0] for r in kept if r[0] is not None}
        cost, audit, lines = plain_best(kept, faults)
        initials = [r[1][:1] for r in kept]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, brute.sha("\n".join(lines)))
    return out


def conversations(rng, n):
    texts = ["Yes.", "No!", "cut off", "", "  ", "And?", "same words.", None]
    rows = []
    for conv in range(n):
        roles = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * rng.randint(0, 5)
        for turn, role in enumerate(roles):
            if rng.random() < 0.3:
                role = rng.choice(["user", "assistant", "system", "tool", "", None])
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn + (rng.random() < 0.1), role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return rows + rows[5:8]


@pytest.mark.parametrize("segment", [repair.SEGMENT, 3])
def test_repair_equals_the_plain_programme(spark, monkeypatch, segment):
    rows = conversations(random.Random(8), 150)
    rows += [("long", t, *r[2:]) for t, r in enumerate(rows)]
    rows = [(None if c is None else -1 if c == "long" else c, *r) for c, *r in rows]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, symbols string, kind string").repartition(5)
    monkeypatch.setattr(repair, "segments", small_segments(repair.segments, segment))
    got = {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in repair.repair(frame).collect()}
    assert got == plain_repair(rows)
    assert repair.repair(frame.limit(0)).collect() == []


def small_segments(real, size):
    """The segment size reaches the workers with the closure, as they import the module anew."""
    return lambda entries: real(entries, size)


def test_grammar_finds_the_least_audit_of_all():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(0, 3)
        rows = [(k, rng.choice(["user", "assistant", "system", "tool"]), "") for k in range(n)]
        faults = [rng.choice(["", "", "truncated", "blank"]) for _ in range(n)]
        symbols = "".join("x" if f == "blank" else (s if (s := r[1][0]) in "sua" else "o").upper() if f else (r[1][0] if r[1][0] in "sua" else "o") for r, f in zip(rows, faults, strict=True))
        cost, pieces = repair.Grammar([]).repair([symbols])
        assert (cost, "".join(pieces)) == every_audit(rows, faults) == plain_best(rows, faults)[:2]


def test_rules_and_cuts_do_not_change_results():
    rng = random.Random(6)
    rules = ["ua", chr(repair.FIRST_RULE) * 2, "xx", "s" + chr(repair.FIRST_RULE), "oo", "UA"]
    for _ in range(200):
        symbols = "".join(rng.choice("suaoSUAOx" + "uauaua") for _ in range(rng.randint(0, 40)))
        cut = sorted(rng.randint(0, len(symbols)) for _ in range(3))
        pieces = [symbols[a:b] for a, b in itertools.pairwise([0, *cut, len(symbols)])]
        plain, ruled, parted = repair.Grammar([]).repair([symbols]), repair.Grammar(rules).repair([symbols]), repair.Grammar(rules).repair(pieces)
        assert plain == ruled and plain[0] == parted[0] and plain[1][0] == "".join(parted[1])
