"""Duplicate search, decontamination and the pipeline against plain versions and on odd input."""

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa

from umbraline.llm import bytes_text, decontaminate, jaccard_join, line_dedup, substring_dedup
from umbraline.llm.common import components, raw_bytes


def numbered(texts):
    return list(enumerate(texts))


def test_words_and_shingles_equal_plain_ones(texts, monkeypatch):
    for piece in (bytes_text.PIECE, 97):
        monkeypatch.setattr(bytes_text, "PIECE", piece)
        data, ends = raw_bytes(pa.array(texts[:40], pa.string()))
        hashes, starts = bytes_text.words(data, ends)
        want = [w for t in texts[:40] for w in brute.words(t)]
        assert len(hashes) == len(want) == starts[-1]
        assert len({(int(h), w) for h, w in zip(hashes, want, strict=True)}) == len(set(want)) == len(set(hashes.tolist()))


def test_substrings_equal_brute_force(odd_docs, no_docs, texts):
    docs = [(i, t) for i, t in enumerate(texts) if not t or len(t) < 90_000]
    want = brute.cut_repeats(docs + [(10**9, texts[6])])
    got = substring_dedup.remove_repeats(odd_docs.where("doc_id is null or text is null or length(text) < 90000"), with_text=True).collect()
    assert len(got) == len(docs) + 3
    for r in got:
        assert tuple(r[1:5]) == want[10**9 if r.doc_id is None else r.doc_id], r.doc_id
        assert brute.sha(bytes(r.kept)) == r.kept_sha256
    assert substring_dedup.remove_repeats(no_docs).collect() == []


def test_bucket_sort_equals_direct_comparison():
    rng = np.random.default_rng(3)
    for letters in (2, 3, 20):
        pool = [rng.integers(65, 65 + letters, 80, dtype=np.uint8) for _ in range(6)]
        text, heads = [], []
        for i in range(60):
            row = pool[rng.integers(6)].copy()
            if rng.random() < 0.5:
                row[rng.integers(80)] = 90
            count = int(rng.integers(1, 32))
            row[count + 49:] = 0
            text.append(np.concatenate([row, np.zeros(16, np.uint8)]))
            heads.append((int(rng.integers(12)), int(rng.integers(1_000)), count))
        head = {"id": np.array([h[0] for h in heads]), "at": np.array([h[1] for h in heads]), "count": np.array([h[2] for h in heads])}
        mask = substring_dedup.sort_bucket(np.array(text), head)
        least: dict[bytes, int] = {}
        for t, (key, _, count) in zip(text, heads, strict=True):
            for o in range(count):
                s = t[o:o + 50].tobytes()
                least[s] = min(least.get(s, 99), key)
        for t, (key, _, count), m in zip(text, heads, mask, strict=True):
            assert [bool(m >> o & 1) for o in range(count)] == [least[t[o:o + 50].tobytes()] < key for o in range(count)]


def test_cover_has_every_shift():
    v, cover = substring_dedup.COVER_SIZE, substring_dedup.COVER
    for a in range(v):
        for b in range(v):
            d = substring_dedup.SHIFT[a, b]
            assert (a + d) % v in cover and (b + d) % v in cover and d < v


def test_near_components_equal_brute_force(odd_docs, no_docs, texts):
    want = brute.near_components(numbered(texts))
    rows = jaccard_join.join(odd_docs).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        assert (r.n_shingles, r.component_id) == want[6 if r.doc_id is None else r.doc_id], r.doc_id
    kept = jaccard_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {k for k, (_, c) in want.items() if k == c}
    assert jaccard_join.join(no_docs).collect() == [] and jaccard_join.one_of_each(no_docs).collect() == []


def test_groups_of_near_copies_lose_no_link(spark, monkeypatch):
    """Copies around the threshold, found through small blocks of the R-tree as well as through leaders."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "LEADERS", 1)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(150):
        words = list(base)
        for j in rng.choice(200, rng.integers(1, 7), replace=False):
            words[j] = f"x{i}_{j}"
        docs.append((i, " ".join(words)))
    docs += [(200 + i, " ".join(f"s{i}_{j}" for j in range(i % 5))) for i in range(20)]
    want = brute.near_components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == want and len({c for _, c in want.values()}) > 20


def test_shared_group_whenever_linked():
    rng = np.random.default_rng(2)
    for n in [*range(5, 60), 100, 500, 2_000]:
        for _ in range(5):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            apart = (len(a) + len(a)) // 19
            drop, add = int(rng.integers(0, apart + 1)), 0
            add = min(apart - drop, apart)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert np.intersect1d(jaccard_join.all_digests(a), jaccard_join.all_digests(b)).size


def plain_components(docs, width, percent):
    sets = {i: brute.shingle_set(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, t in sets.items():
            if j < i and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_pipeline_join_takes_five_words_and_four_fifths(spark, monkeypatch):
    """Pairs just above and below 0.8 of five-word shingles; most above it are under 0.9 of three-word shingles."""
    import corpus_pipeline

    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = np.random.default_rng(21)
    docs, group = [], 0
    for length in (24, 60, 150, 300, 700):
        for cut in range(1, length // 5, max(1, length // 60)):
            base = [f"g{group}_{j}" for j in range(length)]
            at = int(rng.integers(0, length - cut))
            other = [*base[:at], *(f"x{group}_{j}" for j in range(cut)), *base[at + cut:]]
            docs += [(2 * group, " ".join(base)), (2 * group + 1, " ".join(other))]
            group += 1
    block = [f"b{j}" for j in range(300)]
    docs += [(9_000, " ".join(block)), (9_001, " ".join([*block[:140], *(f"c{j}" for j in range(20)), *block[160:]]))]
    docs += [(10_000 + i, " ".join(f"y{i}_{j}" if rng.random() < 0.015 else f"h{j}" for j in range(200))) for i in range(60)]
    want = plain_components(docs, 5, 80)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.join_stage(spark, frame, "").collect()}
    assert got == {i for i, c in want.items() if i == c} and 9_001 not in got
    assert len(got) < len({c for c in plain_components(docs, 3, 90).values()})
    assert {r.doc_id: r.component_id for r in jaccard_join.join(frame).collect()} == plain_components(docs, 3, 90)


def test_shared_group_whenever_linked_at_four_fifths():
    rng = np.random.default_rng(6)
    for n in [*range(1, 80), 100, 500, 2_000, 9_000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, n // 5 + 1))
            add = int(rng.integers(0, n // 4 + 1)) if drop == 0 else int((n - drop) / 0.8 - n + 1e-9)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, max(add, 0), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert abs(jaccard_join.size_class(len(a)) - jaccard_join.size_class(len(b))) <= 1
                assert np.intersect1d(jaccard_join.all_digests(a, 80), jaccard_join.all_digests(b, 80)).size


def test_group_counts_bound_the_overlap():
    rng = np.random.default_rng(9)
    for n in (0, 1, 7, 8, 9, 100, 3_000):
        for share in (0.0, 0.5, 0.9, 1.0):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[:int(n * share)], rng.integers(0, 2**63, n // 3, dtype=np.uint64)]))
            x, y = jaccard_join.group_counts(a), jaccard_join.group_counts(b)
            assert (x.sum(), y.sum()) == (len(a), len(b)) and jaccard_join.most_common(x, y) == jaccard_join.most_common(y, x)
            assert len(np.intersect1d(a, b)) <= jaccard_join.most_common(x, y) <= min(len(a), len(b))


def test_tree_search_keeps_every_close_point():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 6, (500, 128)).astype(np.int32)
    points[1::2] = points[::2] + (rng.random((250, 128)) < 0.03)
    sizes = points.sum(1).astype(np.int64)
    tree = jaccard_join.CountTree(points)
    for i in range(0, 500, 17):
        bound = np.minimum(points, points[i]).sum(1)
        near = (190 * bound >= 90 * (sizes + sizes[i])) & (100 * np.minimum(sizes, sizes[i]) >= 90 * np.maximum(sizes, sizes[i]))
        assert set(np.flatnonzero(near)) <= set(tree.search(points[i], int(sizes[i]), sizes))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_containment_equals_brute_force(spark, odd_docs, no_docs, texts):
    rng = np.random.default_rng(8)
    items = [(0, texts[20].split("\n")[1]), (1, None), (2, "a b c"), (3, "nothing of that kind stands anywhere in these texts"), (4, " ".join(texts[6].split()[10:60])), (5, texts[6])]
    long = texts[-8].split()
    items += [(10 + i, " ".join(long[s:s + n])) for i, (s, n) in enumerate(zip(rng.integers(0, 14_000, 20), rng.integers(5, 400, 20), strict=True))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute.leaks(numbered(texts), items)
    got = decontaminate.contained(odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"]), bench).collect()
    assert {tuple(r[:4]) for r in got} == want and len(got) == len(want)
    clean = decontaminate.keep_clean(odd_docs, bench)
    assert clean.columns == odd_docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {w[0] for w in want}
    assert decontaminate.contained(no_docs, bench).collect() == [] and decontaminate.contained(odd_docs, bench.limit(0)).collect() == []
    assert decontaminate.keep_clean(odd_docs, bench.limit(0)).count() == odd_docs.count()


def test_lines_equal_brute_force(odd_docs, no_docs, texts):
    docs = [(i, t) for i, t in enumerate(texts)]
    want = brute.later_lines([*docs, (-1, texts[6])], line_dedup.MIN_WORDS)  # a null id comes first
    rows = line_dedup.report(odd_docs).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        text = texts[6 if r.doc_id is None else r.doc_id]
        gone = want.get(-1 if r.doc_id is None else r.doc_id, set())
        lines = [] if text is None else text.split("\n")
        assert (r.n_lines, r.n_removed, r.kept_sha256) == (len(lines), len(gone), brute.sha("\n".join(x for i, x in enumerate(lines) if i not in gone))), r.doc_id
    kept = line_dedup.drop_repeats(odd_docs)
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes
    assert all(r.n_chars is None or r.text is None or r.n_chars == len(r.text) for r in kept.collect())
    assert line_dedup.report(no_docs).collect() == [] and line_dedup.drop_repeats(no_docs).collect() == []


def test_rows_given_twice_are_one_document_to_line_runs(spark):
    """Six lines of 12 words, the earlier document given twice: runs of three lines are found, and rows do not multiply."""
    lines = ["\n".join(" ".join(f"r{k}_{i}_{j}" for j in range(12)) for i in range(n)) for k, n in enumerate((6, 40))]
    docs = [(1, lines[0]), (1, lines[0]), (2, lines[0] + "\nown"), (3, lines[1]), (3, lines[1]), (3, lines[1]), (4, "x\n" + lines[1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.report(frame).collect())
    assert got == [(1, 6, 0), (1, 6, 0), (2, 7, 6), (3, 40, 0), (3, 40, 0), (3, 40, 0), (4, 41, 40)]
    assert line_dedup.repeated_lines(frame, "doc_id", "text").count() == 92


def test_runs_inside_each_other_are_merged(spark):
    """Runs that lie in each other: two documents with 200 blank lines before a long one."""
    long = "\n" * 200 + " ".join(f"w{j}" for j in range(40))
    rows = [(1, long), (2, "own line\n" + long + "\nend"), (3, "\n\n\n")]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (201, 0), 2: (203, 201), 3: (4, 0)}
    assert [r.text for r in line_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).where("doc_id = 2").collect()] == ["own line\nend"]


def test_pipeline_equals_the_plain_stages(spark, tmp_path, texts):
    import corpus_pipeline
    import tiktoken

    from umbraline.llm import bpe, quality

    base = [f"pipe{k}x{k * k % 97}" for k in range(300)]   # near copies by five words at 0.8 that three words at 0.9 tell apart
    docs = [(i, t, "en", "h", 0 if t is None else len(t)) for i, t in enumerate([*texts, " ".join(base), " ".join([*base[:100], *(w + "y" for w in base[100:120]), *base[120:]])])
            if t is None or len(t) < 90_000]
    items = [(0, " ".join(texts[-1].split()[5:25])), (1, "not in any of these texts at all")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {r.doc_id for r in quality.judge(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect() if r.kept}
    stage = [(i, t) for i, t, *_ in docs if i in left]
    gone = brute.later_lines(stage, line_dedup.MIN_WORDS)
    stage = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ()))) for i, t in stage]
    stage = [(i, t) for i, t in stage if brute.words(t) or i not in gone]
    near = brute.near_components(stage, 80, 5)
    assert near != brute.near_components(stage) and any(near[i][1] != i for i in near)
    stage = [(i, t) for i, t in stage if near[i][1] == i]
    bad = {w[0] for w in brute.leaks(stage, items)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {i: plain.encode_ordinary(t) for i, t in stage if i not in bad}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and bad and len(want) < len(stage) < len(docs)


def test_rounds_give_the_drivers_heap_back(spark, monkeypatch):
    """Plans of many tasks let the driver's heap grow; each round of components gives it back, and no round runs without links."""
    from umbraline.llm import common, jaccard_join

    calls = []
    monkeypatch.setattr(common, "release", lambda s: calls.append("release"))
    chain = spark.createDataFrame([(k, k + 1) for k in range(12)], "a bigint, b bigint")
    assert {r.component for r in common.components(chain, "a", "b").collect()} == {0}
    assert len(calls) >= 2
    tried = []
    monkeypatch.setattr(jaccard_join, "components", lambda *a: tried.append(a) or common.components(*a))
    words = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, words), (2, words + " " + " ".join(f"x{k}" for k in range(14)))], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.join(docs).collect()} == {1: 1, 2: 2} and not tried
