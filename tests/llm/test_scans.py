"""Secret scan, quality rules, license scan, URL filter, archives and tokens against plain versions and on odd input."""

import base64
import hashlib
import json

import brute
import numpy as np
import public_tokenizers
import pytest

from umbraline.llm import bpe, licenses, quality, secret_scan, url_filter, warc
from umbraline.llm.queries import URL_RULES

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def by_id(rows):
    return {r[0]: tuple(r[1:]) for r in rows}


def test_base_secrets_equal_the_plain_patterns(odd_docs, no_docs, texts):
    rows = secret_scan.scan(odd_docs).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        text = texts[6 if r.doc_id is None else r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute.base_secrets(text)
    assert secret_scan.scan(no_docs).collect() == []


def test_structure_confirms_keys_and_tokens():
    def der(tag, body):
        size = len(body)
        head = bytes([size]) if size < 128 else bytes([0x81, size]) if size < 256 else bytes([0x82, size >> 8, size & 255])
        return bytes([tag]) + head + body

    number = der(2, bytes(range(1, 40)))
    key = der(0x30, der(2, b"\0") + number * 8)
    assert secret_scan.is_key_structure(key) and not secret_scan.is_key_structure(key[:-1]) and not secret_scan.is_key_structure(key + b"\0")
    armour = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END RSA PRIVATE KEY-----"
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = part({"alg": "HS256", "typ": "JWT"}) + "." + part({"sub": "someone"}) + "." + "A" * 43
    text = f"é {armour} and {token} and {key.hex()} and {base64.b64encode(b'just some plain words that are no key at all, for sure').decode()}"
    spans = secret_scan.structural_spans(text)
    assert [s[0] for s in sorted(spans, key=lambda s: s[1])] == ["armoured_key", "signed_token", "encoded_key"]
    assert text[spans[0][1]:spans[0][2]] == armour
    wire = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-rsa", b"\1\0\1", bytes(64)))
    assert secret_scan.confirmed(wire) == "wire_key" and secret_scan.confirmed(wire[:-1]) is None
    assert not secret_scan.is_signed_token(part({"typ": "JWT"}), part({}), "A" * 20)


def quality_by_hand(text):
    words = brute.words(text, lower=False)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3_000 else set()
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(8)}
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_host_verdicts(spark, odd_docs, no_docs, texts):
    rows = quality.judge(odd_docs).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        want = quality_by_hand(texts[6 if r.doc_id is None else r.doc_id])
        assert tuple(r[1:6]) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.judge(no_docs).collect() == []
    kept = quality.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert quality.keep(no_docs).collect() == []
    # A host whose documents mostly break a soft rule loses those; the same text stays at a good host.
    noisy = " ".join(f"w{i} #" for i in range(40))
    clean = " ".join(f"w{i}" for i in range(40))
    docs = [(i, f"{noisy} a{i}", "bad") for i in range(30)] + [(100, f"{clean} z", "bad")] + [(200 + i, f"{clean} b{i}", "good") for i in range(60)] + [(300, noisy, "good"), (301, noisy, None)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()}
    assert not any(kept[i] for i in range(30)) and all(v for k, v in kept.items() if k >= 100)


def test_license_labels(odd_docs, no_docs, texts):
    rows = {r.doc_id: r for r in licenses.scan(odd_docs).collect()}
    at = {t: i for i, t in enumerate(texts) if t and ("icense" in t or "reserved" in t)}
    got = [rows[at[t]] for t in sorted(at, key=at.get)]
    assert [(r.base_labels, r.labels) for r in got] == [("cc-by,reserved", "cc-by,cc-by-nc,reserved"), ("cc-by", "cc-by,mit"), ("gpl", "apache-2.0,gpl")]
    assert [(r.n_base, r.first_word, r.last_word, r.score) for r in got] == [(2, 2, 7, 0.95), (1, 5, 5, 0.9), (1, 6, 6, 1.0)]
    assert (rows[0].n_words, rows[0].n_base, rows[0].first_word, rows[0].labels, rows[0].score) == (0, 0, None, "", 0.0)
    assert licenses.scan(no_docs).collect() == []
    assert len(licenses.build_rules()) > 200


def test_every_match_of_a_license_rule_counts(spark):
    """A first match inside a longer rule's interval hides no later one; one blank may end a match and open the next."""
    lines = ["images licensed under cc-by-nc-sa, text licensed under cc-by-nc.", "MIT license MIT license mit licensed", "licensed under mit or licensed under mit2, licensed under (mit)", "license: mit license: mit",
             "licensed under mitx, licensed under mit. " * 50]
    got = {r.doc_id: (r.labels, r.score, r.n_detections) for r in licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()}
    assert got == {0: ("cc-by,cc-by-nc,cc-by-nc-sa", 0.95, 2), 1: ("mit", 0.8, 2), 2: ("mit", 0.95, 1), 3: ("mit", 0.8, 3), 4: ("mit", 0.95, 50)}


def test_urls_follow_rules_then_globs(spark):
    urls = ["https://a.ORG/x", "http://org", "http://org?x/", "http://www.example.org/es/1", "http://example.org/en/12?q", "http://b.com/fr/1", "http://com/de/", "http://x.net/login/a", "http://x.net/a",
            "notaurl", None, "", "http://ads.x.net/b", "http://x.net/a?sid=1#f", "http://evilorg/x", "http://org.net/é" + "y" * 5_000, "http://x.net/" + "z" * 200 + ".exe"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), URL_RULES).collect()}
    verdicts = [(got[i].rule, got[i].verdict) for i in range(len(urls))]
    assert verdicts == [
        ("org/", "allow"), (None, "allow"), (None, "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "block"), (None, "allow"),
        (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "block")]
    assert (got[0].host, got[0].path, got[9].host, got[10].path) == ("a.org", "/x", "", "")
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string"), URL_RULES).collect() == []


def test_automaton_equals_regular_expressions():
    import re

    globs = url_filter.BLOCK_GLOBS + ["", "**", "*", "a*b**c", "*.x/**"]
    texts = ["", "a", "abc", "axxb/c", "a/b", "q.x/1", "x/1", "ads.a/b/login", "casino.net", "é.x/", "foo.exe", "a.b/c?d=1&sid=2"]
    raw = [t.encode() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    fits = url_filter.GlobAutomaton(globs).accepts(np.frombuffer(b"".join(raw), np.uint8), ends)
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert fits[i, j] == bool(re.match(url_filter.glob_regex(g).replace(r"\z", r"\Z"), t)), (t, g)


def test_archives_come_back(spark, tmp_path):
    page = "<p>" + "long enough to be a revisit " * 8 + "</p>"
    rows = [(3, "http://a", page), (1, "http://b\r\nX: y", page), (2, None, page), (4, "http://c", "short"), (5, "http://d", "short"), (6, "http://e", None), (7, "http://é/ü", ""), (1, "http://b", page),
            (None, "http://n", page), (8, "u", "é" * 60), (9, "u", "é" * 49), (10, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    warc.write_archives(warc.plan_records(pages), str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        body = next((h or "").encode() for p, _, h in rows if p == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        again = body == page.encode() and r.page_id != 1
        assert (r.record_type, r.refers_to, bytes(r.payload)) == (("revisit", 1, b"") if again else ("response", None, body))
    assert warc.round_trip(pages.limit(0), str(tmp_path / "none")).collect() == []


def test_damaged_archives_are_refused():
    raw = [warc.record(i, "u", "response", None, b"body%d" % i, 5, hashlib.sha256(b"body%d" % i).hexdigest()) for i in range(3)]
    whole = warc.SEPARATOR.join(warc.frames(iter(raw)))
    assert [r["payload"] for r in warc.read_archive(whole)] == [b"body0", b"body1", b"body2"]
    for bad in (whole[8:], whole[:-3], whole[:6], whole + b"xx"):
        with pytest.raises(warc.DamagedArchive):
            list(warc.read_archive(bad))
    for bad in (raw[0].replace(b"WARC/1.1", b"WARC/9"), raw[0].replace(b"Content-Length: 5", b"Content-Length: 6"), raw[0].replace(b"body0", b"bodyX"), raw[0].replace(b"WARC-Type", b"Warc-Kind")):
        with pytest.raises(warc.DamagedArchive):
            warc.parse_record(bad)


def plain_offsets(plain, text, ids):
    """Starts and ends in code points from the bytes of the tokens, as 32-bit numbers."""
    char_of = [n for n, c in enumerate(text) for _ in c.encode()]
    ends = np.cumsum([len(plain.decode_single_token_bytes(i)) for i in ids], dtype=int)
    starts = [char_of[e - len(plain.decode_single_token_bytes(i))] for e, i in zip(ends, ids, strict=True)]
    return np.array([*starts, *(char_of[e - 1] + 1 for e in ends)], "<i4").tobytes()


def test_tokens_equal_the_rank_file(odd_docs, no_docs, texts):
    import tiktoken

    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for r in bpe.digests(odd_docs, RANKS, PATTERN, with_ids=True).collect():
        text = texts[6 if r.doc_id is None else r.doc_id] or ""
        ids = plain.encode_ordinary(text)
        assert (r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) == (len(ids), ids, brute.sha(" ".join(map(str, ids))), brute.sha(text))
        assert r.offsets_sha256 == brute.sha(plain_offsets(plain, text, ids))
    assert bpe.digests(no_docs, RANKS, PATTERN).collect() == []


def test_offsets_and_decoding(spark, odd_docs):
    coded = bpe.encode(odd_docs.where("length(text) < 2000"), RANKS, PATTERN)
    for r in bpe.decode(coded, RANKS, PATTERN, "bpe_ids").collect():
        assert r.decoded == r.text and len(r.bpe_ids) == len(r.bpe_starts) == len(r.bpe_ends)
        assert not r.text or (r.bpe_starts[0] == 0 and r.bpe_ends[-1] == len(r.text))
    cut = spark.createDataFrame([([8582],), (None,), ([],)], "ids array<int>")
    assert {r.decoded for r in bpe.decode(cut, RANKS, PATTERN).collect()} == {"�", None, ""}
