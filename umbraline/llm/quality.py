"""Quality rules with verdicts per host: DataFrame operations only.

Every document is measured; hard rules reject it alone. Softer rules are counted per host (the `source` of a document):
the share of failing documents is shrunk towards all hosts by a beta prior fitted to the hosts' shares (method of
moments), so that a host of three documents is not judged by three documents. Where most of a host's documents break a
soft rule, its documents that break that rule are rejected as well; elsewhere a soft rule rejects nothing.

Results for odd input: null text has no words and fails; a document without a host is judged alone; texts are measured whole;
rows with equal ids are judged one by one, equal rows get equal results; an empty table gives an empty table; other
columns are kept by `keep` and not read by `judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bounded_broadcast, counted, text_key

MIN_WORDS = 20          # hard: fewer words fail
REPEAT_PERCENT = 30     # hard: more words in repeated windows fail
WINDOW = 8              # words of a window
SOFT = ("symbols", "lines", "lengths")
BAD_SHARE = 0.5         # shrunk share of failing documents from which a host is bad
MOST_PRIOR = 10_000.0   # weight of the prior, in documents, when all hosts are alike
BROADCAST_HOSTS = 100_000


def repeated_words(words: str) -> Column:
    """Words covered by windows that occur twice or more, from an array of words. Exact: windows are compared as text."""
    return F.expr(f"""
        aggregate(
          array_sort(transform(
            filter(sequence(0, size(windows) - 1), k -> get(windows, k).w = get(windows, k - 1).w OR get(windows, k).w = get(windows, k + 1).w),
            k -> get(windows, k).i)),
          named_struct('total', 0L, 'until', 0L),
          (a, i) -> named_struct('total', a.total + i + {WINDOW} - greatest(CAST(i AS BIGINT), a.until), 'until', CAST(i + {WINDOW} AS BIGINT)),
          a -> a.total)""")


def measure(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """The columns of `keep`, then n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    names = [f"kept_{n}" for n in range(len(keep))]
    first = docs.select(
        *(c.alias(n) for c, n in zip(keep, names, strict=True)),
        F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")).alias("words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"))
    hashed = first.select(
        *names, "words", "n_symbols", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    parts = ", ".join(f"get(h, i + {k})" for k in range(WINDOW))
    # Different hashes prove different windows; only texts with an equal pair of hashes are compared window by window.
    looked = hashed.select("*", F.expr(f"CASE WHEN size(h) > {WINDOW} THEN transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({parts})) END").alias("rolled"))
    looked = looked.drop("h").select("*", (F.col("rolled").isNotNull() & (F.size(F.array_distinct("rolled")) < F.size("rolled"))).alias("again")).drop("rolled")
    looked = looked.select("*", F.expr(f"""
        CASE WHEN again THEN array_sort(transform(sequence(0, size(words) - {WINDOW}),
          i -> named_struct('w', array_join(slice(words, i + 1, {WINDOW}), ' '), 'i', i))) END""").alias("windows")).drop("words")
    return looked.select(
        *(F.col(n) for n in names), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
        F.when(F.col("again"), repeated_words("windows")).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def soft_failed() -> dict[str, Column]:
    """More than a symbol to ten words; more than three tenths of the lines repeat; words of under 2 or over 15 code points on average."""
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "lengths": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))}


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(host, bad_<rule> ...) of the hosts that are bad by some rule. measured has host and soft_<rule>."""
    hosts, n = counted(measured.where("host IS NOT NULL").groupBy("host").agg(
        F.count("*").alias("n"), *(F.count_if(F.col(f"soft_{r}")).alias(f"n_{r}") for r in SOFT)))
    shares = hosts.agg(*(x for r in SOFT for x in (
        F.avg(F.col(f"n_{r}") / F.col("n")).alias(f"mean_{r}"), F.var_pop(F.col(f"n_{r}") / F.col("n")).alias(f"var_{r}")))).first()
    bad = {}
    for r in SOFT:
        mean, var = (shares[f"mean_{r}"] or 0.0), (shares[f"var_{r}"] or 0.0)
        weight = MOST_PRIOR if var * (MOST_PRIOR + 1) <= mean * (1 - mean) else mean * (1 - mean) / var - 1
        weight = max(weight, 0.0)
        shrunk = (F.col(f"n_{r}") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        bad[f"bad_{r}"] = F.round(shrunk, 9) > BAD_SHARE
    return hosts.select("host", *(c.alias(k) for k, c in bad.items())).where(" OR ".join(bad))


def verdicts(docs: DataFrame, text_col: str, host_col: str, keep: list[Column]) -> DataFrame:
    """The columns of `keep` under their names, the measures, base_failed and kept."""
    names = [docs.select(c).columns[0] for c in keep]
    measured = measure(docs, text_col, [*keep, F.col(host_col).cast("string")])
    measured = measured.withColumnsRenamed({f"kept_{len(keep)}": "host"})
    measured = measured.select("*", base_failed().alias("base_failed"), *(c.alias(f"soft_{r}") for r, c in soft_failed().items()))
    measured, _ = counted(measured)
    bad, n = counted(host_verdicts(measured))
    bad = bad.withColumnRenamed("host", "bad_host")
    joined = measured.join(bounded_broadcast(bad, n, BROADCAST_HOSTS), measured["host"] == bad["bad_host"], "left")
    caught = " OR ".join(f"(soft_{r} AND coalesce(bad_{r}, false))" for r in SOFT)
    return joined.select(
        *(F.col(f"kept_{n}").alias(name) for n, name in enumerate(names)),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr(f"NOT base_failed AND NOT ({caught})").alias("kept"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    return verdicts(docs, text_col, host_col, [F.col(id_col)])


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    rejected = verdicts(docs, text_col, host_col, text_key(id_col, text_col)).where("NOT kept").select(F.col("k_id").alias("r_id"), F.col("k_text").alias("r_text")).distinct()
    id_key, hashed = text_key(id_col, text_col)
    return docs.join(rejected, id_key.eqNullSafe(rejected["r_id"]) & hashed.eqNullSafe(rejected["r_text"]), "left_anti")
