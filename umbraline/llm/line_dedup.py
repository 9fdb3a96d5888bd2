"""Line dedup over sequences of line ids: DataFrame operations only.

Lines get ids, and runs of 1, 2, 4, ... lines get ranks by distributed prefix doubling: the rank of a double run is the
pair of the ranks of its halves, named again. Ranks order runs by first occurrence; only their equality is used. Runs
that occur once drop out of every round, as nothing longer that starts with them can repeat.

The suffixes that share their lines up to a length form an interval of the suffix array whose longest common prefix
is at least that length. A repeated run of MIN_WORDS words or more is the union of its shortest such parts, counted from each of its
lines forwards and backwards. For every such part the interval is found (two overlapping ranks of a power of two
name a run of any length); all members but the earliest are later copies, and their lines are deleted. So
every line of every maximal repeated run of MIN_WORDS words goes from all copies but the first.

Earlier means a smaller id, then a smaller hash of the text where ids repeat, then a smaller line. Null ids come first.
Results for odd input: null text has no lines and stays null; empty lines are lines; a line or text of any length is taken whole; equal
rows (same id and text) are one document and all get its result; an empty table gives an empty table; other columns
are kept by `drop_repeats` whatever their names and not read by `report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, counted, release, text_key

MIN_WORDS = 30
KEY = ["k_id", "k_text"]


def n_words(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")))


def place() -> Column:
    return F.struct(*KEY, "n")


def repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k_id, k_text, n, words, name): lines that occur twice or more, each with the name of its class."""
    lines = docs.where(F.col(text_col).isNotNull()).select(*text_key(id_col, text_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "line"))
    lines = lines.select(*KEY, "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), n_words(F.col("line")).alias("words"))
    lines, _ = counted(lines.dropDuplicates([*KEY, "n"]))  # equal rows are one document
    return named(lines, ["h1", "h2"])


def named(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose `by` occurs at two places or more, with a number for each such class in place of `by`."""
    classes = rows.groupBy(*by).agg(F.min(place()).alias("first"), F.max(place()).alias("last")).where("first < last").drop("first", "last")
    classes, _ = counted(classes.withColumn("name", F.monotonically_increasing_id()))
    return rows.join(classes.withColumnsRenamed({c: f"c_{c}" for c in by}), [F.col(c) == F.col(f"c_{c}") for c in by]).drop(*by, *(f"c_{c}" for c in by))


def shortest_runs(lines: DataFrame, least: int) -> DataFrame:
    """(k_id, k_text, n, c): the shortest runs of repeated lines with that many words, from each line forwards and backwards."""
    from pyspark.sql import Window as W

    doc = W.partitionBy(*KEY).orderBy("n")
    islands = lines.select(*KEY, "n", "words", (F.col("n") - F.row_number().over(doc)).alias("island"))
    own = W.partitionBy(*KEY, "island").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    sums = islands.select(*KEY, "island", "n", "words", F.sum("words").over(own).alias("upto"))
    # One ordered pass each way: a line asks at a word count, lines answer at theirs.
    event = F.explode(F.array(
        F.struct(F.lit(True).alias("asks"), (F.col("upto") - F.col("words") + least).alias("ahead"), (F.col("upto") - least).alias("back")),
        F.struct(F.lit(False).alias("asks"), F.col("upto").alias("ahead"), (F.col("upto") - F.col("words")).alias("back"))))
    events = sums.select(*KEY, "island", "n", event.alias("e")).select(*KEY, "island", "n", "e.*")
    part = W.partitionBy(*KEY, "island")
    answers = events.select(
        *KEY, "n", "asks",
        F.min(F.when(~F.col("asks"), F.col("n"))).over(part.orderBy(F.desc("ahead")).rangeBetween(W.unboundedPreceding, W.currentRow)).alias("until"),
        F.max(F.when(~F.col("asks"), F.col("n"))).over(part.orderBy("back").rangeBetween(W.unboundedPreceding, W.currentRow)).alias("since")).where("asks")
    forwards = answers.where("until >= n").select(*KEY, "n", (F.col("until") - F.col("n") + 1).alias("c"))
    backwards = answers.where("since <= n").select(*KEY, F.col("since").alias("n"), (F.col("n") - F.col("since") + 1).alias("c"))
    return forwards.union(backwards).distinct()


def doubled(ranks: DataFrame, step: int) -> DataFrame:
    """Ranks of runs of 2 * step lines from ranks of runs of step lines."""
    later = ranks.select(F.col("k_id").alias("l_id"), F.col("k_text").alias("l_text"), (F.col("n") - step).alias("l_n"), F.col("name").alias("name_b"))
    pairs = ranks.join(later, ranks["k_id"].eqNullSafe(later["l_id"]) & (ranks["k_text"] == later["l_text"]) & (ranks["n"] == later["l_n"]))
    return named(pairs.select(*KEY, "n", F.col("name").alias("name_a"), "name_b"), ["name_a", "name_b"])


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(k_id, k_text, gone): the lines to delete as intervals, one row per document that has any."""
    lines, n = counted(repeated_lines(docs, id_col, text_col))
    runs, _ = counted(shortest_runs(lines, least))
    release(docs.sparkSession)
    longest = runs.agg(F.max("c")).first()[0] or 0
    ranks = lines.select(*KEY, "n", "name")
    every, step, level = ranks.withColumn("level", F.lit(0)), 1, 0
    while 2 * step <= longest and n:
        ranks, n = counted(doubled(ranks, step))
        step, level = 2 * step, level + 1
        every = every.unionByName(ranks.withColumn("level", F.lit(level)))
        release(docs.sparkSession)
    runs = runs.select("*", F.floor(F.log2("c")).cast("int").alias("level"))
    for end, start in (("a", F.col("n")), ("b", F.col("n") + F.col("c") - F.expr("shiftleft(1, level)"))):
        one = every.select(F.col("k_id").alias("e_id"), F.col("k_text").alias("e_text"), F.col("n").alias("e_n"), F.col("level").alias("e_level"), F.col("name").alias(f"rank_{end}"))
        asked = runs.withColumn("at", start)
        runs = asked.join(one, asked["k_id"].eqNullSafe(one["e_id"]) & (asked["k_text"] == one["e_text"]) & (asked["at"] == one["e_n"]) & (asked["level"] == one["e_level"]))
        runs = runs.drop("at", "e_id", "e_text", "e_n", "e_level")
    runs, _ = counted(runs)
    release(docs.sparkSession)
    own = ["c", "rank_a", "rank_b"]  # the lengths tell the levels apart
    first = runs.groupBy(*own).agg(F.min(place()).alias("first"), F.max(place()).alias("last")).where("first < last").drop("last")
    first, _ = counted(first.withColumnsRenamed({c: f"f_{c}" for c in own}))
    later = runs.join(first, [runs[c] == first[f"f_{c}"] for c in own]).where(F.col("first") < place())
    return merged(later)


def merged(runs: DataFrame) -> DataFrame:
    """(k_id, k_text, gone): the lines that runs (n, c) cover, as sorted intervals (start, end) that do not touch. Runs may lie
    in each other by the thousand (blank lines before a long one), so they are merged before anything is said per line."""
    from pyspark.sql import Window as W

    ends = runs.groupBy(*KEY, "n").agg((F.col("n") + F.max("c") - 1).alias("end"))
    doc = W.partitionBy(*KEY).orderBy("n")
    reach = F.max("end").over(doc.rowsBetween(W.unboundedPreceding, -1))
    fresh = ends.withColumn("fresh", F.when(reach.isNull() | (F.col("n") > reach + 1), 1).otherwise(0))
    islands = fresh.withColumn("island", F.sum("fresh").over(doc)).groupBy(*KEY, "island").agg(F.min("n").alias("start"), F.max("end").alias("end"))
    return islands.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone"))


def with_kept(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """docs as a struct `row`, with the kept text, the number of lines and of deleted lines. The join is by document."""
    gone = later_copies(docs, id_col, text_col, least).withColumnsRenamed({"k_id": "g_id", "k_text": "g_text"})
    id_key, hashed = text_key(id_col, text_col)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), id_key.alias("k_id"), hashed.alias("k_text"), F.col(text_col).alias("whole"))
    joined = rows.join(gone, rows["k_id"].eqNullSafe(gone["g_id"]) & (rows["k_text"] == gone["g_text"]), "left")
    # What stays lies before, between and behind the intervals; slices keep this linear in lines.
    kept = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.expr("""array_join(flatten(transform(sequence(0, size(gone)), j -> slice(parts,
        if(j = 0, 0, gone[greatest(j - 1, 0)].end + 1) + 1,
        if(j = size(gone), size(parts), gone[least(j, size(gone) - 1)].start) - if(j = 0, 0, gone[greatest(j - 1, 0)].end + 1)))), '\n')"""))
    joined = joined.withColumn("parts", F.split("whole", "\n"))
    total = F.when(F.col("whole").isNull(), 0).otherwise(F.size("parts"))
    removed = F.aggregate("gone", F.lit(0), lambda s, g: s + g["end"] - g["start"] + 1)
    return joined.select("row", kept.alias("kept_text"), total.cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """id, n_lines, n_removed, and the digest of the kept text (null text: empty)."""
    own = with_kept(docs.select(id_col, text_col), id_col, text_col, least)
    return own.select(F.col("row")[id_col].alias(id_col), "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, count_col: str = "n_chars") -> DataFrame:
    """The documents without the lines of later copies; one that loses its last word goes. A count column follows the text."""
    own = with_kept(docs, id_col, text_col, least).where((F.col("n_removed") == 0) | (F.length(F.btrim("kept_text", F.lit(SPACES))) > 0))
    changed = F.col("n_removed") > 0
    new = {text_col: F.col("kept_text")}
    if count_col in docs.columns:
        kind = docs.schema[count_col].dataType
        new[count_col] = F.when(changed, F.length("kept_text").cast(kind)).otherwise(F.col("row")[count_col])
    return own.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
