"""License scan by ordered signature rules: DataFrame operations only.

Base: fixed phrases are looked for in the words of a text. The method adds detections line by line: a line that holds a
gate word is tried against the rules whose own keyword it holds; every match of a rule is an interval. A detection
inside the interval of one with higher priority is dropped, as is the longer-named rule's shorter rival at the same
place. What remains gives labels and a score.

The rules are built from families (label, keyword, name) and statement forms; the order of the forms is their priority.

Results for odd input: null text is empty: no words, no labels, score 0; lines and texts of any length are scanned whole; equal
rows give equal rows; an empty table gives an empty table; only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Fixed values of the base: phrase and label.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: label, keyword that a line must hold, name as a regular expression over lower-case text (no look-around).
FAMILIES = [
    ("cc-by-nc-nd", "nc", r"(cc|creative commons)[ -]by[ -]nc[ -]nd"),
    ("cc-by-nc-sa", "nc", r"(cc|creative commons)[ -]by[ -]nc[ -]sa"),
    ("cc-by-nc", "nc", r"(cc|creative commons)[ -]by[ -]nc"),
    ("cc-by-nd", "nd", r"(cc|creative commons)[ -]by[ -]nd"),
    ("cc-by-sa", "sa", r"(cc|creative commons)[ -]by[ -]sa"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution[ -]noncommercial"),
    ("cc-by-sa", "sharealike", r"creative commons attribution[ -]sharealike"),
    ("cc-by-nd", "noderiv", r"creative commons attribution[ -]noderivatives"),
    ("cc-by", "attribution", r"creative commons attribution"),
    ("cc-by", "by", r"(cc|creative commons)[ -]by"),
    ("cc0", "cc0", r"cc0([ -]1\.0)?"),
    ("public-domain", "public domain", r"public domain"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtf", r"(wtfpl|do what the fuck you want to public license)"),
    ("agpl-3.0", "affero", r"(gnu )?affero general public license"),
    ("agpl-3.0", "agpl", r"(gnu )?agpl([ -]?v?3(\.0)?)?"),
    ("lgpl", "lesser", r"(gnu )?lesser general public license"),
    ("lgpl", "library general", r"(gnu )?library general public license"),
    ("lgpl", "lgpl", r"(gnu )?lgpl([ -]?v?[23](\.[01])?)?"),
    ("gpl-3.0", "gpl", r"(gnu )?gpl[ -]?v?3(\.0)?"),
    ("gpl-2.0", "gpl", r"(gnu )?gpl[ -]?v?2(\.0)?"),
    ("gpl", "gpl", r"(gnu )?gpl"),
    ("gpl", "general public", r"(gnu )?general public license"),
    ("gfdl", "free documentation", r"(gnu )?free documentation license"),
    ("gfdl", "gfdl", r"(gnu )?gfdl([ -]?v?1\.[123])?"),
    ("apache-2.0", "apache", r"apache( software)?( license)?[, -]*(version |v)?2(\.0)?"),
    ("apache-1.1", "apache", r"apache( software)?( license)?[, -]*(version |v)?1\.1"),
    ("apache", "apache", r"apache( software)?"),
    ("mit", "mit", r"mit"),
    ("mit", "expat", r"expat"),
    ("x11", "x11", r"x11"),
    ("isc", "isc", r"isc"),
    ("bsd-4-clause", "bsd", r"((4|four)[ -]clause|original) bsd"),
    ("bsd-3-clause", "bsd", r"(((3|three)[ -]clause|new|modified|revised) bsd|bsd[ -]3([ -]clause)?)"),
    ("bsd-2-clause", "bsd", r"(((2|two)[ -]clause|simplified|freebsd) bsd|bsd[ -]2([ -]clause)?)"),
    ("bsd-0-clause", "bsd", r"((0|zero)[ -]clause bsd|0bsd)"),
    ("bsd", "bsd", r"bsd"),
    ("mpl-2.0", "mozilla", r"mozilla public license"),
    ("mpl-2.0", "mpl", r"mpl([ -]?v?2(\.0)?)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("epl", "epl", r"epl([ -]?v?[12](\.0)?)?"),
    ("cddl", "cddl", r"cddl"),
    ("cddl", "common development", r"common development and distribution license"),
    ("cpl", "common public", r"common public license"),
    ("eupl", "eupl", r"eupl([ -]?v?1\.[12])?"),
    ("eupl", "european union", r"european union public licen[cs]e"),
    ("artistic", "artistic", r"artistic( license)?([ -]?2(\.0)?)?"),
    ("zlib", "zlib", r"zlib(/libpng)?"),
    ("boost", "boost", r"boost software"),
    ("boost", "bsl", r"bsl[ -]?1(\.0)?"),
    ("ms-pl", "microsoft public", r"microsoft public license"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license"),
    ("odbl", "odbl", r"odbl([ -]?1(\.0)?)?"),
    ("odbl", "open database", r"open database license"),
    ("odc-by", "odc", r"odc[ -]by"),
    ("pddl", "pddl", r"pddl"),
    ("ogl-uk", "open government", r"open government licen[cs]e"),
    ("ofl", "open font", r"(sil )?open font license"),
    ("ofl", "ofl", r"ofl([ -]?1\.1)?"),
    ("psf", "python software", r"python software foundation"),
    ("ruby", "ruby", r"ruby"),
    ("php", "php", r"php"),
    ("vim", "vim", r"vim"),
    ("w3c", "w3c", r"w3c"),
    ("openssl", "openssl", r"openssl"),
    ("postgresql", "postgresql", r"postgresql"),
    ("sspl", "server side", r"server side public license"),
    ("elastic-2.0", "elastic", r"elastic license"),
    ("busl-1.1", "business source", r"business source license"),
    ("proprietary", "proprietary", r"(a )?proprietary"),
]

#: Statement forms in order of priority: gate word of the line, weight, form around the name.
FORMS = [
    ("spdx-", 1.0, r"spdx-license-identifier: *{}"),
    ("licens", 0.95, r"licen[cs]ed (to you )?under (the )?(terms of )?(the )?{}"),
    ("under ", 0.9, r"(released|distributed|published|available|provided|redistributed) under (the )?(terms of )?(the )?{}"),
    ("licen", 0.8, r"{} licen[cs]e"),
    ("licen", 0.7, r"licen[cs]e: *{}"),
]
GATES = sorted({gate for gate, _, _ in FORMS})
STOP = r"([^a-z0-9]|$)"


def build_rules() -> list[tuple[int, str, str, str, float, str]]:
    """(priority, gate, keyword, regular expression, weight, label): forms first, then the order of the families."""
    edge = r"(^|[^a-z0-9])"
    return [(n * len(FAMILIES) + k, gate, key, edge + form.replace("{}", name) + STOP, weight, label)
            for n, (gate, weight, form) in enumerate(FORMS) for k, (label, key, name) in enumerate(FAMILIES)]


def quoted(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else repr(text)


def rules_column() -> Column:
    """The rules as an array. A rule only looks at the character behind a match, as that may open the rule's next match."""
    return F.expr("array(" + ", ".join(
        f"named_struct('pri', {p}, 'gate', {quoted(g)}, 'key', {quoted(k)}, 'rx', {quoted(x.removesuffix(STOP) + '(?=' + STOP[1:])}, 'weight', {w}D, 'label', {quoted(lab)})"
        for p, g, k, x, w, lab in build_rules()) + ")")


def any_of(line: Column) -> Column:
    out = F.lit(False)
    for gate in GATES:
        out = out | F.contains(line, F.lit(gate))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    low = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    plain = low.select("id", "low", F.btrim(F.regexp_replace("low", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")).alias("plain"))
    padded = F.concat(F.lit(" "), F.col("plain"), F.lit(" "))
    hit = F.lit(False)
    for phrase, _ in PHRASES:
        hit = hit | F.contains(padded, F.lit(f" {phrase} "))
    looked = plain.select(
        "id", F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.when(hit, F.split("plain", " ")).alias("words"),
        F.when(any_of(F.col("low")), F.filter(F.split("low", "\n"), any_of)).alias("lines"))
    places = [f"""filter(sequence(0, size(words) - 1), i -> {' AND '.join(f"get(words, i + {k}) <=> '{w}'" for k, w in enumerate(phrase.split()))})""" for phrase, _ in PHRASES]
    looked = looked.select("id", "n_words", "lines", *(F.expr(f"CASE WHEN words IS NOT NULL THEN {p} ELSE CAST(array() AS array<int>) END").alias(f"p{n}") for n, p in enumerate(places)))
    # Detections of every gated line: rules whose gate and keyword the line holds, each match as an interval. A match starts
    # behind the earlier matches and the gaps before them.
    found = looked.select("*", F.when(F.size("lines") > 0, rules_column()).alias("rules")).select("*", F.expr("""
        CASE WHEN size(lines) > 0 THEN transform(lines, line ->
          flatten(transform(filter(transform(filter(rules, r -> contains(line, r.gate) AND contains(line, r.key)),
            r -> named_struct('r', r, 'hits', transform(regexp_extract_all(line, r.rx, 0), h -> length(h)))), m -> size(m.hits) > 0),
            m -> aggregate(zip_with(m.hits, transform(split(line, m.r.rx), g -> length(g)), (h, g) -> named_struct('hit', h, 'gap', g)),
              named_struct('at', 1, 'spans', CAST(array() AS array<struct<pri: int, label: string, weight: double, a: int, n: int>>)),
              (s, x) -> named_struct('at', s.at + x.gap + coalesce(x.hit, 0), 'spans', IF(x.hit IS NULL, s.spans, concat(s.spans, array(
                named_struct('pri', m.r.pri, 'label', m.r.label, 'weight', m.r.weight, 'a', s.at + x.gap, 'n', x.hit))))),
              s -> s.spans)))) END""").alias("found"))
    kept = found.select("*", F.expr("""
        coalesce(flatten(transform(found, f -> filter(f, d ->
          NOT exists(f, e -> e.pri < d.pri AND e.a <= d.a AND e.a + e.n >= d.a + d.n)))), array())""").alias("kept"))
    base = F.array_compact(F.array(*(F.when(F.size(f"p{n}") > 0, F.lit(label)) for n, (_, label) in enumerate(PHRASES))))
    every = F.concat(*(F.col(f"p{n}") for n in range(len(PHRASES))))
    return kept.select(
        F.col("id").alias(id_col), "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.expr("transform(kept, d -> d.label)")))), ",").alias("labels"),
        F.greatest(F.coalesce(F.expr("array_max(transform(kept, d -> d.weight))"), F.lit(0.0)), F.when(F.size(every) > 0, 0.5).otherwise(0.0)).alias("score"),
        F.size("kept").cast("long").alias("n_detections"))
