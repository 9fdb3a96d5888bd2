"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled documents of good quality; everything without a label is unlabelled web text; bad labels
are not used. The model minimises the non-negative unbiased risk: with class prior p,
    p * R_p(+) + max(0, R_u(-) - p * R_p(-)),
whose second part is turned back when it falls below zero, so a flexible model cannot make it negative by overfitting.
The prior is estimated first: a model that tells positives from unlabelled text ranks all documents, and the share of
unlabelled text above a threshold, over that of positives above it, is smallest where only positives are left
(best-bin estimate with its confidence terms). Rows are dealt into two halves, and each half is ranked by the model of the
other, as a model ranks the positives it has seen above their like among the unlabelled.

A text is described by SIZE numbers about its form (bytes by kind, repetition, words, lines); no label, language, source or
id is among them. Their means and deviations, and the ranking behind the prior, take in all documents; only the fit runs on a
bounded sample: MOST_POSITIVE and MOST_UNLABELLED rows, those with the least hash of id and form, so the sample is stable.
The fit is deterministic; tasks score their rows with the fitted weights.

Documents whose crc32 of the id, modulo 5, is 0 are held out: neither their labels nor their texts enter the fit.

Results for odd input: null and empty texts have the form of an empty text and a score; a null id counts as the empty string
for the fold; rows that repeat each get a row; several labels of one id are positive where one of them is; without
positives or without unlabelled text nothing can be learnt and every score is 0.5; where a half has none of either, the
prior is 0.5; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, raw_bytes, sliced, stored, strings

FOLDS = 5
THRESHOLD = 0.3
MOST_POSITIVE = 10_000      # rows of the fit
MOST_UNLABELLED = 30_000
BINS = 500                  # of the ranking behind the prior
SLICE = 4_000_000           # bytes of text described at once
HIDDEN, STEPS, RATE, DECAY = 16, 400, 0.02, 1e-4

#: Kinds of bytes that are counted.
KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?", "#*$%&", "|<>", "\"'-:;()"]
SIZE = len(KINDS) + 1 + 10
_KIND = np.full(256, len(KINDS), np.uint8)
for _k, _chars in enumerate(KINDS):
    _KIND[list(_chars.encode())] = _k


def form(text: str, kinds: np.ndarray) -> list[float]:
    """Numbers about the form of a text, from it and the kinds of its bytes."""
    n = max(len(kinds), 1)
    shares = np.bincount(kinds, minlength=len(KINDS) + 1) / n
    words = text.split()
    many = max(len(words), 1)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = text.split("\n")
    return [
        *shares, math.log1p(len(words)), math.log1p(n / many), len(seen) / many, len(seen) / math.sqrt(many), max(seen.values(), default=0) / many,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / many, pairs / many, sum(w.isupper() and len(w) > 1 for w in words) / many,
        math.log1p(many / len(lines)), len(set(lines)) / len(lines)]


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, held_out, form): one row per document."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in sliced(batch, 2, SLICE):
            data, ends = raw_bytes(part.column(2))
            kinds = _KIND[data]
            rows = [form(t, kinds[a:b]) for t, a, b in zip(strings(part.column(2)), ends[:-1], ends[1:], strict=True)]
            flat = pa.array(np.array(rows, np.float32).reshape(-1))
            forms = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * SIZE), flat)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), forms], names=["id", "held_out", "form"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")),
                     f"id {kind}, held_out boolean, form array<float>", run)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == 0


@dataclass
class Net:
    """One hidden layer over forms brought to mean 0 and deviation 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def inputs(self, forms: np.ndarray) -> np.ndarray:
        return np.clip((forms - self.mean) / self.scale, -8, 8)

    def margin(self, forms: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(self.inputs(forms) @ w1 + b1) @ w2 + b2[0]

    def score(self, forms: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(forms))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def fit(mean: np.ndarray, scale: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Net:
    """Minimise the non-negative risk under the prior; without one, tell positives from unlabelled text (both weigh a half)."""
    rng = np.random.default_rng(7)
    net = Net(mean, scale, [rng.normal(0, 1 / math.sqrt(SIZE), (SIZE, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)])
    x = net.inputs(np.concatenate([positive, unlabelled]))
    is_p = np.arange(len(x)) < len(positive)
    n_p, n_u = len(positive), len(unlabelled)
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for step in range(1, STEPS + 1):
        w1, b1, w2, b2 = net.weights
        hidden = np.tanh(x @ w1 + b1)
        z = hidden @ w2 + b2[0]
        up, down = sigmoid(z) - 1, sigmoid(z)   # slopes of the loss as positive and as negative
        if prior is None:
            slope = np.where(is_p, 0.5 * up / n_p, 0.5 * down / n_u)
        else:
            negative_risk = softplus(z[~is_p]).mean() - prior * softplus(z[is_p]).mean()
            back = 1.0 if negative_risk >= 0 else -1.0
            slope = np.where(is_p, ((prior * up if back > 0 else 0) - back * prior * down) / n_p, back * down / n_u)
        inner = slope[:, None] * w2 * (1 - hidden ** 2)
        slopes = [x.T @ inner + DECAY * w1, inner.sum(0), hidden.T @ slope + DECAY * w2, np.array([slope.sum()])]
        for k, g in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.weights[k] = net.weights[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from two histograms over the same rising score bins: the share of unlabelled text above a bin, over the
    share of positives above it, where the ratio with its confidence terms is smallest."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    above_p, above_u = np.cumsum(positive[::-1])[::-1] / n_p, np.cumsum(unlabelled[::-1])[::-1] / n_u
    doubt = math.sqrt(math.log(40) / (2 * n_p)) + math.sqrt(math.log(40) / (2 * n_u))
    usable = above_p > 0
    bound = np.where(usable, (above_u + doubt) / np.where(usable, above_p, 1), np.inf)
    at = int(np.argmin(bound))
    return float(np.clip(above_u[at] / above_p[at], 0.01, 0.99))


def scored(forms: DataFrame, net: Net) -> DataFrame:
    """forms with a column score in place of the form."""
    names = [c for c in forms.columns if c != "form"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in forms.schema.fields if f.name != "form"), "score double"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(batch.schema.get_field_index("form")).flatten().to_numpy().reshape(-1, SIZE).astype(np.float64)
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(net.score(rows))], names=[*names, "score"])

    return map_arrow(forms, schema, run)


def matrix(df: DataFrame, most: int) -> np.ndarray:
    """Forms of at most `most` rows, those of the least hash; the bound keeps the driver's share fixed."""
    rows = df.select("form", F.xxhash64("id", "form").alias("h")).orderBy("h").limit(most).select("form").collect()
    return np.array([r.form for r in rows], np.float64).reshape(-1, SIZE)


def histogram(scores: DataFrame) -> np.ndarray:
    out = np.zeros(BINS)
    for r in scores.groupBy(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")).count().collect():  # BINS rows at most
        out[r["bin"]] = r["count"]
    return out


def train(forms: DataFrame, labels: DataFrame) -> tuple[Net | None, float | None]:
    """The fitted model and the prior from stored forms; (None, None) where there is nothing to learn from."""
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"))
    open_rows = forms.where("NOT held_out")
    half = F.pmod(F.xxhash64(F.lit(1), "id", "form"), F.lit(2)).cast("int")
    joined = stored(open_rows.join(marks, open_rows["id"] == marks["label_id"], "left").select("id", "form", "label_id", "good", half.alias("half")), "pu-rows")
    positive, unlabelled = joined.where("good = 1"), joined.where("label_id IS NULL")
    halves = [[matrix(rows.where(F.col("half") == k), most // 2) for rows, most in ((positive, MOST_POSITIVE), (unlabelled, MOST_UNLABELLED))] for k in (0, 1)]
    p, u = (np.concatenate([h[k] for h in halves]) for k in (0, 1))
    if not len(p) or not len(u):
        return None, None
    stats = forms.select(*(F.get("form", F.lit(k)).cast("double").alias(f"f{k}") for k in range(SIZE))).agg(
        *(F.avg(f"f{k}") for k in range(SIZE)), *(F.stddev_pop(f"f{k}") for k in range(SIZE))).first()
    mean, spread = np.array(stats[:SIZE], float), np.array(stats[SIZE:], float)
    scale = np.where(spread > 1e-9, spread, 1.0)
    if all(len(x) for h in halves for x in h):
        ranked = [[histogram(scored(rows.where(F.col("half") == k).select("form"), fit(mean, scale, *halves[1 - k], None))) for rows in (positive, unlabelled)]
                  for k in (0, 1)]
        prior = best_bin_prior(ranked[0][0] + ranked[1][0], ranked[0][1] + ranked[1][1])
    else:
        prior = 0.5
    return fit(mean, scale, p, u, prior), prior


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    forms = stored(describe(docs, id_col, text_col), "pu-forms")
    net, _ = train(forms, labels)
    out = forms.select("id", "held_out", F.lit(0.5).alias("score")) if net is None else scored(forms, net)
    return out.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
