"""Quality by Bradley-Terry ranking of document pairs.

A document's score is a weighted sum of its features; the chance that one document is preferred to
another is the logistic function of the difference of their scores, so the weights are learned by
logistic loss on the differences of the features of preference pairs. A labelled document of good
quality that is not toxic is preferred to every other labelled one. The corpus is cut at a score
quantile: the LOSS quantile of the preferred documents that the model was not fitted on, or, if a
quantile is given, that of all documents.

Features: which words of the training documents occur, however rare, and a few figures of style. A word's feature is
the smaller, and so its weight shrinks the more, the less its share of preferred documents tells it from chance: no word
is left out for being rare, as those of a small language all are. The model is fitted on at most MAX_LABELLED labelled documents (those with the
least hash of their id), and on at most three quarters of them; scores and quantiles are of all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import materialize, quoted, text_batches

MAX_LABELLED = 8000
LOSS = 0.01  # share of the preferred documents that falls below the threshold
PAIRS = 60_000
MAX_SHARE = 0.1  # of the training documents; commoner words only tell how long a text is
SIGMAS = 3.5  # by which a word's share of preferred documents differs from that of all where it counts in full
SHRINK = 12  # a word at half as many sigmas is a feature of 2**-SHRINK
ROUNDS = 400
RATE = 0.05
DECAY = 1e-4
SEED = 7

_WORD = re.compile(r"[^\W\d_]+")
N_STYLE = 8


def style(text: str, words: list[str], distinct: int) -> list[float]:
    """Figures of a text that do not depend on its length: shares of upper case, digits, punctuation and
    white space, mean word length, share of distinct words, share of words joined to symbols, lines."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(raw), 1)
    count = np.bincount(raw, minlength=256)
    digits = int(count[48:58].sum())
    upper = int(count[65:91].sum())
    space = int(count[:33].sum())
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    stops = int(count[44] + count[46])  # commas and full stops are ordinary
    k = max(len(words), 1)
    # distinct words of a text grow with the square root of its length, about
    return [upper / n, digits / n, (marks - stops) / n, space / n, sum(map(len, words)) / k / 10, distinct / (k**0.5 * 10), distinct / k, int(count[10]) / n * 10]


def features(text: str | None) -> tuple[set[str], list[float]]:
    """(words that occur, style) of a text; a null text counts as an empty one."""
    text = text or ""
    words = _WORD.findall(text.lower())
    found = set(words)
    return found, style(text, words, len(found))


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        found, figures = features(text)
        get = self.words.get
        by_word = sum(w for w in map(get, found) if w is not None)
        return by_word + float(((np.array(figures) - self.mean) / self.scale).clip(-6, 6) @ self.weights)


def fit(words: pa.ListArray, figures: np.ndarray, good: np.ndarray, pairs: int = PAIRS, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """The model of labelled documents: their words and figures, and whether each is preferred. Without
    both kinds there are no pairs, and every score is 0."""
    coded = pc.dictionary_encode(words.values if words.offset == 0 else words.flatten())
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    n = np.bincount(index, minlength=len(coded.dictionary))
    liked = np.bincount(index[good[doc]], minlength=len(coded.dictionary))
    p = good.mean() if len(good) else 0.0
    apart = np.abs(liked - n * p)
    # words that preferred and other documents have in the very same share say nothing
    often = (n <= MAX_SHARE * len(words)) & (apart > 1e-9 * n)
    size = np.minimum(1.0, apart / np.sqrt(np.maximum(n * p * (1 - p), 1e-9)) / SIGMAS)[often] ** SHRINK
    number = np.cumsum(often) - 1
    use = often[index]
    index, doc = number[index[use]], doc[use]
    vocabulary = coded.dictionary.filter(pa.array(often)).to_pylist()
    mean, scale = figures.mean(0) if len(figures) else np.zeros(N_STYLE), figures.std(0) + 1e-6 if len(figures) else np.ones(N_STYLE)
    x = ((figures - mean) / scale).clip(-6, 6)
    w, v = np.zeros(len(vocabulary)), np.zeros(N_STYLE)
    yes, no = np.flatnonzero(good), np.flatnonzero(~good)
    if len(yes) and len(no):
        rng = np.random.default_rng(seed)
        a, b = rng.choice(yes, pairs), rng.choice(no, pairs)
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
        for t in range(1, rounds + 1):
            score = np.bincount(doc, weights=(w * size)[index], minlength=len(words)) + x @ v
            push = 1 / (1 + np.exp(np.clip(score[a] - score[b], -40, 40))) / pairs
            by_doc = np.bincount(a, push, len(words)) - np.bincount(b, push, len(words))
            for theta, grad, m, s in ((w, size * np.bincount(index, weights=by_doc[doc], minlength=len(w)), moments[0], moments[1]), (v, by_doc @ x, moments[2], moments[3])):
                grad = grad - DECAY * theta
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                theta += RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return Model(dict(zip(vocabulary, (w * size).tolist())), mean, scale, v)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(0)]
        words = pa.array([sorted(r[0]) for r in rows], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([words, pa.array([r[1] for r in rows], pa.list_(pa.float64())), batch.column(1)], ["words", "figures", "good"])


def preferences(labels: DataFrame) -> DataFrame:
    """(doc_id, good), a row a labelled document: of several labels the worst counts. Labels without an
    id or a quality are left out; a null toxic is 0."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good).alias("good"))


def train(docs: DataFrame, chosen: DataFrame) -> Model:
    """Fit on the documents of chosen(doc_id, good), of which there are at most MAX_LABELLED, say."""
    rows = docs.select("doc_id", quoted("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "good")
    # the driver gets the features of a bounded number of documents
    got = rows.mapInArrow(_extracted, "words array<string>, figures array<double>, good boolean").toArrow()
    words = pa.concat_arrays([c.cast(pa.list_(pa.string())) for c in got["words"].chunks]) if got.num_rows else pa.array([], pa.list_(pa.string()))
    figures = np.array(got["figures"].to_pylist(), float).reshape(-1, N_STYLE)
    return fit(words, figures, np.array(got["good"].to_pylist(), bool))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        score = sent.value.score
        return pa.array([score(t.as_py()) for t in texts], pa.float64())

    return docs.select("doc_id", F.arrow_udf(run, "double")(quoted("text")).alias("score"))


def keep_best(docs: DataFrame, labels: DataFrame, quantile: float | None = None, max_labelled: int = MAX_LABELLED, loss: float = LOSS) -> DataFrame:
    """(doc_id, score) of the rows of docs whose score is not below the threshold.

    A null text counts as an empty one and is scored like any; repeated rows have equal scores, and rows
    at the threshold stay. Labels of documents that docs lacks are not used. Without labels of both
    kinds all scores are 0 and all rows stay; an empty table gives an empty one. Extra columns are not
    read.
    """
    text_batches(docs.sparkSession)
    preferred = materialize(preferences(labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")), "preferred")
    n = min(max_labelled, -(-3 * preferred.count() // 4))
    chosen = materialize(preferred.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n), "chosen")
    scores = materialize(scored(docs, train(docs, chosen)), "scores")
    if quantile is None:
        held = preferred.where("good").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
        at = scores.join(held, "doc_id").agg(F.percentile_approx("score", float(loss), 100_000)).first()[0]
    else:
        at = scores.agg(F.percentile_approx("score", float(quantile), 100_000)).first()[0]
    return scores.where(F.col("score") >= F.lit(at)) if at is not None else scores
