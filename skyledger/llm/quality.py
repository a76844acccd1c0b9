"""Quality classifier from weak labels.

Overlapping heuristic labellers vote *good*, *junk* or abstain on each text.  Expectation-maximisation
(Dawid and Skene's one-coin model) estimates each labeller's accuracy from their overlaps,
without any true label.  The posteriors of a bounded sample then train a linear scorer
over hashed word shapes, which decides for every text.

One pass over the texts gives each document's votes and shape counts, a small table; everything
after works on that.  EM runs on the counts of vote patterns (at most 3 to the number of
labellers).

Defined cases: null and empty texts are rejected with score 0; texts of a few words get votes only from
labellers that can judge them; repeated rows each get a row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import operator
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, docs_only, map_rows, slices, written

DIMENSIONS = 1024
GOOD, JUNK, ABSTAIN = 2, 1, 0
SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\[\]…-]{2,}|[!?]{2,}|[|]")
#: Detectors of one kind of junk each come in overlapping pairs; three vote for good text.
LABELLERS = ("symbols", "marks", "capitals", "shouting", "runs", "variety", "tables", "lines", "prose", "plain", "varied")


def votes(text: str, words: list[str], counts: Counter, shapes: Counter) -> list[int]:
    """A vote of each labeller; a detector that finds nothing abstains."""
    n = len(words)
    odd = sum(k for s, k in shapes.items() if SYMBOLS.search(s)) / n
    marks = sum(k * sum(c not in "aA9.,;:!?'\"()-" for c in s) for s, k in shapes.items()) / n
    loud = sum(k for s, k in shapes.items() if "!!" in s) / n
    upper = sum(k for s, k in shapes.items() if "A" in s and "a" not in s) / n
    ends = sum(k for s, k in shapes.items() if s[-1] in ".!?…") / n
    repeats = sum(map(operator.eq, words, words[1:])) / n
    variety = min(1.0, len(counts) / min(n, 400))
    lines = [x for x in text.split("\n") if x]
    junk = [
        odd >= 0.3,
        marks >= 0.3,
        upper >= 0.5 and n >= 5,
        loud >= 0.3,
        repeats >= 0.2 and n >= 10,
        variety <= 0.15 and n >= 30,
        counts["|"] / n >= 0.1,
        len(lines) >= 5 and len(set(lines)) / len(lines) <= 0.4,
    ]
    clean = odd <= 0.08 and marks <= 0.1 and upper <= 0.25 and repeats <= 0.05
    good = [clean and n >= 20 and 0.01 <= ends <= 0.4, clean, clean and n >= 30 and variety >= 0.25]
    return [JUNK if x else ABSTAIN for x in junk] + [GOOD if x else ABSTAIN for x in good]


def shape(word: str, cache: dict[str, str]) -> str:
    """Runs of letters, capitals and digits become a, A and 9; marks stay."""
    body, end = (word[:-1], word[-1]) if word[-1] in ".," else (word, "")
    if body.isalpha():
        if body.islower():
            return "a" + end
        if body[1:].islower():
            return "Aa" + end
        if body.isupper():
            return "A" + end
    if word in cache:
        return cache[word]
    out = re.sub(r"[^\W\d_A-Z]+", "a", word)
    out = re.sub(r"[A-Z]+", "A", out)
    out = re.sub(r"\d+", "9", out)
    if len(cache) < 200_000:
        cache[word] = out
    return out


def look(text: str | None, cache: dict[str, str]) -> tuple[list[int], list[int], list[float]]:
    """Votes, hashed features and their values."""
    words = (text or "").split()
    if not words:
        return [JUNK] * 8 + [ABSTAIN] * 3, [], []
    n = len(words)
    counts = Counter(words)
    shapes: Counter = Counter()
    for w, k in counts.items():
        shapes[shape(w, cache)] += k
    features = {f"shape {s}": k / n for s, k in shapes.items()}
    features["repeat"] = sum(map(operator.eq, words, words[1:])) / n
    features["same"] = 1 - min(1.0, len(counts) / min(n, 400))
    features["common"] = (counts.most_common(1)[0][1] - 1) / n
    hashed: dict[int, float] = {}
    for f, v in features.items():
        at = xxhash.xxh32_intdigest(f) % DIMENSIONS
        hashed[at] = hashed.get(at, 0.0) + v
    return votes(text, words, counts, shapes), list(hashed), list(hashed.values())


def looks(docs: DataFrame) -> DataFrame:
    """``doc_id, votes, at, value``: the only pass over the texts."""

    def make():
        cache: dict[str, str] = {}
        return lambda doc_id, text: (doc_id, *look(text, cache))

    return map_rows(docs_only(docs, "doc_id", "text"), make, "doc_id long, votes array<int>, at array<int>, value array<double>")


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """EM: the posterior of *good* of each pattern, each labeller's accuracy, the share of good.

    The one-coin model of Dawid and Skene: a labeller that votes is right with its own
    accuracy; an abstention says nothing.  It starts from the majority of votes.
    """
    sign = (patterns == GOOD).astype(float) - (patterns == JUNK)
    total = sign.sum(1)
    good, accuracy, share = np.where(total > 0, 0.9, np.where(total < 0, 0.1, 0.5)), np.full(patterns.shape[1], 0.8), 0.5
    for _ in range(rounds):
        right = ((sign > 0) * good[:, None] + (sign < 0) * (1 - good)[:, None]) * counts[:, None]
        cast = (sign != 0) * counts[:, None]
        accuracy = np.clip((right.sum(0) + 4) / (cast.sum(0) + 5), 0.55, 0.99)
        share = float(np.clip((counts * good).sum() / counts.sum(), 0.05, 0.95))
        log = np.log(share / (1 - share)) + sign @ np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return good, accuracy, share


def linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Logistic weights (the constant last) for soft labels, by Nesterov's gradient steps."""
    x = np.column_stack([x, np.ones(len(x))])
    step = 4 / max(1e-9, np.linalg.norm(x, 2) ** 2 / len(x) + 4 * ridge)
    w = before = np.zeros(x.shape[1])
    for i in range(rounds):
        ahead = w + i / (i + 3) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        before, w = w, ahead - step * (x.T @ (p - y) / len(x) + ridge * ahead)
    return w


def fit(seen: DataFrame, *, max_rows: int = 4000) -> tuple[np.ndarray, DataFrame]:
    """Scorer weights, and ``votes, posterior`` of every vote pattern.

    The scorer trains on the posteriors of at most ``max_rows`` documents (smallest hash of
    doc_id); the vote patterns are counted over all.
    """
    spark = seen.sparkSession
    rows = seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    schema = "votes array<int>, posterior double"
    if not rows:
        return np.zeros(DIMENSIONS + 1), spark.createDataFrame([], schema)
    good, _, _ = estimate(np.array([r.votes for r in rows]), np.array([r.n for r in rows], float))
    posterior = {tuple(r.votes): float(g) for r, g in zip(rows, good, strict=True)}
    sample = bounded_sample(seen, max_rows).select("votes", "at", "value").collect()
    x = np.zeros((len(sample), DIMENSIONS))
    for i, r in enumerate(sample):
        x[i, r["at"]] = r["value"]
    w = linear(x, np.array([posterior[tuple(r.votes)] for r in sample]))
    return w, spark.createDataFrame([(list(v), p) for v, p in posterior.items()], schema)


def score_quality(docs: DataFrame, *, max_rows: int = 4000, least: float = 0.5) -> DataFrame:
    """``doc_id, score, posterior, keep`` of every document; ``keep`` is ``score >= least``."""
    seen = written(looks(docs))
    weights, patterns = fit(seen, max_rows=max_rows)
    table = F.array(*(F.lit(float(w)) for w in weights[:-1]))
    terms = F.zip_with("at", "value", lambda i, v: F.get(table, i) * v)
    z = F.aggregate(terms, F.lit(float(weights[-1])), lambda a, t: a + t)
    score = F.when(F.size("at") == 0, 0.0).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    rows = seen.join(F.broadcast(patterns), "votes", "left").withColumn("score", score)
    return rows.select("doc_id", "score", "posterior", (F.col("score") >= least).cast("int").alias("keep"))


def keep_good(docs: DataFrame, *, max_rows: int = 4000, least: float = 0.5) -> DataFrame:
    """``docs`` without the rejected ones; the second pass scores in place, so no text is shuffled."""
    weights, _ = fit(written(looks(docs)), max_rows=max_rows)
    at = docs.columns.index("text")

    def run(batches):
        cache: dict[str, str] = {}
        for part in slices(batches):
            keep = []
            for text in part.column(at).to_pylist():
                _, where, value = look(text, cache)
                z = weights[-1] + sum(weights[i] * v for i, v in zip(where, value, strict=True))
                keep.append(bool(where) and 1 / (1 + np.exp(-z)) >= least)
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
