"""Periodic runs of words: stretches of a text that repeat with a period of one word or many.

A run is a stretch of consecutive words with smallest period ``q``, at least ``max(24, 3 q)`` words long, that no
neighbouring word extends.  On the diagonal of lag ``q`` (words against the words ``q`` before) it is a match of at least
16 words, which is where the sparse dynamic program starts: for each word, earlier occurrences of its
context activate or increment the match length of their lag, and a diagonal that ends emits its
run at once if the run is long enough.

Which earlier occurrences count is thinned without loss.  Contexts are the last ``m`` words, for ``m`` = 16, 32, 64 and so on,
each for the lags over ``m / 2`` and up to ``m`` (the first for all up to 16).  In a run of smallest period ``q <= m`` the latest earlier occurrence
of any ``m`` words is exactly ``q`` words back: a smaller distance would be a smaller period.  A run with ``q > m / 2`` has
``3 q >= m + q`` words, so every one is met, and the first context that lies in it starts its diagonal with
the match length ``m``.  So a text of ``n`` words costs at most ``n`` steps a width, and a width without an equal
pair of contexts ends the search, whatever the text; there is no list of all earlier occurrences of a
frequent word.  Contexts are compared exactly: names of two halves are paired and numbered anew.

Each document is worked on by itself, so rows need no shuffle.

Defined cases: a null text has no words; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import docs_only, map_rows

#: The least length of a run, its least number of periods, and the words of the shortest context.
LEAST, PERIODS, CONTEXT = 24, 3, 16


def _diagonals(places: list[int], lags: list[int], width: int) -> Iterator[tuple[int, int, int]]:
    """``start, length, period`` of long enough runs; ``places`` (last words of contexts) ascend, each with its lag."""
    lag = length = last = -1
    for place, own in zip(places, lags, strict=True):
        if own == lag and place == last + 1:
            length += 1
        else:
            if length + lag >= max(LEAST, PERIODS * lag):
                yield last + 1 - length - lag, length + lag, lag
            lag, length = own, width
        last = place
    if length + lag >= max(LEAST, PERIODS * lag):
        yield last + 1 - length - lag, length + lag, lag


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run, by start and then period."""
    n = len(words)
    if n < LEAST:
        return []
    ids: dict[bytes, int] = {}
    names = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    found: list[tuple[int, int, int]] = []
    width, distinct = 1, len(ids)
    while width <= CONTEXT or PERIODS * (width // 2 + 1) <= n:
        if width >= CONTEXT:
            order = np.argsort(names, kind="stable")
            same = names[order[1:]] == names[order[:-1]]
            back = np.zeros(len(names), np.int64)
            back[order[1:][same]] = (order[1:] - order[:-1])[same]
            at = np.flatnonzero((back > (width // 2 if width > CONTEXT else 0)) & (back <= width))
            found += _diagonals((at + width - 1).tolist(), back[at].tolist(), width)
        if distinct == len(names) or 2 * width > n:
            break
        paired = names[: len(names) - width] * distinct + names[width:]
        numbers, names = np.unique(paired, return_inverse=True)
        width, distinct = 2 * width, len(numbers)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains behind its first period."""
    if not found:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def densest(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the most periods; ties go to the smaller start, then period."""
    best = found[0]
    for run in found[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a tail made periodic in every tenth document, chosen and shaped by the CRC-32 of its id; a null id has none."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_runs(docs: DataFrame, *, plant: bool = False) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed`` of every document.

    ``start, length, period`` are those of the run of the most periods (null without one), in words; ``runs_sha256`` hashes the lines
    ``start,length,period`` of all; ``collapsed`` is the text without the repetitions, its words joined by
    a space.  ``plant`` makes known runs first, for a check.
    """

    def make():
        def one(doc_id, text):
            words = text.encode("utf-8", "surrogatepass").split()
            words = planted(words, doc_id) if plant else words
            found = runs(words)
            start, length, period = densest(found) if found else (None, None, None)
            kept = b" ".join(collapse(words, found))
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
            milli = 1000 * length // period if found else None
            return doc_id, len(found), start, length, period, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")

        return one

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"
    return map_rows(docs_only(docs, "doc_id", "text"), make, schema)
