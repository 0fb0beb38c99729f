"""Periodic runs of words: seeds extended along diagonals, and texts collapsed to one period of each run."""

from __future__ import annotations

import hashlib
import re
import zlib

from pyspark.sql import DataFrame

from voxelmill.llm.common import slices, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
SCHEMA = "doc_id {}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of a tenth of the documents (by the CRC-32 of the id) with a tail made periodic; the others as they are."""
    n, h = len(words), 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def _stretch(x, i: int, q: int) -> tuple[int, int]:
    """The bounds of the equal stretch ``x[t] == x[t + q]`` around ``i``, found in blocks that double."""
    import numpy as np

    def reach(a, b):
        """Equal leading entries of two arrays of one length."""
        at, step = 0, 64
        while at < len(a):
            differ = np.flatnonzero(a[at : at + step] != b[at : at + step])
            if len(differ):
                return at + int(differ[0])
            at, step = at + step, 2 * step
        return len(a)

    return i - reach(x[:i][::-1], x[q : q + i][::-1]), i + reach(x[i : len(x) - q], x[i + q :])


def find_runs(x) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every maximal run of the integer array ``x``, by start, then period.

    A run of period q repeats itself over at least max(6 - q, 3 q) places.  For
    periods from 2^j to 2^(j+1) - 1 this is at least K = 3 * 2^j (5 for j = 0),
    which is no less than the period, so a K-gram within such a run is met next
    exactly one smallest period later: the index of K-grams gives pairs of
    neighbouring occurrences only, at most one a place and level.  Each pair is
    extended both ways at its lag, unless the lag's furthest covered place lies
    beyond it.  Ranks of grams come from doubling, so no two grams are confused.
    """
    import numpy as np

    n, found = len(x), []
    if n < LEAST_WORDS:
        return found
    x = np.unique(x, return_inverse=True)[1].astype(np.int64)

    def paired(a, b):
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)

    def joined(rank, size, gap):
        """Ranks of grams of size + gap words from those of ``size`` words, gap places apart (gap <= size)."""
        m = n - size - gap + 1
        return paired(rank[:m], rank[gap : gap + m])

    grams, low = x, 1  # ranks of 2^j-grams
    while max(LEAST_WORDS, LEAST_PERIODS * low) <= n:
        k = max(LEAST_WORDS - low, (LEAST_PERIODS - 1) * low)
        rank, size = grams, low
        while size < k:
            gap = min(size, k - size)
            rank, size = joined(rank, size, gap), size + gap
        order = np.argsort(rank, kind="stable")
        same = rank[order[1:]] == rank[order[:-1]]
        here, lag = order[:-1][same], (order[1:] - order[:-1])[same]
        keep = (lag >= low) & (lag < 2 * low)
        by_place = np.lexsort((here[keep], lag[keep]))
        covered: dict[int, int] = {}
        for i, q in zip(here[keep][by_place].tolist(), lag[keep][by_place].tolist(), strict=True):
            if i < covered.get(q, 0):
                continue
            start, end = _stretch(x, i, q)
            covered[q] = end
            if end - start + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((start, end - start + q, q))
        grams, low = joined(grams, low, low), 2 * low
        if int(grams.max()) + 1 == len(grams):  # no longer gram repeats
            break
    return sorted(found, key=lambda r: (r[0], r[2]))


def summary(doc_id: int | None, text: str) -> tuple:
    """One result row of a document without its id."""
    import numpy as np

    words = planted(doc_id, WORD.findall(text))
    number: dict[str, int] = {}
    x = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    runs = find_runs(x)
    best = None
    for s, length, q in runs:  # in order of start, then period
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    cover = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        cover[s + q] += 1
        cover[s + length] -= 1
    if runs:
        gone = np.cumsum(cover[:-1]) > 0
        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    listed = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
    kept = hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()
    return len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], listed, kept


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to one row a document: its runs, the strongest of them, and the digest of its collapsed text.

    A run is a stretch of words of smallest period q, of at least 6 words and 4
    periods, that no neighbouring word extends.  Words behind the first period
    of any run are dropped.  Null texts have no words; texts without words or
    runs have n_runs 0, nulls for the strongest run and the digest of no runs;
    a row with a null doc_id keeps its words as they are; equal rows give equal
    rows; an empty table gives none.  Only doc_id and text are read.
    """

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            rows = [summary(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, SCHEMA.format(kind))
