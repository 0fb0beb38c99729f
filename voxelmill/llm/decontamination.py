"""Benchmark decontamination: n-gram seeds find passages, local alignment scores them."""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelmill.llm.common import filtered, slices, text_of

NGRAM = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Alignment score over the best possible one from which a passage is a copy.
MIN_SCORE = 0.6
#: Items to a block: the index that is broadcast holds no more, larger benchmarks take several passes.
BLOCK_ITEMS = 20_000
#: ... and no more words than this.
BLOCK_WORDS = 2_000_000
EDGE = b".,;:!?\"'()[]{}*#$%&|<>-"


def tokens(text: str) -> list[bytes]:
    """Words at ASCII white space, A-Z lower-cased, without punctuation at their ends."""
    return [w.strip(EDGE) or w for w in text.encode("utf-8", "surrogatepass").lower().split()]


def build_index(items: list[tuple[int, str]]) -> dict:
    """Word ids, for each n-gram key the items that have it with their first and last place and number of places, and the lengths of keys (a short item is one key)."""
    ids: dict[bytes, int] = {}
    seqs = {}
    for item, text in items:
        seqs[item] = [ids.setdefault(w, len(ids)) for w in tokens(text)]
    places = defaultdict(dict)
    for item, s in seqs.items():
        n = min(NGRAM, len(s))
        for i in range(len(s) - n + 1 if s else 0):
            mine = places[tuple(s[i : i + n])]
            first, _, times = mine.get(item, (i, i, 0))
            mine[item] = (first, i, times + 1)
    return {"sizes": sorted({len(k) for k in places}), "ids": ids, "seqs": {k: v for k, v in seqs.items() if v}, "bags": {k: Counter(v) for k, v in seqs.items() if v}, "places": dict(places)}


def hits(a, index):
    """(position, key) of each n-gram of a document's word ids that is in an item, one after the other."""
    wanted, sizes = index["places"], index["sizes"]
    run = 0
    for i, x in enumerate(a):
        run = run + 1 if x >= 0 else 0
        for n in sizes:
            if n > run:
                break
            key = tuple(a[i - n + 1 : i + 1])
            if key in wanted:
                yield i - n + 1, key


def align(item, window):
    """Smith-Waterman with linear gaps: (score, first, end) of the best local alignment, places in ``window``."""
    import numpy as np

    b = np.asarray(window)
    n = len(b)
    ramp = np.arange(n + 1) * GAP
    row = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    best = (0, 0, 0)
    for x in item:
        diag = row[:-1] + np.where(b == x, MATCH, MISMATCH)
        up = row[1:] + GAP
        cell = np.concatenate([[0], np.maximum(np.maximum(diag, up), 0)])
        origin = np.concatenate([[0], np.where(diag >= up, start[:-1], start[1:])])
        origin = np.where(cell == 0, np.arange(n + 1), origin)
        # gaps along the row: the best earlier cell less the way from it
        lifted = cell - ramp
        top = np.maximum.accumulate(lifted)
        src = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row = top + ramp
        start = origin[src]
        start = np.where(row <= 0, np.arange(n + 1), start)
        row = np.maximum(row, 0)
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(start[j]), j)
    return best


def overlap(bag: Counter, words: Counter) -> int:
    """Words of an item that are among ``words``, each as often as in both: no alignment matches more."""
    return sum(min(n, words[w]) for w, n in bag.items() if w in words)


def leaks_in(words, index, min_score=MIN_SCORE):
    """(item, score, first word, end word, seeds) of each item that a document copies, its best passage.

    Every n-gram of an item is a seed, however many documents have it.  Items
    and passages whose words cannot reach the score are not aligned (exact).
    An n-gram that an item repeats stands for all diagonals from its last to
    its first place, so that memory and time grow with the document's seeds,
    not with their product with the item's places.
    """
    get = index["ids"].get
    a = [get(w, -1) for w in words]
    by_item, seeds = defaultdict(lambda: (array("q"), array("q"))), Counter()
    for at, key in hits(a, index):
        for item, (first, last, times) in index["places"][key].items():
            lows, highs = by_item[item]
            lows.append(at - last)
            highs.append(at - first)
            seeds[item] += times
    out = []
    if not by_item:
        return out
    bag = Counter(a)
    for item, (lows, highs) in by_item.items():
        seq = index["seqs"][item]
        least = min_score * len(seq) - 1e-9
        if overlap(index["bags"][item], bag) < least:
            continue
        n, slack = len(seq), len(seq) // 2 + NGRAM
        best = (0.0, 0, 0)
        # passages: runs of nearby diagonals
        lo = hi = None
        spans = []
        for first, last in sorted(set(zip(lows, highs, strict=True))):
            if lo is None or first > hi + slack:
                if lo is not None:
                    spans.append((lo, hi))
                lo, hi = first, last
            hi = max(hi, last)
        spans.append((lo, hi))
        for lo, hi in spans:
            s, e = max(0, lo - slack), min(len(a), hi + n + slack)
            if overlap(index["bags"][item], Counter(a[s:e])) < least:
                continue
            got, i, j = align(seq, a[s:e])
            if got / (MATCH * n) > best[0]:
                best = (got / (MATCH * n), s + i, s + j)
        if best[0] >= min_score:
            out.append((item, best[0], best[1], best[2], seeds[item]))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Passages of ``docs(doc_id, text)`` that copy items of ``benchmark(item_id, text)``.

    Returns a row per document and item at ``min_score`` or more: doc_id,
    item_id, score (alignment score over the item's best possible), first_word,
    end_word (word places of the best passage), n_seeds (pairs of equal
    n-grams of the item and the document).  A copy needs one intact n-gram.

    The benchmark goes to the tasks in blocks of at most BLOCK_ITEMS items and
    BLOCK_WORDS words, so its broadcast index is bounded at any size; documents
    are read once for each block and never shuffled.  An item under NGRAM words
    is one seed: it is found where all its words stand in a row.  Null texts and ids: a null text has no
    words; items with a null id are skipped; a null doc_id is returned as such.
    Repeated rows each give rows; items sharing an id count as one (the smallest
    text); empty tables give no rows.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType())]
        + [T.StructField(c, T.LongType()) for c in ("first_word", "end_word", "n_seeds")]
    )
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    result = spark.createDataFrame([], schema)
    for block in _blocks(benchmark):
        result = result.union(_search(rows, block, min_score, schema)) if block else result
    return result


def _blocks(benchmark: DataFrame):
    items = benchmark.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    block, words = [], 0
    for item, text in items.orderBy("item_id").toLocalIterator():
        n = len(text.split())
        if block and (len(block) >= BLOCK_ITEMS or words + n > BLOCK_WORDS):
            yield block
            block, words = [], 0
        block.append((item, text))
        words += n
    yield block


def _search(rows: DataFrame, items, min_score: float, schema) -> DataFrame:
    index = rows.sparkSession.sparkContext.broadcast(build_index(items))

    def search(batches):
        import pyarrow as pa

        for part in slices(batches):
            out = []
            for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                out += [(d, *leak) for leak in leaks_in(tokens(t), index.value, min_score)]
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [part.schema.field(0).type, pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

    return rows.mapInArrow(search, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns; documents are not shuffled.

    Null texts have no words and stay, as all rows do where the benchmark is
    empty; repeated rows stay or go together; a score of MIN_SCORE is a leak; a
    null doc_id does not matter; an empty table gives none.
    """
    at = docs.columns.index("text")
    for block in _blocks(benchmark):
        if not block:
            continue
        index = docs.sparkSession.sparkContext.broadcast(build_index(block))

        def run(batches, index=index):
            import pyarrow as pa

            for part in slices(batches):
                yield part.filter(pa.array([not leaks_in(tokens(t or ""), index.value) for t in part.column(at).to_pylist()], pa.bool_()))

        docs = filtered(docs, run)
    return docs
