"""Line labelling with a linear-chain conditional random field, and rules on its content share."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.common import materialise, slices, text_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Content share of the words from which a document is kept.
MIN_CONTENT = 0.5
#: Labelled documents that the field is fitted on at most.
FIT_DOCUMENTS = 10_000
#: A line in so many different documents of the sample may be boilerplate.
SHARED = 3
#: Rounds of labelling the open lines and fitting anew.
ROUNDS = 3
FEATURES = 14
#: Weights of content that are tried at last.
OFFSETS = tuple(x / 2 for x in range(13))
#: Features that mark a line as boilerplate in fitting, whatever its document's label.
MARKS = (3, 5, 6, 7, 8, 9, 10, 12)


def line_features(line: bytes, seen: bool):
    """0/1 features of a line, the last one constant."""
    words = line.split()
    n = len(words)
    text = line.decode("utf-8", "replace")
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    symbols = sum(map(text.count, SYMBOLS))
    digits = sum(map(str.isdigit, text))
    chars = max(1, sum(map(len, words)))
    ends = text.rstrip()[-1:] in ".!?:。"
    marks = sum(map(text.count, "!?"))
    return (
        n < 4,
        4 <= n < 12,
        n >= 40,
        upper * 10 > 5 * letters,
        upper * 10 > 2 * letters,
        symbols * 10 > 2 * n,
        symbols > n,
        line.count(b"|") * 4 > n and n > 2,
        marks * 3 > n,
        digits * 5 > chars,
        letters * 2 < chars,
        not ends,
        seen,
        True,
    )


def document_lines(text: str):
    """Lines with a word: (word count, features) of each, and the count of repeated ones."""
    seen: set[bytes] = set()
    sizes, feats, dup = [], [], 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        n = len(line.split())
        if n:
            again = line in seen
            dup += again
            seen.add(line)
            sizes.append(n)
            feats.append(line_features(line, again))
    return sizes, feats, dup


def viterbi(emission, transition):
    """The best state sequence: ``emission`` (lines, 2) and ``transition`` (2, 2) scores; ties go to state 1, content."""
    import numpy as np

    n = len(emission)
    back = np.zeros((n, 2), np.int8)
    best = emission[0].copy()
    for i in range(1, n):
        step = best[:, None] + transition
        back[i] = np.where(step[1] >= step[0], 1, 0)
        best = step.max(axis=0) + emission[i]
    path = np.empty(n, np.int8)
    path[-1] = 1 if best[1] >= best[0] else 0
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def unpack(patterns):
    """Patterns (features as bits) to rows of FEATURES 0/1 values."""
    import numpy as np

    return (np.asarray(patterns, np.int64)[:, None] >> np.arange(FEATURES) & 1).astype(float)


def fit_field(counts, decay: float = 1e-5, rounds: int = 30):
    """Weights (FEATURES,) of state 1 over state 0 and transitions (2, 2) by the chain's pseudo-likelihood.

    ``counts``: rows (pattern, state before, state, state behind, number), -1
    where there is no line.  Given its neighbours' states a line's state is a
    logistic regression, linear in the weights and transitions; Newton's steps
    solve it with a small ridge.
    """
    import numpy as np

    theta = np.zeros(FEATURES + 4)
    if len(counts):
        pattern, before, y, behind, n = np.asarray(counts, np.int64).T
        moves = [np.where(before == a, 2 * b - 1, 0) + np.where(behind == b, 2 * a - 1, 0) for a in (0, 1) for b in (0, 1)]
        x = np.hstack([unpack(pattern), np.stack(moves, axis=1)])
        ridge = decay * n.sum() * np.eye(len(theta))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ theta)
            theta = theta + step
            if np.abs(step).max() < 1e-8:
                break
    return theta[:FEATURES], theta[FEATURES:].reshape(2, 2)


def complete(patterns, sizes, known, good: bool, field):
    """States of a document's lines: ``known`` ones (0, 1) stay, open ones (-1) are decoded.

    A rejected document has less than MIN_CONTENT of its words in content as
    far as its known lines allow: a penalty on content grows until it has.
    """
    import numpy as np

    w, trans = field
    open_ = known < 0
    score = unpack(patterns) @ w
    for penalty in (0, 1, 2, 4, 8, 16):
        s = np.where(open_, score - penalty, np.where(known == 1, 1e6, -1e6))
        path = viterbi(np.stack([np.zeros_like(s), s], axis=1), trans)
        if good or not open_.any() or (path * sizes).sum() < MIN_CONTENT * sizes.sum():
            break
    return path


def line_targets(docs: DataFrame, labels: DataFrame, at_most: int = FIT_DOCUMENTS) -> DataFrame:
    """``(lines array<struct<i, pattern, size, known>>, good)`` of at most ``at_most`` labelled documents.

    ``known`` is 0 for lines with a mark of boilerplate, -1 (open) for lines that
    SHARED documents of the sample have, 1 for the other lines of accepted
    documents, -1 for the other lines of rejected ones.  Documents that
    fail the base rules say nothing of their lines and are left out.  The sample
    is the labels with the smallest hashes of doc_id; its ids are broadcast.
    """
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)

    def run(batches):
        import hashlib

        import pyarrow as pa

        for part in slices(batches, 64):
            for d, t, q in zip(*[c.to_pylist() for c in part.columns], strict=True):
                words = t.encode("utf-8", "surrogatepass").split()
                if base_fails(len(words), repeated_words(words)):
                    continue
                sizes, feats, _ = document_lines(t)
                lines = [x for x in t.encode("utf-8", "surrogatepass").split(b"\n") if x.split()]
                key = [int.from_bytes(hashlib.blake2b(b" ".join(x.split()), digest_size=8).digest(), "little", signed=True) for x in lines]
                bits = [sum(1 << k for k, v in enumerate(f) if v) for f in feats]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * n, pa.int64()), pa.array([q] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(bits, pa.int32()), pa.array(sizes, pa.int32()), pa.array(key, pa.int64())],
                    names=["doc", "quality", "i", "pattern", "size", "key"],
                )

    rows = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(sample), "doc_id").select(F.monotonically_increasing_id().alias("doc"), "text", "quality")
    rows = materialise(rows.mapInArrow(run, "doc long, quality int, i int, pattern int, size int, key long"))
    shared = rows.select("doc", "key").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED)
    rows = rows.join(shared, "key", "left")
    marked = F.col("pattern").bitwiseAND(F.lit(sum(1 << k for k in MARKS))) != 0
    known = F.when(marked, 0).when(F.col("n").isNotNull(), -1).when(F.col("quality") > 0, 1).otherwise(-1)
    lines = rows.groupBy("doc", "quality").agg(F.array_sort(F.collect_list(F.struct("i", "pattern", "size", known.alias("known")))).alias("lines"))
    return materialise(lines.select("lines", (F.col("quality") > 0).alias("good")))


def train(docs: DataFrame, labels: DataFrame, at_most: int = FIT_DOCUMENTS):
    """Fit the field to latent line states by alternating: label the open lines with it, count, fit anew.

    Each task sums its own counts of (features, state before, state, state
    behind), Spark adds them up; what the driver gets is bounded by the number
    of such combinations (2^13 x 18), however many lines there are.  At last
    the one of OFFSETS is added to content's weight with which the verdicts on
    the sample agree best with its labels (the mean of both shares of right
    ones).  Without labels all weights are 0, which keeps every line.
    """
    import numpy as np

    targets, field = line_targets(docs, labels, at_most), (np.zeros(FEATURES), np.zeros((2, 2)))
    for _ in range(ROUNDS):

        def count(batches, field=field):
            from collections import Counter

            import pyarrow as pa

            total: Counter = Counter()
            for part in slices(batches, 64):
                for lines, good in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    pattern, size, known = (np.array([x[k] for x in lines]) for k in ("pattern", "size", "known"))
                    path = [-1, *complete(pattern, size, known, good, field).tolist(), -1]
                    total.update(zip(pattern.tolist(), path, path[1:], path[2:], strict=False))
            cols = list(zip(*[(*k, n) for k, n in total.items()], strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["pattern", "before", "y", "behind", "n"])

        sums = targets.mapInArrow(count, "pattern long, before long, y long, behind long, n long").groupBy("pattern", "before", "y", "behind").agg(F.sum("n").alias("n"))
        field = fit_field([tuple(r) for r in sums.collect()])

    def verdicts(batches):
        import pyarrow as pa

        right = np.zeros((len(OFFSETS), 2), np.int64)
        for part in slices(batches, 64):
            for lines, good in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                score, size = unpack([x["pattern"] for x in lines]) @ field[0], np.array([x["size"] for x in lines])
                for k, offset in enumerate(OFFSETS):
                    path = viterbi(np.stack([np.zeros_like(score), score + offset], axis=1), field[1])
                    right[k, int(good)] += ((path * size).sum() >= MIN_CONTENT * size.sum()) == good
        yield pa.RecordBatch.from_arrays([pa.array(range(len(OFFSETS)), pa.int32()), pa.array(right[:, 0]), pa.array(right[:, 1])], names=["k", "bad", "good"])

    right = targets.mapInArrow(verdicts, "k int, bad long, good long").groupBy("k").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
    most = [max(1, sum(r[0] for r in targets.select((F.col("good") == g).cast("int")).groupBy().sum().collect() if r[0])) for g in (False, True)]
    best = max(right, key=lambda r: (r.bad / most[0] + r.good / most[1], -r.k), default=None)
    if best is not None:
        field[0][-1] += OFFSETS[best.k]
    return field


def repeated_words(words) -> int:
    """Words inside 5-word windows that occur twice or more in the sequence."""
    import numpy as np

    n = len(words)
    if n < 6:
        return 0
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)

    def pairs(x, y):
        return np.unique(x * (int(y.max()) + 1) + y, return_inverse=True)[1]

    two = pairs(a[:-1], a[1:])
    four = pairs(two[:-2], two[2:])
    _, five, count = np.unique(four[:-1] * (int(a.max()) + 1) + a[4:], return_inverse=True, return_counts=True)
    if count.max() < 2:
        return 0
    mark = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(count[five] > 1)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + 5, -1)
    return int((mark.cumsum() > 0).sum())


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def label_documents(docs: DataFrame, field) -> DataFrame:
    """``docs(doc_id, text)`` to the base counts, the CRF's content share and the verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lines, content_share.  Words are runs of other than ASCII
    white space.  Null text is empty: it fails the base, and its share is 0.
    Rows are judged one by one: repeated rows get equal results, an empty table
    gives no rows, other columns are ignored.
    """
    w, trans = field

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.int64(), pa.float64()]
        for part in slices(batches):
            out = []
            for t in part.column(1).to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                words = raw.split()
                n = len(words)
                space = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
                sizes, feats, dup = document_lines(t)
                rep = repeated_words(words)
                failed = base_fails(n, rep)
                share = 0.0
                if feats:
                    s = np.array(feats, float) @ w
                    path = viterbi(np.stack([np.zeros_like(s), s], axis=1), trans)
                    share = float((path * np.array(sizes)).sum() / sum(sizes))
                out.append((n, len(t) - space, sum(map(t.count, SYMBOLS)), dup, rep, failed, not failed and share >= MIN_CONTENT, len(sizes), share))
            cols = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "content_share"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, content_share double"
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, schema)
