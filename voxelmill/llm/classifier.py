"""Quality scores: random Fourier features, ridge regression and isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.common import filtered, materialise, slices, text_of

#: Labelled documents that the model is fitted on at most.
FIT_DOCUMENTS = 40_000
FOLDS = 5
#: Fold 0 is held out; this one calibrates, the others give the weights.
CALIBRATION_FOLD = 1
COMPONENTS = 256
WIDTH = 0.25
RIDGE = 1e-3
THRESHOLD = 0.3
SEED = 20_240_229
SYMBOLS = "#*$%&|<>"
STATISTICS = 22


def statistics(text: str) -> list[float]:
    """Document statistics: sizes, character and word shares, repetition, line shapes."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * (STATISTICS - 1) + [1.0]
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, letters = sum(map(str.isupper, text)), sum(map(str.isalpha, text))
    digits, symbols = sum(map(str.isdigit, text)), sum(map(text.count, SYMBOLS))
    marks, stops = text.count("!") + text.count("?"), text.count(".") + text.count(",")
    bi = Counter(zip(words, words[1:], strict=False))
    top = counts.most_common(3)
    heads = [x.split(None, 1)[0] for x in lines]
    share = lambda x, y: x / y if y else 0.0
    short = sum(len(w) <= 3 for w in words)
    return [
        math.log1p(n),
        math.log1p(chars / n),
        share(upper, letters),
        share(letters, chars),
        share(digits, chars),
        min(2.0, symbols / n),
        min(2.0, marks / n),
        min(2.0, stops / n),
        min(2.0, text.count("|") / n),
        len(counts) / n,
        share(sum(c for _, c in top), n),
        share(top[0][1], n),
        1 - share(len(bi), n - 1) if n > 1 else 0.0,
        share(sum(c == 1 for c in counts.values()), len(counts)),
        math.log1p(len(lines)),
        math.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        1 - len(set(heads)) / len(heads),
        share(sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines), len(lines)),
        short / n,
        share(sum(len(w) > 12 for w in words), n),
        0.0,
    ]


@dataclass(frozen=True)
class Model:
    """What scoring needs; all parts are of fixed size."""

    mean: list
    scale: list
    weights: list
    knots: list
    levels: list


def projection():
    """Fixed Gaussian frequencies (STATISTICS, COMPONENTS) and phases."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    return rng.normal(0, WIDTH, (STATISTICS, COMPONENTS)), rng.uniform(0, 2 * np.pi, COMPONENTS)


def fourier(x, model_mean, model_scale):
    """Random Fourier features of rows of statistics, with the standardised statistics and a constant beside them."""
    import numpy as np

    freq, phase = projection()
    z = np.clip((x - np.asarray(model_mean)) / np.asarray(model_scale), -8, 8)
    return np.hstack([np.sqrt(2 / COMPONENTS) * np.cos(z @ freq + phase), z * 0.1, np.ones((len(x), 1))])


def isotonic(scores, labels):
    """Pool adjacent violators: rising knots (scores) and rising levels (label means, kept half a row's weight off 0 and 1)."""
    import numpy as np

    at, group = np.unique(np.asarray(scores, float), return_inverse=True)
    ones, rows = np.bincount(group, np.asarray(labels, float)), np.bincount(group)
    blocks: list[list[float]] = []
    for s, y, n in zip(at.tolist(), ones.tolist(), rows.tolist(), strict=True):
        blocks.append([s, y, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s0, y0, n0 = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][2] + s0 * n0) / (blocks[-1][2] + n0), blocks[-1][1] + y0, blocks[-1][2] + n0]
    least = 0.5 / (len(group) + 1)
    return [b[0] for b in blocks], [min(max(b[1] / b[2], least), 1 - least) for b in blocks]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo FOLDS; a null id is in fold 0, so it is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0)).cast("int")


def _gram(batches, model_mean, model_scale):
    """Sums of one partition: normal matrix and right-hand side as one binary row."""
    import numpy as np
    import pyarrow as pa

    size = COMPONENTS + STATISTICS + 1
    total = np.zeros((size, size + 1))
    for part in slices(batches, 2048):
        x = np.array(part.column(0).to_pylist(), float).reshape(-1, STATISTICS)
        z = fourier(x, model_mean, model_scale)
        total[:, :size] += z.T @ z
        total[:, size] += z.T @ np.array(part.column(1).to_pylist(), float)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def fit(docs: DataFrame, labels: DataFrame, at_most: int = FIT_DOCUMENTS) -> Model:
    """Fit on the labelled documents of folds other than 0, at most ``at_most`` of them (smallest hashes of doc_id).

    Ids of the sample are broadcast (12 bytes each); statistics stay in Spark.
    Each partition sums its own normal equations; those fixed-size sums are
    added up by a second level of tasks and solved on the driver.  Null labels
    are skipped; without usable labels every score is 0.5.
    """
    import numpy as np

    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    usable = usable.where(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([statistics(t) for t in part.column(0).to_pylist()], pa.list_(pa.float64())), part.column(1), part.column(2)], names=["x", "y", "fold"]
            )

    rows = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(usable), "doc_id")
    rows = materialise(rows.select("text", "y", fold(F.col("doc_id")).alias("fold")).mapInArrow(run, "x array<double>, y double, fold int"))
    stats = rows.agg(F.count("*"), *[f(F.col("x")[i]) for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    if not stats[0]:
        return Model([0.0] * STATISTICS, [1.0] * STATISTICS, [0.0] * (COMPONENTS + STATISTICS + 1), [0.0], [0.5])
    mean = [float(v) for v in stats[1::2]]
    scale = [max(float(v), 1e-6) for v in stats[2::2]]

    def add(batches):
        import numpy as np
        import pyarrow as pa

        total = 0.0
        for batch in batches:
            for b in batch.column(0):
                total = total + np.frombuffer(b.as_buffer())
        if not isinstance(total, float):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    learn = rows.where(F.col("fold") != CALIBRATION_FOLD).select("x", "y")
    sums = learn.mapInArrow(lambda b: _gram(b, mean, scale), "sums binary").repartition(8).mapInArrow(add, "sums binary").collect()
    size = COMPONENTS + STATISTICS + 1
    total = np.sum([np.frombuffer(bytes(r[0])) for r in sums], axis=0).reshape(size, size + 1)
    n = max(1.0, total[size - 1, size - 1])
    ridge = RIDGE * n / size * np.eye(size)
    ridge[-1, -1] = 1e-9
    weights = np.linalg.solve(total[:, :size] + ridge, total[:, size])

    def raw(batches):
        import numpy as np
        import pyarrow as pa

        for part in slices(batches, 2048):
            x = np.array(part.column(0).to_pylist(), float).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([pa.array(fourier(x, mean, scale) @ weights), part.column(1)], names=["s", "y"])

    held = rows.where(F.col("fold") == CALIBRATION_FOLD).select("x", "y").mapInArrow(raw, "s double, y double").collect()
    if not held:
        return Model(mean, scale, weights.tolist(), [0.0, 1.0], [0.0, 1.0])
    knots, levels = isotonic([r[0] for r in held], [r[1] for r in held])
    return Model(mean, scale, weights.tolist(), knots, levels)


def scores(texts: list[str], model: Model):
    """Calibrated scores in 0..1: linear between the isotonic knots."""
    import numpy as np

    x = np.array([statistics(t) for t in texts], float).reshape(-1, STATISTICS)
    s = fourier(x, model.mean, model.scale) @ np.asarray(model.weights)
    return np.clip(np.interp(s, model.knots, model.levels), 0, 1)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, held_out, score, predicted.

    Null and empty texts get the score of the empty text, a null doc_id counts
    as held out, repeated rows get equal scores, other columns are ignored.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in slices(batches):
            s = scores(part.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select("doc_id", (fold(docs["doc_id"]) == 0).alias("held_out"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score THRESHOLD or more, with all their columns as they were.

    Null texts score as empty ones; repeated rows stay or go together; a score
    of THRESHOLD stays; a null doc_id does not matter; an empty table gives none.
    """
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            yield part.filter(pa.array(scores([t or "" for t in part.column(at).to_pylist()], model) >= THRESHOLD))

    return filtered(docs, run)
