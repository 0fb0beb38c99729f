"""Whitening, min-max near-duplicates and periodic runs against brute force, with odd rows and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from voxelmill.llm import minhash, periodic, queries, whitening

SCHEMA = "doc_id long, text string, sid string, node long, n_shingles int, h int"


# --- whitening ------------------------------------------------------------------------------


def whitened(spark, vectors, components=32):
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n int, x double")
    return whitening.whiten(df, components).collect()


@pytest.mark.parametrize("rows,size,decay", [(300, 64, 0.0), (200, 90, 0.05), (120, 5, 0.0)])
def test_whitening_equals_a_dense_eigendecomposition(spark, rows, size, decay):
    rng = np.random.default_rng(size)
    vectors = (rng.standard_normal((rows, size)) * np.exp(-decay * np.arange(size))).tolist()
    got = whitened(spark, vectors)
    x = np.floor(64 * np.array(vectors)).astype(int) + 1_000_000
    assert len(got) == rows * min(32, size)
    centred = x - x.mean(0)
    values, basis = np.linalg.eigh(centred.T @ centred / rows)
    values, basis = values[::-1], basis[:, ::-1]
    score = collections.defaultdict(dict)
    for r in got:
        score[r.component][r.vec_id] = r.whitened
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9 and r.n == rows
    sums = x.sum(0)
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(i, int(((rows * v - sums) ** 2).sum())) for i, v in enumerate(x)}
    for c, by_row in score.items():
        mine = np.array([by_row[i] for i in range(rows)])
        theirs = centred @ basis[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-7


def test_whitening_leaves_out_unusable_vectors_and_flat_components(spark):
    line = [[float(i), 2.0 * i, 0.0] for i in range(20)]
    odd = [None, [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0]]
    got = whitened(spark, [*odd, *line, line[3]])
    assert {r.component for r in got} == {1} and {r.vec_id for r in got} == set(range(4, 25)) and {r.n for r in got} == {21}
    assert whitened(spark, []) == [] and whitened(spark, odd) == [] and whitened(spark, [[1.0, 2.0]] * 5) == []
    with pytest.raises(Exception, match="entries"):
        whitened(spark, [[1.0, 2.0], [1.0]])


def test_large_deviations_stay_exact():
    off = np.array([[2**40, -(2**41), 3], [1, 2, 3]], np.int64)
    assert [int(v.as_py()) for v in whitening._exact_squares(off)] == [2**80 + 2**82 + 9, 14]


def test_partial_sums_of_many_tasks_are_added_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((60, 40)).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(8)
    plain = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(df, 4).collect()}
    monkeypatch.setattr(whitening, "FAN", 1)
    grouped = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(df, 4).collect()}
    assert plain.keys() == grouped.keys() and all(abs(plain[k] - grouped[k]) < 1e-8 for k in plain)


# --- near-duplicates ------------------------------------------------------------------------


def word_sets(text, n):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_classes(rows, n):
    sets = [word_sets(t, n) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = low.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return collections.Counter(out)


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_classes_equal_brute_force(spark, n):
    rng = random.Random(n)
    texts = ["", None, " \n", "one", "One", "a b", "A B", "x" * 30000, "a b c d e", "same " * 3000, "same " * 3001]
    for size in (5, 12, 40, 90, 300):
        for _ in range(6):
            base = [f"w{rng.randrange(400)}" for _ in range(size)]
            texts += [" ".join(base)] * rng.randrange(1, 3)
            texts += [edited(rng, base, rng.randrange(1, max(2, size // 10))) for _ in range(6)]
    rng.shuffle(texts)
    rows = [(None if i % 29 == 7 else i, t) for i, t in enumerate(texts)]
    rows += rows[3:6]
    df = spark.createDataFrame([(d, t, "s", 1, 2, 3) for d, t in rows], SCHEMA)
    got = minhash.similar_classes(df, n)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert collections.Counter(map(tuple, got.collect())) == brute_classes(rows, n)
    assert minhash.similar_classes(df.limit(0), n).count() == 0


def test_minhash_links_a_large_group_of_different_classes_in_one_bucket(spark, monkeypatch):
    """Texts that share most words, but not enough of them: buckets of many classes, dealt in parts."""
    monkeypatch.setattr(minhash, "SALT", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        own = edited(rng, base, 9).split()
        rows += [(3 * i, " ".join(own)), (3 * i + 1, edited(rng, own, 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(map(tuple, minhash.similar_classes(df, 2).collect())) == brute_classes(rows, 2)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**64, 800, dtype=np.uint64)
    x, y = (np.concatenate([both, rng.integers(0, 2**64, 100, dtype=np.uint64)]) for _ in range(2))
    made = minhash.permutations()
    a, b = minhash.signature(x, *made), minhash.signature(y, *made)
    pairs = [(int(m), int(f)) for m, f in zip(*(c[:2, 0] for c in made), strict=True)]
    assert abs((a == b).mean() - 0.8) < 0.12
    half = minhash.PERMUTATIONS
    assert [int(v) for v in a[:2]] == [min((int(h) ^ m) * f % 2**64 for h in x) for m, f in pairs]
    assert [int(v) for v in a[half : half + 2]] == [max((int(h) ^ m) * f % 2**64 for h in x) for m, f in pairs]
    differ = sum((int(p ^ q) % 2**64).bit_count() for p, q in zip(minhash.sketch(a), minhash.sketch(b), strict=True))
    assert differ <= minhash.allowed_bits(0.8) < 80 and len(minhash.bands(a)) == 2 * half // minhash.ROWS


# --- periodic runs --------------------------------------------------------------------------


def brute_runs(x):
    n, found = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(x[t] == x[t + p] for t in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept)


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(1500):
        size = rng.randrange(60)
        x = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(size)]
        if rng.random() < 0.6 and size > 8:
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 14))]
            x = x[: size // 3] + unit * rng.randrange(2, 7) + unit[: rng.randrange(len(unit))] + x[size // 3 :]
        assert periodic.find_runs(np.array(x, np.int64)) == brute_runs(x), x


def test_periodic_rows_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "one", "a " * 5, "a " * 6, "a b " * 5, "ab c " * 9, "x y z. " * 4 + "tail", "one\ttwo\x0b" * 7]
    texts += [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b " * 6), (5, "a " * 6)]
    df = spark.createDataFrame([(d, t, "s", 1, 2, 3) for d, t in rows], SCHEMA)
    got = periodic.periodic_runs(df)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_row(*r) for r in rows)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows if d) and periodic.periodic_runs(df.limit(0)).count() == 0


def test_very_long_texts_take_nearly_linear_time():
    n = 300_000
    assert periodic.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic.find_runs(np.arange(n) % 4999) == [(0, n, 4999)]


def test_new_queries_cover_their_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert collections.Counter(map(tuple, queries.op12_minhash(spark, sf).collect())) == brute_classes(rows, 2)
    short = {d: t for d, t in rows if len((t or "").split()) < 400}
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()]
    assert len(got) == len(rows) and collections.Counter(r for r in got if r[0] in short) == collections.Counter(brute_row(*r) for r in rows if r[0] in short)
    white = queries.op11_whitening(spark, sf)
    assert dict(white.dtypes)["deviation"] == "bigint" and white.count() == 32 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
