"""Near-duplicate classes from min-max hashes: banded signatures, verified on full shingle sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.common import materialise, slices, text_of
from voxelmill.llm.graph import components
from voxelmill.llm.simhash import _few, _lists, _texts, shingle_hashes

#: Permutations, each giving a minimum and a maximum, and values to a band.  Two sets of similarity 0.8 share none of the
#: 2 * 80 / 4 = 40 bands with a chance of (1 - 0.8^4)^40 < 1e-9.
PERMUTATIONS, ROWS = 80, 4
#: Two-bit hashes of the 160 values, in longs: sketches whose equal bits estimate the similarity.
BITS, SKETCH = 2, 2 * 2 * PERMUTATIONS // 64
#: Longs of a set's parity bits: bit h mod 1024 flips with each entry h, so two sets differ in at least as many entries as
#: their parities differ in bits.
PARITY = 16
#: A sketch may differ from that of a set with the wanted similarity by its expectation and this many standard errors.
ERRORS = 6
#: Texts of one bucket that take one part of it on one side.
SALT = 256
#: Shingles hashed at a time, whatever the length of a text.
STEP = 1 << 13


def permutations():
    """Columns ``(masks, odd factors)``: a hash h goes to ``(h ^ mask) * factor``, a permutation of 64-bit integers."""
    import numpy as np
    import xxhash

    made = [(xxhash.xxh64_intdigest(f"mask {k}", 0), xxhash.xxh64_intdigest(f"factor {k}", 0) | 1) for k in range(PERMUTATIONS)]
    return tuple(np.array(x, np.uint64)[:, None] for x in zip(*made, strict=True))


def signature(h, mask, factor):
    """Minimum and maximum of the hashes ``h`` (not empty) under each permutation: an array of 2 * PERMUTATIONS, minima first."""
    import numpy as np

    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(h), STEP):
        part = h[None, i : i + STEP] ^ mask
        part *= factor
        low, high = np.minimum(low, part.min(1)), np.maximum(high, part.max(1))
    return np.concatenate([low, high])


def bands(values):
    """A hash for every ROWS values, minima and maxima in bands of their own."""
    import numpy as np

    out = np.zeros(len(values) // ROWS, np.uint64)
    for i in range(ROWS):
        out = (out ^ values[i::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketch(values):
    """BITS bits of a hash of every value, 64 to a long."""
    import numpy as np

    h = values * np.uint64(0xD6E8FEB86659FD93)
    bit = np.stack([(h >> np.uint64(63 - k)) & np.uint64(1) for k in range(BITS)]).astype(np.uint8)
    return np.packbits(bit.reshape(SKETCH, 64), axis=1, bitorder="little").view(np.int64).ravel()


def parity(h):
    """For each of 64 * PARITY places whether an odd number of the hashes falls there."""
    import numpy as np

    odd = (np.bincount((h & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def allowed_bits(similarity: float) -> int:
    """Bits in which the sketches of two sets of at least that similarity may differ, up to ERRORS standard errors.

    Each of n values differs with chance 1 - similarity, and then each of its
    bits with one half.
    """
    n, q = 2 * PERMUTATIONS, 1 - similarity
    mean, var = n * q * BITS / 2, n * (q * BITS / 4 + q * (1 - q) * BITS**2 / 4)
    return int(mean + ERRORS * var**0.5) + 1


def signatures(docs: DataFrame, ngram: int) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, th, sid, n_shingles, bands, sketch)``, minima's and maxima's sketch and parity in one array; digests of the text and of the set, the latter null for an empty one."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        none, made = np.zeros(0, np.int64), permutations()
        for part in slices(batches):
            sets = [np.unique(shingle_hashes(t, ngram)) for t in part.column(1).to_pylist()]
            values = [signature(h, *made) if len(h) else None for h in sets]
            cols = [
                part.column(0),
                part.column(2),
                pa.array([xxhash.xxh3_128_hexdigest(h.tobytes()) if len(h) else None for h in sets], pa.string()),
                pa.array([len(h) for h in sets], pa.int64()),
                _lists([none if v is None else bands(v) for v in values]),
                _lists([none if v is None else np.concatenate([sketch(v), parity(h)]) for v, h in zip(values, sets, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "sid", "n_shingles", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of(docs).alias("text")).withColumn("th", F.md5("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, th string, sid string, n_shingles long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, ngram: int) -> DataFrame:
    """``(node, h)``: the sorted shingle hashes of the written ``nodes(node, th, low)``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in slices(batches, 64):
            sets = [np.unique(shingle_hashes(t, ngram)).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets)], names=["node", "h"])

    return materialise(_texts(docs, nodes).mapInArrow(run, "node long, h array<long>").dropDuplicates(["node"]))


def _similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, ngram: int, similarity: float) -> DataFrame:
    """The written ``pairs(a, b)`` whose full shingle sets reach the similarity.  A set is made and shuffled as hashes, its text is not."""
    thousandths = round(1000 * similarity)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in slices(batches, 64):
            keep = []
            for i in range(part.num_rows):
                x, y = (part.column(c)[i].values.to_numpy() for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(1000 * both >= thousandths * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    used = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = _sets(docs, materialise(nodes.select("node", "th", "low").join(_few(used), "node")), ngram)
    side = lambda x: sets.select(F.col("node").alias(x), F.col("h").alias(f"h{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb")
    return materialise(both.mapInArrow(run, "a long, b long"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs of nodes that are in different classes, with these; ``comp`` is written."""
    few = _few(comp)
    of = lambda x: few.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return named.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")


def _bits(first: int, last: int) -> Column:
    """Bits in which the longs s{first} to s{last - 1} of two rows, suffixed a and b, differ."""
    return reduce(lambda p, q: p + q, [F.bit_count(F.col(f"s{i}a").bitwiseXOR(F.col(f"s{i}b"))) for i in range(first, last)])


def _close(similarity: float) -> Column:
    """Whether rows with m and sketch columns, suffixed a and b, may reach the similarity.

    By sizes, by sketches up to their error, and by parities: sets of that
    similarity differ in at most (1 - s) / (1 + s) of all their entries.
    """
    alike = F.least("ma", "mb") >= F.lit(similarity) * F.greatest("ma", "mb") - 1e-6
    few = _bits(SKETCH, SKETCH + PARITY) <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("ma") + F.col("mb")) + 1e-6
    return alike & (_bits(0, SKETCH) <= allowed_bits(similarity)) & few


def _pairs_apart(buckets: DataFrame, nodes: DataFrame, comp: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, d)``: pairs of different classes that share a bucket and may reach the similarity, and their differing bits.

    One class of a bucket, that of its centre, is met by the others only and
    not by itself; the others are dealt in parts of about SALT, and each part
    meets the whole bucket.  Sizes, sketches and parities are tried within the join,
    and a pair stays in the first of its buckets only.
    """
    named = buckets.join(_few(comp), "node", "left").select("band", "key", "node", "centre", F.coalesce("component", "node").alias("c"))
    mixed = named.groupBy("band", "key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max(F.when(F.col("node") == F.col("centre"), F.col("c"))).alias("main")).where("c0 <> c1").select("band", "key", "main")
    sketches = nodes.select("node", "m", "bands", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH + PARITY)])
    named = materialise(named.drop("centre").join(mixed, ["band", "key"]).join(sketches, "node"))
    parts = named.where("c <> main").groupBy("band", "key").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts")).where("parts > 1")
    named = named.join(_few(materialise(parts)), ["band", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    side = lambda df, x: df.select("band", "key", "salt", *[F.col(k).alias(f"{k}{x}") for k in ("node", "m", "c", "bands", *[f"s{i}" for i in range(SKETCH + PARITY)])], *(["main"] if x == "b" else []))
    left = side(named.where("c <> main").withColumn("salt", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")), "a")
    right = side(named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "b")
    apart = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("nodea") < F.col("nodeb")))
    same = reduce(lambda p, q: p & q, [left[k] == right[k] for k in ("band", "key", "salt")])
    before = [F.slice(f"bands{x}", F.lit(1), left["band"]) for x in "ab"]
    again = F.exists(F.zip_with(*before, lambda x, y: x == y), lambda x: x)  # the pair has met in an earlier band
    met = left.join(right, same & apart & _close(similarity) & ~again)
    return met.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b"), _bits(0, SKETCH).alias("d"))


def similar_classes(docs: DataFrame, ngram: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_shingles, component_id, kept)`` by Jaccard similarity of n-word shingle sets.

    Equal sets are one node.  Each permutation gives two signature values, its
    minimum and its maximum; nodes with an equal band of values share a bucket.
    First each node is verified against one centre, that of most of its buckets;
    a bucket's centre is the node that meets most others in all its own buckets,
    in a group of edited copies the original.  Then every pair of different
    classes in every bucket is tried, filtered by set sizes, sketches and parities:
    first the closest pair of each two classes, then those still
    apart.  The full sets decide every link.

    A text of fewer than n words is one shingle.  Null texts and texts without
    words are empty, linked with nothing, and their component_id is their own
    doc_id.  Repeated rows share a class; a row with a null doc_id gets its
    class's least id, null if there is none, and is never kept; an empty table
    gives no rows.  Only doc_id and text are read.
    """
    rows = materialise(signatures(docs, ngram))
    found = rows.where("sid is not null").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th")).alias("low"), F.first("n_shingles").alias("m"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    found = found.select("sid", F.col("low.doc_id").alias("low"), F.col("low.th").alias("th"), "m", "bands", "sketch")
    nodes = materialise(found.withColumn("node", F.monotonically_increasing_id()))
    dealt = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = dealt.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(dealt.join(shared, ["band", "key"]))
    meets = materialise(met.groupBy("node").agg(F.sum("n").alias("meets")))
    met = met.join(_few(meets), "node")
    centres = met.groupBy("band", "key").agg(F.max_by("node", F.struct("meets", "node")).alias("centre"))
    buckets = materialise(met.join(centres, ["band", "key"]))

    nearest = buckets.where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("b"))
    links = _similar(docs, nodes, materialise(nearest.select(F.col("node").alias("a"), "b")), ngram, similarity)
    comp = materialise(components(links))
    near = materialise(_pairs_apart(buckets, nodes, comp, similarity))
    best = _apart(near, comp).groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min(F.struct("d", "a", "b")).alias("p"))
    best = materialise(best.select("p.a", "p.b"))
    if not best.isEmpty():
        links = links.union(_similar(docs, nodes, best, ngram, similarity))
        comp = materialise(components(links))
        rest = materialise(_apart(near.join(_few(best), ["a", "b"], "left_anti"), comp).select("a", "b"))
        if not rest.isEmpty():
            links = links.union(_similar(docs, nodes, rest, ngram, similarity))
            comp = materialise(components(links))

    own = nodes.select("sid", "low", "node").join(comp, "node", "left").select("sid", "low", F.coalesce("component", "node").alias("component"))
    low = own.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = own.join(low, "component").select("sid", "component_id")
    full = rows.where("sid is not null").join(ids, "sid").select("doc_id", "n_shingles", "component_id")
    full = full.union(rows.where("sid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return full.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
