"""SimHash fingerprints and near-duplicate classes with pivot distance tables."""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.common import materialise, slices, text_of, whole_row
from voxelmill.llm.graph import components

SEED = 42
PIVOTS = 16
#: A bucket with more members than this takes the linear path.
LIGHT = 64
#: 64 bits in five blocks: two differing bits leave three blocks as they were.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def pivot(i: int) -> int:
    """The i-th reference fingerprint: the first 64 bits of an MD5 digest, as a signed long."""
    return _signed(int(hashlib.md5(f"pivot {i}".encode()).hexdigest()[:16], 16))


def pivot_table(fp: Column, n: int = PIVOTS) -> list[Column]:
    """Hamming distances of ``fp`` to ``n`` pivots, eight 7-bit distances to a long."""
    d = [F.bit_count(fp.bitwiseXOR(F.lit(pivot(i)))).cast("long") for i in range(n)]
    return [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(x, 7 * k) for k, x in enumerate(d[i : i + 8])]) for i in range(0, n, 8)]


def pivots_allow(a: list[Column], b: list[Column], radius: int) -> Column:
    """Whether no pivot's distances differ by more than ``radius`` (else the triangle inequality rules the pair out)."""
    one = lambda x, k: F.shiftright(x, 7 * k).bitwiseAND(F.lit(127))
    return reduce(lambda p, q: p & q, [F.abs(one(x, k) - one(y, k)) <= radius for x, y in zip(a, b, strict=True) for k in range(8)])


def shingle_hashes(text: str, n: int):
    """XXH64 of the text's n-word shingles (A-Z lower-cased; fewer words: one shingle)."""
    import numpy as np
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) <= n:
        return np.array([h(join(w), SEED)], np.uint64)
    return np.fromiter((h(join(s), SEED) for s in zip(*(w[i:] for i in range(n)), strict=False)), np.uint64, len(w) - n + 1)


def majority(h) -> int:
    """The 64-bit integer whose bit is set where over half of ``h`` have it set; 0 for no hashes."""
    import numpy as np

    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = np.ascontiguousarray(h[i : i + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp)``; null and wordless texts get 0."""

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            fp = [_signed(majority(shingle_hashes(t, ngram))) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _buckets(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in buckets of 2 to LIGHT members, and rows in larger ones."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(sizes, keys)
    return rows.where(F.col("_n") <= LIGHT).drop("_n"), rows.where(F.col("_n") > LIGHT).drop("_n")


def links_within_two(fps: DataFrame) -> DataFrame:
    """All links ``(a, b)`` needed to connect the distinct ``fps(fp)`` at Hamming distance 2 or less.

    Fingerprints meet in buckets: two differing bits leave three of five blocks
    equal.  In a bucket of at most LIGHT members each pair is tried: the pivot
    table discards it by its largest coordinate difference, and survivors are
    verified.  Members of larger buckets are linked through centres instead:
    each goes to itself and its 64 one-bit neighbours; those that share a
    centre are at most 2 apart, and a centre has at most 65.  Nothing is capped.
    """
    mask = [((1 << n) - 1) << at for at, n in BLOCKS]
    combos = [_signed(sum(mask[i] for i in c)) for c in itertools.combinations(range(5), 3)]
    p = [c.alias(f"p{i}") for i, c in enumerate(pivot_table(F.col("fp")))]
    names = [f"p{i}" for i in range(len(p))]
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for i, m in enumerate(combos)])
    rows = fps.select("fp", *p).select("fp", *names, F.explode(keys).alias("k")).select("k.c", "k.m", "fp", *names)
    light, heavy = _buckets(rows, ["c", "m"])
    a = light.select("c", "m", F.col("fp").alias("a"), *[F.col(x).alias(f"a{x}") for x in names])
    b = light.select("c", "m", F.col("fp").alias("b"), *[F.col(x).alias(f"b{x}") for x in names])
    near = (
        a.join(b, ["c", "m"])
        .where("a < b")
        .where(pivots_allow([F.col(f"a{x}") for x in names], [F.col(f"b{x}") for x in names], 2))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
        .select("a", "b")
    )
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    stars = heavy.select("fp").distinct().select("fp", F.explode(around).alias("centre")).groupBy("centre").agg(F.collect_list("fp").alias("near")).where("size(near) > 1")
    stars = stars.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b")
    return near.union(stars)


def near_duplicate_classes(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp, component_id)`` at Hamming distance 2 or less.

    component_id is the smallest doc_id reachable over links.  Null texts are
    empty; texts without words share fingerprint 0; equal texts and repeated
    rows share a class; rows with a null doc_id take part and get their class's
    id (null if no row of it has one); an empty table gives no rows.
    """
    rows = materialise(fingerprints(docs, ngram))
    own = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    comp = components(links_within_two(own.select("fp")))
    own = own.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    low = own.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = own.join(low, "component").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


# --- classes by similarity: candidates from prefixes, long fingerprints, exact Jaccard ---------

#: 64-bit words of a long fingerprint.
WORDS = 16
#: Shingles of the smaller text from which the filter's radius is that of so many.
FEW = 256
#: Nodes that share a hashed prefix entry from which the entry is common, and its nodes are dealt anew by document frequency.
COMMON = 100
PIVOT_NAMES = [f"p{i}" for i in range(4)]
#: Times that common entries are sought and moved to the end of the order, and how many at most (8 bytes each in a task).
#: They only choose the order, so results do not depend on them.
ROUNDS, MOST = 2, 1_000_000
#: Nodes that are broadcast to look up their texts (about 60 bytes each); more are joined by a shuffle.
BROADCAST_NODES = 400_000
#: Members of a large group that one part of it takes on one side.
SALT = 256


@functools.cache
def allowed_difference(similarity: float) -> tuple[int, ...]:
    """Bits in which long fingerprints may differ, by the smaller number of shingles (from FEW on the last entry holds).

    Over all sizes of two sets, the chance that a bit differs at the least
    overlap with that similarity, exactly; an entry is the expected number of
    such bits and six standard errors, so that the radius only filters.
    """
    import numpy as np

    def odds(n):
        return np.exp([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(n + 1)])

    def is_set(m, both, c):
        """Chance that a set's bit is set if c of its ``both`` common shingles have it set."""
        tail = np.cumsum(odds(m - both)[::-1])[::-1]
        need = m // 2 + 1 - c
        return np.where(need > m - both, 0, tail[np.clip(need, 0, m - both)])

    chance = np.zeros(FEW + 1)
    for m1 in range(1, FEW + 1):
        sizes = range(m1, math.floor(m1 / similarity + 1e-9) + 1)
        for m2 in sizes if m1 <= 64 else {m1, (sizes[0] + sizes[-1]) // 2, sizes[-1] - 1, sizes[-1]}:
            both = math.ceil(similarity / (1 + similarity) * (m1 + m2) - 1e-9)
            p, q = (is_set(m, both, np.arange(both + 1)) for m in (m1, m2))
            chance[m1] = max(chance[m1], (odds(both) * (p * (1 - q) + q * (1 - p))).sum())
    chance = np.maximum.accumulate(chance[::-1])[::-1]
    bits = 64 * WORDS
    return tuple(math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p))) for p in chance)


def _near(similarity: float, x: str, y: str) -> Column:
    """Whether rows with ``w``, ``m`` and pivot distances, suffixed x and y, may reach the similarity; the pivot table goes first."""
    radius = F.get(F.lit(list(allowed_difference(similarity))), F.least(F.col(f"m{x}"), F.col(f"m{y}"), F.lit(FEW)).cast("int"))
    close = reduce(lambda p, q: p & q, [F.abs(F.col(f"{n}{x}") - F.col(f"{n}{y}")) <= radius for n in PIVOT_NAMES])
    return close & (_differing(x, y) <= radius)


def _differing(x: str, y: str) -> Column:
    return reduce(lambda p, q: p + q, [F.bit_count(F.col(f"w{x}")[i].bitwiseXOR(F.col(f"w{y}")[i])) for i in range(WORDS)])


def shingle_set(text: str, n: int):
    """The different shingle hashes of a text in rising order; a text without words has the single entry 0."""
    import numpy as np

    h = np.unique(shingle_hashes(text, n))
    return h if len(h) else np.zeros(1, np.uint64)


def prefix_size(m: int, similarity: float) -> int:
    """Entries of a set of m, in any order common to all sets, of which a set of that similarity has one among its own first ones."""
    return m - math.ceil(similarity * m - 1e-9) + 1


def _prefix(h, common, similarity: float):
    """The set's prefix (as longs) in the order of the hashes, those of the sorted array ``common`` last."""
    import numpy as np

    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        late = common[at] == h
        h = np.concatenate([h[~late], h[late]])
    return h[: prefix_size(len(h), similarity)].view(np.int64)


def _lists(arrays):
    import numpy as np
    import pyarrow as pa

    at = pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32())
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]), pa.int64()))


def long_fingerprints(texts: DataFrame, ngram: int, similarity: float) -> DataFrame:
    """``texts(node, text, th, low)`` to ``(node, th, low, w, prefix, m)``: WORDS fingerprints from remixed hashes of the shingle set, the set's prefix in the order of the hashes, its size."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def mixed(h, k):
            h = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return h ^ (h >> np.uint64(31))

        for part in slices(batches):
            sets = [shingle_set(t, ngram) for t in part.column(1).to_pylist()]
            w = [[_signed(majority(mixed(h, k))) for k in range(1, WORDS + 1)] for h in sets]
            prefix = _lists([_prefix(h, (), similarity) for h in sets])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(w, pa.list_(pa.int64())), prefix, pa.array(map(len, sets), pa.int64())], names=["node", "th", "low", "w", "prefix", "m"])

    return texts.mapInArrow(run, f"node long, th string, low {texts.schema['low'].dataType.simpleString()}, w array<long>, prefix array<long>, m long")


def _few(nodes: DataFrame) -> DataFrame:
    """Written ``nodes`` with a broadcast hint if they are at most BROADCAST_NODES."""
    return F.broadcast(nodes) if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else nodes


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, text, th, low)`` of ``nodes(node, th, low)``, repeated where document rows are; documents are shuffled only if the nodes are many."""
    side = _few(nodes.select("node", F.col("th").alias("_th"), "low"))
    texts = docs.select("doc_id", text_of(docs).alias("text")).withColumn("th", F.md5("text"))
    return texts.join(side, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("low"))).select("node", "text", "th", "low")


def _prefixes(docs: DataFrame, nodes: DataFrame, repeated: bool, ngram: int, similarity: float) -> DataFrame:
    """``nodes(node, th, low, m, prefix)`` with common entries last in the order of the prefixes.

    The prefix of a set without a common entry in it stays as it is, so that
    only texts with one are read again.  ``repeated``: a text may be found twice.
    """
    import numpy as np

    spark = docs.sparkSession
    now, common = nodes.select("node", "th", "low", "m", "prefix"), np.zeros(0, np.uint64)
    kind = f"node long, th string, low {nodes.schema['low'].dataType.simpleString()}, m long, prefix array<long>"
    for _ in range(ROUNDS):
        often = now.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > COMMON)
        keys = often.orderBy(F.desc("n"), "key").limit(MOST).select("key").toArrow().column(0).to_numpy().view(np.uint64)
        new = np.setdiff1d(keys, common)[: MOST - len(common)]
        if not len(new):
            break
        common = np.union1d(common, new)
        shared = spark.sparkContext.broadcast(common)
        found = spark.createDataFrame([(k,) for k in new.view(np.int64).tolist()], "key long")
        again = now.select("node", "th", "low", F.explode("prefix").alias("key")).join(F.broadcast(found), "key", "left_semi")
        again = materialise(again.select("node", "th", "low").distinct())

        def run(batches, shared=shared):
            import pyarrow as pa

            for part in slices(batches):
                sets = [shingle_set(t, ngram) for t in part.column(1).to_pylist()]
                cols = [part.column(0), part.column(2), part.column(3), pa.array(map(len, sets), pa.int64()), _lists([_prefix(h, shared.value, similarity) for h in sets])]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "th", "low", "m", "prefix"])

        moved = _texts(docs, again).mapInArrow(run, kind)
        moved = moved.dropDuplicates(["node"]) if repeated else moved
        now = materialise(now.join(_few(again.select("node")), "node", "left_anti").union(moved))
    return now


def _exactly(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, ngram: int, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets have at least the Jaccard similarity; both texts of a pair meet."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in slices(batches, 64):
            keep = []
            for t, u in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                x, y = shingle_set(t, ngram), shingle_set(u, ngram)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    used = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = materialise(_texts(docs, materialise(nodes.select("node", "th", "low").join(_few(used), "node"))))
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    return materialise(both.mapInArrow(run, "a long, b long"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs of nodes that are in different classes, with their classes; ``comp`` is written."""
    few = _few(comp)
    of = lambda x: few.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return named.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, links: DataFrame | None, ngram: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``links`` and those of the written ``pairs`` that are similar, and the classes of them all."""
    found = _exactly(docs, nodes, pairs, ngram, similarity)
    links = found if links is None else links.union(found)
    return links, materialise(components(links))


def _groups(rows: DataFrame) -> DataFrame:
    """``rows(key, node, m, r, ...)`` of keys with two nodes or more, with their number ``n``."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(sizes, "key")


def _by_frequency(docs: DataFrame, hot: DataFrame, ngram: int, similarity: float) -> DataFrame:
    """``(key, node, m, r)``: the prefixes of the sets of ``hot(node, th, low, m)`` in the order of document frequency among them.

    Entries of a single set come first and meet no other, so only their number
    counts.  ``r`` is how many entries are left from this one on.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in slices(batches, 64):
            for node, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                h = shingle_set(t, ngram).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node, np.int64)), pa.array(h)], names=["node", "h"])

    sets = _texts(docs, hot).mapInArrow(run, "node long, h long")
    often = sets.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = sets.join(often, "h").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("df", "h"))).alias("s"))
    shared = shared.join(hot.select("node", "m"), "node").withColumn("alone", F.col("m") - F.size("s"))
    size = F.col("m") - F.ceil(F.lit(similarity) * F.col("m") - 1e-9) + 1
    shared = shared.withColumn("s", F.slice("s", 1, F.greatest(F.lit(0), size - F.col("alone")).cast("int")))
    return shared.select("node", "m", "alone", F.posexplode("s").alias("i", "x")).select(F.col("x.h").alias("key"), "node", "m", (F.col("m") - F.col("alone") - F.col("i")).alias("r"))


def prefix_groups(docs: DataFrame, nodes: DataFrame, repeated: bool, ngram: int, similarity: float) -> DataFrame:
    """Groups ``(level, key, node, m, r, n, hot)`` in which every two nodes of that similarity meet; pairs of two hot nodes are left to level 1.

    Two sets of similarity s share an entry among the first
    ``m - ceil(s m) + 1`` of each, in any order common to both.  The order of
    the hashes, common entries last, comes first, as it moves little data.
    Nodes that still share an entry with more than COMMON others are hot: among
    themselves they meet in groups by exact document frequency instead, rare
    entries first (``level`` 1).  A hot node still meets the others by its
    hashed prefix.  Nothing is left out at any size.
    """
    rows = _prefixes(docs, nodes, repeated, ngram, similarity).select("node", "m", F.posexplode("prefix").alias("i", "key")).select("key", "node", "m", (F.col("m") - F.col("i")).alias("r"))
    met = materialise(_groups(rows))
    hot = materialise(met.where(F.col("n") > COMMON).select("node").distinct())
    plain = met.where(F.col("n") <= COMMON).join(hot.withColumn("hot", F.lit(True)), "node", "left")
    plain = plain.select(F.lit(0).alias("level"), "key", "node", "m", "r", "n", F.coalesce("hot", F.lit(False)).alias("hot"))
    again = _groups(_by_frequency(docs, materialise(nodes.select("node", "th", "low", "m").join(hot, "node")), ngram, similarity))
    return materialise(plain.union(again.select(F.lit(1), "key", "node", "m", "r", "n", F.lit(False))))


def _candidates(pairs: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, d)``: the pairs of nodes whose long fingerprints allow the similarity, and their differing bits."""
    side = lambda x: table.select(F.col("node").alias(x), *[F.col(k).alias(f"{k}_{x}") for k in ("w", "m", *PIVOT_NAMES)])
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_near(similarity, "_a", "_b")).select("a", "b", _differing("_a", "_b").alias("d"))


def _pairs_apart(groups: DataFrame, comp: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of different classes that meet in a group and may reach the similarity by their sizes and places.

    Sets of m1 and m2 entries with similarity s share s / (1 + s) * (m1 + m2);
    from a common entry on at most the lesser r can be common, and at the first
    common one this bounds all.  Members of a large group's main class (its
    centre's) need no pairs among themselves, so one side holds the others only,
    dealt in parts.
    """
    least = similarity / (1 + similarity)
    named = groups.join(_few(comp), "node", "left").select("level", "key", "node", "m", "r", "hot", "n", F.coalesce("component", "node").alias("c"))
    sizes = named.groupBy("level", "key").agg(F.min("m").alias("least_m"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(F.struct(F.col("m") - F.col("r"), "node", "c")).alias("centre")).where("c0 <> c1")
    sizes = sizes.select("level", "key", "least_m", F.col("centre.c").alias("main"))
    named = named.join(sizes, ["level", "key"])
    named = named.where(F.col("r") >= least * (F.col("m") + F.greatest("least_m", F.ceil(F.col("m") * similarity - 1e-9))) - 1e-6)
    # the main class of a small group is not told apart
    named = materialise(named.withColumn("main", F.when(F.col("n") > COMMON, F.col("main")).otherwise(F.lit(-1))).drop("least_m"))
    # the others of a large group go to several parts, which all its members meet
    parts = materialise(named.where("c <> main and main <> -1").groupBy("level", "key").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts")).where("parts > 1"))
    all_ = named.join(_few(parts), ["level", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    others = all_.where("c <> main")
    side = lambda df, x: df.select("level", "key", "salt", *[F.col(k).alias(f"{k}{x}") for k in ("node", "m", "r", "c", "hot")], *(["main"] if x == "b" else []))
    left = side(others.withColumn("salt", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")), "a")
    right = side(all_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "b")
    may = F.least("ra", "rb") >= F.lit(least) * (F.col("ma") + F.col("mb")) - 1e-6
    alike = F.least("ma", "mb") >= F.lit(similarity) * F.greatest("ma", "mb") - 1e-6
    met = left.join(right, ["level", "key", "salt"]).where("ca <> cb and (cb = main or nodea < nodeb) and not (hota and hotb)").where(may & alike)
    return met.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct()


def similar_classes(docs: DataFrame, ngram: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, th, component_id, class)`` by similarity of n-word shingle sets.

    Equal texts are one node.  Different texts meet where the prefixes of their
    shingle sets do, which misses no pair of that similarity.  The pivot table
    discards pairs by coordinate difference, then the differing bits of the long
    fingerprints do, at a radius that only filters; the Jaccard similarity of
    the sets decides.

    In groups of more than COMMON nodes each is tried against the group's centre
    first, the node with the fewest rarer entries, which in a group of edited
    copies is nearest to the original; then every pair of different classes in
    every group is tried.  Null texts are empty; texts without words are equal.
    """
    rows = materialise(docs.select("doc_id", F.md5(text_of(docs)).alias("th")))
    ids = materialise(rows.groupBy("th").agg(F.min("doc_id").alias("low")).withColumn("node", F.monotonically_increasing_id()))
    nodes = materialise(long_fingerprints(_texts(docs, ids), ngram, similarity))
    repeated = nodes.count() > ids.count()
    if repeated:
        nodes = materialise(nodes.dropDuplicates(["node"]))
    table = nodes.select("node", "th", "low", "w", "m", *[c.alias(n) for n, c in zip(PIVOT_NAMES, _long_pivots(), strict=True)])
    groups = prefix_groups(docs, nodes, repeated, ngram, similarity)

    # each node of a large group and the centre nearest to it
    large = groups.where(F.col("n") > COMMON)
    centres = large.groupBy("level", "key").agg(F.min(F.struct(F.col("m") - F.col("r"), "node")).alias("c")).select("level", "key", F.col("c.node").alias("centre"))
    pairs = large.join(centres, ["level", "key"]).where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    nearest = _candidates(pairs, table, similarity).groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    links, comp = _linked(docs, nodes, materialise(nearest), None, ngram, similarity)
    # all pairs of different classes: first the closest of each two classes, then those that are still apart
    near = materialise(_apart(_candidates(_pairs_apart(groups, comp, similarity), table, similarity), comp))
    best = materialise(near.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min(F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b"))
    links, comp = _linked(docs, nodes, best, links, ngram, similarity)
    rest = materialise(_apart(near.select("a", "b").join(_few(best), ["a", "b"], "left_anti"), comp).select("a", "b"))
    if not rest.isEmpty():
        comp = _linked(docs, nodes, rest, links, ngram, similarity)[1]

    own = nodes.select("th", "low", "node").join(comp, "node", "left").select("th", "low", F.coalesce("component", "node").alias("component"))
    low = own.groupBy("component").agg(F.min("low").alias("component_id"))
    return rows.select("doc_id", "th").join(own.join(low, "component").select("th", "component_id", F.col("component").alias("class")), "th")


def _long_pivots() -> list[Column]:
    """Distances of a long fingerprint to four reference fingerprints."""
    return [reduce(lambda x, y: x + y, [F.bit_count(F.col("w")[i].bitwiseXOR(F.lit(pivot(WORDS * k + i)))) for i in range(WORDS)]) for k in range(4)]


def one_of_each(docs: DataFrame, ngram: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near-duplicates: of each class the row with the smallest doc_id stays, as it is.

    A null doc_id comes last, then the smaller text digest goes first; of rows
    that agree in both, the one whose JSON is smallest stays.  Null and empty
    texts and those of white space are one class.  All columns stay whatever
    their names; only doc_id and text take part.  An empty table gives none.
    """
    classes = materialise(similar_classes(docs, ngram, similarity).groupBy("class", "doc_id", "th").agg(F.count("*").alias("n")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th", "n")).alias("best")
    keep = materialise(classes.groupBy("class").agg(best).select(F.col("best.doc_id").alias("id"), F.col("best.th").alias("th0"), F.col("best.n").alias("n")))
    rows = docs.select(whole_row(docs).alias("row"), F.md5(text_of(docs)).alias("th"), docs["doc_id"].alias("doc_id"))
    on = lambda k: rows.join(k, (F.col("th") == F.col("th0")) & F.col("doc_id").eqNullSafe(F.col("id")))
    kept = on(keep.where("n = 1")).select("row")
    repeated = keep.where("n > 1")
    if not repeated.isEmpty():
        kept = kept.union(on(repeated).groupBy("id", "th0").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return kept.select("row.*")
