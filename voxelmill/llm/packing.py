"""Packing token sequences: best-two-fit in shards of pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelmill.llm.common import materialise, slices, text_of

CAPACITY = 2048
#: Pieces that one task packs, about.
SHARD = 6_000
#: Sequences at least so full are final after the first pass; others are packed anew, so many shards' leftovers together.
FULL = 0.999
MERGE = 64
SPECIAL = "<|endoftext|>"


def read_tokenizer(json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> dict:
    """What tasks need to make ids: the tokenizer file's text and, if given, the same vocabulary as byte ranks.

    The ranks are a faster way to the same ids; texts with the special token's
    string always take the tokenizer itself.
    """
    import base64

    with open(json_path, encoding="utf-8") as f:
        spec = {"json": f.read(), "ranks": None, "pattern": pattern}
    if ranks_path:
        with open(ranks_path, "rb") as f:
            spec["ranks"] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return spec


def encoder(spec: dict):
    """text -> list of ids."""
    from tokenizers import Tokenizer

    plain = None

    def exact(text):
        nonlocal plain
        if plain is None:
            plain = Tokenizer.from_str(spec["json"])
        return plain.encode(text, add_special_tokens=False).ids

    if not spec["ranks"]:
        return exact
    import tiktoken

    fast = tiktoken.Encoding("ranks", pat_str=spec["pattern"], mergeable_ranks=spec["ranks"], special_tokens={}).encode_ordinary
    return lambda text: exact(text) if SPECIAL in text else fast(text)


def pieces(docs: DataFrame, spec: dict, capacity: int = CAPACITY) -> DataFrame:
    """``docs(doc_id, text)`` to pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32.

    A document's ids end with id 0.  Only longer ones are cut; then the first
    piece takes the remainder and the others are full.  Null text is empty: one
    piece with the id 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = encoder(shared.value)
        for part in slices(batches):
            rows, at = [], []
            for i, t in enumerate(part.column(1).to_pylist()):
                ids = np.asarray([*encode(t), 0], "<u4")
                start, n = 0, len(ids)
                for k in range(-(-n // capacity)):
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    rows.append((k, start, size, zlib.crc32(ids[start : start + size].tobytes())))
                    at.append(i)
                    start += size
            cols = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    )


def best_two_fit(lengths, capacity: int) -> list[list[int]]:
    """Bins of indices into ``lengths`` (1..capacity each).

    A bin is filled greedily with the longest that fits.  If a gap is left, its
    smallest member gives way to two unpacked ones that fill the member and the
    gap more tightly, if there are such.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths):
        free[n].append(i)
    # bit n: a length n is unpacked; mirrored: bit capacity - n
    mask = sum(1 << n for n in range(capacity + 1) if free[n])
    mirror = sum(1 << (capacity - n) for n in range(capacity + 1) if free[n])
    bins = []

    def take(n: int) -> int:
        nonlocal mask, mirror
        i = free[n].pop()
        if not free[n]:
            mask &= ~(1 << n)
            mirror &= ~(1 << (capacity - n))
        return i

    while mask:
        members, gap = [], capacity
        while gap and (fit := mask & ((2 << gap) - 1)):
            n = fit.bit_length() - 1
            members.append(take(n))
            gap -= n
        if gap and mask:
            small = lengths[members[-1]]
            for total in range(gap + small, small, -1):
                both = mask & (mirror >> (capacity - total)) & ((1 << total) - 1)
                if total % 2 == 0 and both >> (total // 2) & 1 and len(free[total // 2]) < 2:
                    both &= ~(1 << (total // 2))
                if both:
                    n = both.bit_length() - 1
                    back = members.pop()
                    members += [take(n), take(total - n)]
                    if not free[small]:
                        mask |= 1 << small
                        mirror |= 1 << (capacity - small)
                    free[small].append(back)
                    break
        bins.append(members)
    return bins


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (with ``length``) to the same rows with sequence_id and offset.

    Shards of about SHARD pieces, dealt by row number, are packed each in a
    task; sequences that are not full are dissolved and packed again together
    with those of MERGE shards in all.  Memory of a task is bounded by these two.
    """
    parts = materialise(parts.withColumn("_row", F.monotonically_increasing_id()))
    shards = max(1, parts.count() // SHARD)
    names = parts.columns
    out = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_shard", T.LongType())])

    def packed(level: int):
        def run(key, table):
            import numpy as np
            import pyarrow as pa

            lengths = table.column("length").to_pylist()
            order, seq, off = [], [], []
            for b, members in enumerate(best_two_fit(lengths, capacity)):
                fill = sum(lengths[i] for i in members)
                done = level or fill >= FULL * capacity
                at = 0
                for i in members:
                    order.append(i)
                    seq.append((key[0].as_py() << 25 | b << 1 | level) if done else None)
                    off.append(at)
                    at += lengths[i]
            got = table.select(names).take(pa.array(np.array(order, np.int64)))
            extra = [pa.array(seq, pa.int64()), pa.array(off, pa.int64()), pa.array([key[0].as_py()] * len(order), pa.int64())]
            return pa.Table.from_arrays([*got.columns, *extra], schema=pa.schema([*got.schema, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("_shard", pa.int64())]))

        return run

    dealt = parts.withColumn("_s", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    first = materialise(dealt.groupBy("_s").applyInArrow(packed(0), out))
    rest = first.where("sequence_id is null").select(*names, F.floor(F.col("_shard") / MERGE).cast("long").alias("_s"))
    second = rest.groupBy("_s").applyInArrow(packed(1), out)
    return first.where("sequence_id is not null").union(second).drop("_row", "_shard")


def pack_documents(docs: DataFrame, spec: dict, capacity: int = CAPACITY) -> DataFrame:
    """All documents' pieces with their sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed each, a null doc_id stays null, an empty table gives
    no rows, other columns are ignored.
    """
    return pack(pieces(docs, spec, capacity), capacity)
