"""Packing, sharding and quote linking as a whole, against brute force and SQL."""

import collections
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from voxelmill.llm import extraction, packing, queries, quotes, sharding


@pytest.mark.parametrize("shard", [40, 10_000])
def test_sequences_are_gapless_and_few(spark, monkeypatch, shard):
    """In many shards, whose leftovers are packed again, and in one."""
    rng = np.random.default_rng(21)
    texts = ["word " * int(n) for n in rng.integers(0, 900, 260)] + ["word " * 5000, "", None, "", "a"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "x"), (0, texts[0])], "doc_id long, text string")
    monkeypatch.setattr(packing, "SHARD", shard)
    rows = packing.pack_documents(docs, queries.byte_bpe()).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at and length >= 1
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert math.ceil(total / 2048) <= len(bins) <= math.ceil(total / 2048) * 1.03 + 1
    whole = {r.doc_id: r for r in rows if r.doc_id in (1, 2, 3)}
    assert all(r.start == 0 for r in whole.values()) and sum(r.doc_id is None for r in rows) == 1


def test_bids_by_brute_force(spark):
    weights, grown = [1.0, 2.0, 0.5], [1.0, 2.0, 0.5, 3.0]

    def lowest(key, w):
        def bid(i):
            h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), xxhash.xxh64_intdigest(key.encode(), 42)) >> 11
            return -math.log((h + 0.5) / 2**53) / w[i]

        return min(range(len(w)), key=bid)

    ids = [*range(-5, 800), 2**62, None, None, 7]
    docs = spark.createDataFrame([(i, None, "x", 9) for i in ids], "doc_id long, text string, shard string, slot int")
    got = sharding.shard_records(docs, weights, grown).collect()
    assert sorted((r.doc_id or 0) for r in got) == sorted((i or 0) for i in ids)
    for r in got:
        key = "null" if r.doc_id is None else f"k{r.doc_id}"
        assert (r.shard, r.grown_shard, r.size, r.law) == (lowest(key, weights), lowest(key, grown), 1, "key")


def conversations():
    """Turns that quote an earlier turn with what it quotes, to depth 3; own lines do not repeat in a conversation."""
    rng = np.random.default_rng(22)
    rows = []
    for c in range(60):
        said = []
        for t in range(int(rng.integers(1, 9))):
            own = [f"turn {t} line {k}  of  {'Ab é𝄞'[int(rng.integers(5))]}" for k in range(int(rng.integers(0, 4)))]
            quoted = []
            if t and rng.random() < 0.8:
                for line in said[int(rng.integers(t))].split("\n"):
                    if line and not line.startswith(">>>") and not line.endswith("wrote:"):
                        quoted.append((">" if line.startswith(">") else "> ") + (line.upper() if rng.random() < 0.3 else line))
                if rng.random() < 0.5 and quoted:
                    quoted.insert(0, "Joe wrote:")
            parts = [quoted, own] if rng.random() < 0.7 else [own[:1], quoted, own[1:]]
            said.append("\n".join(x for p in parts for x in p))
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", said[-1]))
    return [*rows, (100, 0, None, None), (101, 0, "user", "> nothing said\n\n>> it")]


def test_quotes_to_depth_three_as_in_sql(spark):
    rows = conversations()
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    want = con.execute(quotes.ORACLE_SQL).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].astype(object).where(x[cols].notna(), None).sort_values(["conv_id", "turn"]).reset_index(drop=True) for x in (got, want))
    assert got.max_depth.max() >= 3 and got.reply_to.notna().sum() > 100
    assert got.map(lambda x: int(x) if isinstance(x, float) else x).equals(want.map(lambda x: int(x) if isinstance(x, float) else x))


def test_pages_and_messages_take_odd_rows_and_clashing_columns(spark):
    page = "page_id long, url string, html string, path string, host string, text string, n_chars int, _h int, container string"
    odd = [(1, None, "<p>a", *"xyz", 1, 2, "c"), (1, None, "<p>a", *"xyz", 1, 2, "c"), (None, "", None, None, None, None, None, None, None), (3, "http://[", "<div>" * 3000 + "deep", *"xyz", 1, 2, "c"), (4, "u", " \n ", *"xyz", 1, 2, "c")]
    got = extraction.extract_pages(spark.createDataFrame(odd, page)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (3, "deep", 4), (4, "", 0)]
    assert extraction.extract_pages(spark.createDataFrame([], page)).count() == 0
    talk = "conv_id long, turn long, role string, text string, _id long, h long, n_linked string, top int, lines string"
    odd = [(1, 0, "u", "hi", 1, 1, "a", 1, "l"), (1, 1, None, "> hi\n" * 2000, 1, 1, "a", 1, "l"), (1, 1, None, "> hi", 1, 1, "a", 1, "l"), (None, None, None, None, None, None, None, None, None), (1, None, "u", "> hi", 1, 1, "a", 1, "l")]
    got = quotes.link_quotes(spark.createDataFrame(odd, talk)).collect()
    assert collections.Counter((r.conv_id, r.turn, r.reply_to, r.n_quoted, r.n_linked) for r in got) == {(1, 0, None, 0, 0): 1, (1, 1, 0, 2000, 2000): 1, (1, 1, 0, 1, 1): 1, (None, None, None, 0, 0): 1, (1, None, None, 1, 0): 1}
    assert quotes.link_quotes(spark.createDataFrame([], talk)).count() == 0
