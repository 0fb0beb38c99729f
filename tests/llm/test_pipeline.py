"""The five stages, run over a small corpus with planted cases, against brute force."""

import collections
import itertools
import zlib

import numpy as np
from test_operators import similar_by_brute_force

import corpus_pipeline
from voxelmill.llm import decontamination, packing, queries


def best_alignment(item, words):
    h = np.zeros((len(item) + 1, len(words) + 1), int)
    for i, j in itertools.product(range(len(item)), range(len(words))):
        h[i + 1, j + 1] = max(0, h[i, j] + (2 if item[i] == words[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max() / (2 * len(item))


def corpus():
    """(documents, labels, benchmark): good and bad texts, copies, near copies, leaks and addresses."""
    rng = np.random.default_rng(31)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 8)))
    vocabulary = [word() for _ in range(300)]
    text = lambda: list(rng.choice(vocabulary, 40))
    items = [[f"q{word()}" for _ in range(20)] for _ in range(3)]
    good = [text() for _ in range(300)]
    for i in range(40, 70):  # one address a text, so that no term can disclose it
        good[i].insert(int(rng.integers(41)), f"user{i}@site.example.org")
    for i in range(70, 90):  # passages of an item, from whole to less than is a copy
        s = list(items[i % 3])
        for k in range(4, 4 + (i - 70) // 2):
            s[k] = "changed"
        good[i][10:10] = s
    copies = [list(t) for t in good[:20]] + [[*t[:-1], "other"] for t in good[10:50]] + [[*t[:6], "x", *t[7:14], "y", *t[15:]] for t in good[100:120]]
    bad = [[w + "###" for w in text()] for _ in range(120)]
    texts = [(" ".join(t), 1) for t in good + copies] + [(" ".join(t), 0) for t in bad]
    order = rng.permutation(len(texts)).tolist()
    docs = [(i, texts[k][0], "en", "s", len(texts[k][0])) for i, k in enumerate(order)]
    return docs, [(i, texts[k][1], 0) for i, k in enumerate(order)], [(i, " ".join(t)) for i, t in enumerate(items)]


def test_run_by_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    for name, rows, kind in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars int"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = [d for d, (_, quality, _) in zip(docs, labels, strict=True) if quality]
    classes = similar_by_brute_force([d[1] for d in good])
    alone = [d for i, d in enumerate(good) if classes[i] == i]
    assert 280 <= len(alone) <= 330 and len(alone) < len(good)
    seqs = [decontamination.tokens(t) for _, t in items]
    clean = [d for d in alone if max(best_alignment(s, decontamination.tokens(d[1])) for s in seqs) < 0.6]
    assert 10 <= len(alone) - len(clean) <= 20
    want = {d[0]: " ".join("[EMAIL]" if "@" in w else w for w in d[1].split(" ")) for d in clean}
    assert sum("[EMAIL]" in t for t in want.values()) == 30

    encode = packing.encoder({"json": queries.byte_bpe()["json"], "ranks": None, "pattern": None})
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        ids = np.array([*encode(want[r.doc_id]), 0], "<u4")
        assert (r.piece, r.start, r.length, r.ids_crc32) == (0, 0, len(ids), zlib.crc32(ids.tobytes()))
    bins = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == bins[r.sequence_id]
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs, labels, items = corpus()
    empty = {"documents": [], "labels": labels, "benchmark": items}
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars int", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, rows in empty.items():
        spark.createDataFrame(rows, kinds[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    table = spark.createDataFrame(docs[:40], kinds["documents"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
