"""Containers hold what they can, every text is placed once, little room stays empty."""

import os

import numpy as np
import pytest

from tracewright.llm import packing as K


def test_plan_covers_every_rank():
    rng = np.random.default_rng(1)
    for n in (1, 7, 500, 20_000):
        x = np.clip(rng.lognormal(6, 0.7, n), 257, 4096).astype(int)
        histogram = dict(zip(*(a.tolist() for a in np.unique(x, return_counts=True))))
        plan = K.make_plan(histogram)
        where = plan.place(np.arange(n))
        used = np.bincount(where, weights=np.sort(x)[::-1], minlength=plan.containers)
        assert used.max() <= 4096 and len(used) == plan.containers
    assert K.make_plan({}).containers == 0
    same = K.make_plan({1365: 900})
    assert np.bincount(same.place(np.arange(900))).max() == 3 and same.containers == 300


@pytest.mark.skipif(not os.path.isdir(K.TOKENIZER_DIR), reason="no vocabulary files here")
def test_packing(spark):
    rows = [(i, "word " * (i * 37 % 900), "x") for i in range(400)] + [(400, None, "x"), (401, "", "x"), (402, "long " * 20_000, "x"), (403, "a b c", "x"), (403, "a b c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    got = K.pack(df).collect()
    used = {}
    for r in got:
        used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
    assert max(used.values()) <= K.CAPACITY
    assert sum(used.values()) / (len(used) * K.CAPACITY) > 0.93
    assert len({(r["doc_id"], r["piece"]) for r in got}) == 404 + sum(r["doc_id"] == 402 for r in got) - 1 and sum(r["doc_id"] == 403 for r in got) == 2
    assert sum(r["tokens"] for r in got if r["doc_id"] == 402) == len(K._encoding("x", open(f"{K.TOKENIZER_DIR}/{K.TOKENIZER_FILE}", "rb").read()).encode_ordinary("long " * 20_000))
    assert K.pack(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(K.TOKENIZER_DIR), reason="no vocabulary files here")
def test_many_containers_and_few_small_texts(spark, monkeypatch):
    """Containers alone raise the number of buckets; nothing is lost between buckets."""
    monkeypatch.setattr(K, "BUCKET_ROWS", 10)
    df = spark.createDataFrame([(i, "word " * 2600) for i in range(60)] + [(100 + i, "a b") for i in range(3)], "doc_id long, text string")
    used = {}
    for r in K.pack(df).collect():
        used.setdefault(r["container"], []).append(r["tokens"])
    assert sum(map(len, used.values())) == 63 and max(map(sum, used.values())) <= K.CAPACITY and len(used) <= 63
