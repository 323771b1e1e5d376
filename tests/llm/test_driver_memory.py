"""What the driver holds and plans at a time."""

from __future__ import annotations

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa

from logtally.llm import language, mixing


def test_mix_is_planned_in_small_steps(spark, tmp_path):
    """Each table is read by the plans that need it, not made again in one plan that broadcasts all of them at a time."""
    rows = [(i, f"a b c {i}", "en" if i % 3 else "de", f"src{i % 7}") for i in range(300)]
    docs = mixing.with_leaf(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    plan = mixing.leaf_cuts(docs, mixing.MixSettings())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") + plan.count("SortMergeJoin") <= 4
    assert plan.count("Scan parquet") <= 5


def test_language_model_is_small_in_the_driver():
    """Names stay in Arrow: a Python text and a dict entry for each takes several times as much."""
    names = pa.array([f"{i:08x}" for i in range(100_000)])
    n, total = pa.array(np.ones(len(names), np.int64)), pa.array(np.full(len(names), len(names)))
    counts = pa.table({"word": names, "lang": pa.array(["en"] * len(names)), "n": n, "total": total})
    few = counts.slice(0, 10)
    tracemalloc.start()
    try:
        model = language.model_of(counts, few, language.FitSettings())
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 32 * len(names)
    assert len(model.words.names) == len(names) and model.words.names["00000007"] == 7 and model.words.names.get("other") is None
    sent = pickle.loads(pickle.dumps(model))
    assert sent.words.names == {name: i for i, name in enumerate(names.to_pylist())} and np.array_equal(sent.words.score, model.words.score)
