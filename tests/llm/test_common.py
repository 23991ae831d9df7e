import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import common


def test_stage_unstage_and_clear(spark):
    df = spark.range(5).withColumnRenamed("id", "a.b")
    kept, gone = common.stage(df, "kept"), common.stage(df, "gone")
    common.unstage(gone)
    assert kept.count() == 5
    with pytest.raises(Exception):  # noqa: B017
        gone.collect()
    assert common.stage(df.limit(0), "empty").count() == 0
    assert kept.select(common.column("a.b")).count() == 5
    common.clear_stages(spark)
    with pytest.raises(Exception):  # noqa: B017
        kept.collect()


def test_whole_groups_never_cut_a_key():
    keys = np.repeat(np.arange(40), np.arange(40) % 7 + 1)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 9])], ["k"]) for i in range(0, len(keys), 9)]
    tables = list(common.whole_groups(iter(batches), ["k"], 12))
    parts = [t.column("k").to_numpy() for t in tables]
    assert np.array_equal(np.concatenate(parts), keys) and len(parts) > 3
    assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert list(common.whole_groups(iter([]), ["k"])) == []


def test_merged_runs():
    start, end = common.merged_runs(np.array([9, 0, 3, 20]), np.array([12, 3, 5, 21]))
    assert (start.tolist(), end.tolist()) == ([0, 9, 20], [5, 12, 21])
    assert common.merged_runs(np.zeros(0, int), np.zeros(0, int))[0].size == 0
