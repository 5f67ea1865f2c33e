"""Merges into a stored keyed table."""

import json
import os

import pytest

from graphtables.operators.keyed import keyed_merge
from graphtables.operators.upsert import StoredKeyed

ROWS = "key long, value long, seq long"


def _rows(spark, n, start=0, keys=40):
    return spark.createDataFrame([((i * 7 + start) % keys, i % 16, start + i) for i in range(n)], ROWS)


def _files(path):
    return {part: sorted(f for f in os.listdir(f"{path}/data/{part}") if f.startswith("part-"))
            for part in os.listdir(f"{path}/data") if part.startswith("part=")}


def _plain(df):
    return {r["key"]: r["value"] for r in df.collect()}


@pytest.mark.parametrize("how", ["sum", "max", "min", "bit_or", "last"])
def test_successive_merges(spark, scratch, how):
    batches = [_rows(spark, 60), _rows(spark, 30, 1000, 55), _rows(spark, 5, 2000, 3)]
    stored = StoredKeyed(spark, f"{scratch}/t", how=how, seq="seq", parts=8)
    for k, rows in enumerate(batches):
        stored.merge(rows, f"b{k}")
    everything = batches[0].unionByName(batches[1]).unionByName(batches[2])
    assert _plain(stored.table()) == _plain(keyed_merge(everything, everything.limit(0), how=how, seq="seq"))
    assert StoredKeyed(spark, f"{scratch}/t", how=how, seq="seq").parts == 8
    with pytest.raises(ValueError):
        StoredKeyed(spark, f"{scratch}/t", how="max" if how != "max" else "min")


def test_untouched_parts_keep_their_files(spark, scratch):
    path = f"{scratch}/t"
    stored = StoredKeyed(spark, path, how="sum", parts=8)
    assert sorted(stored.merge(_rows(spark, 80), "all")) == sorted(int(p[5:]) for p in _files(path))
    before = _files(path)
    touched = stored.merge(spark.createDataFrame([(3, 100, 1), (3, 1, 2)], ROWS), "one")
    after = _files(path)
    assert len(touched) == 1
    assert {p for p in before if before[p] != after[p]} == {f"part={touched[0]}"} and len(before) > 4


def test_a_batch_is_merged_once(spark, scratch):
    stored = StoredKeyed(spark, f"{scratch}/t", how="sum", parts=4)
    stored.merge(_rows(spark, 20), "a")
    there = _plain(stored.table())
    assert StoredKeyed(spark, f"{scratch}/t", how="sum").merge(_rows(spark, 20), "a") == []
    assert _plain(stored.table()) == there and stored.batches() == ["a"]


def test_a_merge_that_was_cut_off_is_undone_and_repeated(spark, scratch, monkeypatch):
    """After its folders were replaced, and before the batch was noted."""
    import graphtables.operators.upsert as upsert

    path = f"{scratch}/t"
    StoredKeyed(spark, path, how="sum", parts=4).merge(_rows(spark, 20), "a")
    whole = upsert.write_text

    def dying(spark_, at, text):
        if at.endswith("batches/b"):
            raise KeyboardInterrupt
        whole(spark_, at, text)

    monkeypatch.setattr(upsert, "write_text", dying)
    with pytest.raises(KeyboardInterrupt):
        StoredKeyed(spark, path, how="sum").merge(_rows(spark, 30, 500, 70), "b")
    monkeypatch.undo()
    with open(f"{path}/pending") as f:
        assert json.load(f)["batch"] == "b"
    stored = StoredKeyed(spark, path, how="sum")
    stored.merge(_rows(spark, 30, 500, 70), "b")
    both = _rows(spark, 20).unionByName(_rows(spark, 30, 500, 70))
    assert _plain(stored.table()) == _plain(keyed_merge(both, both.limit(0), how="sum"))
    assert not os.path.exists(f"{path}/pending") and not os.path.exists(f"{path}/before")


def test_null_keys_and_empty_batches(spark, scratch):
    stored = StoredKeyed(spark, f"{scratch}/t", how="sum", parts=4)
    stored.merge(spark.createDataFrame([(None, 1, 1), (None, 2, 2), (5, None, 3)], ROWS), "a")
    assert stored.merge(spark.createDataFrame([], ROWS), "none") == []
    assert _plain(stored.table()) == {None: 3, 5: None}
