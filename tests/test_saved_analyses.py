"""The append-only log of saved analyses: odd names, versions, stopped deletes and compactions."""

import os

import pytest

from sheetwise.sources import io as IO


@pytest.fixture()
def one_row(spark):
    return spark.createDataFrame([(1, "a")], "x long, y string")


def listed(spark, root, user):
    return [r["analysis_id"] for r in IO.list_saved_analyses(spark, root, user).collect()]


def test_names_that_are_no_file_names(spark, tmp_dir, one_row):
    users = ["a/b", "a:b", "a%b", "a%2Fb", "a=b", "../x", " ", "", "a", "é\n"]
    root = os.path.join(tmp_dir, "root")
    ids = {u: IO.save_analysis(spark, root, u, "n", one_row, {"cleaned_rows": 1}, analysis_id="../same id/é") for u in users}
    assert os.listdir(tmp_dir) == ["root"]
    for i, u in enumerate(users):
        assert listed(spark, root, u) == [ids[u]]
        if i % 3 == 0:
            assert IO.delete_analysis(spark, root, u, ids[u])
            assert not IO.delete_analysis(spark, root, u, ids[u])
            with pytest.raises(ValueError):
                IO.load_analysis(spark, root, u, ids[u])
    for i, u in enumerate(users):
        assert listed(spark, root, u) == ([ids[u]] if i % 3 else [])
        if i % 3:
            assert IO.load_analysis(spark, root, u, ids[u])[0].collect() == one_row.collect()


def test_newest_version_wins_and_comes_back_after_a_delete(spark, tmp_dir, one_row):
    for n in (1, 2, 3):
        IO.save_analysis(spark, tmp_dir, "u", f"v{n}", one_row.selectExpr(f"x * {n} AS x"), {"n": n}, analysis_id="a")
    data, report = IO.load_analysis(spark, tmp_dir, "u", "a")
    assert data.first()["x"] == 3 and report == {"n": 3} and listed(spark, tmp_dir, "u") == ["a"]
    assert IO.delete_analysis(spark, tmp_dir, "u", "a") and listed(spark, tmp_dir, "u") == []
    IO.save_analysis(spark, tmp_dir, "u", "v4", one_row, {"n": 4}, analysis_id="a")
    assert IO.load_analysis(spark, tmp_dir, "u", "a")[1] == {"n": 4}
    assert IO.compact_analyses(spark, tmp_dir) == 1 and IO.compact_analyses(spark, tmp_dir) == 1
    assert IO.load_analysis(spark, tmp_dir, "u", "a")[0].first()["x"] == 1
    assert len(os.listdir(os.path.join(tmp_dir, "data"))) == 1


def test_stopped_deletes_and_compactions_lose_nothing(spark, tmp_dir, one_row, monkeypatch):
    a, b = (IO.save_analysis(spark, tmp_dir, "u", n, one_row, {}) for n in "ab")
    monkeypatch.setattr(IO, "_append", lambda *args: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # before the tombstone: nothing has happened
        IO.delete_analysis(spark, tmp_dir, "u", a)
    monkeypatch.undo()
    assert sorted(listed(spark, tmp_dir, "u")) == sorted([a, b])
    assert IO.load_analysis(spark, tmp_dir, "u", a)[0].count() == 1
    # a compaction that stopped before its mark: a generation that nobody reads
    os.makedirs(os.path.join(tmp_dir, "log", "g1", "user_part=0"))
    assert sorted(listed(spark, tmp_dir, "u")) == sorted([a, b])
    assert IO.compact_analyses(spark, tmp_dir) == 2
    assert sorted(listed(spark, tmp_dir, "u")) == sorted([a, b])


def test_nothing_saved_yet(spark, tmp_dir):
    assert listed(spark, tmp_dir, "nobody") == [] and not IO.delete_analysis(spark, tmp_dir, "nobody", "x")
    assert IO.compact_analyses(spark, tmp_dir) == 0
