"""Quote-aware CSV reading, split by split, against pandas."""

import csv
import io
import os
import random

import pandas as pd
import pytest

from sheetwise.sources import csv_records as CR
from sheetwise.sources import io as IO


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "251", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_line_states_follow_the_pandas_reader():
    rnd = random.Random(1)
    for _ in range(4000):
        text = "".join(rnd.choice(['"', '"', ",", "a", "\n", "b c", '""']) for _ in range(rnd.randint(1, 14)))
        inside, records, record = False, [], []
        for line in text.split("\n"):
            record.append(line)
            inside = CR.ends_inside(line.encode(), inside)
            if not inside:
                records.append("\n".join(record))
                record = []
        if inside:
            with pytest.raises((pd.errors.ParserError, pd.errors.EmptyDataError)):
                pd.read_csv(io.StringIO(text), header=None, names=range(20), dtype=str, keep_default_na=False)
            continue
        if not any(r.strip() for r in records):
            continue
        got = pd.read_csv(io.StringIO(text), header=None, names=range(20), dtype=str, index_col=False)
        assert len(got) == sum(bool(r.strip()) for r in records), text


def write(path, rows, encoding, newline="\n"):
    with open(path, "w", encoding=encoding, newline="") as fh:
        csv.writer(fh, lineterminator=newline).writerows(rows)


def test_quoted_line_breaks_split_into_many_tasks(small_splits, tmp_dir):
    spark, rnd = small_splits, random.Random(2)
    words = ["plain", 'say "hi"', "two\nlines", "three\n\n lines, 'x'", '"', "a,b", "\r\n", "é", "£", "5\" pipe", "\n\"\n", " x "]

    def rows(n, seed):
        r = random.Random(seed)
        return [["id", "text\nof it", "amount"]] + [
            [str(i), " ".join(r.choice(words) for _ in range(r.randint(0, 5))), r.choice(["1.5", "", "NA"])] for i in range(n)]

    paths, frames = [], []
    for name, encoding, newline in (("utf [8].csv", "utf-8-sig", "\n"), ("win.csv", "cp1252", "\r\n"), ("plain.csv", "utf-8", "\n")):
        p = os.path.join(tmp_dir, name)
        data = rows(300, rnd.random())
        if name == "plain.csv":
            data = [["id", "text\nof it", "amount"], ["7", "only the header is broken", "2"]]
        write(p, data, encoding, newline)
        paths.append(p.replace("[", "\\[").replace("]", "\\]"))
        frames.append(pd.read_csv(p, encoding=encoding))
    assert CR.raw_lines(spark, paths).rdd.getNumPartitions() > 20
    got = IO.read_csv(spark, paths)
    assert dict(got.dtypes) == {"id": "bigint", "text\nof it": "string", "amount": "double"}
    want = pd.concat(frames)
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(
        (tuple(None if pd.isna(x) else x for x in t) for t in want.itertuples(index=False)), key=key)


def test_a_value_over_many_splits_and_states_that_never_meet(small_splits, tmp_dir):
    spark = small_splits
    rows = [["a", "b"], ["1", "\n" * 500 + 'x"\n"y' * 50], ["2", "z"]] + [[str(i), "\nk"] for i in range(3, 90)]
    p = os.path.join(tmp_dir, "long.csv")
    write(p, rows, "utf-8")
    with open(p, "a") as fh:  # both readings of such lines stay apart
        fh.write('200,"\n"\n201,"\n"\n')
    got = sorted(tuple(r) for r in IO.read_csv(spark, p).collect())
    assert got == sorted((int(a), b) for a, b in rows[1:]) + [(200, "\n"), (201, "\n")]


def test_some_files_with_breaks_among_many_without(spark, tmp_dir):
    # splits are a share of all files' bytes: a second reading of the files with breaks cuts them elsewhere
    rnd, old = random.Random(5), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        want = []
        for k in range(4):
            rows = [[str(1000 * k + i), ", ".join(rnd.choice(["a", 'b "c"', "d\n"[:1 + (k == 0)], "\n" if k == 0 else "e"])
                                                 for _ in range(6))] for i in range(300)]
            write(os.path.join(tmp_dir, f"{k}.csv"), [["id", "text"], *rows], "utf-8")
            want += [(int(a), b) for a, b in rows]
        assert sorted(tuple(r) for r in IO.read_csv(spark, tmp_dir).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)


def test_unquoted_quotes_blank_lines_and_old_line_ends(small_splits, tmp_dir):
    spark = small_splits
    p = os.path.join(tmp_dir, "odd.csv")
    with open(p, "wb") as fh:
        fh.write(b'size,n\r\n5" pipe,1\r\n   \r\n\r\n"6"" pipe",2\r\n"a"b"c,3\r\nshort\r\n')
    want = pd.read_csv(p)
    got = [tuple(r) for r in IO.read_csv(spark, p).orderBy("n").collect()]
    assert got == [("short", None), ('5" pipe', 1), ('6" pipe', 2), ('"a"b"c', 3)]
    # text after a closing quote: the same records, but such a field keeps its quotes
    assert sorted(want["size"].replace('ab"c', '"a"b"c')) == sorted(g[0] for g in got)
    old = os.path.join(tmp_dir, "old.csv")
    with open(old, "wb") as fh:
        fh.write(b"x,y\r1,2\r3,4\r")
    assert sorted(tuple(r) for r in IO.read_csv(spark, old).collect()) == [(1, 2), (3, 4)]


def test_broken_files_raise(spark, tmp_dir):
    p = os.path.join(tmp_dir, "open.csv")
    with open(p, "w") as fh:
        fh.write('a,b\n1,"never closed\n2,3\n')
    with pytest.raises(ValueError, match="inside a quoted value"):
        IO.read_csv(spark, p)
    p = os.path.join(tmp_dir, "wide.csv")
    with open(p, "w") as fh:
        fh.write("a,b\n1,2\n1,2,3\n")
    with pytest.raises(ValueError, match="more fields"):
        IO.read_csv(spark, p)
