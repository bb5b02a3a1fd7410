"""Quoted CSV by many tasks against one task, for splits at any byte."""

import csv
import random

import pytest

import venuelens as vl
from venuelens.sources import quoted_csv
from venuelens.sources.quoted_csv import POSITION, read_quoted_csv


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of some bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "509", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def made(rng, n):
    parts = ["a", ",", '"', "\n", "\r\n", " ", "é", "long text ", '""', "'", "\t", "x" * 60 + "\n" * 3]
    for i in range(n):
        yield [str(i), "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))), rng.choice(["", "4.5", "n/a"])]


def write(path, rows, end="\n", quoting=csv.QUOTE_MINIMAL, bom=""):
    with open(path, "w", newline="", encoding="utf-8") as file:
        file.write(bom)
        csv.writer(file, lineterminator=end, quoting=quoting).writerows(rows)


def plain(path):
    with open(path, newline="", encoding="utf-8-sig") as file:
        return list(csv.reader(file))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
@pytest.mark.parametrize("bound", [quoted_csv.MAX_SPLITS, 3])
def test_rows_equal_a_plain_reader(spark, tmp_path, small_splits, monkeypatch, end, quoting, bound):
    monkeypatch.setattr(quoted_csv, "MAX_SPLITS", bound)
    rng = random.Random(31)
    rows = [["id", "the text", "score"], *made(rng, 150)]
    path = str(tmp_path / "r.csv")
    write(path, rows, end, quoting, "\ufeff" if quoting == csv.QUOTE_ALL else "")
    got = read_quoted_csv(spark, path)
    assert got.columns == [POSITION, "id", "the text", "score"]
    found = got.orderBy(POSITION).collect()
    # An empty field is missing unless it is quoted.
    assert [[x or "" for x in tuple(r)[1:]] for r in found] == plain(path)[1:] == rows[1:]
    assert spark.read.text(path).rdd.getNumPartitions() > 8


def test_one_task_and_many_give_the_same(spark, tmp_path):
    rng = random.Random(32)
    for i in range(4):
        write(tmp_path / f"part{i}.csv", [["id", "text", "score"], *made(rng, 40)])
    key = "spark.sql.files.maxPartitionBytes"
    before, rows = spark.conf.get(key), []
    for size in ("128m", "701"):
        spark.conf.set(key, size)
        try:
            rows.append(sorted(map(tuple, read_quoted_csv(spark, str(tmp_path)).collect())))
        finally:
            spark.conf.set(key, before)
    assert rows[0] == rows[1] and len(rows[0]) == len({r[0] for r in rows[0]}) == 160
    one = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path)).collect()
    assert {tuple(r) for r in one} == {r[1:] for r in rows[0]}


def test_odd_files(spark, tmp_path):
    write(tmp_path / "a.csv", [["id", "text"]])
    assert read_quoted_csv(spark, str(tmp_path / "a.csv")).count() == 0
    (tmp_path / "b.csv").write_text('id,text\n\n1,"open\nuntil the end\n2,x\n')
    rows = read_quoted_csv(spark, str(tmp_path / "b.csv")).collect()
    assert len(rows) == 1 and rows[0].id == "1" and rows[0][POSITION] == 1
    (tmp_path / "c.csv").write_text("id\n1\n")
    with pytest.raises(ValueError, match="different headers"):
        read_quoted_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "c.csv")])
    (tmp_path / "d.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_quoted_csv(spark, str(tmp_path / "d.csv"))
    # the last line has no end, names need quoting, fields are missing or too many
    (tmp_path / "e.csv").write_text('"a,b","c`d"\n1\n2,3,4\n5,"6"')
    rows = read_quoted_csv(spark, str(tmp_path / "e.csv")).orderBy(POSITION).collect()
    assert [tuple(r)[1:] for r in rows] == [("1", None), ("2", "3"), ("5", "6")]


def test_numbers_follow_the_files(spark, tmp_path, small_splits):
    for i in range(3):
        write(tmp_path / f"{i}.csv", [["cafe_id", "rating", "review_text"], *[[j, 4, f"text {i} {j}\nline"] for j in range(9)]])
    reviews = vl.read_reviews(spark, str(tmp_path)).orderBy("review_id").collect()
    assert [r.review_text for r in reviews] == [f"text {i} {j}\nline" for i in range(3) for j in range(9)]
