"""Reading CSV files with quoted line breaks in byte ranges, against the reader with one task per file."""

import csv
import io
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from staylens.sources import records, reviews

CELLS = ["", "a", "plain text", 'with "quotes"', "two\nlines", "a,b", '"', "\n", 'end"', "é\n\n,\n", " lead", "x\"y\"\nz", '""', "1.5"]


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def text_of(seed, n, newline="\r\n", width=4, quoting=csv.QUOTE_MINIMAL):
    r = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=newline, quoting=quoting)
    writer.writerow(["id", "name, first", "comment", "n"])
    for i in range(n):
        cells = [r.choice(CELLS) for _ in range(2)]
        if r.random() < 0.1:
            cells[0] = "\n".join(r.choice(["lorem", "", "a,b", 'he said "x"']) for _ in range(r.randrange(40)))
        writer.writerow([i, *cells, r.randrange(9)][:width])
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    before_cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def use(size):
        spark.conf.set(key, str(size))

    yield use
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.files.openCostInBytes", before_cost)


@pytest.mark.parametrize("size,newline", [(37, "\n"), (64, "\r\n"), (150, "\n"), (1000, "\r\n"), (4000, "\n")])
def test_ranges_give_what_one_task_gives(spark, tmp_path, small_splits, size, newline):
    for k in range(3):
        (tmp_path / f"part{k}.csv").write_bytes(text_of(k, 60, newline).encode())
    small_splits(size)
    path = str(tmp_path)
    assert records.read_lines(spark, path).rdd.getNumPartitions() >= 4
    whole = reviews.load_reviews(spark, path, {"id": "long"}, reader="whole")
    split = reviews.load_reviews(spark, path, {"id": "long"}, reader="split")
    assert split.columns == whole.columns == ["id", "name, first", "comment", "n"]
    assert rows_of(split) == rows_of(whole) and whole.count() == 180


def test_an_edge_at_every_byte(spark, tmp_path, small_splits):
    text = 'id,comment\n1,"a\nb ""q""\n\n,c"\n2,"x"\n3,"one\n\ntwo"\n4,5" pipe\n'
    (tmp_path / "a.csv").write_text(text)
    want = [("1", 'a\nb "q"\n\n,c'), ("2", "x"), ("3", "one\n\ntwo"), ("4", '5" pipe')]
    for size in range(3, len(text) + 1, 5):
        small_splits(size)
        assert rows_of(reviews.load_reviews(spark, str(tmp_path), {}, reader="split")) == want, size


def test_records_past_the_broadcast_limit(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text(text_of(5, 80, "\n"))
    small_splits(90)
    kept, joined = (rows_of(records.read_records(spark, str(tmp_path), limit)) for limit in (None, 0))
    assert kept == joined and len(kept) == 81 and sum(r[1] for r in kept) == 1


def test_state_of_a_line():
    for line, out, into in [
        ("a,b", False, True), ('a,"b', True, False), ('"a""', True, False), ('5" x,y', False, False), ('a,"b"x"y', False, False),
        ('"a",5" pipe,"b', True, True), ('""', False, True), ('"""', True, False), ("", False, True), ('a"b"', False, False),
    ]:
        assert (records.leaves_open(line, False), records.leaves_open(line, True)) == (out, into), line
    long = '"' + 'x""' * 200_000
    assert records.leaves_open(long, False) and not records.leaves_open(long + '"', False)


def test_unclosed_quote_mark_and_blank_lines(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('﻿\n\nid,comment\r\n\r\n1,"a"\r\n\n2,"open\nto the\nend', newline="")
    small_splits(12)
    assert rows_of(records.read_records(spark, str(tmp_path))) == [('1,"a"', False), ('2,"open\nto the\nend', False), ("id,comment", True)]


def test_headers_must_agree(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("id,comment\n1,x\n")
    (tmp_path / "b.csv").write_text("comment,id\ny,2\n")
    with pytest.raises(Exception, match="header of a file differs"):
        reviews.load_reviews(spark, str(tmp_path), {}, reader="split").collect()


@pytest.mark.parametrize("reader", ["whole", "split"])
def test_cells_are_counted_not_looked_at(spark, tmp_path, reader):
    (tmp_path / "odd.csv").write_text('id,comment,price\n1,"fine, quoted",5\n2,bad, with comma,\n3,short\n4,ok,\n5,a,b,c,d\n6,"q,\n,q",\n7,"x"y"z,3\n')
    path, kinds = str(tmp_path), {"id": "long", "price": "double"}
    with pytest.raises(Exception, match="more cells than the header"):
        reviews.load_reviews(spark, path, kinds, reader=reader).count()
    counts = Observation()
    kept = reviews.load_reviews(spark, path, kinds, surplus="quarantine", reader=reader, counts=counts)
    assert rows_of(kept.select("id")) == [(1,), (3,), (4,), (6,), (7,)]
    assert counts.get == {"rows": 7, "short": 1, "surplus": 2}
    odd = rows_of(reviews.malformed_rows(spark, path, reader=reader))
    assert odd == [("short", "3,short"), ("surplus", "2,bad, with comma,"), ("surplus", "5,a,b,c,d")]


def test_cell_count(spark):
    cases = {"a,b,c": 3, "": 1, ",": 2, '"a,b",c': 2, '"a""b,",c,': 3, '5" x,"y,z"': 2, '"a"b"c,d': 2, 'a,"b\n,c",""': 3}
    found = spark.createDataFrame([(k,) for k in cases], "r string").select("r", reviews.cell_count(F.col("r")))
    assert {r[0]: r[1] for r in found.collect()} == cases


def test_auto_splits_large_files_only(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text(text_of(9, 50, "\n"))
    plan = lambda: reviews.load_reviews(spark, str(tmp_path), {})._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan()
    small_splits(500)
    assert "MapInArrow" in plan()
    assert reviews.load_reviews(spark, str(tmp_path), {}).count() == 50
