"""CSV files cut into ranges of a few bytes against the scan with one task for each file."""

import random

import pytest

from redline.sources import csv
from redline.sources.records import open_after


@pytest.fixture
def tiny_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def set_(size):
        for n, v in zip(names, (str(size), "1")):
            spark.conf.set(n, v)

    yield set_
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def written(path, rows, header="case_id,template,report", ends="\n"):
    def cell(x, r):
        if any(c in x for c in '",\n') or r.random() < 0.3:
            return '"' + x.replace('"', '""') + '"'
        return x

    r = random.Random(3)
    lines = [header] + [",".join(cell(x, r) for x in row) for row in rows]
    path.write_bytes((ends.join(lines) + ends).encode())
    return rows


def some_rows(n, seed):
    r = random.Random(seed)
    parts = ["FINDINGS:", "\n", "\n\n", '"', '""', ",", " ", "é", "深い", "left 5 mm", "\n\"", "\",", "x"]
    return [(f"c{i}", "".join(r.choices(parts, k=r.randint(0, 12))), "".join(r.choices(parts, k=r.randint(0, 30)))) for i in range(n)]


def got(df):
    return [tuple(x) for x in df.orderBy("row_index").collect()]


@pytest.mark.parametrize("size", [37, 200, 1 << 20])
def test_cells_with_breaks_and_quotes_across_borders(spark, tiny_ranges, tmp_path, size):
    rows = written(tmp_path / "a.csv", some_rows(60, 1))
    tiny_ranges(size)
    df = csv.read_strings(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["row_index", "case_id", "template", "report"]
    assert got(df) == [(i, *row) for i, row in enumerate(rows)]
    assert got(df) == got(csv.read_whole(spark, str(tmp_path / "a.csv")))


def test_one_cell_over_many_ranges_and_several_files(spark, tiny_ranges, tmp_path):
    long = "\n".join(f'line {i}, "quoted"' for i in range(60))
    a = written(tmp_path / "part-0.csv", [("1", long, ""), ("2", "", "end")])
    b = written(tmp_path / "part-1.csv", [])
    c = written(tmp_path / "part-2.csv", some_rows(20, 2) + [("z", "open\n", long)], ends="\r\n")
    tiny_ranges(64)
    assert got(csv.read_strings(spark, str(tmp_path))) == [(i, *row) for i, row in enumerate(a + b + c)]


def test_loose_quotes_blank_lines_and_uneven_rows(spark, tiny_ranges, tmp_path):
    text = 'a,b,c\n5" pipe,x,y\n\n"q"rest,1,2\nshort\n1,2,3,4\n , "sp",\n"open to the\nend'
    (tmp_path / "odd.csv").write_text(text)
    whole = got(csv.read_whole(spark, str(tmp_path / "odd.csv")))
    tiny_ranges(5)
    assert got(csv.read_strings(spark, str(tmp_path / "odd.csv"))) == whole


def test_many_tasks_read_one_file(spark, tiny_ranges, tmp_path):
    written(tmp_path / "a.csv", some_rows(300, 4))
    tiny_ranges(2000)
    used = csv.records(spark, str(tmp_path / "a.csv")).select("record")
    assert used.rdd.getNumPartitions() > 1
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() >= 8


@pytest.mark.parametrize("line, inside, after", [
    ("", False, False), ("", True, True), ('a,"b', False, True), ('a"b', False, False), ('x""', True, True), ('x"', True, False),
    ('x",y"', True, False), ('x","y', True, True), ('""', False, False), ('"""', False, True), ('"a"b,"c', False, True),
])
def test_state_after_a_line(line, inside, after):
    assert open_after(line, inside) is after
