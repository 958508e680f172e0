"""Records cut by many tasks, against the csv module reading the file as a whole."""

import csv
import io
import random

import pytest

from framegauge.sources import csv_files
from framegauge.sources.csv_records import block_states, csv_records, ends_inside, file_lines

CELLS = ["", "x", "NA", '"', "two\nlines", "a,b", 'say ""', "\n", ' "in" ', "long\n" * 40, 'q"\n"', "\r\n", "é🙂"]


def made_up(seed, rows):
    choice = random.Random(seed)
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=choice.choice(["\n", "\r\n"]))
    writer.writerow(["id", "b\nc", "d"])
    for i in range(rows):
        writer.writerow([i, choice.choice(CELLS), choice.choice(CELLS)])
    return out.getvalue()


def test_state_of_a_line():
    for line, outside, inside in [("a,b", False, True), ('"a', True, False), ('a"', False, False), ('5" pipe,x', False, False), ('"a",b', False, False),
                                  ('x","y', True, True), ('"a"",', True, False), ('""', False, True), ('"', True, False), (',"', True, False), ('a,""', False, True)]:
        assert (ends_inside(line, False), ends_inside(line, True)) == (outside, inside), line


@pytest.mark.parametrize("block", [64, 700, 1 << 20])
def test_records_against_the_csv_module(spark, tmp_path, block):
    texts = {f"f{k}.csv": made_up(k, 60) for k in range(3)}
    texts["note.csv"] = 'a,b\n5" pipe,"x""\ny"\n\n  \nlast,"no end of line"'
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        tasks = file_lines(spark, str(tmp_path)).rdd.getNumPartitions()
        found = {}
        for r in csv_records(spark, str(tmp_path)).collect():
            assert not r["unclosed"]
            found.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["header"], r["record"]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > {64: 100, 700: 5}.get(block, 0)
    for name, text in texts.items():
        want = [row for row in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in row) or len(row) > 1]
        got = [next(csv.reader(io.StringIO(record, newline=""))) for _, record in found[name]]
        assert sorted(got) == sorted(want)
        assert [next(csv.reader(io.StringIO(r, newline=""))) for h, r in found[name] if h] == [want[0]]


def test_quoted_breaks_are_right_by_default(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    df = csv_files.csv_scan(spark, str(tmp_path))
    assert [t for _, t in df.dtypes] == ["bigint", "string"] and sorted(map(tuple, df.collect())) == [(1, "x\ny"), (2, "z")]


def test_quote_that_is_never_closed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\n2,z\n')
    (tmp_path / "b.csv").write_text("a,b\n3,4\n")
    with pytest.raises(ValueError, match="a.csv"):
        csv_files.csv_scan(spark, str(tmp_path))
    good, bad = csv_files.reject_unreadable(csv_files.csv_text(spark, str(tmp_path), ["a", "b"]))
    assert [r["a"] for r in good.collect()] == ["3"] and [r["_file_path"][-5:] for r in bad.collect()] == ["a.csv"]
    assert {(r["file"][-5:], r["ends"]) for r in block_states(file_lines(spark, str(tmp_path))).collect()} == {("a.csv", True), ("b.csv", False)}
