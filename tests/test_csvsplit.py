"""A CSV file read in many splits against Python's own reader."""

from __future__ import annotations

import csv
import io
import random

import pytest

from tallyframe.sources import csvfile, csvsplit


def slow(text, delimiter=","):
    """(line, cells, ragged) of every record that is not blank, after the header."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if any(c.strip() for c in r)]
    wide = len(rows[0]) if rows else 0
    return [(n, [*r[:wide], *[""] * (wide - len(r))], len(r) != wide) for n, r in enumerate(rows[1:], 2)]


def fast(spark, path, split):
    cells, headers = csvsplit.read_large_csv(spark, str(path), split)
    return sorted((r["line"], r["cells"], r["ragged"]) for r in cells.collect()), headers


def quoted(c):
    return '"' + c.replace('"', '""') + '"'


def file_of(draw, n, end):
    rows = ["id,name,note"]
    for i in range(n):
        note = draw.choice(["plain", "", "two\nlines", 'he said "no"', ',"', "\n\n\n", 'a,"b"\n"c",d', '"', "x" * 300])
        rows.append(",".join([str(i), draw.choice(["n", quoted("q,q"), 'in 5" pipe', quoted("")]), quoted(note)] + (["more"] if i % 11 == 5 else [])))
        if i % 17 == 3:
            rows.append(draw.choice(["", ",,", "  ", '"",""']))
        if i % 13 == 4:
            rows.append(f"{i},short")
    return end.join(rows) + draw.choice(["", end])


@pytest.mark.parametrize(("end", "split"), [("\n", 200), ("\n", 37), ("\r\n", 450), ("\n", None)])
def test_splits_give_the_records_of_one_reader(spark, tmp_path, end, split):
    text = file_of(random.Random(split), 120, end)
    (tmp_path / "one.csv").write_text(text, newline="")
    got, headers = fast(spark, tmp_path / "one.csv", split)
    assert headers == ["id", "name", "note"]
    assert got == slow(text)


def test_a_record_over_many_splits_and_an_unclosed_one(spark, tmp_path):
    text = "a,b\n1," + quoted("line\n" * 200) + '\n2,x\n3,"never closed\nto the end\n4,y'
    (tmp_path / "one.csv").write_text(text)
    got, _ = fast(spark, tmp_path / "one.csv", 64)
    assert [(n, c[0], len(c[1])) for n, c, _ in got] == [(2, "1", 1000), (3, "2", 1), (4, "3", len("never closed\nto the end\n4,y"))]


def test_many_tasks_read_one_file_and_files_are_numbered_apart(spark, tmp_path):
    texts = [file_of(random.Random(i), 40, "\n") for i in range(3)]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.csv").write_text(t)
    cells, _ = csvsplit.read_large_csv(spark, str(tmp_path), 100)
    got = {}
    for r in cells.collect():
        got.setdefault(r["file"][-5], []).append((r["line"], r["cells"], r["ragged"]))
    assert {k: sorted(v) for k, v in got.items()} == {str(i): slow(t) for i, t in enumerate(texts)}
    with csvsplit._split_size(spark, 100):
        assert spark.read.text(str(tmp_path / "0.csv")).rdd.getNumPartitions() > 10


def test_as_the_reader_of_whole_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text(file_of(random.Random(7), 60, "\n"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("")
    whole, headers = csvfile.read_csv(spark, str(tmp_path / "one.csv"))
    assert fast(spark, tmp_path / "one.csv", 90) == (sorted((r["line"], r["cells"], r["ragged"]) for r in whole.collect()), headers)
    assert fast(spark, tmp_path / "empty", 90) == ([], [])
