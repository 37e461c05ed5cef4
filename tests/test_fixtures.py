"""Fixture rows written, checked and read again."""

import os

import pytest
from pyspark.sql import functions as F

from tonegauge.sources import fixtures

SCHEMA = "id string, family string, text string, n long, more array<string>"
ODD = ["", "plain", "```\n## Rows\n```json\n[", "a\nb\r\nc d", 'quotes " and \\ and ],', "🎉 ü", "]", "[", "x" * 3_000_000, None]


def rows(spark, extra=()):
    data = [(f"r{i:03d}", "ab"[i % 2], text, i, [str(i)] if i % 3 else None) for i, text in enumerate(ODD * 5)]
    return spark.createDataFrame([*data, *extra], SCHEMA).repartition(3)


@pytest.mark.parametrize("form", sorted(fixtures.FORMS))
def test_odd_rows_come_back(spark, tmp_path, form):
    path, d = str(tmp_path / "f"), rows(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files, small as they are
    fixtures.write(d, path, family="family", form=form, expected=50, families={"a": 25, "b": 25})
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(repr, fixtures.read(spark, path, SCHEMA).collect())) == sorted(map(repr, d.collect()))
    known = fixtures.manifest(path)
    assert known["rows"] == 50 and known["families"] == {"a": 25, "b": 25} and len(known["files"]) > 1
    (tmp_path / "f" / "part-999999-lost.md").write_text("## Rows\n\n```json\n[\n{}\n]\n```\n")  # of a lost attempt
    assert fixtures.read(spark, path, SCHEMA).count() == 50
    with pytest.raises(Exception, match="already"):
        fixtures.write(d, path)


@pytest.mark.parametrize(
    "extra, options, fault",
    [
        ([("r007", "a", "again", 0, None)], {}, "comes twice"),
        ([(None, "a", "no id", 0, None)], {}, "no id"),
        ([("z", "c", "other family", 0, None)], {"families": {"a": None, "b": None}}, "is of family 'c'"),
        ([("z", None, "no family", 0, None)], {"families": {"a": None, "b": None}}, "is of family None"),
        ([("z", "a", "one more", 0, None)], {"families": {"a": 25, "b": 25}}, "26 rows of family 'a' instead of 25"),
        ([("z", "a", "one more", 0, None)], {"expected": 50}, "51 rows instead of 50"),
    ],
)
def test_faults_fail_the_commit_and_leave_nothing(spark, tmp_path, extra, options, fault):
    path = str(tmp_path / "f")
    with pytest.raises(Exception, match=fault):
        fixtures.write(rows(spark, extra), path, family="family", **options)
    assert os.listdir(path) == []


def test_the_commit_compares_files(tmp_path):
    writer = fixtures._Writer({"path": str(tmp_path)})
    parts = [fixtures.Written("one", 2, "a", "c"), fixtures.Written("two", 1, "c", "c"), None, fixtures.Written()]
    with pytest.raises(ValueError, match="'c' comes twice"):
        writer.commit(parts)
    parts[1] = fixtures.Written("two", 1, "d", "d", faults=["two reads otherwise than it was written"])
    with pytest.raises(ValueError, match="reads otherwise"):
        writer.commit(parts)
    parts[1] = fixtures.Written("two", 1, "d", "d")
    writer.commit(parts[::-1])
    assert [f["name"] for f in fixtures.manifest(str(tmp_path))["files"]] == ["one", "two"]


def test_a_file_that_changed_is_noticed(tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    one = fixtures._digest(fixtures._rows(str(tmp_path), "x.jsonl", "lines", ""))
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 3}\n')
    assert one[0] == 2 and fixtures._digest(fixtures._rows(str(tmp_path), "x.jsonl", "lines", "")) != one


def test_an_empty_table_and_clashing_names(spark, tmp_path):
    empty = str(tmp_path / "empty")
    fixtures.write(rows(spark).limit(0), empty, family="family", expected=0, families={"a": 0})
    assert fixtures.read(spark, empty, SCHEMA).collect() == []
    d = spark.range(9).select("id", F.lit("x").alias("row"), F.lit("y").alias("a.b"))
    fixtures.write(d, str(tmp_path / "names"))
    assert fixtures.read(spark, str(tmp_path / "names"), "id long, row string, `a.b` string").where("row = 'x' AND `a.b` = 'y'").count() == 9
