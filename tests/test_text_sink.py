"""Reports written as files: whole, in order, replaced on a second run."""

from collections import defaultdict
from datetime import datetime
from pathlib import Path

import pytest

from snapdelta import build_model, numbered_lines, read_lines, report_dir, schema_rows, write_text
from snapdelta.plans import comparison
from snapdelta.sources.sample_catalog import catalog_from, pairs_from


@pytest.fixture(scope="module")
def model(spark, small_sf):
    return build_model(catalog_from(spark, small_sf))


def texts_of(lines, *key):
    wanted = defaultdict(list)
    for r in lines.orderBy(*key, "line_no").collect():
        wanted[tuple(r[k] for k in key)].append(r["line"] + "\n")
    return {k: "".join(v) for k, v in wanted.items()}


def read_back(folder: Path):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*.txt")))


def test_run_stamp():
    assert report_dir("/reports/", datetime(2024, 1, 2, 3, 4, 59)) == "/reports/2024_01_02_03_04"


def test_reports_of_a_run(spark, small_sf, model, tmp_path):
    pairs = pairs_from(spark, small_sf).where("target_id < 3")
    at = datetime(2024, 1, 2, 3, 4)
    for _ in range(2):
        path = comparison.write_schema_reports(model, pairs, str(tmp_path), at)
    assert path == f"{tmp_path}/2024_01_02_03_04"
    wanted = texts_of(numbered_lines(comparison.schema_report(model)), "snapshot_id")
    folders = {p.name for p in Path(path).iterdir() if p.is_dir()}
    assert folders == {f"snapshot_id={i}" for i in range(3)}
    for i in range(3):
        text = read_back(Path(path) / f"snapshot_id={i}")
        assert text == wanted[(i,)]
        assert text.startswith("=== Database Schema ===\nTotal objects: ")


def test_diff_reports(spark, small_sf, model, tmp_path):
    report = comparison.diff_report(model, pairs_from(spark, small_sf))
    write_text(report, str(tmp_path / "diffs"))
    wanted = texts_of(numbered_lines(report), "source_id", "target_id")
    assert len(wanted) == 4
    for (source, target), text in wanted.items():
        folder = tmp_path / "diffs" / f"source_id={source}" / f"target_id={target}"
        assert read_back(folder) == text


def test_files_are_read_in_their_order(spark, small_sf, model, tmp_path):
    """Whole and in order, also where a file is read in many blocks, and in any file order."""
    pairs = pairs_from(spark, small_sf)
    at = datetime(2024, 1, 2, 3, 4)
    path = comparison.write_diff_reports(model, pairs, str(tmp_path), at)
    wanted = texts_of(numbered_lines(comparison.diff_report(model, pairs)), "source_id", "target_id")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        found = read_lines(spark, path, "source_id INT, target_id INT")
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        assert texts_of(found, "source_id", "target_id") == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    unknown = spark.createDataFrame([(0, 99)], "source_id INT, target_id INT")
    for write in (comparison.write_diff_reports, comparison.write_schema_reports):
        with pytest.raises(Exception, match="pair names an unknown snapshot"):
            write(model, unknown, str(tmp_path / "none"), at)


def test_a_report_longer_than_a_range_stays_in_order(spark, model, tmp_path):
    one = model.snapshots.where("snapshot_id = 0")
    report = schema_rows(
        model.stored_objects.where("snapshot_id = 0"),
        model.children.where("snapshot_id = 0"), one,
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_text(report, str(tmp_path / "one"))
        lines = numbered_lines(report)
        wanted = texts_of(lines, "snapshot_id")[(0,)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folder = tmp_path / "one" / "snapshot_id=0"
    assert len(list(folder.glob("part-*.txt"))) > 3
    assert read_back(folder) == wanted
