"""What the plans must look like, and that they hold when nothing is small."""

import os
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from snapdelta import build_model, land, latest, numbered_lines
from snapdelta.operators import report, tree
from snapdelta.plans import comparison
from snapdelta.sources.catalog import RELATIONS, catalog_of, read_catalog
from snapdelta.sources.sample_catalog import catalog_from, pairs_from
from snapdelta.sources.shared_storage import FREE_SETTING, cleaned_up, discard, shared_dir, stored


@pytest.fixture(scope="module")
def landed(spark, small_sf, tmp_path_factory):
    """The sample catalog as landed files, like a real one."""
    path = str(tmp_path_factory.mktemp("landed"))
    land(vars(catalog_from(spark, small_sf)), path)
    pairs_from(spark, small_sf).write.parquet(f"{path}/pairs")
    return path


@pytest.fixture(scope="module")
def model(spark, landed):
    return build_model(read_catalog(spark, landed))


@pytest.fixture(scope="module")
def pairs(spark, landed):
    return spark.read.schema("source_id INT, target_id INT").parquet(f"{landed}/pairs")


@pytest.fixture
def settings(spark):
    """Set session settings for one test."""
    changed = []

    def change(**values):
        for name, value in values.items():
            key = "spark.sql." + name.replace("__", ".")
            changed.append((key, spark.conf.get(key, None)))
            spark.conf.set(key, value)

    yield change
    for key, old in reversed(changed):
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def all_results(model, pairs):
    return {
        "latest": latest(model.objects),
        "summary": comparison.diff_summary(model, pairs),
        "diff": comparison.diff(model, pairs),
        "tree": comparison.tree_diff(model, pairs),
        "tree text": comparison.tree_text(model, pairs),
        "schema text": report.ranged(comparison.schema_report(model)),
        "diff text": report.ranged(comparison.diff_report(model, pairs)),
    }


def test_no_cross_joins_and_no_python(model, pairs):
    for name, df in all_results(model, pairs).items():
        plan = plan_of(df)
        for unwanted in ("CartesianProduct", "NestedLoop", "Python", "collect_list"):
            assert unwanted not in plan, (name, unwanted)


def test_filters_and_columns_reach_the_scan(model, spark, landed):
    scans = plan_of(build_model(read_catalog(spark, landed), "s1").children)
    assert len(re.findall(r"PushedFilters: \[[^\n]*Not\(In\(table_schema", scans)) >= 3
    assert len(re.findall(r"EqualTo\((table_schema|schemaname),s1\)", scans)) >= 4
    # Counting objects reads no types, defaults or definitions.
    counted = plan_of(model.objects.groupBy("snapshot_id").count())
    for unused in ("column_default", "indexdef", "return_type", "start_value"):
        assert unused not in "".join(re.findall(r"ReadSchema: [^\n]*", counted)), unused


def test_repeats_of_a_name_shrink_before_the_shuffle(model, pairs):
    plan = plan_of(latest(model.objects))
    assert plan.count("WindowGroupLimit") >= 2
    assert "partial_max" in plan_of(comparison.diff_summary(model, pairs))


def test_tree_nodes_are_shuffled_once(model, pairs):
    """From the union of objects and children on, one shuffle: by the node's names."""
    plan = comparison.tree_diff(model, pairs)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Union")]
    by_rows = [x for x in re.findall(r"Exchange (\w+)\(([^)]*)\)", above) if "object_name" in x[1]]
    assert len(by_rows) == 1 and "snapshot_id" not in by_rows[0][1], by_rows


def test_report_rows_are_made_once(model, pairs):
    """Finding even ranges reads stored rows, not the joins that make them."""
    for name in ("schema text", "diff text"):
        plan = plan_of(all_results(model, pairs)[name])
        assert "rangepartitioning" in plan and "Join" not in plan and "Aggregate" not in plan, name


def rows_of(df):
    return Counter(map(repr, df.collect()))


def test_same_results_without_broadcasts_and_with_split_keys(model, pairs, settings):
    names = ("summary", "tree", "latest")
    expected = {n: rows_of(all_results(model, pairs)[n]) for n in names}
    lines = rows_of(numbered_lines(comparison.schema_report(model)))
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="1b",
        adaptive__skewJoin__skewedPartitionFactor="1.0",
        adaptive__advisoryPartitionSizeInBytes="4k",
        adaptive__coalescePartitions__minPartitionSize="1k",
        shuffle__partitions="13",
    )
    for n in names:
        assert rows_of(all_results(model, pairs)[n]) == expected[n], n
    assert rows_of(numbered_lines(comparison.schema_report(model))) == lines


def file_scans(df):
    """``(relation, partition filters)`` of every file scan of a plan."""
    plan = plan_of(df)
    return re.findall(r"Location: [^\n]*/(\w+)\][^\n]*\n(?:PartitionFilters: ([^\n]*))?", plan)


def test_a_pair_reads_the_partitions_of_its_snapshots_only(spark, model):
    one = spark.createDataFrame([(1, 2)], "source_id INT, target_id INT")
    for name, df in (
        ("summary", comparison.diff_summary(model, one)), ("tree", comparison.tree_diff(model, one)),
    ):
        found = dict(file_scans(df))
        # A tree shows no key columns.
        landed_relations = set(RELATIONS) - {"snapshots"} - ({"key_column_usage"} if name == "tree" else set())
        assert landed_relations <= set(found), name
        for relation in landed_relations:
            assert "dynamicpruning" in found[relation], (name, relation)
    read = comparison.diff(model, one)
    assert {r.source_id for r in read.select("source_id").distinct().collect()} <= {1}


def test_the_scope_is_resolved_once(spark, model, pairs):
    """One tiny table is all that a relation is joined with, and it is not aggregated again."""
    plan = plan_of(comparison.diff_summary(model, pairs))
    assert "collect_set" not in plan
    assert "collect_set" not in plan_of(comparison.tree_diff(model, pairs))


def test_no_job_runs_while_a_plan_is_built(spark, model, pairs):
    """Making the comparison resolves and checks the run; its results are lazy."""
    run = comparison.Comparison(model, pairs)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job may run")
    try:
        run.summary(), run.tree_diff(), run.objects, run.children
        assert list(tracker.getJobIdsForGroup("building")) == []
        run.summary().collect()
        assert list(tracker.getJobIdsForGroup("building")) != []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_baseline_of_many_pairs_is_reduced_once(spark, model, pairs):
    """Pairs are joined to one narrow row per snapshot and name."""
    plan = comparison.diff_summary(model, pairs)._jdf.queryExecution().optimizedPlan().toString()
    above_pairs = plan[: plan.index("is_old")]
    for wide in ("fingerprint", "arguments", "language"):
        assert wide not in above_pairs.split("Join")[0], wide


def test_landing_again_replaces_a_snapshot(spark, tmp_path):
    path = str(tmp_path / "landing")
    snapshots = [(1, "one", None), (2, "two", "s")]
    column = (2, "s", "t", "c", "int", "NO", None, 1)
    first = catalog_of(spark, {
        "snapshots": snapshots, "views": [(1, "s", "v"), (2, "s", "w")],
        "columns": [(1, "s", "t", "c", "int", "NO", None, 1), column],
    })
    land(vars(first), path)
    assert {p.name for p in (tmp_path / "landing" / "views").glob("snap*")} == {"snapshot_id=1", "snapshot_id=2"}
    again = catalog_of(spark, {"snapshots": snapshots[:1], "views": [(1, "s", "x"), (1, "s", "y")]})
    land({k: v.withColumn("extra", F.lit(1)) for k, v in vars(again).items()}, path)
    found = read_catalog(spark, path)
    assert sorted(map(tuple, found.views.select("snapshot_id", "table_name").collect())) == [(1, "x"), (1, "y"), (2, "w")]
    assert [tuple(r) for r in found.columns.select(*RELATIONS["columns"].replace(",", "").split()[::2]).collect()] == [column]
    assert found.snapshots.count() == 2
    assert found.columns.schema["ordinal_position"].dataType.simpleString() == "int"


def test_stored_tables_are_cleaned_up(spark):
    with cleaned_up(spark):
        kept = stored(spark.range(3))
        (file, *_) = kept.inputFiles()
        assert kept.count() == 3
    assert not os.path.exists(file.removeprefix("file://"))


def test_a_freed_job_leaves_no_shuffle_files_and_no_setting(spark):
    files = lambda: {
        f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
            spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        ) if f.getName().startswith("shuffle_")
    }
    before, rows = files(), spark.range(1000).groupBy((F.col("id") % 10).alias("x")).count()
    kept = stored(rows, free=True, packed=True)
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(FREE_SETTING) == "false"
    assert sorted(map(tuple, kept.collect())) == [(x, 100) for x in range(10)]
    (folder,) = {f.rpartition("/")[0] for f in kept.inputFiles()}
    discard(kept)
    assert not os.path.exists(folder.removeprefix("file://"))


def test_tree_text_leaves_its_lines_alone(model, pairs, spark, landed):
    """What was stored on the way is deleted once the next step has it."""
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    found = comparison.tree_text(model, pairs)
    sizes = [spark.read.parquet(f"{folder}/{name}").count() for name in set(os.listdir(folder)) - before]
    listed = model.objects.count()
    assert found.count() > listed and [n for n in sizes if n > listed] == [found.count()]


def test_pairs_meet_where_tree_nodes_lie(model, pairs, settings, monkeypatch):
    """Behind the ranges of the nodes nothing deals them anew, whatever the settings."""
    made = []

    def kept(df, **how):
        made.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, **how)

    monkeypatch.setattr(tree, "stored", kept)
    settings(autoBroadcastJoinThreshold="-1", requireAllClusterKeysForDistribution="true")
    comparison.tree_text(model, pairs)
    (plan,) = [text for columns, text in made if "left_line" in columns]
    by_rows = [x for x in re.findall(r"Exchange (\w+)\(([^)]*)\)", plan) if "object_name" in x[1]]
    assert [kind for kind, _ in by_rows] == ["rangepartitioning"], by_rows


def test_tree_text_of_names_that_many_ranges_share(spark, settings):
    """Overloads, and equal tables of many schemas with children, cut by ranges anywhere."""
    n = 60
    catalog = catalog_of(
        spark,
        {
            "snapshots": [(s, "db", None) for s in (0, 1)],
            "namespace": [(s, 1, "public") for s in (0, 1)],
            "language": [(s, 1, "sql") for s in (0, 1)],
            "columns": [
                (s, f"s{k:02}", "t", f"c{c}", "int", "YES", None, c)
                for s in (0, 1) for k in range(s, n) for c in range(1 + k % 5)
            ],
            "proc": [(s, o, "f", 1, 1, "f", "int", f"{o:03} int") for s in (0, 1) for o in range(7 * s, n)],
            "indexes": [(0, "s03", "t", f"i{i:02}", "CREATE INDEX") for i in range(n)],
        },
    )
    pairs = spark.createDataFrame([(0, 1), (1, 0), (1, 1)], "source_id INT, target_id INT")

    def text():
        found = comparison.tree_text(build_model(catalog), pairs)
        return sorted((tuple(r) for r in found.collect()), key=repr)

    settings(shuffle__partitions="1")
    whole = text()
    settings(shuffle__partitions="23", adaptive__coalescePartitions__enabled="false")
    assert text() == whole
    # The last tables and overloads of snapshot 0 have no counterpart, in order.
    tables, children = n, sum(1 + k % 5 for k in range(n))
    first = [r for r in whole if r[:2] == (0, 1)]
    assert len(first) >= tables + n and sum(r[6] == "[FUNCTION] f" for r in first) == n
    assert sum(r[6] == "[FUNCTION] f" and r[3] == "left_only" for r in first) == 7
    assert sum(r[6] == "[TABLE] t" and r[3] == "left_only" for r in first) == 1
    assert sum(r[6].startswith("  [COLUMN]") for r in first) >= children - 1


def hot_catalog(spark, n):
    """One table owns most columns, one name most routines, one snapshot most rows."""
    ids = spark.range(n)
    base = catalog_of(
        spark,
        {
            "snapshots": [(0, "hot", None), (1, "small", None)],
            "namespace": [(s, 1, "public") for s in (0, 1)],
            "language": [(s, 1, "sql") for s in (0, 1)],
            "columns": [(1, "public", "wide", "c0", "int", "YES", None, 0)],
            "proc": [(1, 0, "f", 1, 1, "f", "int", "0 int")],
        },
    )
    columns = ids.selectExpr(
        "0 snapshot_id", "'public' table_schema", "'wide' table_name",
        "concat('c', id) column_name", "'int' data_type", "'YES' is_nullable",
        "cast(null as string) column_default", "cast(id as int) ordinal_position",
    )
    proc = ids.selectExpr(
        "0 snapshot_id", "id oid", "'f' proname", "1L pronamespace", "1L prolang",
        "'f' prokind", "'int' return_type", "concat(id, ' int') arguments",
    )
    return type(base)(
        **{
            **vars(base),
            "columns": base.columns.unionByName(columns),
            "proc": base.proc.unionByName(proc),
        }
    )


def test_one_hot_table_one_hot_name_and_one_hot_snapshot(spark):
    n = 50_000
    model = build_model(hot_catalog(spark, n))
    pairs = spark.createDataFrame([(0, 1), (1, 0)], "source_id INT, target_id INT")
    got = {
        (r["source_id"], r["status"]): r["n"]
        for r in comparison.diff_summary(model, pairs).collect()
    }
    # Both names stand on both sides and differ: the wide table and the last overload.
    assert got == {
        (s, status): 2 if status == "modified" else 0
        for s in (0, 1) for status in ("added", "removed", "modified")
    }
    lines = numbered_lines(comparison.schema_report(model)).where("snapshot_id = 0")
    # 3 heading lines, 2 per object or its end, 1 per column.
    assert lines.count() == 3 + 2 * (n + 1) + n
    assert lines.agg(F.max("line_no"), F.countDistinct("line_no")).first() == (
        lines.count(), lines.count(),
    )
    (heading,) = lines.where("line_no = 2").collect()
    assert heading["line"] == f"Total objects: {n + 1}"


def test_many_copies_of_one_view(spark):
    n = 70_000
    catalog = catalog_of(spark, {"snapshots": [(0, "db", None)]})
    views = spark.range(n).selectExpr(
        "0 snapshot_id", "'s' table_schema", "'v' table_name"
    )
    model = build_model(type(catalog)(**{**vars(catalog), "views": views}))
    found = model.objects.agg(F.count("*"), F.max("copy_no"), F.countDistinct("copy_no")).first()
    assert found == (n, n, n)
