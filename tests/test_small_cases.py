"""Hand-made snapshots with exact expected rows and texts."""

import pytest
from pyspark.sql import functions as F

from snapdelta import build_model, diff_rows, latest, numbered_lines, schema_rows
from snapdelta.operators import members
from snapdelta.operators.faults import catalog_faults
from snapdelta.plans import comparison
from snapdelta.sources.catalog import catalog_of

INT = ("integer", "YES", None, 1)


def tables(snapshot, *columns):
    return [(snapshot, "public", table, name, *rest) for table, name, *rest in columns]


def model_of(spark, snapshots=(0, 1), **relations):
    relations["snapshots"] = [(s, f"db{s}", None) for s in snapshots]
    return build_model(catalog_of(spark, relations))


def one_pair(spark, source=0, target=1):
    return spark.createDataFrame([(source, target)], "source_id INT, target_id INT")


def counts(spark, model):
    rows = comparison.diff_summary(model, one_pair(spark)).collect()
    return {r["status"]: r["n"] for r in rows}


def lines(report, order):
    return [r["line"] for r in numbered_lines(report).orderBy(*order, "line_no").collect()]


def diff_lines(spark, model):
    return lines(comparison.diff_report(model, one_pair(spark)), ["source_id", "target_id"])


def test_empty_snapshot(spark):
    model = model_of(spark, snapshots=[0])
    assert model.objects.count() == 0
    assert lines(comparison.schema_report(model), ["snapshot_id"]) == [
        "=== Database Schema ===", "Total objects: 0", "",
    ]


def test_one_table(spark):
    model = model_of(
        spark,
        snapshots=[0],
        columns=tables(
            0,
            ("test_table", "id", "integer", "NO", "nextval('test_table_id_seq'::regclass)", 1),
            ("test_table", "name", "character varying", "NO", None, 2),
        ),
        indexes=[(0, "public", "test_table", "test_table_pkey",
                  "CREATE UNIQUE INDEX test_table_pkey ON public.test_table USING btree (id)")],
        table_constraints=[(0, "public", "test_table", "test_table_pkey", "PRIMARY KEY")],
        key_column_usage=[(0, "public", "test_table", "test_table_pkey", "id", 1)],
    )
    (table,) = model.objects.collect()
    assert (table["type"], table["name"]) == ("TABLE", "public.test_table")
    assert (table["n_columns"], table["n_indexes"], table["n_constraints"]) == (2, 1, 1)
    children = model.children.orderBy("child_rank", "ordinal_position").collect()
    assert [
        (c.child_type, c.child_name, c.data_type, c.is_nullable, c.is_unique, c.definition)
        for c in children
    ] == [
        ("COLUMN", "id", "integer", False, None, None),
        ("COLUMN", "name", "character varying", False, None, None),
        ("INDEX", "test_table_pkey", None, None, True, children[2].definition),
        ("CONSTRAINT", "test_table_pkey", None, None, None, "PRIMARY KEY (id)"),
    ]


def test_identical(spark):
    both = tables(0, ("t", "id", *INT)) + tables(1, ("t", "id", *INT))
    assert counts(spark, model_of(spark, columns=both)) == {
        "added": 0, "removed": 0, "modified": 0,
    }


def test_added(spark):
    model = model_of(spark, columns=tables(1, ("added_table", "id", *INT)))
    assert counts(spark, model) == {"added": 1, "removed": 0, "modified": 0}


def test_removed(spark):
    model = model_of(spark, columns=tables(0, ("removed_table", "id", *INT)))
    assert counts(spark, model) == {"added": 0, "removed": 1, "modified": 0}


def test_modified(spark):
    model = model_of(
        spark,
        columns=tables(0, ("modified_table", "id", *INT))
        + tables(1, ("modified_table", "id", *INT),
                 ("modified_table", "name", "character varying", "YES", None, 2)),
    )
    (row,) = comparison.diff(model, one_pair(spark)).collect()
    assert (row["status"], row["name"]) == ("modified", "public.modified_table")
    assert (row["old"]["n_columns"], row["new"]["n_columns"]) == (1, 2)
    assert diff_lines(spark, model) == [
        "=== Added Objects ===", "(none)", "",
        "=== Removed Objects ===", "(none)", "",
        "=== Modified Objects ===",
        "Object: public.modified_table (TABLE)",
        "  --- Old version ---",
        "  type: TABLE",
        "  name: modified_table",
        "  children:",
        "    type: COLUMN",
        "    name: id",
        "  --- New version ---",
        "  type: TABLE",
        "  name: modified_table",
        "  children:",
        "    type: COLUMN",
        "    name: id",
        "    type: COLUMN",
        "    name: name",
        "",
    ]


def test_diff_text_of_one_added_and_one_removed_table(spark):
    model = model_of(
        spark,
        columns=tables(0, ("table1", "id", *INT))
        + tables(1, ("table2", "name", "character varying", "YES", None, 1)),
    )
    assert diff_lines(spark, model) == [
        "=== Added Objects ===", "- TABLE: table2", "  - COLUMN: name", "",
        "=== Removed Objects ===", "- TABLE: table1", "  - COLUMN: id", "",
        "=== Modified Objects ===", "(none)",
    ]


def test_empty_diff_text(spark):
    assert diff_lines(spark, model_of(spark)) == [
        "=== Added Objects ===", "(none)", "",
        "=== Removed Objects ===", "(none)", "",
        "=== Modified Objects ===", "(none)",
    ]


def test_objects_and_children_are_sorted_by_unqualified_name(spark):
    model = model_of(
        spark,
        snapshots=[0],
        columns=[
            (0, "a", "zebra", "z_col", *INT),
            (0, "a", "zebra", "a_col", "integer", "YES", None, 2),
            (0, "a", "zebra", "m_col", "integer", "YES", None, 3),
            (0, "z", "alpha", "id", *INT),
        ],
        indexes=[(0, "a", "zebra", "b_index", "CREATE INDEX b_index")],
        views=[(0, "m", "middle")],
    )
    assert lines(comparison.schema_report(model), ["snapshot_id"]) == [
        "=== Database Schema ===", "Total objects: 3", "",
        "[TABLE] alpha", "  [COLUMN] id", "",
        "[VIEW] middle", "",
        "[TABLE] zebra", "  [COLUMN] a_col", "  [INDEX] b_index", "  [COLUMN] m_col",
        "  [COLUMN] z_col", "",
    ]


def test_heading_names_the_schema(spark):
    model = model_of(spark, snapshots=[0])
    named = model.snapshots.withColumn("schema_name", F.lit("my_schema"))
    report = schema_rows(model.objects, model.children, named)
    assert lines(report, ["snapshot_id"]) == [
        "=== Database Schema ===", "Schema: my_schema", "Total objects: 0", "",
    ]


def test_a_view_with_columns_is_a_table_too(spark):
    model = model_of(
        spark, columns=tables(1, ("v", "id", *INT)), views=[(1, "public", "v")]
    )
    assert counts(spark, model) == {"added": 2, "removed": 0, "modified": 0}
    (last,) = latest(model.objects).collect()
    assert last["type"] == "VIEW"


def test_a_view_without_columns_keeps_no_table(spark):
    model = model_of(spark, views=[(1, "public", "v")])
    assert [(r["type"], r["n_columns"]) for r in model.objects.collect()] == [("VIEW", 0)]


def test_table_that_becomes_a_view_is_modified(spark):
    model = model_of(
        spark,
        columns=tables(0, ("t", "id", *INT)) + tables(1, ("t", "id", *INT)),
        views=[(1, "public", "t")],
    )
    (row,) = comparison.diff(model, one_pair(spark)).collect()
    assert (row["status"], row["old"]["type"], row["new"]["type"]) == (
        "modified", "TABLE", "VIEW",
    )


def routines(snapshot, *rows):
    return [(snapshot, oid, name, 10, 1, kind, returns, args)
            for oid, (name, kind, returns, args) in enumerate(rows)]


def with_routines(spark, rows, **more):
    return model_of(
        spark,
        proc=rows,
        namespace=[(s, 10, "public") for s in (0, 1)],
        language=[(s, 1, "sql") for s in (0, 1)],
        **more,
    )


def test_overloads_count_each_but_the_last_is_compared(spark):
    model = with_routines(
        spark,
        routines(0, ("f", "f", "int", "a int"), ("f", "f", "int", "b int"))
        + routines(1, ("f", "f", "text", "a int"), ("f", "f", "int", "b int"),
                   ("g", "f", "int", "a int"), ("g", "f", "int", "b int"),
                   ("agg", "a", "int", "a int"), ("win", "w", "int", "a int")),
    )
    # The result of f(a) changed, but f(b) holds the name; both overloads of g are new.
    assert counts(spark, model) == {"added": 2, "removed": 0, "modified": 0}


def test_a_later_kind_hides_a_table_of_the_same_name(spark):
    model = with_routines(
        spark,
        routines(0, ("x", "f", "int", "")) + routines(1, ("x", "f", "int", "")),
        columns=tables(0, ("x", "id", *INT)),
    )
    assert counts(spark, model) == {"added": 0, "removed": 0, "modified": 0}


def test_names_are_compared_joined(spark):
    columns = [(0, "a.b", "c", "id", *INT), (1, "a", "b.c", "id", *INT)]
    assert counts(spark, model_of(spark, columns=columns)) == {
        "added": 0, "removed": 0, "modified": 1,
    }


@pytest.mark.parametrize(
    "old, new, modified",
    [(None, None, 0), (None, "0", 1), (None, "", 1), ("0", "0", 0), ("0", "1", 1)],
)
def test_defaults_are_compared_null_safe(spark, old, new, modified):
    model = model_of(
        spark,
        columns=tables(0, ("t", "id", "integer", "YES", old, 1))
        + tables(1, ("t", "id", "integer", "YES", new, 1)),
    )
    assert counts(spark, model)["modified"] == modified


def test_position_is_compared(spark):
    model = model_of(
        spark,
        columns=tables(0, ("t", "id", "integer", "YES", None, 1))
        + tables(1, ("t", "id", "integer", "YES", None, 2)),
    )
    assert counts(spark, model)["modified"] == 1


def test_constraint_definitions(spark):
    kinds = ["PRIMARY KEY", "FOREIGN KEY", "UNIQUE", "CHECK", "EXCLUDE"]
    catalog = catalog_of(
        spark,
        {
            "table_constraints": [(0, "s", "t", k.lower(), k) for k in kinds]
            + [(0, "s", "t", "no keys", "PRIMARY KEY")],
            "key_column_usage": [
                (0, "s", "t", k.lower(), c, i) for k in kinds for i, c in ((2, "a"), (1, "b"))
            ]
            # Keys of the same name elsewhere.
            + [(0, "s", "other", "unique", "x", 1), (1, "s", "t", "unique", "x", 1)],
        },
    )
    found = members.constraints(catalog.table_constraints, catalog.key_column_usage)
    assert {r["constraint_name"]: r["definition"] for r in found.collect()} == {
        "primary key": "PRIMARY KEY (b,a)",
        "foreign key": "FOREIGN KEY (b,a) REFERENCES ...",
        "unique": "UNIQUE (b,a)",
        "check": "CHECK (...)",
        "exclude": "EXCLUDE",
        "no keys": "PRIMARY KEY ()",
    }


def test_unique_is_any_mention_of_the_word(spark):
    catalog = catalog_of(
        spark,
        {
            "indexes": [
                (0, "s", "t", "a", "create unique index a"),
                (0, "s", "t", "b", "CREATE INDEX ix_unique_b"),
                (0, "s", "t", "c", "CREATE INDEX c"),
            ]
        },
    )
    found = members.indexes(catalog.indexes).collect()
    assert {r["index_name"]: r["is_unique"] for r in found} == {"a": True, "b": True, "c": False}


def test_system_schemas_are_left_out_everywhere(spark):
    catalog = catalog_of(
        spark,
        {
            "columns": [(0, s, "t", "id", *INT) for s in ("pg_catalog", "information_schema")],
            "indexes": [(0, "pg_catalog", "t", "i", "CREATE INDEX i")],
            "table_constraints": [(0, "pg_catalog", "t", "k", "CHECK")],
            "views": [(0, "information_schema", "v")],
            "sequences": [(0, "pg_catalog", "s", "bigint", "1", "1")],
            "proc": [(0, 1, "f", 10, 1, "f", "int", "")],
            "namespace": [(0, 10, "pg_catalog")],
            "language": [(0, 1, "sql")],
        },
    )
    assert build_model(catalog).objects.count() == 0
    assert build_model(catalog, "pg_catalog").objects.count() == 0


def test_view_name_with_a_quote(spark):
    model = model_of(
        spark, snapshots=[0], columns=tables(0, ("it's", "id", *INT)),
        views=[(0, "public", "it's")],
    )
    found = members.view_columns(model.catalog.columns, model.catalog.views).collect()
    assert [(r["table_name"], r["column_name"]) for r in found] == [("it's", "id")]


def test_name_with_a_line_break_takes_two_lines(spark):
    model = model_of(spark, snapshots=[0], views=[(0, "public", "a\nb")])
    assert lines(comparison.schema_report(model), ["snapshot_id"]) == [
        "=== Database Schema ===", "Total objects: 1", "", "[VIEW] a", "b", "",
    ]


@pytest.mark.parametrize("source, target", [(0, 9), (9, 0), (0, None)])
def test_unknown_snapshot_is_an_error(spark, source, target):
    model = model_of(spark)
    with pytest.raises(Exception, match="pair names an unknown snapshot"):
        comparison.diff_summary(model, one_pair(spark, source, target)).collect()


@pytest.mark.parametrize(
    "relation, row",
    [
        ("columns", (0, "s", "t", None, *INT)),
        ("columns", (0, "s", "t", "c", None, "YES", None, 1)),
        ("columns", (0, "s", "t", "c", "int", None, None, 1)),
        ("columns", (0, "s", "t", "c", "int", "YES", None, None)),
        ("indexes", (0, "s", "t", "i", None)),
        ("table_constraints", (0, "s", "t", "k", None)),
        ("sequences", (0, "s", "q", "bigint", None, "1")),
        ("sequences", (0, "s", "q", "bigint", "one", "1")),
    ],
)
def test_missing_required_field_is_an_error(spark, relation, row):
    model = model_of(spark, **{relation: [row]})
    with pytest.raises(Exception, match="required catalog field|CAST_INVALID_INPUT"):
        comparison.diff_summary(model, one_pair(spark)).collect()


def test_missing_result_is_an_error_for_functions_only(spark):
    fine = with_routines(spark, routines(0, ("p", "p", None, "")))
    assert counts(spark, fine)["removed"] == 1
    broken = with_routines(spark, routines(0, ("f", "f", None, "")))
    with pytest.raises(Exception, match="required catalog field is null: return_type"):
        counts(spark, broken)


def test_faults_count_every_required_field(spark):
    rows = {
        "columns": [(0, "s", "t", "c", None, "YES", None, 1), (0, "s", "t", None, *INT),
                    (1, "pg_catalog", None, None, None, None, None, None), (1, "s", "t", "c", *INT)],
        "indexes": [(0, "s", None, None, None)],
        "table_constraints": [(0, "s", "t", "k", None), (0, "s", None, "k", "CHECK")],
        "views": [(1, "s", None)],
        "sequences": [(1, "s", "q", None, "1", "1"), (1, "s", "q", "bigint", None, None)],
        "namespace": [(0, 1, "s"), (0, 2, "information_schema")],
        "language": [(0, 1, None), (0, 2, "sql")],
        "proc": [(0, 1, "f", 1, 1, "f", None, None), (0, 2, None, 1, 2, "p", None, ""),
                 (0, 3, None, 2, 1, "f", None, None), (0, 4, None, 1, 1, "a", None, None)],
    }
    catalog = catalog_of(spark, rows)
    found = catalog_faults(catalog).collect()
    assert {(r.snapshot_id, r.relation, r.field): (r.n_rows, r.n_missing) for r in found if r.n_missing} == {
        (0, "columns", "column_name"): (2, 1), (0, "columns", "data_type"): (2, 1),
        (0, "indexes", "tablename"): (1, 1), (0, "indexes", "indexname"): (1, 1),
        (0, "indexes", "indexdef"): (1, 1),
        (0, "table_constraints", "constraint_type"): (2, 1), (0, "table_constraints", "table_name"): (2, 1),
        (1, "views", "table_name"): (1, 1),
        (1, "sequences", "data_type"): (2, 1), (1, "sequences", "start_value"): (2, 1),
        (1, "sequences", "increment"): (2, 1),
        (0, "proc", "proname"): (2, 1), (0, "proc", "arguments"): (2, 1), (0, "proc", "lanname"): (2, 1),
        (0, "proc", "return_type"): (1, 1),
    }
    assert len({(r.snapshot_id, r.relation, r.field) for r in found}) == len(found)
    assert all(r.n_missing == 0 for r in catalog_faults(catalog, "nowhere").collect())


def test_snapshots_with_schemas_of_their_own(spark):
    """The comparison reads the schema of each side, and the texts name it."""
    catalog = catalog_of(spark, {
        "snapshots": [(0, "db0", "a"), (1, "db1", None), (2, "db2", "nowhere")],
        "columns": [(s, schema, "t", "c", *INT) for s in (0, 1, 2) for schema in ("a", "b")],
    })
    model = build_model(catalog)
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "source_id INT, target_id INT")
    found = comparison.diff(model, pairs).collect()
    assert sorted((r.target_id, r.status, r.name) for r in found) == [(1, "added", "b.t"), (2, "removed", "a.t")]
    text = lines(comparison.schema_report(model), ["snapshot_id"])
    assert text[:3] == ["=== Database Schema ===", "Schema: a", "Total objects: 1"]
    assert "Schema: nowhere" in text and text.count("=== Database Schema ===") == 3


def test_two_schemas_for_one_snapshot_are_an_error(spark):
    catalog = catalog_of(spark, {"snapshots": [(0, "db0", "a"), (0, "db0", "b"), (1, "db1", None)]})
    with pytest.raises(Exception, match="several schemas are wanted of snapshot 0"):
        comparison.diff_summary(build_model(catalog), one_pair(spark)).collect()


def test_diff_rows_can_be_built_from_a_stored_diff(spark, tmp_path):
    model = model_of(spark, columns=tables(1, ("t", "id", *INT)))
    path = str(tmp_path / "diff")
    comparison.diff(model, one_pair(spark)).write.parquet(path)
    report = diff_rows(spark.read.parquet(path), model.children, one_pair(spark))
    assert lines(report, ["source_id", "target_id"])[:3] == [
        "=== Added Objects ===", "- TABLE: t", "  - COLUMN: id",
    ]
