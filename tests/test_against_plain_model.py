"""Many random snapshots with clashing names, against the plain model."""

import random
from collections import Counter, defaultdict

import plain_model as plain
import pytest
from pyspark.sql import functions as F

from snapdelta import build_model, latest, numbered_lines, object_counts
from snapdelta.operators import compare as cmp
from snapdelta.plans import comparison
from snapdelta.sources.catalog import catalog_of

SNAPSHOTS = range(24)
SCHEMAS = ["a", "a.b", "it's", "pg_catalog", "information_schema"]
NAMES = ["c", "b.c", "Über", "v\"x", "unique_t", "z"]
LEAVES = ["id", "ix_unique_1", "k1", "K1", "日本", "id2"]


def random_relations(seed):
    rnd = random.Random(seed)
    relations = defaultdict(list)
    for s in SNAPSHOTS:
        if s == 3:
            continue  # a snapshot without any object

        def pick(options):
            return rnd.choice(options)

        def add(relation, *row):
            relations[relation].append((s, *row))

        for _ in range(rnd.randint(0, 14)):
            add("columns", pick(SCHEMAS), pick(NAMES), pick(LEAVES), pick(["int", "text"]),
                pick(["YES", "NO"]), pick([None, None, "", "0"]), rnd.randint(1, 4))
        for _ in range(rnd.randint(0, 4)):
            add("indexes", pick(SCHEMAS), pick(NAMES), pick(LEAVES),
                pick(["create unique index i", "CREATE INDEX i", "CREATE UNIQUE INDEX i"]))
        for _ in range(rnd.randint(0, 5)):
            place = (pick(SCHEMAS), pick(NAMES), pick(["k1", "K1", "id"]))
            add("table_constraints", *place,
                pick(["PRIMARY KEY", "FOREIGN KEY", "UNIQUE", "CHECK", "EXCLUDE"]))
            for position in range(rnd.randint(0, 3)):
                add("key_column_usage", *place, pick(LEAVES), position)
        for _ in range(rnd.randint(0, 4)):
            add("views", pick(SCHEMAS), pick(NAMES))
        for oid, name in enumerate(["a", "a.b", "pg_catalog"]):
            add("namespace", oid, name)
        for oid, name in enumerate(["sql", "plpgsql"]):
            add("language", oid, name)
        for oid in range(rnd.randint(0, 6)):
            add("proc", oid, pick(NAMES[:3]), rnd.randint(0, 3), rnd.randint(0, 2),
                pick("ffppaw"), pick(["int", "void"]), pick(["", "x int"]))
        for name in rnd.sample(NAMES, rnd.randint(0, 2)):
            add("sequences", pick(SCHEMAS), name, "bigint", "1", pick(["1", "5"]))
        # Repeats within a snapshot and an unchanged copy of another one.
        for relation in ("views", "table_constraints"):
            if rnd.random() < 0.3 and relations[relation]:
                if relations[relation][-1][0] == s:
                    relations[relation].append(relations[relation][-1])
    for relation, rows in relations.items():
        rows += [(100, *row[1:]) for row in rows if row[0] == 5]
    relations["snapshots"] = [(s, f"db{s}", None) for s in [*SNAPSHOTS, 100]]
    return relations


@pytest.fixture(scope="module")
def relations():
    return random_relations(7)


@pytest.fixture(scope="module")
def model(spark, relations):
    return build_model(catalog_of(spark, relations))


@pytest.fixture(scope="module")
def expected(relations):
    return {s[0]: plain.build(relations, s[0]) for s in relations["snapshots"]}


@pytest.fixture(scope="module")
def pair_list():
    rnd = random.Random(11)
    listed = [(rnd.choice(SNAPSHOTS), rnd.choice(SNAPSHOTS)) for _ in range(40)]
    return sorted({*listed, (3, 0), (0, 3), (3, 3), (6, 6), (5, 100), (100, 5)})


@pytest.fixture(scope="module")
def pairs(spark, pair_list):
    # A repeated pair counts once.
    return spark.createDataFrame(
        [*pair_list, pair_list[0]], "source_id INT, target_id INT"
    )


def shape(item):
    kinds = Counter(c.type for c in item.children)
    return (item.type, item.schema, item.short, item.name, kinds["COLUMN"], kinds["INDEX"],
            kinds["CONSTRAINT"])


SHAPE = ["type", "schema_name", "object_name", "name", "n_columns", "n_indexes",
         "n_constraints"]


def test_objects(model, expected):
    got = defaultdict(Counter)
    for row in model.objects.select("snapshot_id", *SHAPE).collect():
        got[row[0]][tuple(row[1:])] += 1
    for snapshot, items in expected.items():
        assert got[snapshot] == Counter(map(shape, items)), snapshot


def test_leaf_objects_keep_their_fields(model, expected):
    fields = {
        "FUNCTION": ["arguments", "language", "return_type"],
        "PROCEDURE": ["arguments", "language", "return_type"],
        "SEQUENCE": ["data_type", "start_value", "increment"],
    }
    got = Counter(
        (row["snapshot_id"], row["type"], row["name"], tuple(row[f] for f in fields[row["type"]]))
        for row in model.objects.where(F.col("type").isin(*fields)).collect()
    )
    assert got == Counter(
        (s, i.type, i.name, i.fields) for s, items in expected.items() for i in items
        if i.type in fields
    )


def test_children_in_stored_order(model, expected):
    rows = (
        model.children.where(F.col("copy_no") == 1)
        .orderBy("snapshot_id", "type", "schema_name", "object_name", "child_rank",
                 "ordinal_position", "child_name", "constraint_type")
        .collect()
    )
    got = defaultdict(list)
    for r in rows:
        fields = {
            "COLUMN": (r.data_type, r.is_nullable, r.default_value, r.ordinal_position),
            "INDEX": (r.definition, r.is_unique),
            "CONSTRAINT": (r.constraint_type, r.definition),
        }[r.child_type]
        got[r.snapshot_id, r.type, r.schema_name, r.object_name].append(
            (r.child_type, r.child_name, fields)
        )
    wanted = {
        (s, i.type, i.schema, i.short): [(c.type, c.short, c.fields) for c in i.children]
        for s, items in expected.items() for i in items if i.children
    }
    assert {k: Counter(v) for k, v in got.items()} == {k: Counter(v) for k, v in wanted.items()}
    plain_order = {k: [(c[0], c[1]) for c in v] for k, v in wanted.items()}
    assert {k: [(c[0], c[1]) for c in v] for k, v in got.items()} == plain_order


def test_counts_and_latest(model, expected):
    counts = {r[0]: r[1] for r in object_counts(model.objects, model.snapshots).collect()}
    assert counts == {s: len(items) for s, items in expected.items()}
    got = {
        (r["snapshot_id"], r["name"]): tuple(r[f] for f in SHAPE)
        for r in latest(model.objects).collect()
    }
    assert got == {
        (s, n): shape(i)
        for s, items in expected.items() for n, i in plain.last_of_each_name(items).items()
    }


def test_compare_and_summary(model, expected, pairs, pair_list):
    got = defaultdict(Counter)
    for r in comparison.diff(model, pairs).collect():
        sides = tuple(
            None if e is None else (e["type"], e["schema_name"], e["object_name"],
                                    e["n_columns"], e["n_indexes"], e["n_constraints"])
            for e in (r["old"], r["new"])
        )
        got[r["source_id"], r["target_id"]][(r["status"], r["name"], *sides)] += 1
    counts = {
        (r["source_id"], r["target_id"], r["status"]): r["n"]
        for r in comparison.diff_summary(model, pairs).collect()
    }

    def side(item):
        s = shape(item)
        return s[:3] + s[4:]

    total = Counter()
    for pair in pair_list:
        diff = plain.compare(expected[pair[0]], expected[pair[1]])
        wanted = Counter(
            [("added", i.name, None, side(i)) for i in diff["added"]]
            + [("removed", i.name, side(i), None) for i in diff["removed"]]
            + [("modified", o.name, side(o), side(n)) for o, n in diff["modified"]]
        )
        assert got[pair] == wanted, pair
        for status, items in diff.items():
            assert counts.pop((*pair, status)) == len(items)
            total[status] += len(items)
    assert not counts
    assert min(total.values()) > 20


def test_tree_diff(model, expected, pairs, pair_list):
    got = defaultdict(dict)
    for r in comparison.tree_diff(model, pairs).collect():
        node = (r["object_name"], r["object_type"], r["child_type"], r["child_name"])
        got[r["source_id"], r["target_id"]][(*node, r["side"])] = r["n"]
    for pair in pair_list:
        left, right = (plain.tree_nodes(expected[s]) for s in pair)
        wanted = {}
        for node in left | right:
            both = min(left[node], right[node])
            for side, n in (("both", both), ("left_only", left[node] - both),
                            ("right_only", right[node] - both)):
                if n:
                    wanted[(*node, side)] = n
        assert got[pair] == wanted, pair


def test_tree_text(model, expected, pairs, pair_list):
    """Both texts in their order, aligned as far as kinds, names and repeats allow."""
    rows = defaultdict(list)
    for r in comparison.tree_text(model, pairs).orderBy("source_id", "target_id", "line_no").collect():
        rows[r["source_id"], r["target_id"]].append(r)
    texts_of = {s: plain.schema_text(items) for s, items in expected.items()}

    def nodes(items):
        """Each node of a text as object kind, name and number, child kind, name and number."""
        seen, found = Counter(), []
        for item in sorted(items, key=lambda i: i.short):
            place = (item.type, item.short, seen[item.type, item.short])
            seen[item.type, item.short] += 1
            found.append(place)
            inner = Counter()
            for child in sorted(item.children, key=lambda c: c.short):
                found.append((*place, child.type, child.short, inner[child.type, child.short]))
                inner[child.type, child.short] += 1
        return found

    for pair in pair_list:
        got = rows[pair]
        assert [r["line_no"] for r in got] == list(range(1, len(got) + 1))
        for at, s in (("left_line", pair[0]), ("right_line", pair[1])):
            shown = [(r[at], r["line"]) for r in got if r[at] is not None]
            named = [(n, line) for n, line in enumerate(texts_of[s], 1) if line.lstrip().startswith("[")]
            assert shown == named, (pair, at)
        left, right = (set(nodes(expected[s])) for s in pair)
        sides = Counter(r["side"] for r in got)
        assert (sides["both"], sides["left_only"], sides["right_only"]) == (
            len(left & right), len(left - right), len(right - left),
        ), pair


def texts(lines, key):
    got = defaultdict(list)
    for r in lines.orderBy(*key, "line_no").collect():
        got[tuple(r[k] for k in key)].append((r["line_no"], r["line"]))
    for numbered in got.values():
        assert [n for n, _ in numbered] == list(range(1, len(numbered) + 1))
    return {k: [line for _, line in v] for k, v in got.items()}


def test_schema_text(model, expected):
    got = texts(numbered_lines(comparison.schema_report(model)), ["snapshot_id"])
    assert got == {(s,): plain.schema_text(items) for s, items in expected.items()}


def test_diff_text(model, expected, pairs, pair_list):
    report = comparison.diff_report(model, pairs)
    got = texts(numbered_lines(report), ["source_id", "target_id"])
    assert set(got) == set(pair_list)
    for pair in pair_list:
        diff = plain.compare(expected[pair[0]], expected[pair[1]])
        assert got[pair] == plain.diff_text(diff), pair


@pytest.mark.parametrize("schema", ["a", "pg_catalog", "nowhere"])
def test_one_schema(spark, relations, schema):
    objects = build_model(catalog_of(spark, relations), schema).objects
    got = Counter((r["snapshot_id"], *(r[f] for f in SHAPE)) for r in objects.collect())
    assert got == Counter(
        (s[0], *shape(i)) for s in relations["snapshots"]
        for i in plain.build(relations, s[0], schema)
    )


def test_schema_per_snapshot(spark, relations):
    own = {s[0]: [None, "a", "it's"][s[0] % 3] for s in relations["snapshots"]}
    scope = spark.createDataFrame(list(own.items()), "snapshot_id INT, schema_name STRING")
    objects = build_model(catalog_of(spark, relations), scope).objects
    got = Counter((r["snapshot_id"], *(r[f] for f in SHAPE)) for r in objects.collect())
    assert got == Counter(
        (s, *shape(i)) for s, schema in own.items() for i in plain.build(relations, s, schema)
    )


def test_fingerprint_sees_what_equality_sees(model, expected):
    """Two objects of one name have equal fingerprints exactly when they are equal."""
    fields = cmp._ENTRY + ["snapshot_id", "name"]
    rows = latest(model.objects).select(*fields).collect()
    content = {
        (r["snapshot_id"], r["name"]): tuple(
            r[f] for f in [*cmp.CONTENT_FIELDS, "fingerprint"]
        )
        for r in rows
    }
    last = {
        (s, n): i for s, items in expected.items()
        for n, i in plain.last_of_each_name(items).items()
    }
    by_name = defaultdict(list)
    for s, n in last:
        by_name[n].append((s, n))
    compared = 0
    for keys in by_name.values():
        for a in keys:
            for b in keys:
                assert (content[a] == content[b]) == (last[a] == last[b]), (a, b)
                compared += 1
    assert compared > 500
