"""The expected results in plain Python, one snapshot and one pair at a time.

Only for tests: small inputs, whole objects in memory, written from the meaning of
the results and not from the library.
"""

from collections import Counter, defaultdict
from dataclasses import dataclass

SYSTEM = {"pg_catalog", "information_schema"}


@dataclass(frozen=True)
class Item:
    """An object or a child: what equality sees, in order."""

    type: str
    schema: str | None
    short: str
    fields: tuple
    children: tuple = ()

    @property
    def name(self):
        return self.short if self.schema is None else f"{self.schema}.{self.short}"


def build(relations, snapshot, schema=None):
    """Objects of one snapshot in list order."""

    def rows(name, schema_at=None):
        found = [r[1:] for r in relations.get(name, []) if r[0] == snapshot]
        if schema_at is None:
            return found
        return [
            r for r in found
            if r[schema_at] not in SYSTEM and schema in (None, r[schema_at])
        ]

    columns, indexes, constraints = defaultdict(list), defaultdict(list), defaultdict(list)
    for s, t, c, kind, nullable, default, position in rows("columns", 0):
        item = Item("COLUMN", None, c, (kind, nullable == "YES", default, position))
        columns[s, t].append((position, c, item))
    for s, t, i, definition in rows("indexes", 0):
        item = Item("INDEX", None, i, (definition, "UNIQUE" in definition.upper()))
        indexes[s, t].append((i, definition, item))
    groups = defaultdict(list)
    for s, t, c, kind in rows("table_constraints", 0):
        keys = [
            (position, column)
            for ks, kt, kc, column, position in rows("key_column_usage")
            if (ks, kt, kc) == (s, t, c)
        ]
        groups[s, t, c, kind] += keys
    shapes = {
        "PRIMARY KEY": "PRIMARY KEY ({})", "FOREIGN KEY": "FOREIGN KEY ({}) REFERENCES ...",
        "UNIQUE": "UNIQUE ({})", "CHECK": "CHECK (...)",
    }
    for (s, t, c, kind), keys in groups.items():
        listed = ",".join(column for _, column in sorted(keys))
        definition = shapes.get(kind, kind).format(listed)
        constraints[s, t].append((c, kind, Item("CONSTRAINT", None, c, (kind, definition))))

    def ordered(entries):
        return tuple(e[-1] for e in sorted(entries, key=lambda e: e[:-1]))

    tables = sorted(columns)
    tables += sorted(set(indexes) - set(tables))
    tables += sorted(set(constraints) - set(tables))
    result = [
        Item("TABLE", s, t, (), ordered(columns[s, t]) + ordered(indexes[s, t])
             + ordered(constraints[s, t]))
        for s, t in tables
    ]
    result += [
        Item("VIEW", s, v, (), ordered(columns[s, v])) for s, v in sorted(rows("views", 0))
    ]
    namespaces = {oid: n for oid, n in rows("namespace")}
    languages = {oid: n for oid, n in rows("language")}
    for mark, type_ in (("f", "FUNCTION"), ("p", "PROCEDURE")):
        found = []
        for oid, proname, ns, lang, kind, returns, arguments in rows("proc"):
            s = namespaces.get(ns)
            if kind != mark or s is None or lang not in languages or s in SYSTEM:
                continue
            if schema in (None, s):
                fields = (arguments, languages[lang], returns if mark == "f" else None)
                found.append((fields, s, proname, oid))
        # By arguments, language and result: an order the catalog leaves open.
        found.sort(key=lambda f: (f[0][0], f[0][1], f[0][2] or "", f[1], f[2], f[3]))
        result += [Item(type_, s, proname, fields) for fields, s, proname, _ in found]
    for s, n, kind, start, step in sorted(rows("sequences", 0)):
        result.append(Item("SEQUENCE", s, n, (kind, int(start), int(step))))
    return result


def last_of_each_name(items):
    return {item.name: item for item in items}


def compare(old, new):
    olds, news = last_of_each_name(old), last_of_each_name(new)
    return {
        "added": [i for i in new if i.name not in olds],
        "removed": [i for i in old if i.name not in news],
        "modified": [
            (olds[n], news[n]) for n in sorted(olds.keys() & news.keys()) if olds[n] != news[n]
        ],
    }


def tree_nodes(items):
    nodes = Counter()
    for item in items:
        nodes[item.short, item.type, None, None] += 1
        for child in item.children:
            nodes[item.short, item.type, child.type, child.short] += 1
    return nodes


def schema_text(items, schema_name=None):
    out = ["=== Database Schema ==="]
    if schema_name is not None:
        out.append(f"Schema: {schema_name}")
    out += [f"Total objects: {len(items)}", ""]
    for item in sorted(items, key=lambda i: i.short):
        out.append(f"[{item.type}] {item.short}")
        out += [f"  [{c.type}] {c.short}" for c in sorted(item.children, key=lambda c: c.short)]
        out.append("")
    return out


def diff_text(diff):
    def details(item, indent):
        pad = " " * indent
        lines = [f"{pad}type: {item.type}", f"{pad}name: {item.short}"]
        if item.children:
            lines.append(f"{pad}children:")
            for child in item.children:
                lines += details(child, indent + 2)
        return lines

    out = []
    for title, items in (("Added", diff["added"]), ("Removed", diff["removed"])):
        out.append(f"=== {title} Objects ===")
        if not items:
            out.append("(none)")
        for item in sorted(items, key=lambda i: i.name):
            out.append(f"- {item.type}: {item.short}")
            out += [f"  - {c.type}: {c.short}" for c in item.children]
        out.append("")
    out.append("=== Modified Objects ===")
    if not diff["modified"]:
        out.append("(none)")
    for old, new in diff["modified"]:
        out += [f"Object: {old.name} ({old.type})", "  --- Old version ---", *details(old, 2),
                "  --- New version ---", *details(new, 2), ""]
    return out
