"""A Merkle manifest of a dataset, with a proof per row.

Every row is a leaf: the SHA-256 of its fields, each ``-`` if null and else its UTF-8 byte
count, a colon and the value. The leaves of one group (``lang``) in order of their id form
a tree: while several nodes remain, every ``fanout`` consecutive ones (fewer at the end,
even one) become the hash of their hexadecimal digests. What remains is the group's
subroot. The subroots in order of the group (null first, bytewise) form the top tree.

Method: a node's rank is written in digits, each worth ``LEVELS`` levels of the tree, and
``DIGITS`` of them make a block of at most ``fanout ** (LEVELS * DIGITS)`` nodes. Blocks
are dealt out once; then the digit columns are grouped away one after the other, nesting
the structs of the children and hashing their levels, without another shuffle. The roots
of the blocks are the nodes of the next round, until one is left. On the way back every
block gets the siblings above it by one more grouping with its single row from the round
above; nested transforms put the siblings of the inner levels in front, and an explode
emits the proofs. No proof takes a join, and no group or task holds more than a block.

Ranks come from a range sort by group and id that is written once: a row's place in its
range plus the rows of its group in earlier ranges. So a group may own any share of rows.

Defined cases: a null id comes first; rows of one id come in the order of their leaf.
Repeated rows are leaves of their own. An empty table gives an empty manifest. Only a
row's own hash looks at its text, whole, whatever its length. The top tree takes any
number of groups. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.sources.shared_storage import stored

LEVELS, DIGITS = 3, 3
_STEPS = "array<struct<before:string,after:string>>"


def field_text(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]).cast("binary"), 256)


def ranked(nodes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows, stored, with ``rank`` from 0 within their group and ``total``, its size."""
    keys = [*group, *order]
    placed = stored(
        nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    )
    runs = placed.groupBy("_range", *group).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    by = f"partition by {', '.join(group)}" if group else ""
    offsets = runs.selectExpr(
        "_range", *group, "_first",
        f"coalesce(sum(_n) over ({by} order by _range rows between unbounded preceding and 1 preceding), 0) as _before",
        f"sum(_n) over ({by}) as total",
    )
    return placed.join(offsets, ["_range", *group]).withColumn(
        "rank", F.col("_place") - F.col("_first") + F.col("_before")
    ).drop("_range", "_place", "_first", "_before")


def _next_level(hashes: Column, total: Column, fanout: int, level: int) -> Column:
    """The parents of the nodes of a level; the root of the tree stays as it is."""
    steps = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / F.lit(fanout)).cast("int"))

    def parent(i: Column) -> Column:
        return F.sha2(F.array_join(F.slice(hashes, i * fanout + 1, F.lit(fanout)), "").cast("binary"), 256)

    return F.when(total > fanout**level, F.transform(steps, parent)).otherwise(hashes)


def _roll_up(nodes: DataFrame, group: list[str], fanout: int, payload: list[str]) -> DataFrame:
    """``group, total, rank, tree`` with one row per block: its rank and its nested nodes.

    ``nodes`` has ``group, total, rank, hash`` and ``payload``.
    """
    base = fanout**LEVELS
    digits = [f"_digit{d}" for d in range(DIGITS)]
    rows = nodes.select(
        *group, "total", F.expr(f"rank div {base**DIGITS}L").alias("_block"),
        *[F.expr(f"cast(rank div {base**d}L % {base} as int)").alias(name) for d, name in enumerate(digits)],
        F.struct("hash", *payload).alias("tree"),
    ).repartition(*group, "_block")
    for d, digit in enumerate(digits):
        outer = [*group, "_block", *digits[d + 1:]]
        children = F.transform(F.sort_array(F.collect_list(F.struct(digit, "tree"))), lambda c: c["tree"])
        steps = rows.groupBy(*outer, "total").agg(children.alias("_children")).withColumn(
            "_level0", F.transform("_children", lambda c: c["hash"])
        )
        for i in range(LEVELS):
            level = _next_level(F.col(f"_level{i}"), F.col("total"), fanout, d * LEVELS + i)
            steps = steps.withColumn(f"_level{i + 1}", level)
        levels = [f"_level{i}" for i in range(LEVELS + 1)]
        rows = steps.select(
            *outer, "total",
            F.struct(
                F.element_at(levels[-1], 1).alias("hash"), F.array(*levels[:-1]).alias("levels"),
                F.col("_children").alias("children"),
            ).alias("tree"),
        )
    return rows.withColumnRenamed("_block", "rank")


def _siblings(levels: Column, index: Column, total: Column, fanout: int, below: int) -> Column:
    """The steps from child ``index`` to the root of its struct: per level of the tree the
    digests before and after it, empty if it is alone."""
    made = []
    for i in range(LEVELS):
        level = F.element_at(levels, i + 1)
        at = F.floor(index / F.lit(fanout**i)).cast("int")
        first = at - at % fanout
        step = F.struct(
            F.array_join(F.slice(level, first + 1, at - first), "").alias("before"),
            F.array_join(F.slice(level, at + 2, first + fanout - 1 - at), "").alias("after"),
        )
        made.append(F.when(total > fanout ** (below + i), F.array(step)).otherwise(F.array().cast(_STEPS)))
    return F.concat(*made)


def _emitted(tree: Column, above: Column, total: Column, fanout: int, payload: list[str], digit: int) -> Column:
    """The nodes below ``tree`` with their steps, from the outermost digit inwards."""
    levels, children = tree["levels"], tree["children"]

    def child(node: Column, index: Column) -> Column:
        steps = F.concat(_siblings(levels, index, total, fanout, digit * LEVELS), above)
        if digit == 0:
            leaf = F.struct(*[node[name].alias(name) for name in ["hash", *payload]], steps.alias("steps"))
            return F.array(leaf)
        return _emitted(node, steps, total, fanout, payload, digit - 1)

    return F.flatten(F.transform(children, child))


class Trees:
    """The trees over ranked nodes, one per group, as stored rounds of blocks."""

    def __init__(self, nodes: DataFrame, group: list[str], fanout: int, payload: list[str]):
        self.group, self.fanout, self.payload = group, fanout, payload
        base = fanout ** (LEVELS * DIGITS)
        size = nodes.agg(F.max("total")).first()[0] or 0
        self.rounds = [stored(_roll_up(nodes, group, fanout, payload))]
        while size > base:
            roots = self.rounds[-1].select(
                *group, "rank", F.col("tree.hash").alias("hash"),
                F.expr(f"(total + {base - 1}) div {base}L").alias("total"),
            )
            self.rounds.append(stored(_roll_up(roots, group, fanout, [])))
            size = -(-size // base)
        self.roots = self.rounds[-1].select(*group, F.col("tree.hash").alias("hash"))

    def proofs(self, above: DataFrame, carried: list[str]) -> DataFrame:
        """``group, hash, payload, steps, carried`` per node; ``above`` has a row per group
        with the ``above`` steps beyond its root and columns to carry."""
        base = self.fanout ** (LEVELS * DIGITS)
        above = above.withColumn("rank", F.lit(0).cast("bigint"))
        for i in range(len(self.rounds) - 1, -1, -1):
            # A block has one row here and one above, so this takes no join and no group grows.
            met = (
                self.rounds[i].unionByName(above, allowMissingColumns=True).groupBy(*self.group, "rank")
                .agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("total", "tree", "above", *carried)])
            )
            emitted = _emitted(
                F.col("tree"), F.col("above"), F.col("total"), self.fanout, self.payload if i == 0 else [], DIGITS - 1
            )
            out = met.select(*self.group, "rank", *carried, F.posexplode(emitted).alias("_at", "_node"))
            above = out.select(
                *self.group, *carried, (F.col("rank") * base + F.col("_at")).alias("rank"), F.col("_node.steps").alias("above")
            )
        return out.select(*self.group, *carried, "_node.*")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(
        steps, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]).cast("binary"), 256)
    )


def siblings_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def manifest(
    rows: DataFrame,
    fields: Iterable[str],
    id_col: str = "doc_id",
    group_col: str = "lang",
    fanout: int = 2,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """``id, group, extra, leaf, steps, subroot, root`` per row.

    ``fields`` are hashed in this order; ``extra`` are further columns to carry along, from
    expressions over the input.
    """
    extra = extra or {}
    group = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    leaves = rows.select(
        group.alias("_group"), F.col(f"`{id_col}`").alias("_id"),
        digest(*[F.col(f"`{f}`") for f in fields]).alias("hash"),
        F.struct(F.lit(True).alias("_"), *[c.alias(name) for name, c in extra.items()]).alias("_extra"),
    )
    trees = Trees(ranked(leaves, ["_group"], ["_id", "hash"]), ["_group"], fanout, ["_id", "_extra"])
    tops = ranked(trees.roots.withColumnRenamed("_group", "_name"), [], ["_name"]).withColumn("_all", F.lit(0))
    top = Trees(tops, ["_all"], fanout, ["_name"])
    beyond = top.roots.select("_all", F.array().cast(_STEPS).alias("above"), F.col("hash").alias("root"))
    of_groups = top.proofs(beyond, ["root"]).select(
        F.col("_name").alias("_group"), F.col("steps").alias("above"), F.col("hash").alias("subroot"), "root"
    )
    return trees.proofs(of_groups, ["subroot", "root"]).select(
        F.col("_id").alias(id_col), F.col("hash").alias("leaf"), "steps", "subroot", "root",
        *[F.col(f"_extra.`{name}`").alias(name) for name in extra],
    )
