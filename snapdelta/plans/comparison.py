"""Whole computations, from catalog relations to results."""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.expressions import Scope, Wanted, one_scope_each
from snapdelta.operators import compare as cmp
from snapdelta.operators import objects as obj
from snapdelta.operators import report, tree
from snapdelta.sources.catalog import Catalog
from snapdelta.sources.shared_storage import stored
from snapdelta.sources.text_sink import report_dir, write_text


def _headed(snapshots: DataFrame, schema: Scope) -> DataFrame:
    """The known snapshots, once each, with the schema that their heading names."""
    if schema is None:
        return one_scope_each(snapshots)
    ids = snapshots.select("snapshot_id").distinct()
    if isinstance(schema, str):
        return ids.withColumn("schema_name", F.lit(schema))
    return ids.join(one_scope_each(schema), "snapshot_id", "left")


class Model:
    """The objects of all snapshots, their children and the known snapshots.

    Nothing is computed until a result asks for it.
    """

    def __init__(self, catalog: Catalog, scope: Scope, snapshots: DataFrame):
        self.catalog = catalog
        self.scope = scope
        self.snapshots = snapshots

    @cached_property
    def objects(self) -> DataFrame:
        return obj.objects(self.catalog, self.scope)

    @cached_property
    def children(self) -> DataFrame:
        """By far the larger relation; always read straight from the catalog."""
        return obj.children(self.catalog, self.scope)

    @cached_property
    def stored_objects(self) -> DataFrame:
        """The objects, computed once: for plans that read them more than once."""
        return stored(self.objects)

    @cached_property
    def listed_objects(self) -> DataFrame:
        """What a listing shows, stored. Without the fingerprint, the content of the
        children is neither read nor hashed."""
        return stored(self.objects.drop("fingerprint"), free=True)

    @cached_property
    def report(self) -> report.Report:
        """The schema text of the model's snapshots."""
        return report.schema_rows(self.listed_objects, self.children, self.snapshots)


class Comparison(Model):
    """A model of the snapshots that its pairs name.

    Making it resolves the run once: a small stored table of the known snapshots, the
    schema wanted of each and whether it takes part. It is the only filter that each
    relation meets, and prunes the partitions of a catalog landed by snapshot. The job
    that writes it fails on a pair that names an unknown snapshot.
    """

    def __init__(self, model: Model, pairs: DataFrame):
        self.pairs = pairs
        ids = pairs.select(F.explode(F.array("source_id", "target_id")).alias("_side")).distinct()
        unknown = F.col("snapshot_id").isNull()
        resolved = stored(
            model.snapshots.join(ids, F.col("snapshot_id") == F.col("_side"), "full_outer").select(
                F.when(unknown, F.raise_error(cmp.unknown_snapshot("_side")))
                .otherwise(F.col("snapshot_id")).cast("int").alias("snapshot_id"),
                "schema_name",
                F.col("_side").isNotNull().cast("int").alias("taking_part"),
            )
        )
        name = model.scope if isinstance(model.scope, str) else None
        own = model.scope is not None and name is None
        super().__init__(
            model.catalog, Wanted(resolved, name, own),
            resolved.where("taking_part = 1").drop("taking_part"),
        )

    @cached_property
    def sides(self) -> DataFrame:
        return cmp.pair_sides(self.pairs)

    def summary(self) -> DataFrame:
        """Counts per pair and status. Reads the objects once."""
        changes = cmp.name_changes(cmp.name_heads(self.objects), self.sides)
        return cmp.summary(changes, self.pairs)

    @cached_property
    def diff(self) -> DataFrame:
        """The differing objects of every pair."""
        return cmp.compare(self.stored_objects, self.sides)

    def tree_diff(self) -> DataFrame:
        """The aligned nodes of both sides of every pair, counted."""
        return cmp.tree_diff(self.objects, self.children, self.sides)

    def tree_text(self) -> DataFrame:
        """The aligned lines of both sides of every pair, in order."""
        return tree.side_by_side(self.report, self.sides)

    @cached_property
    def diff_report(self) -> report.Report:
        """The difference text of every pair."""
        return report.diff_rows(stored(self.diff), self.children, self.pairs)


def build_model(catalog: Catalog, schema: Scope = None, own_schemas: bool = True) -> Model:
    """The model of a catalog, restricted to ``schema``: a name, or a relation with a name
    per snapshot (null = every schema).

    Without one, each snapshot is restricted to the schema that ``catalog.snapshots``
    names for it. Headings name the schema applied. A catalog that names none may say so
    with ``own_schemas=False``, which saves the lookup.
    """
    snapshots = _headed(catalog.snapshots, schema)
    if schema is None and own_schemas:
        schema = catalog.snapshots.select("snapshot_id", "schema_name")
    return Model(catalog, schema, snapshots)


def diff_summary(model: Model, pairs: DataFrame) -> DataFrame:
    return Comparison(model, pairs).summary()


def diff(model: Model, pairs: DataFrame) -> DataFrame:
    return Comparison(model, pairs).diff


def tree_diff(model: Model, pairs: DataFrame) -> DataFrame:
    return Comparison(model, pairs).tree_diff()


def tree_text(model: Model, pairs: DataFrame) -> DataFrame:
    return Comparison(model, pairs).tree_text()


def schema_report(model: Model) -> report.Report:
    return model.report


def diff_report(model: Model, pairs: DataFrame) -> report.Report:
    return Comparison(model, pairs).diff_report


def write_schema_reports(model: Model, pairs: DataFrame, base: str, run_at: datetime) -> str:
    """Write the schema text of every snapshot of a pair; returns the run's folder.

    Its ``snapshot_id=<id>`` folders hold the texts.
    """
    path = report_dir(base, run_at)
    write_text(Comparison(model, pairs).report, path)
    return path


def write_diff_reports(model: Model, pairs: DataFrame, base: str, run_at: datetime) -> str:
    """Write the difference text of every pair; returns the run's folder.

    Its ``source_id=<id>/target_id=<id>`` folders hold the texts.
    """
    path = report_dir(base, run_at)
    write_text(Comparison(model, pairs).diff_report, path)
    return path
