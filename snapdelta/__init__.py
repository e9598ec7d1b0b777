"""Compare database catalogs at fleet scale with Spark.

Catalog relations (columns, indexes, constraints, views, routines, sequences)
of any number of database snapshots go in as DataFrames; typed schema objects,
the differences of snapshot pairs and sorted text reports come out.
"""

from snapdelta.operators.compare import (
    compare,
    name_changes,
    name_heads,
    pair_sides,
    summary,
    tree_diff,
)
from snapdelta.operators.objects import children, latest, object_counts, objects
from snapdelta.operators.report import (
    diff_rows,
    numbered_lines,
    schema_rows,
)
from snapdelta.operators.tree import side_by_side
from snapdelta.plans.comparison import Comparison, Model, build_model
from snapdelta.sources.catalog import Catalog, land, read_catalog
from snapdelta.sources.text_sink import read_lines, report_dir, write_text

__all__ = [
    "Catalog",
    "Comparison",
    "Model",
    "build_model",
    "children",
    "compare",
    "diff_rows",
    "land",
    "latest",
    "name_changes",
    "name_heads",
    "numbered_lines",
    "object_counts",
    "objects",
    "pair_sides",
    "read_catalog",
    "read_lines",
    "report_dir",
    "schema_rows",
    "side_by_side",
    "summary",
    "tree_diff",
    "write_text",
]
