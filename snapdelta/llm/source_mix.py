"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are in words. The mix as a whole has ``share`` times the words of all rows. Sources
share it by weight (weights repeat over the sources in code point order, null last); a
source's target stops at ``most`` times its size, and what is left over goes to the
others by weight until none is above.

A hash of id and text deals the rows of a source into 256 blocks, permuted by source. A source
gives whole passes over its blocks, then the blocks of a last pass up to its target. The
block where the target lies is cut finer, by a second level of 256 cells, and in the cell
where it lies by row. What is then missing goes to the one later row whose size comes
closest (it joins the source's last shard), so the words taken come within one row of the
target whatever the source's size. The numbers of blocks that sources give, their quotas, are split among
the output shards by a tree: a node holds the quotas left to it and deals its left half
as many blocks as it has room for, drawn without replacement from all its sources at
once, so the counts are multivariate hypergeometric. A shard's blocks of a source are the
next ones in the source's permuted order, so shards are disjoint, and within a shard
rows are ordered by a hash.

Defined cases: a null text has size 0, a null source is a source of its own. Rows without
an id, or with one id, are told apart by their texts; rows of one id and text are taken
alike. Rows of size 0 are taken like their block. If all sizes are 0 all targets are 0 and
nothing is taken. An empty table gives no rows. A text of any length is counted whole. The
row's own columns are packed into one struct, so any column name will do. All work is
built-in functions. What is gathered per source is one row; what meets in one task is one
row per source, or 256 cells of it. A source has 256 blocks at any size, and a block goes to
one shard whole: beyond 512 shards' worth of words a source's shards grow with it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapdelta.sources.shared_storage import stored

CELLS = 256
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _positions(source: Column, row_id: Column, text: Column, seed: int) -> tuple[Column, Column, Column]:
    """Of a row: its block's place in the source's order, its cell's place, and its order there."""
    own = F.xxhash64(F.lit(seed), row_id, F.xxhash64(F.lit(seed), text))
    turn = F.xxhash64(F.lit(seed + 1), source)
    factor = turn.bitwiseAND(F.lit(CELLS // 2 - 1)) * 2 + 1
    shift = F.shiftrightunsigned(turn, 8).bitwiseAND(F.lit(CELLS - 1))
    place = F.pmod(own.bitwiseAND(F.lit(CELLS - 1)) * factor + shift, F.lit(CELLS))
    cell = F.shiftrightunsigned(own, 8).bitwiseAND(F.lit(CELLS - 1))
    return place.cast("int"), cell.cast("int"), F.shiftrightunsigned(own, 16)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``; one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(order) - 1) % len(weights)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number + 1).alias("weight")
    )
    by_room = Window.orderBy(F.col("room"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        sources.withColumn("cap", most * F.col("source_size")).withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("ahead", F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("all", share * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("all") - F.col("before")) / F.col("ahead"))
    )
    level = F.min_by("level", F.when(F.col("level") < F.col("room"), F.struct("room", F.col("source").isNull(), "source")))
    return filled.withColumn("level", level.over(everything)).select(
        "source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target")
    )


def _cut(rows: DataFrame, plan: DataFrame, place: str, left: str) -> DataFrame:
    """The plan with the first place of each source where the words left are exceeded.

    Adds ``<place>_cut`` (CELLS if they are not) and replaces ``left`` by what is left there.
    """
    cells = rows.groupBy("source", place).agg(F.sum("size").alias("n"))
    # eqNullSafe: a null source is a source.
    known = plan.select(F.col("source").alias("_source"), F.col(left).alias("_left"))
    upto = Window.partitionBy("source").orderBy(place)
    beyond = (
        cells.withColumn("upto", F.sum("n").over(upto))
        .join(known, F.col("source").eqNullSafe(F.col("_source")))
        .where(F.col("upto") > F.col("_left"))
        .groupBy("_source").agg(F.min(F.struct(F.col(place).alias("at"), (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
    )
    joined = plan.join(beyond, F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.withColumn(f"{place}_cut", F.coalesce("cut.at", F.lit(CELLS))).withColumn(
        left, F.col(left) - F.coalesce("cut.before", F.lit(0))
    ).drop("_source", "cut")


def plan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    words_per_shard: int = 4_000_000,
    least_shards: int = 8,
    seed: int = 17,
) -> DataFrame:
    """One row per source: size, target, passes, where its last pass ends, and its blocks' shards.

    There is a shard for each ``words_per_shard`` words of the mix, ``least_shards`` at least.
    """
    source, text = F.col(f"`{source_col}`"), F.col(f"`{text_col}`")
    place, cell, order = _positions(source, F.col(f"`{id_col}`"), text, seed)
    rows = stored(
        df.select(
            source.alias("source"), word_count(text).alias("size"), place.alias("place"), cell.alias("cell"),
            order.alias("order"),
        )
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(F.lit(0))
    wanted = stored(
        targets(rows, weights, share, most).withColumn("passes", whole.cast("int"))
        .withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
        .withColumn("partial", (F.col("left") > 0) & (F.col("passes") < most))
    )
    cut = stored(_cut(rows, wanted, "place", "left"))
    near = rows.join(
        cut.where("partial").select(F.col("source").alias("_s"), "place_cut"), F.col("source").eqNullSafe(F.col("_s"))
    ).where(F.col("place") == F.col("place_cut")).drop("_s", "place_cut")
    cut = stored(_cut(near, cut, "cell", "left"))
    last = near.join(
        cut.select(F.col("source").alias("_s"), "cell_cut", "left"), F.col("source").eqNullSafe(F.col("_s"))
    ).where(F.col("cell") == F.col("cell_cut"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("order"))
    ends = (
        last.withColumn("upto", upto).where(F.col("upto") <= F.col("left"))
        .groupBy("_s").agg(F.max("order").alias("order_cut"), F.max("upto").alias("got"))
    )
    ended = stored(cut.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn(
        "order_cut", F.coalesce("order_cut", F.lit(-1))
    ).withColumn("left", F.col("left") - F.coalesce("got", F.lit(0))).drop("got"))
    # What is still missing goes to the one row behind the cut whose size comes closest.
    key = F.struct("place", "cell", "order")
    off = F.abs(F.col("size") - F.col("left"))
    behind = rows.join(
        ended.where("partial").select(F.col("source").alias("_s"), "place_cut", "cell_cut", "order_cut", "left"),
        F.col("source").eqNullSafe(F.col("_s")),
    ).where((key > F.struct(F.col("place_cut").alias("place"), F.col("cell_cut").alias("cell"), F.col("order_cut").alias("order")))
            & (off < F.col("left")))
    extra = behind.groupBy("_s").agg(F.min(F.struct(off.alias("off"), key.alias("key"))).alias("best"))
    ended = ended.join(extra, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("extra", F.col("best.key")).drop("_s", "best")
    quota = F.col("passes") * CELLS + F.when(F.col("partial"), F.least(F.col("place_cut") + 1, F.lit(CELLS))).otherwise(F.lit(0))
    total = wanted.agg(F.sum("target")).first()[0] or 0.0
    shards = max(least_shards, math.ceil(total / words_per_shard))
    return _with_shards(stored(ended.withColumn("quota", quota.cast("long"))), shards, seed)


def _left_counts(node: str, share: str, seed: int) -> Column:
    """How many blocks of each source go left: blocks pass one by one, each with the
    probability that the room left gives it."""
    return F.expr(f"""
        aggregate(
          counts,
          named_struct('room', CAST(round(aggregate(counts, 0L, (t, c) -> t + c) * {share}) AS BIGINT),
                       'all', aggregate(counts, 0L, (t, c) -> t + c), 'out', CAST(array() AS ARRAY<BIGINT>)),
          (s, c) -> aggregate(
            if(c > 0, sequence(1L, c), CAST(array() AS ARRAY<BIGINT>)),
            named_struct('room', s.room, 'all', s.all, 'got', 0L, 'out', s.out),
            (a, i) -> if(
              (xxhash64({seed}, {node}, size(s.out), i) & 9007199254740991) / 9007199254740992D * a.all < a.room,
              named_struct('room', a.room - 1L, 'all', a.all - 1L, 'got', a.got + 1L, 'out', a.out),
              named_struct('room', a.room, 'all', a.all - 1L, 'got', a.got, 'out', a.out)),
            a -> named_struct('room', a.room, 'all', a.all, 'out', array_append(a.out, a.got))),
          s -> s.out)""")


def split_quotas(quotas: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """``shard, counts`` from one row ``counts``, the sources' quotas in order.

    The first half of a node's shards goes left, and as large a part of its blocks.
    """
    nodes = quotas.select(F.lit(0).alias("shard"), F.lit(shards).alias("width"), "counts")
    while shards > 1:
        half = "CAST(width DIV 2 AS INT)"
        halved = nodes.withColumn("given", F.when(F.col("width") > 1, _left_counts("shard, width", f"({half} / width)", seed)))
        left = F.struct("shard", F.expr(half).alias("width"), F.col("given").alias("counts"))
        right = F.struct(
            F.expr(f"shard + {half}").alias("shard"), F.expr(f"width - {half}").alias("width"),
            F.zip_with("counts", "given", lambda c, g: c - g).alias("counts"),
        )
        same = F.struct("shard", "width", "counts")
        nodes = halved.select(F.explode(F.when(F.col("width") > 1, F.array(left, right)).otherwise(F.array(same))).alias("n")).select("n.*")
        shards = -(-shards // 2)
    return nodes.select("shard", "counts")


def _with_shards(planned: DataFrame, shards: int, seed: int) -> DataFrame:
    """The plan with ``shards``: the shard of each block draw of a source, in order."""
    key = F.struct(F.col("source").isNull().alias("last"), "source", "quota")
    listed = planned.groupBy().agg(F.array_sort(F.collect_list(key)).alias("keys"))
    split = split_quotas(listed.select(F.transform("keys", lambda k: k["quota"]).alias("counts")), shards, seed)
    runs = (
        split.select("shard", F.posexplode("counts").alias("number", "count")).where(F.col("count") > 0)
        .groupBy("number").agg(F.array_sort(F.collect_list(F.struct("shard", "count"))).alias("runs"))
    )
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    draws = F.flatten(F.transform("runs", lambda r: F.array_repeat(r["shard"], r["count"].cast("int"))))
    one = planned.withColumn("number", number).join(runs, "number", "left")
    none = F.array().cast("array<int>")
    return stored(one.withColumn("shards", F.coalesce(draws, none)).drop("runs", "number"))


def mix(
    df: DataFrame,
    planned: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
) -> DataFrame:
    """``row``, the input row as a struct, and ``mix``: size, source_size, target, copies, taken, shards.

    ``shards`` names the shard of each copy. The plan has one row per source, and Spark
    decides by its size whether the join needs a shuffle.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    source, row_id, text = (F.col("row").getField(c) for c in (source_col, id_col, text_col))
    place, cell, order = _positions(source, row_id, text, seed)
    one = F.struct(*[F.col(c) for c in planned.columns])
    joined = rows.join(planned.select(one.alias("plan")), source.eqNullSafe(F.col("plan.source")))
    p = lambda name: F.col(f"plan.{name}")
    inside = (place < p("place_cut")) | (
        (place == p("place_cut")) & ((cell < p("cell_cut")) | ((cell == p("cell_cut")) & (order <= p("order_cut"))))
    ) | F.coalesce((place == p("extra.place")) & (cell == p("extra.cell")) & (order == p("extra.order")), F.lit(False))
    copies = p("passes") + F.when(p("partial") & inside, F.lit(1)).otherwise(F.lit(0))
    size = word_count(text)
    numbers = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
    return joined.select(
        "row",
        F.struct(
            size.alias("size"), p("source_size").alias("source_size"), p("target").alias("target"),
            copies.cast("int").alias("copies"), (copies * size).cast("long").alias("taken"),
            F.transform(
                numbers,
                lambda n: F.coalesce(F.get(p("shards"), n * CELLS + place), F.element_at(p("shards"), -1)),
            ).alias("shards"),
        ).alias("mix"),
    )


def drawn(mixed: DataFrame, id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """One row per copy taken: ``row``, its ``shard`` and ``order``, its place within the shard."""
    copies = mixed.select("row", F.posexplode("mix.shards").alias("copy", "shard"))
    place = F.xxhash64(F.lit(seed + 2), "shard", F.col("row").getField(id_col), "copy")
    return copies.select("row", "shard", place.alias("order"))
