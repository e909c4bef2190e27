"""Exact ranks, tiles and medians without a single-task sort.

A window over all rows, or over a group that holds a third of them, would sort in one task. Instead the rows of large
groups are cut into *cells* of a fixed size that are ordered among themselves. Cutting goes level by level: a cell that
is too large gets up to ``FAN`` limits at its own quantiles, kept in a table that is joined to its rows, and falls apart
into what lies between the limits and what equals them; what is still too large is cut again. A value that alone is too
large for a cell is cut by ranges of the tie key's hash. A row's rank is the number of rows in earlier cells plus its
position in its own cell. Limits are written down before they are used, so any lost task can be recomputed to the same
answer, and neither groups nor limits ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.functions.nulls import join_same
from trialloom.functions.scalars import md5_of
from trialloom.session import materialise

ROWS_PER_CELL = 250_000
#: Most parts between limits into which one level cuts a cell; a power of two.
FAN = 256
BROADCAST_ROWS = 200_000
#: Tie ranges that are summed together in the prefix sums of a group without limits.
RANGES_PER_BLOCK = 4_096


@dataclass(frozen=True)
class _Cells:
    """Rows with ``_cell`` and ``_sub``; if any group had to be cut, a stored table of the cut groups' cells.

    ``table`` has ``_size``, the weight of each cell; ``depth`` is the number of levels of limits.
    """

    rows: DataFrame
    table: DataFrame | None = None
    count: int = 0
    depth: int = 0


def _small(df: DataFrame, count: int) -> DataFrame:
    """A table to be broadcast only if its counted rows are few."""
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


def _below(df: DataFrame, limits: str, value: str, output: str) -> DataFrame:
    """How many of at most FAN - 1 sorted limits lie below a value: one comparison for each bit of the answer."""
    df = df.withColumn(output, F.lit(0))
    step = FAN // 2
    while step:
        here = F.coalesce(F.get(limits, F.col(output) + (step - 1)) < F.col(value), F.lit(False))
        df = df.withColumn(output, F.col(output) + F.when(here, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return df


def _place(df: DataFrame, keys: Sequence[str], value: str | None, tie: str | None, rows_per_cell: int, weight: Column) -> _Cells:
    """Add ``_cell`` (value range) and ``_sub`` (tie range); groups that are small enough stay whole.

    Every level takes two passes over the rows: quantiles of the cells that are too large, and sizes of what they fell
    into. A table of groups or cells is counted before it is used, and broadcast if it is small.
    """
    df = df.withColumns({"_cell": F.lit(0).cast("long"), "_sub": F.lit(0)})
    stats = [F.count(F.lit(1)).alias("_n"), weight.alias("_size")]
    if value is not None:
        # adding zero makes -0.0 and 0.0, which sort as equal, one value for the limits too
        df = df.withColumn("_v", F.col(value).cast("double") + F.lit(0.0))
        stats += [F.min("_v").alias("_low"), F.max("_v").alias("_high"), (F.min(value) == F.max(value)).alias("_single")]
    large = F.col("_n") > rows_per_cell
    wide = large & (F.col("_low") < F.col("_high")) if value is not None else F.lit(False)
    at, depth = [*keys, "_cell"], 0

    def counts(table: DataFrame) -> tuple[int, int, int]:
        return tuple(table.agg(F.count(F.lit(1)), F.count_if(large), F.count_if(wide)).first())

    table = materialise(df.groupBy(*at).agg(*stats).filter(large), "large-groups")
    n, n_large, n_wide = counts(table)
    if not n:
        return _Cells(df.drop("_v"))
    hot, n_hot = table.select(*keys), n
    points = F.array(*[F.lit(i / FAN) for i in range(1, FAN)])
    while n_wide:
        inside = join_same(df, _small(table.filter(wide).select(*at), n_wide), at, "left_semi")
        plain = F.when(~F.isnan("_v"), F.col("_v"))
        limits = F.array_sort(F.array_distinct(F.percentile_approx(plain, points, 4 * FAN))).alias("_limits")
        stored = materialise(inside.groupBy(*at).agg(limits), "cell-limits")
        df = _below(join_same(df, _small(stored, n_wide), at), "_limits", "_v", "_p")
        equal = F.coalesce(F.get("_limits", F.col("_p")) == F.col("_v"), F.lit(False))
        df = df.withColumn("_cell", F.col("_cell") * (2 * FAN) + 2 * F.col("_p") + equal.cast("int")).drop("_limits", "_p")
        depth += 1
        table = materialise(_of(hot, n_hot, keys, df.groupBy(*at).agg(*stats)), "cells")
        n, n_large, n_wide = counts(table)
    table = table.withColumn("_sub", F.lit(0))
    if n_large and tie is not None:
        single = table.filter(large) if value is None else table.filter(large & F.col("_single"))
        parts = single.select(*at, F.ceil(F.col("_n") / rows_per_cell).alias("_parts"))
        df = join_same(df, _small(parts, n_large), at)
        df = df.withColumn("_sub", F.coalesce(_tie_range(tie, F.col("_parts")), F.lit(0))).drop("_parts")
        table = materialise(_of(hot, n_hot, keys, df.groupBy(*at, "_sub").agg(weight.alias("_size"))), "cells")
        n = table.count()
    return _Cells(df.drop("_v"), table, n, depth)


def _of(hot: DataFrame, n_hot: int, keys: Sequence[str], sizes: DataFrame) -> DataFrame:
    """The sizes of the cut groups; other groups hold one cell each and need no offset."""
    return join_same(sizes, _small(hot, n_hot), keys, "left_semi") if keys else sizes


def _tie_range(tie: str, parts: Column) -> Column:
    """Which of ``parts`` equal ranges of the hash an md5 falls in; follows the order of the hash."""
    head = F.conv(F.substring(tie, 1, 8), 16, 10).cast("long")
    return F.floor(head * parts / F.lit(16**8)).cast("int")


def _with_offsets(cells: _Cells, keys: Sequence[str]) -> DataFrame:
    """Rows with ``_before`` (weight of earlier cells of the group), ``_size`` and ``_total``.

    The prefix sums have two levels: over blocks of neighbouring cells, and within a block. A block is a cell of the
    first level of limits, or some thousand tie ranges of a group that has no limits.
    """
    depth = cells.depth
    block = F.floor(F.col("_cell") / (2 * FAN) ** (depth - 1)) if depth else F.floor(F.col("_sub") / RANGES_PER_BLOCK)
    sizes = cells.table.withColumn("_block", block)
    blocks = sizes.groupBy(*keys, "_block").agg(F.sum("_size").alias("_n"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.sum("_n").over(group).alias("_total")
    )
    within = Window.partitionBy(*keys, "_block").orderBy("_cell", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_inner", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    found = join_same(sizes, blocks, [*keys, "_block"])
    found = found.select(*keys, "_cell", "_sub", "_size", (F.col("_start") + F.col("_inner")).alias("_before"), "_total")
    return join_same(cells.rows, _small(found, cells.count), [*keys, "_cell", "_sub"])


def with_rank(
    df: DataFrame,
    value: str | None,
    unique_key: Sequence[str],
    partition_by: Sequence[str] = (),
    rows_per_cell: int = ROWS_PER_CELL,
    seed: int | None = None,
    store: bool = False,
) -> DataFrame:
    """Add ``rank`` (1-based) and ``total`` by ``value`` ascending, ties by the md5 of ``unique_key``.

    Without ``value`` the order is the hash order alone, i.e. a reproducible random permutation. Rows whose
    value is NULL are not ranked and not counted; they keep NULL. ``df`` is read a few times (sizes, limits, cells,
    rows): with ``store`` it is written once to the scratch area first, which pays if it is costly to compute.
    """
    df = materialise(df, "ranked") if store else df
    keys = list(partition_by)
    parts = list(unique_key) if seed is None else [seed, *unique_key]
    hashed = df.withColumn("_tie", md5_of(*parts))
    known = hashed if value is None else hashed.filter(F.col(value).isNotNull())
    cells = _place(known, keys, value, "_tie", rows_per_cell, F.count(F.lit(1)))
    placed = cells.rows
    group = Window.partitionBy(*keys, "_cell", "_sub")
    order = [F.col(c) for c in ([] if value is None else [value]) + ["_tie", *unique_key]]
    position = F.row_number().over(group.orderBy(*order))
    if cells.table is not None:
        placed = _with_offsets(cells, keys)
        rank = F.coalesce("_before", F.lit(0)) + position
        total = F.coalesce("_total", F.count(F.lit(1)).over(group))
    else:
        rank, total = position, F.count(F.lit(1)).over(group)
    ranked = placed.withColumns({"rank": rank.cast("long"), "total": total.cast("long")})
    ranked = ranked.drop("_tie", "_cell", "_sub", "_size", "_before", "_total")
    if value is None:
        return ranked
    blank = df.filter(F.col(value).isNull()).withColumns(
        {"rank": F.lit(None).cast("long"), "total": F.lit(None).cast("long")}
    )
    return ranked.unionByName(blank)


def tile(k: int, rank: Column | str = "rank", total: Column | str = "total", legacy: bool = False) -> Column:
    """Which of ``k`` equal parts a rank falls in.

    The standard rule gives the first ``total mod k`` parts one row more; ``legacy`` spreads the remainder.
    """
    r = F.col(rank) if isinstance(rank, str) else rank
    n = F.col(total) if isinstance(total, str) else total
    if legacy:
        return (F.floor(F.lit(k) * (r - 1) / n) + 1).cast("int")
    small = F.floor(n / k)
    extra = F.pmod(n, F.lit(k))
    edge = extra * (small + 1)
    in_large = F.floor((r - 1) / (small + 1)) + 1
    in_small = extra + F.floor(F.try_divide(r - edge - 1, small)) + 1
    return F.when(r <= edge, in_large).when(r > edge, in_small).cast("int")


def with_ntile(
    df: DataFrame,
    value: str,
    k: int,
    unique_key: Sequence[str],
    partition_by: Sequence[str] = (),
    output: str = "tile",
    legacy: bool = False,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    ranked = with_rank(df, value, unique_key, partition_by, rows_per_cell)
    return ranked.withColumn(output, tile(k, legacy=legacy)).drop("rank", "total")


def exact_median(
    df: DataFrame, value: str, partition_by: Sequence[str] = (), rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Interpolated median per group, NULLs skipped.

    Equal values are counted where they are read, so only distinct values are shuffled; they are stored, cut into cells
    where a group has too many, and the two middle places are found by cumulative counts.
    """
    keys = list(partition_by)
    known = df.filter(F.col(value).isNotNull()).select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_value"))
    counted = materialise(known.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    cells = _place(counted, keys, "_value", None, rows_per_cell, F.sum("_n"))
    rows = cells.rows
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    if cells.table is not None:
        rows = _with_offsets(cells, keys)
        own = Window.partitionBy(*keys, "_cell")
        rows = rows.withColumns({"_before": F.coalesce("_before", F.lit(0)), "_size": F.coalesce("_size", F.sum("_n").over(own)), "_total": F.coalesce("_total", F.sum("_n").over(own))})
        rows = rows.filter((F.col("_before") < high) & (F.col("_before") + F.col("_size") >= low))
    else:
        rows = rows.withColumns({"_before": F.lit(0), "_total": F.sum("_n").over(Window.partitionBy(*keys, "_cell"))})
    upto = Window.partitionBy(*keys, "_cell").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_before") + F.sum("_n").over(upto)
    covered = rows.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    covers_low = (F.col("_first") <= low) & (F.col("_last") >= low)
    covers_high = (F.col("_first") <= high) & (F.col("_last") >= high)
    middle = (F.max(F.when(covers_low, F.col("_value"))) + F.max(F.when(covers_high, F.col("_value")))) / 2
    return covered.groupBy(*keys).agg(middle.alias("median"))


def running_extremes(
    df: DataFrame,
    order_by: str,
    upto: dict[str, Column],
    onward: dict[str, Column],
    unique_key: Sequence[str],
    partition_by: Sequence[str] = (),
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Running maxima from the start (``upto``) and running minima from the end (``onward``) in the order of a value.

    The columns may use ``rank`` and ``total``. A group of any size is an ordered scan over ranges of ranks: each range
    gives its own maximum and minimum, these are carried over the few ranges of a group, and rows add what lies in
    their own range. Rows without a value keep NULL.
    """
    keys = list(partition_by)
    at = [*keys, "_range"]
    # sizes, ranks, ends and rows all read it
    ranked = materialise(with_rank(df, order_by, unique_key, keys, rows_per_cell, store=True), "ranked")
    ranked = ranked.withColumns({**upto, **onward}).withColumn("_range", F.floor((F.col("rank") - 1) / rows_per_cell))
    known = F.col("rank").isNotNull()
    within = Window.partitionBy(*at).orderBy("rank")
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    own = {c: F.when(known, F.max(c).over(within.rowsBetween(first, 0))) for c in upto}
    own |= {c: F.when(known, F.min(c).over(within.rowsBetween(0, last))) for c in onward}
    ends = ranked.filter(known).groupBy(*at).agg(*[F.max(c).alias(f"_{c}") for c in upto], *[F.min(c).alias(f"_{c}") for c in onward])
    ranges = Window.partitionBy(*keys).orderBy("_range")
    carried = {f"_{c}": F.max(f"_{c}").over(ranges.rowsBetween(first, -1)) for c in upto}
    carried |= {f"_{c}": F.min(f"_{c}").over(ranges.rowsBetween(1, last)) for c in onward}
    ends = materialise(ends.select(*at, *[v.alias(k) for k, v in carried.items()]), "range-ends")
    out = join_same(ranked.withColumns(own), _small(ends, ends.count()), at)
    # the extreme of a NULL and a value is the value
    out = out.withColumns({c: F.when(known, F.greatest(c, f"_{c}")) for c in upto} | {c: F.when(known, F.least(c, f"_{c}")) for c in onward})
    return out.drop("_range", *carried)
