"""Row order without one-task groups.

A plain SQL window puts all rows of a key in one task. That is right while every key is
small, and fails when one key holds a large part of the table. The functions here measure
the largest key first (unless the caller states a bound that already settles it):

* small keys: one ordinary window per key, nothing else;
* a large key: the rows are range-partitioned by (key, order) into runs of bounded size,
  written once, worked on per run, and the effect of the earlier runs (a count, a sum, a
  last value) is added from a table with one row per (key, run).

Runs, and the keys of a table that is large as a whole, are dealt to a stated number of tasks:
adaptive execution joins partitions by their compressed size, which would put most of them
into one task again, with a sort buffer and a window buffer for all of its rows.

``order`` must be a total order within a key, so that results do not depend on the layout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.storage import durable

MAX_GROUP_ROWS = "spark.pulsegrid.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 2_000_000

RUN = "_run"
OrderKey = str | Column


def max_group_rows(spark: SparkSession) -> int:
    """Rows of one key that may go through one task."""
    return int(spark.conf.get(MAX_GROUP_ROWS, str(DEFAULT_MAX_GROUP_ROWS)))


def key_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the table and of its largest key."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    return total or 0, largest or 0


def split_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[OrderKey], group_rows: int | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame | None:
    """``df`` with a run number that splits large keys in order; None if no key is large.

    Runs are numbered in the order of (keys, order). ``group_rows`` is an upper bound on the
    rows of one key, if the caller knows one; ``sizes`` are those of ``key_sizes``, if already taken.
    """
    limit = max_group_rows(df.sparkSession)
    if group_rows is not None and group_rows <= limit:
        return None
    total, largest = sizes or key_sizes(df, keys)
    if largest <= limit:
        return None
    runs = max(2, math.ceil(2 * total / limit))
    ranged = df.repartitionByRange(runs, *[F.col(k) for k in keys], *order)
    return durable(ranged.withColumn(RUN, F.spark_partition_id()), "runs")


def _by_run(runs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of split keys dealt by ``names`` to as many tasks as there are runs."""
    return runs.repartition(max(2, runs.select(RUN).distinct().count()), *names)


def attach(rows: DataFrame, small: DataFrame, names: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join on ``names`` that keeps rows with null keys and adds ``columns``.

    Whether ``small`` is broadcast is left to its size. Callers write a small aggregate first
    (``durable``), since a written table tells the planner its size before the rows are shuffled.
    """
    side = small.select(*[F.col(n).alias(f"_on_{n}") for n in names], *columns)
    match = reduce(lambda a, b: a & b, [rows[n].eqNullSafe(side[f"_on_{n}"]) for n in names])
    return rows.join(side, match, "left").drop(*[f"_on_{n}" for n in names])


def _totals_of_earlier_runs(runs: DataFrame, keys: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    per_run = runs.groupBy(*keys, RUN).agg(*[c.alias(n) for n, c in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    return durable(per_run.select(*keys, RUN, *[F.sum(n).over(earlier).alias(n) for n in totals]), "offsets")


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[OrderKey],
    name: str = "pos",
    group_rows: int | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """0-based position of every row in its key."""
    limit = max_group_rows(df.sparkSession)
    if sizes is None and (group_rows is None or group_rows > limit):
        sizes = key_sizes(df, keys)
    runs = split_runs(df, keys, order, group_rows, sizes)
    if runs is None:
        if sizes and sizes[0] > limit:
            df = df.repartition(math.ceil(8 * sizes[0] / limit), *keys)
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(name, (number - 1).cast("long"))
    number = F.row_number().over(Window.partitionBy(*keys, RUN).orderBy(*order))
    offsets = _totals_of_earlier_runs(runs, keys, {"_before": F.count(F.lit(1))})
    return (
        attach(_by_run(runs, [*keys, RUN]).withColumn(name, number), offsets, [*keys, RUN], ["_before"])
        .withColumn(name, (F.col(name) - 1 + F.coalesce("_before", F.lit(0))).cast("long"))
        .drop("_before", RUN)
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[OrderKey],
    sums: dict[str, Column],
    group_rows: int | None = None,
) -> DataFrame:
    """Sums over all rows of the key up to and including the row."""
    runs = split_runs(df, keys, order, group_rows)
    if runs is None:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()})
    upto = Window.partitionBy(*keys, RUN).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    offsets = _totals_of_earlier_runs(runs, keys, {f"_before_{n}": F.sum(c) for n, c in sums.items()})
    local = _by_run(runs, [*keys, RUN]).withColumns({n: F.sum(c).over(upto) for n, c in sums.items()})
    joined = attach(local, offsets, [*keys, RUN], [f"_before_{n}" for n in sums])
    return joined.withColumns(
        {
            n: F.when(F.col(f"_before_{n}").isNull(), F.col(n)).otherwise(
                F.coalesce(n, F.lit(0)) + F.col(f"_before_{n}")
            )
            for n in sums
        }
    ).drop(RUN, *[f"_before_{n}" for n in sums])


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    backward: bool = False,
    group_rows: int | None = None,
) -> DataFrame:
    """Last non-null value at or before the row (``backward``: first one at or after it)."""
    return known_around(df, keys, order, {} if backward else values, values if backward else {}, group_rows)


def known_around(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: dict[str, Column],
    after: dict[str, Column],
    group_rows: int | None = None,
) -> DataFrame:
    """Last non-null values at or before the row and first ones at or after it, from one layout."""
    runs = split_runs(df, keys, order, group_rows)
    split = [] if runs is None else [RUN]
    rows = df if runs is None else _by_run(runs, [*keys, RUN])

    def frame(backward: bool) -> WindowSpec:
        direction = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
        return Window.partitionBy(*keys, *split).orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0)

    sides = [(n, c, False) for n, c in before.items()] + [(n, c, True) for n, c in after.items()]
    local = rows.withColumns({n: F.last(c, True).over(frame(b)) for n, c, b in sides})
    if runs is None:
        return local

    def outermost(c: Column, backward: bool) -> Column:
        nearest = F.min_by if backward else F.max_by
        return nearest(c, F.when(c.isNotNull(), F.struct(*order)))

    def from_other_runs(name: str, backward: bool) -> Column:
        run_order = F.col(RUN).desc() if backward else F.col(RUN).asc()
        earlier = Window.partitionBy(*keys).orderBy(run_order).rowsBetween(Window.unboundedPreceding, -1)
        return F.last(name, True).over(earlier).alias(name)

    carry = {n: f"_carry_{n}" for n, _, _ in sides}
    per_run = runs.groupBy(*keys, RUN).agg(*[outermost(c, b).alias(carry[n]) for n, c, b in sides])
    carried = durable(per_run.select(*keys, RUN, *[from_other_runs(carry[n], b) for n, _, b in sides]), "carried")
    joined = attach(local, carried, [*keys, RUN], list(carry.values()))
    return joined.withColumns({n: F.coalesce(n, c) for n, c in carry.items()}).drop(RUN, *carry.values())


def row_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[OrderKey],
    before: int,
    after: int,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    group_rows: int | None = None,
) -> DataFrame:
    """``compute(rows, window)`` for frames of at most ``before`` rows back and ``after`` rows ahead.

    ``compute`` adds columns and keeps the rows. Large keys are cut into blocks, and each block
    gets copies of the rows that its edge frames reach into; the copies are dropped afterwards.
    """
    limit = max_group_rows(df.sparkSession)
    if group_rows is not None and group_rows <= limit:
        return compute(df, Window.partitionBy(*keys).orderBy(*order))
    sizes = key_sizes(df, keys)
    if sizes[1] <= limit:
        return compute(df, Window.partitionBy(*keys).orderBy(*order))
    block = max(limit // 2, before + after + 1)
    placed = positions(df, keys, order, "_at", group_rows, sizes)
    home = F.floor(F.col("_at") / block)
    first = F.greatest(F.floor((F.col("_at") - after) / block), F.lit(0))
    last = F.floor((F.col("_at") + before) / block)
    copies = placed.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(first, last)))
    copies = copies.repartition(math.ceil(sizes[0] / block), *keys, "_block")
    done = compute(copies, Window.partitionBy(*keys, "_block").orderBy("_at"))
    return done.where("_home = _block").drop("_at", "_home", "_block")


def order_statistic(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    q: float,
    out: str,
    interpolate: bool = False,
    group_rows: int | None = None,
) -> DataFrame:
    """Exact quantile per key, with the number of values.

    Picks element ``floor(q * n)`` of the sorted values, or interpolates linearly at ``q * (n - 1)``.
    """
    found = order_statistics(df, keys, value, [q], interpolate, group_rows)
    return found.select(*keys, "n", F.col("value").alias(out))


#: Shares of the values on either side of a quantile that its first bracket takes in, and the accuracy of its ends.
BRACKET_PAD, BRACKET_ACCURACY = 0.002, 10_000


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], interpolate: bool = False, group_rows: int | None = None
) -> DataFrame:
    """Exact quantiles per key: a row (keys, q, n, value) for each of ``qs``, as in ``order_statistic``.

    Approximate quantiles first narrow the ranges of all ``qs``, so that only values near a wanted rank are grouped and ranked; of
    the others those between two brackets are merely counted, together. Should a rank lie outside its bracket, the values of its
    key are ranked in full.
    """
    by = list(keys) or ["_all"]
    known = df.where(F.col(value).isNotNull()).select(*(keys or [F.lit(0).alias("_all")]), F.col(value).alias("_v"))
    few = 1_000
    ends = [min(max(q + side, 0.0), 1.0) for q in qs for side in (-BRACKET_PAD, BRACKET_PAD)]
    # For few values the padding is less than a rank or two, so their whole range is the bracket.
    whole = F.array(*[F.min("_v"), F.max("_v")] * len(qs))
    bracket = F.when(F.count("_v") < few, whole).otherwise(F.percentile_approx("_v", ends, BRACKET_ACCURACY))
    span = durable(known.groupBy(*by).agg(F.count("_v").alias("n"), bracket.alias("_b")), "span")
    picked = durable(_ranked_in_brackets(known, span, by, qs, interpolate, group_rows), "ranks")
    missed = picked.where("not inside").select(*by).distinct()
    if not missed.isEmpty():
        missed = durable(missed.withColumn("_missed", F.lit(True)), "missed")
        values = attach(known, missed, by, ["_missed"]).where("_missed").drop("_missed")
        full = values.groupBy(*by).agg(F.count("_v").alias("n"), whole.alias("_b"))
        again = _ranked_in_brackets(values, durable(full, "span"), by, qs, interpolate, group_rows)
        picked = attach(picked, missed, by, ["_missed"]).where("_missed is null").drop("_missed").unionByName(again)
    return picked.select(*keys, "q", "n", "value")


def _ranked_in_brackets(
    known: DataFrame, span: DataFrame, keys: Sequence[str], qs: Sequence[float], interpolate: bool, group_rows: int | None
) -> DataFrame:
    """(keys, q, n, value, inside); ``inside`` is false where a rank lies outside all brackets.

    Values outside count under the greatest bracket end below them (null: none), after the values that equal it.
    """
    v, b = F.col("_v"), F.col("_b")
    pairs = [(b[2 * i], b[2 * i + 1]) for i in range(len(qs))]
    within = reduce(lambda x, y: x | y, [(v >= low) & (v <= high) for low, high in pairs])
    below = [F.when(high < v, high) for _, high in pairs]
    place = F.when(within, v).otherwise(F.greatest(*below) if len(below) > 1 else below[0])
    counts = (
        attach(known, span, keys, ["n", "_b"])
        .groupBy(*keys, place.alias("_v"), (~within).alias("_out"))
        .agg(F.count(F.lit(1)).alias("_c"), F.max("n").alias("n"))
    )
    ranked = running_sums(counts, keys, [F.col("_v").asc_nulls_first(), "_out"], {"_upto": F.col("_c")}, group_rows)
    n, picks = F.col("n"), []
    for q in qs:
        at = F.lit(float(q)) * ((n - 1) if interpolate else n)
        first = lambda rank: F.min(F.when(F.col("_upto") > F.least(rank, n - 1), F.struct("_upto", "_v", "_out")))
        picks.append(F.struct(F.lit(float(q)).alias("q"), first(F.floor(at)).alias("low"), first(F.ceil(at)).alias("high")))
    each = ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*picks).alias("_p")).select(*keys, "n", F.inline("_p"))
    at = F.col("q") * (n - 1)
    lower, upper = F.col("low._v"), F.col("high._v")
    result = lower + (upper - lower) * (at - F.floor(at)) if interpolate else lower
    return each.select(*keys, "q", "n", result.alias("value"), (~F.col("low._out") & ~F.col("high._out")).alias("inside"))
