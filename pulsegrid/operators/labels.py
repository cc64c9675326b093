"""Labels from fault and normal intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import last_known, positions, row_frames, running_sums
from pulsegrid.storage import durable, fits

ANOMALOUS, NORMAL, UNLABELLED = 1, 0, -1

BROADCAST_INTERVALS = "spark.pulsegrid.broadcastIntervals"
DEFAULT_BROADCAST_INTERVALS = 100_000
MAX_INTERVALS_PER_BIN = 64


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Disjoint cover of the intervals of each label. For interval tables of a checked size."""
    upto = Window.partitionBy("label").orderBy("start_ts", "end_ts").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("label").orderBy("start_ts", "end_ts")
    opens = F.coalesce((F.col("start_ts") > F.max("end_ts").over(upto)).cast("int"), F.lit(1))
    return (
        intervals.where("start_ts <= end_ts")
        .withColumn("_open", opens)
        .withColumn("_id", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("label", "_id")
        .agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
        .drop("_id")
    )


def _micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _binned_cover(intervals: DataFrame) -> tuple[DataFrame, int] | None:
    """Disjoint intervals spread over equal bins, and the bin width; None if one bin holds too many.

    A bin is at least as wide as the mean interval, so n intervals give no more than 2n rows.
    """
    cover = durable(merge_intervals(intervals).select("label", _micros("start_ts").alias("_s"), _micros("end_ts").alias("_e")), "cover")
    mean = cover.agg(F.avg(F.col("_e") - F.col("_s"))).first()[0]
    width = max(1_000_000, int(mean or 0))
    bins = cover.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width)))
    )
    fullest = bins.groupBy("label", "_bin").count().agg(F.max("count")).first()[0]
    return (bins.select("label", "_bin", "_s", "_e"), width) if (fullest or 0) <= MAX_INTERVALS_PER_BIN else None


def label_points(points: DataFrame, intervals: DataFrame, ts: str = "ts", group_rows: int | None = None) -> DataFrame:
    """Label of every row: 1 inside a fault interval, else 0 inside a normal one, else -1.

    Interval ends are inclusive and an empty interval table labels everything 0. A small interval
    table is made disjoint and broadcast, so that the points are not shuffled. A large one is swept
    together with the points in time order, counting the open intervals; neither way pairs every
    point with every interval that covers it.
    """
    spark = points.sparkSession
    if intervals.isEmpty():
        return points.withColumn("label", F.lit(NORMAL))
    limit = int(spark.conf.get(BROADCAST_INTERVALS, str(DEFAULT_BROADCAST_INTERVALS)))
    if fits(intervals, limit):
        binned = _binned_cover(intervals)
        if binned is not None:
            return _label_by_broadcast(points, *binned, ts)
    return _label_by_sweep(points, intervals, ts, group_rows)


def _label_by_broadcast(points: DataFrame, bins: DataFrame, width: int, ts: str) -> DataFrame:
    out = points.withColumn("_t", _micros(ts)).withColumn("_bin", F.floor(F.col("_t") / width))
    for label, hit in ((ANOMALOUS, "_fault"), (NORMAL, "_normal")):
        side = bins.where(F.col("label") == label).select(
            F.col("_bin").alias("_b"), F.col("_s").alias("_bs"), F.col("_e").alias("_be"), F.lit(True).alias(hit)
        )
        inside = (F.col("_bin") == F.col("_b")) & (F.col("_t") >= F.col("_bs")) & (F.col("_t") <= F.col("_be"))
        out = out.join(F.broadcast(side), inside, "left").drop("_b", "_bs", "_be")
    label = F.when(F.col("_fault"), ANOMALOUS).when(F.col("_normal"), NORMAL).otherwise(UNLABELLED)
    return out.withColumn("label", label).drop("_t", "_bin", "_fault", "_normal")


def _label_by_sweep(points: DataFrame, intervals: DataFrame, ts: str, group_rows: int | None) -> DataFrame:
    columns = points.columns
    probes = points.withColumns({"_at": F.col(ts), "_turn": F.lit(1), "_kind": F.lit(None).cast("int"), "_step": F.lit(0)})
    edge = lambda column, turn, step: F.struct(F.col(column).alias("_at"), F.lit(turn).alias("_turn"), F.lit(step).alias("_step"))
    edges = (
        intervals.where("start_ts <= end_ts")
        .select(F.col("label").alias("_kind"), F.explode(F.array(edge("start_ts", 0, 1), edge("end_ts", 2, -1))).alias("_e"))
        .select("_kind", "_e.*")
    )
    # Rows of one instant and turn may come in any order, so a tie-breaker lets a busy instant be split between runs.
    line = probes.unionByName(edges, allowMissingColumns=True).withColumn("_tie", F.monotonically_increasing_id())
    swept = running_sums(
        line,
        [],
        ["_at", "_turn", "_tie"],
        {
            "_faults": F.when(F.col("_kind") == ANOMALOUS, F.col("_step")).otherwise(0),
            "_normals": F.when(F.col("_kind") == NORMAL, F.col("_step")).otherwise(0),
        },
        None if group_rows is None else group_rows + 2 * intervals.count(),
    )
    label = F.when(F.col("_faults") > 0, ANOMALOUS).when(F.col("_normals") > 0, NORMAL).otherwise(UNLABELLED)
    return swept.where("_turn = 1").select(*columns, label.alias("label"))


def has_usable_labels(labelled: DataFrame) -> bool:
    """False if every row is unlabelled; such a label set must not be written."""
    return not labelled.where(F.col("label") != UNLABELLED).isEmpty()


def collapse_labels(df: DataFrame, ts: str = "ts", label: str = "label") -> DataFrame:
    """One label per instant; 1 beats 0 beats -1."""
    return df.groupBy(ts).agg(F.max(label).alias(label))


def distinct_instants(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.select(ts).distinct()


def labels_on_timeline(timeline: DataFrame, labels: DataFrame, ts: str = "ts") -> DataFrame:
    """Labels on a timeline; instants without a label count as normal."""
    return timeline.join(labels.select(ts, "label"), ts, "left").withColumn("label", F.coalesce("label", F.lit(NORMAL)))


def label_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    c = F.col(label)
    return df.agg(
        F.count_if(c == NORMAL).alias("normal"),
        F.count_if(c == ANOMALOUS).alias("anomalous"),
        F.count_if(c == UNLABELLED).alias("unlabellable"),
        F.avg(F.when(c != UNLABELLED, c.cast("double"))).alias("anomaly_ratio"),
    )


def alignment_check(metrics: DataFrame, labels: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: does every whole-second metric instant in the shared range have a label?"""
    second = F.date_trunc("second", F.col(ts).cast("timestamp")).alias("s")
    m = metrics.select(second).distinct().withColumn("in_metrics", F.lit(1))
    lab = labels.select(second).distinct().withColumn("in_labels", F.lit(1))
    both = m.join(lab, "s", "full")
    lo = F.greatest(m.select(F.min("s")).scalar(), lab.select(F.min("s")).scalar())
    hi = F.least(m.select(F.max("s")).scalar(), lab.select(F.max("s")).scalar())
    inside = both.where((F.col("s") >= lo) & (F.col("s") <= hi))
    return inside.agg(
        F.count("in_metrics").alias("metric_instants"),
        F.count_if(F.col("in_metrics").isNotNull() & F.col("in_labels").isNull()).alias("missing"),
        F.count_if(F.col("in_metrics").isNull()).alias("label_only"),
    ).withColumn("aligned", (F.col("metric_instants") + F.col("label_only") > 0) & (F.col("missing") == 0))


def unlabelled_periods(
    df: DataFrame, ts: str = "ts", label: str = "label", gap_seconds: float = 1.0, group_rows: int | None = None
) -> DataFrame:
    """Periods of unlabelled instants at most ``gap_seconds`` apart: start, end, number of instants."""
    instants = positions(df.where(F.col(label) == UNLABELLED).select(ts).distinct(), [], [ts], "_p", group_rows)
    limit = int(gap_seconds * 1_000_000)

    def edges(rows, w):
        step = _micros(ts) - F.lag(_micros(ts)).over(w)
        return rows.withColumn("_opens", F.coalesce(step > limit, F.lit(True))).withColumn(
            "_closes", F.coalesce(F.lead("_opens").over(w), F.lit(True))
        )

    def ends(rows, w):
        here = F.struct(F.col(ts), F.col("_p"))
        return rows.withColumn("_end", F.when(F.col("_closes"), here).otherwise(F.lead(here).over(w)))

    bounds = row_frames(instants, [], ["_p"], 1, 1, edges, group_rows).where("_opens or _closes")
    return (
        row_frames(bounds, [], ["_p"], 0, 1, ends, group_rows)
        .where("_opens")
        .select(
            F.col(ts).alias("start_ts"),
            F.col(f"_end.{ts}").alias("end_ts"),
            (F.col("_end._p") - F.col("_p") + 1).alias("instants"),
        )
    )


def segments(df: DataFrame, keys: Sequence[str] = (), idx: str = "idx", label: str = "label", group_rows: int | None = None) -> DataFrame:
    """Segments (start_idx, end_idx) of anomalous rows.

    A segment runs from a 1 up to the row before the next 0, or to the last row; rows labelled -1
    neither open nor close one.
    """
    marked = in_segment(df, keys, idx, label, group_rows)
    return (
        marked.where(F.col("segment").isNotNull())
        .groupBy(*keys, F.col("segment").alias("start_idx"))
        .agg(F.max(idx).alias("end_idx"))
    )


def in_segment(df: DataFrame, keys: Sequence[str] = (), idx: str = "idx", label: str = "label", group_rows: int | None = None) -> DataFrame:
    """Adds ``segment``: the start index of the segment a row lies in, null outside."""
    usable = F.when(F.col(label) != UNLABELLED, F.col(label))
    state = last_known(df, keys, [idx], {"_state": usable}, group_rows=group_rows)

    def starts(rows, w):
        before = F.coalesce(F.lag("_state").over(w), F.lit(NORMAL))
        opens = (F.col("_state") == ANOMALOUS) & (before != ANOMALOUS)
        return rows.withColumn("_start", F.when(opens, F.col(idx)))

    marked = row_frames(state, keys, [idx], 1, 0, starts, group_rows)
    filled = last_known(marked, keys, [idx], {"_seg": F.col("_start")}, group_rows=group_rows)
    return filled.withColumn("segment", F.when(F.col("_state") == ANOMALOUS, F.col("_seg"))).drop("_state", "_start", "_seg")


def overlap_counts(windows: DataFrame, intervals: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Per window (window_id, window_start, window_end): overlapping faults and normal intervals.

    An interval overlaps if it starts no later than the window ends and ends no earlier than the
    window starts, so the count is (starts up to the window's end) - (ends before its start). One
    sweep over all edges in time order gives both; no window meets an interval row by row.
    """
    mark = lambda column, turn, side: F.struct(F.col(column).alias("at"), F.lit(turn).alias("turn"), F.lit(side).alias("side"))
    edges = (
        intervals.where("start_ts <= end_ts")
        .select("label", F.explode(F.array(mark("start_ts", 0, 0), mark("end_ts", 2, 0))).alias("e"))
        .select("e.*", (F.col("label") == ANOMALOUS).cast("int").alias("fault"), (F.col("label") == NORMAL).cast("int").alias("normal"))
    )
    probes = windows.select(
        "window_id", F.explode(F.array(mark("window_start", 1, 1), mark("window_end", 2, 2))).alias("e")
    ).select("window_id", "e.*", F.lit(0).alias("fault"), F.lit(0).alias("normal"))
    # A probe reads sums of the other kind of edge only, so rows of one instant and turn may come in any order and be split.
    line = probes.unionByName(edges, allowMissingColumns=True).withColumn("tie", F.monotonically_increasing_id())
    opened, closed = F.col("side") + F.col("turn") == 0, (F.col("side") == 0) & (F.col("turn") == 2)
    swept = running_sums(
        line,
        [],
        ["at", "turn", "tie"],
        {
            "_f0": F.when(opened, F.col("fault")).otherwise(0),
            "_f1": F.when(closed, F.col("fault")).otherwise(0),
            "_n0": F.when(opened, F.col("normal")).otherwise(0),
            "_n1": F.when(closed, F.col("normal")).otherwise(0),
        },
        group_rows,
    )
    at_end, at_start = F.col("side") == 2, F.col("side") == 1
    return (
        swept.where("side > 0")
        .groupBy("window_id")
        .agg(
            (F.max(F.when(at_end, F.col("_f0"))) - F.max(F.when(at_start, F.col("_f1")))).alias("faults"),
            (F.max(F.when(at_end, F.col("_n0"))) - F.max(F.when(at_start, F.col("_n1")))).alias("normals"),
        )
    )


def window_truth(
    windows: DataFrame, intervals: DataFrame, session: DataFrame | None = None, group_rows: int | None = None
) -> DataFrame:
    """Ground truth per window: covered, has_anomaly, normal_overlap, is_normal, number of faults.

    ``session`` has one row (session_start, session_end); an open session has no end.
    """
    counts = overlap_counts(windows, intervals, group_rows)
    out = windows.join(counts, "window_id")
    if session is not None:
        s = session.select(F.struct("session_start", "session_end")).scalar()
        covered = (s["session_start"] <= F.col("window_end")) & F.coalesce(
            s["session_end"] >= F.col("window_start"), F.lit(True)
        )
        out = out.withColumn("covered", F.coalesce(covered, F.lit(False)))
    else:
        out = out.withColumn("covered", F.lit(True))
    seen = F.col("covered")
    return out.withColumns(
        {
            "faults": F.when(seen, F.col("faults")).otherwise(0),
            "has_anomaly": seen & (F.col("faults") > 0),
            "normal_overlap": seen & (F.col("normals") > 0),
            "is_normal": seen & (F.col("normals") > 0) & (F.col("faults") == 0),
        }
    )


def overlapping_faults(windows: DataFrame, intervals: DataFrame, bin_seconds: int = 600) -> DataFrame:
    """The fault intervals that overlap each window, one row per (window, fault).

    Both sides are spread over time bins and joined by bin; a pair is kept only in the first bin
    that both share.
    """
    width = bin_seconds * 1_000_000
    first = lambda c: F.floor(_micros(c) / width)
    w = windows.withColumn("_w0", first("window_start")).withColumn(
        "_bin", F.explode(F.sequence("_w0", first("window_end")))
    )
    i = (
        intervals.where((F.col("label") == ANOMALOUS) & (F.col("start_ts") <= F.col("end_ts")))
        .withColumn("_i0", first("start_ts"))
        .withColumn("_bin", F.explode(F.sequence("_i0", first("end_ts"))))
    )
    return (
        w.join(i, "_bin")
        .where("start_ts <= window_end and end_ts >= window_start and _bin = greatest(_w0, _i0)")
        .drop("_bin", "_w0", "_i0")
    )


def fault_details(windows: DataFrame, faults: DataFrame, bin_seconds: int = 600) -> DataFrame:
    """What overlaps each window, by kind and target of fault: number, first start, last end, and seconds inside the window.

    ``faults`` (start_ts, end_ts, fault_type, target_service) are counted as they meet; a missing kind or target is ``?``.
    """
    named = faults.select("start_ts", "end_ts", F.lit(ANOMALOUS).alias("label"), *[F.coalesce(c, F.lit("?")).alias(c) for c in ("fault_type", "target_service")])
    inside = (F.least(_micros("end_ts"), _micros("window_end")) - F.greatest(_micros("start_ts"), _micros("window_start"))) / 1_000_000
    return overlapping_faults(windows, named, bin_seconds).groupBy("window_id", "window_start", "window_end", "fault_type", "target_service").agg(
        F.count(F.lit(1)).alias("faults"), F.min("start_ts").alias("first_start"), F.max("end_ts").alias("last_end"), F.sum(inside).alias("seconds")
    )


def verdicts(truth: DataFrame, flagged: str = "flagged") -> DataFrame:
    """TP / TN / FP / FN per covered window from its number of flagged sequences."""
    predicted, actual = F.col(flagged) > 0, F.col("has_anomaly")
    verdict = (
        F.when(~F.col("covered"), None)
        .when(predicted & actual, F.lit("TP"))
        .when(predicted, F.lit("FP"))
        .when(actual, F.lit("FN"))
        .otherwise(F.lit("TN"))
    )
    return truth.withColumn("verdict", verdict)
