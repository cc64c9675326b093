"""Queries on reconstruction, classifiers, folds and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import classify as C
from pulsegrid.operators import evaluate as E
from pulsegrid.operators import quality as Q
from pulsegrid.operators import reconstruct as R
from pulsegrid.operators import scoring as S
from pulsegrid.operators import splits as P
from pulsegrid.operators.metrics import finite_or_zero
from pulsegrid.operators.oneclass import margin_scores
from pulsegrid.operators.windows import sliding_windows
from pulsegrid.plans.base import (
    EV, HOURLY, INTERVALS, MARKS, WINDOW, events, hourly, query, r6, recursive_sql, rows_in, sql, table,
)
from pulsegrid.plans.labels import WINDOW_LABELS, labelled_windows
from pulsegrid.storage import dealt, durable

DIMENSIONS, SEED = 64, 32
FOLDS = 10


def _vectors(spark, sf):
    """Embeddings with a binary label: class 0 is the anomaly."""
    return table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("label"))


def _scaled(spark, sf):
    vectors = _vectors(spark, sf)
    return R.standardise_array(vectors, vectors.where("label = 0"), "embedding")


@query(
    "standard_scaling",
    """WITH v AS (SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM v WHERE label = 0 GROUP BY i)
SELECT vec_id, round(sum(z), 4) AS total, round(min(z), 4) AS lowest, round(max(z), 4) AS highest
FROM (SELECT vec_id, (x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z FROM v JOIN s USING (i)) GROUP BY vec_id""",
)
def standard_scaling(spark, sf):
    total = F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x)
    return _scaled(spark, sf).select(
        "vec_id", F.round(total, 4).alias("total"), F.round(F.array_min("scaled"), 4).alias("lowest"), F.round(F.array_max("scaled"), 4).alias("highest")
    )


def _flagged(scaled, components, rows):
    errors = durable(R.reconstruction_errors(scaled, components), "errors")
    flagged = R.flag_above(errors, R.quantile_threshold(errors.where("label = 0"), group_rows=rows))
    return flagged.select("vec_id", "label", F.round("mae", 6).alias("mae"), F.round("mse", 6).alias("mse"), "alarm")


@query("reconstruct_errors")
def reconstruct_errors(spark, sf):
    """Vectors projected on four components of the normal ones; alarm above the 99 % quantile of their error."""
    scaled = durable(_scaled(spark, sf).select("vec_id", "label", "scaled"), "scaled")
    return _flagged(scaled, R.fit_components(scaled.where("label = 0")), rows_in(spark, sf, "embeddings")).drop("mse")


@query(
    "reconstruct_given",
    f"""WITH v AS (SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM v WHERE label = 0 GROUP BY i),
z AS (SELECT vec_id, label, i, (x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z FROM v JOIN s USING (i)),
c AS (SELECT i, j, sqrt(2.0::DOUBLE / {DIMENSIONS}) * cos(pi() * (i - 0.5) * j / {DIMENSIONS}) AS c FROM range(1, {DIMENSIONS + 1}) a(i), range(1, {R.COMPONENTS + 1}) b(j)),
p AS (SELECT vec_id, j, sum(z * c) AS p FROM z JOIN c USING (i) GROUP BY vec_id, j),
r AS (SELECT vec_id, i, sum(p * c) AS r FROM p JOIN c USING (j) GROUP BY vec_id, i),
e AS (SELECT vec_id, label, avg(abs(z - r)) AS mae, avg((z - r) * (z - r)) AS mse FROM z JOIN r USING (vec_id, i) GROUP BY vec_id, label)
SELECT vec_id, label, round(mae, 6) AS mae, round(mse, 6) AS mse, CAST(mae > (SELECT quantile_cont(mae, 0.99) FROM e WHERE label = 0) AS INT) AS alarm FROM e""",
)
def reconstruct_given(spark, sf):
    """The same on components that are given: four waves over the dimensions."""
    scaled = durable(_scaled(spark, sf).select("vec_id", "label", "scaled"), "scaled")
    return _flagged(scaled, R.cosine_components(DIMENSIONS), rows_in(spark, sf, "embeddings"))


@query("window_reconstruct_errors")
def window_reconstruct_errors(spark, sf):
    """Windows of the hourly series rebuilt from components; summary with threshold mean + 2 deviations."""
    windows = sliding_windows(
        hourly(spark, sf), ["metric"], ["ts"], {"steps": ("list", F.col("value"))}, WINDOW, 1, rows_in(spark, sf, "events")
    )
    windows = durable(windows.select("metric", "win_id", "steps"), "windows")
    scaled = R.standardise_array(windows, windows, "steps")
    errors = R.reconstruction_errors(scaled, R.fit_components(scaled))
    return S.error_summary(errors, "mse").select("n", *[F.round(c, 6).alias(c) for c in ("mean_error", "std_error", "threshold")], "anomalies")


LAGS = WINDOW - 1
TERMS = LAGS + 1

#: The normal equations of every metric as rows of lists, cleared column by column.
LAG_SQL = f"""f AS (SELECT * FROM (SELECT metric, ts, value AS y, list_prepend(1.0::DOUBLE, list_reverse(list(value) OVER w)) AS x, count(value) OVER w AS n FROM hourly
  WINDOW w AS (PARTITION BY metric ORDER BY ts ROWS BETWEEN {LAGS} PRECEDING AND 1 PRECEDING)) WHERE n = {LAGS} AND y IS NOT NULL),
ij AS (SELECT i, j FROM range(1, {TERMS + 1}) a(i), range(1, {TERMS + 2}) b(j)),
cells AS (SELECT metric, i, j, sum(x[i] * CASE WHEN j > {TERMS} THEN y ELSE x[j] END) AS v FROM f, ij GROUP BY metric, i, j),
system AS (SELECT metric, list(r ORDER BY i) AS m FROM (SELECT metric, i, list(v ORDER BY j) AS r FROM cells GROUP BY metric, i) GROUP BY metric),
solved AS (SELECT metric, 1 AS k, m FROM system UNION ALL
  SELECT metric, k + 1, list_transform(range(1, {TERMS + 1}), lambda i: list_transform(range(1, {TERMS + 2}), lambda j:
    CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END)) FROM solved WHERE k <= {TERMS}),
model AS (SELECT metric, list_transform(m, lambda r: r[{TERMS + 1}]) AS b FROM solved WHERE k = {TERMS + 1})"""


@query(
    "lag_regression",
    recursive_sql(EV, HOURLY, LAG_SQL, body="SELECT metric, round(avg(pow(y - list_sum(list_transform(list_zip(b, x), lambda p: p[1] * p[2])), 2)), 4) AS mse FROM f JOIN model USING (metric) GROUP BY metric"),
)
def lag_regression(spark, sf):
    """Next hourly value from the nine before it by a linear model per metric; squared error per metric."""
    features = S.lag_features(hourly(spark, sf), ["metric"], ["ts"], "value", WINDOW, rows_in(spark, sf, "events"))
    features = durable(features, "features")
    fitted = durable(S.fit_lag_regression(features, ["metric"], "value", WINDOW), "fitted")
    predicted = S.predict_lag_regression(fitted, features, ["metric"], "value", WINDOW).where("value is not null")
    return S.group_loss(predicted, "metric", "value", "value_pred").withColumn("mse", F.round("mse", 4))


def _suite(spark, sf, names):
    predictions = C.cross_predictions(
        _vectors(spark, sf), ["vec_id"], "embedding", DIMENSIONS, names, FOLDS, 2, rows_in(spark, sf, "embeddings")
    )
    report = E.class_report(E.confusion_table(predictions, keys=["model"]), ["model"])
    return E.report_averages(report, ["model"])


BAYES_SQL = f"""WITH v AS (SELECT vec_id, embedding, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM embeddings),
o AS (SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || vec_id), vec_id) - 1) % {FOLDS} AS own FROM v),
x AS (SELECT vec_id, own, label, x::DOUBLE AS x, i FROM o JOIN (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM v) USING (vec_id)),
k AS (SELECT unnest(range({FOLDS})) AS fold),
{{scored}},
p AS (SELECT label, arg_max(class, score) AS guess FROM scored GROUP BY vec_id, label),
sides AS (SELECT label AS class, 1 AS support, 0 AS guessed, CASE WHEN guess = label THEN 1 ELSE 0 END AS hit FROM p UNION ALL SELECT guess, 0, 1, 0 FROM p),
r AS (SELECT class, coalesce(sum(hit) / nullif(sum(guessed), 0), 0) AS p, coalesce(sum(hit) / nullif(sum(support), 0), 0) AS r, sum(support) AS s FROM sides GROUP BY class),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM r)
SELECT '{{model}}' AS model, CAST(sum(s) AS BIGINT) AS support, round(sum(r * s) / sum(s), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall,
  round(avg(f1), 6) AS macro_f1, round(sum(p * s) / sum(s), 6) AS weighted_precision, round(sum(r * s) / sum(s), 6) AS weighted_recall, round(sum(f1 * s) / sum(s), 6) AS weighted_f1 FROM f"""

#: Normal densities per class and dimension; the spread is widened by a billionth of the greatest one.
GAUSSIAN_SQL = BAYES_SQL.replace("{model}", "gaussian_nb").replace("{scored}", """m AS (SELECT fold, label AS class, i, count(*) AS n, avg(x) AS mu, avg(x * x) - avg(x) * avg(x) AS s FROM x JOIN k ON own <> fold GROUP BY ALL),
e AS (SELECT fold, 1e-9 * max(s) AS e FROM (SELECT fold, i, var_samp(x) AS s FROM x JOIN k ON own <> fold GROUP BY ALL) GROUP BY fold),
scored AS (SELECT x.vec_id, x.label, m.class, max(ln(n)) - 0.5 * sum(ln(2 * pi() * (s + e)) + (x - mu) * (x - mu) / (s + e)) AS score
  FROM x JOIN m ON m.fold = x.own AND m.i = x.i JOIN e ON e.fold = x.own GROUP BY ALL)""")

#: What the other classes have of each dimension, shifted to start from 0: a row goes where the others fit worst.
COMPLEMENT_SQL = BAYES_SQL.replace("{model}", "complement_nb").replace("{scored}", """low AS (SELECT fold, min(x) AS low FROM x JOIN k ON own <> fold GROUP BY fold),
t AS (SELECT fold, label, i, sum(x - low) AS t FROM x JOIN low ON own <> fold GROUP BY ALL),
c AS (SELECT a.fold, a.label AS class, a.i, sum(b.t) AS t FROM t a JOIN t b ON a.fold = b.fold AND a.i = b.i AND a.label <> b.label GROUP BY ALL),
w AS (SELECT fold, class, i, ln(t + 1) - ln(sum(t + 1) OVER (PARTITION BY fold, class)) AS w FROM c),
scored AS (SELECT x.vec_id, x.label, w.class, -sum(greatest(x - low, 0) * w) AS score FROM x JOIN low ON low.fold = x.own JOIN w ON w.fold = x.own AND w.i = x.i GROUP BY ALL)""")


def _register(name, sql_twin=None):
    @query(f"classify_{name}", sql_twin)
    def run(spark, sf):
        averages = _suite(spark, sf, [name])
        return averages.withColumns({c: r6(c) for c in averages.columns if c not in ("model", "support")})


CONTRACT = ("decision_tree", "linear_svc", "kernel_svc")
SUITE = ("decision_tree", "random_forest", "gaussian_nb", "complement_nb", "mlp", "linear_svc", "sampled_svc")
TWINS = {"gaussian_nb": GAUSSIAN_SQL, "complement_nb": COMPLEMENT_SQL}
for _name in (*SUITE, "kernel_svc"):
    _register(_name, TWINS.get(_name))


@query(
    "classifier_contract",
    f"""WITH v AS (SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM embeddings)
SELECT m AS model, (SELECT count(*) FROM v) AS rows, (SELECT count(*) FROM v) AS ids, {FOLDS} AS folds, (SELECT sum(label)::BIGINT FROM v) AS anomalies, true AS of_known_classes
FROM (VALUES {", ".join(f"('{m}')" for m in CONTRACT)}) a(m)""",
)
def classifier_contract(spark, sf):
    """What holds for every classifier over folds: each row is predicted once, out of its fold, as one of the classes."""
    predictions = C.cross_predictions(
        _vectors(spark, sf), ["vec_id"], "embedding", DIMENSIONS, list(CONTRACT), FOLDS, 2, rows_in(spark, sf, "embeddings")
    )
    return predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("vec_id").alias("ids"), F.countDistinct("fold").cast("int").alias("folds"),
        F.sum("label").alias("anomalies"), F.every(F.col("prediction").isin(0, 1)).alias("of_known_classes"),
    )


@query("one_class_margin")
def one_class_margin(spark, sf):
    """The one-class hinge margin on random features per fold; 5 % of the training rows outside."""
    rated, _ = margin_scores(_vectors(spark, sf), ["vec_id"], "embedding", DIMENSIONS, FOLDS, group_rows=rows_in(spark, sf, "embeddings"))
    return rated.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query("classifier_mean_accuracy")
def classifier_mean_accuracy(spark, sf):
    return E.mean_reported(_suite(spark, sf, list(SUITE))).withColumn("mean_accuracy", r6("mean_accuracy"))


ONE_CLASS_FOLDS = FOLDS


@query(
    "one_class_boundary",
    f"""WITH v AS (SELECT vec_id, embedding, label = 0 AS odd FROM embeddings),
f AS (SELECT vec_id, embedding, (row_number() OVER (ORDER BY md5('{SEED}:' || vec_id), vec_id) - 1) % {ONE_CLASS_FOLDS} AS own FROM v WHERE NOT odd),
folds AS (SELECT unnest(range({ONE_CLASS_FOLDS})) AS fold),
x AS (SELECT vec_id, own, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM f),
m AS (SELECT fold, i, avg(x) AS m, sqrt(greatest(sum(x * x) / count(*) - avg(x) * avg(x), 0)) AS sd FROM x JOIN folds ON own <> fold GROUP BY fold, i),
a AS (SELECT vec_id, NULL AS own, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM v WHERE odd UNION ALL SELECT * FROM x),
d AS (SELECT vec_id, own, fold, round(sqrt(sum(CASE WHEN sd > 0 THEN pow((x - m) / sd, 2) ELSE 0 END)), 9) AS distance FROM a JOIN m USING (i) GROUP BY vec_id, own, fold),
b AS (SELECT fold, quantile_cont(distance, 0.95) AS boundary FROM d WHERE own <> fold GROUP BY fold),
c AS (SELECT d.fold, count(*) FILTER (WHERE own IS NULL AND distance > boundary) AS tp, count(*) FILTER (WHERE own IS NOT NULL AND distance > boundary) AS fp,
  count(*) FILTER (WHERE own IS NOT NULL AND distance <= boundary) AS tn, count(*) FILTER (WHERE own IS NULL AND distance <= boundary) AS fn
  FROM d JOIN b USING (fold) WHERE own IS NULL OR own = d.fold GROUP BY d.fold),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
SELECT fold, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r""",
)
def one_class_boundary(spark, sf):
    rated = C.one_class(
        _vectors(spark, sf), ["vec_id"], "embedding", DIMENSIONS, ONE_CLASS_FOLDS,
        group_rows=ONE_CLASS_FOLDS * rows_in(spark, sf, "embeddings"),
    )
    return rated.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query("boosted_grid")
def boosted_grid(spark, sf):
    """Boosted trees chosen over the whole grid of the operator: 27 points, 5 folds, 20 rounds."""
    vectors = _vectors(spark, sf)
    prepared = C.prepare(vectors, vectors, "embedding").select("vec_id", F.xxhash64("embedding", "label").alias("_h"), "raw", "label")
    # Every part of the table, even an empty one, sends the sums of all bins of a tree's level. The fits therefore share the cores instead of
    # each taking all of them. The order settles which fold a row is in, so only equal rows may tie.
    most = max(1, spark.sparkContext.defaultParallelism // C.BOOSTED_AT_ONCE)
    rows = dealt(durable(prepared, "train"), ["vec_id", "_h"], rows_in(spark, sf, "embeddings"), most).select("raw", "label")
    fitted = C.boosted_grid(rows)
    results = C.grid_results(fitted)
    return spark.createDataFrame(results, "max_depth int, step double, share double, accuracy double")


@query(
    "phase_relabel",
    sql(EV, body="""SELECT event_id, CASE WHEN k % 3 IN (0, 2) OR metric = 'view' THEN 0 ELSE 1 END AS label FROM ev"""),
)
def phase_relabel(spark, sf):
    phase = F.when(F.col("k") % 3 == 0, "pre").when(F.col("k") % 3 == 2, "pos").otherwise("attack")
    kind = F.when(F.col("metric") == "view", "normal").otherwise(F.col("metric"))
    return events(spark, sf).select("event_id", C.phase_label(kind, phase).alias("label"))


@query(
    "stratified_folds",
    f"""SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1) % {FOLDS} AS INTEGER) AS fold FROM labels""",
)
def stratified_folds(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", "quality")
    return P.stratified_folds(rows, ["doc_id"], "quality", FOLDS, SEED, rows_in(spark, sf, "labels"))


@query(
    "plain_folds",
    f"""SELECT doc_id, CAST((row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1) % {FOLDS} AS INTEGER) AS fold FROM labels""",
)
def plain_folds(spark, sf):
    return P.plain_folds(table(spark, sf, "labels").select("doc_id"), ["doc_id"], FOLDS, SEED, rows_in(spark, sf, "labels"))


SHUFFLED = """shuffled AS (SELECT event_id, CASE WHEN r < floor(n * 0.7::DOUBLE) THEN 'train' WHEN r < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) - 1 AS r, count(*) OVER () AS n FROM ev))"""


@query("shuffled_split", sql(EV, SHUFFLED, body="SELECT event_id, split FROM shuffled"))
def shuffled_split(spark, sf):
    return P.shuffled_split(events(spark, sf).select("event_id"), ["event_id"], group_rows=rows_in(spark, sf, "events"))


SUPERVISED = """usable AS (SELECT win_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || win_id), win_id) - 1 AS r,
  count(*) OVER (PARTITION BY label) AS n FROM win WHERE label IN (0, 1)),
sized AS (SELECT *, CASE WHEN label = 0 THEN floor(n * 0.8::DOUBLE) ELSE 0 END AS train FROM usable),
supervised AS (SELECT win_id, label, CASE WHEN r < train THEN 'train' WHEN r - train < floor((n - train) * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM sized)"""


def split_windows(spark, sf):
    return P.supervised_split(
        labelled_windows(spark, sf).select("win_id", "label"), ["win_id"], group_rows=rows_in(spark, sf, "events")
    )


@query("supervised_split", sql(EV, INTERVALS, MARKS, WINDOW_LABELS, SUPERVISED, body="SELECT * FROM supervised"))
def supervised_split(spark, sf):
    return split_windows(spark, sf)


@query(
    "split_row_overlap",
    sql(EV, INTERVALS, MARKS, WINDOW_LABELS, SUPERVISED, f"""covered AS (SELECT DISTINCT split, unnest(range(win_id, win_id + {WINDOW})) AS row_id FROM supervised)""",
        body="""SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared_rows FROM covered a JOIN covered b ON a.row_id = b.row_id AND a.split < b.split GROUP BY 1, 2"""),
)
def split_row_overlap(spark, sf):
    return P.row_overlap(split_windows(spark, sf), WINDOW, 1)


@query(
    "first_rows",
    sql(EV, body="SELECT event_id, metric, value FROM ev ORDER BY ts, event_id LIMIT 900"),
)
def first_rows(spark, sf):
    return P.first_rows(events(spark, sf), ["ts", "event_id"], 900).select("event_id", "metric", "value")


@query(
    "shared_values",
    sql(EV, SHUFFLED, body="""SELECT value FROM ev JOIN shuffled USING (event_id) WHERE split = 'train'
INTERSECT SELECT value FROM ev JOIN shuffled USING (event_id) WHERE split = 'test'"""),
)
def shared_values(spark, sf):
    rows = P.shuffled_split(events(spark, sf).select("event_id", "value"), ["event_id"], group_rows=rows_in(spark, sf, "events"))
    return P.shared_values(rows.where("split = 'train'"), rows.where("split = 'test'"), "value")


@query(
    "window_structure",
    sql(EV, HOURLY, f"""g AS (SELECT CASE WHEN metric IN ('error', 'view') THEN 'load' ELSE 'traffic' END AS "group", metric, count(*) AS n FROM hourly GROUP BY metric),
w AS (SELECT "group", CAST(sum(greatest(n - {WINDOW} + 1, 0)) AS BIGINT) AS windows FROM g GROUP BY 1)""",
        body=f"""SELECT "group", windows, {WINDOW} AS shortest, {WINDOW} AS longest, (SELECT count(DISTINCT windows) = 1 FROM w) AS ok FROM w"""),
)
def window_structure(spark, sf):
    windows = sliding_windows(
        hourly(spark, sf), ["metric"], ["ts"], {"steps": ("list", F.col("value"))}, WINDOW, 1, rows_in(spark, sf, "events")
    )
    grouped = durable(windows.withColumn("group", F.when(F.col("metric").isin("error", "view"), "load").otherwise("traffic")), "windows")
    return Q.window_structure(grouped, WINDOW)


@query(
    "aligned_labels",
    sql(EV, INTERVALS, MARKS, WINDOW_LABELS, body="SELECT win_id, CASE WHEN label = 1 THEN 1 ELSE 0 END AS label FROM win"),
)
def aligned_labels(spark, sf):
    """Windows with the label of the usable ones; unlabelled windows count as normal."""
    windows = durable(labelled_windows(spark, sf), "windows")
    return E.align_labels(windows.select("win_id"), windows.where("label <> -1"), require=False).select("win_id", "label")


@query(
    "finite_values",
    sql(EV, body="SELECT event_id, CASE WHEN k % 10 < 3 THEN 0.0 ELSE value END AS value FROM ev"),
)
def finite_values(spark, sf):
    kind = F.col("k") % 10
    dirty = F.when(kind == 0, float("inf")).when(kind == 1, float("nan")).when(kind == 2, None).otherwise(F.col("value"))
    return events(spark, sf).select("event_id", finite_or_zero(dirty).alias("value"))
