"""A mix of sources to target weights by Efraimidis-Spirakis sampling.

Sources, in the order of their names, weigh 5, 2, 1 and so on again, and share the words of the whole table by weight; a target stops at
``MOST_EPOCHS`` times the words of its source, and the others share the excess by weight. With the sources in the order of the share at which
they stop, that is one prefix sum over them: those before the first that does not stop are full, the others share what is left.

A source is then read in whole epochs as often as its target holds them. What is left of the target is a weighted sample without replacement:
every document draws an exponential key whose rate is its quality weight, and documents are taken in the order of their keys until the words
before them reach the budget. The last one gives the words that are still missing, from its beginning, so a source's taken words are its
target, rounded down. Keys come from a hash of seed, id and text, so reruns agree.

Quality weight: the share of letters among the characters, times the share of different lines among the lines, at least ``LEAST_WEIGHT``.

Null text: no words. Null source: a source of its own, the last. Empty texts and sources without words take nothing and have a target of 0.
Repeated rows are a document each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.ranges import ranked, summed_before
from pulsegrid.operators.ordered import attach
from pulsegrid.storage import durable

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
LEAST_WEIGHT = 0.01
SEED = 11

#: Characters between words.
BLANK = r"[\x20\x09-\x0D]"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of letters times share of different lines."""
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\n")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(LEAST_WEIGHT), letters * (F.size(F.array_distinct(lines)) / F.size(lines)))


def sampling_key(seed: int, doc_id: Column, text: Column, weight: Column) -> Column:
    """An exponential variate of rate ``weight``, from 52 bits of a hash."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))), 256)
    uniform = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(uniform) / weight


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``sizes`` (key, source_size; one row per source, key order is source order) with ``target``. Sources may be many: their order is ranged."""
    placed = ranked(sizes.withColumn("_all", F.lit("")), "_all", ["key"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("lo") % len(weights) + 1).cast("int")).cast("long")
    weighed = placed.select("_all", "key", "source_size", weight.alias("_w"), (F.col("source_size") * most).alias("_cap"))
    stops = durable(summed_twice(weighed.withColumn("_stop", F.col("_cap") / F.col("_w"))), "stops")
    total, weight_sum = stops.agg(F.sum("source_size")).scalar(), stops.agg(F.sum("_w")).scalar()
    # Where a source would stop if it and all later ones shared what the earlier ones leave.
    shared = stops.withColumn("_level", (total - F.col("_caps")) / (weight_sum - F.col("_before_w")))
    level = shared.where(F.col("_level") <= F.col("_stop")).agg(F.min(F.struct("_stop", "key", "_level"))["_level"]).scalar()
    target = F.coalesce(F.least(F.col("_cap").cast("double"), level * F.col("_w")), F.lit(0.0))
    return stops.select("key", "source_size", target.alias("target"))


def summed_twice(weighed: DataFrame) -> DataFrame:
    """Caps and weights of the sources that stop earlier."""
    once = summed_before(weighed, "_all", ["_stop", "key"], "_cap", "_caps")
    return summed_before(once, "_all", ["_stop", "key"], "_w", "_before_w")


def mix(docs: DataFrame, weight: Column | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs (whole ones of its source) and sample_key of every row."""
    key = F.when(F.col("source").isNull(), F.struct(F.lit(1).alias("last"), F.lit("").alias("name")))
    key = key.otherwise(F.struct(F.lit(0).alias("last"), F.col("source").cast("string").alias("name")))
    drawn = sampling_key(seed, F.col("doc_id"), F.col("text"), weight if weight is not None else quality_weight(F.col("text")))
    rows = docs.select("doc_id", "source", key.alias("key"), n_words(F.col("text")).alias("size"), drawn.alias("sample_key"), F.monotonically_increasing_id().alias("_tie"))
    # Written first: a range partitioning reads its input twice, and texts should be measured once.
    placed = durable(summed_before(durable(rows, "rows"), "key", ["sample_key", "doc_id", "_tie"], "size", "_upto"), "keys")
    targets = durable(source_targets(durable(placed.groupBy("key").agg(F.sum("size").alias("source_size")), "sizes")), "targets")
    mixed = attach(placed, targets, ["key"], ["source_size", "target"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")) - F.col("_upto")
    part = F.least(F.greatest(budget, F.lit(0)), F.col("size"))
    mixed = mixed.withColumn("epochs", epochs).withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "epochs", "sample_key")


def epoch_reads(mixed: DataFrame) -> DataFrame:
    """What a loader reads: a row (source, epoch, doc_id, words) for every time that a document is read, whole epochs before the sample."""
    read = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.col("epochs"))
    each = mixed.where(read > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), read.cast("int"))))
    return each.select("source", "epoch", "doc_id", F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size")).alias("words"), "sample_key")
