"""What five filters remove in every order of application, alone and together.

Each row gets a mask of the filters that it fails. Four of them look at the row alone; the fifth, equality with the text of a lesser id, comes
from tries over ranges of texts (``text_tries``). Masks are joined to the labels by id and counted per part, which leaves at most 32 counts a
part; all orders and steps follow from these counts.

Failing: A under 100 words; B 100 * distinct words < 80 * words; C 100 * ``[A-Z]`` > 10 * code points; D holds one of ``#$%&*|``; E its text
is that of a lesser id. Words are maximal runs of other characters than blank and U+0009 to U+000D.

Null text: empty, which fails A alone, or E too. Null lang: the part of the empty string. Null id: neither less nor greater than another, and
without labels. Rows that repeat an id and its text don't fail E by one another; every row counts. An id with several labels is good or toxic
if one of them says so. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.text_tries import repeated
from pulsegrid.storage import durable

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
BLANK = r"[\x20\x09-\x0D]+"


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def row_mask(words: Column, text: Column) -> Column:
    """The bits of A to D. ``words`` is the array of words."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failing = {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike(r"[#$%&*|]")}
    bits = [F.when(failed, _bit(name)).otherwise(0) for name, failed in failing.items()]
    return bits[0] + bits[1] + bits[2] + bits[3]


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row."""
    texts = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", BLANK), "")
    judged = texts.withColumn("_words", words).withColumn("mask", row_mask(F.col("_words"), F.col("text"))).drop("_words")
    flags = repeated(judged, "doc_id", ["part", "mask"])
    return flags.select("doc_id", "part", (F.col("mask") + F.col("repeated").cast("int") * _bit("E")).alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the rows, good rows and toxic rows that have it."""
    known = labels.groupBy("doc_id").agg((F.max("quality") == 1).cast("int").alias("good"), (F.max("toxic") == 1).cast("int").alias("bad"))
    rows = masks(docs).groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("c"))
    judged = rows.join(known, "doc_id", "left")
    sums = {"n": F.sum("c"), "good": F.sum(F.col("c") * F.coalesce("good", F.lit(0))), "toxic": F.sum(F.col("c") * F.coalesce("bad", F.lit(0)))}
    return judged.groupBy("part", "mask").agg(*[c.alias(n) for n, c in sums.items()])


def _sum(masks_: Column, field: str, wanted) -> Column:
    return F.aggregate(masks_, F.lit(0).cast("long"), lambda acc, m: acc + F.when(wanted(m["mask"]), m[field]).otherwise(0))


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the counts of ``mask_counts``."""
    bits = F.create_map(*[F.lit(x) for name in FILTERS for x in (name, _bit(name))])
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    orders = parts.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS])))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letters = F.split("filter_order", "")
    steps = steps.withColumns(
        {
            "_filter": F.element_at(letters, F.col("step")),
            "_before": F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda acc, c: acc + F.element_at(bits, c)),
        }
    ).withColumn("_bit", F.element_at(bits, F.col("_filter")))
    bit, before = F.col("_bit"), F.col("_before")
    fails = lambda mask: mask.bitwiseAND(bit) != 0
    gone = lambda mask: mask.bitwiseAND(before) != 0
    sums = {
        "kept": _sum(F.col("m"), "n", lambda x: ~fails(x) & ~gone(x)),
        "removed": _sum(F.col("m"), "n", lambda x: fails(x) & ~gone(x)),
        "redundant": _sum(F.col("m"), "n", lambda x: fails(x) & gone(x)),
        "unique_fails": _sum(F.col("m"), "n", lambda x: x == bit),
        "good_lost": _sum(F.col("m"), "good", lambda x: fails(x) & ~gone(x)),
        "toxic_lost": _sum(F.col("m"), "toxic", lambda x: fails(x) & ~gone(x)),
    }
    done = steps.withColumns(sums).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_filter")))
    return done.select("part", "filter_order", "step", *sums, "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters on all rows of ``docs``."""
    return interactions(durable(mask_counts(docs, labels), "masks"))
