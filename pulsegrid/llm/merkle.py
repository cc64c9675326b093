"""A Merkle manifest of a corpus by nested-interval labels.

Every node of a source's tree is labelled with the interval [lo, hi) of leaf ranks that it covers. Levels are handled in bands of ``BAND``:
a bucket is the interval that one node at the top of a band covers, at most ``SPAN`` nodes of the band's lowest level, and one row holds the
nodes of a bucket, level by level. Bands are built from the leaves to the root, one grouping each. On the way back every bucket is joined to
the node above that contains its interval, by (tree, bucket), and a node's siblings at each level are the interval difference: what its
parent's run holds left of it and right of it. The subroots are the leaves of one more tree of the same kind.

Nulls: any column may be null; a leaf hashes ``-`` for it. Null ids come first in their source, null sources first among sources. A null id
is never tampered with. Repeated rows are a leaf each, and so are rows that share an id: those go by their leaf digest. An empty table gives
no rows. Other columns are neither hashed nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.ranges import ranked
from pulsegrid.storage import durable

ARITY = 3
BAND = 4
SPAN = ARITY**BAND
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<left:string,right:string>>"


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: dict[str, Column] | None = None) -> Column:
    """The digest of a row; ``columns`` replaces some of its fields."""
    return _digest(*[_field((columns or {}).get(c, F.col(c))) for c in FIELDS])


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda c: c["digest"]), "")


def _run(level: Column, i: Column) -> Column:
    """The children of the ``i``-th parent above ``level``."""
    return F.slice(level, (i * ARITY + 1).cast("int"), ARITY)


def _parents(level: Column) -> Column:
    def parent(i: Column) -> Column:
        kids = _run(level, i)
        return F.struct(F.get(kids, F.lit(0))["lo"].alias("lo"), F.element_at(kids, -1)["hi"].alias("hi"), _digest(_joined(kids)).alias("digest"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int")), parent)


def build(leaves: DataFrame, payload: Sequence[str] = ()) -> list[DataFrame]:
    """The bands of all trees from the lowest up: tree, n, bucket and the nodes of the bucket's levels ``l0`` .. ``l<BAND>``.

    ``leaves`` has tree (not null), n (leaves of the tree), lo (rank), digest. A level above the root of its tree is null. The number of bands
    follows from the largest tree: each takes ``BAND`` levels, so ten billion leaves need six.
    """
    largest = leaves.agg(F.max("n")).first()[0] or 0
    found, unit = [], 1
    items = leaves.withColumn("hi", F.col("lo") + 1)
    node = F.struct("lo", "hi", "digest", *payload)
    while True:
        width = unit * SPAN
        rows = items.groupBy("tree", F.expr(f"lo div {width}").alias("bucket")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(node)).alias("l0"))
        for j in range(1, BAND + 1):
            rows = rows.withColumn(f"l{j}", F.when(F.col("n") > unit * ARITY ** (j - 1), _parents(F.col(f"l{j - 1}"))))
        rows = durable(rows, "band")
        found.append(rows)
        if largest <= width:
            return found
        top = F.col(f"l{BAND}")[0]
        items = rows.where(F.col("n") > width).select("tree", "n", top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest"))
        node = F.struct("lo", "hi", "digest")
        unit = width


def roots(bands: Sequence[DataFrame]) -> DataFrame:
    """tree, digest of the root of every tree, from the band in which it ends."""
    levels = [F.col(f"l{j}")[0]["digest"] for j in range(BAND, -1, -1)]
    ends = [_ending(rows, b).select("tree", F.coalesce(*levels).alias("digest")) for b, rows in enumerate(bands)]
    return reduce(DataFrame.unionByName, ends)


def _ending(rows: DataFrame, band: int) -> DataFrame:
    low = SPAN**band if band else 0
    return rows.where((F.col("n") > low) & (F.col("n") <= SPAN ** (band + 1)))


def _steps(x: Column, unit: int) -> Column:
    """Siblings of the node ``x`` and of its ancestors inside its bucket, a step per level: those left of it and those right of it."""
    i = F.floor((x["lo"] % (unit * SPAN)) / unit)
    steps = []
    for j in range(BAND):
        kids = _run(F.col(f"l{j}"), F.floor(i / ARITY ** (j + 1)))
        left, right = F.filter(kids, lambda c: c["hi"] <= x["lo"]), F.filter(kids, lambda c: c["lo"] >= x["hi"])
        step = F.array(F.struct(_joined(left).alias("left"), _joined(right).alias("right")))
        steps.append(F.when(F.col(f"l{j + 1}").isNotNull(), step).otherwise(F.array().cast(_STEPS)))
    return F.concat(*steps)


def descend(bands: Sequence[DataFrame], crown: DataFrame, carried: Sequence[str], payload: Sequence[str] = ()) -> DataFrame:
    """lo, digest and payload of every leaf with ``path``, its steps to the top, and the carried columns of its tree.

    ``crown`` has tree, path and the carried columns: what stands above the root of each tree.
    """
    above = None
    for band in range(len(bands) - 1, -1, -1):
        unit, rows = SPAN**band, bands[band]
        width = unit * SPAN
        ends = _ending(rows, band).select("tree", "bucket", F.col("l0")[0]["lo"].alias("_lo"), F.element_at("l0", -1)["hi"].alias("_hi")).join(crown, "tree")
        if above is not None:
            inner = above.select("tree", F.expr(f"lo div {width}").alias("bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "path", *carried)
            ends = ends.unionByName(inner)
        held = rows.join(ends, ["tree", "bucket"]).where((F.col("_lo") <= F.col("l0")[0]["lo"]) & (F.element_at("l0", -1)["hi"] <= F.col("_hi")))
        names = list(payload) if band == 0 else []
        item = lambda x: F.struct(*[x[c].alias(c) for c in ("lo", "hi", "digest", *names)], F.concat(_steps(x, unit), F.col("path")).alias("path"))  # noqa: E731, B023
        above = held.select("tree", *carried, F.inline(F.transform("l0", item)))
        if band:
            above = durable(above, "paths")
    return above.select("tree", *carried, "lo", "digest", *payload, "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda acc, p: _digest(p["left"], acc, p["right"]))


def proof_digest(path: Column) -> Column:
    return _digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def manifest(docs: DataFrame, second: Column | None = None) -> DataFrame:
    """doc_id, leaf, second, subroot, root and path of every row; ``second`` is another digest of the row that is carried along."""
    # Sources keep their order under this name, and a null one comes first.
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    leaves = docs.select(
        "doc_id", tree.alias("tree"), leaf_digest().alias("digest"), (second if second is not None else F.lit(None).cast("string")).alias("second"), F.monotonically_increasing_id().alias("_tie")
    )
    # Written first: a range partitioning reads its input twice, and texts should be hashed once.
    placed = ranked(durable(leaves, "leaves"), "tree", ["doc_id", "digest", "_tie"]).drop("_tie")
    bands = build(placed, ["doc_id", "second"])
    members = roots(bands).select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest")
    crown_bands = build(ranked(members, "tree", ["member"]), ["member"])
    top = roots(crown_bands).select("tree", F.array().cast(_STEPS).alias("path"), F.col("digest").alias("root"))
    crown = durable(descend(crown_bands, top, ["root"], ["member"]).select(F.col("member").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "crown")
    rows = descend(bands, crown, ["subroot", "root"], ["doc_id", "second"])
    return rows.select("doc_id", F.col("digest").alias("leaf"), "second", "subroot", "root", "path")


def audit(docs: DataFrame) -> DataFrame:
    """Every row's leaf, roots and proof, and whether its proof still holds once half of the texts have lost their line feeds."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    rows = manifest(docs, leaf_digest({"text": text}))
    folded = rows.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": fold(F.col("second"), F.col("path"))})
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
