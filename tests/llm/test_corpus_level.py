"""Mix, filter audit and manifest against plain versions: nulls, empty and long texts, ties, repeated rows, text ids, clashing names."""

import hashlib
import math
import random
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import filter_audit, merkle, mixing, ranges, text_tries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def awkward_docs(n=260, seed=1):
    """A hot source, a source of one row, a null one; copies, repeated rows, null columns, one long text."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "delta,", "é", "x#", "o", "the"]) + rng.choice(["", "", "s", "1"])
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(word() for _ in range(rng.choice([0, 3, 40, 130]))) for _ in range(rng.choice([1, 2, 4])))
        source = "hot" if i % 3 == 0 else rng.choice(["b", "a", "ä", None, "empty"])
        rows.append((i, "" if source == "empty" else text, rng.choice(["en", "de", None, ""]), source, len(text)))
    rows += [(1000 + i, rows[3][1], "en", "hot", 5) for i in range(60)] + [rows[5]] * 4
    rows += [(None, rows[3][1], "en", "a", None), (None, None, None, None, None), (7, "other text of an id that is there", "en", "a", 3)]
    rows += [(2000, None, "en", "b", 0), (2001, "", "de", "b", 0), (2002, "long words " * 50_000, "en", "single", 550_000)]
    return rows


def frame(spark, rows):
    """With columns whose names the operators use inside."""
    extra = {c: F.lit(77) for c in ("_range", "_run", "_at", "lo", "n", "tree", "size", "part", "mask", "path", "key", "_tie")}
    return spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns(extra)


@pytest.fixture
def docs(spark):
    return frame(spark, awkward_docs())


# --- manifest ---------------------------------------------------------------------------------------


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest(*[field(v) for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(leaves):
    """Root, and per leaf the (left, right) siblings of every level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            paths[leaf].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        level = [digest(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def plain_manifest(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        members = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[source] = members, *plain_tree([leaf_of(r, r[1]) for r in members])
    root, tops = plain_tree([trees[s][1] for s in order])
    out = []
    for source, top in zip(order, tops):
        members, subroot, paths = trees[source]
        for row, path in zip(members, paths):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            folded = leaf_of(row, row[1].replace("\n", "") if hit and row[1] is not None else row[1])
            for left, right in path + top:
                folded = digest(left, folded, right)
            out.append((row[0], leaf_of(row, row[1]), subroot, root, digest(*[x + y for x, y in path + top]), folded, folded == root))
    return sorted(out, key=str)


def got_manifest(df):
    return sorted([tuple(r) for r in merkle.audit(df).collect()], key=str)


def test_manifest_equals_brute_force(spark, docs):
    want = plain_manifest(awkward_docs())
    assert got_manifest(docs) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 81, 82, 243, 250])
def test_manifest_of_trees_of_every_shape(spark, n):
    rows = [(i, f"text {i}\n", "en", "s", i) for i in range(n)]
    assert got_manifest(frame(spark, rows)) == plain_manifest(rows)


def test_manifest_over_many_bands_and_sources(spark, monkeypatch):
    """Bands of one level each, and more sources than a bucket holds."""
    rows = [(i, f"text {i}\n", "en", f"s{i % 11}" if i % 2 else "hot", i) for i in range(300)]
    for band in (1, 2):
        monkeypatch.setattr(merkle, "BAND", band)
        monkeypatch.setattr(merkle, "SPAN", 3**band)
        assert got_manifest(frame(spark, rows)) == plain_manifest(rows)


def test_manifest_of_text_ids_and_of_nothing(spark):
    df = frame(spark, [(i, "a\nb", "en", "s", 1) for i in range(30)]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    rows = [(f"d{i}", "a\nb", "en", "s", 1) for i in range(30)]
    by_text = sorted(rows)
    leaves = [leaf_of(r, r[1]) for r in by_text]
    assert {r["doc_id"]: r["root"] for r in merkle.manifest(df).collect()} == {r[0]: plain_tree([plain_tree(leaves)[0]])[0] for r in rows}
    assert merkle.audit(df.where("false")).count() == 0


# --- mix --------------------------------------------------------------------------------------------


def plain_targets(sizes):
    """Shares by weight; what is above three times a source's size is dealt again to the others."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not above:
            return {s: float(3 * sizes[s]) if s in full else share * weight[s] for s in order}
        full |= above


def test_mix_equals_brute_force(spark, docs):
    rows = awkward_docs()
    n_words = lambda t: len((t or "").split())
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + n_words(r[1])
    targets = plain_targets(sizes)
    got = mixing.mix(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), n_words(r[1])) for r in rows)
    taken, by_source = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size and r.epochs * r.size <= r.taken <= (r.epochs + 1) * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        by_source.setdefault(r.source, []).append(r)
    assert all(abs(taken[s] - targets[s]) < 1 + 1e-6 for s in sizes)
    for s, members in by_source.items():
        # In the order of the keys, documents are taken whole, then one in part, then none.
        extra = [(r.taken - r.epochs * r.size, r.size) for r in sorted(members, key=lambda r: (r.sample_key, r.doc_id or -1)) if r.size]
        parts = [e / n for e, n in extra]
        assert parts == sorted(parts, reverse=True) and sum(0 < p < 1 for p in parts) <= 1
    assert {3} < {round(targets[s] / sizes[s]) for s in sizes if sizes[s]}
    key = lambda r: (str(r.doc_id), r.sample_key, r.taken)
    assert sorted(map(key, mixing.mix(docs.repartition(3)).collect())) == sorted(map(key, got))


def test_better_documents_are_sampled_more_often(spark):
    """2,000 good and 2,000 poor documents of equal size, half of which fit: the share of good ones follows the weights."""
    rows = [(i, ("fine words in a line " * 4 if i % 2 else "fine 1234 5678 9012 91 " * 4) + str(i), "en", "a" if i < 4000 else "b", 1) for i in range(8000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).where("source = 'b'")
    good = got.where("taken > epochs * size").agg(F.avg((F.col("doc_id") % 2).cast("double"))).first()[0]
    assert 0.6 < good < 0.95


def test_reads_of_the_mix(spark, docs):
    mixed = mixing.mix(docs)
    reads = mixing.epoch_reads(mixed)
    assert reads.agg(F.sum("words")).first()[0] == mixed.agg(F.sum("taken")).first()[0]
    assert reads.where("words < 0 or epoch > 3").count() == 0


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "", None, "a", 0), (2, None, None, None, 0)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


# --- audit ------------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    out, seen = {}, []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = [w for w in text.replace("\n", " ").split(" ") if w]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                 "D": any(c in "#$%&*|" for c in text), "E": doc_id is not None and least[text] < doc_id}
        good, toxic = (any(v[k] == 1 for v in labels.get(doc_id, [])) if doc_id is not None else False for k in (0, 1))
        seen.append((lang or "", {k for k in fails if fails[k]}, good, toxic))
    for part in {s[0] for s in seen}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order):
                mine = [s for s in seen if s[0] == part]
                here = [s for s in mine if f in s[1] and not s[1] & gone]
                kept = sum(not s[1] & (gone | {f}) for s in mine)
                out[part, "".join(order), step + 1] = [kept, len(here), sum(f in s[1] for s in mine) - len(here), sum(s[1] == {f} for s in mine), sum(s[2] for s in here), sum(s[3] for s in here)]
                shapley[f] += len(here)
                gone.add(f)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                out[part, "".join(order), step + 1].append(shapley[f])
    return out


@pytest.mark.parametrize("range_bytes", [32 << 20, 4_000])
def test_audit_equals_brute_force(spark, docs, monkeypatch, range_bytes):
    monkeypatch.setattr(text_tries, "RANGE_BYTES", range_bytes)
    rng = random.Random(2)
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    known = {}
    for i, q, t in labels:
        known.setdefault(i, []).append((q, t))
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r[:3]): list(r[3:]) for r in got.collect()} == plain_audit(awkward_docs(), known)


def test_audit_of_nothing(spark, docs):
    assert filter_audit.audit(docs.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_tries_find_copies_under_long_common_prefixes(spark, monkeypatch):
    """Texts that share up to 5,000 bytes, over many ranges: boundaries must look past what they share."""
    monkeypatch.setattr(text_tries, "RANGE_BYTES", 20_000)
    rng = random.Random(3)
    heads = ["x" * 5_000, "x" * 70, "ü" * 40, ""]
    texts = [rng.choice(heads) + str(rng.randrange(400)) for _ in range(1500)] + ["x" * n for n in range(1, 300)]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 5
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    cuts = text_tries.boundaries(df.select("text"), 30)
    assert cuts == sorted(set(cuts)) and len(cuts) > 10 and max(map(len, cuts)) > 5_000
    least = {}
    for i, t in rows:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    got = text_tries.repeated(df, "doc_id", []).collect()
    assert sorted((str(r.doc_id), r.repeated) for r in got) == sorted((str(i), i is not None and least[t] < i) for i, t in rows)


def test_trie_nodes_are_compressed():
    trie, rng = text_tries.Trie(), random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(2_000)]
    for i, t in enumerate(texts):
        trie.insert(t, i, (i,))
    found = {row[0]: flag for row, flag in trie.walk()}
    assert found == {i: texts.index(t) < i for i, t in enumerate(texts)}
    stack, nodes = [trie.root], 0
    while stack:
        node = stack.pop()
        nodes += 1
        assert node is trie.root or node.rows or len(node.below) > 1
        stack.extend(node.below.values())
    assert nodes <= 2 * len(set(texts)) + 1


# --- ranges -----------------------------------------------------------------------------------------


def test_ranks_and_sums_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", (i * 37) % 500, i) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, at long, id long")
    ranked = {r.id: (r.lo, r.n) for r in ranges.ranked(df, "key", ["at", "id"]).collect()}
    before = {r.id: r.upto for r in ranges.summed_before(df, "key", ["at", "id"], "at", "upto").collect()}
    for key in {r[0] for r in rows}:
        total = 0
        members = sorted([r for r in rows if r[0] == key], key=lambda r: r[1:])
        for i, (_, at, id_) in enumerate(members):
            assert ranked[id_] == (i, len(members)) and before[id_] == total
            total += at
