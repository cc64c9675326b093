"""Operators on documents against brute force, with nulls, empty and repeated rows, and clashing columns."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import bagminhash, credentials, decontaminate, hashed, quality, toxicity
from pulsegrid.llm.components import components
from pulsegrid.llm.textbatch import lowered, pieces, word_hashes

WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")


def words(draw, n):
    return [f"{draw.choice(['alpha', 'béta', 'gamma', 'delta', 'eps'])}{draw.randrange(400)}" for _ in range(n)]


def bag(text):
    w = WORD.findall((text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def partition(pairs):
    return sorted(sorted(g) for g in pairs.values())


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(4)
    base = [words(draw, draw.choice([3, 30, 80, 200])) for _ in range(25)]
    rows = [" ".join(b) for b in base]
    for b in base[:12]:
        for _ in range(6):
            copy = list(b)
            for _ in range(draw.choice([0, 1, 2, 5])):
                copy[draw.randrange(len(copy))] = f"new{draw.randrange(10**6)}"
            rows.append(" ".join(copy[: draw.choice([len(copy), len(copy) - 2])]))
    rows += [None, "", "  \n ", "!!!", rows[3], rows[3].upper(), "one two", "one  TWO"]
    table = [(i, t, "hot" if i % 3 else "x", 0) for i, t in enumerate(rows)]
    return spark.createDataFrame(table, "doc_id bigint, text string, label string, bag int").repartition(4)


def test_classes_are_those_of_all_pairs(spark, docs):
    rows = docs.collect()
    bags = [bag(r.text) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if either == 0 or both >= 0.8 * either:
                parent[root(i)] = root(j)
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(root(i), []).append(r.doc_id)
    got, sizes = {}, {}
    for r in bagminhash.classes(docs).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
        sizes[r.class_id] = r.class_size
    assert partition(got) == partition(want)
    assert all(min(v) == k and len(v) == sizes[k] for k, v in got.items())
    kept = bagminhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(got)


def test_repeated_and_null_ids(spark):
    text = " ".join(words(random.Random(1), 40))
    rows = [(1, text), (1, text), (None, text), (None, "other words that are only here now"), (2, None), (2, None), (1, "a quite different text of seven words")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert bagminhash.classes(table).count() == 7
    kept = [(r.doc_id, r.text) for r in bagminhash.one_of_each(table).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[3], rows[4], rows[6]], key=str)
    assert bagminhash.classes(table.where("false")).count() == 0


def test_ids_of_text_and_names_that_clash(spark):
    draw = random.Random(9)
    base = words(draw, 200)
    near = [*base[:150], "another", *base[151:]]
    rows = [("b", " ".join(base)), ("a", " ".join(near)), (None, " ".join(base)), ("", "some other text that stands alone here"), ("c", None), ("b", " ".join(base))]
    table = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "77 as _row_id", "78 as row_id", "'x' as _text_hash", "79 as key", "80 as label")
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in bagminhash.classes(table).collect())
    assert got == sorted([("b", "a", 4), ("a", "a", 4), ("None", "a", 4), ("b", "a", 4), ("", "", 1), ("c", "c", 1)])
    kept = bagminhash.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted([tuple(r) for r in kept.collect()], key=str) == sorted([(i, t, 77, 78, "x", 79, 80) for i, t in [("a", " ".join(near)), rows[3], rows[4]]], key=str)
    as_int = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near))], "doc_id int, text string")
    assert [r.class_id for r in bagminhash.classes(as_int).collect()] == [1, 1]


def test_items_of_any_type_of_id(spark):
    text = " ".join(words(random.Random(3), 30))
    docs = spark.createDataFrame([("d1", f"before it {text} after it"), ("d2", "nothing of the kind")], "doc_id string, text string")
    for kind, item in (("int", 5), ("bigint", 5), ("string", "five"), ("smallint", 5)):
        bench = spark.createDataFrame([(item, text)], f"item_id {kind}, text string")
        assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()] == [("d1", item)]


def test_registers_estimate_weighted_similarity():
    draw, errors = np.random.default_rng(0), []
    for _ in range(150):
        ids, a = draw.integers(0, 2**63, 60).astype(np.uint64), draw.integers(1, 9, 60)
        b = np.where(draw.random(60) < 0.5, a, draw.integers(1, 9, 60))
        found = bagminhash.registers(2, np.repeat([0, 1], 60), np.tile(ids, 2), np.concatenate([a, b]))
        errors.append((found[0] == found[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.07


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (900, 900)]
    found = {}
    for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect():
        found.setdefault(r.label, []).append(r.node)
    assert partition(found) == [list(range(41)), list(range(100, 160)), [900]]


def test_contained_items(spark, docs):
    draw = random.Random(9)
    items = [words(draw, n) for n in (3, 5, 9, 14, 40, 70, 300)] + [[], ["solo"]]
    long = words(draw, 5000)
    hidden = [" ".join(long[:k] + item + long[k:]) for k, item in zip((0, 900, 2500, 4000, 4999, 100, 3000), items)]
    partly = " ".join(long[:50] + items[4][:35] + long[50:])
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in enumerate([*hidden, partly, "solo", " ".join(items[0])])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(50, None), (51, " ".join(items[3]))], "item_id bigint, text string")
    want = set()
    for item in bench.collect():
        need = set(bag(item.text))
        for doc, text in rows:
            if need and len(need & set(bag(text))) >= 0.8 * len(need):
                want.add((doc, item.item_id))
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()} == want
    clean = decontaminate.without_leaks(table, bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in rows} - {d for d, _ in want})
    assert decontaminate.leaks(table, bench.where("false")).count() == decontaminate.leaks(table.where("false"), bench).count() == 0


ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def test_base_spans_are_the_patterns():
    draw = random.Random(2)
    bits = ["password", "PassWd", "seſcret", "SECRET", "token", "api_key", "apikey", "=", ":", " ", '"', "AKIA", "ABCD1234EFGH5678", "deadbeef00112233", "0123abcd", "x", "\n", "é", "abcdefghijklmn", "user", "pwd"]
    for _ in range(3000):
        text = "".join(draw.choices(bits, k=draw.randint(0, 25)))
        want = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        (_, got, every), = credentials._scan(pa.array([text]))
        assert sorted(got) == sorted(want) and set(got) <= set(every)


def test_weak_parts_need_complements(spark):
    together = "host=db1.example.com\nuser=alice\npwd=hunter2"
    texts = [together, "user=alice", "pwd=hunter2", "https://example.com/a", "user=bob\n\npwd=hunter2", "user=bob" + " " * 400 + "pwd=hunter2", None, "", together * 200]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "text", "7 as n_chars", "'s' as spans")
    found = {r.doc_id: r.spans for r in credentials.digests(table).collect()}
    assert found[0] == "endpoint:0:20,id:21:31,secret:32:43"
    assert not any(found[i] for i in (1, 2, 3, 4, 6, 7))
    assert found[5] == "id:0:8,secret:408:419"  # one scope, however far apart
    clean = {r.doc_id: r for r in credentials.redact(table).collect()}
    assert clean[0].text == "[endpoint]\n[id]\n[secret]" and clean[0].n_chars == len(clean[0].text)
    assert clean[6].text is None and clean[1].text == "user=alice"
    assert [len(r.base) for r in credentials.find(table, ["doc_id"]).collect()] == [0] * 9


def test_linking_equals_brute_force():
    """Scopes cut out of the text one by one, parts told by their own patterns in each."""
    draw = random.Random(5)
    bits = ["user=alice", "login: bob7", "pwd=hunter2", "token=abcd", "password=P@ss1!x", "secret=abcdefgh12345678", "AKIA" + "Q" * 16, "0123456789abcdef0", "https://h.example/x",
            "host=db1", "10.0.0.1:5432", "word", "x" * 400]
    for _ in range(2000):
        scopes = [" ".join(draw.choices(bits, k=draw.randint(0, 4))) for _ in range(draw.randint(1, 4))]
        want, at = set(), 0
        for scope in scopes:
            weak = [(m.start(), m.end(), "id") for m in credentials.IDENTIFIER.finditer(scope)] + [(m.start(), m.end(), "endpoint") for m in credentials.ENDPOINT.finditer(scope)]
            base, short = credentials.base_spans(scope)
            weak += short + [(m.start(), m.end(), "secret") for m in credentials.SECRET.finditer(scope)]
            has_id = any(k in ("id", "access") for *_, k in base + weak)
            has_secret = any(k in ("secret", "assign", "hex") for *_, k in base + weak)
            has_end = any(k == "endpoint" for *_, k in weak)
            told = {"id": has_secret, "secret": has_id or has_end, "endpoint": has_id and has_secret}
            want |= {(s + at, e + at, k) for s, e, k in weak if told[k]} | {(s + at, e + at, k) for s, e, k in base}
            at += len(scope) + 2
        assert set(credentials.all_spans("\n\n".join(scopes))[1]) == want


def test_patterns_take_time_in_proportion():
    """A megabyte of any one class of characters, after what lets the patterns be tried."""
    head = "x://y user=alice password= host=a 0123456789abcdef AKIA "
    for unit in ("a", "A", "f", "0", " ", "\n", "\n ", "=", "user", "user ", "token:", "a.", "1.", "https:", "jdbc:a", "sql", "é", "password = ", "'", "AKIA"):
        text = head + unit * (1_000_000 // len(unit))
        began = time.process_time()
        credentials.all_spans(text)
        assert time.process_time() - began < 10, unit
    for pattern in (credentials.ASSIGN, credentials.WIDE, credentials.ACCESS, credentials.HEX, credentials.IDENTIFIER, credentials.SECRET, credentials.ENDPOINT, credentials.SCOPE_END):
        for unit in ("a", "Z", "7", " ", "\n", "\t", ".", "é"):
            text, began = unit * 1_000_000, time.process_time()
            sum(1 for _ in pattern.finditer(text))
            assert time.process_time() - began < 1.5, (pattern.pattern, unit)


def test_base_counts_by_hand():
    draw = random.Random(6)
    rows = ["", "a", "a b a b a b", "x y z x y z", "# $ é| <b>\nx\n\nx\n \nx", "l\nl\nl"] + [
        " ".join(draw.choices(["ab", "cé", "d\nd", "e\t", "#"], k=draw.randint(0, 150))) for _ in range(200)
    ]
    for texts in pieces(pa.array(rows)):
        _words, _ = quality._features(texts)
        got = quality.base_counts(texts, _words)
        for i, text in enumerate(rows):
            w = re.findall("[^\x20\x09-\x0d]+", text)
            triples = Counter(zip(w, w[1:], w[2:]))
            inside = {k + j for k, t in enumerate(zip(w, w[1:], w[2:])) if triples[t] > 1 for j in range(3)}
            lines = text.split("\n")
            again = sum(bool(re.search("[^\x20\x09-\x0d]", x)) and x in lines[:k] for k, x in enumerate(lines))
            want = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)]
            assert [got[c][i] for c in got] == want, text


@pytest.fixture(scope="module")
def labelled(spark):
    draw, rows, marks = random.Random(8), [], []
    for i in range(900):
        good, toxic = i % 4 != 0, i % 5 == 0
        body = words(draw, 120)
        if not good:
            body = [w.upper() + "!!" for w in body]
        if toxic:
            for _ in range(3):
                body[draw.randrange(120)] = "nasty" + draw.choice(["er", "est", "ish", "oid", "ling", "zz"])
        rows.append((i, " ".join(body)))
        marks.append((i, int(good), int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "some text")]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


def test_toxicity_of_held_out_rows(labelled):
    docs, labels = labelled
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    scored = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.predicted for r in scored]) > 0.95
    one = toxicity.toxicity(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in one.collect()} == {0}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_quality_verdicts(labelled):
    docs, labels = labelled
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    got = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert np.mean([got[k] == bool(v) for k, v in truth.items()]) > 0.97
    assert not got[5000] and not got[5001] and not got[None]
    kept = quality.keep_good(docs.selectExpr("doc_id", "text", "1 as kept", "2 as n_words"), labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in got.items() if v)
    assert kept.columns == ["doc_id", "text", "kept", "n_words"]


def test_code_points_of_any_text():
    text = "".join(map(chr, [1, 0x41, 0x7F, 0x80, 0x7FF, 0x800, 0xFFFF, 0x10000, 0x10FFFF])) + "aé漢😀"
    values, number = hashed.code_points(np.frombuffer(text.encode(), np.uint8))
    assert values.tolist() == [ord(c) for c in text]
    assert number.tolist() == [i for i, c in enumerate(text) for _ in c.encode()]


def plain_grams(word):
    """Buckets of the character n-grams of a word, one by one."""
    marked, out = [1, *map(ord, word), 1], []
    for order in hashed.ORDERS:
        for i in range(len(marked) - order + 1):
            h = 0
            for c in marked[i : i + order]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
            h = (h ^ h >> 15) * (0x9E3779B1 + 2 * order) & 0xFFFFFFFF
            out.append(h >> 32 - hashed.BITS)
    return out


def test_toxicity_scores_follow_from_the_model():
    draw = np.random.default_rng(3)
    model = toxicity.Model(draw.normal(size=1 << hashed.BITS).astype(np.float32), -0.3)
    texts = ["", "one", "Ünïcode wörds, 漢字 and 😀 of-all kinds; again and again: nine ten eleven twelve", "a b c d e f g h i j k l m n o p q " * 40, "...", "x" * 3000]
    got = np.concatenate([toxicity.scores(model, t) for t in pieces(lowered(pa.array(texts)))])
    for text, score in zip(texts, got):
        found = re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())
        vectors = []
        for word in found:
            (piece,) = pieces(pa.array([word]))
            buckets = [*hashed.bucket(word_hashes(piece)[1]).tolist(), *plain_grams(word)]
            vectors.append(np.mean([model.weights[b] for b in buckets]))
        windows = [np.mean(vectors[i : i + toxicity.WINDOW]) * toxicity.WINDOW for i in range(0, len(vectors), toxicity.WINDOW)]
        assert abs(score - 1 / (1 + np.exp(-(max(windows, default=0.0) + model.bias)))) < 1e-5


def test_quality_of_rows_that_were_not_fitted_on(spark, labelled):
    docs, labels = labelled
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    fitted = labels.where("doc_id % 3 <> 0 or doc_id is null")
    rows = [r for r in quality.judge(docs, fitted).collect() if r.doc_id is not None and r.doc_id in truth and r.doc_id % 3 == 0]
    assert len(rows) > 250 and np.mean([truth[r.doc_id] == r.kept for r in rows]) > 0.95


def test_long_and_repeated_texts(spark, labelled):
    docs, labels = labelled
    long = (" ".join(words(random.Random(8), 200)) + " ") * 1_000
    more = docs.unionByName(spark.createDataFrame([(6000, long), (6001, long + " nastyer nastyest nastyoid"), (6002, "same"), (6002, "same")], "doc_id bigint, text string"))
    found = {}
    for r in toxicity.toxicity(more, labels).where("doc_id >= 6000").collect():
        found.setdefault(r.doc_id, []).append(r.score)
    assert len(found[6002]) == 2 and len(set(found[6002])) == 1
    assert found[6000][0] < 0.5 < found[6001][0]
    judged = quality.judge(more, labels).where("doc_id >= 6000").collect()
    assert sorted(r.n_words for r in judged) == [1, 1, 200_000, 200_003]


def test_nodes_with_many_partners_are_dealt_out(spark, docs, monkeypatch):
    want = partition(_class_lists(docs))
    monkeypatch.setattr(bagminhash, "PARTNERS", 2)
    assert partition(_class_lists(docs)) == want


def _class_lists(docs):
    found = {}
    for r in bagminhash.classes(docs).collect():
        found.setdefault(r.class_id, []).append(r.doc_id)
    return found
