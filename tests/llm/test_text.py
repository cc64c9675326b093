"""Token operators: exact against the library, brute force and round trips."""

import hashlib
import random
import zlib
from math import log

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pulsegrid.llm import credentials, hashed, prefix_bpe, training_order, trie_counts
from pulsegrid.llm.pretokens import pretokens

PATH = public_tokenizers.path(prefix_bpe.VOCABULARY)
ODD = [
    None, "", " ", "  ", "\n", "it's we'll 'sx ''s !'s 's's 'll'd", "a" * 3000, " " * 2000, "ab" * 1500, "x y  z", "é漢字😀 ½Ⅷ", "<|endoftext|>", "tab\t\tend \n\n next",
    "password = abc", "a b", "a b",
]


def texts(n=400, seed=3):
    alphabet = list("abcdefgstmdvrle'''   \n\t\r019 .,!-éüßñ漢字  \x1c\x85😀ſ½Ⅷ́אabc")
    draw = random.Random(seed)
    return ODD + ["".join(draw.choices(alphabet, k=draw.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(None if i % 11 == 0 else i // 2, t, "x", i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int").repartition(3)


def test_ids_are_the_librarys(spark, table):
    encode = training_order._encoding(PATH).encode_ordinary
    want = {}
    for row in table.collect():
        ids = np.array(encode(row.text or ""), dtype="<u4")
        want.setdefault(row.doc_id, []).append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest()))
    got = {}
    for row in prefix_bpe.encoding_digests(table).collect():
        got.setdefault(row.doc_id, []).append((row.n_tokens, row.ids_sha256, row.decoded_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_encode_then_decode_keeps_columns(spark, table):
    found = prefix_bpe.decode(prefix_bpe.encode(table.select("doc_id", "text", "n_tokens")))
    assert found.columns == ["doc_id", "n_tokens", "text"]
    assert {r.n_tokens: bytes(r.text).decode() for r in found.collect()} == {r.n_tokens: r.text or "" for r in table.collect()}


def test_prefixes_appends_and_edits():
    v = prefix_bpe.vocabulary(PATH)
    draw = random.Random(5)
    for _ in range(30):
        data = bytes(draw.choices(b"abcdethr ning", k=draw.randint(0, 300)))
        whole, grown = prefix_bpe.Prefixes(v, data), prefix_bpe.Prefixes(v, data[:40])
        grown.append(data[40:])
        assert grown.last == whole.last
        cut = draw.randint(0, len(data))
        assert whole.ids(cut) == prefix_bpe.Prefixes(v, data[:cut]).ids()
        begin, end = sorted((draw.randint(0, len(data)), draw.randint(0, len(data))))
        grown.edit(begin, end, b"xyz")
        assert grown.last == prefix_bpe.Prefixes(v, data[:begin] + b"xyz" + data[end:]).last


def test_unigram_counts_are_the_cheapest(spark, table):
    with open(PATH, "rb") as file:
        import base64

        cost = {base64.b64decode(t): round(1e6 * log(int(r) + 2)) for t, r in (x.split() for x in file)}

    def cheapest(form: bytes) -> int:
        at = [(0, 0)]
        for end in range(1, len(form) + 1):
            at.append(min((at[b][0] + cost[form[b:end]], at[b][1] + 1) for b in range(max(0, end - 130), end) if form[b:end] in cost))
        return at[-1][1]

    got = sorted((r.doc_id or -1, r.n_tokens, r.n_bytes) for r in trie_counts.token_counts(table).collect())
    want = []
    for row in table.collect():
        forms = [f.forms[i] for f in pretokens(pa.array([row.text], pa.string())) for i in f.form]
        want.append((row.doc_id or -1, sum(map(cheapest, forms)), len((row.text or "").encode())))
    assert got == sorted(want)


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = training_order.Permutation(n, seed=n)
        slots = p.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert (p.number(slots) == np.arange(n)).all()


def test_shards_hold_every_sequence_in_slot_order(spark, table, folder):
    got = training_order.placed_sequences(spark, table, folder, per_shard=50).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert all(r.shard == r.slot // 50 and r.offset == (r.slot % 50) * training_order.record_type(PATH).itemsize for r in got)
    encode, want = training_order._encoding(PATH).encode_ordinary, []
    for row in table.collect():
        ids = encode(row.text or "")
        for at in range(0, len(ids), training_order.LENGTH):
            part = ids[at : at + training_order.LENGTH]
            want.append((row.doc_id or -1, at // training_order.LENGTH, len(part), zlib.crc32(np.array(part, "<u2").tobytes())))
    assert sorted((r.doc_id or -1, r.part, r.n_ids, r.ids_crc32) for r in got) == sorted(want)
    manifest = spark.read.parquet(f"{folder}/manifest")
    assert sorted(r.slot for r in training_order.read_shards(manifest, folder, PATH, from_slot=33).collect()) == list(range(33, len(got)))


def test_empty_tables(spark, table, folder):
    none = table.where("false")
    assert prefix_bpe.encoding_digests(none).count() == trie_counts.token_counts(none).count() == 0
    assert training_order.placed_sequences(spark, none, folder).count() == 0


def test_credentials_with_prefixed_names_and_any_characters():
    def told(text):
        base, spans = credentials.all_spans(text)
        return [(kind, text[start:end]) for start, end, kind in base], [(kind, text[start:end]) for start, end, kind in spans]

    env = [("endpoint", "HOST=db1.internal"), ("id", "USER=app"), ("secret", "PASSWORD=hunter2x")]
    assert told("DB_HOST=db1.internal\nDB_USER=app\nDB_PASSWORD=hunter2x") == ([], env)
    assert told("db-user: app, my-pwd: hunter2x") == ([], [("id", "user: app"), ("secret", "pwd: hunter2x")])
    parts = [("id", "user=admin"), ("secret", "password=P@ssw0rd!2024"), ("endpoint", "host=db1.internal")]
    assert told("user=admin\npassword=P@ssw0rd!2024\nhost=db1.internal") == ([], parts)
    long = [("assign", "token=abcdefghijkl")]
    assert told("user=admin token=abcdefghijkl") == (long, [("id", "user=admin"), *long])
    assert told("user=admin token=abcdefghijkl@1") == (long, [("id", "user=admin"), *long, ("secret", "token=abcdefghijkl@1")])
    assert told("superuser=admin, password=P@ssw0rd!2024") == ([], [])
    assert told("PASSWORD=hunter2x") == ([], [])


def test_sequences_keep_their_length(spark, folder):
    docs = spark.createDataFrame([(1, " word" * 300)], "doc_id bigint, text string")
    got = training_order.placed_sequences(spark, docs, folder).collect()
    assert sorted((r.part, r.n_ids) for r in got) == [(0, 128), (1, 128), (2, 44)]
    assert training_order.PER_SHARD == 131072


def test_repeated_ids_do_not_push_others_out_of_a_fit(spark):
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(50)] + [(i, f"text {i}") for i in range(2, 9)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id bigint, quality int")
    want = [("copy 0", 1)] + [(f"text {i}", i % 2) for i in range(2, 9)]
    assert hashed.labelled_sample(docs, labels, "quality", rows=4) == want
