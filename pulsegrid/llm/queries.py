"""The registered queries of this subpackage, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import bagminhash, credentials, decontaminate, filter_audit, html_paths, merkle, mixing, prefix_bpe, quality, toxicity, training_order, trie_counts, warc
from pulsegrid.storage import new_table_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op10_prefix_bpe")
def op10_prefix_bpe(spark, sf_dir):
    """Every document's ids by prefix dynamic programming, and the text they decode to, as digests."""
    return prefix_bpe.encoding_digests(_table(spark, sf_dir, "documents"))


@_query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    """Every document's toxicity by subword embeddings fitted on labels outside the held-out fifth."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op9_quality")
def op9_quality(spark, sf_dir):
    """Every document's base counts and the verdict of the n-gram regression."""
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


@_query("op6_credentials")
def op6_credentials(spark, sf_dir):
    """Secrets of every document: base spans as counts and digest, and all spans with the linked weak parts."""
    return credentials.digests(_table(spark, sf_dir, "documents"))


@_query("op5_trie_counts")
def op5_trie_counts(spark, sf_dir):
    """Every document's number of unigram tokens, from forward scores on a trie of its pre-tokens."""
    return trie_counts.token_counts(_table(spark, sf_dir, "documents"))


@_query("op1_html_paths")
def op1_html_paths(spark, sf_dir):
    """The main text of every page by tag-path ratios."""
    return html_paths.main_texts(_table(spark, sf_dir, "pages"))


_WARC_SQL = """WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""


@_query("op7_warc_members", _WARC_SQL)
def op7_warc_members(spark, sf_dir):
    """Every page through whole-file archives, their normalised form, and reads by offset."""
    return warc.roundtrip(_table(spark, sf_dir, "pages"), new_table_path(spark, "warc"))


WORD_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+')"
_NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORD_SQL} AS ws FROM documents),
k AS (SELECT ws, min(doc_id) AS node, count(*) AS copies FROM w GROUP BY ws),
s AS (SELECT node, s, count(*) AS n FROM (
  SELECT node, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) ELSE [array_to_string(ws, ' ')] END) AS s
  FROM k WHERE len(ws) > 0) GROUP BY node, s),
t AS (SELECT node, sum(n) AS total FROM s GROUP BY node),
o AS (SELECT a.node AS a, b.node AS b, sum(least(a.n, b.n)) AS shared FROM s a JOIN s b ON a.s = b.s AND a.node < b.node GROUP BY a.node, b.node),
e AS (SELECT a, b FROM o JOIN t x ON x.node = a JOIN t y ON y.node = b WHERE shared >= 0.8 * (x.total + y.total - shared)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT node, node AS label FROM k UNION SELECT b.b, r.label FROM reach r JOIN both_ways b ON b.a = r.node),
c AS (SELECT node, min(label) AS class_id FROM reach GROUP BY node),
z AS (SELECT class_id, sum(copies) AS class_size FROM c JOIN k USING (node) GROUP BY class_id)
SELECT w.doc_id, c.class_id, CAST(z.class_size AS BIGINT) AS class_size
FROM w JOIN k ON w.ws = k.ws JOIN c USING (node) JOIN z USING (class_id)"""


@_query("op3_bagminhash", _NEAR_SQL)
def op3_bagminhash(spark, sf_dir):
    """Every document's class of near-duplicates by weighted Jaccard similarity of five-word shingles."""
    return bagminhash.classes(_table(spark, sf_dir, "documents"))


_LEAK_SQL = f"""WITH w AS (SELECT doc_id, {WORD_SQL} AS ws FROM documents), v AS (SELECT item_id, {WORD_SQL} AS ws FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest({{shingles}}) AS s FROM w WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, unnest({{shingles}}) AS s FROM v WHERE len(ws) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
o AS (SELECT doc_id, item_id, count(*) AS n_shared FROM i JOIN d USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM o JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles""".replace(
    "{shingles}",
    "CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) ELSE [array_to_string(ws, ' ')] END",
)


@_query("op4_decontamination", _LEAK_SQL)
def op4_decontamination(spark, sf_dir):
    """Every benchmark item that a document contains."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op8_training_order")
def op8_training_order(spark, sf_dir):
    """Every sequence of every document's ids at its slot in fixed-stride shards, as read back from them."""
    return training_order.placed_sequences(spark, _table(spark, sf_dir, "documents"), new_table_path(spark, "order"))


_MERKLE_SQL = """WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, source, text, lang, n_chars,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 2 = 0 AS hit FROM documents, crc_table),
f AS (SELECT doc_id, source, text, hit, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
  || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
  replace(text, chr(10), '') AS bare FROM d),
h AS (SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
  CASE WHEN hit THEN sha256(head || coalesce(octet_length(encode(bare)) || ':' || bare, '-')) ELSE sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) END AS second FROM f),
leaves AS (SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM h),
nodes AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, n, pos // 3),
subs AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, pos, n, digest FROM subs
  UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, n, pos // 3),
every AS (SELECT tree, level, pos, n, digest FROM nodes UNION ALL SELECT NULL, level, pos, n, digest FROM tops),
sides AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM every a JOIN every b ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos),
up AS (SELECT tree, pos AS id, tree AS at, 0 AS level, pos, '' AS proof, second AS folded FROM leaves
  UNION ALL SELECT up.tree, up.id, up.at, up.level + 1, up.pos // 3, proof || l || r, sha256(l || folded || r) FROM up JOIN sides s ON s.tree = up.at AND s.level = up.level AND s.pos = up.pos),
mid AS (SELECT tree, id, max_by(proof, level) AS proof, max_by(folded, level) AS folded FROM up GROUP BY tree, id),
over AS (SELECT m.tree, m.id, 0 AS level, s.pos, m.proof, m.folded FROM mid m JOIN subs s USING (tree)
  UNION ALL SELECT o.tree, o.id, o.level + 1, o.pos // 3, proof || l || r, sha256(l || folded || r) FROM over o JOIN sides s ON s.tree IS NULL AND s.level = o.level AND s.pos = o.pos),
ended AS (SELECT tree, id, max_by(proof, level) AS proof, max_by(folded, level) AS folded FROM over GROUP BY tree, id)
SELECT doc_id, leaf, subs.digest AS subroot, tops.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = tops.digest AS verified
FROM leaves JOIN ended ON ended.tree = leaves.tree AND ended.id = leaves.pos JOIN subs ON subs.tree = leaves.tree JOIN tops ON tops.n = 1"""


@_query("op13_merkle_intervals", _MERKLE_SQL)
def op13_merkle_intervals(spark, sf_dir):
    """Every document's leaf, roots and proof by nested intervals, and whether the proof holds after tampering."""
    return merkle.audit(_table(spark, sf_dir, "documents"))


_MIX_SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, source IS NULL AS last FROM documents),
k AS (SELECT doc_id, source, last, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  -ln((CAST('0x' || substr(sha256('11:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || text), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    / greatest(0.01::DOUBLE, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) / greatest(length(text), 1) * (len(list_distinct(string_split(text, chr(10)))) / len(string_split(text, chr(10))))) AS sample_key
  FROM d),
s AS (SELECT last, source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY last, source) - 1 AS r FROM k GROUP BY last, source),
w AS (SELECT *, [5, 2, 1][r % 3 + 1] AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, cap / w AS stop, coalesce(sum(cap) OVER before, 0) AS caps, coalesce(sum(w) OVER before, 0) AS ws, sum(source_size) OVER () AS total, sum(w) OVER () AS weights FROM w
  WINDOW before AS (ORDER BY cap / w, last, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - caps) / (weights - ws), (stop, last, source)) AS share FROM o WHERE (total - caps) / (weights - ws) <= stop),
t AS (SELECT last, source, source_size, coalesce(least(CAST(cap AS DOUBLE), share * w), 0) AS target FROM o, l),
p AS (SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
  coalesce(sum(size) OVER (PARTITION BY k.last, k.source ORDER BY sample_key, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
  FROM k JOIN t ON k.last = t.last AND k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, CAST(epochs * size + least(greatest(floor(target - epochs * source_size) - upto, 0), size) AS BIGINT) AS taken, epochs FROM p"""


@_query("op11_weighted_mix", _MIX_SQL)
def op11_weighted_mix(spark, sf_dir):
    """Every document's words in a mix of the sources to target weights."""
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("sample_key")


_AUDIT_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
  [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
   coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)] AS fails FROM w LEFT JOIN g USING (doc_id)),
o AS (SELECT '' AS o UNION ALL SELECT o || f FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS t(f) WHERE NOT contains(o, f)),
s AS (SELECT o AS filter_order, CAST(step AS INT) AS step, ascii(o[step]) - 64 AS f, list_transform(string_split(o[1:step - 1], ''), lambda c: ascii(c) - 64) AS earlier
  FROM o, unnest([1, 2, 3, 4, 5]) AS t(step) WHERE length(o) = 5),
x AS (SELECT part, good, bad, fails, count(*) AS n FROM m GROUP BY ALL),
j AS (SELECT part, filter_order, step, f, fails[f] AS hit, step > 1 AND list_bool_or(list_transform(earlier, lambda e: coalesce(fails[e], false))) AS gone, len(list_filter(fails, lambda b: b)) = 1 AS alone, good, bad, n FROM x, s),
c AS (SELECT part, filter_order, step, f, sum(n) FILTER (WHERE NOT hit AND NOT gone) AS kept, sum(n) FILTER (WHERE hit AND NOT gone) AS removed, sum(n) FILTER (WHERE hit AND gone) AS redundant,
  sum(n) FILTER (WHERE hit AND alone) AS unique_fails, sum(n) FILTER (WHERE hit AND NOT gone AND good) AS good_lost, sum(n) FILTER (WHERE hit AND NOT gone AND bad) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM c"""


@_query("op12_filter_tries", _AUDIT_SQL)
def op12_filter_tries(spark, sf_dir):
    """What five filters remove from each language in all orders; equal texts by tries over ranges of texts."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
