"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, exact_topk, license_scan, mixing, near_dedup, pii, sentencepiece_codec, suffix_dedup, toxicity
from .common import table

#: The tokenizer's vocabulary file; None takes the installed public one.
MODEL_PATH: str | None = None


def model_path() -> str:
    if MODEL_PATH:
        return MODEL_PATH
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"), model_path())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def queries() -> dict:
    every = (
        op1_sentencepiece, op2_license_scan, op3_quotation_linking, op4_ann, op5_suffix_dedup,
        op6_toxicity, op7_mixing, op8_pii, op9_exact_topk, op10_near_dedup,
    )
    return {f.__name__: f for f in every}


LOWER = f"translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}')"

#: Every rule's matches, then those that no other one hides. The rules are the same table that the scan uses.
LICENSE_SQL = """
WITH d AS (SELECT doc_id, {lower} AS low FROM documents),
w AS (SELECT doc_id, low, regexp_extract_all(low, '{word}') AS words FROM d),
n AS (SELECT doc_id, low, len(words) AS n_words, ' ' || array_to_string(list_transform(words, lambda x, i: x || '#' || (i - 1)), ' ') AS t FROM w),
rules(rule, label, key, priority, rx) AS (VALUES {rules}),
base(label, rx) AS (VALUES {base}),
m AS (SELECT doc_id, rule, label, priority, unnest(regexp_extract_all(t, rx)) AS hit FROM n JOIN rules ON contains(low, key) WHERE regexp_matches(low, '{gate}')),
p AS (SELECT doc_id, rule, label, priority, CAST(regexp_extract(hit, '#([0-9]+)', 1) AS BIGINT) AS a, CAST(regexp_extract(hit, '#([0-9]+)$', 1) AS BIGINT) AS z FROM m),
k AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p e WHERE e.doc_id = p.doc_id AND e.a <= p.a AND e.z >= p.z AND (e.priority > p.priority OR e.priority = p.priority AND (e.z - e.a > p.z - p.a OR e.a = p.a AND e.z = p.z AND e.rule < p.rule)))),
b AS (SELECT doc_id, label, CAST(regexp_extract(hit, '#([0-9]+)', 1) AS BIGINT) AS a FROM (SELECT doc_id, label, unnest(regexp_extract_all(t, rx)) AS hit FROM n, base)),
kd AS (SELECT doc_id, count(*) AS n_detections, max(priority) AS top FROM k GROUP BY doc_id),
bd AS (SELECT doc_id, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
ld AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM k UNION ALL SELECT doc_id, label FROM b) GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(n_detections, 0) AS BIGINT) AS n_detections, greatest(coalesce(top, 0), CASE WHEN n_base > 0 THEN 90 ELSE 0 END) / 100.0::DOUBLE AS score
FROM n LEFT JOIN kd USING (doc_id) LEFT JOIN bd USING (doc_id) LEFT JOIN ld USING (doc_id)
"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""


QUOTES_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT r, string_split_regex(text, '\r?\n') AS x FROM m),
l AS (SELECT r, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM s),
k AS (SELECT r, i, line, regexp_extract(line, '{marks}') AS marks FROM l),
v AS (SELECT r, i, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, substr(line, length(marks) + 1) AS body FROM k),
n AS (SELECT *, lead(level) OVER (PARTITION BY r ORDER BY i) AS next FROM v),
a AS (SELECT r, i, level, body FROM n WHERE NOT coalesce(level < next AND regexp_matches(body, '{attribution}'), FALSE)),
g AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY r ORDER BY i) IS DISTINCT FROM level THEN 1 ELSE 0 END AS first FROM a),
h AS (SELECT *, sum(first) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
p AS (SELECT r, run, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS body FROM h GROUP BY r, run),
o AS (SELECT r, trim(coalesce(string_agg(body, chr(10) ORDER BY run) FILTER (WHERE level = 0), ''), ' ' || chr(9) || chr(13) || chr(10)) AS own, count(*) FILTER (WHERE level > 0) AS n_quotes, max(level) AS quote_depth FROM p GROUP BY r),
parts AS (SELECT r, level, body FROM p UNION ALL SELECT r, level, unnest(string_split_regex(body, '\n[ \t]*\n')) FROM p
  UNION ALL SELECT r, level, x FROM (SELECT r, level, unnest(string_split(body, chr(10))) AS x FROM p) WHERE len(regexp_extract_all(x, '\S+')) >= 3),
u AS (SELECT DISTINCT conv_id, turn, level, md5(c) AS unit FROM (SELECT r, level, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS c FROM parts) JOIN m USING (r) WHERE c <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
originals AS (SELECT conv_id, unit, min(turn) AS original FROM u WHERE level = 0 GROUP BY conv_id, unit),
linked AS (SELECT q.conv_id, q.turn, q.level, f.original FROM u q JOIN originals f ON f.conv_id = q.conv_id AND f.unit = q.unit WHERE q.level > 0 AND f.original < q.turn),
links AS (SELECT conv_id, turn, arg_max(original, (-level, original)) AS reply_to, count(DISTINCT original) AS n_linked FROM linked GROUP BY conv_id, turn),
up(conv_id, turn, top, steps) AS (SELECT conv_id, turn, reply_to, 1 FROM links UNION ALL SELECT up.conv_id, up.turn, links.reply_to, steps + 1 FROM up JOIN links ON links.conv_id = up.conv_id AND links.turn = up.top),
tree AS (SELECT conv_id, turn, arg_max(top, steps) AS thread_root, max(steps) AS reply_depth FROM up GROUP BY conv_id, turn),
down(conv_id, root, turn, path) AS (SELECT DISTINCT conv_id, thread_root, thread_root, [thread_root] FROM tree UNION ALL
  SELECT down.conv_id, down.root, links.turn, list_append(down.path, links.turn) FROM down JOIN links ON links.conv_id = down.conv_id AND links.reply_to = down.turn),
places AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, root ORDER BY path) - 1 AS position FROM down)
SELECT m.conv_id, m.turn, m.role, o.own AS text, '<|' || coalesce(m.role, '') || '|>' || chr(10) || o.own || '<|end|>' || chr(10) AS formatted,
  CAST(n_quotes AS BIGINT) AS n_quotes, CAST(quote_depth AS BIGINT) AS quote_depth, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, reply_to,
  coalesce(thread_root, m.turn) AS thread_root, CAST(coalesce(reply_depth, 0) AS BIGINT) AS reply_depth, CAST(coalesce(position, 0) AS BIGINT) AS position
FROM m JOIN o USING (r) LEFT JOIN places ON places.conv_id = m.conv_id AND places.turn = m.turn LEFT JOIN links ON links.conv_id = m.conv_id AND links.turn = m.turn LEFT JOIN tree ON tree.conv_id = m.conv_id AND tree.turn = m.turn
"""


def oracle_sql() -> dict[str, str]:
    """op1, op4, op6, op7, op8 and the pipeline have none: SQL has no tokenizer, search graph, fitted model, Newton step or cipher."""
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    rules = ", ".join(f"({o}, {quoted(label)}, {quoted(key)}, {p}, {quoted(rx)})" for o, label, key, p, rx in license_scan.RULES)
    base = ", ".join(f"({quoted(label)}, {quoted(license_scan._pattern(phrase))})" for phrase, label in license_scan.BASE)
    return {
        "op2_license_scan": LICENSE_SQL.format(lower=LOWER, word=license_scan.WORD, rules=rules, base=base, gate=license_scan.GATE),
        "op3_quotation_linking": QUOTES_SQL.replace("{marks}", chat.MARKS).replace("{attribution}", chat.ATTRIBUTION),
        "op9_exact_topk": TOPK_SQL,
        "op10_near_dedup": NEAR_SQL.format(lower=LOWER),
    }
