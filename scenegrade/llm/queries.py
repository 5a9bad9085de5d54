"""Registered queries of this subpackage and the DuckDB SQL for those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from scenegrade.llm import chat_format, language_id, near_dedup, packing, quality_rules, sentencepiece_viterbi
from scenegrade.llm import substring_dedup, token_alignment, token_blocks, url_filter, vector_codes, warc
from scenegrade.llm.common import pick, table
from scenegrade.llm.exact_dedup import exact_duplicates

URL_RULES = [
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
]


def held_out():
    """Holds out every fourth document of op1, by the CRC of its id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file, by the box's own lookup."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    model = language_id.fit(docs.filter(~held_out()).select("text", "lang"))
    return language_id.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Settings(words=2))


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_file_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = pick(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    planted = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat_format.conversation_digests(given.unionByName(planted))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(table(spark, sf_dir, "pages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.round_trips(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_RULES} AS t(host, path, verdict)")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = (tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    return token_alignment.alignment(table(spark, sf_dir, "documents"), *files)[0]


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_near_dedup, op3_token_blocks, op4_chat_format, op5_best_fit_packing, op6_exact_dedup,
        op7_quality_rules, op8_warc, op9_sentencepiece, op10_url_filter, op11_token_alignment, op12_vector_codes, op13_substring_dedup, pipeline,
    )
}

_WORDS = r"string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+')"

OP2 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter({_WORDS}, lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS k
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (
  SELECT u, v FROM common WHERE 100 * k >= 80 * (nu + nv - k)
), edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT e.v, r.root FROM reach r JOIN edges e ON e.u = r.node
), best AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN best ON node = doc_id
"""

_ESCAPED = r"replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<')"
OP4 = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), steps AS (
  SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || role || ': </turn>') + 1 + length({_ESCAPED}))::BIGINT AS formatted_chars,
  bool_and((before || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user'))
    AND bool_or(after IS NULL AND role IN ('user', 'assistant')) AS valid
FROM steps GROUP BY conv_id
"""

OP6 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP8 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP10 = rf"""
WITH rules(rh, rp, verdict) AS (VALUES {_RULES}),
urls AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM urls
), hits AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN hits USING (page_id)
"""

_CODED = ["""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, len(embedding) // 4 AS d, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, e[p * d + 1 : (p + 1) * d] AS x FROM v CROSS JOIN range(4) AS r(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS c, x FROM parts QUALIFY c < 256
)"""]
#: Distance and index in one integer: their least is the nearest entry, ties to the lower index.
_NEAREST = """, near{k} AS MATERIALIZED (
  SELECT q.vec_id, q.p, q.x, min((list_inner_product(q.x, q.x) - 2 * list_inner_product(q.x, b.x) + list_inner_product(b.x, b.x))::BIGINT * 256 + c) AS best
  FROM parts q JOIN book{k} b ON q.p = b.p GROUP BY ALL
)"""
_MOVED = """, sums{k} AS (
  SELECT p, best % 256 AS c, i, floor(sum(x[i]) / count(*)) AS s FROM near{k} CROSS JOIN generate_series(1, (SELECT max(d) FROM v)) AS g(i) GROUP BY ALL
), book{n} AS MATERIALIZED (
  SELECT b.p, b.c, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (SELECT p, c, list(s ORDER BY i) AS x FROM sums{k} GROUP BY p, c) m ON b.p = m.p AND b.c = m.c
)"""
for _k in range(4):
    _CODED += [_NEAREST.format(k=_k), _MOVED.format(k=_k, n=_k + 1)]
_CODED += [_NEAREST.format(k=4), """, codes AS (
  SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM near4 GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM book4
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN v USING (vec_id) CROSS JOIN digest"""]
OP12 = "".join(_CODED)

_CASED = _WORDS.replace("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "coalesce(text, '')")
OP13 = rf"""
WITH words AS MATERIALIZED (
  SELECT doc_id, list_filter({_CASED}, lambda x: x <> '') AS w FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS x
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS s FROM words)
), repeated AS (
  SELECT doc_id, s FROM windows JOIN (SELECT x, min(doc_id) AS least FROM windows GROUP BY x) USING (x) WHERE doc_id > least
), gone AS (
  SELECT DISTINCT doc_id, s + k AS i FROM repeated CROSS JOIN range(13) AS r(k)
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM words) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op2_near_dedup": OP2, "op4_chat_format": OP4, "op6_exact_dedup": OP6, "op8_warc": OP8, "op10_url_filter": OP10, "op12_vector_codes": OP12, "op13_substring_dedup": OP13}
