"""Named queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hamming, langid, mixing, ngram_join, passages, substrings, templates, warc, wavelet

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def _with_offsets(found: DataFrame) -> DataFrame:
    spans = F.transform("removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", "text", F.array_join(spans, ";").alias("removed"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_offsets(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages with their exact edges; ``op4_substring_dedup`` removes whole sentences only."""
    return _with_offsets(passages.remove_passages(table(spark, sf_dir, "documents")))


def op5_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each capture's nested records as JSON, payloads as text."""
    found = warc.assemble(warc.records(warc.pages_as_warc(table(spark, sf_dir, "pages"))))
    readable = lambda r, payload: r.withField(payload, r[payload].cast("string"))
    return found.select(
        "capture_id",
        "target_uri",
        "date",
        F.to_json(readable(F.col("response"), "payload")).alias("response"),
        F.to_json(F.transform("requests", lambda r: readable(r, "payload"))).alias("requests"),
        F.to_json(F.transform("metadata", lambda r: readable(r, "content"))).alias("metadata"),
        "truncated",
    )


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.wavelet_shards(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest(table(spark, sf_dir, "embeddings"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_offsets(templates.drop_recurring_lines(table(spark, sf_dir, "documents")))


def op10_chat_prefix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.prefix_trees(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_passage_dedup": op4_passage_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_warc_captures": op5_warc_captures,
    "op6_wavelet_shards": op6_wavelet_shards,
    "op7_mixing": op7_mixing,
    "op8_hamming_topk": op8_hamming_topk,
    "op9_line_templates": op9_line_templates,
    "op10_chat_prefix_trees": op10_chat_prefix_trees,
}

WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
SHINGLES = (
    "list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1),"
    " lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [array_to_string(ws, ' ')] END)"
)

def _share_out_sql(nodes: str, parent: str, name: str) -> str:
    """Water-filling of siblings in SQL; ``nodes`` has capacity, weight and parent_budget."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"({by} ORDER BY capacity::DOUBLE / weight::DOUBLE, {name}"
    return f"""
  SELECT * EXCLUDE (rest, open_weight, saturated), CASE WHEN saturated THEN capacity ELSE (rest * weight) // open_weight END AS budget FROM (
    SELECT *, parent_budget - sum(CASE WHEN saturated THEN capacity ELSE 0 END) OVER ({by}) AS rest,
           sum(CASE WHEN saturated THEN 0 ELSE weight END) OVER ({by}) AS open_weight FROM (
      SELECT *, capacity * sum(weight) OVER {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
             <= weight * (parent_budget - coalesce(sum(capacity) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS saturated
      FROM {nodes} WHERE weight > 0))"""


def _weight_sql(level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in mixing.WEIGHTS[level].items())
    return f"(CASE {cases} ELSE 1 END)" if cases else "1"


def _key_sql(epoch: str) -> str:
    return f"('0x' || substr(md5('{mixing.SEED}|' || {epoch}::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT"


_NUMBER = "regexp_extract(source, '^src([0-9]{1,9})$', 1)"
_MIXING_SQL = f"""
WITH counted AS (
  SELECT doc_id, CASE WHEN coalesce({_NUMBER}, '') = '' THEN 'unknown'
                      ELSE {list(mixing.DOMAINS)}[({_NUMBER}::INT % {len(mixing.DOMAINS)}) + 1] END AS domain,
         coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::BIGINT AS n_tokens
  FROM documents
),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {mixing.MAX_EPOCHS} AS capacity FROM counted GROUP BY ALL),
n1 AS (SELECT domain, sum(capacity) AS capacity, {_weight_sql("domain")} AS weight,
              (SELECT sum(tokens) * {mixing.BUDGET_PERCENT} // 100 FROM leaves) AS parent_budget FROM leaves GROUP BY domain),
b1 AS ({_share_out_sql("n1", "", "domain")}),
n2 AS (SELECT domain, lang, sum(l.capacity) AS capacity, {_weight_sql("lang")} AS weight, any_value(budget) AS parent_budget
       FROM leaves l JOIN b1 USING (domain) GROUP BY domain, lang),
b2 AS ({_share_out_sql("n2", "domain", "lang")}),
n3 AS (SELECT domain, lang, source, l.capacity, tokens, {_weight_sql("source")} AS weight, budget AS parent_budget
       FROM leaves l JOIN b2 USING (domain, lang)),
b3 AS ({_share_out_sql("n3", "domain, lang", "source")}),
planned AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
                   CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM b3),
epochs AS (
  SELECT doc_id, domain, lang, source, n_tokens, whole, rest, unnest(range(0, whole::BIGINT + 1)) AS epoch FROM counted JOIN planned USING (domain, lang, source)
),
keyed AS (SELECT *, {_key_sql("epoch")} AS order_key FROM epochs),
placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY order_key RANGE UNBOUNDED PRECEDING)
            - sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch, order_key) AS before FROM keyed
)
SELECT doc_id, domain, lang, source, epoch, order_key, n_tokens,
       CASE WHEN epoch < whole THEN n_tokens ELSE least(n_tokens, rest - before) END::BIGINT AS taken
FROM placed WHERE epoch < whole OR before < rest
"""

def _uuid_sql(kind: str) -> str:
    h = f"md5('{kind}' || coalesce(page_id::VARCHAR, ''))"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "'urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in cuts)


SQL: dict[str, str] = {
    "op5_warc_captures": f"""
WITH p AS (
  SELECT {_uuid_sql("response")} AS rid, {_uuid_sql("request")} AS qid, {_uuid_sql("metadata")} AS mid, page_id, url, html,
         regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
         regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '#.*$', '') AS path FROM pages
)
SELECT rid AS capture_id, url AS target_uri, '2024-01-01T00:00:00Z' AS date,
  to_json({{'date': '2024-01-01T00:00:00Z', 'record_id': rid, 'target_uri': url, 'status': 200,
           'headers': [{{'name': 'content-type', 'value': 'text/html; charset=utf-8'}}], 'payload': html}})::VARCHAR AS response,
  to_json([{{'date': '2024-01-01T00:00:00Z', 'record_id': qid, 'target_uri': url,
            'request_line': 'GET ' || CASE WHEN path = '' THEN '/' ELSE path END || ' HTTP/1.1',
            'headers': [{{'name': 'host', 'value': host}}], 'payload': ''}}])::VARCHAR AS requests,
  to_json([{{'date': '2024-01-01T00:00:00Z', 'record_id': mid, 'target_uri': url, 'type': 'metadata',
            'content': 'pageId: ' || page_id || chr(13) || chr(10)}}])::VARCHAR AS metadata, false AS truncated
FROM p
""",
    "op8_hamming_topk": f"""
WITH c AS (
  SELECT vec_id, string_agg(CASE WHEN x > 0 THEN '1' ELSE '0' END, '' ORDER BY i)::BIT AS code FROM (
    SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id
),
p AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, bit_count(xor(a.code, b.code))::INT AS distance FROM c a JOIN c b ON a.vec_id <> b.vec_id WHERE a.vec_id % {hamming.QUERY_EVERY} = 0
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id)::INT AS rank FROM p) WHERE rank <= {hamming.K}
""",
    "op4_substring_dedup": f"""
WITH p AS (
  SELECT doc_id, unnest(ps) AS unit, generate_subscripts(ps, 1) AS k FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?] |\n)', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM documents WHERE text IS NOT NULL)
),
w AS (SELECT *, {WORDS.replace("text", "unit")} AS ws, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS stop FROM p),
r AS (
  SELECT *, len(ws) >= {substrings.MIN_WORDS}
         AND row_number() OVER (PARTITION BY array_to_string(ws, ' ') ORDER BY doc_id, k) > 1 AS gone FROM w
),
c AS (
  SELECT doc_id, string_agg(CASE WHEN gone THEN '' ELSE unit END, '' ORDER BY k) AS text,
         coalesce(string_agg((stop - length(unit))::VARCHAR || ':' || stop::VARCHAR, ';' ORDER BY k) FILTER (gone), '') AS removed
  FROM r GROUP BY doc_id
)
SELECT doc_id, c.text, coalesce(c.removed, '') AS removed FROM documents LEFT JOIN c USING (doc_id)
""",
    "op7_mixing": _MIXING_SQL,
    "op2_decontamination": f"""
WITH d AS (
  SELECT doc_id, unnest({SHINGLES}) AS g FROM (SELECT doc_id, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL) WHERE len(ws) > 0
), i AS (
  SELECT item_id, len(sh) AS n, unnest(sh) AS g FROM (
    SELECT item_id, {SHINGLES} AS sh FROM (SELECT item_id, {WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL) WHERE len(ws) > 0)
)
SELECT doc_id, item_id, count(*)::DOUBLE / any_value(n)::DOUBLE AS containment FROM d JOIN i USING (g)
GROUP BY doc_id, item_id HAVING count(*)::DOUBLE / any_value(n)::DOUBLE >= {decontaminate.CONTAINMENT}
""",
    "op3_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) > 0 THEN list_sort({SHINGLES}) END AS sh FROM w),
c AS (SELECT row_number() OVER () AS cls, min(doc_id) AS doc_id, count(*) AS size, sh FROM s WHERE sh IS NOT NULL GROUP BY sh),
e AS (SELECT cls, len(sh) AS n, unnest(sh) AS g FROM c),
p AS (
  SELECT a.cls AS x, b.cls AS y FROM e a JOIN e b ON a.g = b.g AND a.cls <> b.cls GROUP BY 1, 2
  HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE >= {ngram_join.THRESHOLD}
),
reach AS (SELECT cls, doc_id FROM c UNION SELECT p.y, reach.doc_id FROM reach JOIN p ON p.x = reach.cls),
near AS (SELECT x, sum(size) AS near FROM p JOIN c ON c.cls = p.y GROUP BY x),
k AS (SELECT cls, min(doc_id) AS class_id FROM reach GROUP BY cls)
SELECT s.doc_id, coalesce(class_id, s.doc_id) AS class_id, coalesce(size - 1, 0)::BIGINT AS copies, (coalesce(size - 1, 0) + coalesce(near, 0))::BIGINT AS links
FROM s LEFT JOIN c USING (sh) LEFT JOIN near ON near.x = c.cls LEFT JOIN k ON k.cls = c.cls
""",
}
