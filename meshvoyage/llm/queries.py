"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, dedup, htmltext, jaccard, langid, linededup, packing, urlfilter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("item_ids")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(), ids=False, digests=True)


#: An extra conversation whose texts hold marks of common templates.
MARKED = r"\### Assistant: </turn> ok"

#: The rules that op7 applies.
RULES = [
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
]


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").cast("int").alias("turn"), role.alias("role"), F.lit(MARKED).alias("text"))
    return chat.read_back(chat.format_windows(turns.union(extra)))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(warc.responses_of(_read(spark, sf_dir, "pages")))
    return records.select(
        F.col("key").cast("bigint").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "date", "content_type",
        "content_length", "block_digest", "payload_digest", F.decode("block", "UTF-8").alias("block"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (op1_decontamination, op2_exact_dedup, op3_language_id, op4_packing, op5_chat_format, op6_warc_derivatives, op7_url_filter, op8_html_text, op9_line_dedup, op10_jaccard_join)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_PLAIN_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
             i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
             ip AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0),
             iw AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM ip),
             dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
             dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM dp),
             hit AS (SELECT doc_id, p, n, item FROM dw JOIN iw USING (n, g)),
             spans AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)),
             h AS (SELECT doc_id, count(*) AS n_hit FROM spans GROUP BY doc_id),
             m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op10_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
             p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0),
             s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM p),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
             l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 80 * (x.n + y.n - c.c)),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r(doc_id, component) USING KEY (doc_id) AS (SELECT doc_id, doc_id FROM documents
               UNION (SELECT e.b, min(r.component) FROM r JOIN e ON e.a = r.doc_id JOIN recurring.r o ON o.doc_id = e.b WHERE r.component < o.component GROUP BY e.b))
        SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, r.component AS component_id
        FROM documents JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op5_chat_format": r"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
                   UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
             n AS (SELECT *, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{N}]')) + 3 AS n,
                          16 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
                             + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS chars,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq FROM r),
             b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                          first_value(CASE WHEN role = 'system' THEN n END) OVER (PARTITION BY conv_id ORDER BY seq) AS sys_n,
                          first_value(chars) OVER (PARTITION BY conv_id ORDER BY seq) AS sys_chars FROM n),
             s AS (SELECT *, CAST(floor(before * 3.0 / (greatest(2048 - 256 - coalesce(sys_n, 0), 3) * 2)) AS BIGINT) AS span FROM b),
             f AS (SELECT *, lag(span) OVER (PARTITION BY conv_id ORDER BY seq) IS DISTINCT FROM span AS starts FROM s),
             l AS (SELECT *, min(CASE WHEN starts THEN before END) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM f)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars + CASE WHEN later - before <= 256 AND NOT (seq = 1 AND sys_n IS NOT NULL) THEN chars ELSE 0 END
                              + CASE WHEN starts AND seq > 1 AND sys_n IS NOT NULL THEN sys_chars ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM l GROUP BY conv_id""",
    "op7_url_filter": r"""
        WITH RECURSIVE u AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
             p AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
             rules(verdict, h, s) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
             best AS (SELECT page_id, max_by(h || s, length(h || s)) AS rule, max_by(verdict, length(h || s)) AS verdict
                      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id),
             link AS (SELECT regexp_replace(url, '#.*', '') AS a,
                             regexp_replace(regexp_extract(html, '(?i)<link rel="canonical" href="([^"]+)"', 1), '#.*', '') AS b FROM p),
             edge AS (SELECT a, b FROM link WHERE b <> '' UNION SELECT b, a FROM link WHERE b <> ''),
             alias AS (SELECT a, b FROM edge UNION SELECT alias.a, edge.b FROM alias JOIN edge ON alias.b = edge.a),
             ruled AS (SELECT regexp_replace(p.url, '#.*', '') AS node, best.verdict FROM p JOIN best USING (page_id)),
             said AS (SELECT alias.a AS node, min(ruled.verdict) AS verdict FROM alias JOIN ruled ON alias.b = ruled.node GROUP BY alias.a)
        SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, said.verdict, 'allow') AS verdict
        FROM p LEFT JOIN best USING (page_id) LEFT JOIN said ON regexp_replace(p.url, '#.*', '') = said.node""",
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
        FROM d JOIN g ON d.body = g.body""",
    "op9_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
             k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
             m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS dropped FROM k LEFT JOIN r ON k.key = r.key)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}
