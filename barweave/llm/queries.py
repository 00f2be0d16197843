"""The queries of the numbered operators over the driver's tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, divergence, language_id, packing, quality_model, quality_rules, secret_scan, simhash, top_k, url_filter, vector_codes, warc
from .common import table, words_of

#: Rules of the URL query: host, path, action.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rhost, rpath, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), found AS (
  SELECT s.*, r.rhost || r.rpath AS rule, r.action FROM split s LEFT JOIN rules r
    ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM found
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""


#: The conversation that the query adds: its texts hold the template's own marks.
EXTRA_TEXT = r"\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chat(turns))


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), sized AS (
  SELECT *, length(text)
      + (length(text) - length(replace(text, '\', '')))
      + (length(text) - length(replace(text, '###', ''))) // 3
      + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 END + 9 AS size,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                     ELSE before IS NOT NULL AND before = 'user' END) AND bool_or(from_end = 1 AND role = 'assistant') AS valid
FROM sized GROUP BY conv_id
"""


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.size(words_of(F.col("text"))).alias("n_units"))
    return packing.pack(simhash.near_duplicates(docs), length=F.col("n_units"), cluster=F.col("component_id"))


def held_out(divisor: int, rest: int):
    """Whether the id's CRC leaves this remainder."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor)) == rest, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = language_id.train(language_id.training_stretches(docs.where(~held_out(4, 2))))
    found = language_id.label_languages(docs.select("doc_id", "text"), network, keep_text=False)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    found = quality_model.classify(docs, labels, ~held_out(5, 0))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.judge(docs, keep_text=False).select("doc_id", *counts)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    number = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(secret_scan.listed(F.col("base_spans")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.mark_contaminated(docs, table(spark, sf_dir, "benchmark"), keep_text=False)


OP5_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM item WHERE len(w) > 0
), item_window AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words FROM sized, unnest(range(1, len(w) - k + 2)) AS t(i)
), doc_window AS (
  SELECT doc_id, s.k, i, array_to_string(w[i:i + s.k - 1], ' ') AS words
  FROM doc, (SELECT DISTINCT k FROM sized) s, unnest(range(1, len(w) - s.k + 2)) AS t(i)
), found AS (
  SELECT doc_id, d.k, i, item_id FROM doc_window d JOIN item_window m ON d.words = m.words AND d.k = m.k
), hits AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM found, unnest(range(i, i + k)) AS t(j) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(d.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN hits h USING (doc_id) LEFT JOIN named d USING (doc_id)
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), found AS (
  SELECT d, lang, source, unnest(w) AS term FROM doc
), grp AS (
  SELECT DISTINCT lang, source FROM doc
), vocab AS (
  SELECT lang, term, count(*) AS lang_n FROM found GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM found JOIN vocab USING (lang, term) GROUP BY ALL
), sized AS (
  SELECT lang, count(*) AS v, sum(lang_n)::HUGEINT AS lang_total FROM vocab GROUP BY lang
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM grp LEFT JOIN counted USING (lang, source) GROUP BY lang, source
), dense AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + s.v))::HUGEINT AS p,
         (1 + (1000000000::HUGEINT * (v.lang_n + 1)) // (s.lang_total + s.v))::HUGEINT AS q
  FROM totals g JOIN vocab v ON v.lang = g.lang JOIN sized s ON s.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::HUGEINT AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM dense WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    found = vector_codes.with_group_sum(coded, "label", "error", "label_error")
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _op11_sql(rounds: int = 2) -> str:
    """Every round compares every part with every entry of its codebook, without bounds."""
    nearest = """
    SELECT x.id, x.part, min(list_sum(list_transform(list_zip(x.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + c.j) AS best
    FROM part x JOIN book{r} c ON c.part = x.part GROUP BY ALL"""
    update = """
    SELECT b.part, b.j, CASE WHEN s.c IS NULL THEN b.c ELSE s.c END AS c FROM book{q} b LEFT JOIN (
      SELECT part, j, list((total - ((total % n) + n) % n) // n ORDER BY pos) AS c FROM (
        SELECT x.part, a.best % 64 AS j, u.pos, sum(x.x[u.pos])::BIGINT AS total, count(*)::BIGINT AS n
        FROM part x JOIN near{q} a ON a.id = x.id AND a.part = x.part, unnest(range(1, len(x.x) + 1)) AS u(pos) GROUP BY ALL
      ) GROUP BY ALL
    ) s ON s.part = b.part AND s.j = b.j"""
    steps = "".join(f", near{r} AS MATERIALIZED ({nearest.format(r=r)}\n), book{r + 1} AS MATERIALIZED ({update.format(q=r)}\n)" for r in range(rounds))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT id, p.part, v[p.part * (len(v) // 16) + 1 : (p.part + 1) * (len(v) // 16)] AS x FROM kept, unnest(range(16)) AS p(part)
), book0 AS MATERIALIZED (
  SELECT part, id - 1 AS j, x AS c FROM part WHERE id <= 64
){steps}, near{rounds} AS MATERIALIZED ({nearest.format(r=rounds)}
), coded AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', n.best % 64), '' ORDER BY n.part) AS code, sum(n.best // 64)::BIGINT AS error
  FROM kept k JOIN near{rounds} n USING (id) GROUP BY k.id, vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(u.x::VARCHAR, ',' ORDER BY part, j, pos)) FROM book{rounds}, unnest(range(1, len(c) + 1)) AS t(pos), unnest([c[pos]]) AS u(x)) AS codebooks_sha256
FROM coded
"""


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH kept AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.id, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM kept q JOIN kept c ON q.vec_id % 50 = 0 AND q.vec_id IS DISTINCT FROM c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM scored
QUALIFY rank <= 5
"""


QUERIES = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_quality_model": op6_quality_model,
    "op7_secrets": op7_secrets,
    "op8_url_filter": op8_url_filter,
    "op9_chat": op9_chat,
    "op10_simhash": op10_simhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_divergence": op12_divergence,
    "op13_top_k": op13_top_k,
}
ORACLES = {"op5_decontamination": OP5_SQL, "op8_url_filter": OP8_SQL, "op9_chat": OP9_SQL, "op11_vector_codes": _op11_sql(), "op12_divergence": OP12_SQL, "op13_top_k": OP13_SQL}
