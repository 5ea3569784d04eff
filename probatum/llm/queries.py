"""One registered query per operator, over its whole table, and the SQL check where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.llm import bpe, chat, divergence, html_extract, itq, linededup, mixing, negatives, ngramjoin, periodic, quality, topk, toxicity
from probatum.llm.common import crc32_mod, table
from probatum.operators.grouping import once

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f
    return put


def bpe_digests(docs: DataFrame) -> DataFrame:
    coded = bpe.encode(docs, RANKS, keep=["doc_id"])
    # the ids go to decoding once only: their digest is taken before
    told = coded.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        "token_ids", "token_ends",
    )
    decoded = bpe.decode(told, RANKS, keep=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query(f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'
), r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c
), e AS (
  SELECT *, length(regexp_replace(role, '([<\\[])(\\\\*)(\\|[A-Za-z_]+\\|>|/?s>|<SYS>>|</SYS>>|/?INST\\])', '\\1\\\\\\2\\3', 'g')) AS role_len,
    length(regexp_replace(text, '([<\\[])(\\\\*)(\\|[A-Za-z_]+\\|>|/?s>|<SYS>>|</SYS>>|/?INST\\])', '\\1\\\\\\2\\3', 'g')) AS text_len,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_len + CASE WHEN prev IS NULL OR prev <> role THEN role_len + 8 + 8 + 7 ELSE 8 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_conversations(rows).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"),
        F.concat_ws("", chat.read_loss_texts(F.col("formatted"), F.col("loss_mask"))).alias("loss"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.concat_ws("", line).cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    substr(md5('7:' || coalesce(doc_id::VARCHAR, '~') || ':' || md5(coalesce(text, '~'))), 1, 15) AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source
), w AS (
  SELECT *, CASE number % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM s
), k AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM w
), l AS (
  SELECT coalesce(min_by(lam, ratio) FILTER (lam * weight <= cap), 0) AS level FROM k
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM w, l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), g AS MATERIALIZED (
  SELECT d.source, u, size, sum(size) AS words, any_value(target - whole * source_size) AS open
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source WHERE size > 0 AND target / source_size > whole GROUP BY d.source, u, size
), f AS (
  SELECT DISTINCT source, open, '' AS after, 0 AS pass FROM g
  UNION ALL
  SELECT source, any_value(open) - coalesce(sum(words) FILTER (upto <= open), 0) AS open, min(u) FILTER (upto > open) AS after, any_value(pass) + 1
  FROM (
    SELECT g.source, f.open, u, words, pass, sum(words) OVER (PARTITION BY g.source ORDER BY u) AS upto
    FROM g JOIN f ON g.source IS NOT DISTINCT FROM f.source AND u > after AND size <= f.open
  ) GROUP BY source
), spans AS (
  SELECT source, open AS most, after, coalesce(lead(after) OVER (PARTITION BY source ORDER BY pass), 'g') AS before FROM f
), o AS (
  SELECT source, min(open) AS gap FROM f GROUP BY source
), t2 AS (
  SELECT g.source, u, words, size FROM g JOIN spans s ON g.source IS NOT DISTINCT FROM s.source AND u > after AND u < before AND size <= most
), x AS (
  SELECT g.source, arg_min(u, (abs(words - gap), u)) AS extra FROM g JOIN o ON g.source IS NOT DISTINCT FROM o.source
  WHERE abs(words - gap) < gap AND size < 2 * gap
    AND NOT EXISTS (SELECT 1 FROM t2 WHERE t2.source IS NOT DISTINCT FROM g.source AND t2.u = g.u) GROUP BY g.source
)
SELECT doc_id, d.size, source_size, target,
  (d.size * (whole + CASE WHEN t2.u IS NOT NULL OR coalesce(d.u = extra, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
LEFT JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source AND d.u = t2.u LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
""")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc32_mod("doc_id", 5) == 0
    scored = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc32_mod("doc_id", 3) == 1
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query()
def op10_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query()
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_removed").cast("bigint").alias("n_removed"),
        F.length("deduped").cast("bigint").alias("kept_chars"), F.sha2(F.col("deduped").cast("binary"), 256).alias("kept_sha256"), "kept_in")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; of every document whose crc32(doc_id) ends in 0 the words from one place on repeat a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    told = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = once(told, g=F.floor(h / 10), w=F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))
    n = F.size("w")
    told = once(told, a=F.when(n > 0, F.col("g") % n))
    told = once(told, p=1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    words = F.transform("w", lambda x, i: F.when(i >= F.col("a"), F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(x))
    return told.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.repeated_runs(with_planted_runs(table(spark, sf_dir, "documents")), keep=["doc_id"])
    found = once(found, top=periodic.longest_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.row <> c.row AND len(a.v) = len(c.v)
), p AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, row AS positive, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.vec_id, s.row)::INTEGER AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


@query(r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS text FROM documents
), b AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    regexp_replace(text, '[a-z]+', '', 'g') AS rest
  FROM d
), g AS (
  SELECT row, unnest(generate_series(0, len(w) - 3)) AS i, w FROM b WHERE len(w) >= 3
), h AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, w[i + 1], w[i + 2], w[i + 3]) AS seen FROM g
), c AS (
  SELECT row, sum(least(3, coalesce(ahead - i, 3)))::BIGINT AS n_repeat_words
  FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS ahead FROM h WHERE seen > 1) GROUP BY row
), base AS (
  SELECT b.*, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(text) AS n
  FROM b LEFT JOIN c USING (row)
), k AS (
  SELECT *, [n - length(rest), length(rest) - length(regexp_replace(rest, '[A-Z]+', '', 'g')), length(rest) - length(regexp_replace(rest, '[0-9]+', '', 'g')),
    length(rest) - length(regexp_replace(rest, '[\x20\x09]+', '', 'g')), length(rest) - length(regexp_replace(rest, '[\x0A-\x0D]+', '', 'g')),
    length(rest) - length(regexp_replace(rest, '[.,;:]+', '', 'g')), length(rest) - length(regexp_replace(rest, '[!?]+', '', 'g')),
    length(rest) - length(regexp_replace(rest, '[#*$%&|<>]+', '', 'g')), length(rest) - length(regexp_replace(rest, '[\x80-\x{10FFFF}]+', '', 'g'))] AS counts
  FROM base
), c2 AS (
  SELECT *, list_append(counts, n - list_sum(counts)) AS classes FROM k
), words AS (
  SELECT lang, unnest(w) AS word FROM c2
), wc AS (
  SELECT lang, word, count(*) AS c FROM words GROUP BY GROUPING SETS ((lang, word), (word))
), total AS (
  SELECT lang, grouping(lang) = 1 AS whole, count(*) AS words FROM words GROUP BY GROUPING SETS ((lang), ())
), langs AS (
  SELECT t.lang, t.words FROM total t WHERE NOT whole AND lang IS NOT NULL AND words >= 2000 AND 1000 * words >= (SELECT words FROM total WHERE whole)
), own AS (
  SELECT c2.*, langs.lang AS ref FROM c2 LEFT JOIN langs USING (lang)
), cw AS (
  SELECT langs.lang AS ref, word, count(*) / any_value(langs.words) AS share FROM words JOIN langs USING (lang) GROUP BY langs.lang, word HAVING 500 * count(*) >= any_value(langs.words)
  UNION ALL SELECT NULL, word, count(*) / any_value(t.words) FROM words, (SELECT words FROM total WHERE whole) t GROUP BY word HAVING 500 * count(*) >= any_value(t.words)
), bins AS (
  SELECT ref, word, CASE WHEN share >= 0.01 THEN word ELSE '~~band' END AS bin, share FROM cw
), q0 AS (
  SELECT ref, bin, sum(share) AS q FROM bins GROUP BY ref, bin
), q AS (
  SELECT * FROM q0 UNION ALL SELECT refs.ref, '~~other', 1 - coalesce((SELECT sum(q) FROM q0 WHERE q0.ref IS NOT DISTINCT FROM refs.ref), 0) FROM (SELECT lang AS ref FROM langs UNION ALL SELECT NULL) refs
), dw AS (
  SELECT row, ref, unnest(w) AS word, len(w) AS m FROM own
), p AS (
  SELECT row, dw.ref, coalesce(bin, '~~other') AS bin, count(*) / any_value(m) AS p FROM dw LEFT JOIN bins ON dw.ref IS NOT DISTINCT FROM bins.ref AND dw.word = bins.word GROUP BY row, dw.ref, coalesce(bin, '~~other')
), jw AS (
  SELECT row, sqrt(greatest(0, (sum(p * ln(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) + ln(2) * (1 - sum(q))) / 2 / ln(2))) AS js_words
  FROM p JOIN q ON p.ref IS NOT DISTINCT FROM q.ref AND p.bin = q.bin GROUP BY row
), cls AS (
  SELECT row, ref, unnest(classes) AS c, unnest(generate_series(1, 10)) AS class, n FROM own
), rc AS (
  SELECT lang AS ref, class, sum(c) AS c FROM (SELECT own.lang, unnest(classes) AS c, unnest(generate_series(1, 10)) AS class FROM own) WHERE lang IN (SELECT lang FROM langs) GROUP BY lang, class
  UNION ALL SELECT NULL, class, sum(c) FROM cls GROUP BY class
), qc AS (
  SELECT ref, class, c / sum(c) OVER (PARTITION BY ref) AS q FROM rc
), jc AS (
  SELECT row, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2 / ln(2))) AS js_chars
  FROM (SELECT row, class, c / n AS p, q FROM cls JOIN qc USING (class) WHERE cls.ref IS NOT DISTINCT FROM qc.ref AND n > 0) GROUP BY row
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(n >= 200 AND js_chars > 0.2 + 1.5 / sqrt(n), false)
    AND NOT coalesce(n_words >= 50 AND js_words > 0.18 + 1 / sqrt(n_words), false) AS kept
FROM own LEFT JOIN jw USING (row) LEFT JOIN jc USING (row)
""")
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judged(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("char_distance", "word_distance")
