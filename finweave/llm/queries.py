"""The corpus queries: thin callers of the operators over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from finweave.llm.audio import audio_report
from finweave.llm.common import read_table
from finweave.llm.concurrency import peak_concurrency
from finweave.llm.decontaminate import contaminated
from finweave.llm.importance import importance_scores
from finweave.llm.licenses import license_scan
from finweave.llm.linededup import line_report
from finweave.llm.minhash import near_duplicates
from finweave.llm.mixing import mix_report
from finweave.llm.packing import pack_report
from finweave.llm.quality import quality_scores
from finweave.llm.tokencount import token_counts
from finweave.llm.tokenio import token_output
from finweave.llm.urlfilter import UrlRule, judge_urls

BPE_FILE = "byte_bpe_50k.json"
WORD_FILE = "word_bpe_49k.json"


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_table(spark, sf_dir, "documents"))


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_report(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_table(spark, sf_dir, "documents"))


#: The rules of the query's contract.
URL_RULES = (
    UrlRule("allow", "org/"),
    UrlRule("block", "example.org/es/"),
    UrlRule("block", "example.org/en/1"),
    UrlRule("allow", "com/fr/"),
    UrlRule("block", "com/de/"),
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op11_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peak_concurrency(*(read_table(spark, sf_dir, name) for name in ("sales", "sale_lines", "clients")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_report(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_duplicates, op2_decontamination, op3_line_dedup, op4_audio, op5_token_counts, op6_quality, op7_mixing, op8_url_filter, op9_license_scan, op10_token_output, op11_peak_concurrency, op12_importance_resampling, op13_packing)}


#: The mix as plain windows over all documents; offsets and places are the same digests.
MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, sum(source_size) OVER () AS total FROM per
), filled AS (
  SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)
), leveled AS (
  SELECT arg_min(level, source_size / weight) AS level FROM filled WHERE level * weight <= 2.0 * source_size
), targets AS (
  SELECT source, source_size, coalesce(least(l.level * weight, 2.0 * source_size), 2.0 * source_size) AS target,
    ('0x' || substr(md5(concat('mix-1-offset|', CASE WHEN source IS NULL THEN 'true|' ELSE concat('false|', source) END)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM filled, leveled l
), placed AS (
  SELECT s.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0) ELSE 0 END AS expected,
    row_number() OVER (PARTITION BY s.source ORDER BY floor(ln(size + 1.0::DOUBLE) / ln(2.0::DOUBLE) * 16), substr(md5(concat('mix-1|', coalesce(doc_id::VARCHAR, ''))), 1, 13), doc_id NULLS FIRST, size) - 1 AS place
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (CASE WHEN size > 0 THEN least(floor(expected * (place + 1) + u) - floor(expected * place + u), ceil(expected)) ELSE 0 END::BIGINT * size)::BIGINT AS taken
FROM placed
"""
#: The sweep as plain windows over a nation.
PEAK_SQL = """
WITH shipped AS (
  SELECT sale_id, min(shipped_at) AS shipped FROM sale_lines WHERE shipped_at IS NOT NULL GROUP BY sale_id
), open_sales AS (
  SELECT coalesce(c.nation_id, -1)::INTEGER AS nation_id, floor(epoch(s.sold_at) / 60)::BIGINT * 60 AS from_s,
    floor(epoch(shipped + INTERVAL 7 DAY) / 60)::BIGINT * 60 AS until_s, coalesce(floor(100 * s.total + 0.5), 0)::BIGINT AS cents
  FROM sales s LEFT JOIN shipped USING (sale_id) LEFT JOIN clients c ON c.client_id = s.client_id WHERE s.sold_at IS NOT NULL
), counted AS (
  SELECT * FROM open_sales WHERE until_s IS NULL OR until_s > from_s
), twice AS (
  SELECT * FROM counted UNION ALL SELECT -2, from_s, until_s, cents FROM counted
), net AS (
  SELECT nation_id, moment AS from_s, sum(n)::BIGINT AS n, sum(c)::BIGINT AS c FROM (
    SELECT nation_id, from_s AS moment, 1 AS n, cents AS c FROM twice UNION ALL SELECT nation_id, until_s, -1, -cents FROM twice WHERE until_s IS NOT NULL
  ) GROUP BY 1, 2 HAVING sum(n) <> 0 OR sum(c) <> 0
), running AS (
  SELECT nation_id, from_s, lead(from_s) OVER w AS to_s, sum(n) OVER w AS n_open, sum(c) OVER w AS open_cents FROM net WINDOW w AS (PARTITION BY nation_id ORDER BY from_s)
)
SELECT nation_id, from_s, to_s, n_open::BIGINT AS n_open, open_cents::BIGINT AS open_cents,
  max(n_open) OVER (PARTITION BY nation_id ORDER BY from_s)::BIGINT AS high_open, open_cents = max(open_cents) OVER (PARTITION BY nation_id) AS is_peak
FROM running
"""
#: The draw from counts of distinct words; CRC-32 by its table of 256 remainders, made here from the polynomial.
IMPORTANCE_SQL = r"""
WITH remainders AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)
  )
), words AS (
  SELECT doc_id, 'd' AS side, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT item_id, 't', unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), counted AS (
  SELECT word, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM words GROUP BY word
), hashed AS (
  SELECT word, s, counted.t AS t, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, remainders.t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM counted, remainders
), buckets AS (
  SELECT bucket, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t, (sum(sum(s)) OVER ())::BIGINT AS all_s, (sum(sum(t)) OVER ())::BIGINT AS all_t FROM hashed GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM buckets
), weights AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
    coalesce(floor(total::DOUBLE / n), 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * eligible // 100 THEN place END AS rank FROM scored s LEFT JOIN placed USING (doc_id)
"""
ORACLES: dict[str, str] = {"op7_mixing": MIX_SQL, "op11_peak_concurrency": PEAK_SQL, "op12_importance_resampling": IMPORTANCE_SQL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
