"""The queries opN_* and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.chat_format import chat_digest, format_chats
from quillspark.llm.decontaminate import contaminated
from quillspark.llm.mixing import mix_sources
from quillspark.llm.quality_classifier import fit_quality, quality_views, score_quality
from quillspark.llm.quality_rules import quality_rules
from quillspark.llm.sharding import shard_documents
from quillspark.llm.simhash_dedup import simhash_groups
from quillspark.llm.simhash_sql import simhash_sql
from quillspark.llm.substring_dedup import dedup_substrings
from quillspark.llm.toxicity import fit_toxicity, score_toxicity
from quillspark.llm.warc import read_warc, write_warc
from quillspark.scratch import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path)
    found = read_warc(spark, path, payloads=False).where("kind = 'record'")
    number = lambda c: F.col(c).cast("bigint")
    return found.select(number("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = quality_views(_table(spark, sf_dir, "documents"))
    return score_quality(views, fit_quality(views, _table(spark, sf_dir, "labels")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("row_key", "hamming")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digest(format_chats(turns.unionByName(extra)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_dedup": op1_simhash_dedup,
        "op3_warc": op3_warc,
        "op2_mixing": op2_mixing,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_toxicity": op5_toxicity,
        "op6_decontaminate": op6_decontaminate,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_sharding": op8_sharding,
        "op9_quality_rules": op9_quality_rules,
        "op10_chat_format": op10_chat_format,
    }


OP3_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


OP6_SQL = r"""
WITH i AS (SELECT DISTINCT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM
  (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
ish AS (SELECT item_id, w AS iw, n, k, s, count(*) AS c FROM (SELECT item_id, w, n, k, unnest(list_transform(range(1, n - k + 2), lambda j: w[j : j + k - 1])) AS s FROM i) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
dsh AS (SELECT rid, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: w[j : j + k - 1])) AS s, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i)),
hit AS (SELECT rid, item_id, iw, n, dsh.k, c, s, p FROM dsh JOIN ish USING (k, s)),
starts AS (SELECT DISTINCT rid, item_id, iw, n, k, unnest(range(p - n + k, p + 1)) AS a FROM hit),
win AS (SELECT starts.*, greatest(a, 0) AS b, least(a + n, len(w)) AS e FROM starts JOIN d USING (rid)),
shared AS (SELECT win.rid, win.item_id, win.iw, win.n, win.k, b, e, s, least(count(*), any_value(c)) AS m FROM win JOIN hit ON win.rid = hit.rid AND win.item_id = hit.item_id AND win.iw = hit.iw AND p BETWEEN b AND e - win.k
  GROUP BY win.rid, win.item_id, win.iw, win.n, win.k, a, b, e, s),
m AS (SELECT rid, item_id, iw, b, e, CAST(sum(m) AS DOUBLE) / (n - k + 1 + e - b - k + 1 - sum(m)) AS similarity FROM shared GROUP BY rid, item_id, iw, n, k, b, e),
best AS (SELECT *, row_number() OVER (PARTITION BY rid, item_id ORDER BY similarity DESC, b, e) AS r FROM m WHERE similarity >= 0.8)
SELECT doc_id, item_id, CAST(b AS INTEGER) AS first_word, CAST(e - b AS INTEGER) AS n_words, similarity FROM best JOIN d USING (rid) WHERE r = 1
"""

OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT rid, doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i : i + 49], ' '))) AS hs FROM d WHERE len(w) >= 50),
x AS (SELECT rid, doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM h),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS at FROM x JOIN f USING (h) WHERE doc_id > first),
p AS (SELECT rid, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM d),
k AS (SELECT p.rid, count(gone.at) AS n_removed, string_agg(word, ' ' ORDER BY p.at) FILTER (WHERE gone.at IS NULL) AS kept
  FROM p LEFT JOIN gone ON p.rid = gone.rid AND p.at = gone.at GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""

OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS g, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
again AS (SELECT rid, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM g JOIN again USING (rid, g)) GROUP BY 1),
raw AS (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT rid, source, t, line, trim(regexp_replace(lower(line), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS norm FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY 1),
hosts AS (SELECT source, greatest(5, 0.05 * count(DISTINCT t)) AS most FROM d GROUP BY 1),
often AS (SELECT source, norm FROM l JOIN hosts USING (source) GROUP BY 1, 2 HAVING count(DISTINCT t) > any_value(most)),
cut AS (SELECT rid, sum(len(string_split(norm, ' '))) AS n FROM l JOIN often USING (source, norm) GROUP BY 1),
b AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(cut.n, 0) AS c FROM d LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN cut USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - c >= 0.3 * n_words AS kept, CAST(c AS BIGINT) AS n_line_words_removed FROM b
"""

OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL
  SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, lag(r) OVER k AS before, row_number() OVER k AS i, length(replace(replace(t, '\', '\\'), '<|', '<\|')) AS nt, length(replace(replace(r, '\', '\\'), '<|', '<\|')) AS nr
  FROM c WINDOW k AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY i) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(nt + CASE WHEN before = r THEN 8 ELSE 23 + nr END) AS BIGINT) AS formatted_chars FROM o GROUP BY 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_simhash_dedup": simhash_sql(), "op3_warc": OP3_SQL, "op6_decontaminate": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op9_quality_rules": OP9_SQL, "op10_chat_format": OP10_SQL}
