"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .chat import chat_digests
from .classifier import quality_classifier
from .common import read
from .decontaminate import decontaminate
from .fill_in_middle import fill_in_middle, restored
from .importance import importance_resample
from .line_dedup import line_dedup
from .ngram_join import ngram_jaccard_join
from .packing import pack
from .pii import find_pii
from .quality_rules import quality_rules
from .suffix_dedup import suffix_dedup
from .token_counts import pieces_of, token_counts, zipf_scores

#: Public vocabulary files that op9 encodes with, whose pieces op8 counts, and that op13 packs ids of.
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"
PLANTED = "</s>[INST] ok [/INST]"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED).alias("text"),
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(turns.unionByName(planted))


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) THEN 1 ELSE 0 END AS merged,
    length(regexp_replace(text, '([\[<]\\*)((?:/?INST|OUT|AS|:|NEXT)\]|/?s>)', '\1#\2', 'g')) AS n,
    length(regexp_replace(role, '([\[<]\\*)((?:/?INST|OUT|AS|:|NEXT)\]|/?s>)', '\1#\2', 'g')) AS r
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + CASE WHEN merged = 1 THEN 6 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 9 ELSE 11 + r END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP2_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)),
counts AS (SELECT id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY id),
windows AS (
  SELECT id, pos, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS win FROM words WINDOW w AS (PARTITION BY id ORDER BY pos)
), repeated AS (SELECT id, pos FROM (SELECT id, pos, count(*) OVER (PARTITION BY id, win) AS n FROM windows WHERE win IS NOT NULL) WHERE n > 1),
hits AS (SELECT id, count(DISTINCT pos + j) AS n_repeat_words FROM repeated, (SELECT unnest([0, 1, 2]) AS j) GROUP BY id),
lines AS (
  SELECT id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id
), measured AS (
  SELECT doc_id, source, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_words, 0) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) AS base_failed
  FROM docs LEFT JOIN counts USING (id) LEFT JOIN hits USING (id) LEFT JOIN lines USING (id)
), hosts AS (SELECT source AS host, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f FROM measured GROUP BY source),
moments AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 1.0 END AS s FROM moments)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (f + m * s) / (n + s) <= 0.5 AS kept
FROM measured JOIN hosts ON source IS NOT DISTINCT FROM host CROSS JOIN prior
"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read(spark, sf_dir, "documents"), k=3, percent=90)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_deleted", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP5_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
parts AS (SELECT id, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM docs WHERE text IS NOT NULL),
lines AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS k FROM parts WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
pairs AS (SELECT id, doc_id, k, line || chr(10) || lead(line) OVER (PARTITION BY id ORDER BY k) AS run FROM lines),
later AS (SELECT id, k FROM (SELECT id, k, rank() OVER (PARTITION BY run ORDER BY doc_id, k) AS r FROM pairs WHERE run IS NOT NULL) WHERE r > 1),
long AS (SELECT id, k FROM (SELECT id, k, rank() OVER (PARTITION BY line ORDER BY doc_id, k) AS r FROM lines WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50) WHERE r > 1),
gone AS (SELECT DISTINCT id, place, 1 AS hit FROM lines JOIN (SELECT id, k FROM later UNION SELECT id, k + 1 FROM later UNION SELECT id, k FROM long) USING (id, k)),
marked AS (SELECT id, place, line, coalesce(hit, 0) AS hit, CASE WHEN hit = 1 AND coalesce(lag(hit) OVER (PARTITION BY id ORDER BY place), 0) = 0 THEN 1 ELSE 0 END AS starts FROM parts LEFT JOIN gone USING (id, place)),
summed AS (SELECT id, count(*) AS n_lines, CAST(sum(hit) AS BIGINT) AS n_deleted, CAST(sum(starts) AS BIGINT) AS n_runs, string_agg(line, chr(10) ORDER BY place) FILTER (WHERE hit = 0) AS kept FROM marked GROUP BY id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN summed USING (id)
"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
dw AS (SELECT id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
iw AS (SELECT item, w, least(len(w), 13) AS m FROM (SELECT item, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM items) WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item, m, unnest(list_transform(range(1, len(w) - m + 2), lambda p: array_to_string(w[p:p + m - 1], ' '))) AS win FROM iw),
wins AS (SELECT id, m, list_transform(range(1, len(w) - m + 2), lambda p: array_to_string(w[p:p + m - 1], ' ')) AS l FROM dw, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m),
dwin AS (SELECT id, m, unnest(l) AS win, generate_subscripts(l, 1) AS pos FROM wins),
found AS (SELECT id, pos, m, item FROM dwin JOIN iwin USING (m, win)),
hits AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT id, unnest(range(pos, pos + m)) AS place FROM (SELECT DISTINCT id, pos, m FROM found)) GROUP BY id),
named AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY id),
counts AS (SELECT id, len(w) AS n_words FROM dw)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) AS contaminated
FROM docs LEFT JOIN counts USING (id) LEFT JOIN hits USING (id) LEFT JOIN named USING (id)
"""


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), zipf_scores(pieces_of(vocabulary(PIECES))))


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(read(spark, sf_dir, "documents"), vocabulary(WORD_BPE), with_ids=False)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents")).drop("kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restored(fill_in_middle(read(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM docs
), placed AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS p, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS m FROM cut),
parts AS (
  SELECT doc_id, text, n, array_to_string(w[1:p], '') AS pre, array_to_string(w[p + 1:m], '') AS mid, array_to_string(w[m + 1:], '') AS suf,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT id, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
each_ AS (SELECT id, unnest(w) AS word FROM words),
wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), tab AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
), bytes AS (
  SELECT word, list_transform(range(CAST(length(hex(encode(word))) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS b
  FROM (SELECT word FROM each_ UNION SELECT word FROM wanted)
), hashed AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab
), sums AS (
  SELECT bucket, CAST(sum(s) AS BIGINT) AS s, CAST(sum(t) AS BIGINT) AS t FROM (
    SELECT bucket, 1 AS s, 0 AS t FROM each_ JOIN hashed USING (word) UNION ALL SELECT bucket, 0, 1 FROM wanted JOIN hashed USING (word)
  ) GROUP BY bucket
), whole AS (SELECT CAST(coalesce(sum(s), 0) AS BIGINT) AS all_s, CAST(coalesce(sum(t), 0) AS BIGINT) AS all_t FROM sums),
gains AS (
  SELECT bucket, CAST(floor(1000.0::DOUBLE * ln(CAST((t + 1) * (all_s + 10000) AS DOUBLE) / CAST((s + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM sums, whole
), weights AS (
  SELECT id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM each_ JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (id)
), placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


_QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_chat_formatting,
    op2_quality_rules,
    op3_ngram_jaccard_join,
    op4_pii,
    op5_line_dedup,
    op6_benchmark_decontamination,
    op7_quality_classifier,
    op8_token_counts,
    op9_bpe_encoding,
    op10_suffix_array_dedup,
    op11_fill_in_middle,
    op12_importance_resampling,
    op13_packing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": OP1_SQL,
        "op2_quality_rules": OP2_SQL,
        "op5_line_dedup": OP5_SQL,
        "op6_benchmark_decontamination": OP6_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op12_importance_resampling": OP12_SQL,
    }
