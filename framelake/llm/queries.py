"""The queries of the text operators and their SQL, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import bpe, decontaminate, minhash, phrases, quality, repair, secrets, sharding, substring_dedup, suffix_dedup, token_output, toxicity, vectors
from framelake.llm.common import shared_dir, small_batches


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), shards=40)


def secret_columns(docs: DataFrame) -> DataFrame:
    """The contract's columns of `secrets.scan`."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return secrets.scan(docs).select("doc_id", *map(count, secrets.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_columns(documents(spark, sf_dir))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary())


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/framelake/{uuid.uuid4().hex}/token_files"
    token_output.write_tokens(documents(spark, sf_dir), vocabulary(), folder)
    return token_output.read_tokens(spark, folder)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_filter(documents(spark, sf_dir))


def op7_common_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules with a limit that small tables reach: lines that two documents of a host share."""
    return quality.quality_filter(documents(spark, sf_dir), min_docs=2, min_share=0.0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return repair.repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_secret_scan": op2_secret_scan,
    "op3_bpe_encode_decode": op3_bpe_encode_decode,
    "op9_token_id_output": op9_token_id_output,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op7_common_lines": op7_common_lines,
    "op8_toxicity": op8_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_vector_near_dedup": op13_vector_near_dedup,
}

WORDS = r"words AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS ws FROM documents)"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op6_minhash_near_dedup": f"""
WITH RECURSIVE {WORDS.format(text=LOWER)},
 sets AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(list_slice(ws, i, i + 4), ' ') ELSE array_to_string(ws, ' ') END AS shingle
  FROM words, generate_series(1, greatest(len(ws) - 4, 1)) s(i) WHERE len(ws) > 0),
 sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
 shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
 reach AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT CASE WHEN v = a THEN b ELSE a END, c FROM reach JOIN links ON v = a OR v = b),
 components AS (SELECT v, min(c) AS component_id FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN components ON v = d.doc_id""",
    "op7_quality_rules": rf"""
WITH {WORDS.format(text="coalesce(text, '')")},
 lines AS (SELECT doc_id, coalesce(source, '') AS host, text, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]'))) AS line FROM words),
 keyed AS (SELECT *, trim(regexp_replace(lower(line), '[ 	-
]+', ' ', 'g')) AS norm FROM lines),
 hosts AS (SELECT coalesce(source, '') AS host, count(DISTINCT doc_id) AS in_host FROM words GROUP BY 1),
 often AS (SELECT k.host, norm FROM keyed k JOIN hosts h ON h.host = k.host GROUP BY k.host, norm HAVING count(DISTINCT doc_id) >= 20 AND count(DISTINCT doc_id) >= 0.002 * any_value(in_host)),
 lost AS (SELECT doc_id, sum(length(line)) AS in_lines, sum(CASE WHEN o.norm IS NOT NULL THEN length(line) ELSE 0 END) AS n_common_chars, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM keyed k LEFT JOIN often o ON o.host = k.host AND o.norm = k.norm GROUP BY doc_id),
 grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM words, generate_series(1, len(ws) - 2) s(i)),
 repeats AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM grams, range(3) r(j) WHERE n > 1 GROUP BY doc_id),
 facts AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_common_chars, 0)::BIGINT AS n_common_chars, coalesce(in_lines, 0) AS in_lines
  FROM words w LEFT JOIN lost l ON l.doc_id = w.doc_id LEFT JOIN repeats r ON r.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_common_chars,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_common_chars <= 0.5 * in_lines AS kept FROM facts""",
    "op10_substring_dedup": f"""
WITH {WORDS.format(text="coalesce(text, '')")},
 windows AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(list_slice(ws, i, i + 19), ' ') ORDER BY doc_id, i) AS turn FROM words, generate_series(1, len(ws) - 19) s(i)),
 gone AS (SELECT DISTINCT doc_id, i + j AS p FROM windows, range(20) r(j) WHERE turn > 1),
 placed AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM words),
 kept AS (SELECT a.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY a.p) AS rest FROM placed a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.p GROUP BY a.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id""",
    "op12_phrase_mining": rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
 counts AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM words, generate_series(1, 5) s(k), generate_series(1, len(ws) - k + 1) t(i) GROUP BY ALL),
 totals AS (SELECT lang, sum(f)::HUGEINT AS n FROM counts WHERE k = 1 GROUP BY lang),
 found AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE k > 1 AND f >= 100),
 cuts AS (SELECT c.lang, c.phrase, c.k, c.a, j, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS score FROM found c JOIN generate_series(1, 4) s(j) ON j < c.k
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(ws, 1, j), ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(ws, j + 1, c.k), ' ') JOIN totals n ON n.lang = c.lang),
 best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS turn FROM cuts),
 left_over AS (SELECT * FROM best b WHERE turn = 1 AND NOT EXISTS (SELECT 1 FROM found d WHERE d.lang = b.lang AND d.k > b.k AND contains(' ' || d.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * d.a >= 100 * b.a)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
}
ORACLE_SQL["op7_common_lines"] = ORACLE_SQL["op7_quality_rules"].replace("count(DISTINCT doc_id) >= 20 AND count(DISTINCT doc_id) >= 0.002 * any_value(in_host)", "count(DISTINCT doc_id) >= 2")
