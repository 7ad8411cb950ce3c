"""The queries op1_ to op10_ over whole tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, language_crf, line_rules, lm_scoring, mixing, near_dedup, packing, quality_cnn, sharding

SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_pack_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_shard_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.shard_documents(_table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return made.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_lm_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1")
    docs = lm_scoring.mark_targets(_table(spark, sf_dir, "documents").select("doc_id", "text"), good)
    return lm_scoring.corpus_cross_entropy_difference(docs)


def op4_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = language_crf.training_rows(docs)
    return language_crf.predict_language(docs, language_crf.fit([t for t, _ in rows], [g for _, g in rows]))


def op5_mix_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # the replicated texts go through the shuffle; their length is taken after it
    return mixing.poisson_mix(docs, seed=17).select(
        "doc_id", "source", F.col("copy").cast("long").alias("copy"), F.length("text").cast("long").alias("chars"), F.round("rate", 9).alias("rate"), "shuffle_key"
    )


def op6_minhash_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op7_exact_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_quality_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_cnn.score_quality(docs, quality_model(spark, docs, sf_dir))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_cnn.ByteCnn:
    rows = quality_cnn.training_rows(docs, _table(spark, sf_dir, "labels"))
    return quality_cnn.fit([t for t, _ in rows], [y for _, y in rows])


def op9_chat_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(own)))


def op10_quality_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_first_report(_table(spark, sf_dir, "documents"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

OP5_SQL = """
WITH s AS (SELECT source, CAST(sum(len(coalesce(text, '')) + 1) AS DOUBLE) AS size FROM documents GROUP BY source),
r AS (SELECT source, sum(size) OVER () * sqrt(size) / sum(sqrt(size)) OVER () / size AS rate FROM s),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM r),
c AS (SELECT source, rate, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT doc_id, source, CAST(len(text) AS BIGINT) AS chars, (CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT doc_id, u.source, chars, rate, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY ALL)
SELECT doc_id, source, copy, chars, round(rate, 9) AS rate, md5('17:' || doc_id || ':' || copy || ':order') AS shuffle_key
FROM (SELECT *, unnest(range(0, n)) AS copy FROM n)"""

#: crc32 by its rule: the 256 remainders, then one step a byte.
OP2_SQL = f"""
WITH t0 AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
     lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(0, 256) r(b))),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, strlen(d.t) + 16 AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(d.t)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
     lambda c, b: xor(c >> 8, t0.t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM d, t0),
p AS (SELECT doc_id, s, -ln((CAST('0x' || substr(md5(doc_id || ':' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS cost FROM documents, range(0, {SHARDS + 1}) r(s)),
w AS (SELECT doc_id, arg_min(s, cost) FILTER (WHERE s < {SHARDS}) AS shard, arg_min(s, cost) AS grown FROM p GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM c JOIN w USING (doc_id)"""

OP6_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n m ON p.a = m.doc_id JOIN n k ON p.b = k.doc_id WHERE 100 * c >= 80 * (m.n + k.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (WITH RECURSIVE r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON r.doc_id = u.a AND r.root < u.b) SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, root = doc_id AS kept FROM r LEFT JOIN n USING (doc_id)"""

_ESCAPED = "replace(replace(replace({x}, '\\', '\\\\'), '#', '\\h'), '<', '\\l')"
OP9_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
c AS (SELECT *, sum(len({_ESCAPED.format(x='text')}) + len(replace({_ESCAPED.format(x='role')}, ':', '\\c')) + 14) OVER w AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS final FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (WHERE role = 'assistant' OR final) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_min_bin_slack": op1_pack_min_bin_slack,
    "op2_shard_rendezvous": op2_shard_rendezvous,
    "op3_lm_cross_entropy_difference": op3_lm_cross_entropy_difference,
    "op4_langid_crf": op4_langid_crf,
    "op5_mix_poisson": op5_mix_poisson,
    "op6_minhash_hamming_join": op6_minhash_hamming_join,
    "op7_exact_content_sort": op7_exact_content_sort,
    "op8_quality_byte_cnn": op8_quality_byte_cnn,
    "op9_chat_prefix_target": op9_chat_prefix_target,
    "op10_quality_line_first": op10_quality_line_first,
}
ORACLES: dict[str, str] = {
    "op2_shard_rendezvous": OP2_SQL,
    "op5_mix_poisson": OP5_SQL,
    "op6_minhash_hamming_join": OP6_SQL,
    "op7_exact_content_sort": OP7_SQL,
    "op9_chat_prefix_target": OP9_SQL,
    "op10_quality_line_first": line_rules.report_sql(),
}
