"""Queries on label text and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import review
from ..sources.carriers import carrier, duck

CATEGORIES = ["server rack", "network switch", "chair", "glass door", "monitor", "window"]


def clean_label(spark: SparkSession, sf: str) -> DataFrame:
    return carrier(spark, sf, "raw_labels").select("item_id", L.clean_label(F.col("raw_label")).alias("label"))


def canonical_label(spark: SparkSession, sf: str) -> DataFrame:
    return carrier(spark, sf, "raw_labels").select("item_id", L.canonical_label(F.col("raw_label")).alias("label"))


def label_flags(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("raw_label")
    return carrier(spark, sf, "raw_labels").select(
        "item_id", L.has_word(label, L.REFLECTORS).alias("reflector"), L.has_word(label, L.PLANAR).alias("planar"), L.has_word(label, L.FLOOR_STANDING).alias("floor_standing"),
        L.has_word(label, L.OPENINGS, whole=False).alias("opening"), L.is_planar_category(label).alias("planar_category"),
    )


def snap_label(spark: SparkSession, sf: str) -> DataFrame:
    return carrier(spark, sf, "raw_labels").select("item_id", L.snap_label(L.clean_label(F.col("raw_label")), CATEGORIES).alias("label"))


def prompt_categories(spark: SparkSession, sf: str) -> DataFrame:
    prompt = F.concat_ws(" . ", F.col("p_type"), F.col("p_name"), F.upper("p_type"), F.lit(" , "), F.col("p_brand"))
    parts = L.prompt_categories(prompt)
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("item_id"), F.concat_ws(" . ", parts).alias("prompt"), F.size(parts).cast("long").alias("n"))


def suggest_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = carrier(spark, sf, "raw_labels").select(
        F.expr("item_id div 50").alias("batch"), F.col("item_id").alias("ord"), F.col("raw_label").alias("label"),
        ((F.col("item_id") * 37 % 130) / F.lit(100.0)).alias("confidence"), (F.col("item_id") % 4).alias("frames_seen"), (F.col("item_id") % 7 != 0).alias("major"),
    )
    return review.suggest_labels(rows, 5)


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    return carrier(spark, sf, "raw_labels").select(
        F.expr("item_id div 2").alias("inst_id"), F.col("item_id").alias("ord"), F.expr("CASE item_id % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' WHEN 4 THEN 'other' ELSE 'relabel' END").alias("action"),
        F.col("raw_label").alias("new_label"), ((F.col("item_id") * 13 % 100) / F.lit(100.0)).alias("confidence"),
    )


def review_apply(spark: SparkSession, sf: str) -> DataFrame:
    return review.apply_decisions(carrier(spark, sf, "placed").select("inst_id", "label"), _decisions(spark, sf))


def review_propagate(spark: SparkSession, sf: str) -> DataFrame:
    obs = carrier(spark, sf, "observations").select("obs_id", "inst_id", "label")
    return review.propagate_labels(obs, review_apply(spark, sf))


def review_batches(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_batches(carrier(spark, sf, "placed").withColumn("scene", F.expr("scene div 5")))


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


CLEAN = """(SELECT item_id, CASE WHEN len(s) <= 60 AND regexp_matches(s, '[a-z0-9]') THEN s END AS s, raw_label FROM
  (SELECT item_id, raw_label, trim(trim(regexp_replace(lower(raw_label), '\\s+', ' ', 'g')), ' .,:;-/') AS s FROM raw_labels))"""
CANON = "CASE " + " ".join(f"WHEN {{0}} = '{a}' THEN '{b}'" for a, b in {**L.SYNONYMS, **{c: c for c in L.CANONICAL}}.items()) + " END"
_REVIEWED = f"""c AS (SELECT item_id, s FROM {CLEAN}),
d AS (SELECT item_id // 2 AS inst_id, item_id AS ord, CASE item_id % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' WHEN 4 THEN 'other' ELSE 'relabel' END AS action,
  coalesce({CANON.format('s')}, s) AS new_label, (item_id * 13 % 100) / 100.0 AS confidence FROM c),
f AS (SELECT * FROM d WHERE action IN ('keep', 'reject') OR (action = 'relabel' AND new_label IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY inst_id ORDER BY ord) = 1),
s AS (SELECT p.inst_id, p.label, f.new_label, CASE WHEN action = 'reject' AND confidence >= 0.85 THEN 'rejected' WHEN action = 'relabel' AND confidence >= 0.70 AND new_label <> p.label THEN 'relabelled' ELSE 'kept' END AS status
  FROM placed p LEFT JOIN f ON p.inst_id = f.inst_id),
reviewed AS (SELECT inst_id, label AS original_label, CASE WHEN status = 'relabelled' THEN new_label ELSE label END AS label, status FROM s)"""
_WORDS = "string_split_regex(replace(lower(raw_label), '-', ' '), '\\s+')"

QUERIES = {
    "clean_label": clean_label, "canonical_label": canonical_label, "label_flags": label_flags, "snap_label": snap_label, "prompt_categories": prompt_categories,
    "suggest_labels": suggest_labels, "review_apply": review_apply, "review_propagate": review_propagate, "review_batches": review_batches,
}
ORACLES = {
    "clean_label": duck("raw_labels", f"SELECT item_id, s AS label FROM {CLEAN}"),
    "canonical_label": duck("raw_labels", f"SELECT item_id, {CANON.format('s')} AS label FROM {CLEAN}"),
    "label_flags": duck("raw_labels", f"""SELECT item_id, list_has_any({_WORDS}, {_list(L.REFLECTORS)}) OR list_contains({_list(L.REFLECTORS)}, trim(lower(raw_label))) AS reflector,
  list_has_any({_WORDS}, {_list(L.PLANAR)}) OR list_contains({_list(L.PLANAR)}, trim(lower(raw_label))) AS planar,
  list_has_any({_WORDS}, {_list(L.FLOOR_STANDING)}) OR list_contains({_list(L.FLOOR_STANDING)}, trim(lower(raw_label))) AS floor_standing,
  list_has_any({_WORDS}, {_list(L.OPENINGS)}) AS opening, {' OR '.join(f"contains(lower(raw_label), '{t}')" for t in L.PLANAR_TERMS)} AS planar_category FROM raw_labels"""),
    "snap_label": duck("raw_labels", f"""c AS (SELECT item_id, s, list_distinct(string_split(s, ' ')) AS w FROM {CLEAN}),
k AS (SELECT k, cat, string_split(cat, ' ') AS cw FROM (SELECT unnest({_list(tuple(CATEGORIES))}) AS cat, generate_subscripts({_list(tuple(CATEGORIES))}, 1) AS k)),
m AS (SELECT item_id, k, cat, len(list_intersect(w, cw)) / len(cw) + len(list_intersect(w, cw)) / greatest(len(w), 1) + CASE WHEN contains(cat, s) OR contains(s, cat) THEN 1 ELSE 0 END AS score FROM c, k WHERE len(list_intersect(w, cw)) > 0),
b AS (SELECT item_id, cat FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, k) = 1)
SELECT c.item_id, CASE WHEN list_contains({_list(tuple(CATEGORIES))}, c.s) THEN c.s ELSE b.cat END AS label FROM c LEFT JOIN b ON c.item_id = b.item_id"""),
    "prompt_categories": """WITH p AS (SELECT p_partkey AS item_id, list_filter(list_transform(string_split_regex(lower(concat_ws(' . ', p_type, p_name, upper(p_type), ' , ', p_brand)), '[.,]'), lambda x: trim(x)), lambda x: x <> '') AS w FROM part),
f AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM p)
SELECT item_id, array_to_string(w, ' . ') AS prompt, CAST(len(w) AS BIGINT) AS n FROM f""",
    "suggest_labels": duck("raw_labels", f"""r AS (SELECT item_id // 50 AS batch, item_id AS ord, {CANON.format('s')} AS label, least((item_id * 37 % 130) / 100.0::DOUBLE, 1.0) AS confidence, item_id % 4 AS frames_seen FROM {CLEAN} WHERE item_id % 7 <> 0),
g AS (SELECT * FROM r WHERE label IS NOT NULL AND confidence >= 0.65 AND (frames_seen >= 2 OR confidence >= 0.85 OR label IN ('door', 'window'))),
o AS (SELECT batch, label, min(ord) AS first FROM g GROUP BY ALL),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY batch, label ORDER BY confidence DESC, frames_seen DESC) = 1)
SELECT batch, label, confidence, frames_seen, row_number() OVER (PARTITION BY batch ORDER BY confidence DESC, frames_seen DESC, first) AS place FROM b JOIN o USING (batch, label) QUALIFY place <= 10"""),
    "review_apply": duck("raw_labels placed", f"{_REVIEWED} SELECT * FROM reviewed"),
    "review_propagate": duck("raw_labels placed observations", f"{_REVIEWED} SELECT obs_id, o.inst_id, r.label FROM observations o JOIN reviewed r ON o.inst_id = r.inst_id WHERE r.status <> 'rejected'"),
    "review_batches": duck("placed", "SELECT scene // 5 AS scene, inst_id, (row_number() OVER (PARTITION BY scene // 5 ORDER BY frames_seen DESC, score DESC, inst_id) - 1) // 12 AS batch FROM placed QUALIFY row_number() OVER (PARTITION BY scene // 5 ORDER BY frames_seen DESC, score DESC, inst_id) <= 24"),
}
