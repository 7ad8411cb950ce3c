"""Scene-like tables derived from the driver's star schema by exact integer arithmetic.

No scans exist among the test tables, so each reference operator runs over tables of the same shape
computed from whole input tables. One text serves both engines: ``DIV`` is integer division.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_CANONICAL = "'server rack', 'cabinet', 'table', 'chair', 'monitor', 'whiteboard', 'shelf', 'printer', 'sofa', 'door', 'window', 'network switch', 'patch panel', 'cable tray'"


def _pick(index: str, words: str) -> str:
    return "CASE " + index + "".join(f" WHEN {k} THEN {w.strip()}" for k, w in enumerate(words.split(","))) + " END"


#: name -> (input tables, SQL)
CARRIERS: dict[str, tuple[tuple[str, ...], str]] = {
    # a frame holds the line items of 16 orders, so frames grow with the data and stay small
    "detections": (("lineitem",), f"""
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS det_id, CAST(l_orderkey DIV 16 AS BIGINT) AS frame,
  {_pick('(l_partkey % 14)', _CANONICAL)} AS label, CAST((30 + (l_suppkey * 7 + l_partkey) % 70) AS DOUBLE) / CAST(100 AS DOUBLE) AS score,
  CAST((l_partkey * 13) % 300 AS DOUBLE) AS x1, CAST((l_suppkey * 29) % 200 AS DOUBLE) AS y1,
  CAST((l_partkey * 13) % 300 + 120 + l_quantity AS DOUBLE) AS x2, CAST((l_suppkey * 29) % 200 + 120 + l_linenumber * 5 AS DOUBLE) AS y2
FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity
      FROM lineitem GROUP BY l_orderkey, l_linenumber) u"""),
    # observed points on a millimetre lattice: an object for 10 customers, a scene for 40 objects
    "points": (("orders",), """
SELECT CAST(o_orderkey AS BIGINT) AS pid, CAST(o_custkey DIV 400 AS BIGINT) AS scene, CAST(o_custkey DIV 10 AS BIGINT) AS obj_id, CAST(o_orderkey % 12 AS BIGINT) AS frame,
  CAST(((o_custkey DIV 10) % 8) * 1500 + (o_orderkey * 37) % 601 AS DOUBLE) / CAST(1000 AS DOUBLE) AS x,
  CAST((o_orderkey * 53) % 2001 AS DOUBLE) / CAST(1000 AS DOUBLE) AS y,
  CAST((((o_custkey DIV 10) DIV 8) % 5) * 1500 + (o_orderkey * 71) % 501 AS DOUBLE) / CAST(1000 AS DOUBLE) AS z,
  CAST(o_orderkey * 11 % 256 AS BIGINT) AS r, CAST(o_orderkey * 17 % 256 AS BIGINT) AS g, CAST(o_orderkey * 23 % 256 AS BIGINT) AS b
FROM orders"""),
    # frames of 25 x 20 depth pixels
    "pixels": (("part",), """
SELECT CAST(p_partkey DIV 500 AS BIGINT) AS frame, CAST(p_partkey % 25 AS BIGINT) AS u, CAST((p_partkey DIV 25) % 20 AS BIGINT) AS v,
  CAST(500 + (p_partkey * 97) % 2500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS depth, CAST(100 + (p_partkey * 31) % 900 AS DOUBLE) / CAST(100 AS DOUBLE) AS conf,
  CAST(p_partkey * 7 % 256 AS BIGINT) AS r, CAST(p_partkey * 13 % 256 AS BIGINT) AS g, CAST(p_partkey * 29 % 256 AS BIGINT) AS b
FROM part"""),
    # a camera a frame, rotated about +Y by a rational angle (3-4-5, 5-12-13, 8-15-17 triangles)
    "cameras": (("part",), """
SELECT frame, c AS r00, CAST(0 AS DOUBLE) AS r01, s AS r02, CAST(0 AS DOUBLE) AS r10, CAST(1 AS DOUBLE) AS r11, CAST(0 AS DOUBLE) AS r12, -s AS r20, CAST(0 AS DOUBLE) AS r21, c AS r22,
  CAST(frame % 5 AS DOUBLE) / CAST(10 AS DOUBLE) AS t0, CAST(frame % 3 AS DOUBLE) / CAST(10 AS DOUBLE) AS t1, CAST(1 + frame % 4 AS DOUBLE) AS t2,
  CAST(20 AS DOUBLE) AS fx, CAST(20 AS DOUBLE) AS fy, CAST(12 AS DOUBLE) AS cx, CAST(10 AS DOUBLE) AS cy
FROM (SELECT CAST(f AS BIGINT) AS frame,
        CASE f % 4 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(4 AS DOUBLE) / CAST(5 AS DOUBLE) WHEN 2 THEN CAST(12 AS DOUBLE) / CAST(13 AS DOUBLE) ELSE CAST(15 AS DOUBLE) / CAST(17 AS DOUBLE) END AS c,
        CASE f % 4 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(3 AS DOUBLE) / CAST(5 AS DOUBLE) WHEN 2 THEN CAST(5 AS DOUBLE) / CAST(13 AS DOUBLE) ELSE CAST(8 AS DOUBLE) / CAST(17 AS DOUBLE) END AS s
      FROM (SELECT DISTINCT p_partkey DIV 500 AS f FROM part) q) w"""),
    "raw_labels": (("part",), """
SELECT CAST(p_partkey AS BIGINT) AS item_id,
  concat(CASE p_partkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN '. ' ELSE '' END,
    CASE p_partkey % 11 WHEN 0 THEN 'Office   Chair' WHEN 1 THEN 'desk' WHEN 2 THEN 'TV' WHEN 3 THEN 'Server Rack' WHEN 4 THEN 'glass-door'
      WHEN 5 THEN p_name WHEN 6 THEN '---' WHEN 7 THEN 'Computer Screen,' WHEN 8 THEN 'rack monitor' WHEN 9 THEN 'glass door' ELSE 'Window' END,
    CASE p_partkey % 2 WHEN 0 THEN ' ;' ELSE '' END) AS raw_label
FROM part"""),
    # observations of instances: 1 to 7 line items of an order, as frames
    "observations": (("lineitem",), f"""
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS obs_id, CAST(l_orderkey AS BIGINT) AS inst_id, CAST(l_linenumber AS BIGINT) AS ord, CAST(l_suppkey % 6 AS BIGINT) AS frame,
  {_pick('(l_partkey % 3)', "'monitor', 'table', 'chair'")} AS label, CAST(20 + l_partkey % 80 AS DOUBLE) / CAST(100 AS DOUBLE) AS score, CAST(30 + l_quantity AS BIGINT) AS n_raw
FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) u"""),
    # placed objects of scenes of 20
    "placed": (("part",), f"""
SELECT CAST(p_partkey DIV 20 AS BIGINT) AS scene, CAST(p_partkey AS BIGINT) AS inst_id, {_pick('(p_partkey % 4)', "'server rack', 'table', 'chair', 'monitor'")} AS label,
  CAST((p_partkey * 7) % 4000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS px, CAST(0 AS DOUBLE) AS py, CAST((p_partkey * 11) % 3000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS pz,
  CAST(500 + p_size * 10 AS DOUBLE) / CAST(1000 AS DOUBLE) AS w, CAST(700 + (p_partkey * 3) % 1500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS h, CAST(400 + p_size * 7 AS DOUBLE) / CAST(1000 AS DOUBLE) AS d,
  CAST(1 + p_partkey % 5 AS BIGINT) AS frames_seen, CAST(30 + p_partkey % 70 AS DOUBLE) / CAST(100 AS DOUBLE) AS score, CAST(p_size * 37 AS BIGINT) AS n_points
FROM part"""),
    # occupied cells of 16 x 10 masks
    "mask_cells": (("orders",), """
SELECT DISTINCT CAST(o_custkey DIV 20 AS BIGINT) AS mask_id, CAST((o_orderkey * 3) % 10 AS BIGINT) AS iy, CAST((o_orderkey * 7 + o_custkey) % 16 AS BIGINT) AS ix FROM orders"""),
    "job_events": (("events",), """
SELECT event_id, ts, user_id AS job_id,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'complete' ELSE 'cancel' END AS state,
  CAST(event_id % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS frac
FROM events"""),
    "frames_sharp": (("events",), "SELECT CAST(user_id % 10 AS BIGINT) AS video, CAST(row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS BIGINT) AS frame_idx, value AS sharpness FROM events"),
    # editor state: scene objects and an update stream
    "scene_objects": (("supplier",), """
SELECT CAST(s_suppkey DIV 10 AS BIGINT) AS scene, CAST(s_suppkey AS BIGINT) AS obj_id, 'chair' AS label, CAST(s_suppkey AS DOUBLE) / CAST(10 AS DOUBLE) AS px, CAST(0 AS DOUBLE) AS py, CAST(s_nationkey AS DOUBLE) AS pz,
  CAST(0 AS DOUBLE) AS yaw, CASE WHEN s_suppkey % 3 = 0 THEN CAST(2 AS DOUBLE) END AS editor_scale, concat('objects/', CAST(s_suppkey DIV 2 AS VARCHAR(20)), '.glb') AS glb
FROM supplier"""),
    "layout_updates": (("customer", "supplier"), """
SELECT CAST(c_custkey AS BIGINT) AS ord, CAST(c_custkey % (SELECT count(*) + 7 FROM supplier) AS BIGINT) AS obj_id, CASE c_custkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'sofa' END AS label,
  CAST(c_nationkey AS DOUBLE) / CAST(3 AS DOUBLE) AS px, CAST(c_custkey % 17 AS DOUBLE) / CAST(7 AS DOUBLE) AS py, CAST(c_custkey % 19 AS DOUBLE) / CAST(9 AS DOUBLE) AS pz,
  CAST(c_custkey % 360 AS DOUBLE) / CAST(57 AS DOUBLE) AS yaw, CASE WHEN c_custkey % 5 = 0 THEN CAST(1 + c_custkey % 3 AS DOUBLE) END AS editor_scale
FROM customer"""),
}


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = CARRIERS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    text = text.replace("DIV", "div")
    for t in tables:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"FROM {t})", f"FROM {{{t}}})")
        text = text[: -len(t)] + f"{{{t}}}" if text.endswith(f"FROM {t}") else text
    return spark.sql(text, **frames)


def unsigned_zeros(sql: str) -> str:
    """The SQL with 0 added to every rounded value: Spark rounds a small negative number to 0, DuckDB to -0."""
    out, at = [], 0
    for m in re.finditer(r"(?<![a-z_])round\(", sql):
        if m.start() < at:
            raise ValueError("nested rounding")
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at : m.start()], f"({sql[m.start():end]} + 0)"]
        at = end
    return "".join(out) + sql[at:]


def duck(names: str, body: str) -> str:
    """DuckDB SQL: the carriers named (blank-separated) as CTEs, then the body, which starts with its own CTEs ("x AS (...)," or none) or SELECT."""
    ctes = ",\n".join(f"{n} AS ({CARRIERS[n][1].replace('DIV', '//')})" for n in names.split())
    body = unsigned_zeros(body.strip())
    return f"WITH RECURSIVE {ctes}\n{body}" if body.upper().startswith("SELECT") else f"WITH RECURSIVE {ctes},\n{body}"
