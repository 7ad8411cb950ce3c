"""Binary glTF 2.0 models as tables of vertices and faces, and back."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the format: magic, chunk types, component types, components of an element, triangles.
MAGIC, JSON_CHUNK, BIN_CHUNK, TRIANGLES = 0x46546C67, 0x4E4F534A, 0x004E4942, 4
COMPONENTS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}


def _chunks(content: bytes) -> tuple[dict, bytes]:
    magic, version, length = struct.unpack_from("<III", content)
    if magic != MAGIC or version != 2 or length > len(content):
        raise ValueError("not a binary glTF 2.0 file")
    spec, blob, at = None, b"", 12
    while at + 8 <= length:
        size, kind = struct.unpack_from("<II", content, at)
        body = content[at + 8 : at + 8 + size]
        if kind == JSON_CHUNK and spec is None:
            spec = json.loads(body)
        elif kind == BIN_CHUNK and not blob:
            blob = body
        at += 8 + size
    return spec, blob


def _accessor(spec: dict, blob: bytes, index: int) -> np.ndarray:
    a = spec["accessors"][index]
    view = spec["bufferViews"][a["bufferView"]]
    kind, width, count = np.dtype(COMPONENTS[a["componentType"]]), WIDTH[a["type"]], a["count"]
    start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    stride = view.get("byteStride", kind.itemsize * width)
    if count and start + stride * (count - 1) + kind.itemsize * width > len(blob):
        raise ValueError("an accessor reaches beyond the file")
    return np.ndarray((count, width), kind, blob, start, (stride, kind.itemsize)).copy()


def _local(node: dict) -> np.ndarray:
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4).T
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    turn = np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])
    out = np.eye(4)
    out[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)), float)
    out[:3, 3] = node.get("translation", (0, 0, 0))
    return out


def parse(content: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(vertices n x 3, faces m x 3) of all triangles of the default scene, in its frame; None if it can't be read or has no faces."""
    try:
        spec, blob = _chunks(bytes(content))
        nodes = spec.get("nodes", [])
        scenes = spec.get("scenes", [])
        roots = scenes[spec.get("scene", 0)].get("nodes", []) if scenes else range(len(nodes))
        points, faces, n = [], [], 0
        open_ = [(k, np.eye(4), 0) for k in roots]
        while open_:
            k, outer, depth = open_.pop()
            if depth > len(nodes):
                raise ValueError("nodes in a circle")
            matrix = outer @ _local(nodes[k])
            open_ += [(c, matrix, depth + 1) for c in nodes[k].get("children", [])]
            for part in spec["meshes"][nodes[k]["mesh"]]["primitives"] if "mesh" in nodes[k] else ():
                if part.get("mode", TRIANGLES) != TRIANGLES:
                    continue
                p = _accessor(spec, blob, part["attributes"]["POSITION"]).astype(float)
                order = _accessor(spec, blob, part["indices"]).ravel().astype(np.int64) if "indices" in part else np.arange(len(p))
                order = order[: len(order) // 3 * 3].reshape(-1, 3)
                if len(order) and order.max() >= len(p):
                    raise ValueError("a face without its vertex")
                points.append(p @ matrix[:3, :3].T + matrix[:3, 3])
                faces.append(order + n)
                n += len(p)
        if not sum(map(len, faces)):
            return None
        return np.concatenate(points), np.concatenate(faces)
    except (ValueError, KeyError, IndexError, TypeError, struct.error):
        return None


def build(vertices: np.ndarray, faces: np.ndarray, colors: np.ndarray | None = None) -> bytes:
    """A model of one mesh; ``colors``: a row of r, g, b, a from 0 to 255 a vertex."""
    parts = [(np.asarray(faces, "<u4").reshape(-1, 1), 5125, "SCALAR", 34963), (np.asarray(vertices, "<f4").reshape(-1, 3), 5126, "VEC3", 34962)]
    if colors is not None:
        parts.append((np.asarray(colors, "<u1").reshape(-1, 4), 5121, "VEC4", 34962))
    blob, views, accessors = b"", [], []
    for data, kind, shape, target in parts:
        views.append({"buffer": 0, "byteOffset": len(blob), "byteLength": data.nbytes, "target": target})
        accessors.append({"bufferView": len(views) - 1, "componentType": kind, "count": len(data), "type": shape})
        blob += data.tobytes()
        blob += b"\0" * (-len(blob) % 4)
    accessors[1] |= {"min": parts[1][0].min(0).astype(float).tolist(), "max": parts[1][0].max(0).astype(float).tolist()}
    if colors is not None:
        accessors[2]["normalized"] = True
    attributes = {"POSITION": 1} | ({"COLOR_0": 2} if colors is not None else {})
    spec = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "buffers": [{"byteLength": len(blob)}], "bufferViews": views,
        "accessors": accessors, "meshes": [{"primitives": [{"attributes": attributes, "indices": 0}]}],
    }
    text = json.dumps(spec, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    body = struct.pack("<II", len(text), JSON_CHUNK) + text + struct.pack("<II", len(blob), BIN_CHUNK) + blob
    return struct.pack("<III", MAGIC, 2, 12 + len(body)) + body


def _rows(files: DataFrame, names: list[str], schema: str, pick: Callable[[tuple[np.ndarray, np.ndarray]], np.ndarray]) -> DataFrame:
    kind = dict(files.dtypes)["mesh_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for mesh, content in zip(f["mesh_id"], f["content"]):
                found = parse(content) if content is not None else None
                if found is not None:
                    rows = pick(found)
                    yield pd.DataFrame({"mesh_id": [mesh] * len(rows), names[0]: np.arange(len(rows)), **{n: rows[:, k] for k, n in enumerate(names[1:])}})

    return files.select("mesh_id", "content").mapInPandas(run, f"mesh_id {kind}, {schema}")


def model_vertices(files: DataFrame) -> DataFrame:
    """(mesh_id, vid, x, y, z) of models (mesh_id, content); a file is the unit of work. Models that can't be read give no rows."""
    return _rows(files, ["vid", "x", "y", "z"], "vid long, x double, y double, z double", lambda m: m[0])


def model_faces(files: DataFrame) -> DataFrame:
    """(mesh_id, face_id, a, b, c): vertex numbers of each triangle."""
    return _rows(files, ["face_id", "a", "b", "c"], "face_id long, a long, b long, c long", lambda m: m[1])


def model_files(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, content): a model of each mesh's vertices (mesh_id, vid, x, y, z, optionally r, g, b) and faces (a, b, c as vid). A mesh is one task's group, as it is one file."""
    kind = dict(vertices.dtypes)["mesh_id"]
    colored = {"r", "g", "b"} <= set(vertices.columns)

    def run(v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(f):
            return pd.DataFrame({"mesh_id": [], "content": []})
        v = v.sort_values("vid", kind="stable")
        at = pd.Series(np.arange(len(v)), index=v["vid"])
        order = f.sort_values("face_id", kind="stable")[["a", "b", "c"]]
        whole = order[order.isin(at.index).all(axis=1)]
        if not len(whole):
            return pd.DataFrame({"mesh_id": [], "content": []})
        colors = np.column_stack([np.clip(v[["r", "g", "b"]], 0, 255), np.full(len(v), 255)]) if colored else None
        return pd.DataFrame({"mesh_id": [v["mesh_id"].iloc[0]], "content": [build(v[["x", "y", "z"]].to_numpy(), at[whole.to_numpy().ravel()].to_numpy(), colors)]})

    return vertices.groupBy("mesh_id").cogroup(faces.groupBy("mesh_id")).applyInPandas(run, f"mesh_id {kind}, content binary")
