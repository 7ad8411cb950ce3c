"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The template, fixed: "### <role>: <text></turn>\n". Inside a text or role these are written as below.
ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_IN_TEXT, _IN_ROLE = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]")
_BACK = {v: k for k, v in ESCAPES.items()}
_CODE = re.compile(r"\\.", re.S)
_TURN = re.compile(r"### ([^:]*): ([^<]*)</turn>\n", re.S)


def escape(text: str, role: bool = False) -> str:
    """Without "#" and "<", so that no control string can stand in it."""
    return (_IN_ROLE if role else _IN_TEXT).sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _CODE.sub(lambda m: _BACK[m[0]], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example; raises if any character is left over."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def expand(turns: list[tuple[str, str]]) -> list[tuple[str, list[tuple[int, int]], bool]]:
    """(formatted, trainable spans, whole) of each example; whole: it holds every turn."""
    out, text = [], ""
    for k, (role, said) in enumerate(turns):
        head = f"### {escape(role, role=True)}: "
        start = len(text) + len(head)
        text += f"{head}{(body := escape(said))}</turn>\n"
        if role == "assistant":
            out.append((text, [(start, start + len(body))], k == len(turns) - 1))
    if turns and turns[-1][0] != "assistant":
        out.append((text, [], True))
    return out


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: conv_id, example, formatted, spans, whole.

    Every assistant turn becomes an example: all turns before it as context, and only its text in
    ``spans`` (character ranges that carry loss). A conversation that ends in another role adds
    one example without loss, so no turn is lost. Rows are ordered by turn; ties (repeated turns) by role and
    text; all are kept. Null text or role counts as empty; a null turn comes first; rows with a null conv_id are one
    conversation. Roles other than "assistant" carry no loss. An empty table gives no rows; other columns are
    ignored. Texts of any length stay whole. An example holds its context, so a conversation is the unit of work,
    as it is of the output; conversations are spread by key.
    """
    small_batches(turns.sparkSession)
    kind = dict(turns.dtypes)[conv]
    whole = turns.groupBy(F.col(conv).cast("string").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")))).alias("turns")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                rows = [(c, k, t, s, w) for c, xs in zip(part["conv_id"], part["turns"]) for k, (t, s, w) in enumerate(expand([(x["r"], x["x"]) for x in xs]))]
                out = pd.DataFrame(rows, columns=["conv_id", "example", "formatted", "spans", "whole"])
                out["spans"] = [[{"start": a, "stop": b} for a, b in s] for s in out["spans"]]
                yield out

    made = whole.mapInPandas(run, "conv_id string, example long, formatted string, spans array<struct<start: long, stop: long>>, whole boolean")
    return made.withColumn("conv_id", F.col("conv_id").cast(kind))


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation, parsed from its formatted examples alone."""
    import hashlib

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for c, k, text, spans, whole in zip(f["conv_id"], f["example"], f["formatted"], f["spans"], f["whole"]):
                n, sha = None, None
                if whole:
                    turns = parse(text)
                    n, sha = len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
                rows.append((c, k, n, sha, "".join(unescape(text[s["start"] : s["stop"]]) for s in spans), len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "k", "n", "sha", "loss", "chars"])
            out["n"] = out["n"].astype("Int64")
            yield out

    kind = dict(examples.dtypes)["conv_id"]
    named = examples.withColumn("conv_id", F.col("conv_id").cast("string"))
    read = named.mapInPandas(run, "conv_id string, k long, n long, sha string, loss string, chars long")
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "loss"))), lambda x: x["loss"]), "")
    return (
        read.groupBy("conv_id")
        .agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), loss.alias("_loss"), F.sum("chars").alias("formatted_chars"))
        .select(F.col("conv_id").cast(kind).alias("conv_id"), "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
    )
