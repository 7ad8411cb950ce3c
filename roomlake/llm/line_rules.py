"""Quality rules: line-first cleaning, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
TERMINAL = [".", "!", "?", "…", ":", ";", '"', "'", "”", "»", ")", "]", "}"]
SEPARATORS = ["|", "»", "«", "•", "·", "›", ">", "/", "→", "*", "-"]
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies",
    "enable javascript", "lorem ipsum", "click here", "sign up", "log in", "read more", "share this", "skip to content",
    "subscribe to", "powered by", "follow us", "back to top",
]
#: A phrase counts where no letter goes on before or after it, so "catalog in" holds no "log in". The phrases are English;
#: the other rules read signs, lengths and final punctuation and hold for any language.
PHRASE = r"(^|[^\p{L}])(" + "|".join(BOILERPLATE) + r")($|[^\p{L}])"
FRAGMENT_WORDS = 8
BOILERPLATE_WORDS = 25
MAX_LOST_PERCENT = 30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SPACES = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, also where a filter on the result is pushed below its projection."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    """Hashes of all windows of three words."""
    n = F.size(words)
    return F.when(n >= 3, F.transform(
        F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))
    )).otherwise(F.array().cast("array<bigint>"))


def _repeats(h: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more: sort the hashes, then measure the union of windows."""
    ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def marked(s: Column) -> Column:
        # null where the window has no equal neighbour in hash order
        mine = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
        return F.sort_array(F.array_compact(mine))

    def width(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(_let(ranked, marked), width))


def line_verdicts(lines: Column) -> Column:
    """Array of (n words, fails) for an array of (line, words) structs."""

    def judge(x: Column) -> Column:
        line, words = x["line"], x["words"]
        n = F.size(words)
        low, last = F.lower(line), F.substring(F.element_at(words, -1), -1, 1)
        phrase = low.rlike(PHRASE)
        signs = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
        fails = (
            ((n < FRAGMENT_WORDS) & ~last.isin(TERMINAL))
            | (signs > n)
            | (F.size(F.filter(words, lambda w: w.isin(SEPARATORS))) * 5 >= n)
            | (F.size(F.filter(words, lambda w: w.endswith("!!") | w.endswith("!!."))) * 2 > n)
            | ((n < BOILERPLATE_WORDS) & phrase)
        )
        return F.struct(n.alias("n"), ((n > 0) & F.coalesce(fails, F.lit(False))).alias("fails"))

    return F.transform(lines, judge)


def parted(text: Column) -> Column:
    """Array of (line, words) structs."""
    return F.transform(
        F.split(text, "\n"), lambda l: F.struct(l.alias("line"), F.filter(F.split(l, _SPACES), lambda w: w != "").alias("words"))
    )


def _lost(verdicts: Column) -> Column:
    return F.aggregate(verdicts, F.lit(0), lambda a, v: a + F.when(v["fails"], v["n"]).otherwise(0))


def line_first_clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's rows with ``cleaned`` (text without failed lines) and ``lost_percent``.

    Each line is judged on its own: a short line without final punctuation, a menu, a line of
    symbols or shouting, or a boilerplate phrase in a short line fails and is cut. Null text counts as empty;
    a blank line never fails; rows, ties and repeated rows are judged one by one; an empty table gives no rows; texts of any
    length are judged whole. All columns of the input are kept but those named cleaned or lost_percent, which are replaced.
    """
    made = ("cleaned", "lost_percent")

    def judge(lines: Column, verdicts: Column) -> Column:
        kept = F.filter(F.arrays_zip(lines["line"].alias("line"), verdicts["fails"].alias("fails")), lambda p: ~p["fails"])
        words = F.aggregate(verdicts, F.lit(0), lambda a, v: a + v["n"])
        return F.struct(
            F.array_join(F.transform(kept, lambda p: p["line"]), "\n").alias("cleaned"),
            (100.0 * _lost(verdicts) / F.greatest(words, F.lit(1))).alias("lost_percent"),
        )

    (found,) = fresh(docs, "_found")
    body = F.coalesce(F.col(text), F.lit(""))
    judged = docs.withColumn(found, _let(parted(body), lambda lines: _let(line_verdicts(lines), lambda v: judge(lines, v))))
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    return judged.select(*own, F.col(found)["cleaned"].alias("cleaned"), F.col(found)["lost_percent"].alias("lost_percent"))


def line_first_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    kept is false if the base rules fail, else says whether the lines that stay hold enough of
    the words. Null text counts as empty (fails the base rules); null keys, ties and repeated rows keep their
    own rows; an empty table gives no rows; other columns are ignored, whatever their names. Texts of any length are read whole, a row
    at a time. Nothing is shuffled. Three-word
    windows are compared by a 64-bit hash.
    """
    def measure(lines: Column) -> Column:
        full = F.transform(F.filter(lines, lambda x: F.size(x["words"]) > 0), lambda x: x["line"])
        return F.struct(
            _let(F.flatten(lines["words"]), lambda w: F.struct(F.size(w).alias("n"), _let(_windows(w), _repeats).alias("repeats"))).alias("words"),
            _let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).alias("dup"),
            _lost(line_verdicts(lines)).alias("lost"),
        )

    slim = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    shown = slim.withColumn("_found", _let(parted(F.col("_text")), measure)).select(
        F.col("_key").alias(key), F.col("_found.words.n").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col("_found.dup").cast("long").alias("n_dup_lines"), F.col("_found.words.repeats").cast("long").alias("n_repeat_words"),
        F.col("_found.lost").cast("long").alias("_lost"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return shown.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("_lost") <= MAX_LOST_PERCENT * F.col("n_words"))
    ).drop("_lost")


def report_sql() -> str:
    """DuckDB SQL for line_first_report over documents."""
    spaces = r"[\x20\x09-\x0D]+"
    quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS li FROM d),
lw AS (SELECT rid, li, line, list_filter(regexp_split_to_array(line, '{spaces}'), lambda w: w <> '') AS ws FROM l),
lj AS (SELECT *, len(ws) AS n,
   len(ws) > 0 AND (
     (len(ws) < {FRAGMENT_WORDS} AND right(ws[-1], 1) NOT IN ({quoted(TERMINAL)}))
     OR len(line) - len(translate(line, '{SYMBOLS}', '')) > len(ws)
     OR len(list_filter(ws, lambda w: w IN ({quoted(SEPARATORS)}))) * 5 >= len(ws)
     OR len(list_filter(ws, lambda w: w LIKE '%!!' OR w LIKE '%!!.')) * 2 > len(ws)
     OR (len(ws) < {BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{PHRASE}'))) AS fails
  FROM lw),
a AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_words, CAST(coalesce(sum(n) FILTER (WHERE fails), 0) AS BIGINT) AS lost,
   CAST(count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS BIGINT) AS n_dup_lines FROM lj GROUP BY rid),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '{spaces}'), lambda w: w <> '') AS ws FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
o AS (SELECT doc_id, n_words, CAST(len(regexp_replace(t, '{spaces}', '', 'g')) AS BIGINT) AS word_chars,
   CAST(len(t) - len(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, lost
  FROM d JOIN a USING (rid) LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * lost <= {MAX_LOST_PERCENT} * n_words AS kept
FROM o"""
