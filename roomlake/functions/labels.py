"""Label text: cleaning, canonical names, vocabularies, snapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The closed vocabulary, its synonyms, and the word lists of the label rules.
CANONICAL = (
    "server rack", "cabinet", "table", "chair", "monitor", "whiteboard", "shelf", "printer", "sofa", "door", "window",
    "network switch", "patch panel", "cable tray",
)
SYNONYMS = {
    "rack": "server rack", "server cabinet": "server rack", "rack cabinet": "server rack", "equipment rack": "server rack",
    "storage cabinet": "cabinet", "cupboard": "cabinet", "desk": "table", "work desk": "table", "office desk": "table",
    "workstation": "table", "workstation desk": "table", "office chair": "chair", "desk chair": "chair",
    "computer chair": "chair", "seat": "chair", "screen": "monitor", "display": "monitor", "computer monitor": "monitor",
    "computer screen": "monitor", "television": "monitor", "tv": "monitor", "bookcase": "shelf", "shelving": "shelf",
    "glass door": "door", "doorway": "door", "office window": "window", "switch": "network switch",
    "server switch": "network switch",
}
REFLECTORS = ("television", "tv", "monitor", "screen", "mirror", "window", "glass")
PLANAR = (*REFLECTORS, "whiteboard", "door", "panel", "painting")
FLOOR_STANDING = ("chair", "table", "desk", "cabinet", "rack", "sofa", "couch", "shelf")
OPENINGS = ("door", "doorway", "window", "opening", "entrance", "exit")
PLANAR_TERMS = ("television", "tv", "monitor", "screen", "mirror", "window", "glass door")
MAX_LABEL = 60


def clean_label(raw: Column) -> Column:
    """Lower case, single spaces, no punctuation at the ends; null if empty, too long or without a letter or digit."""
    flat = F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"\s+", " ")
    label = F.regexp_replace(F.trim(flat), r"^[ .,:;/-]+|[ .,:;/-]+$", "")
    return F.when((F.length(label) <= MAX_LABEL) & label.rlike("[a-z0-9]"), label)


def canonical_label(raw: Column) -> Column:
    """The canonical name of a label or of a synonym; null outside the vocabulary."""
    names = {**SYNONYMS, **{c: c for c in CANONICAL}}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.element_at(table, clean_label(raw))


def has_word(label: Column, words: tuple[str, ...], whole: bool = True) -> Column:
    """Whether a word of the label, hyphens as spaces, is listed; ``whole`` also matches the label as it is."""
    vocabulary = F.array(*[F.lit(w) for w in words])
    value = F.lower(label)
    found = F.arrays_overlap(F.split(F.replace(value, F.lit("-"), F.lit(" ")), r"\s+"), vocabulary)
    return found | F.array_contains(vocabulary, F.trim(value)) if whole else found


def is_planar_category(label: Column) -> Column:
    value = F.trim(F.lower(label))
    return reduce(Column.__or__, [value.contains(t) for t in PLANAR_TERMS])


def prompt_categories(prompt: Column) -> Column:
    """Ordered distinct categories of a prompt separated by dots or commas."""
    parts = F.transform(F.split(F.lower(prompt), "[.,]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def snap_label(span: Column, categories: list[str]) -> Column:
    """The category that shares most words with the span, both ways, plus one if either holds the other; first of ties."""
    s = F.lower(F.trim(span))
    if not categories:
        return F.nullif(s, F.lit(""))
    words = F.array_distinct(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    scored = []
    for k, c in enumerate(categories):
        own = list(dict.fromkeys(c.split()))
        shared = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in own])))
        score = shared / F.lit(float(len(own))) + shared / F.greatest(F.size(words), F.lit(1)).cast("double")
        score = score + F.when(F.lit(c).contains(s) | s.contains(c), 1.0).otherwise(0.0)
        scored.append(F.struct(F.when(shared > 0, score).otherwise(0.0).alias("score"), F.lit(-k).alias("order"), F.lit(c).alias("label")))
    best = F.array_max(F.array(*scored))
    return F.when(s == "", None).when(s.isin(categories), s).otherwise(F.when(best["score"] > 0, best["label"]))
