"""Fast exact encoding with a public word-level BPE vocabulary (tokenizers JSON with an end-of-word suffix).

The vocabulary is read from a path and never copied. Words repeat, so a bounded cache keeps each
word's ids; unseen words are merged in one call by tiktoken, over the same merges, with a space as
the end-of-word mark. Texts that the short way can't promise (control separators, special tokens
in the text) go to the tokenizers library itself.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import regex
import tiktoken

#: Words that the cache holds before it starts anew; about 40 MB.
CACHE_WORDS = 200_000
#: Separators that only Python takes for white space, and the start of a special token.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


def _byte_letters() -> dict[str, int]:
    """Letter for each byte, as byte-level vocabularies write it: printable bytes as themselves, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordBpe:
    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        suffix = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            last = token.endswith(suffix)
            return bytes(letters[c] for c in (token[: -len(suffix)] if last else token)) + b" " * last

        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {bytes([b, 32]): 256 + b for b in range(256) if b != 32}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(raw(a + b), len(ranks) + 1)
        self.vocabulary = np.zeros(max(ranks.values()) + 1, np.uint32)
        self.ends = np.zeros(len(self.vocabulary), bool)
        special = {t["content"] for t in spec["added_tokens"]}
        for token, i in model["vocab"].items():
            if token not in special and 32 not in (b := raw(token))[:-1] and b != b" ":
                self.vocabulary[ranks[b]] = i
                self.ends[ranks[b]] = b.endswith(b" ")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.merger = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _learn(self, words: list[str]) -> None:
        parts, counts = [], np.ones(len(words), np.int64)
        for k, word in enumerate(words):
            if not word.isascii():
                word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
            word = word.lower()
            if not word.isalpha():
                found = self.pieces.findall(word)
                counts[k] = len(found)
                word = " ".join(found)
            parts.append(word)
        got = np.array(self.merger.encode_ordinary(" ".join(parts) + " "), np.int64)
        stops = (np.flatnonzero(self.ends[got]) + 1)[np.cumsum(counts) - 1]
        n, first = len(words), len(self.known)
        sizes = np.diff(stops, prepend=0)
        while len(self.at) < first + n:
            self.at, self.size = np.concatenate([self.at, self.at * 0]), np.concatenate([self.size, self.size * 0])
        while len(self.ids) < self.used + len(got):
            self.ids = np.concatenate([self.ids, self.ids * 0])
        self.at[first : first + n] = self.used + stops - sizes
        self.size[first : first + n] = sizes
        self.ids[self.used : self.used + len(got)] = self.vocabulary[got]
        self.used += len(got)
        self.known.update(zip(words, range(first, first + n)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text), as the library gives without special tokens."""
        odd = {k: self.library.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts) if any(x in t for x in ODD)}
        words: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            if k not in odd:
                words += text.split()
            ends[k + 1] = len(words)
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.clear()
            new = set(words)
        if new:
            self._learn(list(new))
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.size[codes]
        done = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.at[codes] - done[:-1], sizes) + np.arange(done[-1])]
        stops = done[ends]
        if not odd:
            return ids, np.diff(stops)
        parts = [np.array(odd[k], np.uint32) if k in odd else ids[stops[k] : stops[k + 1]] for k in range(len(texts))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One a worker process and path."""
    return WordBpe(path)
