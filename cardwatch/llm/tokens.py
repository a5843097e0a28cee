"""Exact token counts by dynamic programming over prefixes.

Method: in a byte-pair encoding the last token of every prefix is fixed: it is
the one token that ends there and that the encoder would leave apart from the
last token of what precedes it. Filling this table from left to right gives the
exact count of every prefix of a word; words do not merge with each other, so
running sums over words give the count of every prefix of a text, and
questions about truncation or a budget need no second encoding.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import arrow_limits, n_bytes, text_or_empty

LIMIT = 1024
#: Words kept by a worker (about 70 MB); it starts afresh when they are more.
CACHED_WORDS = 600_000
CACHED_PAIRS = 400_000
OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, bytes_within_limit long"
#: How the tokenizer's pattern splits text into words.
_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_CONTRACTIONS = ("'re", "'ve", "'ll")
#: Where the pattern above and the library's classes of characters may part; such texts are split by the library.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]")


def bytes_of_symbols() -> dict[str, int]:
    """The byte behind each printable symbol of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_vocabulary(path: str) -> tuple[dict[bytes, int], dict[tuple[int, int], int], dict[str, int]]:
    """Token bytes to ids (ids rise in the order of the merges), pairs of ids to the merged id, and the special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    names, symbols = spec["model"]["vocab"], bytes_of_symbols()
    vocabulary = {bytes(symbols[c] for c in t): i for t, i in names.items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return vocabulary, {(names[x], names[y]): names[x + y] for x, y in pairs}, special


class PrefixCounter(dict):
    """Word -> number of tokens; ``prefixes`` has the counts after each code point of a word."""

    def __init__(self, path: str):
        super().__init__()
        import ahocorasick
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ids, self.merged, self.special = byte_vocabulary(path)
        self.halves = {m: pair for pair, m in self.merged.items()}
        # Finds the tokens that end at each byte, the longest first.
        self.ending = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.ending.add_word(token.decode("latin-1"), (len(token), i))
        self.ending.make_automaton()
        self.apart: dict[tuple[int, int], bool] = {}
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def _stay_apart(self, pair: tuple[int, int]) -> bool:
        """Whether the encoder turns the bytes of two tokens into just these two."""
        if len(self.apart) > CACHED_PAIRS:
            self.apart.clear()
        known = self.apart[pair] = self._no_merge_across(*pair)
        return known

    def _no_merge_across(self, a: int, b: int) -> bool:
        """Replays the merges at the border of two tokens, lowest id first, the left one of equals first."""
        left, right = [a], [b]
        while left[-1] in self.halves:
            left.append(self.halves[left[-1]][1])
        while right[-1] in self.halves:
            right.append(self.halves[right[-1]][0])
        never = 1 << 62
        x, y = left.pop(), right.pop()
        while True:
            into_left, into_right = left[-1] if left else never, right[-1] if right else never
            across = self.merged.get((x, y), never)
            if across < into_left and across <= into_right and across != never:
                return False
            if into_left == into_right == never:
                return True
            if into_left <= into_right:
                x = left.pop()
            else:
                y = right.pop()

    def _table(self, data: bytes) -> list[int]:
        """The token count of every prefix of one word, by bytes."""
        last, count = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        apart = self.apart
        for at, (length, token) in self.ending.iter(data.decode("latin-1")):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                pair = (last[start], token)
                known = apart.get(pair)
                if not (self._stay_apart(pair) if known is None else known):
                    continue
            last[end] = token
            count[end] = count[start] + 1
        return count

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        data = word.encode()
        n = self[word] = 1 if data in self.ids else self._table(data)[-1]
        return n

    def prefixes(self, word: str) -> list[int]:
        """The token count of every prefix of one word, by code points."""
        count = self._table(word.encode())
        if len(count) == len(word) + 1:
            return count[1:]
        return [count[e] for e in np.cumsum([len(c.encode()) for c in word])]

    def pieces(self, text: str) -> list[str]:
        """The words of a text; a special token is a piece of its own."""
        if self.split_special is None or "<|" not in text:
            return self._words(text)
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [*self._words(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        if _UNUSUAL.search(text) is None:
            return _WORDS.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def counts(self, words: list[str]) -> list[int]:
        if self.special and not self.special.keys().isdisjoint(words):
            return [1 if w in self.special else self[w] for w in words]
        return [self[w] for w in words]

    def count(self, text: str) -> int:
        return sum(self.counts(self.pieces(text)))

    def prefix_counts(self, text: str) -> np.ndarray:
        """The exact count of tokens of every prefix, from none to all code points."""
        out, base, blank, before_blank = [0], 0, "", 0
        for w in self.pieces(text):
            if w in self.special:
                # A cut inside the string leaves ordinary text.
                head = [self.count(text[: len(out) + i]) for i in range(len(w) - 1)]
                out += [*head, base + 1]
                base, blank = base + 1, ""
                continue
            counts = [base + c for c in self.prefixes(w)]
            if w in _CONTRACTIONS:
                counts[1] = base + self["'"] + self[w[1]]  # the cut contraction is two words
            if blank and w[0].isspace():
                counts[0] = before_blank + self[blank + w[0]]  # until a word follows, this blank belongs to the run before it
            out += counts
            before_blank, blank = (base, w) if w.isspace() and not blank else (base, "")
            base += self[w]
        return np.array(out, np.int64)

    def count_within(self, text: str, limit: int) -> tuple[int, int | None]:
        """The count, and the bytes of the longest prefix of at most ``limit`` tokens (None: all)."""
        words = self.pieces(text)
        counts = self.counts(words)
        n = sum(counts)
        if n <= limit:
            return n, None
        # A prefix has at most one token less than its whole words, so only words near the limit decide.
        sums = np.cumsum([0, *counts])
        stop = int(np.searchsorted(sums, limit + 8, side="right"))
        start = int(np.searchsorted(sums, limit - 2, side="right")) - 1
        while start > 0 and words[start - 1].isspace():
            start -= 1
        start = max(start, 0)
        tail = "".join(words[start:stop])
        fits = np.flatnonzero(self.prefix_counts(tail) <= limit - sums[start])
        return n, len("".join(words[:start]).encode()) + len(tail[: int(fits[-1])].encode())

    def within(self, text: str, limit: int) -> int:
        """Bytes of the longest prefix that has at most ``limit`` tokens."""
        size = self.count_within(text, limit)[1]
        return len(text.encode()) if size is None else size


_COUNTERS: dict[str, PrefixCounter] = {}


def counter_of(path: str) -> PrefixCounter:
    """The counter of a tokenizer file; a worker keeps it, with its words, from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, bytes_within_limit.

    Counts are those of the tokenizer file without added tokens; the string of
    a special token inside a text is that token. ``bytes_within_limit`` is the
    longest prefix, in whole code points, of at most ``limit`` tokens. Null
    counts as empty; equal texts get equal rows; an empty table gives no rows.
    """
    arrow_limits(docs.sparkSession)

    def run(batches):
        counter = counter_of(tokenizer_path)
        for batch in batches:
            found = [counter.count_within(t, limit) for t in batch.column("text").to_pylist()]
            n = np.array([k for k, _ in found], np.int64)
            within = batch.column("n_bytes").to_numpy().copy()
            for i in np.flatnonzero(n > limit):
                within[i] = found[i][1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n), pa.array(n > limit), pa.array(within)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "bytes_within_limit"],
            )

    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), n_bytes(text).alias("n_bytes")).mapInArrow(run, OUT)
