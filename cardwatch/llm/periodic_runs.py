"""Runs of repeated words: stretches that repeat one period four times or more.

Method: a suffix automaton reads the words; in its tree of suffix links every
node knows where its words last ended. An access for each appended word
recolours the path from the root to the word's state with the new end. Each
segment of the path that held one earlier end tells how long the suffix is
that ended there; if the distance of the two ends is within that length, the
suffix is a square, and the square is extended to its run. As in a link-cut
tree the path is kept as segments of one colour, a few for each word on
average; the tree is fixed once the automaton has read all words, so the
segments of its heavy chains are plain stacks.

Before that, a text is cut where no run can pass: any three words in a row
inside a run stand at least three times in the text. Every run lies whole
between two cuts, so the automaton sees all of them and little plain prose.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import arrow_limits

MIN_LENGTH = 6
MIN_PERIODS = 4
_NO_RUNS = hashlib.sha256(b"").hexdigest()
RUNS = "doc_id long, start long, length long, period long, words array<string>"
OUT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long,"
    " runs_sha256 string, collapsed_sha256 string"
)


class SuffixAutomaton:
    """The automaton of a sequence of numbers, with its suffix links split into heavy chains."""

    def __init__(self, words: list[int]):
        link, length, follow, state = [-1], [0], [{}], []
        last = 0
        for n, w in enumerate(words):
            new = len(link)
            link.append(0)
            length.append(n + 1)
            follow.append({})
            v = last
            while v >= 0 and w not in follow[v]:
                follow[v][w] = new
                v = link[v]
            if v >= 0:
                u = follow[v][w]
                if length[u] == length[v] + 1:
                    link[new] = u
                else:
                    copy = len(link)
                    link.append(link[u])
                    length.append(length[v] + 1)
                    follow.append(dict(follow[u]))
                    while v >= 0 and follow[v].get(w) == u:
                        follow[v][w] = copy
                        v = link[v]
                    link[u] = link[new] = copy
            state.append(new)
            last = new
        self.link, self.length, self.state = link, length, state
        self.head = self._chains()

    def _chains(self) -> list[int]:
        """The shallowest node of each node's heavy chain."""
        link, nodes = self.link, np.argsort(self.length, kind="stable").tolist()
        size = [1] * len(link)
        for v in reversed(nodes[1:]):
            size[link[v]] += size[v]
        heavy, most = [-1] * len(link), [0] * len(link)
        for v in nodes[1:]:
            if size[v] > most[link[v]]:
                most[link[v]], heavy[link[v]] = size[v], v
        head = list(range(len(link)))
        for v in nodes[1:]:
            if heavy[link[v]] == v:
                head[v] = head[link[v]]
        return head


def squares_to_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """All maximal stretches of at least two periods, as (start, length, smallest period)."""
    tree = SuffixAutomaton(words)
    link, length, state, head = tree.link, tree.length, tree.state, tree.head
    # For each chain its segments, the shallowest last: (length of the deepest node, last end). Not yet seen: no segment.
    chains: list[list[tuple[int, int]]] = [[] for _ in link]
    until: dict[int, int] = {}  # for each period the end of its latest run
    runs, n = [], len(words)
    for i in range(n):
        v = state[i]
        while v > 0:
            top, depth = head[v], length[v]
            segments = chains[top]
            while segments:
                deepest, end = segments[-1]
                reach = deepest if deepest < depth else depth  # the suffix of this length ended at `end` before
                period = i - end
                if period <= reach and until.get(period, -1) < i:
                    z = i + 1
                    while z < n and words[z] == words[z - period]:
                        z += 1
                    until[period] = z - 1
                    start = i - period - reach + 1
                    runs.append((start, z - start, period))
                if deepest <= depth:
                    segments.pop()
                if deepest >= depth:  # what lies deeper in the chain is not on the path
                    break
            segments.append((depth, i))
            v = link[top]
    return runs


def candidates(words: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) outside which no run of four periods lies: all their triples stand three times or more."""
    n = len(words)
    if n < MIN_LENGTH:
        return []
    _, pair, seen = np.unique(words[:-1] * (int(words.max()) + 1) + words[1:], return_inverse=True, return_counts=True)
    often = seen[pair] >= 3
    both = np.flatnonzero(often[:-1] & often[1:])  # triples of two frequent pairs
    if len(both) < MIN_LENGTH - 2:
        return []
    triple, seen = np.unique(pair[both] * len(seen) + pair[both + 1], return_inverse=True, return_counts=True)[1:]
    good = both[seen[triple] >= 3]
    if not len(good):
        return []
    cut = np.flatnonzero(np.diff(good) > 1)
    starts, ends = good[np.append(0, cut + 1)], good[np.append(cut, len(good) - 1)] + 3
    return [(a, z) for a, z in zip(starts.tolist(), ends.tolist()) if z - a >= MIN_LENGTH]


def periodic_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of at least four periods and six words, by start and period."""
    found = []
    for a, z in candidates(words):
        for start, length, period in squares_to_runs(words[a:z].tolist()):
            if length >= max(MIN_LENGTH, MIN_PERIODS * period):
                found.append((start + a, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)


def with_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document, by the checksum of its id, has its words from some place on replaced by repeats of a few."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def describe(words: list[bytes]) -> tuple:
    """n_runs, the longest run's start, length, period and exponent, both digests."""
    runs = periodic_runs(_numbered(words)) if len(words) >= MIN_LENGTH else []
    if not runs:
        return 0, None, None, None, None, _NO_RUNS, hashlib.sha256(b" ".join(words)).hexdigest()
    start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2]))
    dropped = np.zeros(len(words) + 1, np.int64)
    for a, n, q in runs:
        dropped[a + q] += 1
        dropped[a + n] -= 1
    kept = [words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()]
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    digests = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()
    return len(runs), start, length, period, 1000 * length // period, *digests


def _words(text: str | None) -> list[bytes]:
    """The words of a text; bytes.split takes just the space and the controls from tab to carriage return as white space."""
    return text.encode().split() if text else []


def run_report(docs: DataFrame, tails: bool = False) -> DataFrame:
    """One row per document: its runs counted, the longest of them, digests of all runs and of the text without repeats.

    Words are separated by spaces and the controls from tab to carriage
    return. ``start``, ``length``, ``period`` and ``exponent_milli`` describe
    the run of greatest length (ties: smallest start, then period) and are
    null without one. A word goes if any run holds it after that run's first
    period. ``tails`` first replaces the tail of every tenth document.

    Null and empty texts have no words and no runs; rows with a null id stay,
    with no tail replaced; repeated rows give repeated rows; an empty table
    gives no rows; other columns are ignored. Texts are read where they lie,
    whole, one at a time; nothing is shuffled.
    """
    arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found = []
            for doc_id, text in zip(ids, batch.column("text")):
                words = _words(text.as_py())
                found.append(describe(with_tail(words, doc_id) if tails else words))
            columns = list(zip(*found)) if found else [()] * 7
            types = [pa.int64()] * 5 + [pa.string()] * 2
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)


def runs(docs: DataFrame) -> DataFrame:
    """One row per run: doc_id, start, length, period and the words of its first period; else as ``run_report``."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = _words(text.as_py())
                for a, n, q in periodic_runs(_numbered(words)):
                    rows.append((doc_id, a, n, q, [w.decode() for w in words[a : a + q]]))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64()] * 4 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in RUNS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RUNS)
