"""The prefix trie against sets of plain tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from cardwatch.llm import prefix_trie, queries

#: Columns beyond the four have names that the operator uses itself.
SCHEMA = "conv_id long, turn long, role string, text string, block long, key long, side int, base long, ends string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, children, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    for node, inside in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(inside) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, inside in members.items():
        ends = ",".join(str(c) for c in sorted(inside) if built[c] == node)
        above = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(inside), len(node), above, len(inside), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "e") for r in rows], SCHEMA)


def nodes(df):
    return sorted(map(tuple, df.select(*prefix_trie.OUT).collect()), key=str)


@pytest.mark.parametrize("cells", [prefix_trie.BLOCK_CELLS, 30, 1])
def test_trie_of_awkward_conversations(spark, cells):
    rng = random.Random(cells)
    rows = [
        (c, rng.choice([None, t, t]), rng.choice(["u", "a", None, ""]), rng.choice(["x", "yy", "", None, "漢字é"]))
        for c in range(-3, 230)
        for t in range(rng.randrange(9))
    ]
    rows += [(None, 1, "u", "x"), (500, 1, "u", "z"), (500, 1, "u", "z"), (1000, None, None, None)]
    rows += [(700 + k, t, "u", f"same{t}") for k in range(40) for t in range(7)]  # one conversation many times
    rows += [(900 + k, t, "u", f"turn {t}") for k in range(2) for t in range(120)]  # two long ones
    assert nodes(prefix_trie.prefix_trie(table(spark, rows), cells)) == brute(rows)


def test_trie_of_the_small_table(spark, small):
    given = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert nodes(queries.op13_conversation_trie(spark, small)) == brute(map(tuple, given.collect()))


def test_trie_of_nothing(spark):
    assert nodes(prefix_trie.prefix_trie(table(spark, []))) == []
    assert nodes(prefix_trie.prefix_trie(table(spark, [(None, 0, "u", "x")]))) == []
