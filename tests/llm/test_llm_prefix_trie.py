"""The burst trie next to a plain trie of dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cloakspan.llm import prefix_trie

TURNS = "conv_id long, turn int, role string, text string, head string, d int"


def plain_rebuilt(turns):
    """Sequences of (role, text) of rebuilt conversations."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            tid = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, tid, role, text))
    own = {c: [x[3:] for x in sorted(rows)] for c, rows in own.items()}
    out = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + rows[h:]
    return out


def plain_nodes(sequences):
    nodes = defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    children = defaultdict(int)
    for node in nodes:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * words
    out = []
    for node, convs in nodes.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(node))
        out.append((
            min(convs), len(node), min(nodes[node[:-1]]) if node else None, len(convs), children[node],
            leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def rows_with_more(spark, turns, parts=3):
    return spark.createDataFrame([(*t, "h", 1) for t in turns], TURNS).repartition(parts)


def random_turns(seed, convs, turns, texts):
    dealt = random.Random(seed)
    return [
        (c, t, dealt.choice(["user", "assistant"]), " ".join(["w"] * dealt.randrange(texts)))
        for c in range(-5, convs)
        for t in range(dealt.randrange(1, turns))
    ]


@pytest.mark.parametrize("window,container", [(256, 512), (256, 3), (4, 1), (5, 2)])
def test_random_conversations(spark, window, container):
    turns = random_turns(window + container, 90, 9, 3)
    got = prefix_trie.conversation_trie(rows_with_more(spark, turns), window, container)
    assert rows_of(got) == plain_nodes(plain_rebuilt(turns))


def test_odd_turns(spark):
    """Nulls, ties, repeated rows, absent bases, and conversations that end
    where they would begin."""
    turns = [
        (20, 1, "user", "a b"), (20, 2, None, None), (20, 2, "", ""), (20, None, "user", "first"),
        (21, 0, "user", "x"), (22, 0, "user", "x"), (22, 0, "user", "x"), (25, 5, "user", "only"),
        (41, 0, "user", "no base"), (41, 1, "user", "second"), (43, 3, "user", "third"), (44, 0, "user", ""),
        (None, 0, "user", "no id"), (None, 0, "user", "no id"), (-7, 0, "user", "a \x0b b \x1c"), (1, 0, "user", "x"),
        (24, 0, "user", "long " * 20_000), (23, 0, "us", "er"), (26, 0, "u", "ser"),
    ]
    got = prefix_trie.conversation_trie(rows_with_more(spark, turns), 4, 1)
    assert rows_of(got) == plain_nodes(plain_rebuilt(turns))


def test_copies_and_a_long_conversation(spark):
    """A third of the turns in one conversation, a third in equal ones."""
    turns = [(7, t, "user", f"turn {t % 11}") for t in range(600)]
    turns += [(100 + c, t, "user", f"same {t}") for c in range(100) for t in range(6)]
    turns += [(1000 + c, t, "user", f"turn {t % 11} {c * (t > 20)}") for c in range(5) for t in range(60)]
    got = prefix_trie.conversation_trie(rows_with_more(spark, turns, 6), 16, 4)
    assert rows_of(got) == plain_nodes(plain_rebuilt(turns))


def test_copies_of_a_long_conversation(spark):
    """Chains of several conversations, and sequences shared over windows."""
    turns = [(20 * c, t, "user", f"w {t}") for c in (1, 2, 3) for t in range(40)]
    turns += [(80, t, "user", f"w {t}") for t in range(39)] + [(100, t, "user", f"w {t}") for t in range(8)]
    turns += [(120 + 20 * c, t, "user", f"v {t}") for c in range(2) for t in range(30)]
    df = rows_with_more(spark, turns)
    expected = plain_nodes(plain_rebuilt(turns))
    for window, container in ((4, 1), (7, 2), (13, 512)):
        assert rows_of(prefix_trie.conversation_trie(df, window, container)) == expected


def test_numbers_across_partitions(spark):
    turns = [(c, t, "user", "a b c") for c, n in ((1, 3), (2, 500), (3, 1), (4, 70)) for t in range(n)]
    rows = prefix_trie.numbered(rows_with_more(spark, turns)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("pos")).alias("pos"), F.sort_array(F.collect_list("cum")).alias("cum")
    )
    for r in rows.collect():
        n = {1: 3, 2: 500, 3: 1, 4: 70}[r["conv_id"]]
        assert r["pos"] == list(range(1, n + 1)) and r["cum"] == [3 * i for i in r["pos"]]


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    with pytest.raises(ValueError):
        prefix_trie.conversation_trie(spark.createDataFrame([], TURNS), window=3)
