"""The prefix trie against a plain trie of the rebuilt conversations."""

import hashlib
import random
import zlib

import pytest

from volspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, ka string, part int, n_turns string"


def frame(spark, rows):
    """Conversations with columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, 3, "x", 1, "y") for r in rows], SCHEMA)


def brute(rows):
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0, role or "", text or ""), (role or "", text or "")))
    own = {c: [x for _, x in sorted(r)] for c, r in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    nodes: dict[tuple, list] = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, has in nodes.items():
        under = [n for n in nodes if n[: len(node)] == node]
        children = [n for n in under if len(n) == len(node) + 1]
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in under if n)
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in under) for n in under)
        ends = ",".join(map(str, sorted(c for c in has if len(built[c]) == len(node))))
        out.add((min(has), len(node), min(nodes[node[:-1]]) if node else None, len(has), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    got = prefix_trie.prefix_trie(frame(spark, rows)).collect()
    found = {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(found) == len(got) and found == brute(rows)


def test_awkward_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(100, 140), *range(200, 210), 305, 306, 317]:  # 300 is absent
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "ok", "Ünï", "\U0001f600"])))
    rows += [(None, 0, "user", "nobody"), (100, None, None, None), (101, 0, "user", "again"), (101, 0, "user", "again"), (205, 3, None, "x"), (206, 3, "x", None)]
    rows += [(8, 1, "a", "bc"), (9, 1, "ab", "c"), (400, 1, "user", "only turn of the first"), (407, 1, "user", "gone")]
    check(spark, rows)


def test_long_shared_chain_and_hot_conversation(spark, monkeypatch):
    """Copies of a long conversation are one chain, summed over several spans; a conversation that grows by a turn each time."""
    monkeypatch.setattr(prefix_trie, "SPAN", 16)
    rows = [(c, t, "user", f"t{t}") for c in (1000, 1100, 1200) for t in range(70)] + [(1200, 70, "user", "tail"), (1300, 0, "user", "t0")]
    rows += [(2000 + 100 * k, t, "u", f"g{t}") for k in range(8) for t in range(6 + k)]
    check(spark, rows)


def test_many_ends_of_one_node(spark, monkeypatch):
    """Equal conversations end at one node; their ids are hashed in several chunks."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    check(spark, [(100 * c, t, "user", f"t{t}") for c in range(300) for t in range(2)])


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    import duckdb

    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.execute(prefix_trie.ORACLE).fetchall()
    got = prefix_trie.prefix_trie(spark.read.parquet(f"{d}/conversations.parquet")).collect()
    assert {tuple(r) for r in got} == set(want) and len(got) == len(want)
