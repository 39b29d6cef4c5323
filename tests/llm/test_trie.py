"""The conversation prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from panelspark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, family=100, most=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = []
    for node, mine in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        ends = ",".join(map(str, sorted(c for c in mine if len(whole[c]) == len(node))))
        out.append((min(mine), len(node), min(members[node[:-1]]) if node else None, len(mine), sum(len(x) == len(node) + 1 for x in below), len(leaves),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed, n, alphabet="ab", longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c if rng.random() < 0.9 else c + rng.choice([1000, 10**15, -500])
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn if rng.random() < 0.9 else rng.choice([None, 0, 2]), rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else "user", rng.choice(list(alphabet) + [None, "", "漢字😀"]) if rng.random() < 0.2 else alphabet[turn % len(alphabet)]))
    return rows


@pytest.mark.parametrize("seed, n, block, chunk", [(1, 120, 4, 4096), (2, 120, 2, 3), (3, 60, 1, 1), (4, 250, 4, 7)])
def test_trie_equals_brute_force(spark, seed, n, block, chunk):
    rows = made(seed, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(trie.prefix_trie(df, block=block, chunk=chunk)) == brute(rows)


def test_long_conversations_and_copies(spark):
    rng = random.Random(9)
    rows = [(7, t, "user", rng.choice("xyz")) for t in range(150)] + [(c, t, "user", "hello" * 50) for c in range(100, 160) for t in range(5)] + [(3, t, "user", "x" * 20000) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(trie.prefix_trie(df, block=4, chunk=8)) == brute(rows)


def test_null_ids_turnless_repeated_and_empty(spark):
    rows = [(None, 0, "user", "a"), (105, None, None, None), (105, None, None, None), (205, 1, "user", "b"), (1, 1, "u", "same"), (1, 1, "u", "same")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", depth string")
    assert rows_of(trie.prefix_trie(df)) == brute(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0
    assert trie.prefix_trie(df.where("conv_id is null")).count() == 0


def test_sql_twin(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    columns = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    assert rows_of(trie.op12(spark, folder)) == sorted(con.execute(f"SELECT {columns} FROM ({trie.SQL})").fetchall(), key=repr)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(trie.op12(spark, folder)) == brute(rows)
