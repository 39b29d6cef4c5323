"""SimHash fingerprints: the contract's texts, votes against a plain count, groups against brute force."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import fingerprints as fp
from panelspark.llm.common import mix

SCHEMA = "doc_id long, text string"
TEXTS = ["", None, "one", "two words", "漢字 😀 é", "a b c d e f g h i j k l m n o p q r s", "Same Text", "same text", "x" * 3000, "word " * 4000, "\n\t "]


def expected(rows):
    """doc_id -> (n_chars, edited text) for different ids."""
    order = sorted(rows, key=lambda r: -r[0])
    return {d: (len(t or ""), (t or "")[: len(t or "") - len(t or "") // 2] + (order[(k + 1) % len(order)][1] or "")[: len(t or "") // 2]) for k, (d, t) in enumerate(order)}


@pytest.mark.parametrize("partitions", [1, 5])
def test_edited_texts_follow_the_next_document(spark, partitions):
    rng = random.Random(3)
    rows = [(k * 7 % 101, t) for k, t in enumerate(TEXTS + ["".join(rng.choices("ab é漢😀", k=rng.randint(0, 90))) for _ in range(80)])]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r["doc_id"]: r for r in fp.edited(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = expected(rows)
    assert got.keys() == want.keys()
    own = {d: fp._hex(fp.fingerprints(pa.array([t or ""])))[0].as_py() for d, t in rows}
    order = sorted(own, reverse=True)
    for k, d in enumerate(order):
        r, (n, text) = got[d], want[d]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(text.encode()).hexdigest())
        assert r["fingerprint"] == own[d]
        assert r["edited_fingerprint"] == fp._hex(fp.fingerprints(pa.array([text])))[0].as_py()
        for name, other in (("near_edited", r["edited_fingerprint"]), ("near_next", own[order[(k + 1) % len(order)]])):
            bits = bin(int(own[d], 16) ^ int(other, 16)).count("1")
            assert r[name] == pytest.approx(max(0.0, math.cos(math.pi * bits / fp.BITS)))


def test_votes_equal_a_plain_count():
    text = "the cat saw the other cat and The dog " * 3 + "é"
    doc, term, weight = fp._terms(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    votes = [0] * fp.BITS
    for t, w in zip(term, weight):
        for q, salt in enumerate(fp._SALTS):
            octets = mix(np.array([t]) + salt).view(np.uint8)
            for k, octet in enumerate(octets):
                for bit in range(8):
                    votes[q * 64 + k * 8 + bit] += int(w) if octet >> (7 - bit) & 1 else -int(w)
    assert np.unpackbits(fp.fingerprints(pa.array([text]))[0]).tolist() == [int(v > 0) for v in votes]
    words = text.lower().split()
    assert len(term) == len(set(words)) + len(set(zip(words, words[1:])))  # no short runs: there are many words


def test_equal_texts_have_equal_fingerprints_wherever_they_stand():
    rng = random.Random(4)
    texts = [" ".join(rng.choices("alpha beta gamma delta eps zeta eta".split(), k=rng.randint(0, 300))) for _ in range(60)]
    one = fp.fingerprints(pa.array(texts * 2))
    other = np.concatenate([fp.fingerprints(pa.array([t])) for t in texts])
    assert (one[:60] == other).all() and (one[60:] == other).all()


def test_likeness_tells_halves_from_strangers(spark):
    rows = fp.op13(spark, "/root/testdata/sf0.01").where("n_chars > 20").collect()
    better = sum(r["near_edited"] > r["near_next"] for r in rows) / len(rows)
    assert better > 0.98
    assert 0.4 < np.mean([r["near_edited"] for r in rows]) < 0.75 and np.mean([r["near_next"] for r in rows]) < 0.15


def brute_groups(rows, radius):
    prints = sorted({p for _, p in rows})
    group = {p: p for p in prints}
    words = {p: int(p, 16) for p in prints}

    def find(p):
        while group[p] != p:
            p = group[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[i + 1 :]:
            if (words[p] ^ words[q]).bit_count() <= radius:
                a, b = sorted((find(p), find(q)))
                group[b] = a
    least = {}
    for d, p in rows:
        least[find(p)] = min(least.get(find(p), d), d)
    return {p: least[find(p)] for p in prints}


@pytest.mark.parametrize("radius, cell", [(0, 2048), (3, 4), (7, 2048), (7, 3), (12, 16)])
def test_groups_equal_brute_force(spark, radius, cell):
    rng = random.Random(radius)
    rows = []
    for _ in range(12):
        base = rng.getrandbits(fp.BITS)
        for _ in range(rng.randint(1, 14)):
            near = base
            for _ in range(rng.randint(0, radius + 3)):
                near ^= 1 << rng.randrange(fp.BITS)
            rows += [(len(rows), f"{near:064x}")] * rng.randint(1, 2)
    got = {r["fingerprint"]: r["near_id"] for r in fp.near_groups(spark.createDataFrame(rows, "doc_id long, fingerprint string"), radius, cell).collect()}
    assert got == brute_groups(rows, radius)


def test_repeated_and_null_ids_lone_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d"), (None, "x y"), (None, None)], SCHEMA)
    got = fp.edited(df.withColumn("part", df.text)).collect()
    assert len(got) == 5 and sum(r["doc_id"] is None for r in got) == 2
    alone = fp.edited(df.limit(1)).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert fp.edited(df.limit(0)).count() == 0
    with_extra = fp.fingerprint_column(df.withColumn("fingerprint_", df.text)).collect()
    assert with_extra[0]["fingerprint"] == with_extra[1]["fingerprint"]
