"""Exact self-join of documents on the Jaccard similarity of their word shingles: components and numbers of links.

Documents with equal shingle sets form a class; classes are joined. The join filters with several global
orders of the shingles at once. All orders put shingles that many documents share last, by ascending
count; the other shingles come by ascending hash (order 1), by descending hash (order 2), or by hash from
the middle round (order 3). Two linked sets share a shingle among the first ``n // 4 + 1`` of each under every
order. Order 1 makes the candidates, with size and position bounds, and sketches of counts bound their overlap;
then the prefixes under orders 2 and 3 are joined, and only candidates that agree under all orders have their
whole sets moved and intersected.

A large group of near copies would give pairs by the square of its size. So each bucket (a shingle of some
prefixes) first links its members to its most central class, the one with the least share of rare shingles.
Then buckets of more than two classes are joined again, but only for pairs of classes that are not yet in one
component. No pair that could change a component is left out, so components are exact (up to collisions of
64-bit hashes).

All links lie within components, so a class's links are counted there: a component is dealt into blocks of
classes of like size, each pair of blocks that can hold links is one task's product of two incidence matrices,
and only counts leave it. Work is by the square of a component's classes, as links are, but no pair is a row.

Shared shingles are counted over all documents: every chunk of a few thousand documents reports the
shingles that several of its documents hold. They steer the order only; any order gives the same result.
Buckets of shingles that more than ``HOT`` documents share are dealt over ``SALTS`` tasks.

Edge cases: a null, empty or blank text has no shingles and links with nothing. A text of one to four words has one
shingle, the whole sequence. Every input row gives one result row, repeated rows included; a class whose ids are all null has a null
component. Very long texts are read whole. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Words, fold_ascii, free_name, lean_worker, materialize, mix, release, small_batches, table, text_slices, white_space
from .urls import BlockedBloom, build_filter

WORDS, SKETCH, MAX_SKETCH = 5, 128, 1 << 16
#: Links have 100 * intersection >= 75 * union, that is 7 * intersection >= 3 * (sum of sizes).
MIN_PERCENT = 75
#: Shingles in a chunk whose shared shingles are counted, and shared shingles kept at most (16 MB), by how many documents at least.
CHUNK_SHINGLES, MAX_SHARED, MIN_SHARED = 1 << 20, 2 << 20, 3
#: Documents that share a shingle from which its bucket is dealt over so many tasks.
HOT, SALTS = 20_000, 64
#: Classes and shingles in a block of a component whose links are counted; bins of sizes, so that linked classes are at most one apart.
BLOCK_CLASSES, BLOCK_SHINGLES, BIN = 256, 1 << 18, 1.34
_PLACE = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def shingle_sets(column: pa.Array):
    """(first row, list of sorted distinct shingle hashes) for slices of a text column."""
    for at, to, data, bounds in text_slices(column):
        words = Words(data, bounds, white_space(), fold_ascii())
        edge, h = words.doc_bounds(), words.hash
        raw = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            raw += h[k : len(raw) + k] * _PLACE[k]
        raw = mix(raw)
        sets = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a >= WORDS:
                sets.append(np.unique(raw[a : b - WORDS + 1]))
            elif b > a:
                sets.append(mix(np.array([(h[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                sets.append(raw[:0])
        yield at, sets


def signature(tokens: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    place = np.arange(1, len(tokens) + 1, dtype=np.uint64)
    return int(mix(np.array([mix(tokens ^ mix(place)).sum() + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def sketch(tokens: np.ndarray) -> bytes | None:
    """How many shingles fall into each part of the hashes, a byte each; null if a count needs more. Parts are a power
    of two, ``SKETCH`` or about a fourth of the shingles, as unrelated sets fill large parts alike."""
    parts = min(MAX_SKETCH, max(SKETCH, 1 << (len(tokens) // 4).bit_length()))
    counts = np.bincount(((tokens >> np.uint64(20)) % np.uint64(parts)).astype(np.int64), minlength=parts)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, sig, sketch for each row (sig null without shingles), and in some rows the shared shingles of a chunk."""
    shared_type = pa.list_(pa.struct([("token", pa.int64()), ("docs", pa.int32())]))
    types = {"doc_id": pa.int64(), "key": pa.int64(), "n": pa.int64(), "sig": pa.int64(), "sketch": pa.binary(), "shared": shared_type, "is_doc": pa.bool_()}

    def shared(tokens):
        value, count = np.unique(np.concatenate(tokens), return_counts=True) if tokens else (np.zeros(0, np.uint64), np.zeros(0, int))
        some = count >= 2
        return [{"token": t, "docs": c} for t, c in zip(value[some].view(np.int64).tolist(), count[some].tolist(), strict=True)]

    def batch_of(*columns):
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))

    def run(batches):
        lean_worker()
        seen: set[int] = set()
        chunk, held = [], 0
        for batch in batches:
            for at, sets in shingle_sets(batch.column(2)):
                n, sig, marks, report = [], [], [], [None] * len(sets)
                for s in sets:
                    own = signature(s) if len(s) else None
                    n.append(len(s))
                    sig.append(own)
                    marks.append(sketch(s) if len(s) and own not in seen else None)
                    if len(s) and own not in seen:
                        seen.add(own)
                        chunk.append(s)
                        held += len(s)
                if held >= CHUNK_SHINGLES:
                    report[-1] = shared(chunk)
                    chunk, held = [], 0
                yield batch_of(batch.column(0).slice(at, len(sets)), batch.column(1).slice(at, len(sets)), n, sig, marks, report, [True] * len(sets))
        yield batch_of([None], [None], [None], [None], [None], [shared(chunk)], [False])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, n long, sig long, sketch binary, shared array<struct<token:long,docs:int>>, is_doc boolean")


def ordered(tokens: np.ndarray, shared: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens in order 1 (rare ones by hash, then shared ones by count), in how many documents each is (0 if rare), and how many are rare."""
    if not len(shared):
        return tokens, np.zeros(len(tokens), np.int32), len(tokens)
    at = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
    times = np.where(shared[at] == tokens, count[at], 0)
    order = np.lexsort((tokens, times))
    return tokens[order], times[order], int((times == 0).sum())


def prefixes(docs: DataFrame, shared_tokens) -> DataFrame:
    """token, salt, sig, info: the first n // 4 + 1 shingles of each class under order 1.

    ``info`` packs the percentage of rare shingles, the size and the place, as these rows are by far the most
    that are shuffled: 8, 28 and 28 bits. ``salt`` is 0 but for shingles of more than ``HOT`` documents.
    """

    def run(batches):
        lean_worker()
        shared, count = shared_tokens.value
        seen: set[int] = set()
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0)):
                token, salt, sig, info = [], [], [], []
                for s in sets:
                    if not len(s) or (own := signature(s)) in seen:
                        continue
                    seen.add(own)
                    size = len(s) // 4 + 1
                    tokens, times, n_rare = ordered(s, shared, count)
                    token.append(tokens[:size])
                    salt.append(np.where(times[:size] > HOT, 1 + own % SALTS, 0).astype(np.int8))
                    sig.append(np.full(size, own, np.int64))
                    info.append(np.arange(size) + (100 * n_rare // len(s) << 56 | len(s) << 28))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (salt, sig, info))], ["token", "salt", "sig", "info"])

    return docs.select("text").mapInArrow(run, "token long, salt byte, sig long, info long")


def _size(info: Column) -> Column:
    return F.shiftright(info, 28).bitwiseAND(F.lit((1 << 28) - 1))


def _place(info: Column) -> Column:
    return info.bitwiseAND(F.lit((1 << 28) - 1))


def _buckets(docs: DataFrame, shared_tokens) -> DataFrame:
    """token, sig, n, pos, size, hub (sig, n, pos) of every row of a bucket with two classes or more; size 2 stands for two classes."""
    part = Window.partitionBy("token", "salt")
    best = F.struct(F.shiftright("info", 56).alias("rare"), "sig", "info")
    rows = prefixes(docs, shared_tokens).select("*", F.min("sig").over(part).alias("lo"), F.max("sig").over(part).alias("hi"), F.count("*").over(part).alias("size"), F.min(best).over(part).alias("hub"))
    shape = ("token", "sig", _size(F.col("info")).alias("n"), _place(F.col("info")).alias("pos"), "size", F.struct("hub.sig", _size(F.col("hub.info")).alias("n"), _place(F.col("hub.info")).alias("pos")).alias("hub"))
    if not (shared_tokens.value[1] > HOT).any():
        return materialize(rows.where("lo < hi").select(*shape))
    rows = materialize(rows.where("salt > 0 or lo < hi"))
    hot = rows.where("salt > 0")
    whole = materialize(hot.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("size"), F.min("hub").alias("hub")).where("lo < hi"))
    made = materialize(rows.where("salt = 0").select(*shape).unionByName(hot.drop("lo", "hi", "size", "hub").join(whole, "token").select(*shape)))
    release(rows, whole)
    return made


def _prefix_2(tokens: np.ndarray, n_rare: int, size: int) -> np.ndarray:
    """The prefix under order 2 of a set in order 1."""
    return tokens[:size] if n_rare < size else tokens[n_rare - size : n_rare]


def _prefix_3(tokens: np.ndarray, n_rare: int, size: int) -> np.ndarray:
    """The prefix under order 3 of a set in order 1."""
    if n_rare < size:
        return tokens[:size]
    middle = int(np.searchsorted(tokens[:n_rare], np.uint64(1 << 63)))
    return np.concatenate([tokens[middle : min(middle + size, n_rare)], tokens[: max(0, size - (n_rare - middle))]])


def sets_of(docs: DataFrame, needed: DataFrame, shared_tokens) -> DataFrame:
    """sig, second, third (prefixes under orders 2 and 3), tokens for the classes of the texts in ``needed`` (column key).

    A blocked Bloom filter of bounded size keeps other texts from being cut into shingles; sets of texts that it lets
    through in vain, and the same set from several tasks, are left to the joins.
    """
    bloom = build_filter(needed, F.col("key"))
    lanes = docs.sparkSession.sparkContext.broadcast((bloom.blocks, bloom.lanes))  # at most 8 MB
    as_list = lambda some: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, some)]).astype(np.int32)), pa.array(np.concatenate(some).view(np.int64)))

    def run(batches):
        lean_worker()
        shared, count = shared_tokens.value
        wanted = BlockedBloom(*lanes.value)
        seen: set[int] = set()
        for batch in batches:
            key = batch.column(0).to_numpy()
            new = np.zeros(len(key), bool)
            new[np.unique(key, return_index=True)[1]] = True
            some = np.flatnonzero(new & wanted.probe(key)) if len(key) else []
            some = [i for i in some if int(key[i]) not in seen]
            seen.update(key[some].tolist())
            for _, sets in shingle_sets(batch.column(1).take(pa.array(some, pa.int64()))):
                sig, second, third, tokens = [], [], [], []
                for s in sets:
                    if len(s):
                        t, _, n_rare = ordered(s, shared, count)
                        sig.append(signature(s))
                        second.append(_prefix_2(t, n_rare, len(s) // 4 + 1))
                        third.append(_prefix_3(t, n_rare, len(s) // 4 + 1))
                        tokens.append(t)
                if sig:
                    yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), as_list(second), as_list(third), as_list(tokens)], ["sig", "second", "third", "tokens"])

    return docs.select("key", "text").mapInArrow(run, "sig long, second array<long>, third array<long>, tokens array<long>")


def _can_link(n: Column, pos: Column, n2: Column, pos2: Column) -> Column:
    """Bounds from the sizes, and from the places of a first shared shingle in both orders."""
    return (4 * F.least(n, n2) >= 3 * F.greatest(n, n2)) & (7 * F.least(n - pos, n2 - pos2) >= 3 * (n + n2))


def _overlap_bound(a: pd.Series, b: pd.Series) -> pd.Series:
    """From sketches: two sets share no more of a part than the smaller count; a missing sketch bounds nothing."""
    out = np.full(len(a), 1 << 40)
    for at, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is not None and y is not None:
            few = min(len(x), len(y))  # the finer sketch is summed to the parts of the other
            x, y = (np.frombuffer(v, np.uint8).reshape(-1, few).sum(0, dtype=np.int32) for v in (x, y))
            out[at] = np.minimum(x, y).sum()
    return pd.Series(out)


def _joined(pairs: DataFrame, values: DataFrame, left: str, right: str, *names: str) -> DataFrame:
    """``pairs`` (a, b) with struct columns of the named values of both classes."""
    one, two = (values.select(F.col("sig").alias(c), F.struct(*names).alias(out)) for c, out in (("a", left), ("b", right)))
    return pairs.join(one, "a").join(two, "b")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shared_tokens) -> tuple[DataFrame, DataFrame]:
    """The links (a, b) among pairs (a, b, n, n2), and the sets of their classes.

    The sketches must allow the link, then orders 2 and 3 must agree, then the sets are intersected.
    """
    bound = F.pandas_udf(_overlap_bound, "long")
    close = _joined(pairs, classes.select("sig", "sketch"), "x", "y", "sketch").where(7 * bound("x.sketch", "y.sketch") >= 3 * (F.col("n") + F.col("n2")))
    close = materialize(close.select("a", "b"))
    needed = close.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(classes, "sig").select("key")
    sets = materialize(sets_of(docs, materialize(needed), shared_tokens))
    agree = _joined(close, sets.select("sig", "second", "third").dropDuplicates(["sig"]), "x", "y", "second", "third")
    agree = materialize(agree.where(F.arrays_overlap("x.second", "y.second") & F.arrays_overlap("x.third", "y.third")).select("a", "b"))
    both = _joined(agree, sets.select("sig", "tokens").dropDuplicates(["sig"]), "x", "y", "tokens")
    common = F.size(F.array_intersect("x.tokens", "y.tokens"))
    links = materialize(both.where(7 * common >= 3 * (F.size("x.tokens") + F.size("y.tokens"))).select("a", "b"))
    release(close, agree)
    return links, sets


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node in ``edges`` (a, b), by alternating large and small stars."""
    held = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, held = held, materialize(small.distinct())
        release(before)
        now = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            named = held.select(F.col("a").alias("node"), F.col("b").alias("root"))
            made = materialize(named.unionByName(named.select(F.col("root").alias("node"), "root").distinct()))
            release(held)
            return made
        state = now


def _partners(parts: list[np.ndarray], weight: np.ndarray, side: np.ndarray, own_block: bool) -> np.ndarray:
    """For each set the sum of the weights of the sets that it links with: of the other side, or if ``own_block`` of all others."""
    size = np.array([len(p) for p in parts])
    _, column, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    renumber = np.cumsum(times > 1) - 1
    row, column = np.repeat(np.arange(len(parts)), size)[keep], renumber[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(parts), len(parts)), np.float32)
    width = 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        x = np.zeros((len(parts), width), np.float32)
        x[row[a:b], column[a:b] - at] = 1
        common += x @ x.T  # counts below 2**24 are exact
    linked = 7 * common.astype(np.int64) >= 3 * (size[:, None] + size[None, :])
    np.fill_diagonal(linked, False)
    if not own_block:
        linked &= side[:, None] != side[None, :]
    return linked @ weight


def count_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """sig, links: for each class in ``members`` (sig, root, n, weight) the weights of the classes of its component that it links with."""
    members = members.withColumn("bin", F.floor(F.log("n") / math.log(BIN)).cast("int"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("root", "bin").agg(blocks.alias("blocks"), F.count("*").alias("m"), F.sum("n").alias("shingles"))
    whole = (F.sum("m") <= BLOCK_CLASSES) & (F.sum("shingles") <= BLOCK_SHINGLES)
    sizes = materialize(sizes.groupBy("root").agg(whole.alias("whole"), F.sum("shingles").alias("shingles"), F.map_from_entries(F.collect_list(F.struct("bin", "blocks"))).alias("blocks")))  # sizes fall into few bins
    small = int(sizes.where("whole").agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0] // BLOCK_SHINGLES) + 1
    dealt = members.join(sizes.drop("shingles"), "root")
    own = F.pmod(F.col("sig"), F.col("blocks")[F.col("bin")].cast("long")).cast("int")

    def with_bin(step: int) -> Column:
        other = F.try_element_at("blocks", F.col("bin") + step)
        return F.transform(F.sequence(F.lit(0), F.coalesce(other, F.lit(0)) - 1), lambda j: F.struct(
            F.least(F.struct("bin", own.alias("b")), F.struct((F.col("bin") + step).alias("bin"), j.alias("b"))).alias("one"), F.greatest(F.struct("bin", own.alias("b")), F.struct((F.col("bin") + step).alias("bin"), j.alias("b"))).alias("two")))

    none = F.array().cast("array<struct<one:struct<bin:int,b:int>,two:struct<bin:int,b:int>>>")
    some = lambda step: F.when(F.col("blocks")[F.col("bin") + step].isNotNull(), with_bin(step)).otherwise(none) if step else with_bin(0)
    at_once = F.array(F.struct(F.struct(F.lit(-1).alias("bin"), F.lit(0).alias("b")).alias("one"), F.struct(F.lit(-1).alias("bin"), F.lit(0).alias("b")).alias("two")))
    units = F.when(F.col("whole"), at_once).otherwise(F.concat(some(-1), some(0), some(1)))
    rows = dealt.select("sig", "root", "weight", "whole", "bin", own.alias("b"), F.explode(units).alias("unit"))
    # small components share tasks, a pair of blocks of a large one is a task of its own
    deal = F.when(F.col("whole"), F.pmod(F.xxhash64("root"), F.lit(small).cast("long"))).otherwise(F.xxhash64("root", "unit"))
    rows = rows.select("sig", "root", "weight", deal.alias("deal"), F.xxhash64("root", "unit").alias("unit"), (F.col("unit.one") == F.col("unit.two")).alias("own_block"), (F.struct("bin", "b") == F.col("unit.two")).alias("side"))

    def run(held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, unit in held.groupby("unit", sort=False):
            if len(unit) > 1:
                links = _partners([np.asarray(t) for t in unit["tokens"]], unit["weight"].to_numpy(), unit["side"].to_numpy(), bool(unit["own_block"].iloc[0]))
                out.append(pd.DataFrame({"sig": unit["sig"].to_numpy(), "links": links}))
        return pd.concat(out) if out else pd.DataFrame({"sig": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})

    counted = rows.join(sets.select("sig", "tokens").dropDuplicates(["sig"]), "sig").groupBy("deal").applyInPandas(run, "sig long, links long")
    return counted.groupBy("sig").agg(F.sum("links").alias("links"))


def classes_of(docs: DataFrame, with_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """Profiles of the rows (doc_id, key, n, sig), and of each class that is linked or has several rows: sig, class_size,
    first (whether its id is null, the smallest doc_id of the component, the key of its text) and links."""
    spark = small_batches(docs.sparkSession)
    profiles = materialize(profile(docs))
    found = profiles.where("shared is not null").select(F.inline("shared")).groupBy("token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_SHARED).orderBy(F.desc("docs"), "token").limit(MAX_SHARED).toArrow()
    token, count = found.column("token").to_numpy().view(np.uint64), found.column("docs").to_numpy()
    by_token = np.argsort(token)
    shared_tokens = spark.sparkContext.broadcast((token[by_token], count[by_token].astype(np.int32)))  # at most MAX_SHARED
    rows = profiles.where("is_doc").select("doc_id", "key", "n", "sig")
    classes = materialize(profiles.where("sig is not null").groupBy("sig").agg(
        F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"), F.min("key").alias("key"), F.count("*").alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")))

    buckets = _buckets(docs, shared_tokens)
    to_hub = buckets.where(F.col("sig") != F.col("hub.sig")).where(_can_link(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos")))
    links, sets = verify(to_hub.select(F.col("sig").alias("a"), F.col("hub.sig").alias("b"), "n", F.col("hub.n").alias("n2")).distinct(), classes, docs, shared_tokens)
    roots = components(links)

    # in a bucket of two classes the only pair was that with the hub
    known = materialize(buckets.where("size > 2").select("token", "sig", "n", "pos").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")))
    tokens = materialize(known.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token"))
    mixed = known.join(tokens, "token", "left_semi")
    other = mixed.select("token", *(F.col(c).alias(f"{c}2") for c in ("sig", "n", "pos", "root")))
    apart = mixed.join(other, "token").where((F.col("sig") < F.col("sig2")) & (F.col("root") != F.col("root2"))).where(_can_link(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2")))
    more, more_sets = verify(apart.select(F.col("sig").alias("a"), F.col("sig2").alias("b"), "n", "n2").distinct(), classes, docs, shared_tokens)
    first_roots, roots = roots, components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    release(buckets, known, tokens, links, more, first_roots)

    members = materialize(roots.withColumnRenamed("node", "sig").join(classes.select("sig", "n", F.col("class_size").alias("weight"), "first"), "sig"))
    first = materialize(members.groupBy("root").agg(F.min("first").alias("first")))
    linked = members.select("sig", "root").join(first, "root").select("sig", "first")
    out = classes.select("sig", "class_size", F.col("first").alias("own")).join(linked, "sig", "left").where("first is not null or class_size > 1")
    out = out.select("sig", "class_size", F.coalesce("first", "own").alias("first"))
    if with_links:
        counted = materialize(count_links(members.drop("first"), sets.unionByName(more_sets)))
        out = out.join(counted, "sig", "left")
    out = materialize(out)
    release(sets, more_sets, members, first, classes, roots)
    return rows, out


def _with_key(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))


def jaccard_join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_size, n_links (other rows that the row links with, those of its class included) for every row."""
    rows, classes = classes_of(_with_key(documents, id_col, text_col), with_links=True)
    one = F.lit(1).cast("long")
    return rows.join(classes, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.coalesce("class_size", one).alias("class_size"), (F.coalesce("links", F.lit(0)) + F.coalesce("class_size", one) - 1).alias("n_links"))


def one_of_each(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` (doc_id, text, others) with one row of each component, the one of the smallest doc_id; rows without shingles stay.

    Rows whose text is that of no linked or repeated class are told by a Bloom filter on the text's hash and are not moved.
    """
    rows, classes = classes_of(_with_key(documents, "doc_id", text_col))
    key, kept = free_name(documents, "_key"), free_name(documents, "_kept")
    fate = materialize(rows.join(classes, "sig").select(F.col("key").alias(key), F.col("first").alias(kept)).distinct())
    bloom = build_filter(fate, F.col(key))
    lanes = documents.sparkSession.sparkContext.broadcast((bloom.blocks, bloom.lanes))  # at most 8 MB

    def possible(h: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(*lanes.value).probe(h.to_numpy()))

    hit = free_name(documents, "_hit")
    keyed = documents.withColumn(key, F.xxhash64(text_col)).withColumn(hit, F.pandas_udf(possible, "boolean")(key))
    judged = keyed.where(F.col(hit)).join(fate, key, "left")
    chosen = F.col(f"{kept}.key").eqNullSafe(F.col(key)) & F.col(f"{kept}.doc_id").eqNullSafe(F.col("doc_id").cast("long"))
    free = keyed.where(~F.col(hit)).select(*documents.columns).unionByName(judged.where(F.col(kept).isNull()).select(*documents.columns))
    return free.unionByName(judged.where(F.col(kept).isNotNull() & chosen).dropDuplicates(["doc_id", key]).select(*documents.columns))


def op3(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))
