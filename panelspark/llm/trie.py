"""Conversation prefix trie: the tree of all beginnings of the rebuilt conversations.

Conversation c is rebuilt from the first h turns of conversation c - c % 100 and its own turns after the first h, with
h = crc32 of the decimal c, modulo 6. A node is a distinct sequence of first turns; its key is the exclusive or of a
128-bit hash of (place, turn) over its turns, so keys of longer prefixes follow from shorter ones by any grouping.

Fixed-length block hashing: turns are cut into blocks of ``BLOCK`` turns. Conversations are grouped by the digests of their
successive blocks first: a class is all conversations that agree up to the end of a block. Where a class has one block after
it only, every turn of that block has the members of the block. Where siblings diverge, the turns of the sibling classes
(not of the conversations) are grouped by their keys.

Sums over a subtree need no walk through the tree: each node is owned by its smallest member, whose nodes are the end of its
path. A conversation adds what its own nodes hold to every node on its path, so a sum over a subtree is a sum over
members. Only conversations that own a node have a part in it.

No window or list holds more than ``CHUNK`` turns of a conversation or ids of a node: places and running sums are made in
chunks, and chunks are added up. Texts are hashed where they are read and never moved.

Edge cases: turns of one number are ordered by the md5 of role and text, null numbers come first; null roles and texts are empty
strings; rows with a null conv_id take no part; repeated rows are turns of their own; very long texts and very long
conversations are whole; an empty table has no node, not even the root. ``c % 100`` keeps the sign of c. Other columns are
not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import materialize, release, table

#: Turns of a block, turns of a conversation (or ids of a node) that are handled together, and how conversations share turns. The last two are the query's.
BLOCK, CHUNK, FAMILY, MOST_SHARED = 4, 4096, 100, 6
NODE = ["depth", "k1", "k2"]


def _digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), digest, chars of every turn. Rows are dealt to ranges of (conversation, turn), so a long conversation has several tasks."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), _digest(F.col(role_col), F.col(text_col)).alias("digest"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("chars"))
    rows = rows.where("conv is not null").withColumn("row", F.monotonically_increasing_id())
    order = ["conv", F.col("turn").asc_nulls_first(), "digest", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i"))
    dealt = materialize(dealt)
    runs = dealt.groupBy("conv", "part").agg(F.min("i").alias("least"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("conv", "part", (before - F.col("least") + 1).alias("shift"))
    made = materialize(dealt.join(runs, ["conv", "part"]).select("conv", (F.col("i") + F.col("shift")).alias("pos"), "digest", "chars"))
    release(dealt)
    return made


def rebuilt(turns: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv, pos, digest, chars), and conv, len of every conversation, turnless ones too."""
    lengths = turns.groupBy("conv").agg(F.count("*").alias("n"))
    first = F.struct("pos", "digest", "chars")
    heads = turns.where(F.col("pos") < most).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(first)).alias("head"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).cast("int")
    convs = lengths.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % family}).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:string,chars:bigint>>")), F.lit(1), F.col("h"))
    convs = convs.withColumn("head", head).withColumn("m", F.size("head"))
    convs = materialize(convs.select("conv", "h", "m", "head", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    own = turns.join(convs.select("conv", "h", "m"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "digest", "chars")
    shared = convs.select("conv", F.inline("head"))
    return own.unionByName(shared), convs.select("conv", "len")


def _running(df: DataFrame, keys: list[str], place: str, sums: dict[str, tuple[str, str]], chunk: int, backward: bool = False) -> DataFrame:
    """``df`` with running aggregates of its keys up to each row, in order of ``place``: name -> (function, column). Rows of a key are
    taken in chunks of ``chunk`` places; then each chunk gets what the chunks before it hold."""
    sign = -1 if backward else 1
    df = df.withColumn("_chunk", F.floor(F.col(place) * sign / chunk))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(F.col(place) * sign).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({f"_{n}": F.expr(f"{fn}({c})").over(inside) for n, (fn, c) in sums.items()})
    whole = df.groupBy(*keys, "_chunk").agg(*(F.expr(f"{fn}({c})").alias(n) for n, (fn, c) in sums.items()))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*keys, "_chunk", *(F.coalesce(F.expr(f"{fn}({n})").over(earlier), F.lit(0)).alias(n) for n, (fn, _) in sums.items()))
    plus = {"bit_xor": lambda a, b: a.bitwiseXOR(b), "sum": lambda a, b: a + b}
    joined = local.join(whole, [*keys, "_chunk"])
    return joined.select(*(F.col(c) for c in df.columns if c != "_chunk"), *(plus[fn](F.col(n), F.col(f"_{n}")).alias(n) for n, (fn, _) in sums.items()))


def blocks_of(turns: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """conv, block, k1 and k2 (key of the prefix that ends with the block), p1 and p2 (key of the prefix before it), turns (depth, a, b, chars: at most ``block``)."""
    hashed = turns.select("conv", F.floor((F.col("pos") - 1) / block).alias("block"), F.struct(F.col("pos").alias("depth"), F.xxhash64(F.lit(1), "pos", "digest").alias("a"), F.xxhash64(F.lit(2), "digest", "pos").alias("b"), "chars").alias("t"))
    made = hashed.groupBy("conv", "block").agg(F.sort_array(F.collect_list("t")).alias("turns"), F.bit_xor("t.a").alias("a"), F.bit_xor("t.b").alias("b"))
    made = _running(made, ["conv"], "block", {"k1": ("bit_xor", "a"), "k2": ("bit_xor", "b")}, chunk)
    return made.select("conv", "block", "k1", "k2", F.col("k1").bitwiseXOR(F.col("a")).alias("p1"), F.col("k2").bitwiseXOR(F.col("b")).alias("p2"), "turns")


def _nodes_in(turns: str, p1: str, p2: str) -> Column:
    """The nodes along the turns of a block: depth, key, key of the parent, chars."""

    def key(upto, start, part):
        return F.aggregate(F.slice(turns, F.lit(1), upto), F.col(start), lambda k, t: k.bitwiseXOR(t[part]))

    return F.transform(turns, lambda t, i: F.struct(t["depth"].alias("depth"), key(i + 1, p1, "a").alias("k1"), key(i + 1, p2, "b").alias("k2"), key(i, p1, "a").alias("u1"), key(i, p2, "b").alias("u2"), t["chars"].alias("chars")))


def nodes_of(blocks: DataFrame) -> DataFrame:
    """depth, k1, k2, u1, u2 (the parent), chars, conv_id (smallest member), n_convs of every node but the root."""
    classes = blocks.groupBy("block", "k1", "k2", F.size("turns").alias("size")).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("turns").alias("turns"))
    classes = materialize(classes)
    later = classes.where("block > 0")  # the first blocks have one parent, the root: they are refined, whatever their number
    siblings = later.groupBy("block", "p1", "p2").agg(F.count("*").alias("siblings"))
    both = later.join(siblings, ["block", "p1", "p2"]).select(*classes.columns, "siblings").unionByName(classes.where("block = 0").withColumn("siblings", F.lit(2).cast("long")))
    turned = both.select("siblings", "conv_id", "n_convs", F.inline(_nodes_in("turns", "p1", "p2")))
    alone = turned.where("siblings = 1")
    split = turned.where("siblings > 1").groupBy(*NODE).agg(F.min("u1").alias("u1"), F.min("u2").alias("u2"), F.min("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    return alone.select(*split.columns).unionByName(split)


def ends_of(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """depth, k1, k2, n_ends, ends_sha256 of the nodes where conversations end (conv, depth, k1, k2). Ids are listed in ranges of at
    most ``chunk`` values; a node with several ranges has them hashed one after another, in one pass that keeps none."""
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")))
    lists = materialize(ends.groupBy(*NODE, (F.col("conv") - F.pmod("conv", F.lit(chunk))).alias("range")).agg(ids.alias("ids"), F.count("*").alias("n")))
    per = lists.groupBy(*NODE).agg(F.count("*").alias("ranges"), F.min("ids").alias("ids"), F.sum("n").alias("n_ends"))
    long = per.where("ranges > 1").select(*NODE)

    def run(batches):
        key = made = None
        for batch in batches:
            out = []
            for *k, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if key is not None:
                        out.append((*key, made.hexdigest()))
                    key, made = k, hashlib.sha256(ids.encode())
                else:
                    made.update(b"," + ids.encode())
            yield _hashes(out)
        if key is not None:
            yield _hashes([(*key, made.hexdigest())])

    def _hashes(rows):
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*NODE, "streamed"])

    streamed = lists.join(long, NODE).select(*NODE, "range", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "range").mapInArrow(run, "depth long, k1 long, k2 long, streamed string")
    return per.join(streamed, NODE, "left").select(*NODE, "n_ends", F.coalesce("streamed", F.sha2(F.col("ids").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, family: int = FAMILY, most: int = MOST_SHARED, block: int = BLOCK, chunk: int = CHUNK, **columns: str) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = numbered(conversations, **columns)
    joined, lengths = rebuilt(turns, family, most)
    blocks = materialize(blocks_of(joined, block, chunk))
    release(turns)
    last = blocks.select("conv", "k1", "k2", F.element_at("turns", -1)["depth"].alias("depth"))
    ends = lengths.join(last, (lengths["conv"] == last["conv"]) & (lengths["len"] == last["depth"]), "left").select(lengths["conv"], F.col("len").cast("long").alias("depth"), F.coalesce("k1", F.lit(0)).alias("k1"), F.coalesce("k2", F.lit(0)).alias("k2"))
    root = lengths.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*(F.lit(0).cast("long").alias(c) for c in NODE), *(F.lit(None).cast("long").alias(c) for c in ("u1", "u2")), F.lit(0).cast("long").alias("chars"), "conv_id", "n_convs")
    nodes = nodes_of(blocks).unionByName(root).join(ends_of(ends, chunk), NODE, "left")
    nodes = nodes.withColumns({"n_ends": F.coalesce("n_ends", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)), "value": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = materialize(nodes.withColumn("leaf", (F.col("n_ends") == F.col("n_convs")).cast("long")))
    # what a conversation's own nodes hold, from each of them to the end of its path
    own = _running(nodes.where("depth > 0").select(*NODE, "conv_id", "value"), ["conv_id"], "depth", {"saved": ("sum", "value")}, chunk, backward=True)
    owners = nodes.where("depth > 0").groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.sum("value").alias("all_saved"), F.max("leaf").alias("leaf"))
    owners = materialize(owners)
    above = blocks.join(owners, F.col("conv") == F.col("conv_id")).where(F.element_at("turns", 1)["depth"] < F.col("own_from"))
    above = above.select("own_from", "all_saved", "leaf", F.inline(_nodes_in("turns", "p1", "p2"))).where("depth < own_from").select(*NODE, F.col("all_saved").alias("saved"), F.col("leaf").alias("leaves"))
    whole = owners.select(*(F.lit(0).cast("long").alias(c) for c in NODE), F.col("all_saved").alias("saved"), F.col("leaf").alias("leaves"))
    own = own.select(*NODE, "saved", F.lit(0).cast("long").alias("leaves"))
    none = F.lit(0).cast("long")
    parts = [above.withColumn("children", none), whole.withColumn("children", none), own.withColumn("children", none), nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2"), none.alias("saved"), none.alias("leaves"), F.lit(1).cast("long").alias("children"))]
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    sums = together.groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("more_leaves"), F.sum("children").alias("n_children"))
    # a node's own leaf comes from its owner, who counts above the own nodes only
    owned = owners.select(F.col("conv_id").alias("owner"), F.col("leaf").alias("own_leaf"))
    made = nodes.join(sums, NODE, "left").join(owned, F.col("conv_id") == F.col("owner"), "left")
    leaves = F.coalesce("more_leaves", F.lit(0)) + F.when(F.col("depth") > 0, F.col("own_leaf")).otherwise(F.lit(0))
    leaves = F.when((F.col("depth") == 0) & (F.coalesce("n_children", F.lit(0)) == 0), F.lit(1)).otherwise(leaves)
    parents = nodes.select(F.col("depth").alias("_d"), F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.col("conv_id").alias("parent_conv_id"))
    made = made.join(parents, (F.col("_d") == F.col("depth") - 1) & (F.col("_1") == F.col("u1")) & (F.col("_2") == F.col("u2")), "left")
    return made.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), leaves.alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), "ends_sha256")


#: crc32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
lambda acc, b: list_reduce(list_prepend(xor(acc, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

SQL = f"""WITH t AS (SELECT conv_id AS c, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, coalesce(length(text), 0) AS l, turn FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT c, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(l ORDER BY turn NULLS FIRST, k) AS ls FROM t GROUP BY c),
h AS (SELECT *, CAST({_CRC} % {MOST_SHARED} AS BIGINT) AS h FROM g),
r AS (SELECT h.c, list_concat(coalesce(b.ks[1:h], []), h.ks[h + 1:]) AS ks, list_concat(coalesce(b.ls[1:h], []), h.ls[h + 1:]) AS ls FROM h LEFT JOIN g b ON b.c = h.c - h.c % {FAMILY}),
p AS (SELECT c, d, ks, array_to_string(ks[1:d], '') AS k, CASE WHEN d > 0 THEN ls[d] ELSE 0 END AS l, len(ks) = d AS last FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM r)),
n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(ks) AS ks, count(*) * any_value(l) - any_value(l) AS saved, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last) AS ids, count(*) FILTER (NOT last) = 0 AS leaf FROM p GROUP BY d, k),
up AS (SELECT a, array_to_string(ks[1:a], '') AS k, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves, count(*) FILTER (d = a + 1) AS children FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM n) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM n JOIN up ON up.a = n.d AND up.k = n.k LEFT JOIN n u ON u.d = n.d - 1 AND u.k = array_to_string(n.ks[1:n.d - 1], '')"""


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
