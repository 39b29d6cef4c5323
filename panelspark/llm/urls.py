"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

``judge`` gives every page the verdict of its longest fitting rule. Pages that no rule fits are looked up by
their canonical URL in a list: a blocked Bloom filter (one block of 256 bits a URL, eight bits each) passes
possible hits to an exact hash join, which removes the false positives. The filter takes at most
``MAX_BLOCKS`` blocks (8 MB), whatever the list's length; a longer list only passes more rows to the join.

A canonical URL has no scheme, user, port, trailing dot or leading ``www.``, no query and fragment, and no
trailing slashes; A-Z in the host are lower-cased.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule, is on no list and is
allowed. Repeated rows are judged alike, extra columns are not read, very long urls are read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, table

#: (verdict, rule); fixed values of the query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MAX_RULES, MAX_BLOCKS, BITS_A_URL = 256, 1 << 18, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Canonical URL of a host and a path; null for an empty host."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    name = F.regexp_replace(name, r"^www\.", "")
    return F.when(name != "", F.concat(name, F.regexp_replace(path, r"/+$", "")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and the four 64-bit lanes with its eight bits set."""
    h = h.view(np.uint64)
    block = (h >> np.uint64(40)) % np.uint64(blocks)
    lanes = np.zeros((len(h), 4), np.uint64)
    for k in range(8):
        bit = (h >> np.uint64(5 * k)) & np.uint64(31)
        lanes[:, k % 4] |= np.uint64(1) << (bit + np.uint64(32 * (k // 4)))
    return block.astype(np.int64), lanes


class BlockedBloom:
    def __init__(self, blocks: int, lanes: np.ndarray):
        self.blocks, self.lanes = blocks, lanes

    def probe(self, h: np.ndarray) -> np.ndarray:
        block, want = _bits(h, self.blocks)
        return ((self.lanes[block] & want) == want).all(1)


def build_filter(listed: DataFrame, key: Column) -> BlockedBloom:
    """A filter of the well-mixed 64-bit ``key``. Set the bits on the executors, OR the blocks together, bring the blocks (bounded) to the driver."""
    n = listed.count()
    blocks = min(MAX_BLOCKS, max(1, -(-n * BITS_A_URL // 256)))

    def run(parts):
        for part in parts:
            block, lanes = _bits(part["h"].to_numpy(), blocks)
            yield pd.DataFrame({"block": block} | {f"l{i}": lanes[:, i].view(np.int64) for i in range(4)})

    rows = listed.select(key.alias("h")).mapInPandas(run, "block long, l0 long, l1 long, l2 long, l3 long")
    got = rows.groupBy("block").agg(*(F.bit_or(f"l{i}").alias(f"l{i}") for i in range(4))).toArrow()
    lanes = np.zeros((blocks, 4), np.uint64)
    if got.num_rows:
        lanes[got.column("block").to_numpy()] = np.stack([got.column(f"l{i}").to_numpy().view(np.uint64) for i in range(4)], 1)
    return BlockedBloom(blocks, lanes)


def on_list(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows`` with hit: is their ``canonical`` in ``listed`` (distinct, not null)? Each row comes out once."""
    bloom = build_filter(listed, F.xxhash64("canonical"))
    shared = rows.sparkSession.sparkContext.broadcast((bloom.blocks, bloom.lanes))  # at most 8 MB

    def possible(h: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(*shared.value).probe(h.to_numpy()))

    rows = rows.withColumn("possible", F.col("canonical").isNotNull() & F.pandas_udf(possible, "boolean")(F.xxhash64("canonical")))
    exact = listed.select(F.col("canonical").alias("listed"))
    found = rows.where("possible").join(exact, F.col("canonical") == F.col("listed"), "left").select(*rows.columns, F.col("listed").isNotNull().alias("hit"))
    return found.unionByName(rows.where("not possible").withColumn("hit", F.lit(False))).drop("possible")


def judge(pages: DataFrame, rules=RULES, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed for every page.

    ``listed`` has a column ``canonical``. Without it, the list is made from the pages themselves: the
    canonical form of every url that a block rule fits, so that the same page under another spelling (user,
    port, trailing dot) is blocked too.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, ruling = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.select("*", rule.alias("rule"), ruling.alias("ruling"), canonical(F.col("host"), F.col("path")).alias("canonical"))
    if listed is None:
        listed = parts.where("ruling = 'block'").select("canonical")
    listed = materialize(listed.where("canonical is not null").select("canonical").distinct())
    ruled = parts.where("rule is not null").withColumn("hit", F.lit(False))
    free = on_list(parts.where("rule is null"), listed)
    verdict = F.coalesce("ruling", F.when(F.col("hit"), "block").otherwise("allow"))
    return ruled.unionByName(free).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canonical", "hit")


def op5(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


_CASES = {k: "CASE " + " ".join(f"WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{v if k == 'ruling' else t}'" for v, t in sorted(RULES, key=lambda r: -len(r[1]))) + " END" for k in ("rule", "ruling")}
SQL = rf"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
  SELECT *, {_CASES["rule"]} AS rule, {_CASES["ruling"]} AS ruling,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.+$', ''), '^www\.', '') AS name FROM parts),
canon AS (SELECT *, CASE WHEN name <> '' THEN name || regexp_replace(path, '/+$', '') END AS canonical FROM ruled),
listed AS (SELECT DISTINCT canonical AS c FROM canon WHERE ruling = 'block' AND canonical IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN c IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, canonical,
  rule IS NULL AND c IS NOT NULL AS hit
FROM canon LEFT JOIN listed ON canonical = c
"""
