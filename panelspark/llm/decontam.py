"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A mask is a fixed pattern over at most ``SPAN`` neighbouring words that samples some of them and ignores the others. The
sampled words of every window of every text are hashed and joined with the hashes of the benchmark items.
Around a hit the text and the item are laid side by side, and the hit counts if some run of at least ``MIN_RUN``
neighbouring words (within ``REACH`` words on either side of the window, inside the item) has at least ``MIN_SHARE``
equal words. The masks hit every such run, so what is in no run is all that is left out. An item of fewer words
than ``MIN_RUN`` is compared whole, with masks of its own that hit every share from ``MIN_SHARE``.

Words are runs of characters other than white space (space and characters 9 to 13), A-Z lower-cased.

The seeds of the benchmark are broadcast while there are at most ``MAX_BROADCAST_SEEDS`` of them (counted
first); a larger benchmark is joined by a shuffle on the seed, and texts with hits are fetched again. Both ways
verify every hit.

Edge cases: null or empty texts, and null or empty items, match nothing. Rows are judged by id and text, so repeated rows and
null ids keep their own verdicts. Items are told by id and text: one without an id flags texts as any other, but no id is listed
for it; repeated items count once. Windows cover very long texts whole. An empty benchmark flags nothing.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .common import table

#: Offsets of the sampled words. A search over all masks of five words found these: of 11 to 21 words (see REACH) with any
#: quarter unequal, rounded down, one of them samples equal words only.
MASKS = ((0, 1, 2, 6, 8), (0, 3, 4, 5, 6), (0, 1, 2, 4, 5), (0, 1, 4, 6, 9))
SPAN, MIN_SHARE, MAX_BROADCAST_SEEDS = 10, 0.75, 1_000_000
#: A run of twice MIN_RUN words falls into two, one of them with as great a share, so shorter ones are enough.
MIN_RUN, REACH = 11, 20


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks for an item of n words, fewer than MIN_RUN: of four blocks, all but as many as words may be unequal."""
    blocks = [range(n * k // 4, n * (k + 1) // 4) for k in range(4)]
    kept = (sorted(i for block in some for i in block) for some in combinations(blocks, 4 - n // 4))
    return sorted({tuple(i - offsets[0] for i in offsets) for offsets in kept})


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words; null for a text without words."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
    words = F.filter(F.split(low, " "), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(hashes) > 0, hashes)


def seeds(df: DataFrame, hashes: str, masks: list[tuple[int, ...]], only: dict[int, Column] | None = None) -> DataFrame:
    """One row for each window of each row of ``df``: its columns, at and seed. A mask in ``only`` has the condition where it counts."""
    n = F.size(hashes)
    places = df.select("*", F.explode_outer(F.sequence(F.lit(0), n - 1)).alias("at"))
    fits = [(F.col("at") + m[-1] < n) & (only or {}).get(k, F.lit(True)) for k, m in enumerate(masks)]
    made = [F.when(fit, F.xxhash64(F.lit(k), *(F.get(hashes, F.col("at") + i) for i in m))) for k, (fit, m) in enumerate(zip(fits, masks, strict=True))]
    return places.select("*", F.explode_outer(F.array(*made)).alias("seed")).where("seed is not null")


def surroundings(words: Column, at: Column) -> list[Column]:
    """near, near_at: the words that a hit at ``at`` is compared with, and the place of ``at`` among them. All hits of a text are held
    at once, so each of them takes these few words and not the text."""
    first = F.greatest(F.lit(0), at - REACH)
    return [F.slice(words, first + 1, at + SPAN + REACH - first).alias("near"), (at - first).alias("near_at")]


def share_equal(words: Column, item: Column, at: Column, item_at: Column) -> Column:
    """Share of equal words in the best run near a hit, 0 if none is good enough, when the item's word ``item_at`` lies on the text's word ``at``.
    ``words`` are those of the text or of the ``surroundings``, with ``at`` counted in them.

    A run is ``MIN_RUN`` or more neighbouring words of the item, or the whole of a shorter item; words of the item
    outside the text count as unequal. The best run has the greatest score: 1 for each equal word, less 3 for
    each other one, so that 0 stands for a share of 0.75. MIN_RUN equal words in a row at the hit are 1.0 at once.
    """
    least = F.least(F.size(item), F.lit(MIN_RUN))
    low = F.greatest(F.lit(0), item_at - REACH)
    high = F.least(F.size(item), item_at + SPAN + REACH) - 1
    unit = 1 << 20  # a run as one number: score * unit + equal words
    loss = round(MIN_SHARE / (1 - MIN_SHARE))
    step = lambda i: F.when((at - item_at + i >= 0) & (F.get(words, F.greatest(F.lit(0), at - item_at + i)) == F.get(item, i)), F.lit(unit + 1).cast("long")).otherwise(F.lit(-loss * unit).cast("long"))

    def best_run(steps):
        def add(s, k):
            last = s["last"] + F.get(steps, k) - F.when(k >= least, F.get(steps, F.greatest(F.lit(0), k - least))).otherwise(F.lit(0).cast("long"))
            ending = F.greatest(s["ending"] + F.get(steps, k), F.when(k >= least - 1, last))
            return F.struct(last.alias("last"), ending.alias("ending"), F.greatest(s["best"], ending).alias("best"))

        none = F.struct(F.lit(0).cast("long").alias("last"), F.lit(None).cast("long").alias("ending"), F.lit(None).cast("long").alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(steps) - 1), none, add)["best"]

    best = F.transform(F.array(F.transform(F.sequence(low, high), step)), best_run)  # an array of one, so that its parts are made once

    def share(code):
        equal = F.pmod(code, F.lit(unit))
        score = (code - equal) / unit
        return F.when(score >= 0, equal / (((1 + loss) * equal - score) / loss)).otherwise(0.0)

    first = F.least(item_at, F.size(item) - least)
    from_word = at - item_at + first
    plain = (from_word >= 0) & (F.slice(words, F.greatest(F.lit(0), from_word) + 1, least) == F.slice(item, first + 1, least))
    return F.when(plain, 1.0).otherwise(F.get(F.transform(best, share), 0))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, text_key, item_id, at, item_at, share: the best verified overlap of each row and item."""
    item_key = F.xxhash64(item_col, item_text_col).alias("item_key")  # ids can be null or repeat
    items = benchmark.select(F.col(item_col).alias("item_id"), item_key, word_hashes(F.col(item_text_col)).alias("item")).where("item is not null").dropDuplicates(["item_key"])
    sizes = items.groupBy(F.least(F.size("item"), F.lit(MIN_RUN)).alias("n")).agg(F.sum(F.size("item")).alias("words")).collect()  # at most MIN_RUN rows
    masks_of = {r["n"]: list(MASKS) if r["n"] == MIN_RUN else short_masks(r["n"]) for r in sizes}
    masks = sorted({m for some in masks_of.values() for m in some})
    small = sum(r["words"] * len(masks_of[r["n"]]) for r in sizes) <= MAX_BROADCAST_SEEDS
    hint = F.broadcast if small else lambda df: df
    own = {k: F.least(F.size("item"), F.lit(MIN_RUN)).isin([n for n, some in masks_of.items() if m in some]) for k, m in enumerate(masks)}
    if not masks:
        masks, own = [MASKS[0]], {}
    listed = seeds(items, "item", masks, own).select("item_key", "seed", F.col("at").alias("item_at"))
    key = F.xxhash64(text_col).alias("text_key")
    rows = docs.select(F.col(id_col).alias("doc_id"), key, word_hashes(F.col(text_col)).alias("words")).where("words is not null")
    windows = seeds(rows, "words", masks).select("doc_id", "text_key", *(["words"] if small else []), "seed", "at")
    hits = windows.join(hint(listed), "seed")
    if small:
        hits = hits.select("doc_id", "text_key", "item_key", "at", "item_at", *surroundings(F.col("words"), F.col("at")))
    else:
        hits = hits.groupBy("doc_id", "text_key", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("item_at").alias("places"))
        once = rows.dropDuplicates(["doc_id", "text_key"])
        hits = hits.alias("h").join(once.alias("r"), F.col("h.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("h.text_key") == F.col("r.text_key"))).select("h.*", "r.words")
        at = F.col("item_at") + F.col("shift")
        hits = hits.select("*", F.explode("places").alias("item_at")).select("doc_id", "text_key", "item_key", at.alias("at"), "item_at", *surroundings(F.col("words"), at))
    share = share_equal(F.col("near"), F.col("item"), F.col("near_at"), F.col("item_at"))
    sure = hits.join(hint(items), "item_key").select("doc_id", "text_key", "item_id", "at", "item_at", share.alias("share")).where(F.col("share") >= MIN_SHARE)
    return sure.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("share", "at", "item_at")).alias("best")).select("doc_id", "text_key", "item_id", "best.*")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each row with an overlap: doc_id, text_key, item_ids (sorted), share (the best)."""
    return overlaps(docs, benchmark).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.max("share").alias("share"))


def flag(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids, share for every row."""
    found = contamination(docs, benchmark).alias("f")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key")).alias("d")
    joined = rows.join(found, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key")), "left")
    none = F.array().cast("array<bigint>")
    return joined.select("d.doc_id", F.col("share").isNotNull().alias("contaminated"), F.coalesce(F.col("item_ids").cast("array<bigint>"), none).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item."""
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_key"]), "left_anti")


def op4(spark, sf_dir):
    return flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
