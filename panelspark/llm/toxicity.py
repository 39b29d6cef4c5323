"""Toxicity by weak supervision.

Voters are a fixed lexicon of insults, patterns mined from labelled training rows (words and word beginnings
of 5 to 8 bytes that occur almost only in toxic texts, dealt into several lists of each kind), shouting, and
two that vote against: no pattern at all, and a long text with none. A voter votes for, against or abstains. A
generative label model (``label_model``) estimates the voters' accuracies and correlations by expectation maximisation
without looking at labels; only the share of toxic texts comes from them. The posteriors are
the targets of a linear classifier (logistic regression) over the single patterns, which scores every text.

The training sample is bounded: ``TRAIN_ROWS`` labelled rows drawn by a hash of the id, of any length.

Edge cases: null and empty texts, and texts without a pattern, get the classifier's base score. Without
labels, or without toxic ones, the fixed lexicon alone votes. A document labelled twice counts as its larger label. Repeated
rows are scored alike; very long texts are scored whole; labels of unknown documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, fold_ascii, free_name, non_letters, small_batches, table, text_slices
from .langid import fold_of

#: Fixed lexicon of English insults.
LEXICON = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumb", "retard", "filth", "vermin")
TRAIN_ROWS, MAX_PATTERNS, PREFIXES, LISTS = 8000, 512, (5, 6, 7, 8), 3
KINDS = len(PREFIXES) + 1
#: Least share of toxic texts among those with a mined pattern; share of toxic texts where no label tells it.
MIN_PRECISION, DEFAULT_SHARE = 0.8, 0.05
#: How often a voter is believed to be right before any text is seen.
BELIEF = 0.9


def patterns_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and word beginnings: document, kind (0: the word, k: its k-th prefix length), hash."""
    words = Words(data, bounds, non_letters(), fold_ascii())
    doc, kind, value = [words.doc], [np.zeros(len(words.doc), np.int8)], [words.hash]
    for k, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(words.end - words.start >= size)
        doc.append(words.doc[long])
        kind.append(np.full(len(long), k, np.int8))
        value.append(words.span_hash(words.start[long], words.start[long] + size))
    value = [v ^ np.uint64(k) for k, v in enumerate(value)]
    return np.concatenate(doc), np.concatenate(kind), np.concatenate(value)


def lexicon_hashes() -> np.ndarray:
    data = " ".join(LEXICON).encode()
    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), non_letters(), fold_ascii())
    return words.hash ^ np.uint64(0)


def pattern_counts(sample: DataFrame) -> DataFrame:
    """pattern, kind, toxic, clean: in how many sampled texts of either label each pattern occurs."""

    def run(batches):
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for at, to, data, bounds in text_slices(batch.column(0)):
                doc, kind, value = patterns_of(data, bounds)
                order = np.lexsort((doc, value))
                doc, kind, value = doc[order], kind[order], value[order]
                first = np.ones(len(value), bool)
                first[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                doc, kind, value = doc[first], kind[first], value[first]
                key, start = np.unique(value, return_index=True)
                bad = (label[at:to] == 1)[doc].astype(np.int64)
                toxic = np.add.reduceat(bad, start) if len(start) else bad
                total = np.diff(np.append(start, len(value)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind[start].astype(np.int32)), pa.array(toxic), pa.array(total - toxic)], ["pattern", "kind", "toxic", "clean"])

    rows = sample.select("text", "toxic").mapInArrow(run, "pattern long, kind int, toxic long, clean long")
    return rows.groupBy("pattern", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def hits_of(data: np.ndarray, bounds: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, index of pattern) for every pattern that a text has, once each. ``patterns`` are sorted."""
    doc, _, value = patterns_of(data, bounds)
    maybe = np.zeros(1 << 16, bool)
    maybe[(patterns & np.uint64(0xFFFF)).astype(np.int64)] = True
    some = np.flatnonzero(maybe[(value & np.uint64(0xFFFF)).astype(np.int64)])
    doc, value = doc[some], value[some]
    at = np.minimum(np.searchsorted(patterns, value), len(patterns) - 1)
    hit = patterns[at] == value
    pairs = np.unique(doc[hit] * len(patterns) + at[hit])
    return pairs // len(patterns), pairs % len(patterns)


@dataclass
class LabelModel:
    """Fitted label model: posterior of class 1 for each row of votes, accuracy of each voter (how often the class is
    what it votes, where it votes), and for each voter its parent (-1: none) and the correlation with it given the class."""

    post: np.ndarray
    accuracy: np.ndarray
    parent: np.ndarray
    correlation: np.ndarray


def _tree(tables: np.ndarray, least: float | None) -> np.ndarray:
    """Parents of the voters in the tree of greatest mutual information given the class; links below ``least`` are cut,
    or without it those of voters that tell less than half of each other.

    ``tables`` [class, voter, vote, voter, vote] are joint shares."""
    single = np.einsum("yjvjv->yjv", tables)
    share = single.sum(2)[:, 0]
    if least is None:
        whole = single.sum(0)
        entropy = -np.where(whole > 0, whole * np.log(np.maximum(whole, 1e-12)), 0).sum(1)
    apart = single[:, :, :, None, None] * single[:, None, None, :, :] / np.maximum(share, 1e-12)[:, None, None, None, None]
    gain = np.where(tables > 1e-12, tables * np.log(np.maximum(tables, 1e-12) / np.maximum(apart, 1e-12)), 0).sum((0, 2, 4))
    m = len(gain)
    if least is None:
        least = 0.0
        gain = np.where(gain >= 0.5 * np.minimum(entropy[:, None], entropy[None, :]) + 1e-9, gain, -1.0)
    parent, best, near, out = np.full(m, -1), gain[0].copy(), np.zeros(m, int), set(range(1, m))
    while out:
        j = max(out, key=lambda i: (best[i], -i))
        parent[j] = near[j] if best[j] >= least else -1
        out.discard(j)
        closer = gain[j] > best
        best, near = np.where(closer, gain[j], best), np.where(closer, j, near)
    return parent


def _fit_votes(votes: np.ndarray, count: np.ndarray, balance: float, rounds: int, first_tree: int) -> LabelModel:
    """The fitted model of one start, whose first tree comes in the round ``first_tree``."""
    n, m = votes.shape
    one_hot = (votes[:, :, None] == np.array([-1, 0, 1])).reshape(n, 3 * m).astype(float)
    index = votes.astype(int) + 1
    total = count.sum()
    tables = ((one_hot * count[:, None]).T @ one_hot).reshape(1, m, 3, m, 3) / total
    parent = _tree(tables, None)
    group = np.arange(m)
    for j in np.flatnonzero(parent >= 0).tolist() * m:  # the group of a voter is that of its topmost ancestor
        group[j] = group[parent[j]]
    vote = votes @ (1 / np.bincount(group, minlength=m)[group])
    post = np.where(vote > 0, 0.9, np.where((votes > 0).any(1), 0.5, 0.05))
    parent = np.full(m, -1)
    for step in range(rounds):
        weight = np.stack([count * (1 - post), count * post])
        tables = np.stack([(one_hot * w[:, None]).T @ one_hot for w in weight]).reshape(2, m, 3, m, 3)
        single = np.einsum("yjvjv->yjv", tables)
        if step % 5 == first_tree:
            parent = _tree(tables / total, 4 * np.log(total + 2) / total)
        joint = np.log([1 - balance, balance])[:, None] + np.zeros(n)
        for j in range(m):
            own = (single[:, j] + 0.5) / (single[:, j].sum(1, keepdims=True) + 1.5)  # class, vote
            if parent[j] < 0:
                p = own[:, index[:, j]]
            else:  # rare cases of the parent lean on the table without it
                given = (tables[:, parent[j], :, j, :] + 2 * own[:, None, :]) / (tables[:, parent[j], :, j, :].sum(2, keepdims=True) + 2)
                p = given[:, index[:, parent[j]], index[:, j]]
            joint += np.log(p)
        new = 1 / (1 + np.exp(-np.clip(joint[1] - joint[0], -30, 30)))
        if step > 10 and np.abs(new - post).max() < 1e-6:
            break
        post = new
    cast = votes != 0
    right = np.where(votes > 0, post[:, None], 1 - post[:, None]) * cast
    correlation = np.zeros(m)
    for j in np.flatnonzero(parent >= 0):
        rest = [(v - np.average(v, weights=w)) for w in (count * post + 1e-9, count * (1 - post) + 1e-9) for v in (votes[:, j], votes[:, parent[j]])]
        mixed = [post * a + (1 - post) * b for a, b in ((rest[0], rest[2]), (rest[1], rest[3]))]
        spread = np.sqrt((count * mixed[0] ** 2).sum() * (count * mixed[1] ** 2).sum())
        correlation[j] = (count * mixed[0] * mixed[1]).sum() / spread if spread > 0 else 0.0
    return LabelModel(post, (count @ right) / np.maximum(count @ cast, 1e-9), parent, correlation)


def label_model(votes: np.ndarray, count: np.ndarray, balance: float = 0.5, rounds: int = 40) -> LabelModel:
    """Generative model of votes (1 for, -1 against, 0 abstains) that occur ``count`` times, fitted without labels.

    A class is drawn with probability ``balance``; each voter then votes by a table of its own, which depends on the class
    and on the vote of one other voter, its parent. Parents are the tree of greatest mutual information given the class, and
    voters that know no more of each other than chance explains have none, so voters that are alike are not counted as
    witnesses of their own. Expectation maximisation starts from the majority of the votes, in which voters that all but
    copy each other share one vote, twice: with
    the tree at once, and after some rounds without. A class can be many things; the fit stays that believes the voters more.
    """
    models = [_fit_votes(votes, count, balance, rounds, first_tree) for first_tree in (3, 0)]
    cast = count @ (votes != 0)

    def disbelief(m: LabelModel) -> float:
        """How far the accuracies lie below ``BELIEF``: divergence, for each vote."""
        a = np.clip(m.accuracy, 1e-3, BELIEF)
        return float(cast @ (BELIEF * np.log(BELIEF / a) + (1 - BELIEF) * np.log((1 - BELIEF) / (1 - a))))

    return min(models, key=disbelief)


def linear_model(x: np.ndarray, target: np.ndarray, count: np.ndarray, ridge: float = 0.05, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (count * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (count * (p - target)) + ridge * w)
    return w


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Patterns (sorted hashes) and coefficients. Only labels of rows that are not held out are read."""
    known = labels.where("doc_id is not null and toxic is not null").where(fold_of("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
    drawn = known.where(draw < min(1_000_000, -(-1_000_000 * rows // max(total, 1))))
    sample = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id").select("text", "toxic")  # about `rows` rows
    drawn_rows, n_toxic = drawn.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    mined = pattern_counts(sample).where((F.col("toxic") >= max(5, n_toxic // 60)) & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean") + 1)))
    found = mined.orderBy(F.desc("toxic"), "pattern").limit(MAX_PATTERNS).toArrow()
    fixed = lexicon_hashes()
    hashes = np.concatenate([fixed, found.column("pattern").to_numpy().view(np.uint64)])
    lists = np.concatenate([np.zeros(len(fixed), np.int64), 1 + found.column("kind").to_numpy().astype(np.int64) * LISTS + np.arange(found.num_rows) % LISTS])
    patterns, first = np.unique(hashes, return_index=True)
    lists = lists[first]
    size = len(patterns)

    def run(batches):
        for batch in batches:
            for at, to, data, bounds in text_slices(batch.column(0)):
                doc, k = hits_of(data, bounds, patterns)
                ends = np.searchsorted(doc, np.arange(to - at + 1)).astype(np.int32)
                marks = np.append(0, np.cumsum(data == ord("!")))[bounds]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(k.astype(np.int32))), pa.array(np.diff(marks) >= 4), pa.array(np.diff(bounds) >= 400)], ["hits", "shouts", "long"])

    # a row for each set of patterns and voters, so at most as many rows as the sample has
    seen = sample.select("text").mapInArrow(run, "hits array<int>, shouts boolean, long boolean").groupBy("hits", "shouts", "long").count().toArrow().to_pydict()
    n, count = len(seen["hits"]), np.array(seen["count"], float)
    x = np.zeros((n, size))
    for i, k in enumerate(seen["hits"]):
        x[i, k] = 1
    none = ~x.any(1)
    votes = np.zeros((n, KINDS * LISTS + 4))
    for k in range(size):
        votes[:, lists[k]] = np.maximum(votes[:, lists[k]], x[:, k])
    votes[:, -3] = np.array(seen["shouts"], float)
    votes[:, -2] = -none.astype(float)
    votes[:, -1] = -(none & np.array(seen["long"], bool)).astype(float)
    votes = votes[:, votes.any(0)]
    if not votes.size:
        base = np.log(DEFAULT_SHARE / (1 - DEFAULT_SHARE))
        return {"patterns": patterns, "weights": np.append(np.full(size, np.log(MIN_PRECISION / (1 - MIN_PRECISION)) - base), base)}
    balance = n_toxic / drawn_rows if n_toxic else DEFAULT_SHARE
    model = label_model(votes, count, min(max(balance, 0.005), 0.5))
    weights = linear_model(x, model.post, count)
    alone = np.log(MIN_PRECISION / (1 - MIN_PRECISION)) - weights[-1]  # a word of the lexicon that the sample lacks counts as the least precise pattern
    weights[:-1] = np.where(x.any(0), weights[:-1], alone)
    return {"patterns": patterns, "weights": weights}


def score(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with the probability of label 1; see ``free_name`` for a name that ``docs`` has."""
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # at most MAX_PATTERNS patterns and the lexicon

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        patterns, weights = shared.value["patterns"], shared.value["weights"]
        for column in texts:
            parts = [np.zeros(0)]
            for at, to, data, bounds in text_slices(column):
                doc, k = hits_of(data, bounds, patterns)
                logit = weights[-1] + np.bincount(doc, weights=weights[k], minlength=to - at)
                parts.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            yield pa.array(np.concatenate(parts))

    return docs.withColumn(free_name(docs, out_col), F.arrow_udf(run, "double")(F.col(text_col)))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(documents, labels)
    held_out = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    scored = score(documents.select("doc_id", held_out, "text"), model)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
