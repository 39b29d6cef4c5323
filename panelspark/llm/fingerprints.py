"""Document fingerprints: SimHash with permuted block tables.

Terms are words and pairs of neighbouring words (A-Z lower-cased, white space separates), short texts also have runs of three
bytes, which fade out with the number of words. A term weighs 1 + ln(times in the text) times the weight of its kind, in
whole 64ths, so that sums do not depend on their order. Every bit of a term's 256-bit hash votes with that weight, and a
fingerprint has the bits that more weight is for than against. The share of different bits tells the angle between the texts'
weighted terms; ``likeness`` is its cosine, at least 0.

``near_groups`` finds all fingerprints within a Hamming radius: bits are cut into more blocks than bits may differ, so two
near fingerprints agree in one block at least. Each block leads one table; rows of a table with the same leading block are
compared in cells of bounded size, a frequent block in several cells, and a cell gives out a spanning forest of its links.

``edited`` compares every text with the next document (descending ids) and with a text whose last half is the first part of
the next one. Texts are dealt to ranges of ids, sorted, and read in order with the last row kept; the first and last rows of
the ranges are joined afterwards, so no window spans the table.

Edge cases: a null text counts as empty; empty texts have a fingerprint of zeros and are near each other only; rows of one id
follow each other by a hash of their texts, null ids come last; a lone document is followed by itself; repeated rows give
repeated results; very long texts are read whole; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Words, fold_ascii, lean_worker, materialize, mix, release, small_batches, table, text_slices, white_space
from .jaccard import components

BITS = 256
#: Weights of single words, of pairs of words, and of runs of three bytes, which only texts of fewer than ``FEW_WORDS`` words have.
WORD, PAIR_OF_WORDS, THREE_BYTES, FEW_WORDS = 0.6, 1.0, 0.5, 16
#: Bits in which fingerprints of one group may differ from link to link, and rows of a table that are compared at once (twice as many at most).
RADIUS, CELL = 7, 2048
_SALTS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64))
_SIGNS = (2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) - 1).astype(np.float64)


def _terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight (in 64ths) of the different terms of some texts."""
    words = Words(data, bounds, white_space(), fold_ascii())
    n_words = np.bincount(words.doc, minlength=words.n_docs)
    same = words.doc[1:] == words.doc[:-1]
    pairs = mix(words.hash[:-1] * np.uint64(31) + words.hash[1:])[same]
    few = np.flatnonzero((n_words < FEW_WORDS) & (np.diff(bounds) >= 3))
    places = np.concatenate([np.arange(bounds[d], bounds[d + 1] - 2) for d in few]) if len(few) else np.zeros(0, np.int64)
    kinds = [(words.doc, words.hash, np.full(words.n_docs, WORD)), (words.doc[1:][same], mix(pairs + np.uint64(2)), np.full(words.n_docs, PAIR_OF_WORDS)),
             (np.searchsorted(bounds, places, side="right") - 1, mix(words.span_hash(places, places + 3) + np.uint64(3)), THREE_BYTES * np.maximum(0, 1 - n_words / FEW_WORDS))]
    found = []
    for doc, term, weight in kinds:
        key = mix(term + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        found.append((doc[first], term[first], np.rint(64 * weight[doc[first]] * (1 + np.log(times)))))
    return tuple(np.concatenate(x) for x in zip(*found))


def fingerprints(column: pa.Array) -> np.ndarray:
    """A row of ``BITS`` / 8 bytes for each text."""
    made = [np.zeros((0, BITS // 8), np.uint8)]
    for _, _, data, bounds in text_slices(column):
        doc, term, weight = _terms(data, bounds)
        n, votes = len(bounds) - 1, []
        for salt in _SALTS:
            octets = mix(term + salt).view(np.uint8).reshape(-1, 8)
            for k in range(8):
                votes.append(np.bincount(doc * 256 + octets[:, k], weight, n * 256).reshape(n, 256) @ _SIGNS)
        made.append(np.packbits(np.concatenate(votes, axis=1) > 0, axis=1))
    return np.concatenate(made)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of the angle that the share of different bits tells, 0 to 1."""
    different = np.bitwise_count(a ^ b).sum(axis=1) / BITS
    return np.maximum(0.0, np.cos(np.pi * different))


def _hex(rows: np.ndarray) -> pa.Array:
    text = rows.tobytes().hex()
    return pa.array([text[k : k + BITS // 4] for k in range(0, len(text), BITS // 4)], pa.string())


def fingerprint_column(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of its text as lowercase hex."""
    small_batches(docs.sparkSession)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean_worker()
        for column in texts:
            yield _hex(fingerprints(column))

    return docs.withColumn(name, F.arrow_udf(run, "string")(F.col(text_col)))


# --- the next document

_RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of the following one, or all of it."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _compared(ids: pa.Array, texts: list[str], following: list[str], own: np.ndarray, of_next: np.ndarray) -> list[pa.Array]:
    made = [edit(t, f) for t, f in zip(texts, following, strict=True)]
    after = fingerprints(pa.array(made, pa.large_string()))
    return [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in made], pa.string()), _hex(own), _hex(after), pa.array(likeness(own, after)), pa.array(likeness(own, of_next))]


def edited(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = pa.schema([*_RESULT, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])

    def run(batches):
        lean_worker()
        part = TaskContext.get().partitionId()
        last = None  # id, text and fingerprint of the row before

        def edge(kind, doc_id, text):
            return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *(pa.nulls(1, t) for _, t in _RESULT[1:]), pa.array([part], pa.int32()), pa.array([kind]), pa.array([text], pa.string())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            texts, prints = batch.column(1).to_pylist(), fingerprints(batch.column(1))
            ids = batch.column(0).to_pylist()
            if last is None:
                yield edge("first", None, texts[0])
            else:
                ids, texts, prints = [last[0], *ids], [last[1], *texts], np.concatenate((last[2], prints))
            n = len(texts) - 1
            if n:
                made = _compared(pa.array(ids[:n], pa.int64()), texts[:n], texts[1:], prints[:n], prints[1:])
                yield pa.RecordBatch.from_arrays([*made, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], schema=schema)
            last = ids[n], texts[n], prints[n:]
        if last is not None:
            yield edge("last", last[0], last[1])

    made = materialize(dealt.mapInArrow(run, _RESULT_DDL + ", part int, edge string, text string"))
    edges = made.where("edge is not null")
    parts = edges.where("edge = 'first'").select("part")  # one row a task
    w = Window.orderBy("part")
    parts = parts.select("part", F.coalesce(F.lead("part").over(w), F.min("part").over(w)).alias("after"))
    heads = edges.where("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    pairs = edges.where("edge = 'last'").select("doc_id", "text", "part").join(parts, "part").join(heads, "after").select("doc_id", "text", "following")

    def join_up(batches):
        for batch in batches:
            texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            made = _compared(batch.column(0), texts, following, fingerprints(batch.column(1)), fingerprints(batch.column(2)))
            yield pa.RecordBatch.from_arrays(made, schema=pa.schema(_RESULT))

    return made.where("edge is null").drop("part", "edge", "text").unionByName(pairs.mapInArrow(join_up, _RESULT_DDL))


# --- all within a radius

def _forest(words: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (row, smallest row of its group) of the rows that links within the radius hold together."""
    near = np.zeros((len(words), len(words)), bool)
    for k in range(0, len(words), 512):
        near[k : k + 512] = np.bitwise_count(words[k : k + 512, None, :] ^ words[None, :, :]).sum(axis=2, dtype=np.uint16) <= radius
    root = np.arange(len(words))
    while True:
        least = np.where(near, root[None, :], len(words)).min(axis=1)
        least = least[least]
        if (least == root).all():
            return [(i, r) for i, r in enumerate(root.tolist()) if i != r]
        root = least


def _links_of_cells(radius: int):
    def run(batches):
        lean_worker()
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            cell = held["cell"].to_numpy()
            whole = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on
            if whole:
                yield from _linked(held.slice(0, whole), radius)
                held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield from _linked(held, radius)

    return run


def _linked(rows: pa.Table, radius: int) -> Iterator[pa.RecordBatch]:
    prints = rows["fingerprint"].combine_chunks()
    words = np.frombuffer(bytes.fromhex("".join(prints.to_pylist())), np.uint64).reshape(-1, BITS // 64)
    cell = rows["cell"].to_numpy()
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(starts, len(cell)))
    a, b = [], []
    small = np.repeat(size <= 8, size)
    for step in range(1, 8):  # cells of a few rows, all at once
        i = np.flatnonzero((cell[step:] == cell[:-step]) & small[step:]) if step < len(cell) else np.zeros(0, np.int64)
        i = i[np.bitwise_count(words[i] ^ words[i + step]).sum(axis=1) <= radius]
        a.append(i + step)
        b.append(i)
    for at, n in zip(starts[size > 8].tolist(), size[size > 8].tolist()):
        edges = _forest(words[at : at + n], radius)
        a.append(np.array([at + i for i, _ in edges], np.int64))
        b.append(np.array([at + j for _, j in edges], np.int64))
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        yield pa.RecordBatch.from_arrays([prints.take(pa.array(a)), prints.take(pa.array(b))], ["a", "b"])


def near_groups(prints: DataFrame, radius: int = RADIUS, cell: int = CELL, id_col: str = "doc_id") -> DataFrame:
    """fingerprint, near_id for each different fingerprint of ``prints`` (id_col, fingerprint): the smallest id of the group that is
    reached over links of at most ``radius`` bits."""
    if not 0 <= radius < 32:
        raise ValueError("radius must be 0 to 31")
    blocks = next(n for n in (1, 2, 4, 8, 16, 32) if n > radius)
    width = BITS // 4 // blocks  # hex digits
    classes = materialize(prints.groupBy("fingerprint").agg(F.min(id_col).alias("rep")))
    tables = classes.select("fingerprint", F.posexplode(F.array(*(F.substring("fingerprint", 1 + k * width, width) for k in range(blocks)))).alias("t", "block"))
    counts = tables.groupBy("t", "block").agg(F.count("*").alias("n")).where("n > 1")
    cells = tables.join(counts, ["t", "block"]).withColumn("cells", F.ceil(F.col("n") / cell).cast("int")).withColumn("mine", F.pmod(F.xxhash64("fingerprint"), F.col("cells")).cast("int"))
    cells = cells.select("fingerprint", "t", "block", "mine", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    cells = cells.select("fingerprint", F.xxhash64("t", "block", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))
    edges = cells.repartition("cell").sortWithinPartitions("cell").select("cell", "fingerprint").mapInArrow(_links_of_cells(radius), "a string, b string")
    held = components(edges)
    rooted = classes.join(held, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "rep", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("near_id"))
    made = materialize(rooted.join(least, "root").select("fingerprint", "near_id"))
    release(classes, held)
    return made


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(edited(table(spark, sf_dir, "documents")))
    return rows.join(near_groups(rows), "fingerprint").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_id")
