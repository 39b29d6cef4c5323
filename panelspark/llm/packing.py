"""Token ids packed into fixed rows by best-fit decreasing.

Texts are tokenised (byte-level BPE), a text of more than ``length`` tokens is split into consecutive parts
without loss, and parts are packed into rows of ``length`` ids. Parts are placed from longest to shortest,
each into the fullest row that still takes it; a segment tree over free room finds that row. Packing works on
windows of ``window_tokens`` tokens within a partition, so no row of text is shuffled, a task's memory is
bounded, and one source or group of copies cannot overload a task; the loss is at most the last rows of each
window. A lost task is computed again from the same rows in the same order, with the same result.

A result row is a packed row: its ids padded with ``pad_id`` (binary, little-endian uint16 or uint32), the
cumulative lengths of its segments, position ids that start again at each segment (binary), and for each
segment the document and the place of its first token in it.

Edge cases: null and empty texts have no tokens and no segment; they take part in no row. Repeated rows are packed
as often as they occur; null ids are kept in doc_ids. Extra columns are not read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark import TaskContext

from .common import table, text_slices

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to this vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH, WINDOW_TOKENS, PAD = 2048, 2 << 20, 50256


def read_ranks(path: str = RANK_FILE) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


def tokenizer(ranks: list[tuple[bytes, int]]):
    """Function from a text to its ids; strings of special tokens are ordinary text."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=dict(ranks), special_tokens={}).encode_ordinary


class Room:
    """Segment tree over amounts of free room: how many rows have each amount, and the least amount that fits."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least free room of ``need`` or more, and that room."""
        at = need + self.size
        while not self.tree[at]:  # climb to the nearest right neighbour that has rows
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        while at:
            self.tree[at] -= 1
            at >>= 1
        return row, room


def best_fit_decreasing(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Rows of part indexes; parts of equal length keep their order."""
    rows: list[list[int]] = []
    room = Room(length)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = room.take(need)
        row, free = found if found else (len(rows), length)
        if not found:
            rows.append([])
        rows[row].append(k)
        if free > need:
            room.add(free - need, row)
    return rows


SCHEMA = "pack_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, doc_starts array<int>"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, window_tokens: int = WINDOW_TOKENS, rank_file: str = RANK_FILE, pad_id: int = PAD) -> DataFrame:
    ranks = read_ranks(rank_file)
    kind = np.dtype("<u2") if max(pad_id, max((r for _, r in ranks), default=0)) < 65536 else np.dtype("<u4")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary file
    place = np.arange(length, dtype="<u2" if length <= 65536 else "<u4")

    def emit(base, parts):
        lengths = np.array([len(x[2]) for x in parts])
        out = {k: [] for k in ("pack_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "doc_starts")}
        for n, row in enumerate(best_fit_decreasing(lengths, length)):
            ends = np.concatenate([[0], np.cumsum(lengths[row])])
            ids, pos = np.full(length, pad_id, kind), np.zeros(length, place.dtype)
            for k, a, b in zip(row, ends[:-1], ends[1:], strict=True):
                ids[a:b], pos[a:b] = parts[k][2], place[: b - a]
            for name, v in zip(out, (base + n, int(ends[-1]), ids.tobytes(), ends.tolist(), pos.tobytes(), [parts[k][0] for k in row], [parts[k][1] for k in row]), strict=True):
                out[name].append(v)
            if len(out["pack_id"]) == 512:
                yield batch_of(out)
                for v in out.values():
                    v.clear()
        if out["pack_id"]:
            yield batch_of(out)

    def batch_of(out):
        types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    def run(batches):
        encode = tokenizer(shared.value)
        base = TaskContext.get().partitionId() << 40
        parts, waiting = [], 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, to, _, _ in text_slices(texts):
                for doc, text in zip(ids.slice(at, to - at).to_pylist(), texts.slice(at, to - at).to_pylist(), strict=True):
                    tokens = np.array(encode(text or ""), kind)
                    parts += [(doc, k, tokens[k : k + length]) for k in range(0, len(tokens), length)]
                    waiting += len(tokens)
                    if waiting >= window_tokens:
                        for out in emit(base, parts):
                            base += out.num_rows
                            yield out
                        parts, waiting = [], 0
        yield from emit(base, parts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write packed rows as Parquet: each row group holds an id matrix of equal rows."""
    pack(docs, **options).write.parquet(path)


def op9(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
