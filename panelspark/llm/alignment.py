"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a SentencePiece model (B) cover the same bytes.

A reads space + text, B reads the text and adds the space itself. The tokenizers' own spans are the coarse cuts: character
offsets of A, proto spans of B. Where several tokens share a character (A splits it, B falls back to bytes) the spans
say nothing, and the ends come from the lengths of the decoded bytes. Byte offsets where tokens of both end cut the tokens
into groups; every stretch between neighbouring ends of either is a link of one A and one B token.

A text falls apart before a space that starts a pre-token of A and a word of B, so both tokenizers' results for a text
are those of its parts, one after another. Parts are encoded once in a worker and kept while they are used.

Texts are read once and not shuffled. Their token ids are written to the shared folder with how often each task linked a pair
of ids; after these counts are added up, the ids are read again and give each text its counts. The counts travel to the tasks as arrays of at most ``SENT_PAIRS`` pairs, the
commonest ones; what is rarer is joined by pair, and a rare pair has few rows.

Edge cases: texts that are null, empty or not given back by both tokenizers (a space mark U+2581 in the text) have no
tokens: zeros, and '' as digest; special tokens' strings are plain text; very long texts are aligned whole; repeated rows
count as often as they stand; null ids stay; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import lean_worker, materialize, release, small_batches, table, text_slices, worker_state

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Parts that a worker keeps at most, the longest of them, and pairs of ids that are sent to every task at most (41 bytes each).
KEPT_PARTS, LONGEST_PART, SENT_PAIRS = 700_000, 64, 1_000_000
#: Bytes of text that are handled at once.
SLICE = 1 << 20

#: White space of either regular-expression engine; a cut is made before a space only where both tokenizers begin anew.
_WS = r"\s\u180e"
_CUT = re.compile(rf"(?<=[^{_WS}]) (?=.)|(?<=[{_WS}])(?<! ) (?=[^{_WS}])", re.S)


def _begins_blank(part: str) -> bool:
    return not part or part[0].isspace() or part[0] == "\u180e"


def parts_of(text: str) -> list[str]:
    """The parts of space + text without the space that each starts with."""
    parts = text.split(" ")
    return [p[1:] for p in _spaced(" " + text)] if any(map(_begins_blank, parts)) else parts


def split_all(texts: list[str | None]) -> tuple[list[list[str]], list[str], set[str]]:
    """``parts_of`` of all texts; all parts one after another; and the different ones."""
    split = [t.split(" ") if t else [] for t in texts]
    parts = list(chain.from_iterable(split))
    different = set(parts)
    blank = {p for p in different if not p or p[0].isspace() or p[0] == "\u180e"}
    if blank:
        split = [[p[1:] for p in _spaced(" " + t)] if parts and not blank.isdisjoint(parts) else parts for t, parts in zip(texts, split, strict=True)]
        parts = list(chain.from_iterable(split))
        different = set(parts)
    return split, parts, different


def _spaced(text: str) -> Iterator[str]:
    at = 0
    for m in _CUT.finditer(text, 1):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def read_models(a_file: str = A_FILE, b_file: str = B_FILE) -> tuple[bytes, bytes]:
    """Both model files; their size bounds what is sent to the tasks."""
    with open(a_file, "rb") as a, open(b_file, "rb") as b:
        return a.read(), b.read()


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, models: tuple[bytes, bytes]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(models[0].decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=models[1])
        byte, names = _byte_alphabet(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.IsByte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.IdToPiece(i)) for i in range(self.b.GetPieceSize()))]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("vocabularies of more than 65,536 tokens are not supported")
        self.sizes = tuple(np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """Ids of A, ids of B, and the byte ends of both in space + text; None for a text that either does not give back."""
        for text, x, y in zip(texts, self.a.encode_batch([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1, return_type="proto"), strict=True):
            whole = (" " + text).encode()
            a, b = x.ids, [p.id for p in y.pieces]
            if b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b]):
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                spans_a = np.array(x.offsets, np.int64).reshape(-1, 2)
                if len(whole) != len(text) + 1:  # from characters to bytes
                    code = np.frombuffer((" " + text).encode("utf-32-le"), np.uint32)
                    spans_a = np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))))[spans_a]
                shared = np.append(spans_a[1:, 0] < spans_a[:-1, 1], False)
                to = np.array([p.end for p in y.pieces], np.int64)  # each span begins where the last one ends
                yield a, b, self._ends(a, spans_a[:, 1], shared, 0), self._ends(b, to + 1, np.diff(to, prepend=-1) == 0, 1)
            else:
                yield None

    def _ends(self, ids: np.ndarray, coarse: np.ndarray, unsure: np.ndarray, side: int) -> np.ndarray:
        """Byte ends of tokens: those of their spans, and where a span does not tell (``unsure``: the next token has a share of the
        last character, or a byte of a character has an empty span) the end of the last sure token and the bytes decoded since."""
        if not unsure.any():
            return coarse
        decoded = np.cumsum(self.sizes[side][ids])
        last = np.maximum.accumulate(np.where(unsure, -1, np.arange(len(ids))))
        base = np.where(last >= 0, coarse[last] - decoded[last], 0)
        return np.where(unsure, base + decoded, coarse)


def links_of(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links in order as a << 32 | b, and where each ends: every stretch between neighbouring ends of either side is one."""
    by_a, by_b = (np.zeros(int(ends[-1]) + 1 if len(ends) else 0, bool) for ends in (ends_a, ends_b))
    by_a[ends_a], by_b[ends_b] = True, True
    ends = np.flatnonzero(by_a | by_b)
    by_a, by_b = by_a[ends], by_b[ends]
    return a[np.cumsum(by_a) - by_a] << 32 | b[np.cumsum(by_b) - by_b], ends


class Lookup:
    """Places of pairs in an array of different ones: open addressing, for whole arrays at once."""

    def __init__(self, pairs: np.ndarray):
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.key, self.place = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        waiting, at = np.arange(len(pairs)), self._slot(pairs)
        while len(waiting):
            free = self.key[at] == -1
            self.key[at[free]] = pairs[waiting[free]]  # of several for one slot the last stays
            done = self.key[at] == pairs[waiting]
            self.place[at[done]] = waiting[done]
            waiting, at = waiting[~done], (at[~done] + 1) & (len(self.key) - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The place of each pair, -1 if it has none."""
        at, waiting = self._slot(pairs), slice(None)
        found = np.full(len(pairs), -1, np.int32)
        while True:
            key = self.key[at]
            hit = key == pairs[waiting]
            found[waiting] = np.where(hit, self.place[at], -1)
            on = np.flatnonzero(~hit & (key != -1))
            if not len(on):
                return found
            waiting = on if isinstance(waiting, slice) else waiting[on]
            at = (at[on] + 1) & (len(self.key) - 1)


class Parts:
    """What alignment gives for the parts that a worker has met."""

    def __init__(self, models: tuple[bytes, bytes], kept: int = KEPT_PARTS):
        self.pair, self.kept = Pair(models), kept
        self.name_a, self.name_b = ([str(i) for i in range(len(x))] for x in self.pair.sizes)
        self._start()

    def _start(self) -> None:
        self.code: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_groups = array("i")  # -1: a part that is not given back
        self.flat = (array("H"), array("H"), array("q"))  # ids of A, ids of B, links of all parts
        self.at = (array("q", [0]), array("q", [0]), array("q", [0]))  # and where each part's begin
        self.used = np.zeros(0, np.int64)

    def _append(self, part: str, groups: str, n_groups: int, *values) -> None:
        self.code[part] = len(self.groups)
        self.groups.append(groups)
        self.n_groups.append(n_groups)
        for flat, at, more in zip(self.flat, self.at, values, strict=True):
            flat.extend(more)
            at.append(len(flat))

    def _add(self, parts: list[str]) -> None:
        """Encode parts, many at once as one text: joined, they fall apart where they were joined, unless white space or a space mark is at their ends."""
        plain = [p for p in parts if p and p == p.strip() and p[0] != "\u180e" != p[-1] and "▁" not in p]
        joined = [plain[k : k + 2000] for k in range(0, len(plain), 2000)]
        odd = sorted(set(parts).difference(plain))
        for k in range(0, len(joined), 10):
            self._add_chunks(joined[k : k + 10])
        for k in range(0, len(odd), 2000):
            self._add_chunks([[p] for p in odd[k : k + 2000]])

    def _add_chunks(self, chunks: list[list[str]]) -> None:
        for chunk, made in zip(chunks, self.pair.encode([" ".join(c) for c in chunks]), strict=True):
            if made is None and len(chunk) > 1:
                self._add_chunks([[p] for p in chunk])
            elif made is None:
                self._append(chunk[0], "", -1, [], [], [])
            else:
                self._add_made(chunk, *made)

    def _add_made(self, chunk: list[str], a, b, ends_a, ends_b) -> None:
        ends = np.cumsum([1 + len(p.encode()) for p in chunk])
        links, link_ends = links_of(a, b, ends_a, ends_b)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        x, y = ([self.name_a[i] for i in a.tolist()], [self.name_b[i] for i in b.tolist()])
        to_a, to_b = (np.searchsorted(e, cuts) + 1 for e in (ends_a, ends_b))
        groups, i, j = [], 0, 0
        for p, q in zip(to_a.tolist(), to_b.tolist()):
            groups.append((x[i] if p == i + 1 else ",".join(x[i:p])) + "|" + (y[j] if q == j + 1 else ",".join(y[j:q])))
            i, j = p, q
        first, g = len(self.groups), 0
        to = (np.searchsorted(cuts, ends) + 1).tolist()
        self.code.update(zip(chunk, range(first, first + len(chunk))))
        for h in to:
            self.groups.append(";".join(groups[g:h]))
            g = h
        self.n_groups.extend(np.diff(to, prepend=0).tolist())
        for flat, at, values, value_ends, kind in zip(self.flat, self.at, (a, b, links), (ends_a, ends_b, link_ends), (np.uint16, np.uint16, np.int64), strict=True):
            at.frombytes((len(flat) + np.searchsorted(value_ends, ends) + 1).astype(np.int64).tobytes())
            flat.frombytes(values.astype(kind).tobytes())

    def shrink(self) -> None:
        """If there are too many parts, keep short ones that were used more than once, half of the allowed number at most."""
        if len(self.code) <= self.kept:
            return
        names = [p for p, c in self.code.items() if self.used[c] > 1 and len(p) <= LONGEST_PART]
        names = sorted(names, key=lambda p: -self.used[self.code[p]])[: self.kept // 2]
        old = [(p, self.groups[c], self.n_groups[c], *(flat[at[c] : at[c + 1]] for flat, at in zip(self.flat, self.at))) for p in names for c in [self.code[p]]]
        self._start()
        for row in old:
            self._append(*row)
        self.used = np.zeros(len(self.groups), np.int64)

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Part codes of all texts one after another, and the bounds of each text; texts that are not given back have none."""
        split, parts, different = split_all(texts)
        self._add(sorted(different.difference(self.code)))
        own = {p: self.code[p] for p in different}  # small, so it stays in the processor's cache
        codes = np.fromiter(map(own.__getitem__, parts), np.int64, len(parts))
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in split]))).astype(np.int64)
        self.used = np.concatenate((self.used, np.zeros(len(self.groups) - len(self.used), np.int64)))
        odd = np.frombuffer(self.n_groups, np.int32)[codes] < 0 if len(codes) else np.zeros(0, bool)
        if odd.any():
            keep = np.ones(len(codes), bool)
            for d in np.unique(np.searchsorted(bounds, np.flatnonzero(odd), side="right") - 1):
                keep[bounds[d] : bounds[d + 1]] = False
            bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
            codes = codes[keep]
        self.used += np.bincount(codes, minlength=len(self.used))
        return codes, bounds

    def ids(self, side: int, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and the bounds of each text."""
        if not len(codes):
            return np.zeros(0, np.uint16), np.zeros(len(bounds), np.int64)
        at, flat = np.frombuffer(self.at[side], np.int64), np.frombuffer(self.flat[side], np.uint16)
        n = at[codes + 1] - at[codes]
        to = np.concatenate(([0], np.cumsum(n)))
        return flat[np.repeat(at[codes] - to[:-1], n) + np.arange(to[-1])], to[bounds]

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """How often pairs were linked since the counters were set to 0."""
        pairs, place = np.unique(np.array(self.flat[2], np.int64), return_inverse=True)
        n = np.bincount(place, np.repeat(self.used, np.diff(np.array(self.at[2]))), len(pairs)).astype(np.int64)
        return pairs[n > 0], n[n > 0]


_DOCS = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a binary, b binary, groups string, pair long, n long"


def tokens(docs: DataFrame, models: tuple[bytes, bytes], kept: int = KEPT_PARTS, with_groups: bool = False) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text) with its token ids (two bytes each) and the digest of its groups; and rows with a
    ``pair`` (A id << 32 | B id) and how often a task's texts link it."""
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups")), ("groups_sha256", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("groups", pa.string()), ("pair", pa.int64()), ("n", pa.int64())])

    def run(batches):
        lean_worker(key)
        known = worker_state(key, lambda: Parts(shared.value, kept))
        known.used[:] = 0

        def counts():
            pairs, n = known.counted()
            for k in range(0, len(pairs), 100_000):
                part = [pa.array(x[k : k + 100_000]) for x in (pairs, n)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part[0]), f.type) for f in list(schema)[:8]), *part], schema=schema)

        for batch in (part for whole in batches for part in _slices(whole)):
            codes, bounds = known.codes(batch.column(1).to_pylist())
            texts = [";".join([known.groups[c] for c in codes[i:j].tolist()]) for i, j in zip(bounds, bounds[1:])]
            sums = np.concatenate(([0], np.cumsum(np.array(known.n_groups, np.int64)[codes])))[bounds]
            sides = [known.ids(k, codes, bounds) for k in (0, 1)]
            binary = [pa.array([flat[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary()) for flat, at in sides]
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.diff(at)) for _, at in sides), pa.array(np.diff(sums)), pa.array(digests, pa.string()), *binary, pa.array(texts if with_groups else [None] * len(texts), pa.string()), *(pa.nulls(len(texts), pa.int64()) for _ in range(2))], schema=schema)
            if len(known.code) > known.kept:
                yield from counts()
                known.shrink()
        yield from counts()

    return docs.mapInArrow(run, _DOCS)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``SLICE`` bytes of text at a time."""
    for at, to, _, _ in text_slices(batch.column(1), SLICE):
        yield batch.slice(at, to - at)


def with_best(counts: DataFrame) -> DataFrame:
    """pair, n, best: is it the most frequent one of its B id? Ties are."""
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(b)))


def _sent(counts: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """The pairs that occur at least so often that they are ``most`` at most, as sorted arrays; and that number (0: all pairs)."""
    least = 0
    if counts.count() > most:
        sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()  # 64 rows at most
        by_size, total = sorted(((r["k"], r["count"]) for r in sizes), reverse=True), 0
        least = 2 << by_size[0][0]
        for k, n in by_size:
            total += n
            if total > most:
                break
            least = 1 << k
    rows = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    return (rows["pair"].to_numpy(), rows["n"].to_numpy(), rows["best"].to_numpy()), least


_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: tuple[bytes, bytes] | None = None, sent_pairs: int = SENT_PAIRS, kept_parts: int = KEPT_PARTS, with_groups: bool = False) -> DataFrame:
    """For every row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the groups themselves as text if asked for."""
    spark = small_batches(documents.sparkSession)
    models = models or read_models()
    made = materialize(tokens(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), models, kept_parts, with_groups))
    counts = materialize(with_best(made.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))))
    sent, least = _sent(counts, sent_pairs)
    sizes = Pair(models).sizes
    shared, key = spark.sparkContext.broadcast((sizes, sent)), uuid.uuid4().hex

    def run(batches):
        lean_worker()
        sizes, (pairs, times, best) = shared.value
        lookup = worker_state(key, lambda: Lookup(pairs))
        times, best = np.append(times, 0), np.append(best, False)  # what is not known
        for batch in batches:
            (a, at), (b, bt) = (_ids(batch.column(k)) for k in (5, 6))
            ends_a = np.cumsum(sizes[0][a])
            links, ends = links_of(a, b, ends_a, np.cumsum(sizes[1][b]))
            bounds = np.searchsorted(ends, np.concatenate(([0], ends_a))[at], side="right")
            k = lookup.find(links)
            known = k >= 0
            values = [np.concatenate(([0], np.cumsum(v[k]))) for v in (best, times)]
            rare = [[] for _ in range(batch.num_rows)]
            for d in np.unique(np.searchsorted(bounds, np.flatnonzero(~known), side="right") - 1):
                i, j = bounds[d : d + 2]
                found, n = np.unique(links[i:j][~known[i:j]], return_counts=True)
                rare[d] = [{"pair": p, "k": m} for p, m in zip(found.tolist(), n.tolist())]
            counted = [np.diff(bounds), *(np.diff(v[bounds]) for v in values)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c.astype(np.int64)) for c in counted), batch.column(4), batch.column(7), pa.array(rare, pa.list_(pa.struct([("pair", pa.int64()), ("k", pa.int64())])))], [*_COLUMNS, "groups", "rare"])

    kept = made.where("pair is null").drop("pair", "n")
    done = kept.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in _COLUMNS) + ", groups string, rare array<struct<pair:long,k:long>>")
    if least:
        done = materialize(done.withColumn("row", F.monotonically_increasing_id()))
        rows = done.select("row", F.inline("rare")).join(counts.where(F.col("n") < least), "pair")
        more = rows.groupBy("row").agg(F.sum(F.col("k") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum"))
        done = done.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
        release(made)
    else:
        release(counts)
    return done.select(*_COLUMNS, *(["groups"] if with_groups else []))


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows one after another, and the bounds of each row."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint16) if data is not None else np.zeros(0, np.uint16)
    return flat.astype(np.int64), (offsets - offsets[0]).astype(np.int64) // 2


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
