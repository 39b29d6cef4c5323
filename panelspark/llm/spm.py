"""SentencePiece encoding and decoding as weighted finite-state transduction.

Three transducers are compiled from a model file: the normaliser (dummy prefix, runs of spaces, spaces to the
visible space mark), the pieces (an arc for each piece), and byte fallback (a chain of byte arcs for a character
that no piece holds). They are composed with a text lazily, position by position; the states of the composition
are (position, last piece). Encoding is the path of least weight in the tropical semiring: weights add along a
path, and of all arcs that end in a state the least sum wins.

For a unigram model an arc weighs minus its piece's score. For a BPE model an arc weighs nothing if the piece
and the last one stay two when their text is merged by the model's ranks, and infinity otherwise. A prefix has
just one sequence of pieces whose neighbours all stay apart, so one state a position has a finite weight, and
the least path is the model's own encoding.

A composition falls apart before each run of space marks and wherever no piece holds two characters side by
side. Such parts are composed once and then looked up; the new ones of a slice of texts are composed together, one
position of all of them at a time.

Edge cases: a null text gives null ids, an empty one no ids; the space mark itself in a text counts as a
space; very long texts and very long words are encoded whole, in time linear in their length. Models with a
character map, pieces of the user's or unused pieces, or the space mark at the end of words are refused
(ValueError), as are model kinds other than unigram and BPE.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name, lean_worker, small_batches, table, text_slices, worker_state

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Parts that a task remembers at most in each of two generations, and the longest of them; pairs of pieces it remembers.
REMEMBERED, LONGEST, PAIRS, SLICE = 60_000, 48, 250_000, 1 << 20
_START = (1 << 21) - 1  # stands before the first arc
#: What an unknown character costs in a unigram model beyond the least score of a piece. Fixed value.
UNKNOWN_PENALTY = 10.0


def read_model(path: str = MODEL_FILE) -> dict:
    """Pieces, scores, kind and normaliser of a model file as plain values; the file's size bounds what is broadcast."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        m = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    kind = {1: "unigram", 2: "bpe"}.get(m.trainer_spec.model_type)
    types = [p.type for p in m.pieces]  # 1 normal, 2 unknown, 3 control, 4 of the user, 5 unused, 6 byte
    refused = [what for what, found in (
        ("its kind", kind is None), ("a character map", len(m.normalizer_spec.precompiled_charsmap) > 0), ("pieces of the user's or unused pieces", bool({4, 5} & set(types))),
        ("space marks at the end of words", m.trainer_spec.treat_whitespace_as_suffix), ("spaces that are not escaped", not m.normalizer_spec.escape_whitespaces), ("no unknown piece", 2 not in types)) if found]
    if refused:
        raise ValueError(f"this model is not supported: {', '.join(refused)}")
    return {"pieces": [p.piece for p in m.pieces], "scores": [p.score for p in m.pieces], "types": types, "kind": kind, "prefix": m.normalizer_spec.add_dummy_prefix, "squeeze": m.normalizer_spec.remove_extra_whitespaces}


class Transducer:
    def __init__(self, pieces: list[str], scores: list[float], types: list[int], kind: str, prefix: bool = True, squeeze: bool = False):
        self.pieces, self.kind, self.score, self.prefix, self.squeeze = pieces, kind, scores, prefix, squeeze
        self.unknown = types.index(2)
        self.id_of = {p: i for i, p in enumerate(pieces) if types[i] == 1}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if types[i] == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i, t in enumerate(types) if t == 3}
        self.unknown_weight = UNKNOWN_PENALTY - min((scores[i] for i in self.id_of.values()), default=0.0)
        ending: dict = {}  # trie of the pieces read backwards: characters, and the piece at ""
        for p, i in self.id_of.items():
            node = ending
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        splittable = all(re.fullmatch(f"{MARK}*[^{MARK}]*", p) for p in self.id_of)
        self._parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if splittable else "(?s:.+)")
        self._by_word = splittable and prefix and not squeeze
        self._touch = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}  # characters that stand side by side in a piece
        self._weights: dict[int, float] = {}
        self._sorted = (np.zeros(0, np.int64), np.zeros(0))  # most of the pairs in _weights, by key
        self._whole: dict[str, bool] = {}
        self._trees: dict[str, tuple[str, str, bool] | None] = {}
        # parts, and the words after one space mark (without it), as bytes of ids; and those of the generation before
        self._known: dict[bool, dict[str, bytes]] = {False: {}, True: {}}
        self._older: dict[bool, dict[str, bytes]] = {False: {}, True: {}}
        self._arc_cost = np.append(-np.array(scores), self.unknown_weight)
        step, self._piece_at = [], [-1]  # the trie as arrays: (node, character, next node), and the piece at each node
        waiting = [(0, ending)]
        for at, node in waiting:
            for c, below in node.items():
                if c:
                    step.append((at << 21 | ord(c), len(self._piece_at)))
                    waiting.append((len(self._piece_at), below))
                    self._piece_at.append(below.get("", -1))
        step.sort()
        self._step, self._next = (np.array([x[k] for x in step], np.int64) for k in (0, 1))
        self._piece_at = np.array(self._piece_at, np.int64)
        # the first two steps are looked up directly, the second one for the commonest characters
        self._first = np.full(0x110000, -1, np.int32)
        one = self._step < 1 << 21
        self._first[self._step[one]] = self._next[one]
        self._class = np.zeros(0x110000, np.uint8)
        seen = np.bincount(self._step & _START)
        common = np.argsort(-seen, kind="stable")[:255]
        self._class[common] = np.arange(1, len(common) + 1)
        top = int(self._next[one].max(initial=0)) + 1  # nodes are numbered by depth
        self._second = np.full((top, 256), -2, np.int32)
        self._second[:, 1 : len(common) + 1] = -1
        two = (self._step >= 1 << 21) & (self._step < top << 21)
        into = self._class[self._step & _START]
        two &= into > 0
        self._second[self._step[two] >> 21, into[two]] = self._next[two]
        spell = [b"" if i in self.silent else " ⁇ ".encode() if i == self.unknown else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self._spelt, self._size = np.frombuffer(b"".join(spell), np.uint8), np.array([len(x) for x in spell], np.int64)
        self._spelt_at = np.cumsum(self._size) - self._size

    # -- normaliser
    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(f"[ {MARK}]+", " ", text).strip(" ")
        return (MARK if self.prefix else "") + text.replace(" ", MARK) if text else ""

    # -- weights
    def weight(self, last: int, arc: int) -> float:
        """Weight of an arc (a piece, or a character numbered after the pieces) after the piece ``last``."""
        if self.kind == "unigram":
            return -self.score[arc] if arc < len(self.pieces) else self.unknown_weight
        key = last << 21 | arc
        w = self._weights.get(key)
        if w is None:
            if len(self._weights) >= PAIRS:
                self._weights.clear()
                self._sorted = (np.zeros(0, np.int64), np.zeros(0))
            right = self._text_of(arc)
            fits = self._is_whole(right) if last == _START else self._stay_two(self._text_of(last), right)
            w = self._weights[key] = 0.0 if fits else math.inf
        return w

    def _merged(self, text: str) -> list[str]:
        """The text's characters after all merges, best score first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                k = self.id_of.get(parts[i] + parts[i + 1])
                if k is not None and self.score[k] > best:
                    best, at = self.score[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _tree(self, piece: str) -> tuple[str, str, bool] | None:
        """The last merge that makes the piece, and if every merge in it ranks behind the merges of its halves."""
        if piece not in self._trees:
            parts, last = list(piece), None
            while len(parts) > 1:
                best, at = max((self.score[k], -i) for i in range(len(parts) - 1) if (k := self.id_of.get(parts[i] + parts[i + 1])) is not None)
                last = parts[-at], parts[1 - at]
                parts[-at : 2 - at] = [last[0] + last[1]]
            if last:
                mine = self.score[self.id_of[piece]]
                last = (*last, all(len(x) == 1 or (self.score[self.id_of[x]] > mine and self._tree(x)[2]) for x in last))
            self._trees[piece] = last
        return self._trees[piece]

    def _stay_two(self, left: str, right: str) -> bool:
        """Do two pieces that meet stay two? Merges are undone from the last to the first; at each step the
        pieces that touch must not have had a better merge across the border. The left one wins ties."""
        id_of, score = self.id_of, self.score
        if not (self._is_whole(left) and self._is_whole(right)):
            return False
        a, b = self._tree(left), self._tree(right)
        if (a and not a[2]) or (b and not b[2]):
            return self._merged(left + right) == [left, right]
        if left + right in id_of:
            return False
        while a or b:
            if b and (not a or score[id_of[right]] <= score[id_of[left]]):
                made, right = score[id_of[right]], b[0]
                across = id_of.get(left + right)
                if across is not None and score[across] >= made:
                    return False
                b = self._tree(right)
            else:
                made, left = score[id_of[left]], a[1]
                across = id_of.get(left + right)
                if across is not None and score[across] > made:
                    return False
                a = self._tree(left)
        return True

    def _is_whole(self, piece: str) -> bool:
        """Do the merges of its characters make the piece at all?"""
        if piece not in self._whole:
            self._whole[piece] = self._merged(piece) == [piece]
        return self._whole[piece]

    def _text_of(self, arc: int) -> str:
        return self.pieces[arc] if arc < len(self.pieces) else chr(arc - len(self.pieces))

    # -- composition and shortest path
    def arcs(self, char: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All arcs over parts laid end to end (``place``: of each character in its part): last character, first one,
        piece; by the last one's place, then by the first one."""
        end = np.arange(len(char))
        node, found, beyond = np.zeros(len(char), np.int64), [], len(self.pieces)
        for size in range(len(char)):
            node = self._follow(node, char[end - size], size)
            there = node >= 0
            arc = np.where(there, self._piece_at[node], -1)
            if size == 0:
                arc = np.where(arc < 0, beyond + char, arc)
            some = arc >= 0
            found.append((end[some], end[some] - size, arc[some]))
            more = there & (place[end] > size)
            end, node = end[more], node[more]
            if not len(end):
                break
        last, first, arc = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(np.minimum(place[last], LONGEST) << 52 | last << 12 | (4095 - np.minimum(last - first, 4095)))  # a longer part stands alone
        return last[order], first[order], arc[order]

    def _follow(self, node: np.ndarray, char: np.ndarray, depth: int) -> np.ndarray:
        """The nodes that characters lead to in the trie, -1 for none."""
        if depth == 0:
            return self._first[char].astype(np.int64)
        out = self._second[node, self._class[char]].astype(np.int64) if depth == 1 else np.full(len(node), -2)
        rest = np.flatnonzero(out == -2)
        key = node[rest] << 21 | char[rest]
        at = np.minimum(np.searchsorted(self._step, key), len(self._step) - 1)
        out[rest] = np.where(self._step[at] == key, self._next[at], -1)
        return out

    def _weights_of(self, last: np.ndarray, arc: np.ndarray) -> np.ndarray:
        if self.kind == "unigram":
            return self._arc_cost[np.minimum(arc, len(self.pieces))]
        key = last << 21 | arc
        known, weights = self._sorted
        at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
        new = np.flatnonzero(known[at] != key) if len(known) else np.arange(len(key))
        out = weights[at] if len(known) else np.zeros(len(key))
        if len(new):
            keys, where = np.unique(key[new], return_inverse=True)
            out[new] = np.array([self._weights[k] if k in self._weights else self.weight(k >> 21, k & _START) for k in keys.tolist()])[where]
        return out

    def paths(self, parts: list[str]) -> list[bytes]:
        """Ids on the paths of least weight through the compositions of parts."""
        if not parts:
            return []
        size = np.array([len(p) for p in parts])
        char = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        part = np.repeat(np.arange(len(parts)), size)
        place = np.arange(len(char)) - np.repeat(np.cumsum(size) - size, size)
        end, start, arc = self.arcs(char, place)
        # a state before each character and one at the end of each part
        before, after = start + part[start], end + part[end] + 1
        n = len(char) + len(parts)
        cost, last, back = np.full(n, np.inf), np.full(n, _START), np.zeros(n, np.int64)
        at_end = np.cumsum(size + 1) - 1
        cost[at_end - size] = 0.0
        edge = np.searchsorted(place[end], np.arange(size.max() + 1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            here = slice(a, b)
            total = cost[before[here]] + self._weights_of(last[before[here]], arc[here])
            state = after[here]
            first = np.flatnonzero(np.append(True, state[1:] != state[:-1]))
            least = np.minimum.reduceat(total, first)
            best = np.flatnonzero(total == np.repeat(least, np.diff(np.append(first, b - a))))
            best = best[np.append(True, state[best[1:]] != state[best[:-1]])] + a  # of equal sums the longest arc
            cost[after[best]], last[after[best]], back[after[best]] = least, arc[best], before[best]
        if len(self._weights) > 1.2 * len(self._sorted[0]) + 1000:
            keys = np.sort(np.fromiter(self._weights, np.int64, len(self._weights)))
            self._sorted = keys, np.array([self._weights[k] for k in keys.tolist()])
        of, ids, now, whose = [], [], at_end, np.arange(len(parts))
        while len(now):
            of.append(whose)
            ids.append(last[now])
            now = back[now]
            more = now != (at_end - size)[whose]
            now, whose = now[more], whose[more]
        step = np.repeat(np.arange(len(of)), [len(x) for x in of])
        of, ids = np.concatenate(of), np.concatenate(ids)
        order = np.lexsort((-step, of))
        of, ids = of[order], ids[order]
        edge = 4 * np.searchsorted(of, np.arange(len(parts) + 1))
        flat = ids.astype(np.int32).tobytes()
        out = [flat[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        for k in np.unique(of[ids >= len(self.pieces)]).tolist():
            out[k] = np.array(self._fallback(np.frombuffer(out[k], np.int32).tolist()), np.int32).tobytes()
        return out

    def _fallback(self, arcs: list[int]) -> list[int]:
        """Characters without a piece as chains of bytes; without byte pieces, neighbours are one unknown piece."""
        out: list[int] = []
        for arc in arcs:
            if arc < len(self.pieces):
                out.append(arc)
            elif self.byte_id:
                out += [self.byte_id.get(b, self.unknown) for b in self._text_of(arc).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _cut(self, part: str) -> list[str]:
        """The part cut where no piece crosses."""
        touch = self._touch
        if not self.byte_id:  # unknown neighbours become one piece
            return [part]
        cuts = [0, *(k for k in range(1, len(part)) if part[k - 1 : k + 1] not in touch), len(part)]
        return [part[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of new parts; long ones are cut first."""
        cut = {p: self._cut(p) for p in parts if len(p) > LONGEST}
        atoms = list({p for p in parts if p not in cut}.union(*cut.values()))
        short = [a for a in atoms if len(a) <= LONGEST]
        found = dict(zip(short, self.paths(short), strict=True))
        for a in atoms:
            if a not in found:  # alone, as each position of all parts is one step
                found[a] = self.paths([a])[0]
        for p, some in cut.items():
            found[p] = b"".join([found[a] for a in some])
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes of 32-bit numbers, none for a null text."""
        split: list[list[str]] = []
        by_word: list[bool] = []
        for text in texts:
            text = text or ""
            words = text.split(" ") if self._by_word and text and MARK not in text else []
            by_word.append(bool(words) and "" not in words)  # single spaces: a word after each space mark
            split.append(words if by_word[-1] else self._parts.findall(self.normalise(text)))
        for kind, lead in ((False, ""), (True, MARK)):
            known, older = self._known[kind], self._older[kind]
            new = set().union(*(s for s, w in zip(split, by_word, strict=True) if w == kind)).difference(known)
            known.update((p, older[p]) for p in new & older.keys())
            new = [p for p in new if p not in known]
            made = self._learn([lead + p for p in new])
            known.update((p, made[lead + p]) for p in new)
        out = [b"".join(map(self._known[kind].__getitem__, parts)) for parts, kind in zip(split, by_word, strict=True)]
        for kind, known in self._known.items():
            if len(known) > REMEMBERED:
                self._older[kind], self._known[kind] = {p: i for p, i in known.items() if len(p) <= LONGEST}, {}
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()

    # -- decoding
    def decode(self, ids) -> str:
        parts, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in self.silent:
                parts.append(self.pieces[i] if i != self.unknown else " ⁇ ")
        if run:
            parts.append(run.decode("utf-8", "replace"))
        text = "".join(parts).replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text

    def spell(self, ids: np.ndarray) -> bytes:
        """The pieces of many ids one after the other, with spaces for space marks."""
        sizes = self._size[ids]
        ends = np.cumsum(sizes)
        return self._spelt[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._spelt_at[ids] - ends + sizes, sizes)].tobytes()

    def returns(self, text: str | None, ids: bytes) -> bool | None:
        """Do the ids decode to the text (space marks as spaces)?"""
        if text is None:
            return None
        back = self.spell(np.frombuffer(ids, np.int32))
        want = text.replace(MARK, " ")
        return back == (" " + want if self.prefix and want else want).encode() or self.decode(np.frombuffer(ids, np.int32).tolist()) == want


def encode(docs: DataFrame, text_col: str = "text", model_file: str = MODEL_FILE, ids_col: str = "piece_ids", same_col: str = "roundtrip") -> DataFrame:
    """``docs`` with ids_col (array of int) and same_col (the ids decode to the text); see ``free_name`` for names that ``docs`` has."""
    ids_col, same_col, made_col = free_name(docs, ids_col), free_name(docs, same_col), free_name(docs, "_pieces")
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_model(model_file))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean_worker(keep=("spm", model_file))
        fst = worker_state(("spm", model_file), lambda: Transducer(**shared.value))
        for column in texts:
            flat, sizes, same, null = [b""], [0], [], []
            for at, to, _, _ in text_slices(column, SLICE):
                some = column.slice(at, to - at).to_pylist()
                found = fst.encode_all(some)
                flat += found
                sizes += [len(x) // 4 for x in found]
                null += [t is None for t in some]
                same += [fst.returns(t, x) for t, x in zip(some, found, strict=True)]
            ends = pa.array(np.cumsum(sizes).astype(np.int32), mask=np.array([*null, False]))
            ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(flat), np.int32)))
            yield pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], ["ids", "same"])

    made = F.arrow_udf(run, "ids array<int>, same boolean")(F.col(f"`{text_col}`"))
    return docs.withColumn(made_col, made).withColumns({ids_col: F.col(f"{made_col}.ids"), same_col: F.col(f"{made_col}.same")}).drop(made_col)


def decode(rows: DataFrame, ids_col: str = "piece_ids", out_col: str = "decoded", model_file: str = MODEL_FILE) -> DataFrame:
    """``rows`` with the text of their ids."""
    shared = rows.sparkSession.sparkContext.broadcast(read_model(model_file))

    def run(parts):
        fst = worker_state(("spm", model_file), lambda: Transducer(**shared.value))
        for part in parts:
            yield part.map(lambda ids: None if ids is None else fst.decode(ids))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(out_col, F.pandas_udf(run, "string")(ids_col))


def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs).select("doc_id", F.coalesce(F.size("piece_ids").cast("long"), F.lit(0)).alias("n_pieces"), "piece_ids", "roundtrip")
