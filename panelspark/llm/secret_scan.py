"""Secret scans: fixed patterns, and dictionary-primed compression novelty.

Base spans come from three patterns (assign, access, hex). The novelty method takes every string of token
characters in a sensitive context (a word such as key or credential shortly before it) and measures how many
bytes it adds to the compressed surrounding text, with zstandard primed by a dictionary of the corpus's
identifiers. How many bytes a string of its length and letters would add without any meaning is measured on shuffles of
the string itself, so that every alphabet has a measure of its own: what adds at least ``MIN_SHARE`` of that is
reported as a span of kind ``novel``, and an identifier, whose words the dictionary knows, is not. The context
carries on from a reported string to the next string or line, so that a key of many lines is reported whole; a last line
of under 16 characters before an end mark is part of the key above it and is not measured by itself.

The identifier dictionary is made of the words in and beside candidates that occur in most texts, counted over
all documents, after words that most programs use; at most ``DICTIONARY_WORDS`` of them reach the driver.

Edge cases: a null text counts as empty; empty texts have no spans (``base_sha256`` of the empty string);
very long texts are scanned whole; every input row gives one result row, repeated rows and null ids included.
Offsets count code points, ends are exclusive. A novel span never touches a base span.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import lean_worker, materialize, release, small_batches, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A run of 20 or more characters of the class that starts with AKIA; equal to matching all runs and dropping short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = ("key", "token", "secret", "passw", "passphrase", "credential", "auth", "bearer", "private", "signature", "session", "login")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.I | re.A)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: The next string or line after a string: only quotes, punctuation and white space lie between. The last line of a key block may be short.
_NEXT = re.compile(r"""(?:[\s"'`,;:.\\|>\#*(){}\[\]]|\+(?=\s)){1,48}([A-Za-z0-9+/_=-]{16,}|[A-Za-z0-9+/=]{1,15}(?=[\s"'\\]{1,8}(?:[rn]\\?){0,2}-----END))""")
#: A word of an identifier: it begins where the case changes or anything but a letter stands.
_IDENTIFIER = re.compile(r"[A-Z]?[a-z]{2,23}|[A-Z]{3,24}")
#: How far before a string a sensitive word counts, how much text on either side primes the compressor,
#: which share of its shuffles' bytes a string must add at least, and how many shuffles are measured.
REACH, AROUND, MIN_SHARE, SHUFFLES = 48, 160, 0.85, 4
DICTIONARY_WORDS, LEVEL = 8192, 9
#: A string of which known words make up so much is an identifier, however it is put together.
KNOWN_PART = 0.6
#: Words that most programs use. Fixed values.
COMMON = ("abstract access account action active adapter address admin agent alert array async attribute audit backend base batch bean bind block body boot bridge broker buffer build bundle button cache call "
          "callback cancel card cart case category chain channel check child class clean client clock close cloud cluster code collection column command comment common compare component config configuration connect connection "
          "console constant consumer container content context control controller convert cookie copy core count create current cursor custom data database date debug decode default delete delivery dependency deploy "
          "description detail device dialog digest directory dispatch display document domain download driver element email enable encode endpoint engine entity entry error event exception execute export factory failure "
          "feature fetch field file filter find flag folder format framework function gateway generate get global group handler hash header helper history home host http identifier image impl import index info "
          "init input insert instance interface internal invoice item iterator java job json kernel label layout legacy level library license limit link list listener load local lock log main manager map "
          "mapper master match memory merge message meta method metric migration mock model module monitor name network node notification null number object option order org output owner package page parameter parent parse "
          "path payment permission pipeline platform player plugin policy pool port position prefix price print process processor product production profile project properties property protocol provider proxy public query queue random "
          "read record registry remote render report repository request resource response result retry return role root route router rule runtime sample scan schedule schema scope script search select send serializer server service "
          "set setting shared shell sign size socket sort source spring springframework stack staging start state status step stop storage store stream string style submit subscription support switch sync system table tag "
          "target task template test text thread time timer title tool trace transaction transfer transform tree trigger type update upload user util validate validator value variable vector version view web widget window worker wrapper write")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    spans = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[dict]:
    """Strings in a sensitive context that touch no base span, with the text around them, by start.

    ``after`` is -1 for a string near a sensitive word. The strings that follow it or a base span one by one
    have in ``after`` the end of the string before: they count if that one is reported.
    """
    found, last, starts, furthest = {}, -1, [a for a, _, _ in taken], list(accumulate((b for _, _, b in taken), max))

    def add(start, end, after):
        k = bisect_left(starts, end)
        if k and furthest[k - 1] > start:
            return False
        found[start] = {"start": start, "end": end, "after": after, "value": text[start:end], "around": text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]}
        return True

    for word in _SENSITIVE.finditer(text):
        at = max(word.end(), last)
        while m := _CANDIDATE.search(text, at, min(len(text), word.end() + REACH + 16)):
            last = at = _RUN.match(text, m.start()).end()
            add(m.start(), last, -1)
    for end in sorted({b for _, _, b in taken} | {x["end"] for x in found.values()}):
        while (m := _NEXT.match(text, end)) and m.start(1) not in found and add(*m.span(1), end):
            end = m.end(1)
    return [found[k] for k in sorted(found)]


_FOUND = "array<struct<start:int,end:int,after:int,value:string,around:string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (kind, start, end), found (candidates of the novelty method) for every row."""

    def run(batches):
        lean_worker()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("after", pa.int32()), ("value", pa.string()), ("around", pa.string())]))
        for batch in batches:
            base, found = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                found.append(candidates(text, spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(found, cand)], ["doc_id", "base", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base array<struct<start:int,kind:int,end:int>>, found {_FOUND}")


def identifier_dictionary(scanned: DataFrame, words: int = DICTIONARY_WORDS) -> bytes:
    """The words in and beside candidates that occur in most surroundings, most frequent last, as raw dictionary content. Copies of a
    text have the same surroundings, so what is only copied does not become a word."""
    one = scanned.select(F.explode("found").alias("c")).select(F.xxhash64("c.around").alias("place"), F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "c.around", "c.value"), F.lit(_IDENTIFIER.pattern), F.lit(0)))).alias("word"))
    top = one.distinct().groupBy("word").count().where("count > 1").orderBy(F.desc("count"), "word").limit(words).collect()
    known = COMMON.split()
    return " ".join([*(w.capitalize() for w in known), *known, *(r["word"] for r in reversed(top)), *(w.capitalize() for w in SENSITIVE), *SENSITIVE]).encode()


class Novelty:
    def __init__(self, dictionary: bytes):
        self._known = set(dictionary.decode().lower().split())
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._c = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False)

    def _added(self, value: str, text: bytes, alone: int) -> int:
        return len(self._c.compress(text + value.encode())) - alone

    def share(self, value: str, around: str) -> float:
        """Compressed bytes that the value adds to the text around it, as a share of what shuffles of its characters add on average."""
        text = around.encode()
        alone, rng, chars = len(self._c.compress(text)), random.Random(value), list(value)
        shuffled = 0
        for _ in range(SHUFFLES):
            rng.shuffle(chars)
            shuffled += self._added("".join(chars), text, alone)
        return SHUFFLES * self._added(value, text, alone) / max(1, shuffled)

    def novel(self, value: str, around: str, min_share: float = MIN_SHARE) -> bool:
        """Is the string as new as its own letters in any order? A string of few different characters never is: its shuffles are no news
        either. Short words cost the compressor nearly as much as news, so what passes is checked against the known words."""
        return len(set(value)) >= 8 and self.share(value, around) >= min_share and not self._spelt_out(value)

    def _spelt_out(self, value: str) -> bool:
        found = sum(len(w) for w in _IDENTIFIER.findall(value) if len(w) >= 3 and w.lower() in self._known)
        return found >= KNOWN_PART * sum(c.isalnum() for c in value)


def novel_spans(novelty: Novelty, base: list[tuple[int, int, int]], found: list[dict], min_share: float = MIN_SHARE) -> list[tuple[int, int]]:
    """(start, end) of the candidates to report; spans that overlap become one."""
    ends, spans = {b for _, _, b in base}, []
    for x in found:
        if (x["after"] < 0 or x["after"] in ends) and (x["end"] - x["start"] < 16 or novelty.novel(x["value"], x["around"], min_share)):
            ends.add(x["end"])
            if spans and x["start"] < spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], x["end"]))
            else:
                spans.append((x["start"], x["end"]))
    return spans


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def judge(scanned: DataFrame, dictionary: bytes, min_share: float = MIN_SHARE) -> DataFrame:
    """The result rows from scanned rows: counts, digest of the base spans, all spans."""

    def run(batches):
        novelty = Novelty(dictionary)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                base = [(x["start"], x["kind"], x["end"]) for x in row["base"]]
                novel = [(s, 3, e) for s, e in novel_spans(novelty, base, row["found"], min_share)]
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((row["doc_id"], *n, len(novel), hashlib.sha256(digest(base).encode()).hexdigest(), digest(sorted(base + novel))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 5 + (pa.string(),) * 2, strict=True)] if out else [pa.array([], t) for t in (pa.int64(),) * 5 + (pa.string(),) * 2], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return scanned.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def secret_scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    small_batches(documents.sparkSession)
    scanned = materialize(scan(documents, id_col, text_col))
    return judge(scanned, identifier_dictionary(scanned))


def masked(text: str, novelty: Novelty, mask: str = "[SECRET]") -> str:
    """The text with every reported span replaced."""
    base = base_spans(text)
    spans = sorted([(s, e) for s, _, e in base] + novel_spans(novelty, base, candidates(text, base)))
    done, parts = 0, []
    for s, e in spans:
        if s >= done:
            parts += [text[done:s], mask]
        done = max(done, e)
    return "".join([*parts, text[done:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of its text replaced; rows and columns stay. A null text stays null."""
    spark = small_batches(docs.sparkSession)
    scanned = materialize(scan(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())).where(F.size("found") > 0))
    shared = spark.sparkContext.broadcast(identifier_dictionary(scanned))  # at most DICTIONARY_WORDS words
    release(scanned)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean_worker()
        novelty = Novelty(shared.value)
        for column in texts:
            yield pa.array([masked(t, novelty, mask) if t else t for t in (x.as_py() for x in column)], pa.string())

    return docs.withColumn(text_col, F.arrow_udf(run, "string")(F.col(text_col)))


def op2(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"))
