"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes holds how often each byte followed each context of up to
``ORDER`` bytes. A byte seen in its context is coded there, with its share of the context's count and kinds of
bytes; any other escapes to the next shorter context (escape method C), where the bytes seen in the longer one
are left out of all counts (exclusion); below order 0 all bytes left are equally likely. After training the
counts are frozen, so the code length of a byte is a function of its context alone and is tabulated: one row
for each context that the trees keep, one column for each byte seen in training, one value for each language.
A text's code length is the exact sum of these values; the language of the least code length wins.

The trees keep the ``MAX_CONTEXTS`` commonest contexts of each order, a bound on what is broadcast; a byte after
any other context is coded in the longest one kept.

Nulls and edge cases: a null, empty or letterless text is ``und`` with score 0; training skips rows with a
null text or language; with no training rows at all every text is ``und``. Ties go to the language that
sorts first. Very long texts are read whole. Repeated rows are judged alike. Columns of the input other than
the named ones are passed through by ``predict`` and never read; its own columns get an underscore where a name is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import free_name, lean_worker, small_batches, table, text_slices

ORDER = 3
#: Bounds of the training sample: so many texts and grams of each language, and so many contexts kept.
TRAIN_TEXTS_PER_LANGUAGE, MAX_CONTEXTS, MAX_GRAMS = 3000, 20_000, 400_000
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class PpmModel:
    languages: list[str]
    symbol: np.ndarray  # byte -> column, 0 for bytes not seen
    n_symbols: int
    row_of: np.ndarray  # the last ORDER symbols -> row of the longest context kept
    bits: np.ndarray  # [row * n_symbols + symbol, language]

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code length in bits of each text in each language."""
        n, width = len(data), self.n_symbols
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        if not n:
            return out
        sym = self.symbol[data].astype(np.int64)
        place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
        key = np.zeros(n, np.int64)
        for back in range(1, ORDER + 1):  # column `width` stands for "before the text"
            prior = np.full(n, width, np.int64)
            prior[back:] = sym[:-back] if back < n else sym[:0]
            prior[place < back] = width
            key += prior * (width + 1) ** (back - 1)
        cost = self.bits[self.row_of[key] * width + sym]
        full = np.flatnonzero(np.diff(bounds))
        out[full] = np.add.reduceat(cost, bounds[:-1][full], axis=0, dtype=np.float64)
        return out


def _grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ORDER bytes before it as one key (0x100 for before the text), and how often."""
    n = len(data)
    place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    key = data.astype(np.int64)
    for back in range(1, ORDER + 1):
        prior = np.full(n, 256, np.int64)
        prior[back:] = data[:-back] if back < n else data[:0]
        prior[place < back] = 256
        key |= prior << (9 * back)
    return np.unique(key, return_counts=True)


def gram_counts(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, n: counts of (ORDER + 1)-byte sequences, summed on the map side first."""

    def run(batches):
        lean_worker()
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                sums: dict[int, int] = {}
                for _, _, data, bounds in text_slices(batch.column(0).filter(pa.array(langs == lang)), 1 << 20):
                    for k, c in zip(*(x.tolist() for x in _grams(data, bounds)), strict=True):
                        sums[k] = sums.get(k, 0) + c
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums), pa.string()), pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["lang", "gram", "n"])

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_TEXTS_PER_LANGUAGE) -> PpmModel:
    """Fit on a bounded sample of labelled rows: about ``per_language`` whole texts of each language, drawn by a hash of the id.

    Every language is learned. At most ``MAX_GRAMS`` grams of each, the most frequent, come to the driver.
    """
    known = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = known.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_size"))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000))
    drawn = known.join(F.broadcast(sizes), F.col(lang_col) == F.col("_lang")).where(draw < F.floor((F.lit(1_000_000 * per_language) + F.col("_size") - 1) / F.col("_size")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    grams = gram_counts(drawn, text_col, lang_col).select("*", place.alias("place")).where(F.col("place") <= MAX_GRAMS)
    rows = grams.orderBy(F.desc("n"), "lang", "gram").toArrow()
    lang = rows.column("lang").combine_chunks().dictionary_encode()  # not a Python string for each row
    languages, codes = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    gram, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
    del rows, lang
    model = build(languages, codes, gram, n)
    del codes, gram, n
    lean_worker()  # this is the driver, which goes on to other work
    return model


def build(names: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> PpmModel:
    """Tabulate PPM code lengths from counts n of grams of languages (``lang``: places in ``names``)."""
    languages = sorted(names)
    if not languages:
        return PpmModel([], np.zeros(256, np.int16), 1, np.zeros(2**ORDER, np.int32), np.zeros((1, 0), np.float32))
    lang, count = np.searchsorted(languages, names).astype(np.int32)[lang], n.astype(np.float64)
    parts = [((gram >> (9 * k)) & 511).astype(np.int16) for k in range(ORDER + 1)]  # parts[0] is the byte coded
    # every byte seen has a column; column 0 stands for each of the others
    kept = np.unique(parts[0])
    symbol = np.zeros(256, np.int16)
    symbol[kept] = np.arange(1, len(kept) + 1)
    width = len(kept) + 1
    as_symbol = np.append(symbol, np.int16(width))  # 256: before the text
    sym = [as_symbol[p] for p in parts]
    del parts

    def keys(order: int) -> np.ndarray:
        k = np.zeros(len(gram), np.int64)
        for back in range(1, order + 1):
            k += sym[back].astype(np.int64) * (width + 1) ** (back - 1)
        return k

    n_lang = len(languages)
    before = None  # of the order below: counts, and shares of the bytes that escape
    below = None
    all_rows: list[np.ndarray] = []
    n_rows = 0
    row_of_context = np.zeros(1, np.int64)  # row of each context of the order below
    for order in range(ORDER + 1):
        k = keys(order)
        contexts, where = np.unique(k, return_inverse=True)
        if len(contexts) > MAX_CONTEXTS:  # the most frequent ones
            weight = np.bincount(where, weights=count)
            best = np.sort(np.argsort(-weight, kind="stable")[:MAX_CONTEXTS])
            chosen = np.isin(where, best)
            contexts = contexts[best]
            where = np.searchsorted(contexts, k[chosen])
        else:
            chosen = np.ones(len(gram), bool)
        counts = np.zeros((len(contexts), width, n_lang), np.float32)
        np.add.at(counts, (where, sym[0][chosen], lang[chosen]), count[chosen])
        p, escaped = np.empty_like(counts), np.empty_like(counts)
        suffix = below[contexts % (width + 1) ** (order - 1)] if order else None
        for k in range(n_lang):  # one at a time, as the driver holds all of it
            own = counts[:, :, k].astype(np.float64)
            seen = own > 0
            total, kinds = own.sum(1, keepdims=True), seen.sum(1, keepdims=True)
            if before is None:
                rest = np.broadcast_to(1 / np.maximum(256 - kinds, 1), own.shape)
            else:
                # a context that is not kept has no children that are kept: its count is no less than theirs
                left = np.where(seen, 0, before[0][:, :, k][suffix])
                left_total, left_kinds = left.sum(1, keepdims=True, dtype=np.float64), (left > 0).sum(1, keepdims=True)
                room = np.maximum(left_total + left_kinds, 1)
                rest = np.where(left > 0, left / room, np.where(left_kinds > 0, left_kinds / room, 1.0) * before[1][:, :, k][suffix])
            room = np.maximum(total + kinds, 1)
            escaped[:, :, k] = rest
            p[:, :, k] = np.where(seen, own / room, np.where(total > 0, kinds / room, 1.0) * rest)
        before = counts, escaped
        all_rows.append(p)
        # where each full key finds its row: longer contexts overwrite shorter ones
        size = (width + 1) ** order
        own = np.full(size, -1, np.int64)
        own[contexts] = n_rows + np.arange(len(contexts))
        if order:
            suffix_rows = np.arange(size) % (width + 1) ** (order - 1)
            own = np.where(own >= 0, own, row_of_context[suffix_rows])
        row_of_context = own
        local = np.full(size, 0, np.int64)
        local[contexts] = np.arange(len(contexts))
        below = local
        n_rows += len(contexts)
    before = counts = p = escaped = None
    bits = np.concatenate([x.reshape(-1, n_lang) for x in all_rows])
    np.negative(np.log2(bits, out=bits), out=bits)
    return PpmModel(languages, symbol, width, row_of_context.astype(np.int32), bits)


def predict(docs: DataFrame, model: PpmModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (posterior under equal priors), bits_per_byte under that language; see ``free_name`` for names that ``docs`` has."""
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vars(model))  # its size is bounded by MAX_CONTEXTS, 256 bytes and the languages

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean_worker()
        m = PpmModel(**shared.value)
        for column in texts:
            lang, score, rate = [], [np.zeros(0)], [np.zeros(0)]
            for at, to, data, bounds in text_slices(column):
                letters = np.array([bool(t and _LETTER.search(t)) for t in column.slice(at, to - at).to_pylist()])
                if m.languages:
                    bits = m.score(data, bounds)
                    best = bits.argmin(1)
                    least = bits.min(1)
                    share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                    lang += [m.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                    score.append(np.where(letters, share, 0.0))
                    rate.append(np.where(letters, least / np.maximum(np.diff(bounds), 1), 0.0))
                else:
                    lang += ["und"] * (to - at)
                    score.append(np.zeros(to - at))
                    rate.append(np.zeros(to - at))
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(rate))], ["lang_pred", "score", "bits_per_byte"])

    told = free_name(docs, "_told")
    named = {free_name(docs, c): F.col(f"{told}.{c}") for c in ("lang_pred", "score", "bits_per_byte")}
    return docs.withColumn(told, F.arrow_udf(run, "lang_pred string, score double, bits_per_byte double")(F.col(text_col))).withColumns(named).drop(told)


def with_language(docs: DataFrame, model: PpmModel, text_col: str = "text") -> DataFrame:
    """The rows to which ``predict`` gives a language, with their own columns only."""
    told = predict(docs, model, text_col)
    return told.where(F.col(told.columns[len(docs.columns)]) != "und").select(*(F.col(f"`{c}`") for c in docs.columns))


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter: those that ``predict`` gives a language if it knows any."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()], pa.bool_())

    small_batches(docs.sparkSession)
    return docs.where(F.arrow_udf(run, "boolean")(F.col(text_col)))


def fold_of(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def language_id(documents: DataFrame) -> DataFrame:
    """Train on the two folds that are not held out, predict every document."""
    held_out = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    rows = documents.select("doc_id", "text", "lang")
    model = fit(rows.where(~held_out & F.col("doc_id").isNotNull()))
    return predict(rows.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op7(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))
