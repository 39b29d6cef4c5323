"""Cross-tokenizer alignment against a plain whole-text version."""

import hashlib
import random
from collections import Counter

import pytest

from panelspark.llm import alignment

SCHEMA = "doc_id long, text string"
ODD = ["", None, " ", "  ", "a", " a", "a ", "a\n \nb", "x \n\n y", "\t tab\t\t b", "漢字 かな 😀😀 é", "naïve café\n\n\nzwei  drei   vier", "<|endoftext|> <s> </s> <unk> <0x0A>", "mark ▁ here", "a▁ b", "don't they're we'll",
       "᠎ ᠎ x", "\x85 \x1c a\x1f b 　 c  d", "zero\x00byte", "a" * 5000, "word " * 3000, "한국어 텍스트 😀 👩‍👩‍👧 é"]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(alignment.read_models())


def brute(pair, rows):
    """The contract with whole texts and byte positions: each text's ids, then links of all bytes, then groups."""
    per, counts = {}, Counter()
    for d, text in rows:
        if not text:
            per[d] = ([], [], [], [])
            continue
        a = pair.a.encode(" " + text, add_special_tokens=False).ids
        b = pair.b.encode(text)
        x, y = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            per[d] = ([], [], [], [])
            continue
        own = [[k for k, t in enumerate(side) for _ in t] for side in (x, y)]  # the token of every byte
        links = sorted({(i, j) for i, j in zip(*own)})
        counts.update((a[i], b[j]) for i, j in links)
        ends = [{sum(map(len, side[: k + 1])) for k in range(len(side))} if len(side) < 300 else set(_cumulated(side)) for side in (x, y)]
        cuts = sorted(ends[0] & ends[1])
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        for c in cuts:
            ga, gb = [], []
            while at_a < c:
                ga.append(a[i]); at_a += len(x[i]); i += 1
            while at_b < c:
                gb.append(b[j]); at_b += len(y[j]); j += 1
            groups.append((ga, gb))
        per[d] = (a, b, [(a[i], b[j]) for i, j in links], groups)
    top = Counter()
    for (i, j), n in counts.items():
        top[j] = max(top[j], n)
    out = {}
    for d, (a, b, links, groups) in per.items():
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out[d] = (len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "")
    return out


def _cumulated(side):
    at = 0
    for t in side:
        at += len(t)
        yield at


def rows_of(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_parts_give_what_whole_texts_give(pair):
    rng = random.Random(5)
    alphabet = [" ", " ", "\n", "\t", "a", "b", "é", "漢", "😀", "'s", "1", ".", " ", "᠎", "\x1c", "　", "the", "▁"[:0]]
    for text in [t for t in ODD if t] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(4000)]:
        parts = alignment.parts_of(text)
        assert " " + " ".join(parts) == " " + text
        whole, split = next(pair.encode([text])), list(pair.encode(parts))
        if whole is None:
            assert None in split
        else:
            assert [i for p in split for i in p[0]] == list(whole[0]), repr(text)
            assert [i for p in split for i in p[1]] == list(whole[1]), repr(text)


def test_spans_and_bytes_give_the_same_ends(pair):
    for text in ODD:
        if text and (made := next(pair.encode([text]))):
            a, b, ends_a, ends_b = made
            assert list(ends_a) == list(_cumulated([pair.a_bytes[i] for i in a]))
            assert list(ends_b) == list(_cumulated([pair.b_bytes[i] for i in b]))


@pytest.mark.parametrize("sent, kept", [(alignment.SENT_PAIRS, alignment.KEPT_PARTS), (40, 25), (1, 1)])
def test_alignment_equals_brute_force(spark, pair, sent, kept):
    rng = random.Random(7)
    words = ["the", "über", "naïve", "漢字", "tokenization", "😀", "isn't", "foo_bar", "1999", "…", "étoile"]
    rows = list(enumerate(ODD)) + [(100 + k, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(alignment.align(df, sent_pairs=sent, kept_parts=kept)) == brute(pair, rows)


def test_rows_that_repeat_null_ids_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([(1, "same text", "x"), (1, "same text", "y"), (None, "same text", None)], "doc_id long, text string, pair string")
    got = alignment.align(df, with_groups=True).collect()
    assert len(got) == 3 and len({tuple(r)[1:] for r in got}) == 1
    assert got[0]["n_best"] == got[0]["n_links"] and got[0]["count_sum"] == 3 * got[0]["n_links"]
    assert hashlib.sha256(got[0]["groups"].encode()).hexdigest() == got[0]["groups_sha256"]
    assert alignment.align(df.limit(0)).count() == 0


def test_given_documents_equal_brute_force(spark, pair):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert rows_of(alignment.op11(spark, "/root/testdata/sf0.001")) == brute(pair, [tuple(r) for r in df.collect()])
