"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tally.llm import spelling

SF = "/root/testdata/sf0.001"


def words_of(rows):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            if len(w) >= 7:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= 2}


def deletions(w):
    return {(w[:i], w[i + 1:]) for i in range(len(w))}


def near_pairs(words):
    """All ordered pairs one edit apart, by shared deletions, checked one by one."""
    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    seen = {}
    for w in words:
        for v in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            seen.setdefault(v, set()).add(w)
    return {(a, b) for group in seen.values() for a in group for b in group if a != b and one_edit(a, b)}


def expect(n, times=10):
    near = {w: set() for w in n}
    for a, b in near_pairs(n):
        near[a].add(b)
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= times * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in spelling.query(spark, SF).collect()]
    want = expect(words_of(rows))
    assert set(got) == want and len(got) == len(want) and any(r[1] for r in got) and any(r[4] > 1 for r in got)


def vocabulary_of_variants(rng, stems=60, most=40):
    n = {}
    letters = "abcdeé×ÿ"
    for _ in range(stems):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(7, 12)))
        c = 3 * 10 ** rng.randint(1, 6)
        n[w] = c
        for _ in range(rng.randint(0, most)):
            i, x = rng.randrange(len(w)), rng.choice(letters)
            v = rng.choice([w[:i] + x + w[i + 1:], w[:i] + w[i + 1:], w[:i] + x + w[i:], w + x])
            if len(v) >= 7:
                n.setdefault(v, rng.choice([2, max(2, c // 10), max(2, c // 9)]))
                if rng.random() < 0.5:
                    w, c = v, n[v]
    return n


@pytest.mark.parametrize("block", [50_000, 40, 3])
def test_variants_in_whole_fine_and_cut_groups(spark, block):
    n = vocabulary_of_variants(random.Random(block))
    for i in range(60):  # one half shared by many words of a length
        n["aaaaaaa" + "".join(random.Random(i).choice("bcd") for _ in range(5))] = 2 + i % 3
    for w in ("aaaaaaaaaa", "aaaaaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ababababa"):
        n[w] = 2 + len(w) ** 3
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    pairs = [tuple(r) for r in spelling.near_words(df, block).select("word", "near").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == near_pairs(n)
    got = {tuple(r) for r in spelling.spelling_forms(df, block=block).collect()}
    assert got == expect(n)


def test_chains_end_at_their_root(spark):
    chain = ["aaaaaaab", "aaaaaaabc", "aaaaaaabcd", "aaaaaaabcde", "aaaaaaabcdef", "aaaaaaabcdefg", "aaaaaaabcdefgh"]
    n = {w: 2 * 10 ** i for i, w in enumerate(chain)} | {"zzzzzzzz": 5}
    got = {r.word: r.root for r in spelling.spelling_forms(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == {w: chain[-1] for w in chain} | {"zzzzzzzz": "zzzzzzzz"}


def test_edges(spark):
    rows = [(1, None), (None, "Ordinary words, ORDINARY"), (None, "Ordinary words, ORDINARY"), (3, ""), (4, "ÀÀ×÷abcd ÀÀ×÷abcd"), (5, "a" * 200_000 + " " + "a" * 200_000),
            (6, "sevenab sevenab sixabc sixabc"), (6, "ordinarz ORDINARZ Āordinary x1ordinary")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, word int, n string")
    got = {r.word: r.n for r in spelling.vocabulary(df, change=spelling.misspelt).collect()}
    assert got == words_of(rows) and "a" * 200_000 in got
    out = {tuple(r) for r in spelling.spelling_forms(spelling.vocabulary(df, change=spelling.misspelt)).collect()}
    assert out == expect(words_of(rows))
    assert spelling.spelling_forms(spelling.vocabulary(df.limit(0))).collect() == []
    assert spelling.near_words(spark.createDataFrame([], "word string, n long")).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_forms(spark.createDataFrame([("abcdefg", 2)], "word string, n long"), times=1)
