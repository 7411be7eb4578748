"""Periodic runs against a brute force over all stretches of words."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tally.llm import runs
from tally.llm.common import Words

SF = "/root/testdata/sf0.001"


def brute(w, least=12):
    """Every (start, length, period): all periods, maximal stretches, smallest period kept."""
    best = {}
    n = len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, ln, q) for (s, ln), q in best.items())


def split(text):
    return [x.decode() for x in (text or "").encode().split()]


def plant(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def digest(doc_id, text):
    w = plant(doc_id, split(text))
    found = brute(w)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, ln, q in found for i in range(s + q, s + ln)}
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None,
            hashlib.sha256("".join(f"{s},{ln},{q}\n" for s, ln, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def found(texts, least):
    words = Words(pa.array(texts), lower=False)
    s, ln, q = runs.word_runs(words, least)
    t = np.searchsorted(words.first, s, side="right") - 1
    out = [[] for _ in texts]
    for k, a, b, c in zip(t.tolist(), (s - words.first[t]).tolist(), ln.tolist(), q.tolist()):
        out[k].append((a, b, c))
    return out


def periodic(rng):
    """A text of random pieces, many of them repeated to whole and broken exponents, nested as well."""
    w = []
    for _ in range(rng.randint(1, 6)):
        base = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.4:
            base = base * rng.randint(2, 4) + [rng.choice("abcd")]
        w += (base * rng.randint(1, 9))[:rng.randint(1, 60)]
    return w


@pytest.mark.parametrize("least", [2, 3, 7, 12])
def test_runs_of_random_and_nested_texts(least):
    rng = random.Random(least)
    texts = [" ".join(periodic(rng)) for _ in range(300)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    fib = ["b", "a"]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    texts += [" ".join(fib[-1]), None, "", "a", " ".join("a" * 500), " ".join("ab" * 200 + "a"), " ".join("aab" * 90) + " q " + " ".join("aab" * 90)]
    got = found(texts, least)
    for t, g in zip(texts, got):
        assert g == brute(split(t), least), t


def test_query_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = runs.query(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(digest(i, t) for i, t in docs.items())
    assert any(r.n_runs for r in got) and any(not r.n_runs for r in got)


def test_planted_texts(spark):
    docs = spark.createDataFrame([(i, " ".join(str(x) for x in range(i % 37))) for i in range(400)] + [(None, "a b"), (5, None)], "doc_id long, text string")
    got = docs.select("doc_id", "text", runs.planted(docs.text, docs.doc_id).alias("p")).collect()
    assert all(split(r.p) == plant(r.doc_id, split(r.text)) for r in got if r.doc_id is not None)
    assert any(split(r.p) != split(r.text) for r in got)


def test_edges(spark):
    text = "x " * 40 + "y z " * 20 + "\t\n end"
    rows = [(1, text, "r"), (1, text, "r"), (None, None, None), (3, "", "r"), (4, " \n", None), (5, "é " * 30, "r")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, row string, runs int, collapsed string")
    got = runs.periodic_runs(df).collect()
    assert sorted((str(r.row.doc_id), r.n_words, [tuple(x) for x in r.runs]) for r in got) == sorted(
        (str(i), len(split(t)), brute(split(t))) for i, t, _ in rows)
    assert [r.collapsed for r in got if r.row.doc_id == 1] == ["x y z end"] * 2 and got[0].row.collapsed == "s"
    assert [r.collapsed for r in got if r.row.doc_id in (3, 4, None)] == ["", "", ""]
    assert runs.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(df, min_length=1)


def test_very_long_texts():
    rng = random.Random(3)
    n = 200_000
    block = [str(rng.randrange(1000)) for _ in range(n // 8)]
    texts = [" ".join("a" for _ in range(n)), " ".join("ab"[i % 2] for i in range(n)), " ".join(block * 8), "a" * n, " " * n]
    got = found(texts, 12)
    assert got[0] == [(0, n, 1)] and got[1] == [(0, n, 2)] and got[3] == got[4] == []
    assert (0, n, n // 8) in got[2]
