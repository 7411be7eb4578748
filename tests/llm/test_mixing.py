"""Mixing against targets computed one by one, whole permutations and the mix's own texts."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from tally.llm import mixing

SF = "/root/testdata/sf0.001"


def split(t):
    return [w.decode() for w in (t or "").encode().split()]


def shares(size, share=1.5, most=2.0, weights=(3, 1, 2)):
    """The targets as the rule says: share, cut, share the excess again."""
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(size.values()), list(names), {}
    while free:
        per = left / sum(weight[s] for s in free)
        cut = [s for s in free if per * weight[s] > most * size[s]]
        if not cut:
            return out | {s: per * weight[s] for s in free}
        for s in cut:
            out[s] = most * size[s]
            left -= out[s]
            free.remove(s)
    return out


def check(rows, got):
    sizes = {(i, t, s): len(split(t)) for i, t, s in rows}
    total = defaultdict(int)
    for i, t, s in rows:
        total[s] += len(split(t))
    want = shares(total)
    return sizes, total, want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000, 4097])
def test_permutations(n):
    for key in (0, 1, 12345):
        x = np.arange(n)
        p = mixing.permute(x, np.full(n, n), np.full(n, key))
        assert sorted(p.tolist()) == x.tolist()
        assert mixing.permute(p, np.full(n, n), np.full(n, key), inverse=True).tolist() == x.tolist()
        assert n < 100 or abs(np.corrcoef(x, p)[0, 1]) < 0.2


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 5, 7], [0, 3], [0, 0], [100, 1, 1, 1, 1], [7, 9, 1000, 3, 3, 3, 500], [5]])
def test_targets(spark, sizes):
    size = {f"s{i}": n for i, n in enumerate(sizes)} | {None: 4}
    for s in (size, {"only": 8}):
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(s.items()), "source string, size long")).collect()}
        assert got == pytest.approx(shares(s)) and sum(got.values()) == pytest.approx(1.5 * sum(s.values()))
        assert all(got[k] <= 2 * s[k] + 1e-9 for k in s)


def test_query(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    _, total, want = check(rows, None)
    source = {i: s for i, _, s in rows}
    text = {i: t for i, t, _ in rows}
    got = mixing.query(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(source)
    took = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.size == len(split(text[r.doc_id])) and r.source_size == total[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        took[s] += r.taken
    assert {s: took[s] for s in total} == {s: round(want[s]) for s in total}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = mixing.query(spark, SF).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_spans_are_the_blocks_of_the_permutations(spark):
    rows = [(i, " ".join(f"w{i}.{k}" for k in range(i * 7 % 40)), "abc"[i % 3] if i % 11 else None) for i in range(120)]
    rows += [(i, " ".join(f"w{i}.{k}" for k in range(400)), "a") for i in (500, 501)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block=16, shard_slots=8)
    docs = got.documents.collect()
    place = {(d.sid, d.offset): d for d in docs if d["size"]}
    spans = got.texts(df).collect()
    words = {i: split(t) for i, t, _ in rows}
    assert all(s.text.split() == words[s.doc_id][s["first"]:s["first"] + s.words] and s.doc_id == place[s.sid, s.offset].doc_id for s in spans)
    # every slot is one piece of one block, from its head on, in the source's order
    slots = defaultdict(list)
    for s in spans:
        slots[s.shard, s.slot, s.sid, s.block].append((s.head, s.words, s.offset + s["first"]))
    assert len({k[:2] for k in slots}) == len(slots)
    for (_, _, sid, block), parts in slots.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(parts, parts[1:]))
        assert all(at == block * 16 + head for head, _, at in parts)
    # whole passes take every block once more
    times, size, target = Counter((k[2], k[3]) for k in slots), {d.sid: d.source_size for d in docs}, {d.sid: d.target for d in docs}
    for sid, n in size.items():
        if n:
            blocks, passes = -(-n // 16), round(target[sid]) // n
            assert {times[sid, b] for b in range(blocks)} <= {passes, passes + 1}
    per_shard = Counter(k[0] for k in slots)
    assert all(per_shard[s] == 8 for s in per_shard if s != max(per_shard)) and sorted(per_shard) == list(range(len(per_shard)))
    took = Counter()
    for s in spans:
        took[s.sid] += s.words
    assert {k: v for k, v in took.items()} == {s: round(t) for s, t in target.items() if round(t)}


def test_edges(spark):
    rows = [(1, None, None), (None, "a b c", "s"), (None, "a b c", "s"), (None, None, "s"), (3, "", "t"), (4, " \n", None), (4, "x " * 5000, None), (5, "y" * 100_000, "u"), (5, "y", "u")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, size int, sid string")
    got = mixing.mix(df, block=16)
    _, total, want = check(rows, None)
    docs = got.documents.collect()
    assert len(docs) == len(rows) and {d.source: d.target for d in docs} == pytest.approx(want)
    took = Counter()
    for s in got.spans.collect():
        took[s.sid] += s.words
    assert {d.source: took[d.sid] for d in docs} == {s: round(t) for s, t in want.items()}
    empty = mixing.mix(df.limit(0))
    assert empty.documents.collect() == [] and empty.spans.collect() == []
    blank = mixing.mix(df.where("text IS NULL"))
    assert blank.spans.collect() == [] and [d.target for d in blank.documents.collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        mixing.mix(df, most=1.0)
