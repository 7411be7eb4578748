"""Each operator against a brute-force version or an exact round trip, on whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tally.llm import decontam, langid, lengths, licenses, lm, pieces, quality, shards, simhash, suffix
from tally.llm.graph import connected_components
from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words(t):
    return [w.decode() for w in (t or "").encode().lower().split()]


def alnum(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_quality_matches_sql(spark):
    r = compare(spark, SF, "op3", quality.query, quality.SQL)
    assert r["ok"], r


def fingerprint(t):
    w = words(t)
    grams = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(fps, bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= bits:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("bucket", [4096, 3])
def test_simhash_groups(spark, docs, bucket):
    fp = {i: fingerprint(r.text) for i, r in docs.items()}
    root = groups_of(set(fp.values()), 4)
    first = defaultdict(list)
    for i, f in fp.items():
        first[root[f]].append(i)
    got = simhash.simhash_groups(spark.read.parquet(f"{SF}/documents.parquet"), bucket=bucket).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", min(first[root[f]])) for i, f in fp.items()}


def test_near_links_of_a_dense_bucket(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(40, 3, replace=False)) for _ in range(120)} | {int(x) for x in rng.integers(1 << 62, size=40)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bucket in (4096, 16):
        links = {(r.u, r.v) for r in simhash.near_links(df, 4, bucket).collect()}
        assert all((a ^ b).bit_count() <= 4 for a, b in links)
        nodes = {r.node: r.root for r in connected_components(spark.createDataFrame(list(links), "u long, v long")).collect()}
        want, got = defaultdict(set), defaultdict(set)
        for f, r in groups_of(fps, 4).items():
            want[r].add(f)
        for f in fps:
            got[nodes.get(f, f)].add(f)
        assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_dedup(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.query(spark, SF).collect()}
    assert got == dict(zip(docs, removed([r.text for r in docs.values()], 200)))


@pytest.mark.parametrize("hot_bytes", [8 << 20, 400])
def test_suffix_dedup_of_periodic_and_overlapping_texts(spark, hot_bytes):
    rng = np.random.default_rng(0)
    noise = ["".join("abc"[k] for k in rng.integers(0, 3, 300)) for _ in range(4)]
    texts = ["a" * 300, "ab" * 90, "x" * 39, "y" * 40, None, "", "é" * 50, "abc" * 60 + "q" * 45,
             *["common passage " * 5 + str(i) * 9 for i in range(20)], *noise, noise[0][50:150] + "z", "p" + noise[1][:41] + "\0\0", noise[1][:41] + "\0\0\0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix.remove_repeats(df, length=40, gram=10, hot_bytes=hot_bytes).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == dict(enumerate(removed(texts, 40)))


def test_suffix_order_is_the_sorted_order():
    rng = np.random.default_rng(3)
    body = bytes(rng.integers(97, 100, 400, dtype=np.uint8))
    marks = suffix.repeated_starts([body], 8)[0]
    seen = Counter(body[i:i + 8] for i in range(len(body) - 7))
    assert marks.tolist() == [seen[body[i:i + 8]] > 1 for i in range(len(body) - 7)]


def weighted(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def shingles(w, n=5):
    n = min(n, len(w))
    return [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]


def test_decontamination(spark, docs):
    items = {r.item_id: alnum(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    text = {i: alnum(r.text) for i, r in docs.items()}
    want = {}
    for k, w in items.items():
        s = shingles(w)
        for i, t in text.items():
            if not set(s) & set(shingles(t)):
                continue
            best = max((weighted(s, shingles(t[a:a + len(w)])) for a in range(len(t) - len(w) + 1)), default=0)
            if best >= 0.8:
                want[i, k] = best
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.query(spark, SF).collect()}
    assert got == pytest.approx(want) and want


def test_decontamination_finds_edited_copies(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["w%d" % i for i in range(400)]
    item = list(rng.choice(vocabulary, 80))
    short = ["only", "three", "words"]
    def around(w):
        return " ".join([*rng.choice(vocabulary, 30), *w, *rng.choice(vocabulary, 30)])
    one = item.copy()
    one[40] = "changed"
    many = [w if i % 4 else "x%d" % i for i, w in enumerate(item)]
    texts = [around(item), around(one).upper(), around(many), around(short), around([]), ", ".join(item), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "Only three, words!"), (3, None), (4, "")], "item_id long, text string")
    got = {(r.row_id, r.item_id): r for r in decontam.matches(df, items).collect()}
    assert set(got) == {(0, 1), (1, 1), (5, 1), (3, 2)}
    assert got[0, 1].similarity == 1 and got[0, 1].word_start == 30 and got[0, 1].n_words == 80 and got[1, 1].similarity == pytest.approx(71 / 81)


def test_decontamination_of_texts_shorter_than_an_item(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["w%d" % i for i in range(400)]
    a, b = (list(map(str, rng.choice(vocabulary, n))) for n in (37, 45))
    c = b[:37]  # 37 words, so a window of c's size is a short text to b
    items = {1: a, 2: b, 3: c, 4: ["four", "words", "make", "one"], 5: ["x", "y"] * 9}
    texts = [a[:-1], a[1:], a[:18] + a[19:], a[:-6], a[:-7], a[:4], c, b[:36], b[:-1] + ["z"] * 40, ["z"] * 40 + c + ["z"] * 40,
             items[4][:3], items[4], items[5][:-2], items[5][:9], [], a[3:20] + ["new"] + a[20:33]]
    want = {}
    for i, t in enumerate(texts):
        for k, w in items.items():
            windows = [t[p:p + len(w)] for p in range(len(t) - len(w) + 1)] or [t]
            best = max((weighted(shingles(w), shingles(x)), -p, len(x)) for p, x in enumerate(windows)) if t else (0, 0, 0)
            if best[0] >= 0.8:
                want[i, k] = best
    assert {(0, 1), (1, 1), (3, 1), (6, 2), (6, 3), (7, 3), (12, 5)} <= set(want) and not {(4, 1), (5, 1), (9, 2), (10, 4)} & set(want)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "row_id long, text string")
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r.row_id, r.item_id): (r.similarity, -r.word_start, r.n_words) for r in decontam.matches(df, table).collect()}
    assert set(got) == set(want)
    for k, (s, at, n) in want.items():
        assert got[k][0] == pytest.approx(s) and got[k][2] == n
    left = {r.row_id for r in decontam.drop_contaminated(df, table).collect()}
    assert left == set(range(len(texts))) - {i for i, _ in want}


def test_decontamination_radius_loses_no_similar_pair(spark):
    rng = np.random.default_rng(21)
    items, texts = [], []
    for k in range(300):
        for n, cut in ((9, 8), (60, 49)):  # 4 of 5 and 45 of 56 shingles
            w = ["w%d" % i for i in rng.integers(0, 10**9, n)]
            items.append((len(items), " ".join(w)))
            texts.append((len(texts), " ".join(w[:cut])))
    got = decontam.matches(spark.createDataFrame(texts, "row_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.row_id, r.item_id) for r in got} == {(i, i) for i in range(len(items))}
    assert max(r.distance for r in got) > 16


def test_backoff(spark, docs):
    w = {i: words(r.text) for i, r in docs.items()}
    c = Counter(tuple(x[i:i + n]) for x in w.values() for n in (1, 2, 3) for i in range(len(x) - n + 1))
    total = sum(map(len, w.values()))

    def s(h, x):
        if not h:
            return c[(x,)] / total
        return c[h + (x,)] / c[h] if c[h + (x,)] >= 2 else 0.4 * s(h[1:], x)
    want = {i: sum(math.log10(s(tuple(x[max(0, k - 2):k]), x[k])) for k in range(len(x))) for i, x in w.items()}
    for size in (8 << 20, 50_000):
        got = lm.backoff_scores(spark.read.parquet(f"{SF}/documents.parquet"), block_bytes=size).collect()
        assert {r.doc_id: r.log10_score for r in got} == pytest.approx(want)
        assert {r.doc_id: r.n_words for r in got} == {i: len(x) for i, x in w.items()}


def test_licenses(spark, docs):
    want = {}
    for i, r in docs.items():
        t = alnum(r.text)
        have = set(shingles(t)) if len(t) > 4 else set()
        for name, template in licenses.TEMPLATES:
            m = alnum(template)
            s = set(shingles(m))
            span = len(m) + max(1, len(m) // 4)
            if s & have:
                best = max(len(s & set(shingles(t[a:a + span]))) / len(s) for a in range(max(1, len(t) - 4)))
                if best >= 0.8:
                    want[i, name] = max(best, want.get((i, name), 0))
    got = licenses.query(spark, SF)
    assert {(r.doc_id, r.license): r.containment for r in got.collect()} == pytest.approx(want) and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_license_positions_and_partial_notices(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    texts = ["a b c d e f g " + gpl + " tail", gpl.replace("version 3", "version 2"), "licensed under the GNU", "a b c " + gpl.upper(), None, ""]
    got = {(r.doc_id, r.license): (r.containment, r.word_start) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {(0, "GPL-3.0"): (1.0, 7), (1, "GPL-3.0"): (0.875, 0), (3, "GPL-3.0"): (1.0, 3)}


def test_every_license_template_is_found(spark):
    """Each template inside a text; long ones with their last tenth missing too, whatever stands around them."""
    texts, want = [], {}
    for k, (name, template) in enumerate(licenses.TEMPLATES):
        want[len(texts)] = (name, 1.0, k)
        texts.append(" ".join(f"w{k}x{i}" for i in range(k)) + " /* " + template.replace(" ", "\n * ", 1) + " */ end")
        words = template.split()
        if len(words) >= 50:
            want[len(texts)] = (name, None, 0)
            texts.append(" ".join(words[:-len(words) // 10]) + " and nothing else")
    found = defaultdict(dict)
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        found[r.doc_id][r.license] = (r.containment, r.word_start)
    for i, (name, share, start) in want.items():
        assert found[i][name][1] == start and (found[i][name][0] == share or share is None and 0.8 <= found[i][name][0] <= 1), (i, name, found[i])


def test_licenses_are_told_apart():
    """No template's shingles lie to 80 % in a template of another license, or it would be reported along."""
    each = [(name, set(shingles(alnum(template)))) for name, template in licenses.TEMPLATES]
    assert all(len(s & t) < 0.8 * len(s) for a, s in each for b, t in each if a != b)


def test_license_shingles_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MAX_SHINGLES", 10)
    with pytest.raises(ValueError, match="shingles"):
        licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    got = langid.query(spark, sf).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out and r.n >= 100]
    assert len(test) > 100 and sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97
    assert all(r.lang_pred in {"en", "de", "fr", "es", "und"} for r in got)


def test_language_predictions_recomputed(spark, docs):
    """Every text encoded piece by piece with each language's dictionary; close calls, nulls and letterless texts are ``und``."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    dictionaries = langid.fit(df)
    odd = [(-1, None), (-2, ""), (-3, "123 ... 456"), (-4, "a"), (-5, "Ünïcode 5"), (None, "the of and to in")]
    texts = odd + [(i, r.text) for i, r in docs.items()]

    def encoded(raw, dictionary):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=6)
        c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)
        return sum(len(c.compress(raw[a:a + 4096])) for a in range(0, len(raw), 4096))

    want = {}
    for i, t in texts:
        if not any(c.isalpha() for c in t or ""):
            want[i] = ("und", 0.0)
            continue
        (least, lang), (second, _), *_ = sorted((encoded(t.lower().encode(), d), k) for k, d in dictionaries.items())
        want[i] = (lang if second - least > 0.01 * second else "und", 1 - least / second)
    got = langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), dictionaries).collect()
    assert len(got) == len(texts) and len(dictionaries) > 2
    assert {r.doc_id: r.lang_pred for r in got} == {i: x for i, (x, _) in want.items()}
    assert {r.doc_id: r.score for r in got} == pytest.approx({i: x for i, (_, x) in want.items()})
    assert {r.doc_id for r in got if r.held_out} == {i for i, _ in texts if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}


def test_dictionaries_never_see_held_out_rows(spark):
    rows = [(i, f"secret{i} " * 20, "en") for i in range(50)]
    d = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["en"].decode()
    for i, *_ in rows:
        assert (f"secret{i} " in d) == (zlib.crc32(str(i).encode()) % 5 != 0)


def test_shards(spark, docs):
    got = shards.query(spark, SF).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    for r in got:
        raw = (docs[r.doc_id].text or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "key" and r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and slots
    assert got == shards.query(spark, SF).collect() or sorted(got) == sorted(shards.query(spark, SF).collect())


def xxh64(*values):
    """Spark's xxhash64 of values as bytes: each hashed with the hash before it as seed (nulls skipped), signed."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v, h)
    return h - (1 << 64) if h >> 63 else h


def test_shards_and_order_recomputed(spark):
    """Shard, grown shard and slot of every row from the definition: highest vote, seeded bucket, shuffled rows."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = df.union(spark.createDataFrame([(None, "x"), (10**6, None), (10**6 + 1, ""), (None, None)], "doc_id long, text string"))
    rows, bucket_bytes, shards_n, seed = df.collect(), 20_000, 3, 5
    total = sum(len((r.text or "").encode()) + 1 for r in rows)
    each = -(-total // (shards_n * bucket_bytes))
    long = lambda x: None if x is None else x.to_bytes(8, "little", signed=True)
    raw = lambda x: None if x is None else x.encode()
    number = lambda x: x.to_bytes(4, "little", signed=True)

    def shard(r, n):
        return max(range(n), key=lambda i: (xxh64(number(seed), number(i), long(r.doc_id)), -i))

    buckets = defaultdict(list)
    for r in rows:
        part = xxh64(number(seed + 1), long(r.doc_id), raw(r.text)) % each
        buckets[shard(r, shards_n) * each + part].append(r)
    expected = []
    for s in range(shards_n):
        order = []
        for b in range(s * each, (s + 1) * each):
            sorted_rows = sorted(buckets[b], key=lambda r: (xxh64(long(r.doc_id), raw(r.text)), -1 if r.doc_id is None else r.doc_id))
            order += [sorted_rows[i] for i in np.random.default_rng((seed, b)).permutation(len(sorted_rows))]
        expected += [(r.doc_id, r.text, s, slot, shard(r, shards_n + 1)) for slot, r in enumerate(order)]
    got = shards.shuffle_into_shards(df, shards=shards_n, seed=seed, bucket_bytes=bucket_bytes)
    got = [tuple(r) for r in got.select("row.doc_id", "row.text", "shard", "slot", "grown_shard").collect()]
    assert each > 2 and Counter(got) == Counter(expected)


def test_shards_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    a = shards.shuffle_into_shards(df, shards=3, bucket_bytes=20_000).select("row.doc_id", "shard", "slot").collect()
    monkeypatch.setattr(shards, "MAX_BROADCAST", 0)
    b = shards.shuffle_into_shards(df, shards=3, bucket_bytes=20_000).select("row.doc_id", "shard", "slot").collect()
    assert sorted(a) == sorted(b)


def test_shards_in_small_buckets(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    a = shards.shuffle_into_shards(df, shards=3, bucket_bytes=20_000).select("row.doc_id", "shard", "slot").collect()
    b = shards.shuffle_into_shards(df.orderBy("n_chars"), shards=3, bucket_bytes=20_000).select("row.doc_id", "shard", "slot").collect()
    assert sorted(a) == sorted(b)  # the order of arrival doesn't matter
    for s in range(3):
        order = [r.doc_id for r in sorted((r for r in a if r.shard == s), key=lambda r: r.slot)]
        assert [r.slot for r in sorted((r for r in a if r.shard == s), key=lambda r: r.slot)] == list(range(len(order)))
        assert order != sorted(order)


def test_token_lengths(spark, docs):
    enc = lengths.encoder(open(lengths.VOCABULARY, "rb").read())
    n = sorted(len(enc.encode_ordinary(r.text or "")) for r in docs.values())
    sums = lengths.query(spark, SF)
    rows = {r.n_tokens: r for r in sums.collect()}
    assert {k: r.docs for k, r in rows.items()} == Counter(n)
    for k, r in rows.items():
        assert r.docs_at_least == sum(x >= k for x in n) and r.tokens_at_least == sum(x for x in n if x >= k)
        assert r.truncated_total == sum(min(x, k) for x in n) and r.share_at_most == pytest.approx(sum(x <= k for x in n) / len(n))
    limits = [0, 1, 100, 513, 10**6]
    got = {r.context: (r.docs_over, r.truncated_total, r.total) for r in lengths.at_limits(sums, limits).collect()}
    assert got == {c: (sum(x > c for x in n), sum(min(x, c) for x in n), sum(n)) for c in limits}
    assert {r.q: r.n_tokens for r in lengths.quantiles(sums, [0.5, 0.9, 1.0]).collect()} == {
        q: n[math.ceil(q * len(n)) - 1] for q in (0.5, 0.9, 1.0)}


def test_limits_from_the_suffix_sums_alone(spark):
    n = [0, 0, 3, 5, 5, 9, 2000]
    sums = lengths.suffix_sums(spark.createDataFrame(list(Counter(n).items()), "n_tokens long, docs long"), block=4)
    limits = [-1, 0, 2, 3, 5, 5, 100, 2000, 10**6]
    for s, x in ((sums, n), (sums.limit(0), [])):
        got = [tuple(r) for r in lengths.at_limits(s.drop("docs"), limits).collect()]
        assert sorted(got) == [(c, sum(k > c for k in x), sum(min(k, c) for k in x), sum(x)) for c in sorted(set(limits))]
    assert lengths.at_limits(sums, []).collect() == []


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(open(pieces.MODEL, "rb").read())


def every_segmentation(p, text):
    out = []

    def back(j, score, ids):
        if j == 0:
            out.append((score, tuple(ids)))
        for i in range(j):
            k = p.id_of.get(text[i:j])
            if k is not None:
                back(i, score + p.score[k], [k, *ids])
            elif i == j - 1:
                back(i, score + p.unknown, [*(p.byte_id[b] for b in text[i].encode()), *ids])
    back(len(text), 0.0, [])
    return sorted(out, reverse=True)


@pytest.mark.parametrize("text", ["hello the  end", "ab cd", "x", " lead", "tail ", "漢 a▁b\n\tc", "aa bb cc", "é", "\n\n a", "😀 z"])
def test_nbest_segmentations(vocabulary, text):
    top = next(iter(pieces.Encoder(vocabulary, 5).encode([text])))
    want = every_segmentation(vocabulary, " " + text)[:5]
    assert [s for s, _ in top] == pytest.approx([s for s, _ in want])
    assert len({tuple(x) for _, x in top}) == len(top)
    assert all(vocabulary.decode(x) == text for _, x in top)


@pytest.mark.parametrize("unit", ["a" * 14, " " * 14 + "y", "x" + " " * 12, "aaaabaaab" + "é" * 3, "abababababab"])
def test_nbest_of_tied_lattices(vocabulary, unit):
    want = every_segmentation(vocabulary, unit)
    for n in (1, 2, 4, 9):
        top = vocabulary.nbest(unit, n)
        assert [s for s, _ in top] == pytest.approx([s for s, _ in want[:n]])
        assert len({ids for _, ids in top}) == len(top) and {ids for _, ids in top} <= {ids for _, ids in want}


@pytest.mark.parametrize("text", ["x" + " " * 200_000 + "y", "\n" * 200_000, "a" * 200_000, "".join(chr(97 + i * i * 7919 % 26) for i in range(50_000)), "é漢" * 50_000])
def test_very_long_runs_are_encoded_whole(vocabulary, text):
    top = next(iter(pieces.Encoder(vocabulary, 4).encode([text])))
    assert vocabulary.decode(top[0][1]) == text and [s for s, _ in top] == sorted((s for s, _ in top), reverse=True)


def test_long_blank_runs_count_as_the_pattern_says(monkeypatch):
    with open(lengths.VOCABULARY, "rb") as f:
        enc = lengths.encoder(f.read())
    texts = ["a" + " " * n + tail for n in (1, 2, 9, 10, 11, 40) for tail in ("", "b c", "\n", "\u3000x", "1  2", "é" + " " * 30)]
    texts += ["\n \t" * 20 + "q", " " * 12, "x\x1c\x1c" + " " * 15 + "y", "a" + "\u0085\u2003" * 8]
    plain = [len(enc.encode_ordinary(t)) for t in texts]
    monkeypatch.setattr(lengths, "LONG_BLANK", 10)
    monkeypatch.setattr(lengths, "_BLANKS", lengths.regex.compile(r"\p{White_Space}{10,}"))
    assert [lengths.count_tokens(enc, t) for t in texts] == plain
    assert lengths.count_tokens(enc, "x" + " " * 1_000_000 + "y") > 1 and lengths.count_tokens(enc, "\n" * 1_000_000) > 1


def test_pieces_round_trip(spark, docs):
    got = pieces.query(spark, SF).collect()
    assert len(got) == len(docs) and all(r.round_trip and r.nbest_scores == sorted(r.nbest_scores, reverse=True) for r in got)
    df = pieces.encode(spark.read.parquet(f"{SF}/documents.parquet"), n=1, columns=["doc_id"])
    assert {r.doc_id: r.text for r in pieces.decode(df).select("row.doc_id", "text").collect()} == {i: r.text for i, r in docs.items()}
