"""The pipeline against brute force, stage by stage, on whole small tables."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np

from tally.llm import pieces
from tests.llm.test_exact import alnum, fingerprint, groups_of, shingles, weighted
from tests.oracle_compare import duck
from tally.llm.quality import SQL

SF = "/root/testdata/sf0.001"


def cut(texts, length=200):
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(b[i:i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in raw.items():
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        out[k] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    return out


def test_pipeline_matches_brute_force(spark):
    con = duck(SF)
    text = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({SQL}) WHERE kept").fetchall()}
    text = {i: t for i, t in text.items() if i in kept}
    fps = {i: fingerprint(t) for i, t in text.items()}
    root = groups_of(set(fps.values()), 4)
    groups = defaultdict(list)
    for i, f in fps.items():
        groups[root[f]].append(i)
    text = cut({i: text[i] for i in (min(g) for g in groups.values())})
    items = [alnum(t) for _, t in con.execute("SELECT item_id, text FROM benchmark").fetchall()]

    def contaminated(t):
        t = alnum(t)
        return any(weighted(shingles(w), shingles(t[a:a + len(w)])) >= 0.8 for w in items if set(shingles(w)) & set(shingles(t) if t else [])
                   for a in range(max(1, len(t) - len(w) + 1)))  # a text shorter than the item is compared whole
    text = {i: t for i, t in text.items() if not contaminated(t)}
    got = corpus_pipeline.run(spark, SF).collect()
    p = pieces.Pieces(open(pieces.MODEL, "rb").read())
    assert {r.doc_id: p.decode(r.ids) for r in got} == text and len(got) == len(text) and all(r.round_trip for r in got)


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
