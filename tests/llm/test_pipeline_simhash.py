"""The near-dedup stage finds candidates by SimHash and the trie, not by MinHash bands alone."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from chronoweave.llm import minhash, simhash


def texts():
    base = [f"w{i}" for i in range(2000)]
    return [" ".join(base), " ".join(base[:900] + ["x"] + base[901:]), " ".join(f"v{i}" for i in range(2000)), " ".join(base[::-1])]


def test_trie_links_are_candidates(spark):
    prints = [(k, int(np.uint64(simhash.majority(minhash.shingles(t.encode()))).view(np.int64))) for k, t in enumerate(texts())]
    edges = minhash.simhash_candidates(spark.createDataFrame([*prints, (9, prints[2][1])], "code long, print long")).collect()
    assert sorted(tuple(sorted(e)) for e in edges) == [(0, 1), (2, 9)]


def test_stage_links_by_simhash_where_no_band_meets(spark, monkeypatch):
    count = iter(range(10**6))
    monkeypatch.setattr(minhash, "bands", lambda sh: np.array([hash((len(sh), int(sh[0]), next(count)))] * minhash.BANDS))
    signed = minhash.simhash_candidates
    seen = []
    monkeypatch.setattr(minhash, "simhash_candidates", lambda p: seen.append(p.columns) or signed(p))
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    out = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert seen == [["code", "print"]] and sorted(r.doc_id for r in out.collect()) == [0, 2, 3]
