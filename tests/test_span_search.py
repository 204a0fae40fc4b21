"""Phrases looked for in sentences' texts, texts without odd spaces, and greedy de-duplication; against loops."""

import random

from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.operators import mining as mn


def test_phrase_in_sentences(spark):
    r = random.Random(2)
    cases = []
    for k in range(300):
        norms = [r.choice(["a", "a", "b", "b", "ab", ""]) for _ in range(r.randint(4, 40))]
        cuts = sorted({0, len(norms), *(r.randrange(len(norms)) for _ in range(4))})
        sents = list(zip(cuts, cuts[1:]))
        lo = r.randrange(len(sents))
        cases.append((k, norms, sents, [r.choice("ab") for _ in range(r.randint(2, 4))], lo, r.randrange(lo, len(sents))))
    df = spark.createDataFrame(cases, "k int, norms array<string>, sents array<struct<word_start:int,word_end:int>>, q array<string>, lo int, hi int")
    said = df.withColumn("said", mn.sentence_norms(F.col("sents"), F.col("norms")))
    got = said.select("k", mn.locate_exact(F.col("said"), F.col("q"), F.col("lo"), F.col("hi"), F.get("sents", F.col("lo"))["word_start"]).alias("at")).collect()
    want = []
    for _, norms, sents, q, lo, hi in cases:
        a, b = sents[lo][0], sents[hi][1]
        want.append(next((i for i in range(a, b - len(q) + 1) if norms[i:i + len(q)] == q), None) if len(q) >= 3 else None)
    assert [x["at"] for x in sorted(got)] == want and sum(w is not None for w in want) > 20


def test_plain_texts_are_not_searched_for_odd_spaces(spark):
    texts = ["It's a  Co-op.", "a\tb\x0bc\rd", "é b", "a　b c", "\x1ca b", "", None, "a\x85b a b"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    old = F.array_remove(tx.norm_words(F.regexp_replace("x", tx.ODD_SPACE, " ")), "")
    for r in df.select(tx.norm_tokens("x").alias("a"), tx.norm_tokens(F.col("x")).alias("b"), old.alias("c")).collect():
        assert r.a == r.b == r.c
    assert "octet_length" in df.select(tx.norm_tokens("x"))._jdf.queryExecution().optimizedPlan().toString()


def test_overlapping_items_go_weaker_first(spark):
    r = random.Random(6)
    rows = [(k, [(a, None if r.random() < 0.05 else a + r.choice([0, 5, 40, 90])) for a in (r.randrange(300) for _ in range(25))]) for k in range(30)]
    df = spark.createDataFrame(rows, "k int, xs array<struct<s:long,e:long>>")
    got = {x.k: [tuple(v) for v in x.kept] for x in df.select("k", mn.interval_nms(F.col("xs"), "s", "e", "s").alias("kept")).collect()}
    least = lambda *v: min(x for x in v if x is not None)
    for k, xs in rows:
        kept = []
        for s, e in xs:
            def clash(o):
                ends = [x for x in (o[1], e) if x is not None]
                lengths = [b - a for a, b in (o, (s, e)) if b is not None]
                inter = least(*ends) - max(o[0], s) if ends else None
                return inter is not None and inter > 0 and inter / least(*lengths) > 0.45
            if not any(clash(o) for o in kept):
                kept.append((s, e))
        assert got[k] == kept
