"""Corpus operators against plain versions, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import collections
import gzip
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from chronoweave.llm import common, decontamination, langid, lines, minhash, quality, queries, sentencepiece_codec, sharding, simhash, substrings, vectors, warc

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, h1 long, node long, label string, place string, code long, r1 long, spans string"


def docs_of(spark, rows):
    """``(doc_id, text)`` rows with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "k", 2, 3, "l", "p", 4, 5, "x") for i, t in rows], DOCS).repartition(3)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


ODD = [(None, None), (None, "a b"), (1, None), (2, ""), (3, "   \n\t "), (4, "x"), (5, prose(1, 300)), (6, prose(1, 300)), (6, prose(1, 300)), (7, prose(2, 60000)),
       (8, prose(1, 150) + " changed " + prose(3, 150)), (9, "é" * 500 + "\x1cß z"), (9, "other text of the same id"), (10, "a" * 3000), (11, "ab" * 900)]


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ---- 1 ----

def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(rows):
    p = [plain_print(t) for _, t in rows]
    a = np.array(p, np.uint64)
    pairs = [(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4) if i < j]
    r = roots(len(rows), pairs)
    low = {}
    for (i, _), k in zip(rows, r):
        if i is not None:
            low[k] = min(low.get(k, i), i)
    return sorted(((i, f"{x:016x}", low.get(k)) for (i, _), x, k in zip(rows, p, r)), key=repr)


def test_simhash_odd_rows(spark):
    out = simhash.simhash_components(docs_of(spark, ODD)).select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")), "component_id")
    assert sorted(map(tuple, out.collect()), key=repr) == plain_components(ODD)
    assert simhash.simhash_components(docs_of(spark, ODD).limit(0)).count() == 0


def test_simhash_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op1_simhash_near_dedup(spark, SF).collect()), key=repr) == plain_components(rows)


@pytest.mark.parametrize("node_rows", [8, 64, 8192])
def test_trie_links_with_slices(spark, node_rows):
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 40, np.uint64)
    code = np.concatenate([base, *[base ^ (np.uint64(1) << r.integers(0, 64, 40, np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 40, np.uint64)) for _ in range(4)],
                           base[0] ^ np.arange(300, dtype=np.uint64), r.integers(0, 1 << 63, 400, np.uint64)])
    code = np.unique(code)
    pairs = [(i, j) for i in range(len(code)) for j in np.flatnonzero(np.bitwise_count(code ^ code[i]) <= 4) if i < j]
    want = roots(len(code), pairs)
    df = spark.createDataFrame([(int(x),) for x in code.view(np.int64)], "code long")
    edges = simhash.fingerprint_links(df, node_rows=node_rows).collect()
    at = {int(x): i for i, x in enumerate(code.view(np.int64))}
    assert all(int(np.bitwise_count(np.uint64(e.a % 2**64) ^ np.uint64(e.b % 2**64))) >= 1 for e in edges)
    assert roots(len(code), [(at[e.a], at[e.b]) for e in edges]) == want
    assert len(edges) < 15 * len(code) * 4


def test_near_duplicates_removed_keeps_columns(spark):
    d = docs_of(spark, ODD)
    out = simhash.near_duplicates_removed(d)
    assert out.columns == d.columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    comp = {(i, x): c for i, x, c in plain_components(ODD)}
    want = collections.Counter({(i, t): 1 if i is not None else ODD.count((i, t)) for i, t in ODD if i is None or any(c == i for (d2, x), c in comp.items() if d2 == i)})
    assert got == want


def five_words(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


@pytest.mark.parametrize("node_rows", [8, 2048])
def test_pipeline_near_dedup_reaches_jaccard(spark, node_rows):
    """Random word changes on texts of every length: all pairs of five-word Jaccard 0.8 or more are linked, and none below."""
    r = random.Random(12)
    rows = list(ODD)
    for k in range(60):
        base = prose(900 + k, r.randrange(30, 400)).split()
        rows.append((1000 + 10 * k, " ".join(base)))
        for j in range(1, 4):
            w = base[:]
            for _ in range(max(1, int(len(w) * r.choice([0.005, 0.01, 0.015, 0.02, 0.03])))):
                w[r.randrange(len(w))] = "edited"
            rows.append((1000 + 10 * k + j, " ".join(w).upper() if j == 2 else " ".join(w)))
    hub = prose(5000, 200).split()
    rows += [(3000 + k, " ".join(hub[:3 * k] + ["edited"] + hub[3 * k + 1:])) for k in range(40)]
    sets = [five_words(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    assert len(pairs) > 100 and sum(9 * len(sets[i] & sets[j]) < 4.25 * (len(sets[i]) + len(sets[j])) for i, j in pairs) > 10
    low = {}
    for k, (i, _) in zip(root := roots(len(rows), pairs), rows):
        if i is not None:
            low[k] = min(low.get(k, i), i)
    got = minhash.jaccard_components(docs_of(spark, rows), node_rows=node_rows).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, low.get(k)) for k, (i, _) in zip(root, rows)), key=repr)
    assert minhash.jaccard_components(docs_of(spark, ODD).limit(0)).count() == 0


def test_pipeline_stage_drops_pairs_of_five_words(spark):
    """A pair of five-word Jaccard of about 0.85, which 4 of 64 bits let through."""
    base = [f"w{i}" for i in range(200)]
    edit = base[:30] + ["x"] + base[31:90] + ["y"] + base[91:150] + ["z"] + base[151:]
    out = corpus_pipeline.simhash_near_dedup(spark, docs_of(spark, [(1, " ".join(base)), (2, " ".join(edit))]), SMALL)
    assert [r.doc_id for r in out.collect()] == [1]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


# ---- 2 ----

def plain_lines(rows, min_chars=20, min_docs=3):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(-2**63 if i is None else i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != (-2**63 if i is None else i))]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


LINE_ROWS = [(i, "\n".join([" Common line that everybody has \t", f"own line number {i} of this text", "short", "éééééééééé", "É line of TWENTY code points ééé", ""] * (1 + i % 2)))
             for i in range(30)] + ODD


def test_lines_odd_rows(spark):
    out = lines.deduplicate_lines(docs_of(spark, LINE_ROWS), stats=True)
    assert sorted((tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr) == plain_lines(LINE_ROWS)
    assert lines.deduplicate_lines(docs_of(spark, ODD)).columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert lines.deduplicate_lines(docs_of(spark, ODD).limit(0)).count() == 0
    assert lines.deduplicate_lines(docs_of(spark, ODD)).where("text is null").count() == 2


def test_lines_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_ROWS", 7)
    monkeypatch.setattr(lines.line_index, "__defaults__", (5,))
    r = random.Random(2)
    rows = [(i, "\n".join(f"a repeated line of text {r.randrange(60)}" for _ in range(12))) for i in range(50)]
    out = lines.deduplicate_lines(docs_of(spark, rows), stats=True)
    assert sorted((tuple(x) for x in out.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr) == plain_lines(rows)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20000, np.uint64))
    ph = lines.PerfectHash.unpack(lines.PerfectHash.build(keys).pack())
    assert sorted(ph.find(keys)) == list(range(len(keys)))


# ---- 3, 9 ----

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_quality_classifier(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality", "score", "predicted").collect()
    right = [r.predicted == r.quality for r in got]
    low, high = [r.score for r in got if not r.quality], [r.score for r in got if r.quality]
    auc = np.mean([(a < b) + 0.5 * (a == b) for a in low for b in high])
    assert len(got) > 500 and np.mean(right) > 0.97 and auc > 0.97, (np.mean(right), auc)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [(i, ("good clean words " if i % 2 else "## junk !! ") * 9) for i in range(40)])
    m = quality.fit(docs, labels, queries.quality_train)
    out = quality.with_score(docs_of(spark, ODD), m).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    scored = {r.doc_id: r.score for r in quality.with_score(docs, m).collect()}
    assert min(scored[i] for i in range(1, 40, 2)) > max(scored[i] for i in range(0, 40, 2))
    for none in (labels.limit(0), labels.where("quality = 1")):
        flat = {r.score for r in quality.with_score(docs, quality.fit(docs, none, queries.quality_train)).collect()}
        assert len({round(s, 4) for s in flat}) == 1
    assert quality.with_score(docs.limit(0), m).count() == 0


def test_quality_sample_of_repeated_ids(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "zz qq xx") for i in range(40)] + [(7, f"good copy {i}") for i in range(300)], "doc_id long, text string")
    assert quality.agreed_labels(labels).where("id = 3").count() == 0
    m = quality.fit(docs, labels, queries.quality_train, sample_per_class=5)
    low, high = (r.score for r in quality.with_score(docs.where("doc_id in (0, 1)"), m).orderBy("doc_id").collect())
    assert low < 0.3 <= high


def test_log_count_ratios_are_counts_of_documents(spark):
    rows = spark.createDataFrame([("ab", 1), ("abab", 1), ("zz", 0)], "text string, quality int")
    ratio, n = quality.log_count_ratios(rows)
    f = lambda t: set(quality.features(t, np.zeros(1 << quality.SPACE_BITS, bool)))
    assert list(n) == [1, 2]
    p = np.ones(1 << quality.SPACE_BITS)
    q = p.copy()
    for t in (b"ab", b"abab"):
        p[list(f(t))] += 1
    q[list(f(b"zz"))] += 1
    assert np.allclose(ratio, np.log(p / p.sum()) - np.log(q / q.sum()))


def test_features_of_pieces(monkeypatch):
    seen = np.zeros(1 << quality.SPACE_BITS, bool)
    text = prose(5, 3000).encode()
    want = quality.features(text, seen)
    monkeypatch.setattr(quality, "PIECE", 1000)
    assert (quality.features(text, seen) == want).all() and not seen.any()


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op9_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    net = langid.fit(docs_of(spark, [(i, "the house and the garden " * 5) for i in range(20)]).withColumn("lang", F.when(F.col("doc_id") % 4 == 0, None).otherwise("en")), queries.language_train)
    got = sorted((r.doc_id, r.lang_pred) for r in langid.with_language(docs_of(spark, [r for r in ODD if r[0] is not None] + [(20, "123 !?")]), net).collect())
    assert ("und" == dict(got)[20]) and dict(got)[1] == "und" and dict(got)[2] == "und" and dict(got)[7] == "en"
    none = langid.fit(docs_of(spark, ODD).limit(0), queries.language_train)
    assert {r.lang_pred for r in langid.with_language(docs_of(spark, ODD), none).collect()} == {"und"}


def test_language_learns_from_whole_texts(spark):
    """Languages whose texts open with one shared header, or with numbers, are learned from their bodies."""
    r = random.Random(6)
    words = {"en": "the house and with garden river this that people there".split(), "de": "und das haus nicht mit garten fluss diese leute dort".split(),
             "fr": "une maison avec jardin rivière cette gens est dans nous".split()}
    body = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    head = {"en": "all rights reserved terms of service apply " * 20, "de": "all rights reserved terms of service apply " * 20, "fr": "0123 456 " * 90}
    rows = [(i, head[k] + body(k, 300), k) for i, k in enumerate(list(words) * 30)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lambda c: c.isNotNull())
    assert net.langs == ["de", "en", "fr"]
    got = langid.with_language(spark.createDataFrame([(i, body(k, 40), k) for i, k in enumerate(list(words) * 10)], "doc_id long, text string, lang string"), net).collect()
    assert np.mean([x.lang == x.lang_pred for x in got]) > 0.95


def test_language_tables_equal_network():
    r = np.random.default_rng(0)
    grid, _ = langid.windows_of([bytes(r.integers(32, 255, 900, np.uint8)), b"", b"abc"])
    net = langid.train(grid, r.integers(0, 2, len(grid)), ["a", "b"], epochs=1)
    best, _ = langid._forward(net, grid)
    want = langid._softmax(np.maximum(np.concatenate([best[w] for w in langid.WIDTHS], axis=1), 0) @ net.dense + net.dense_bias)
    assert np.allclose(langid.window_probabilities(net, net.tables(), grid), want, atol=1e-5)


# ---- 4 ----

def test_warc_odd_pages(spark):
    rows = [(1, "http://a/\r\n1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>x</p>"), (5, "u", "é" * 400000), (6, "u", "WARC/1.1\r\n\r\n"), (2, "again", "<p>x</p>")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, top long, sha string")
    done, read = warc.archive_pages(df)
    got = sorted((tuple(r) for r in warc.page_report(read).collect()), key=repr)
    top = {h or "": max((i for i, _, g in rows if (g or "") == (h or "") and i is not None), default=None) for _, _, h in rows}
    n = collections.Counter(h or "" for _, _, h in rows)
    want = []
    for i, _, h in rows:
        b, t = (h or "").encode(), top[h or ""]
        stored = i is None or i == t or n[h or ""] == 1
        want.append((i, len(b), warc.digest32(b), "response" if stored else "revisit", None if stored else t))
    assert got == sorted(want, key=repr)
    for r in done.collect():  # every member stands alone and the index names it
        path = r.path.removeprefix("file://").removeprefix("file:")
        raw = open(path, "rb").read()
        index = [json.loads(x) for x in open(r.index_path.removeprefix("file://").removeprefix("file:"))]
        assert len(index) == r.records and sum(e["length"] for e in index) == len(raw)
        for e in index:
            assert gzip.decompress(raw[e["offset"]:e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\n")
    assert warc.page_report(warc.archive_pages(df.limit(0))[1]).count() == 0


def test_warc_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "a" * 50), (4, "u", "a" * 50)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.page_report(warc.archive_pages(df, min_bytes=10)[1]).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


# ---- 5 ----

@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(open(sentencepiece_codec.MODEL, "rb").read())


def test_viterbi_is_best(codec):
    table = {}
    for p in codec.auto.keys():
        n, s, i = codec.auto.get(p)
        table[p] = (s, i)
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("▁theingaou12é你 \n") for _ in range(r.randrange(1, 14)))
        best = [0.0] + [-1e18] * len(text)
        for e in range(1, len(text) + 1):
            for b in range(e):
                s = table[text[b:e]][0] if text[b:e] in table else -sentencepiece_codec.BYTE_COST * len(text[b:e].encode()) if e - b == 1 else -1e18
                best[e] = max(best[e], best[b] + s)
        assert abs(codec.best_path(text)[1] - best[-1]) < 1e-9


def test_chunks_lose_nothing(codec):
    r = random.Random(5)
    for _ in range(200):
        text = "".join(r.choice(["the", " ", "  ", "ing", "x", "\n", "é", "Zu"]) for _ in range(12))
        whole = codec.best_path((" " + text if codec.prefix else text).replace(" ", "▁"))[1]
        score = sum(codec.best_path(c)[1] for c in codec.split.findall((" " + text if codec.prefix else text).replace(" ", "▁")))
        assert abs(whole - score) < 1e-9


def test_codec_round_trip(spark, codec):
    rows = ODD + [(20, " lead  and   trail "), (21, "\x00\x01 tab\t\r\n"), (22, "你好 🙂"), (23, "a▁b")]
    out = {(r.doc_id, r.n_tokens): r.exact for r in sentencepiece_codec.round_trips(docs_of(spark, rows)).collect()}
    assert {k[0] for k, v in out.items() if v is False} == {23} and out[(1, None)] is None and out[(2, 0)]
    d = sentencepiece_codec.decoded(sentencepiece_codec.encoded(docs_of(spark, rows[:-1])), out="back")
    assert d.where("not (text <=> back)").count() == 0
    assert sentencepiece_codec.encoded(docs_of(spark, rows).limit(0)).count() == 0
    q = queries.op5_sentencepiece(spark, SMALL).collect()
    assert all(r.exact and r.n_tokens == len(r.token_ids) for r in q) and len(q) == 200


# ---- 6 ----

ITEM = "If Alice buys 12 apples for 30 dollars and then sells 5 apples to Robert for 4 dollars each what is her profit in dollars after the second day"
FILL = " ".join(f"filler{i} word{i * 7 % 13}" for i in range(40)) + ". "


def test_decontamination_cases(spark):
    bench = spark.createDataFrame([(1, ITEM, 9), (2, "tiny item", 9), (3, None, 9), (4, "", 9), (None, ITEM, 9), (5, "a completely different question about the height of mountains near the river", 9)], "item_id long, text string, h long")
    changed = ITEM.replace("12", "48").replace("30", "99").replace(" 5 ", " 6 ").replace(" 4 ", " 3 ").replace("Alice", "Maria").replace("Robert", "Felix")
    mixed = ITEM.replace("12 apples", "48 apples").replace("5 apples", "48 oranges")
    rows = [(1, FILL + ITEM + " " + FILL), (2, FILL + changed + ". " + FILL), (3, FILL * 3), (4, FILL + "tiny item " + FILL), (5, FILL + ITEM.upper().lower() + FILL), (6, None), (7, ""), (None, ITEM),
            (8, "1 2 3 4 5 6 7 8 9 10 " * 20), (9, "filler " + " ".join(ITEM.split()[:8]) + " other words follow here"), (10, ITEM), (10, ITEM)]
    got = {(r.doc_id, r.item_id): r.exact for r in decontamination.leaks(docs_of(spark, rows), bench).collect()}
    assert {k for k in got if k[0] != 5} == {(1, 1), (2, 1), (10, 1)} and got[(1, 1)] and not got[(2, 1)] and got[(10, 1)]
    twisted = ITEM.replace("dollars each", "euros each")  # one item value standing for two values
    got = {r.doc_id for r in decontamination.leaks(docs_of(spark, [(1, FILL + twisted + ". " + FILL), (2, mixed)]), bench).collect()}
    assert 1 not in got
    kept = decontamination.decontaminated(docs_of(spark, rows), bench)
    assert kept.columns == docs_of(spark, rows).columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, None, 8, 9} - ({5} & {k[0] for k in got_ids(spark, rows, bench)})
    assert decontamination.leaks(docs_of(spark, rows).limit(0), bench).count() == 0
    assert decontamination.leaks(docs_of(spark, rows), bench.limit(0)).count() == 0


NAMED = "What did Marie Curie and Pierre Curie discover in Paris after Henri Becquerel of France wrote to Lord Kelvin about Radium"


def test_decontamination_needs_no_name_typing(spark):
    """Copies are found in any case, inside a sentence, and whatever their words are typed."""
    bench = spark.createDataFrame([(1, "Who wrote Pride and Prejudice in 1813?"), (2, NAMED)], "item_id long, text string")
    rows = [(1, FILL + "he then asked Who wrote Pride and Prejudice in 1813? " + FILL), (2, FILL + NAMED.lower() + " " + FILL), (3, FILL + NAMED.upper() + " " + FILL),
            (4, FILL + NAMED.title() + " " + FILL), (5, FILL * 2), (6, FILL + "Who wrote Pride and other books " + FILL)]
    got = {(r.doc_id, r.item_id): r.exact for r in decontamination.leaks(docs_of(spark, rows), bench).collect()}
    assert got == {(1, 1): True, (2, 2): True, (3, 2): True, (4, 2): True}


def test_decontamination_of_items_dense_in_slots(spark):
    """Items of numbers, units and names only are found as copies, and not as templates."""
    dense = "12 km 30 miles 7 hours 45 minutes 3 kg 9 dollars 16 cm"
    bench = spark.createDataFrame([(1, dense), (2, "3 4 5 6 7 plus 8 9"), (3, "total 12 km 30 miles 7 hours 45 minutes 3 kg equals 8")], "item_id long, text string")
    rows = [(1, FILL + dense + " " + FILL), (2, FILL + "3 4 5 6 7 plus 8 9 " + FILL), (3, FILL + "99 km 88 miles 77 hours 66 minutes 55 kg 44 dollars 33 cm " + FILL),
            (4, FILL + "total 12 km 30 miles 7 hours 45 minutes 3 kg equals 8 " + FILL)]
    got = {(r.doc_id, r.item_id): r.exact for r in decontamination.leaks(docs_of(spark, rows), bench).collect()}
    assert got == {(1, 1): True, (2, 2): True, (4, 3): True}


def test_decontamination_of_items_shorter_than_a_window(spark):
    bench = spark.createDataFrame([(1, "Tiny Item here"), (2, "zebra"), (3, "four words and 7"), (4, "")], "item_id long, text string")
    rows = [(1, FILL + "tiny item, here " + FILL), (2, "Zebra"), (3, FILL + "four words and 8 " + FILL), (4, FILL + "four words and 7"), (5, "tiny item"), (6, FILL + "tiny zebra item here " + FILL)]
    got = {(r.doc_id, r.item_id): (r.n_windows, r.run_words, r.exact) for r in decontamination.leaks(docs_of(spark, rows), bench, copies=True).collect()}
    assert got == {(1, 1): (1, 3, True), (2, 2): (1, 1, True), (4, 3): (1, 4, True), (6, 2): (1, 1, True)}
    assert {r.doc_id for r in decontamination.decontaminated(docs_of(spark, rows), bench, copies=True).collect()} == {3, 5}


def test_decontamination_of_edited_copies(spark):
    """With ``copies`` one edited unit, number or name does not hide a copy; a few equal words with inconsistent slots are none."""
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    edits = [ITEM.replace("dollars each", "euros each"), ITEM.replace("4 dollars", "7 euros"), ITEM.replace("30 dollars", "30 euros")]
    mixed = ITEM.replace("12", "48").replace("30 dollars", "99 euros").replace(" 5 ", " 6 ").replace(" 4 ", " 3 ").replace("Alice", "Maria").replace("Robert", "Felix")
    rows = [(i, FILL + t + ". " + FILL) for i, t in enumerate([*edits, mixed])]
    got = {r.doc_id: r.exact for r in decontamination.leaks(docs_of(spark, rows), bench, copies=True).collect()}
    assert set(got) == {0, 1, 2}


def got_ids(spark, rows, bench):
    return {(r.doc_id, r.item_id) for r in decontamination.leaks(docs_of(spark, rows), bench).collect()}


def test_decontamination_query(spark):
    """Every document that holds 80 % of an item's five-word windows, word by word, is found, and no document without a 13-word run or such a share."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    held = collections.defaultdict(set)
    for b in items:
        w = b.text.lower().split()
        for k in range(len(w) - 4):
            held[tuple(w[k:k + 5])].add((b.item_id, k))
    size = {b.item_id: max(1, len(b.text.split()) - 4) for b in items}
    hits = collections.defaultdict(set)
    for d in docs:
        w = d.text.lower().split()
        for k in range(len(w) - 4):
            for i, j in held.get(tuple(w[k:k + 5]), ()):
                hits[d.doc_id, i].add(j)
    want = {k for k, v in hits.items() if len(v) >= 0.8 * size[k[1]]}
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, SF).collect()}
    assert want and want <= got and all(len(hits[k]) >= 0.5 * size[k[1]] for k in got)


# ---- 7 ----

@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards(spark, shards):
    for df in (docs_of(spark, ODD), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = sharding.byte_shards(df, shards).collect()
        want = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
        assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == want and len(got) == len(rows)
        total, largest = sum(r.size for r in got), max(r.size for r in got)
        for s in {r.shard for r in got}:
            part = [r for r in got if r.shard == s]
            assert sorted(r.slot for r in part) == list(range(len(part))) and 0 <= s < shards
        for s in range(shards):  # every shard is its target, give or take the largest row at either end
            assert abs(sum(r.size for r in got if r.shard == s) - total / shards) <= 2 * largest
        groups = collections.defaultdict(list)
        for r in got:
            groups[r.size, r.text_crc32].append(r)
        assert all(len({r.shard for r in g}) == 1 for g in groups.values() if sum(r.size for r in g) <= largest)
    assert sharding.byte_shards(docs_of(spark, ODD).limit(0), 4).count() == 0


def test_shards_plan_is_native(spark):
    plan = sharding.byte_shards(docs_of(spark, ODD), 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 8 ----

@pytest.mark.parametrize("list_rows", [20, 4096])
def test_vectors_odd_rows(spark, list_rows):
    r = np.random.default_rng(8)
    base = r.normal(size=(12, 16))
    v = [(b + r.normal(size=16) * 0.05).tolist() for b in base for _ in range(12)]
    rows = [(i, x, i // 72 % 2) for i, x in enumerate(v)]
    rows += [(200, v[0], 0), (201, v[0], 0), (201, v[0], 0), (202, v[0], None), (203, None, 0), (204, [0.0] * 16, 0), (205, [float("nan")] + [1.0] * 15, 0), (206, [None] + [1.0] * 15, 0),
             (207, [1e30] + [0.0] * 15, 0), (208, [2e30] + [0.0] * 15, 0), (None, v[5], 0), (209, [1.0, 2.0], 0), (210, [2.0, 4.0], 0), (211, [], 0), (212, [float("inf")] * 16, 1), (213, v[0], 1)]
    df = spark.createDataFrame([(*x, 1, 2, "n") for x in rows], "vec_id long, embedding array<double>, label int, node long, n long, unit string")
    out = sorted((tuple(x) for x in vectors.vector_components(df, list_rows=list_rows).collect()), key=repr)

    def unit(x):
        if x is None or any(c is None or not np.isfinite(c) for c in x) or not any(x):
            return None
        u = np.array(x) / np.abs(x).max()
        return u / np.sqrt(u @ u)

    u = [unit(x) for _, x, _ in rows]
    near = lambda i, j: u[i] is not None and u[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.98
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if near(i, j)]
    links = collections.Counter(k for p in pairs for k in p)
    root = roots(len(rows), pairs)
    low = {}
    for k, x in zip(root, rows):
        if x[0] is not None:
            low[k] = min(low.get(k, x[0]), x[0])
    want = sorted(((x[0], links[i], low.get(root[i]), x[0] is not None and x[0] == low.get(root[i])) for i, x in enumerate(rows)), key=repr)
    assert out == want
    assert vectors.vector_components(df.limit(0)).count() == 0


def test_vector_recall(spark):
    """Vectors of the table and perturbed copies of them, against all pairs of a label."""
    r = np.random.default_rng(6)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([v.embedding for v in rows], float)
    x = np.concatenate([x, *[x[:150] + r.normal(size=(150, 64)) * s * np.linalg.norm(x[:150], axis=1, keepdims=True) / 8 for s in (0.05, 0.1, 0.14, 0.18)]])
    lab = np.array([v.label for v in rows] + [v.label for v in rows[:150]] * 4)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, lab))], "vec_id long, embedding array<double>, label int")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (((x @ x.T >= 0.98) & (lab[:, None] == lab)).sum(axis=1) - 1).tolist()
    got = {v.vec_id: v.n_links for v in vectors.vector_components(df).collect()}
    assert all(got[k] <= n for k, n in enumerate(want)) and sum(got.values()) >= 0.98 * sum(want) > 500, (sum(got.values()), sum(want))


# ---- 10 ----

def plain_repeats(rows, length):
    seen = collections.Counter()
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        seen.update(t[i:i + length] for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        n = int(gone.sum())
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(t), n, runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes() if len(t) else b"").hexdigest()))
    return sorted(out, key=repr)


FIELDS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("limits", [(1500, 3000, 1000), (4, 8, 300)])
def test_repeats_odd_rows(spark, limits):
    passage = prose(77, 60)
    rows = [r for r in ODD if r[0] != 7] + [(100 + i, prose(200 + i, 40) + passage + prose(300 + i, 40)) for i in range(30)] + [(200, passage[:410] + "x" + passage[1:408]), (201, passage[10:409]), (202, ("\0" * 9 + "q") * 100)]
    out = substrings.remove_repeats(docs_of(spark, rows), shard_contexts=limits[0], hot_contexts=limits[1], run_windows=limits[2])
    assert sorted((tuple(r) for r in out.select(*FIELDS).collect()), key=repr) == plain_repeats(rows, 400)


def test_repeats_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op10_suffix_array_dedup(spark, SMALL).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain_repeats(rows, 400)
    whole = [r for r in got if "\ufffd" not in r.text]  # else a cut split a character
    assert len(whole) > len(got) / 2 and all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in whole)
    assert substrings.remove_repeats(docs_of(spark, ODD).limit(0)).count() == 0


def test_suffix_array_and_prefixes():
    r = random.Random(1)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(0, 60))).encode() for _ in range(20)] + [b"a" * 50, b"ab" * 20, b"ab" * 20]
    bounds = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    sa, rank = substrings.suffix_array(flat, bounds)
    lcp = substrings.common_prefixes(flat, bounds, sa, rank)
    whole = [t[k:] for t in texts for k in range(len(t) + 1)]
    assert sorted(sa) == list(range(len(flat))) and [whole[i] for i in sa] == sorted(whole)
    for k in range(1, len(sa)):
        a, b = whole[sa[k - 1]], whole[sa[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == n


def test_long_text_anchors_do_not_depend_on_pieces(monkeypatch):
    t = prose(9, 5000).encode()
    roller = substrings.Roller(1 << 20)
    want = substrings.anchors([t], roller, 400, 100)
    monkeypatch.setattr(substrings, "PIECE", 3000)
    got = substrings.anchors([t], roller, 400, 100)
    assert all((w == g).all() for w, g in zip(want, got))
