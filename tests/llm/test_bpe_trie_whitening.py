"""Byte-pair encoding, conversation trie and whitening against the library they follow and brute force."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from chronoweave.llm import bpe, queries, trie, whitening

SMALL = "/root/testdata/sf0.001"


# ---- 11 ----

VECS = "vec_id long, embedding array<float>, label int, x long, n long, component int, dim int, whitened double"


def vecs_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 0.5) for i, v in rows], VECS).repartition(3)


def plain_whitening(rows, want=16):
    x = {k: [int(np.floor(np.float64(np.float32(e)) * 64)) + 1000000 for e in v] for k, v in enumerate(v for _, v in rows)}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    y = (fit * n - s).astype(float) / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:want], q[:, ::-1][:, :want]
    out = []
    for k, (i, _) in enumerate(rows):
        d = np.array(x[k], dtype=object) * n - s
        z = (d.astype(float) / n) @ q / np.sqrt(e)
        out += [(i, j + 1, n, int((d * d).sum()), abs(z[j]), e[j] / np.trace(v)) for j in range(len(e))]
    return sorted(out)


def test_whitening_equals_dense_solver(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in r.normal(size=20) * np.linspace(1, 3, 20)]) for i in range(60)]
    rows += [(60 + i, rows[0][1]) for i in range(40)] + [(5, rows[1][1]), (5, rows[1][1])]
    odd = [(200, None), (201, [float("nan")] * 20), (202, [float("inf")] + [0.0] * 19), (203, [None] + [1.0] * 19), (204, [])]
    got = whitening.whitened(vecs_of(spark, rows + odd)).collect()
    want = plain_whitening(rows)
    mine = sorted((g.vec_id, g.component, g.n, g.deviation, abs(g.whitened), g.explained) for g in got)
    assert [m[:4] for m in mine] == [w[:4] for w in want]
    assert max(abs(m[4] - w[4]) for m, w in zip(mine, want)) < 1e-9 and max(abs(m[5] / w[5] - 1) for m, w in zip(mine, want)) < 1e-12
    assert len({g.identity_error for g in got}) == 1 and got[0].identity_error < 1e-9
    signs = {}
    for g in got:
        signs.setdefault((g.component, round(abs(g.whitened), 9)), set()).add(g.whitened > 0)
    assert sum(len(s) > 1 for s in signs.values()) == 0  # copies agree in sign


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whitened(vecs_of(spark, []).limit(0)).count() == 0
    assert whitening.whitened(vecs_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    got = whitening.whitened(vecs_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 4.0]), (None, [1.0, 4.0]), (3, [1.0]), (4, [5.0])])).collect()
    assert sorted((g.vec_id or 0, g.component, g.n, round(abs(g.whitened), 12), g.explained) for g in got) == [(0, 1, 2, 1.0, 1.0), (1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0), (3, 1, 2, 1.0, 1.0), (4, 1, 2, 1.0, 1.0)]


def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()]
    got = sorted((g.vec_id, g.component, g.n, g.deviation, abs(g.whitened), g.explained) for g in queries.op11_embedding_whitening(spark, SMALL).collect())
    want = plain_whitening(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert max(abs(g[4] - w[4]) for g, w in zip(got, want)) < 1e-9 and max(abs(g[5] / w[5] - 1) for g, w in zip(got, want)) < 1e-12


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize("values", [[5.0] * 20 + [1.0] * 20, [5.0] * 10 + [5.0000001] * 10 + [1.0] * 20, list(range(1, 65)), [1e12, 1, 1, 1] + [0] * 30, [3.0] * 8, [7.0],
                                    [100, 99.9999] + list(np.linspace(60, 66, 62)), list(1.0 / np.arange(1, 50) ** 2)])
def test_contour_integration(values):
    v = spectrum(values)
    e, x = whitening.leading_pairs((v + v.T) / 2, 16)
    want = sorted(values, reverse=True)[:16]
    want = [w for w in want if w > 1e-13 * want[0]]
    assert len(e) == len(want) and np.abs(e - want).max() <= 1e-13 * want[0] * len(values)
    assert np.abs(v @ x - x * e).max() <= 1e-12 * want[0] and np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12


def test_inertia_counts_eigenvalues():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 9, 40):
        a = r.normal(size=(n, n))
        a = a + a.T
        w = np.linalg.eigvalsh(a)
        for s in (-1.0, 0.0, 0.7, 3.0):
            assert whitening.inertia(a, s)[0] == (w > s).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0)[0] == 1  # no single pivot


# ---- 12 ----

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(open(FILE, encoding="utf-8").read())


def test_encoding_equals_library(library, coder):
    r = random.Random(1)
    parts = ["a", "aa", "  ", "\n", "\t ", " ", "'s", "'ll", "é", "1", "<|endoftext|>", "<|endof", "|>", "....", "你好", "\x1c", "\x85", "　", "🙂", "the", "ing", "abab", "\r\n", "​", "Ⅷ", "½"]
    for _ in range(1500):
        s = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        want = library.encode(s, add_special_tokens=False).ids
        assert coder.encode(s).tolist() == want, s
        assert coder.decode(np.array(want, np.int64)) == library.decode(want, skip_special_tokens=False)
    for _ in range(500):
        ids = [r.randrange(50300) for _ in range(r.randrange(12))]  # any ids, also of broken characters and out of the vocabulary
        assert coder.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_every_character(library, coder):
    """The word pattern takes every character as the library does."""
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x20000)]]
    texts = ["".join(f"a{c}b {c}{c} 1{c}?{c}  " for c in chars[i:i + 64]) for i in range(0, len(chars), 64)]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert coder.encode(t).tolist() == want.ids


def test_segment_tree_takes_the_leftmost_lowest(coder):
    def plain(symbols):
        symbols = list(symbols)
        while True:
            ranked = [(coder.merges[a << 32 | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a << 32 | b in coder.merges]
            if not ranked:
                return symbols
            (_, new), i = min(ranked)
            symbols[i:i + 2] = [new]

    r = random.Random(7)
    for _ in range(400):
        word = "".join(r.choice("abcdetinghé ") for _ in range(r.randrange(40))).encode()
        assert bpe.merged([coder.first[b] for b in word], coder.merges) == plain([coder.first[b] for b in word])
    long = [coder.first[ord("a")]] * 70000
    assert sum(map(len, (coder.raw[i] for i in bpe.merged(long, coder.merges)))) == 70000


def test_long_texts_and_the_table_of_words(library, coder, monkeypatch):
    monkeypatch.setattr(bpe, "_STREAMED", 50)
    small = bpe.Coder(open(FILE, encoding="utf-8").read())
    small.words.room = 10
    r = random.Random(2)
    text = " ".join("".join(r.choice("abcdefg") for _ in range(r.randrange(1, 9))) for _ in range(3000)) + " " + "z" * 5000
    assert small.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(small.words) <= 10 and len(small.words.old) <= 10


def test_encoding_on_spark(spark, library):
    rows = [(None, None), (1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "x" * 100000), (5, "<|endoftext|> é")]
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, ids long, words string").repartition(2)
    back = bpe.decoded(bpe.encoded(docs, FILE), FILE, out="back")
    assert back.columns == [*docs.columns, "token_ids", "back"]
    for r in back.collect():
        assert (r.token_ids is None) == (r.text is None) and r.back == r.text
        assert r.text is None or r.token_ids == library.encode(r.text, add_special_tokens=False).ids
    assert bpe.encoded(docs.limit(0), FILE).count() == 0
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_byte_pair_encoding(spark, SMALL).collect()}
    for d in pq.read_table(f"{SMALL}/documents.parquet").to_pylist():
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert got.pop(d["doc_id"]) == (len(ids), *sha)
    assert not got


# ---- 13 ----

def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + ts[h:]
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    nodes = {k: {"conv_id": min(m), "depth": len(k), "n_convs": len(m), "kids": 0, "leaves": 0, "saved": (len(m) - 1) * len(k[-1][1]) if k else 0,
                 "ends": hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)).encode()).hexdigest()} for k, m in members.items()}
    for k in sorted(nodes, key=len, reverse=True):
        n = nodes[k]
        n["leaves"] = n["leaves"] or 1
        if k:
            up = nodes[k[:-1]]
            up["kids"] += 1
            up["leaves"] += n["leaves"]
            up["saved"] += n["saved"]
    return sorted((n["conv_id"], n["depth"], nodes[k[:-1]]["conv_id"] if k else -1, n["n_convs"], n["kids"], n["leaves"], n["saved"], n["ends"]) for k, n in nodes.items())


def conv_rows(out):
    return sorted(tuple(-1 if v is None else v for v in r) for r in out.collect())


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "q", 5) for r in rows], "conv_id long, turn long, role string, text string, at long, k1 long, depth long, shard string, points long").repartition(4)


@pytest.fixture(scope="module")
def talks():
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "héllo 🙂", "", None, "yes"])) for c in [*range(40), *range(100, 130), 205, 399] for t in range(r.randrange(1, 7))]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1060) for t in range(4)]  # a third of all: one conversation
    rows += [(77, t // 3 if t % 5 else None, "user", f"long {t % 7}") for t in range(150)]  # ties, null turns, one long conversation
    rows += [(None, 1, "user", "no conversation"), (-5, 1, "user", "negative"), (-5, 1, "user", "negative"), (0, 0, "user", "x" * 5000)]
    return rows


@pytest.mark.parametrize("shard_rows,queue_rows", [(None, 200_000), (7, 200_000), (40, 3), (10**9, 2)])
def test_trie_equals_brute_force(spark, talks, shard_rows, queue_rows):
    assert conv_rows(trie.prefix_trie(talk(spark, talks), shard_rows, queue_rows)) == plain_trie(talks)


def test_trie_of_a_hot_conversation_in_blocks(spark, talks, monkeypatch):
    """Numbering, running sums and hashes of ends do not depend on how rows are cut."""
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "RUN_IDS", 3)
    assert conv_rows(trie.prefix_trie(talk(spark, talks), 25)) == plain_trie(talks)


def test_trie_of_odd_tables(spark):
    empty = talk(spark, [(1, 1, "a", "b")]).limit(0)
    assert trie.prefix_trie(empty).count() == 0
    assert trie.prefix_trie(talk(spark, [(None, 1, "a", "b")])).count() == 0
    rows = [(c, 0, "u", "t") for c in range(1, 12)]  # some lose their only turn: members of the root alone
    assert conv_rows(trie.prefix_trie(talk(spark, rows))) == plain_trie(rows)


def test_trie_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{SMALL}/conversations.parquet").to_pylist()]
    assert conv_rows(queries.op13_conversation_trie(spark, SMALL)) == plain_trie(rows)


def test_queue_spills_in_order():
    r = random.Random(3)
    queue, plain = trie.SpillingQueue(16), []
    for _ in range(5000):
        if plain and r.random() < 0.45:
            assert queue.peek() == plain[0] and queue.pop() == heapq.heappop(plain)
        else:
            m = tuple(r.randrange(-50, 50) for _ in range(5))
            queue.push(m)
            heapq.heappush(plain, m)
    while plain:
        assert queue.pop() == heapq.heappop(plain)
    assert queue.peek() is None


# ---- 9 ----

def test_letters_of_language_id(spark):
    """A letter is Unicode category L when predicting as in the filter of training rows."""
    from chronoweave.llm import langid
    texts = ["5²", "½ 3", "①", "Ⅷ", "123_", "ª", "é", "ж 1", "你", "ʰ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", r"t rlike '\\p{L}' AS letter").collect()
    assert {r.t: r.letter for r in rows} == {t: bool(langid._LETTER.search(t)) for t in texts}
    assert [bool(langid._LETTER.search(t)) for t in texts] == [False] * 5 + [True] * 5
