"""Language identification by a byte convolutional network.

Bytes are folded to ``SYMBOLS`` classes; filters of several widths slide over
fixed-length windows, the maximum of each filter over a window passes a rectifier
and a softmax layer. Training is plain numpy (Adam on windows of labelled texts).
A convolution over one-hot symbols is a sum of table rows, so inference looks up
rows of symbol-pair tables. Every byte of a text lies in one window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import free_names, small_batches, text_bytes
from chronoweave.operators.staging import stage

SYMBOLS, WINDOW, FILTERS, WIDTHS = 64, 160, 12, (2, 3, 4)
TEXTS_PER_LANG, WINDOWS_PER_TEXT, EPOCHS, RATE = 400, 4, 10, 0.01
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")  # Unicode category L, as in the training filter


def _fold() -> np.ndarray:
    """Byte to symbol: 0 pads, 1-26 letters of either case, 27 blanks, 28 digits, 29 controls, 30-31 marks, 32-63 bytes above 127 by their low bits."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            t[b] = 32 + b % 32
        elif c.isalpha():
            t[b] = ord(c.lower()) - 96
        else:
            t[b] = 27 if c.isspace() else 28 if c.isdigit() else 29 if b < 32 or b == 127 else 30 + (c in "'-’")
    return t


FOLD = _fold()


@dataclass
class Network:
    """Tables ``conv[width][offset, symbol, filter]`` with biases, and the softmax layer."""

    langs: list[str]
    conv: dict[int, np.ndarray]
    conv_bias: dict[int, np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self):
        """Row tables by symbol pair: widths 2, 3 and 4 at the first pair, then width 4 at the second, and width 3 at its third symbol."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(SYMBOLS * SYMBOLS, -1)
        c = self.conv
        first = np.concatenate([pair(c[w][0], c[w][1]) for w in WIDTHS], axis=1).astype(np.float32)
        return first, pair(c[4][2], c[4][3]).astype(np.float32), c[3][2].astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol windows (with padding of three) of whole texts, and the text each window belongs to."""
    n = np.array([-(-len(t) // WINDOW) for t in texts], int)
    flat = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    at = 0
    for t, k in zip(texts, n):
        flat[at:at + len(t)] = FOLD[np.frombuffer(t, np.uint8)]
        at += k * WINDOW
    grid = np.zeros((len(flat) // WINDOW, WINDOW + 3), np.uint8)
    grid[:, :WINDOW] = flat.reshape(-1, WINDOW)
    return grid, np.repeat(np.arange(len(texts)), n)


def _forward(net: Network, grid: np.ndarray):
    best, where = {}, {}
    for w in WIDTHS:
        out = sum(net.conv[w][j][grid[:, j:j + WINDOW]] for j in range(w))
        where[w] = out.argmax(axis=1)
        best[w] = np.take_along_axis(out, where[w][:, None, :], 1)[:, 0, :] + net.conv_bias[w]
    return best, where


def train(grid: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Cross-entropy by Adam over shuffled windows."""
    rng = np.random.default_rng(seed)
    net = Network(langs, {w: rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)) for w in WIDTHS}, {w: np.zeros(FILTERS) for w in WIDTHS},
                  rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))), np.zeros(len(langs)))
    params = [*net.conv.values(), *net.conv_bias.values(), net.dense, net.dense_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 64):
            pick = order[k:k + 64]
            x, t = grid[pick], y[pick]
            best, where = _forward(net, x)
            hidden = np.maximum(np.concatenate([best[w] for w in WIDTHS], axis=1), 0)
            p = _softmax(hidden @ net.dense + net.dense_bias)
            p[np.arange(len(t)), t] -= 1
            p /= len(t)
            back = (p @ net.dense.T) * (hidden > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g, part = np.zeros_like(net.conv[w]), back[:, i * FILTERS:(i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x, where[w] + j, 1), np.arange(FILTERS)), part)
                grads.append(g)
            grads += [back[:, i * FILTERS:(i + 1) * FILTERS].sum(axis=0) for i in range(len(WIDTHS))] + [hidden.T @ p, p.sum(axis=0)]
            step += 1
            for v, g, (m, s) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return net


def window_probabilities(net: Network, tables, grid: np.ndarray) -> np.ndarray:
    """Softmax of each window, a block of windows at a time."""
    first, fourth, third = tables
    out = np.empty((len(grid), len(net.langs)))
    bias = np.concatenate([net.conv_bias[w] for w in WIDTHS])
    for k in range(0, len(grid), 64):
        g = grid[k:k + 64].astype(np.int64)
        pair = g[:, :-1] * SYMBOLS + g[:, 1:]
        acc = np.take(first, pair[:, :WINDOW], axis=0)
        acc[:, :, FILTERS:2 * FILTERS] += np.take(third, g[:, 2:WINDOW + 2], axis=0)
        acc[:, :, 2 * FILTERS:] += np.take(fourth, pair[:, 2:WINDOW + 2], axis=0)
        out[k:k + 64] = _softmax(np.maximum(acc.max(axis=1) + bias, 0) @ net.dense + net.dense_bias)
    return out


def _draw(batches):
    """Of every text the windows with a letter whose hashes are smallest, in their order."""
    for b in batches:
        out = []
        for h, t in zip(b.column("h").to_pylist(), text_bytes(b.column("text"))):
            cut = [t[k:k + WINDOW] for k in range(0, len(t), WINDOW)]
            with_letter = [i for i, w in enumerate(cut) if _LETTER.search(w.decode("utf-8", "ignore"))]
            rank = lambda i: xxhash.xxh64_intdigest(i.to_bytes(8, "little"), h % 2**64)  # noqa: B023, E731
            out.append([cut[i] for i in sorted(sorted(with_letter, key=rank)[:WINDOWS_PER_TEXT])])
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(out, pa.list_(pa.binary()))], ["lang", "h", "windows"])


def fit(docs: DataFrame, use, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", texts_per_lang: int = TEXTS_PER_LANG) -> Network:
    """Train on texts whose id passes ``use``: of every language the ``texts_per_lang`` with the smallest hash of id and text.

    Of each such text ``WINDOWS_PER_TEXT`` windows are drawn by hash from all its windows that hold a letter.
    Texts without a language or a letter are left out, repeated rows count once; without any text, the network knows no language.
    """
    rows = docs.where(use(F.col(doc_id))).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("h"))
    ranked = rows.select("lang", "h").distinct()
    for part in (["lang", F.pmod("h", F.lit(64))], ["lang"]):  # the smallest of each slice, then of all slices
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy("h"))).where(F.col("rank") <= texts_per_lang).drop("rank")
    picked = stage(ranked, "picked")
    drawn = small_batches(rows.join(F.broadcast(picked), ["lang", "h"])).select("lang", "h", "text").mapInArrow(_draw, "lang string, h long, windows array<binary>")
    got = drawn.orderBy("lang", "h").toArrow().to_pylist()  # at most texts_per_lang texts a language, a few windows each
    got = [r for r, last in zip(got, [None, *got]) if last is None or (r["lang"], r["h"]) != (last["lang"], last["h"])]
    names = [r["lang"] for r in got for _ in r["windows"]]
    langs = sorted(set(names))
    grid, owner = windows_of([w for r in got for w in r["windows"]])
    if not langs:
        return Network([], {}, {}, np.zeros((0, 0)), np.zeros(0))
    place = {k: i for i, k in enumerate(langs)}
    return train(grid, np.array([place[names[i]] for i in owner], int), langs)


def with_language(docs: DataFrame, net: Network, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the language with the largest mean window probability, and that mean; all other columns pass.

    ``und`` with score 0 where the text is null, has no letter, or no language was learned.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)  # a few tables of fixed size

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(column: pa.Array) -> pa.Array:
        n = held.value
        texts = text_bytes(column)
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if n.langs:
            tables = n.tables()
            todo = [i for i, t in enumerate(texts) if t and _LETTER.search(t.decode("utf-8", "replace"))]
            for group in _chunks(todo, texts, 1 << 21):
                grid, owner = windows_of([texts[i] for i in group])
                p = window_probabilities(n, tables, grid)
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                mean = np.add.reduceat(p, starts) / np.diff(np.append(starts, len(owner)))[:, None]
                for i, k, s in zip(group, mean.argmax(axis=1), mean.max(axis=1)):
                    langs[i], scores[i] = n.langs[k], min(1.0, float(s))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    found, = free_names(docs, "found")
    return small_batches(docs).withColumn(found, predict(F.col(text))).withColumns(
        {lang_out: F.col(found)["lang"], score_out: F.col(found)["score"]}).drop(found)


def _chunks(todo: list[int], texts: list[bytes], size: int):
    group, n = [], 0
    for i in todo:
        group.append(i)
        n += len(texts[i])
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group
