"""Byte-pair encoding and decoding: a segment tree over the ranks of adjacent pairs picks every merge.

The vocabulary of a public tokenizer file is read, never trained. A text is cut at
the file's special tokens, the rest into words by the pattern of byte-level models.
A word starts as its bytes. The leaves of its segment tree hold the merge rank of
each adjacent pair with the pair's place, so the root is the leftmost pair of lowest
rank; a merge changes the leaves of at most three pairs, and each walks up one path.
Words are independent of each other, and those seen before are looked up.

Words longer than ``_LONG`` characters are encoded alike but not remembered, so the
table of words stays small whatever the texts hold.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Remembered, ragged, small_batches

# The pattern of byte-level models; white space is Unicode's own, without the control characters 1C to 1F.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_KNOWN, _LONG, _STREAMED = 700_000, 64, 1 << 20
_NONE, _FAN = 1 << 62, 5
_LIVE: dict[str, Coder] = {}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def merged(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Merge adjacent symbols, the leftmost pair of lowest rank first, until no pair has a rank.

    ``merges`` maps ``left << 32 | right`` to ``(rank, symbol)``. A node of the segment tree has
    up to ``1 << _FAN`` children, so that a short word's tree is its leaves and a root.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    get = merges.get
    leaves = [_NONE] * (n - 1)
    for i in range(n - 1):
        if found := get(symbols[i] << 32 | symbols[i + 1]):
            leaves[i] = found[0] << 32 | i
    levels = [leaves]
    while len(levels[-1]) > 1 << _FAN:
        down = levels[-1]
        levels.append([min(down[k:k + (1 << _FAN)]) for k in range(0, len(down), 1 << _FAN)])
    top, deep = levels[-1], len(levels) > 1
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (low := min(top)) != _NONE:
        i = low & 0xFFFFFFFF
        j = after[i]
        new = merges[symbols[i] << 32 | symbols[j]][1]
        symbols[i], symbols[j] = new, -1
        k = after[i] = after[j]
        h = before[i]
        if j < n - 1:
            leaves[j] = _NONE
        if k < n:
            before[k] = i
            leaves[i] = found[0] << 32 | i if (found := get(new << 32 | symbols[k])) else _NONE
        else:
            leaves[i] = _NONE
        if h >= 0:
            leaves[h] = found[0] << 32 | h if (found := get(symbols[h] << 32 | new)) else _NONE
        if deep:
            for leaf in (i, min(j, n - 2), max(h, 0)):
                for down, up in zip(levels, levels[1:]):
                    leaf >>= _FAN
                    least = min(down[leaf << _FAN:(leaf + 1) << _FAN])
                    if up[leaf] == least:
                        break
                    up[leaf] = least
    return [s for s in symbols if s >= 0]


class Coder:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, file: str):
        j = json.loads(file)
        model, before = j["model"], j["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and not j["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
                 and not any(t[k] for t in j["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")))
        if not plain:
            raise ValueError("only plain byte-level pair encodings are supported")
        vocab, signs = model["vocab"], byte_alphabet()
        byte_of = {c: b for b, c in enumerate(signs)}
        self.first = [vocab[c] for c in signs]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.raw: list[bytes] = [b""] * size  # ids without a token decode to nothing
        for token, i in [*vocab.items(), *self.special.items()]:
            self.raw[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = Remembered(self.word, _KNOWN, _LONG)

    def word(self, word: str) -> tuple[int, ...]:
        first = self.first
        return tuple(merged([first[b] for b in word.encode()], self.merges))

    def _plain(self, text: str):
        """Ids of the words of a text without special tokens; a very long text is not held as a list of words."""
        words = WORD.findall(text) if len(text) < _STREAMED else (m[0] for m in WORD.finditer(text))
        return chain.from_iterable(map(self.words.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        if self.cut is None or not any(s in text for s in self.special):
            return np.fromiter(self._plain(text), np.int32)

        def parts():
            at = 0
            for m in self.cut.finditer(text):
                yield self._plain(text[at:m.start()])
                yield (self.special[m[0]],)
                at = m.end()
            yield self._plain(text[at:])

        return np.fromiter(chain.from_iterable(parts()), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 are replaced, ids out of the vocabulary give nothing."""
        known = ids[(ids >= 0) & (ids < len(self.raw))]
        return b"".join(map(self.raw.__getitem__, known.tolist())).decode("utf-8", "replace")


def _coder(name: str) -> Coder:
    if name not in _LIVE:
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            _LIVE[name] = Coder(f.read())
    return _LIVE[name]


def _ship(df: DataFrame, file: str) -> str:
    """Send the tokenizer file to the executors; returns its name there."""
    df.sparkSession.sparkContext.addFile(file)
    return file.rstrip("/").rsplit("/", 1)[-1]


def encoded(docs: DataFrame, file: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add the token ids of whole texts; all other columns pass.

    A null text gives null, an empty one no token. Special tokens that a text spells
    out are taken as such. Equal texts have equal ids, whatever rows they stand in.
    """
    name = _ship(docs, file)

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        c = _coder(name)
        return ragged([None if t is None else c.encode(t) for t in column.to_pylist()], pa.int32())

    return small_batches(docs).withColumn(out, run(F.col(text)))


def decoded(tokens: DataFrame, file: str, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """Add the text of token ids; null gives null, no id the empty text; null ids within a list give nothing."""
    name = _ship(tokens, file)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        c = _coder(name)
        return pa.array([None if x is None else c.decode(np.asarray(x.drop_null(), np.int64)) for x in (v.values if v.is_valid else None for v in column)], pa.string())

    return small_batches(tokens).withColumn(out, run(F.col(ids)))
