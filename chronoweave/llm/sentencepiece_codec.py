"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The vocabulary of a public model file is read, never trained. Every character
moves the automaton one state; following its output links gives each piece that
ends there, and each relaxes the best score of its end from that of its start.
Characters that no piece covers become byte pieces (or the unknown piece).

A unigram model's log-probabilities are used as they are. A merge model stores
minus its merge rank, which is no probability; by default a piece of rank r gets
the Zipf log-probability ``-log(r + ZIPF_SHIFT)``, so that few frequent pieces
win. Scores are rounded to multiples of ``1 / GRID``, so sums are exact and ties do not
depend on how a text is cut. Segmentations therefore differ from merge order in places; decoding gives
the text back either way.

Where no piece has a word mark after another character, a text falls into chunks
(word marks, then others; line ends and the like, which are in no piece, stand alone)
that no piece crosses and whose best paths are independent. Chunks seen before are
looked up.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Remembered, ragged, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
ZIPF_SHIFT = 3.0
BYTE_COST = 14.0
GRID = 2.0**20
_KNOWN, _LONG, _STREAMED = 300_000, 64, 1 << 20
_LIVE: dict[str, Codec] = {}


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, proto: bytes):
        m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = m.get_piece_size()
        self.pieces = m.id_to_piece(list(range(size)))
        self.unknown = m.unk_id()
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if m.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i in range(size) if m.is_control(i)}
        scores = m.get_score(list(range(size)))
        merges = all(s == int(s) for s in scores)
        normal = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.prefix = m.encode("a", out_type=str)[0].startswith(MARK)
        self.auto = ahocorasick.Automaton()
        for i in normal:
            s = scores[i]
            if merges:
                s = -math.log((-s if s > -1e8 else 1.0) + ZIPF_SHIFT)
            self.auto.add_word(self.pieces[i], (len(self.pieces[i]), round(s * GRID) / GRID, i))
        self.auto.make_automaton()
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent else self.pieces[i].encode() for i in range(size)]
        self.bare = Remembered(lambda c: BYTE_COST * (len(c.encode()) if self.byte_ids else 1), 10_000, 1)
        self.known = Remembered(lambda chunk: self.best_path(chunk)[0], _KNOWN, _LONG)
        crossed = any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in normal)
        letters = set().union(*(self.pieces[i] for i in normal))
        lone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in letters and chr(c) != " "))  # in no piece: always bytes
        apart = f"|[{lone}]+" if lone else ""
        self.split = re.compile("(?s:.+)" if crossed else f"{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+{apart}")

    def best_path(self, chunk: str) -> tuple[tuple[int, ...], float]:
        """Ids and score of the best segmentation; ties go to the longer last piece."""
        n, bare = len(chunk), self.bare
        score, back, piece = [0.0] + [-math.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        done = 0  # positions up to here are final: those without a better piece take one character as bytes or unknown
        for end, (length, s, ident) in self.auto.iter(chunk):
            while done < end:
                cost = score[done] - bare[chunk[done]]
                done += 1
                if cost > score[done]:
                    score[done], back[done], piece[done] = cost, done - 1, -1
            end += 1
            new = score[end - length] + s
            if new > score[end] or (new == score[end] and length > end - back[end]):
                score[end], back[end], piece[end] = new, end - length, ident
        for e in range(done + 1, n + 1):
            cost = score[e - 1] - bare[chunk[e - 1]]
            if cost > score[e]:
                score[e], back[e], piece[e] = cost, e - 1, -1
        out: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(chunk[back[at]:at].encode()))
            else:
                out.append(self.unknown)
            at = back[at]
        return tuple(reversed(out)), score[n]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        body = (" " + text if self.prefix else text).replace(" ", MARK)
        chunks = self.split.findall(body) if len(body) < _STREAMED else (m[0] for m in self.split.finditer(body))
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, chunks)), np.int32)

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 are replaced."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _codec(name: str) -> Codec:
    if name not in _LIVE:
        with open(SparkFiles.get(name), "rb") as f:
            _LIVE[name] = Codec(f.read())
    return _LIVE[name]


def _ship(df: DataFrame, model: str) -> str:
    """Send the model file to the executors; returns its name there."""
    df.sparkSession.sparkContext.addFile(model)
    return model.rstrip("/").rsplit("/", 1)[-1]


def encoded(docs: DataFrame, text: str = "text", out: str = "token_ids", model: str = MODEL) -> DataFrame:
    """Add token ids of whole texts; null gives null, an empty text no token. All other columns pass.

    A text that itself holds the word mark U+2581 encodes as if that were a space, as the vocabulary prescribes.
    """
    name = _ship(docs, model)

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        c = _codec(name)
        return ragged([None if t is None else c.encode(t) for t in column.to_pylist()], pa.int32())

    return small_batches(docs).withColumn(out, run(F.col(text)))


def decoded(tokens: DataFrame, ids: str = "token_ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """Add the text of token ids; null gives null."""
    name = _ship(tokens, model)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        c = _codec(name)
        return pa.array([None if x is None else c.decode(x) for x in column.to_pylist()], pa.string())

    return small_batches(tokens).withColumn(out, run(F.col(ids)))


def round_trips(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """``doc_id, token_ids, n_tokens, exact``: every text encoded, decoded again and compared in one pass."""
    name = _ship(docs, model)

    @F.arrow_udf("struct<ids: array<int>, exact: boolean>")
    def run(column: pa.Array) -> pa.Array:
        c = _codec(name)
        ids, same = [], []
        for t in column.to_pylist():
            x = None if t is None else c.encode(t)
            ids.append(x)
            same.append(None if t is None else c.decode(x.tolist()) == t)
        return pa.StructArray.from_arrays([ragged(ids, pa.int32()), pa.array(same, pa.bool_())], ["ids", "exact"])

    out = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), run(F.col(text)).alias("r"))
    return out.select("doc_id", F.col("r.ids").alias("token_ids"), F.when(F.col("r.ids").isNotNull(), F.size("r.ids")).alias("n_tokens"), F.col("r.exact").alias("exact"))
