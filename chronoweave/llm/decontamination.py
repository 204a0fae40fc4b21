"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units and names are typed slots, other
words their lower-case form without outer marks. Windows of template tokens of
the documents meet those of the benchmark in a hash join, and so do windows of
the lower-case words themselves, which no typing of slots can part. Hits on one
alignment (a diagonal of document against item) are checked for slot consistency:
an item value must stand for one value of the document all along. A Bloom filter of a
fixed size, built from all benchmark windows, thins the document windows before
the shuffle; it never loses one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import free_names, small_batches
from chronoweave.operators.staging import stage

WIDTH, MIN_PLAIN, SHARE, RUN = 5, 2, 0.8, 13
BLOOM_BITS = 23
# Units and number words.
UNITS = frozenset("""mm cm m km kilometer kilometers meter meters metre metres inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms
ounce ounces pound pounds ton tons tonne tonnes ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours hr day days week weeks month months
year years km/h mph kmh dollar dollars cent cents euro euros usd eur percent degrees degree celsius fahrenheit watt watts volt volts amp amps joule joules newton newtons""".split())
NUMBER_WORDS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty
sixty seventy eighty ninety hundred thousand million billion""".split())
_NUMBER = re.compile(r"[-+]?[$€£]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th|%)?$")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
PLAIN, NUMBER, UNIT, NAME = 0, 1, 2, 3
RAW = 1 << 32  # seed of windows of words
_CACHE = 400_000


class _Words(dict):
    """Word to (hash of its plain form, kind, is capitalised, ends a sentence) packed as a pair of integers."""

    def __missing__(self, word: str) -> tuple[int, int]:
        core = _EDGE.sub("", word)
        low = core.lower()
        kind = NUMBER if _NUMBER.match(word.rstrip(".,;:!?)")) or _NUMBER.match(core) or low in NUMBER_WORDS else UNIT if low in UNITS else PLAIN
        capital = len(core) > 1 and core[0].isupper() and core[1:] == core[1:].lower()
        out = (xxhash.xxh3_64_intdigest((low or word).encode()), kind | capital << 2 | (word[-1] in ".!?:" or word.endswith(('."', ".)"))) << 3)
        if len(self) < _CACHE:
            self[word] = out
        return out


def template(text: str, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes (slots hash by type), token kinds, and value hashes of a whole text."""
    got = [words[w] for w in text.split()]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint64)
    value, flags = np.array([g[0] for g in got], np.uint64), np.array([g[1] for g in got], np.uint8)
    kind = flags & 3
    inside = np.append(True, (flags[:-1] & 8) != 0)  # at a sentence start a capital says nothing
    kind = np.where((kind == PLAIN) & ((flags & 4) != 0) & ~inside, NAME, kind).astype(np.uint8)
    return np.where(kind == PLAIN, value, kind.astype(np.uint64)), kind, value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(token: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every window of ``width`` tokens."""
    h = np.full(len(token) - width + 1, width + seed, np.uint64)
    for j in range(width):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + token[j:len(token) - width + 1 + j])
    return h


def _windows(width: int, bloom=None, short: tuple[int, ...] = ()):
    """Batches of ``id, no, h, raw, kinds, vals``: windows of words, and template windows that have slots; those that pass the filter.

    Items (without a filter) of a length in ``short`` are one window; documents give their windows of these lengths.
    """

    def emit(batches):
        words = _Words()
        for b in batches:
            ids, nos, hs, raws, kinds, vals = [], [], [], [], [], []

            def put(ident, h, keep, raw, kind, value, width=width):
                keep = np.flatnonzero(keep if bloom is None else keep & _passes(bloom.value, h))
                if len(keep):
                    ids.append(np.full(len(keep), ident))
                    nos.append(keep)
                    hs.append(h[keep])
                    raws.append(np.full(len(keep), raw))
                    kinds.append(np.lib.stride_tricks.sliding_window_view(kind, width)[keep])
                    vals.append(np.lib.stride_tricks.sliding_window_view(value, width)[keep])

            for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                token, kind, value = template(text or "", words)
                for w in short:
                    if len(token) == w or bloom is not None and len(token) > w:
                        put(ident, window_hashes(value, w, RAW), np.full(len(token) - w + 1, True), True, kind, value, w)
                if len(token) < width:
                    continue
                plain = np.lib.stride_tricks.sliding_window_view(kind == PLAIN, width).sum(axis=1)
                put(ident, window_hashes(value, width, RAW), np.full(len(plain), True), True, kind, value)
                if (plain < width).any():
                    put(ident, window_hashes(token, width), (plain >= MIN_PLAIN) & (plain < width), False, kind, value)
            if ids:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(nos).astype(np.int64)), pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(raws)),
                    pa.array([bytes(r) for k in kinds for r in k], pa.binary()), pa.array([r.view(np.int64) for v in vals for r in v], pa.list_(pa.int64()))],
                    ["id", "no", "h", "raw", "kinds", "vals"])

    return emit


_SCHEMA = "id long, no long, h long, raw boolean, kinds binary, vals array<long>"


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64(64 - BLOOM_BITS)
    return (h >> top).astype(np.int64), ((h * np.uint64(0xD6E8FEB86659FD93)) >> top).astype(np.int64)


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    one = lambda k: (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
    a, b = _bits(h)
    return one(a) & one(b)


def bloom_of(windows: DataFrame) -> np.ndarray:
    """Filter of a fixed 1 MB over all window hashes: set bits are combined on Spark, so at most the filter comes back."""

    def positions(batches):
        for b in batches:
            k = np.unique(np.concatenate(_bits(b.column("h").to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(k >> 3), pa.array((1 << (k & 7)).astype(np.int32))], ["byte", "bits"])

    byte = windows.select("h").mapInArrow(positions, "byte long, bits int").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    out[byte["byte"].to_numpy(np.int64)] = byte["bits"].to_numpy(np.int64)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
          width: int = WIDTH, share: float = SHARE, run: int = RUN, copies: bool = False) -> DataFrame:
    """``doc_id, item_id, n_windows, n_matched, run_words, exact``: items that a document holds.

    A window matches word for word in any case or, if at least two of its words
    are plain, as a template. An item is held if, on one alignment with consistent
    slots, ``share`` of its windows or a run of ``run`` words matches; where words
    differ, at least half of the words of its template windows are plain. With
    ``copies`` such a share or run of windows equal word for word is enough,
    whatever slots elsewhere on the alignment say.
    ``exact`` is whether all that matched is equal word for word. Null or empty
    texts hold and are nothing. An item with fewer words than a window is found by
    its whole word sequence with ``copies``, else not at all. Rows with a null id
    are left out; rows that share an id count as one document. Extra columns are ignored.
    """
    items = small_batches(benchmark).select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null")
    held = stage(items.mapInArrow(_windows(width, None, tuple(range(1, width)) if copies else ()), _SCHEMA), "items")
    span = F.size("vals").alias("span")
    short = tuple(r.span for r in held.select(span).where(F.col("span") < width).distinct().orderBy("span").collect())  # fewer than width numbers
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(held))
    found = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null").mapInArrow(_windows(width, bloom, short), _SCHEMA)
    kind = "substr(hex({}), 2 * i + 1, 2)"
    n_slots = F.expr(f"size(filter(sequence(0, size(item_vals) - 1), i -> {kind.format('item_kinds')} <> '00'))")
    held = held.select("h", F.col("raw").alias("item_raw"), F.col("id").alias("item"), F.col("no").alias("item_no"), F.col("kinds").alias("item_kinds"), F.col("vals").alias("item_vals"), span).withColumn("n_slots", n_slots)
    fit = (F.col("span") == width) & (F.col("n_slots") <= width - MIN_PLAIN)  # may match as a template
    size = held.where("item_raw").groupBy("item").agg(F.count("*").alias("n_windows"), F.count_if(fit).alias("n_fit"), F.max("span").alias("span"))
    hit = found.join(held, "h").where("raw = item_raw and size(vals) = span and (raw or kinds = item_kinds)")
    # plain words must agree in value; slots give (item value, document value) pairs
    slots = F.expr(f"""filter(transform(sequence(0, size(vals) - 1), i -> named_struct('p', item_no + i, 'k', conv({kind.format('kinds')}, 16, 10), 'a', item_vals[i], 'b', vals[i])),
                       s -> not raw and s.k <> '0')""")
    plain = F.expr(f"forall(sequence(0, size(vals) - 1), i -> not raw and {kind.format('kinds')} <> '00' or vals[i] = item_vals[i])")
    hit = stage(hit.where(plain).select("id", "item", "item_no", "no", "raw", F.when(fit, F.col("n_slots")).alias("n_slots"), (F.col("no") - F.col("item_no")).alias("diagonal"), slots.alias("slots")), "hits")
    key = ["id", "item", "diagonal"]
    pair = hit.select(*key, F.explode("slots").alias("s")).select(*key, "s.*").groupBy(*key, "k", "a").agg(F.count_distinct("b").alias("values"))
    broken = pair.groupBy(*key).agg(F.max("values").alias("values"))
    step, same = Window.partitionBy(*key).orderBy("item_no"), Window.partitionBy(*key, "raw").orderBy("item_no")
    runs = hit.groupBy(*key, "item_no").agg(F.max("raw").alias("raw"), F.max("n_slots").alias("n_slots")).select(
        "*", (F.col("item_no") - F.row_number().over(step)).alias("island"), (F.col("item_no") - F.row_number().over(same)).alias("copy"))
    runs = runs.withColumn("in_run", F.count("*").over(Window.partitionBy(*key, "island"))).withColumn("in_copy", F.count("*").over(Window.partitionBy(*key, "raw", "copy")))
    aligned = runs.groupBy(*key).agg(
        F.count("*").alias("n_matched"), F.max("in_run").alias("longest"), F.count_if("raw").alias("n_copied"), F.max(F.when(F.col("raw"), F.col("in_copy"))).alias("copied"),
        F.count("n_slots").alias("n_fitting"), F.sum("n_slots").alias("n_slots")).join(broken, key, "left").join(size, "item")
    enough = lambda n, of, longest: (F.col(n) >= F.lit(share) * F.col(of)) | (F.col(longest) + F.col("span") - 1 >= run)
    consistent = F.coalesce("values", F.lit(1)) == 1
    copied = F.coalesce(enough("n_copied", "n_windows", "copied"), F.lit(False))
    alike = (F.col("n_slots") * 2 <= F.col("n_fitting") * width) & (
        enough("n_matched", "n_windows", "longest") | (F.col("n_fit") > 0) & (F.col("n_fitting") >= F.lit(share) * F.col("n_fit")))
    best = aligned.where(copied & (consistent | F.lit(copies)) | consistent & F.coalesce(alike, F.lit(False)))
    return best.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.max("n_windows").alias("n_windows"), F.max("n_matched").alias("n_matched"), F.max(F.col("longest") + F.col("span") - 1).alias("run_words"),
        F.max(F.col("n_copied") == F.col("n_matched")).alias("exact"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", copies: bool = False) -> DataFrame:
    """``docs``, all columns, without the documents that hold a benchmark item as in ``leaks``; rows with a null id stay."""
    held, = free_names(docs, "held")
    bad = leaks(docs, benchmark, doc_id, text, copies=copies).select(F.col("doc_id").alias(held)).distinct()
    return docs.join(bad, F.col(doc_id).cast("long") == F.col(held), "left_anti")
