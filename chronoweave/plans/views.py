"""Derived views over the given tables, in Spark and as SQL text for the checks.

``transcripts`` keeps one row per document with its cues as an array: cue and
word operators then work inside the row, with no shuffle, and a transcript is
bounded by one cell of the source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.binding import let, rows
from chronoweave.functions.numeric import half_up, half_up_sql
from chronoweave.functions.text import norm_words

WORD_MS, GAP_MS = 400, 900
BLOCK = 256


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread_out(table(spark, sf, "documents"), "doc_id")


def spread_out(df: DataFrame, key: str) -> DataFrame:
    """Re-split compact source rows when a source has fewer splits than the cluster has cores.

    Word work multiplies rows about a hundredfold, so the source rows are the cheap
    place to balance. A source with enough splits is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def timed_lines(text, word_ms: int = WORD_MS, gap_ms: int = GAP_MS):
    """Text -> array of cues (cue_no, start_ms, end_ms, w0, n, text), one per non-empty line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    sized = F.transform(lines, lambda x: F.struct(x.alias("text"), F.size(F.split(F.trim(x), " +")).cast("long").alias("n")))
    empty = F.array().cast("array<struct<cue_no:bigint,start_ms:bigint,end_ms:bigint,w0:bigint,n:bigint,text:string>>")

    def step(acc, c):
        start = acc["w"] * word_ms + acc["k"] * gap_ms
        cue = F.struct(acc["k"].alias("cue_no"), start.alias("start_ms"), (start + c["n"] * word_ms).alias("end_ms"),
                       acc["w"].alias("w0"), c["n"].alias("n"), c["text"].alias("text"))
        return F.struct(F.concat(acc["cues"], F.array(cue)).alias("cues"), (acc["w"] + c["n"]).alias("w"),
                        (acc["k"] + 1).alias("k"))

    def block(first, b):
        init = F.struct(empty.alias("cues"), first.alias("w"), (b * BLOCK).cast("long").alias("k"))
        return lambda items: F.aggregate(items, init, step, lambda acc: acc["cues"])

    def cut(ls):
        n_blocks = F.floor((F.size(ls) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n_blocks), lambda b: F.slice(ls, b * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, timed)

    def timed(blocks):
        words_in = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, c: a + c["n"]))
        before = F.aggregate(words_in, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return let(before, lambda w: F.flatten(F.transform(blocks, lambda x, b: block(F.get(w, b), b)(x))))

    # A fold that appends copies its array at each step, so lines are numbered in blocks and joined once.
    return let(sized, lambda ls: F.when(F.size(ls) > 0, cut(ls)).when(ls.isNotNull(), empty))


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    return d.select(F.col("doc_id").alias("project_id"), "lang", "source", timed_lines(F.col("text")).alias("cues"))


def cues(spark: SparkSession, sf: str) -> DataFrame:
    t = rows(transcripts(spark, sf), ["project_id"], F.col("cues"), "c").select("project_id", "c.*")
    return t.withColumn("start_sec", F.col("start_ms") / 1000.0).withColumn("end_sec", F.col("end_ms") / 1000.0)


def cue_words(cue):
    """Words of one cue struct, evenly spread: array of (word_no, t_ms, word)."""
    return F.transform(
        F.split(F.trim(cue["text"]), " +"),
        lambda w, i: F.struct((cue["w0"] + i).alias("word_no"),
                              (cue["start_ms"] + i * F.lit(WORD_MS)).cast("long").alias("t_ms"), w.alias("word")))


def words_array(cues_col):
    return F.flatten(F.transform(cues_col, cue_words))


def norms_array(cues_col):
    """Normalised words, place for place those of ``words_array``."""
    return F.flatten(F.transform(cues_col, lambda c: norm_words(F.regexp_replace(F.trim(c["text"]), "  +", " "))))


def text_norms(text):
    """``norms_array`` of a whole text's cues, in one pass over the text; no cue is built."""
    flat = F.trim(F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), "  +", " "))
    return let(flat, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(norm_words(x)))


def words(spark: SparkSession, sf: str) -> DataFrame:
    t = rows(transcripts(spark, sf), ["project_id"], F.col("cues"), "c")
    t = rows(t, ["project_id", F.col("c.cue_no").alias("cue_no")], cue_words(F.col("c")), "w")
    return t.select("project_id", "cue_no", "w.*").withColumn("t", F.col("t_ms") / 1000.0)


def rolling(cues_col):
    """Rolling captions: each cue is prefixed by the last five words of the cue before it."""
    return let(cues_col, _rolling)


def _rolling(cues_col):
    def one(c, i):
        prev = F.split(F.trim(F.element_at(cues_col, F.greatest(i, F.lit(1)))["text"]), " +")
        tail = F.slice(prev, F.greatest(F.size(prev) - 4, F.lit(1)), F.lit(5))
        text = F.when(i == 0, c["text"]).otherwise(F.concat_ws(" ", F.concat_ws(" ", tail), c["text"]))
        return F.struct(c["cue_no"].alias("cue_no"), c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), text.alias("text"))
    return F.transform(cues_col, one)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as cues; a turn lasts 0.4 s per word and starts 60 s after the one before."""
    c = table(spark, sf, "conversations")
    n = F.size(F.split(F.trim(F.regexp_replace("text", "\\s+", " ")), " ")).cast("long")
    return c.select(F.col("conv_id").alias("project_id"), F.col("turn").alias("cue_no"), "role",
                    (F.col("turn") * 60000).alias("start_ms"), (F.col("turn") * 60000 + n * 400).alias("end_ms"), "text")


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Event spans per user: start = ms since 2024-01-01, length = value * 600 s."""
    e = table(spark, sf, "events")
    start = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1000)
    return e.select(F.col("user_id").alias("owner_id"), F.col("event_id").alias("span_id"), start.alias("start_ms"),
                    (start + half_up(F.col("value") * 600000.0)).alias("end_ms"), F.col("value").alias("score"),
                    (F.col("event_type") != "error").alias("enabled"), F.col("event_type").alias("lane"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Event samples per user; ``seq`` breaks ties and ``cut`` marks a shot change."""
    s = spans(spark, sf)
    return s.select(F.col("owner_id").alias("series_id"), F.col("span_id").alias("seq"), F.col("start_ms").alias("t_ms"),
                    F.col("score").alias("x"), (F.col("lane") == "error").alias("cut"), "lane")


# --------------------------------------------------------------------- SQL twins
_NW = "len(string_split(regexp_replace(trim({x}), ' +', ' ', 'g'), ' '))"
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_cues": ((), f"""
        v_lines AS (SELECT doc_id AS project_id, lang, source, u.line AS text, u.ord AS ord,
               {_NW.format(x='u.line')} AS n
          FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, ord)
          WHERE trim(u.line) <> ''),
        v_cues0 AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ord) - 1 AS cue_no,
               coalesce(sum(n) OVER (PARTITION BY project_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS w0
          FROM v_lines),
        v_cues AS (SELECT project_id, lang, source, cue_no, w0, n, text, (400*w0 + 900*cue_no)::BIGINT AS start_ms,
               (400*w0 + 900*cue_no + 400*n)::BIGINT AS end_ms,
               (400*w0 + 900*cue_no) / 1e3 AS start_sec, (400*w0 + 900*cue_no + 400*n) / 1e3 AS end_sec
          FROM v_cues0)"""),
    "v_words": (("v_cues",), """
        v_words AS (SELECT project_id, cue_no, (w0 + u.k - 1)::BIGINT AS word_no, (start_ms + 400*(u.k - 1))::BIGINT AS t_ms,
               (start_ms + 400*(u.k - 1)) / 1e3 AS t, u.word AS word
          FROM v_cues, unnest(string_split(regexp_replace(trim(text), ' +', ' ', 'g'), ' ')) WITH ORDINALITY AS u(word, k))"""),
    "v_rolling": (("v_cues",), """
        v_rolling AS (SELECT project_id, cue_no, start_ms, end_ms,
               CASE WHEN cue_no = 0 THEN text ELSE
                 array_to_string(list_slice(pw, greatest(len(pw) - 4, 1), len(pw)), ' ') || ' ' || text END AS text
          FROM (SELECT *, string_split(regexp_replace(trim(lag(text) OVER (PARTITION BY project_id ORDER BY cue_no)), ' +', ' ', 'g'), ' ') AS pw FROM v_cues))"""),
    "v_turns": ((), r"""
        v_turns AS (SELECT conv_id AS project_id, turn AS cue_no, role, text, turn*60000 AS start_ms,
               turn*60000 + 400*len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS end_ms FROM conversations)"""),
    "v_spans": ((), f"""
        v_spans0 AS (SELECT user_id AS owner_id, event_id AS span_id, value, event_type,
               (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS start_ms FROM events),
        v_spans AS (SELECT owner_id, span_id, start_ms, start_ms + {half_up_sql('value * 6e5')} AS end_ms, value AS score,
               event_type <> 'error' AS enabled, event_type AS lane FROM v_spans0)"""),
    "v_series": (("v_spans",), """
        v_series AS (SELECT owner_id AS series_id, span_id AS seq, start_ms AS t_ms, score AS x, lane = 'error' AS cut, lane FROM v_spans)"""),
}


def with_views(names: list[str], sql: str) -> str:
    done: list[str] = []

    def add(name: str) -> None:
        deps, text = VIEWS[name]
        for d in deps:
            add(d)
        if text not in done:
            done.append(text)

    for n in names:
        add(n)
    sql = sql.strip()
    if not done:
        return sql
    head = "WITH RECURSIVE " + ",\n".join(t.strip() for t in done)
    if sql.upper().startswith(("SELECT", "(SELECT", "FROM")):
        return head + "\n" + sql
    return head + ",\n" + sql
