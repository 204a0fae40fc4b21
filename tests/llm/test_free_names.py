"""User columns named like the operators' own pass unchanged; a shard whose keys agree in 64 bits is hashed by all 128."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chronoweave.llm import common, decontamination, langid, lines, queries, simhash

OWN = "row new drop r1 r2 ident body held found __row __id __text __keep __new __drop __lang __bad _row _held".split()
TEXT = "a line of more than twenty characters\nand another one that is its own {}"


def named(spark):
    rows = [(i, TEXT.format(i if i != 4 else 3) + " x" * 40, "en") for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(f"mine {c}") for c in OWN})


def kept(out, df):
    rows = out.collect()
    return [c for c in out.columns if c in df.columns] == df.columns and rows and all(r[c] == f"mine {c}" for r in rows for c in OWN)


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Row int, _row int, x int")
    assert common.free_names(df, "row", "y") == ["__row", "y"]


def test_operators_keep_columns_named_like_their_own(spark):
    df = named(spark)
    assert kept(lines.deduplicate_lines(df), df)
    assert kept(simhash.near_duplicates_removed(df), df)
    assert kept(langid.with_language(df, langid.fit(df, queries.language_train)), df)
    bench = spark.createDataFrame([(1, TEXT.format(0) + " x" * 40)], "item_id long, text string")
    clean = decontamination.decontaminated(df, bench, copies=True)
    assert clean.columns == df.columns and clean.where("doc_id = 0").count() == 0


def test_shard_of_keys_that_agree_in_64_bits(spark):
    h2 = np.arange(1, 9, dtype=np.int64)
    part = pd.DataFrame({"shard": 3, "h1": np.array([5, 5, 5, 6, 7, 7, 8, 9]), "h2": h2, "n": h2 + 2, "top": h2 * 10})
    built = lines._build(part)
    salt = int(built["salt"][0])
    ph = lines.PerfectHash.unpack(built["levels"][0])
    k = ph.find(lines._mixed(part["h1"].to_numpy(), h2, salt))
    assert salt == 1 and sorted(k) == list(range(8))
    assert (np.frombuffer(built["prints"][0], np.int64)[k] == h2).all() and (np.frombuffer(built["tops"][0], np.int64)[k] == h2 * 10).all()
    assert int(lines._build(part.iloc[[0, 3, 4]])["salt"][0]) == 0
