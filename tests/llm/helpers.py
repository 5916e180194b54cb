"""Small documents with every awkward case, and a runner for the SQL."""

import random

import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: A Thue-Morse word and its complement, which have one value under every polynomial hash modulo 2^64.
TWINS = ["".join(pair[i.bit_count() % 2] for i in range(1024)) for pair in ("ab", "ba")]
TABLES = ("documents", "benchmark", "pages", "labels")


def documents(spark, rows):
    full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s0", None))) for r in rows]
    return spark.createDataFrame(full, DOCS)


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def sentence(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def vocabulary(seed, n=200):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def oracle(sql, folder, names):
    import duckdb

    con = duckdb.connect()
    for t in names:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con.execute(sql).df()


def same(result, expected, key):
    """Equal rows, as multisets, whatever the order of rows and columns."""
    a = result.toPandas()
    assert sorted(a.columns) == sorted(expected.columns)
    cols = sorted(a.columns)
    one = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) and x == int(x) else x
    plain = lambda df: sorted(str([one(x) for x in r]) for r in df[cols].astype(object).values.tolist())
    assert plain(a) == plain(expected)
