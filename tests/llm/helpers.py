"""Small frames and a DuckDB comparison for the tests of this folder."""

import duckdb

SMALL = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"

#: Texts that every operator on documents must take: null, empty, white space, ties and repeats, long, odd characters.
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "one two three"), (5, "one two three"), (None, "no id here at all"),
        (7, "x" * 200_000), (8, "word " * 30_000), (9, "Ünï ⅷ ½² 日本 👍🏽 \x00 \x1c a\r\nb"), (10, "▁ <|endoftext|> 'll")]


def edge_docs(spark):
    """EDGE with extra columns whose names clash with operators' own."""
    rows = [(i, t, 1.5, "s", True, "k") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, sid string, kept boolean, predicted string")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted((dict(zip(names, r)) for r in cur.fetchall()), key=str)


def spark_rows(df):
    return sorted((r.asDict() for r in df.collect()), key=str)
