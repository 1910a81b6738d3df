import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, "
                 "score double, fp long, key string, component_id long",
    "labels": "doc_id long, quality int, toxic int, text string, score double",
    "benchmark": "item_id long, text string, doc_id long",
    "conversations": "conv_id long, turn long, role string, text string, formatted string",
    "embeddings": "vec_id long, embedding array<float>, label int, x array<long>, n long, "
                  "component int",
    "pages": "page_id long, url string, html string, digest string, size long, kind string",
}


def sql(query, folder=SF):
    """Rows of a DuckDB query over the tables of ``folder``, as sorted tuples by column name."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = con.execute(query)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def document_texts(folder=SF):
    return sorted(sql("SELECT doc_id, text FROM documents", folder))


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """Tables with null, empty, repeated and very long values, ties, and extra columns whose names
    the operators use themselves."""
    base = str(tmp_path_factory.mktemp("odd"))
    plain = "the quick brown fox jumps over the lazy dog and runs away into the dark green forest "
    long = " ".join(f"word{i} tail{i % 97}" for i in range(40_000))
    docs = [(1, plain * 8), (2, None), (3, ""), (4, long), (5, plain * 8), (None, plain * 8),
            (None, None), (1, plain * 8), (1, "another text of the same id"), (6, "   \n\t "),
            (7, "idiot loser scum"), (8, "ünï cödé 日本語 😀 <|endoftext|> \x1c odd"), (9, "a"),
            (10, "x" * 3000), (11, "1234 5678 !!"), (12, plain)]
    data = {
        "documents": [(i, t, lang, s, n, 1.5, 7, "k", 3) for (i, t), lang, s, n in zip(
            docs, ["en", None, "en", "fr"] * 4, ["a", None] * 8, [None, 3] * 8)],
        "labels": [(1, 1, 0, None, None), (7, None, 1, "x", 2.0), (7, 0, 1, "x", 2.0),
                   (5, 1, None, None, None), (None, 0, 1, None, None), (4, 0, 0, "", 0.0),
                   (12, 1, 0, "t", 1.0), (9, 0, 1, "t", 1.0)],
        "benchmark": [(1, "The quick BROWN fox, jumps over the lazy dog and runs", 5), (2, None, 1),
                      (3, "lazy dog", 2), (None, "word5 tail5", 3), (3, "brown fox", 4),
                      (4, "...", 4)],
        "conversations": [(1, 0, "user", "hi </s>", "f"), (1, 1, "assistant", None, "f"),
                          (1, 1, "assistant", "b\\e\\b<s>", "f"), (None, None, None, None, None),
                          (2, 0, "assistant", "[INST] \\ <|image|>", "f"),
                          (2, 0, "assistant", "[INST] \\ <|image|>", "f"),
                          (3, None, "sys\ntem", "l\n\n" * 20_000, "f")],
        "embeddings": [(i, v, 1, [7], 2, 3) for i, v in [
            (1, [0.5, 1.0, -2.0]), (2, [0.5, 1.0, -2.0]), (2, [0.5, 1.0, -2.0]), (3, None),
            (4, []), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 2.0]),
            (7, [float("inf"), 1.0, 2.0]), (8, [1.0, 2.0]), (None, [0.25, -1.0, 3.0]),
            (9, [1e30, 0.0, 0.0]), (10, [0.0, 0.0, 1.0])]],
        "pages": [(3, "http://a/\r\n", plain * 3, "d", 1, "k"), (1, None, plain * 3, "d", 1, "k"),
                  (1, None, plain * 3, "d", 1, "k"), (None, "u", plain * 3, "d", 1, "k"),
                  (4, "u", None, "d", 1, "k"), (5, "u", "", "d", 1, "k"), (6, "u", "tiny", "d", 1,
                                                                         "k"),
                  (7, "u", "tiny", "d", 1, "k"), (8, "u", long, "d", 1, "k"),
                  (9, "u", long, "d", 1, "k"), (10, "u", "\r\n\r\n" + long + "é" * 70_000, "d", 1,
                                                "k")],
    }
    for name, schema in TABLES.items():
        spark.createDataFrame(data[name], schema).write.parquet(f"{base}/{name}.parquet")
    return base


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("empty"))
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{base}/{name}.parquet")
    return base
