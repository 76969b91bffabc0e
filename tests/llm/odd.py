"""Documents that operators must survive: NULLs, blanks, repeats, ties, a very long text, clashing extra columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, key long, size long, _row long, h long"


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9)))
        out.append(w + ("." if i % 9 == 8 else ",\n"[i % 2] if i % 17 == 16 else ""))
    return " ".join(out)


def rows() -> list[tuple]:
    texts = [
        (1, words(120, 1), "en", "a"), (2, words(120, 1), "en", "a"), (2, words(120, 1), "en", "a"), (2, words(60, 2), "fr", "b"),
        (3, None, None, None), (4, "", "en", ""), (5, " \n\t ", "de", "b"), (None, words(80, 3), None, "c"), (None, None, None, None),
        (None, words(80, 3), "en", "c"), (6, "one", "en", None), (7, "one two", None, "a"), (-8, words(9000, 4), "en", "a"),
        (9, "\x01 \x85 a  b　c\r\n<|endoftext|>", "xx", "b"), (10, "数据 数据。 ééé ÀÀ", None, "é"), (11, "###!!! $$$", "en", "b"),
    ]
    return [(d, t, la, s, None if t is None else len(t), 0.5, 7, 8, 9, 10, 11) for d, t, la, s in texts]


def odd_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
