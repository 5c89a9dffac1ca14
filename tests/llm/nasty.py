"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, tag string, h string, size string, node string, label string, name string, src string, key string, toxic string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "é", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows() -> list[tuple]:
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = prose(9, 30)
    long = prose(5, 30_000)
    texts = [
        (1, base), (2, base.upper()), (3, near), (4, near), (4, near), (5, None), (6, ""), (7, "   \n\t "), (None, base), (None, prose(2, 40)), (8, long), (9, long + " more"),
        (10, "one two"), (11, "one  TWO"), (12, "x"), (12, prose(3, 50)), (13, prose(7, 80) + " " + passage), (14, passage + " " + prose(8, 80)), (15, "a" * 300), (16, "a" * 120),
        (17, "😀 é " * 40), (18, "<|im_end|> <|endoftext|> " * 5), (-3, prose(2, 40)), (19, "12 % $$ !!"),
    ]
    langs, sources = ["en", None, "de"], ["s1", None, "a", "é"]
    return [(k, t, langs[i % 3], sources[i % 4], None if i % 5 == 0 else 7, i, "r", "t", "h", "z", "n", "l", "m", "s", "k", "x") for i, (k, t) in enumerate(texts)]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def pairs() -> list[tuple]:
    return [(r[0], r[1]) for r in rows()]
