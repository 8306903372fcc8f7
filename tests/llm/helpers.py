"""Small tables with every awkward row, and plain versions of the base rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{i}" for i in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n)) + "."


def awkward() -> list[tuple]:
    """Null and empty values in every column, ties, repeated rows, long texts, odd characters."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "b", None),
        (3, near, None, "a", 5),
        (4, None, "en", "a", None),
        (5, "", "en", None, 0),
        (6, " \t\n\x0b\x0c\r ", "en", None, 7),
        (7, "two words", "de", "c", 9),
        (8, "TWO words", "de", "c", 9),
        (9, "x" * 5000, "en", "c", 5000),
        (10, "a" * 70 + " " + "ä€😀 " * 90, "en", "d", 0),
        (11, prose(2, 9000, 3000), "en", "a", 0),
        (12, "mail me at jo.doe@mail.example.com or +1 (386) 555-3733, card 4111 1111 1111 1111, host 10.0.0.255 now", "en", "a", 0),
        (13, "v 1.2.3.400 and 1.2.3.4.5.6.7.8 @ a@b @c.d +12 call 4111111111111112", "en", "a", 0),
        (13, "v 1.2.3.400 and 1.2.3.4.5.6.7.8 @ a@b @c.d +12 call 4111111111111112", "en", "a", 0),
        (14, "line one is here\nline one is here\n\nline one is here\n <|endoftext|> </s> <s>", "fr", "e", 0),
        (None, base, "en", "a", 1),
        (None, None, None, None, None),
    ]
    return rows


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The rows with extra columns whose names operators use inside."""
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    extra = {"key": "1", "tag": "'t'", "cls": "2", "turn": "3", "n": "4", "length": "5", "size": "6", "group": "7", "score": "0.5"}
    return df.selectExpr("*", *(f"{v} AS `{k}`" for k, v in extra.items()))


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")
