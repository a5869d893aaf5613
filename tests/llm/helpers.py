from __future__ import annotations

import random
import re

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ba", "ke", "li", "mo", "nu") for b in ("ra", "te", "si", "lo", "du") for c in ("n", "r", "s", "t")]


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) for _ in range(n)]


def documents(spark, rows: list[tuple], partitions: int = 3):
    """Rows of (doc_id, text[, source]) as a documents table."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, KIND).repartition(partitions) if full else spark.createDataFrame([], KIND)


def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    long = " ".join(words(rng, 30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, long + " end"), (7, "same text of six words here"), (7, "same text of six words here"), (8, "same text of six words here"), (9, "é 中文 \u0000 🦀 token"), (None, "no id at all but words"), (10, "x", None)]
    return documents(spark, rows)


def clashing(df):
    """The frame with more columns, of names that operators give their own."""
    from pyspark.sql import functions as F

    extra = ["score", "component_id", "name", "keys", "TEXT", "Doc_ID", "r", "c0", "copy", "rate", "host", "path", "x", "row", "n", "label", "piece", "deal"]
    return df.toDF(*[f"z{i}" for i in range(len(df.columns))]).select("*", *[F.lit(i).alias(f"y{i}") for i in range(len(extra))]).toDF(*df.columns, *extra)


def shingles(text: str | None) -> frozenset:
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
