"""Small documents with all that can go wrong: nulls, empty and long texts, ties, repeats."""

import random

from pyspark.sql import types as T

WORDS = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    # Names that the operators use themselves.
    *[T.StructField(n, T.StringType()) for n in (
        "h", "key", "size", "start", "score", "taken", "fp", "n_words", "label", "text_key",
        "digest", "n_lines", "position", "part", "component_id", "words", "lines")],
])


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def hard_rows(seed=1):
    """(doc_id, text, source) rows."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    line = "A Line that many documents share, at least forty letters long"
    base = prose(rng, 300)
    rows = []
    for i in range(40):
        text = prose(rng, rng.randint(5, 120))
        if i % 4 == 0:
            text = f"{text} {passage} {prose(rng, 30)}"
        if i % 3 == 0:
            text = f"{text}\n  {line.upper() if i % 2 else line}\t\n{prose(rng, 20)}"
        if i % 7 == 0:
            words = base.split()
            words[rng.randrange(300)] = "changed"
            text = " ".join(words)
        rows.append((i, text, f"src{i % 4}"))
    rows += [(100 + i, base, "src0") for i in range(6)]
    rows += [(200, None, "src1"), (201, "", None), (202, " \t\n\u000b ", "src2"), (None, base, None)]
    rows += [(None, None, "src1"), (203, prose(rng, 30000), "src3"), (204, "x" * 5000, "src0")]
    rows += [(205, "é" * 300 + "\n" + "é" * 300, "src1"), (206, "a b " * 400, "src2")]
    rows += [(207, "nul \0 char \0 in it " * 20, "src2"), (208, "single", "src0")]
    rows += [(7, rows[7][1], "src3"), (9, prose(rng, 50), "src1"), (210, base.upper(), "src1")]
    rows += [rows[3]] * 3
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, *["clash"] * (len(SCHEMA) - 3)) for r in rows], SCHEMA)
