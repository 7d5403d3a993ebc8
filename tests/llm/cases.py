"""Small tables with the odd rows that every operator has to take."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
WORDS = "the of and to in is thing tionable müssen été niño große ABC Don't x1 42 ... <|endoftext|> ½ ² _a_ Σίσυφος J̌ 日本語  x ▁m".split(" ")


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\n", ". ", ", "]) for _ in range(n)).strip()


def texts():
    long = prose(1, 30000)
    return [
        "", None, " ", "\n", "  a  ", "a", "▁", "▁▁ x", "one two three four", long, long, prose(2, 400), prose(2, 400) + " tail",
        "\x00 zero", "same line\nsame line\nother\nsame line", "a b c a b c a b c", "é́ é", "\x0b\x0c\r\t", "x" * 5000, "#" * 300,
        "I'll they've CAN'T 'tis <|startoftext|>end <|endoftext|> KK İ", "tab\tsep\vform", prose(3, 60), prose(3, 60), "\U0001f600 \U0001f600‍",
    ]


def rows():
    found = [(i, t, "en", f"src{i % 3}" if i % 7 else None, None) for i, t in enumerate(texts())]
    return found + [found[11], (None, "no id", None, "src0", None), (None, None, None, None, None)]


def frame(spark, data=None, extra=()):
    """Rows as ``documents``, with extra string columns that clash with names of operators."""
    data = rows() if data is None else data
    schema = T.StructType([*SCHEMA.fields, *(T.StructField(n, T.StringType()) for n in extra)])
    return spark.createDataFrame([(*r, *(["clash"] * len(extra))) for r in data], schema).repartition(3)


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
