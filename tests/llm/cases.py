"""Rows with nulls, empty and long texts, ties, repeats, and columns whose names clash with results."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        *[
            T.StructField(c, T.StringType())
            for c in ("ids", "n_words", "fp", "row", "kept", "sequence_id", "line", "h", "id", "word", "c", "doc", "host")
        ],
    ]
)
WORDS = "alpha beta gamma delta über straße été 漢字 don't it's x1 42 a.b foo, end. ALPHA Beta".split()


def texts(seed: int = 1, n: int = 40) -> list[str]:
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 14)))
    out = ["\n".join(line() for _ in range(r.randrange(1, 6))) for _ in range(n)]
    out += [None, "", " \t\n ", "\n\n", "one", "two words", "  a  b \n c ", "x\x0by\x0cz\r\nq", "tab\tsep  <|endoftext|> ▁   é"]
    out.append(" ".join(r.choice(WORDS) + str(r.randrange(3000)) for _ in range(20000)))
    return out


def documents(spark, seed: int = 1, n: int = 40):
    """Ids 0, 1, ...; one row without an id, one that repeats, copies, and near copies."""
    rows = [(i, t) for i, t in enumerate(texts(seed, n))]
    rows += [(None, "a row without an id"), rows[3], (rows[-1][0] + 1, rows[2][1]), (rows[-1][0] + 2, (rows[2][1] or "") + " tail")]
    extra = ("clash",) * 13
    return spark.createDataFrame([(i, t, None if i == 5 else f"s{(i or 0) % 2}", *extra) for i, t in rows], SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
