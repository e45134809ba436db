"""Small corpora for the tests."""

import os
import random
import time

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASHING = ("uid", "r", "k", "n", "s", "u", "w", "g", "h", "a", "b", "node", "root", "keep", "digest", "rate", "sketch", "bucket", "words", "lines", "copy", "grp", "block", "pos", "gone", "winner_doc_id", "keeper_doc_id")


def frame(spark, rows, clash=False):
    """documents of (doc_id, text, lang, source)."""
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)
    if clash:
        for c in CLASHING:
            df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def edited(rng, words, text, share):
    return " ".join(rng.choice(words) if rng.random() < share else w for w in text.split(" "))


def noting(run, path):
    """``run`` for mapInArrow, which writes the bytes and rows of each batch that reaches it into the folder ``path``."""

    def noted(batches):
        def each():
            for i, batch in enumerate(batches):
                (path / f"{os.getpid()}-{time.time_ns()}-{i}").write_text(f"{batch.nbytes} {batch.num_rows}")
                yield batch

        yield from run(each())

    return noted


ODD = [
    (None, "a text without an id " * 5, "en", "x"),
    (900, None, "en", "x"),
    (901, "", "en", "x"),
    (902, " \n\t ", None, None),
    (903, "one two three four five six", "en", None),
    (904, "one two three four five six", "en", None),
    (904, "one two three four five six", "en", None),
    (905, "É" * 30 + " ünï 🙂 cödé " * 3, None, "y"),
    (906, "word " * 30000, "en", "y"),
]


def random_rng(seed=1):
    return random.Random(seed)
