import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those that operators add.
CLASHES = ["shard", "slot", "position", "epoch", "media", "n_bytes", "n_words", "n_removed", "kept", "log_ppl", "n_tokens", "token_ids", "_doc", "_row", "payload"]


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def make_rows():
    rng = random.Random(3)
    passage, line = words(rng, 60), "Licensed under the Apache License, Version 2.0."
    rows = [(i, words(rng, rng.randrange(1, 90)), "en" if i % 3 else "de", f"src{i % 4 if i % 2 else 0}") for i in range(40)]
    base = words(rng, 120)
    rows += [(100 + i, base, "en", "src0") for i in range(6)]  # copies
    rows += [(110 + i, " ".join(w if k != 7 * i else "changed" for k, w in enumerate(base.split())), "en", "src1") for i in range(6)]  # near copies
    rows += [(120 + i, f"{words(rng, 20)}\n{passage}  {words(rng, 20)}", "fr", "src2") for i in range(5)]
    rows += [(130 + i, f"{words(rng, 9)} {line} {words(rng, 9)}", "fr", "src2") for i in range(5)]
    rows += [(140, None, "en", "src0"), (141, "", "en", "src0"), (142, " \n\t ", None, None), (143, None, None, "src9"), (None, base, "en", "src0"), (None, passage, "en", None), (None, None, None, None)]
    rows += [(150, passage, "es", "src3"), (150, passage, "es", "src3"), (150, "another text of the same id", "es", "src3")]
    rows += [(160, "Ünïcode, ça va? 東京 🙂 nbsp em  two  spaces\r\nline\x0bvt\x1cfs <|endoftext|> it's İstanbul ΑΣ é", "xx", "src3")]
    rows += [(161, words(rng, 30_000, 4000), "en", "src1"), (162, "x" * 50_000, "en", "src1"), (163, "same " * 3000, "en", "src1"), (164, "THE End. " * 40, "en", "src1")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def wide(docs):
    """docs with columns whose names clash."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("mine").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, a):
        while self.up.setdefault(a, a) != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


@pytest.fixture
def sets():
    return Sets()
