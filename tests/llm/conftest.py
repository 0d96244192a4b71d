from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ta", "re", "mi", "sol", "é", "lu", "ña") for b in ("n", "r", "do", "va", "x!")]


def make_rows() -> list[tuple]:
    """Copies, near copies, shared passages, hot lines, blanks, nulls and one very long text."""
    rng = random.Random(3)

    def prose(n):
        return " ".join(rng.choice(WORDS) for _ in range(n))

    base, passage, line = prose(120), prose(70), prose(12)
    texts = [base, base, passage + " " + prose(30), prose(20) + " " + passage, "", None, "  \n ", "one", "uno dos", prose(4), prose(4000) + "\n" + line]
    for k in range(12):
        words = base.split()
        for _ in range(1 + k % 4):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + "q"
        texts.append(" ".join(words))
    for k in range(8):
        texts.append(f"{prose(15)}\n{line}\n{prose(9)}\n{'ab ' * 3}\n" + (line.replace("r", "R", 1) if k % 2 else ""))
    texts += ["a" * 300, "a" * 180 + "b" + "a" * 90, "ab" * 200, "ab" * 60, "x\t y\rz " * 30]
    rows = [(k * 7 % 53, t, "en" if k % 3 else None) for k, t in enumerate(texts)]
    return rows + [(None, prose(60), None), rows[0], rows[2]]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with columns whose names an operator may use itself."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = ("h", "band", "node", "root", "token", "key", "at", "lo", "hits", "near", "piece", "uid", "shard", "size", "block", "word", "c", "score", "n", "removed", "kept", "lines", "count")
    return df.select("*", *(F.lit(None).cast("int").alias(c) for c in own)).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


def by_id(rows):
    """One text for each id, for brute force; a null id is the least."""
    return {(-(2**63) if i is None else i): (t or "") for i, t, *_ in rows}
