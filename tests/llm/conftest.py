import random

import pytest


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def invent(rng, n):
    return " ".join(rng.choice(["the", "Of", "red", "ring", "gear", "naïve", "Über", "x1", "a-b", "end.", "日本"]) + rng.choice(["", "", "s", "ing", str(rng.randrange(30))]) for _ in range(n))


def texts():
    """Texts with nulls, empties, blanks, short and very long ones, copies, near copies and shared passages."""
    rng = random.Random(4)
    base, shared = invent(rng, 120), invent(rng, 40)
    words = base.split(" ")
    near = [" ".join(w if k != at else "changed" for k, w in enumerate(words)) for at in (3, 60, 119)]
    out = [base, base, *near, None, "", " \n\t ", "one", "one two three four", "one two three four five", invent(rng, 30) + " " + shared, shared + " " + invent(rng, 25), invent(rng, 50) + "\n" + shared + "\n" + invent(rng, 9)]
    out += [invent(rng, 4000), "ab" * 400, "a" * 1500, base.upper(), invent(rng, 200), "one two three four"]
    return out


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars) with a null id and two rows that share an id."""
    out = [(k, t, "en", f"src{k % 4}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts())]
    return [*out, (None, "a row without an id but with words in it", "en", "src1", 40), (3, "another text under an id that is taken", None, "src0", None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("id", "u", "n", "key", "size", "spans", "_row", "_stats", "held_out", "block", "k")


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(f"{c}?").alias(c) for c in CLASHES]).repartition(3).cache()


@pytest.fixture(scope="session")
def plain_docs(spark, rows):
    """The rows with unique ids only."""
    return spark.createDataFrame([r for r in rows[:-2]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
