"""Small tables for the tests of this folder."""

import random

#: Texts of every awkward sort: null, empty, blank, no letter, one word, very long, repeated, marks of other scripts.
AWKWARD = [None, "", "   \n\t ", "12 34 !!", "one", "word " * 30_000, "x" * 200_000, "Ünï çödé ß 漢字 ́a​", "same text here now", "same text here now", "a\x01b\x1cc d e <|endoftext|> f"]


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{min(int(rng.paretovariate(0.6)), vocabulary)}{rng.choice(['', '', '.', ','])}" for _ in range(n))


def documents(spark, texts, first=0):
    """doc_id, text and further columns, some with names that an operator might use for itself."""
    rows = [(first + k, t, "en" if k % 3 else None, f"src{k % 4}", len(t) if t is not None else None, k, "clash", k % 2 == 0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _spans int, _gone string, _text_hash boolean")


def empty(spark):
    return documents(spark, ["x"]).where("false")
