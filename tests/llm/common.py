"""Small documents with everything that can go wrong, and plain models of the contracts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, batch string, k1 long, start string, score string"


def tricky_rows(seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(300)] + ["Été", "ß", "naïve", "日本", "x'll", "<|endoftext|>", "I've", "1234"]
    def prose(n):
        return "".join(r.choice(vocab) + r.choice([" ", " ", " ", "\n", "  ", "\t", ", ", " "]) for _ in range(n))

    base = [prose(r.randint(1, 120)) for _ in range(40)]
    long = prose(6000)
    texts = [None, "", " ", "\n\n", "123 456", "!!!", "one", "one two", *base, base[0], base[0], base[1] + " end", long, long.replace("a", "b", 3),
             base[2] + "\n" + base[3], "prefix " + base[3], base[4] * 3, "é" * 200, "ab" * 300, "word " * 100, base[5].upper()]
    rows = [(k, t, ["en", "fr", None][k % 3], f"s{k % 12}" if k % 7 else None, len(t or ""), 1, "b", 5, "s", "x") for k, t in enumerate(texts)]
    rows += [rows[10], (None, base[6], "en", "s1", 3, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


def tricky(spark, rows=None):
    return spark.createDataFrame(tricky_rows() if rows is None else rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
