"""Made-up documents for the tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    parts = "an the er on in re th ou st ble ing ed ion ea or ha".split()
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def table(spark, rows, extra=""):
    """Documents of (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


#: Rows that every operator has to bear: nulls, empty and blank texts, repeats, one word, no letters, a very long text.
ODD = [(None, "an odd row"), (None, None), (901, None), (902, ""), (903, " \n\t "), (904, "one"), (904, "one"), (905, "!!! ??? ..."), (906, "x" * 50_000), (907, "é中😀   ñ\0b"), (908, "word " * 20_000)]
