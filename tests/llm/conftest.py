import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
#: Columns that operators may use inside, with values of other types.
CLASHES = {
    "key": "k", "row": 1, "kept": "no", "fp": 2.5, "component": "c", "places": "p", "probability": "x", "sampled": 3, "cut_id": 4, "cut_hash": "h",
    "later_id": 5, "doc": "d", "item_id": "i", "path": 6, "lines": "l", "earlier": 7, "words": "w", "class": "y", "topic": 8, "n_words": "n", "_cell_lang": 1,
}


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    """Null, empty, blank and very long texts, null keys, repeated rows and one id with two texts."""
    rng = random.Random(3)
    long = "\n".join(sentence(rng, 40) for _ in range(700))
    base = sentence(rng, 60) + "\n" + sentence(rng, 30)
    texts = [None, "", " \n\t \x0b", long, base, base, base + " tail", "é" * 300, "a" * 5000, "one", "ONE", "x\ny\nx\ny " + base]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (4, sentence(rng, 50), "de", "s1"), (None, base, "en", "s0"), (None, None, None, None), (None, base, "en", "s0")]
    rows += [(100 + k, sentence(rng, rng.randrange(1, 90)), "fr", "s2") for k in range(20)]
    return rows


def documents(spark, rows, clashes=False):
    table = [(i, t, lang, source, len(t) if t is not None else None) for i, t, lang, source in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    if clashes:
        table = [(*r, *CLASHES.values()) for r in table]
        kinds = {str: "string", int: "int", float: "double"}
        schema += "".join(f", `{c}` {kinds[type(v)]}" for c, v in CLASHES.items())
    return spark.createDataFrame(table, schema).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, odd_rows(), clashes=True).cache()


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [], clashes=True)
