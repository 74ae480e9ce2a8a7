import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """(doc_id, text): shared passages, near and exact copies, repeats inside
    a text, ties, nulls, empty, blank, very long texts, repeated rows."""
    rng = random.Random(seed)
    passage = words(rng, 45)
    near = words(rng, 120)
    rows = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 90))
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(8):rng.randrange(30, 46)]
        if i % 7 == 0:
            w = list(near)
            for _ in range(i % 5):
                w[rng.randrange(len(w))] = f"e{i}"
        rows.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(w)))
    rows += [(100, rows[9][1]), (101, rows[9][1]), (102, "same " * 60), (103, "é ü " * 30), (104, "aa bb cc"), (105, "aa bb cc"),
             (106, "\n".join(["a line of text here"] * 12)), (107, "x" * 500), (108, " ".join(words(rng, 30_000, 50_000))),
             (109, None), (110, ""), (111, " \n\t "), (None, rows[0][1]), (None, None), (None, "null id " + " ".join(passage))]
    rows += [rows[12], rows[12], (109, None), (-5, " ".join(passage))]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    """The corpus as a DataFrame with null, extra and clashing columns."""
    rows = corpus()
    df = spark.createDataFrame([(i, t, [None, "en", "fr"][k % 3], None, len(t) if t else None) for k, (i, t) in enumerate(rows)], DOC_SCHEMA)
    clash = ["part", "rid", "key", "shard", "n", "rank", "length", "cls", "label", "kept", "stratum", "offset", "cell", "grade", "host"]
    for c in clash:
        df = df.withColumn(c, df.doc_id.cast("string"))
    return df.repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def same(got, expected):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(expected, key=key)
