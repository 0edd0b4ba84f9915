"""Small corpora, and what the tests compare with."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ("k", "h", "n", "size", "hash", "class", "band", "score", "lang_pred", "row", "group", "copy", "spans", "w", "key", "target", "limit", "kept", "component_id")


def frame(spark, rows, clashing=False):
    """documents of rows (doc_id, text, lang, source), perhaps with columns of clashing names."""
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
    for name in CLASHING if clashing else ():
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df.repartition(3)


def words(text):
    return (text or "").encode().split()


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def corpus(seed=0):
    """Copies, near copies, shared passages, empty, null, short and long texts, ties and repeated rows."""
    base = [prose(seed * 100 + i, 60 + 30 * i) for i in range(8)]
    passage = prose(seed + 999, 55)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20 + i, base[2], "en", "s1") for i in range(4)]
    rows += [(30 + i, edited(base[7], i, 0.006 * i), "en", None) for i in range(12)]
    rows += [(50 + i, prose(seed + 70 + i, 20) + "\n" + passage + "\t" + prose(seed + 80 + i, 15 + i), "de", "s2") for i in range(3)]
    rows += [(60, None, None, None), (61, "", "en", "s0"), (62, " \t\n", None, "s0"), (63, "one", "en", "s9"), (64, "ONE", "en", "s9"), (65, "a b c d", "fr", "s9"), (66, passage + " " + passage, "en", "s0"), (67, "la " * 300, "fr", "s0"), (68, prose(5, 30_000, 9000), "en", "s1"), (69, "x" * 50_000, "en", "s1")]
    return rows + [rows[3], rows[20]]
