import collections
import math

import pytest

from plinth.llm import quality
from tests.llm.support import corpus, frame, prose

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), base


TEXTS = ["a\nb\n\na\n \nb \nb", "x y z x y z", "x y z x y z w x y z", "# * $ % & | < >##", "é ñ o 😀", "a a a", "a a a a", "a b", "\x0b\x0c\r\t", "line\nline\nline", "w " * 49, "w1 w2 w3 w4 w5 " * 11]


def test_rules_as_brute_force(spark):
    rows = corpus() + [(200 + i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(None, prose(1, 70), "en", "s")]
    docs = frame(spark, rows, clashing=True)
    found = quality.scored(docs, quality.Ratio([0.0] * quality.BUCKETS)).collect()
    text = {i: t for i, t, *_ in rows}
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r)[1:7] == brute(text[r["doc_id"]]), r["doc_id"]
        assert r["score"] == 0


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(2_000_000)]
    texts = [" ".join(words), " ".join(words + words[:3]), "x" * 3_000_000, "\n" * 1_000_000, "a b " * 500_000]
    found = {r["doc_id"]: r for r in quality.scored(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), quality.Ratio([0.0] * quality.BUCKETS)).collect()}
    assert [found[i]["n_repeat_words"] for i in range(5)] == [0, 6, 0, 0, 1_000_000]
    assert [found[i]["n_words"] for i in range(5)] == [2_000_000, 2_000_003, 1, 0, 1_000_000]


def test_junk_goes_and_prose_stays(spark):
    # So few documents teach pairs of a small vocabulary only.
    good = [(i, prose(i, 120, 25), "en", "s") for i in range(60)]
    junk = [(100 + i, " ".join(f"{w}!!$$" for w in prose(500 + i, 120, 25).upper().split()), "en", "s") for i in range(30)]
    docs = frame(spark, good + junk, clashing=True)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(0, 1, 0), (100, 0, 1), (None, 1, None), (7, None, None)], LABELS)
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(docs, labels).collect()}
    assert all(kept[i] == (i < 100) for i in kept)
    ratio, again = quality.fit(docs, labels), quality.fit(docs.repartition(5), labels)
    assert again.values == ratio.values
    assert quality.threshold(quality.scored(docs, ratio), labels) == quality.threshold(quality.scored(docs.repartition(5), ratio), labels)


def test_all_that_were_held_out_set_the_threshold(spark, monkeypatch):
    rows = [(i, prose(i, 60 + i, 25), "en", "s") for i in range(60)] + [(90, "short", "en", "s")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], LABELS)
    monkeypatch.setattr(quality, "TRUSTED", 5)
    held = {r[0] for r in spark.sql(f"SELECT id FROM range(100) WHERE pmod(xxhash64(id, 1), {quality.HELD_OUT}) = 0").collect()}
    found = quality.scored(frame(spark, rows), quality.fit(frame(spark, rows), labels))
    scores = sorted(math.floor(r["score"] * quality.STEPS) / quality.STEPS for r in found.collect() if r["doc_id"] in held and r["n_words"] >= 50)
    at = quality.QUANTILE * (len(scores) - 1)
    assert len(scores) > 5 and quality.threshold(found, labels) == pytest.approx(min(0.0, scores[0] + at * (scores[1] - scores[0])) - quality.SLACK)


def test_ratios_as_counted_otherwise(spark):
    """Ratios and scores from counts made by hand."""
    rows = [(i, "a b a", "en", "s") for i in range(40)] + [(50 + i, "b c", "en", "s") for i in range(7)] + [(90, None, "en", "s")]
    ratio = quality.fit(frame(spark, rows), spark.createDataFrame([(i, 1, 0) for i in range(40)], LABELS))
    bucket = {x: spark.sql(f"SELECT pmod(xxhash64({x}), {quality.BUCKETS})").first()[0] for x in ("'a'", "'b'", "'c'", "'a', 'b'", "'b', 'a'", "'b', 'c'")}
    every = {"'a'": 80, "'b'": 47, "'c'": 7, "'a', 'b'": 40, "'b', 'a'": 40, "'b', 'c'": 7}
    held = spark.sql(f"SELECT count_if(pmod(xxhash64(id, 1), {quality.HELD_OUT}) = 0) FROM range(40)").first()[0]
    trusted = {"'a'": 2, "'b'": 1, "'a', 'b'": 1, "'b', 'a'": 1}
    n, m = sum(every.values()), 5 * (40 - held)
    for x, b in bucket.items():
        assert abs(ratio.values[b] - math.log((trusted.get(x, 0) * (40 - held) + 1) / (m + quality.BUCKETS)) + math.log((every[x] + 1) / (n + quality.BUCKETS))) < 1e-9
    score = {r["doc_id"]: r["score"] for r in quality.scored(frame(spark, rows), ratio).collect()}
    parts = ["'a'", "'b'", "'a'", "'a', 'b'", "'b', 'a'"]
    assert abs(score[0] - sum(ratio.values[bucket[x]] for x in parts) / 5) < 1e-4 and score[90] == 0


def test_nothing_trusted_nothing_there(spark):
    none = spark.createDataFrame([], LABELS)
    docs = frame(spark, corpus())
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.assess(docs, none).collect())
    assert quality.assess(frame(spark, []), none).collect() == []


def test_only_dataframe_functions(spark):
    docs = frame(spark, corpus())
    plan = quality.scored(docs, quality.Ratio([0.0] * quality.BUCKETS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
