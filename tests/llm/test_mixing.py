import collections

import pytest

from plinth.llm import mixing
from tests.llm.support import corpus, frame, prose, words


def targets(sizes):
    """By filling up and sharing the excess again."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    capped = set()
    while True:
        rest, w = 1.5 * sum(sizes.values()) - sum(2 * sizes[n] for n in capped), sum(weight[n] for n in names if n not in capped)
        found = {n: 2 * sizes[n] if n in capped else rest * weight[n] / w for n in names}
        more = {n for n in names if n not in capped and found[n] > 2 * sizes[n]}
        if not more:
            return found
        capped |= more


def check(rows, found):
    sizes, most = collections.Counter(), collections.Counter()
    source = {}
    for i, t, _, s in rows:
        sizes[s] += len(words(t))
        most[s] = max(most[s], len(words(t)))
        source[i] = s
    expected, taken = targets(sizes), collections.Counter()
    assert len(found) == len(rows)
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(expected[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= most[s], s


def test_as_computed_otherwise(spark):
    rows = [r for r in {r[0]: r for r in corpus()}.values()] + [(1000 + i, prose(i, 5 + i % 40), "en", f"m{i % 7}") for i in range(300)]
    docs = frame(spark, rows, clashing=True)
    found = mixing.mix(docs).collect()
    check(rows, found)
    assert {r["doc_id"]: r["size"] for r in found} == {i: len(words(t)) for i, t, *_ in rows}
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, found))
    copies = collections.Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert copies == +collections.Counter({r["doc_id"]: r["copies"] for r in found}) and mixing.mixed(docs).columns == docs.columns


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(7, "a b c", "en", "s")] * 5 + [(None, f"t{i} u", "en", None) for i in range(40)] + [(i, None, "en", "z") for i in range(10, 14)]
    found = mixing.mix(frame(spark, rows)).collect()
    assert len(found) == len(rows) and len({r["taken"] for r in found if r["doc_id"] == 7}) == 1
    assert sum(r["taken"] for r in found if r["doc_id"] is None) == pytest.approx(found[[r["doc_id"] for r in found].index(None)]["target"], abs=4)


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).collect() == [] and mixing.mixed(frame(spark, [])).collect() == []
    assert [tuple(r)[1:5] for r in mixing.mix(frame(spark, [(1, "", "en", "s")])).collect()] == [(0, 0, 0.0, 0)]


def test_only_dataframe_functions(spark):
    plan = mixing.mixed(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
