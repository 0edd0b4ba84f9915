import random

import pytest

from plinth.llm import graph, nearcopies
from plinth.llm.graph import components
from plinth.llm.nearcopies import near_duplicates
from tests.llm.support import corpus, edited, frame, prose, words


def shingles(text):
    w = [x.lower() if x.isascii() else x for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def reach(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def brute(rows, percent=75):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = reach(ids, links)
    return sorted({(i, len(sets[i]), comp[i], comp[i] == i) for i in ids})


def run(spark, rows, **more):
    return sorted(set(map(tuple, near_duplicates(frame(spark, rows, **more)).collect())))


@pytest.mark.parametrize("seed", [0, 1])
def test_as_brute_force(spark, seed):
    rows = corpus(seed) + [(None, prose(1, 50), "en", "s")]
    assert run(spark, rows, clashing=True) == brute(rows)


def test_a_group_of_many_near_copies(spark):
    # Copies of one text with few to many changes, and copies of changed copies: links in all directions.
    base = prose(1, 150, 5000)
    rows = [(i, edited(base, i, 0.004 * (i % 9)), "en", "s") for i in range(1, 90)] + [(0, base, "en", "s")]
    rows += [(100 + i, edited(rows[8][1], 500 + i, 0.01), "en", "s") for i in range(10)]
    found = run(spark, rows)
    assert found == brute(rows) and len({r[2] for r in found}) > 1


def test_rows_that_share_a_doc_id(spark):
    rows = [(i % 40, edited(prose(i % 7, 60, 5000), i, 0.03 * (i % 5)), "en", "s") for i in range(120)]
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if i != j and 100 * len(a & b) >= 75 * len(a | b)]
    comp = reach({i for i, _ in sets}, links)
    assert run(spark, rows) == sorted({(i, len(a), comp[i], comp[i] == i) for i, a in sets})


def counted(monkeypatch):
    """Lists of how many pairs are compared, and how many rows of unlinked classes meet in buckets, from now on."""
    compared, met = [], []
    compare, partners = nearcopies._compared, nearcopies._with_partners

    def count_compared(pairs, *more):
        compared.append(pairs.count())
        return compare(pairs, *more)

    def count_met(side):
        out = partners(side).cache()
        met.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "_compared", count_compared)
    monkeypatch.setattr(nearcopies, "_with_partners", count_met)
    return compared, met


def test_many_texts_of_one_template(spark, monkeypatch):
    """Similarity of about 0.6 to 0.74 to each other: buckets of thousands without a link, which must not be compared pair by pair."""
    base = prose(1, 120, 50_000)
    texts = [edited(base, i, 0.035 + 0.0001 * (i % 100)) for i in range(3000)]
    sets = [shingles(t) for t in texts]
    root = shingles(base)
    # Edits are new words, so two texts share what both kept of the template.
    kept = [s & root for s in sets]
    compared, met = counted(monkeypatch)
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert sum(compared) < 40 * len(texts)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(kept[a] & kept[b]) >= 75 * (len(sets[a]) + len(sets[b]) - len(kept[a] & kept[b]))]
    assert found == reach(range(len(sets)), links)
    print("template:", compared, met)


def test_large_buckets_over_a_grid(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "CELL", 3)
    base = prose(2, 80, 5000)
    pool = [prose(50 + i, 20, 5000) for i in range(12)]
    # Texts of a template with passages of a pool: none has shingles of its own.
    rows = [(i, base + " " + pool[i % 12] + " " + pool[(i * 5 + i // 12) % 12], "en", "s") for i in range(100)]
    assert run(spark, rows) == brute(rows)


def test_the_threshold_itself(spark):
    # 8 words are 4 shingles, 7 words 3 of them: exactly three quarters.
    rows = [(1, "a b c d e f g h", "en", "s"), (2, "a b c d e f g", "en", "s"), (3, "a b c d e f", "en", "s"), (4, "A B C D E F G", "en", "s"), (5, "É b", "en", "s"), (6, "é b", "en", "s")]
    assert run(spark, rows) == brute(rows)
    assert [r[2] for r in run(spark, rows)] == [1, 1, 3, 1, 5, 6]


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, None, None), (2, "", None, None)]) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 4), (4, 5), (9, 7), (7, 8), (3, None)], [(i, i ^ 1) for i in range(20)]])
def test_components(spark, links):
    sound = [(a, b) for a, b in links if b is not None and a != b]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == reach({n for pair in sound for n in pair}, sound)


@pytest.mark.parametrize(("share", "tasks"), [(graph.LINKS, 1), (12, 4)])
def test_few_links_take_few_tasks(spark, monkeypatch, share, tasks):
    monkeypatch.setattr(graph, "LINKS", share)
    made, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: made.append(df.rdd.getNumPartitions()) or write(df))
    links = [(i, i // 4) for i in range(1, 45)]
    conf = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = components(spark.createDataFrame(links, "a long, b long"))
        assert found.rdd.getNumPartitions() <= tasks and max(made[1:]) <= tasks
        assert dict(map(tuple, found.collect())) == reach(range(45), links)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_least_needs_of_other_components(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(30), rng.randrange(6), rng.randrange(4), rng.randrange(-9, 12)) for _ in range(200)] + [(99, 1, 1, -5), (99, 2, 1, -5)]
    side = spark.createDataFrame(rows, "band long, class long, component long, need long").repartition(3)
    least = [r for r in rows if any(r[0] == o[0] and r[2] != o[2] and r[3] + o[3] <= 0 for o in rows)]
    assert sorted((r["band"], r["class"], r["component"], r["need"]) for r in nearcopies._with_partners(side).collect()) == sorted(least)
