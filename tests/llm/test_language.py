import random
import zlib

import numpy as np

from plinth.llm import language
from tests.llm.support import corpus, frame

LANGUAGES = {"en": ["the", "and", "thing", "with", "whether"], "de": ["und", "nicht", "schön", "über", "keit"], "fr": ["les", "été", "où", "eaux", "quel"]}


def text(name, rng, n):
    return " ".join("".join(rng.choice(LANGUAGES[name]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def labelled(n=240):
    rng = random.Random(4)
    return [(i, text(name, rng, rng.randint(5, 60)), name, "s") for i in range(n) for name in [rng.choice(list(LANGUAGES))]]


def test_held_out_accuracy(spark):
    rows = labelled()
    odd = [(1000, None, "en", "s"), (1001, "123 ... !", "de", "s"), (1002, "", None, "s"), (None, "und nicht schön über", "de", "s"), (1003, "THE AND WITH " * 5000, None, "s")]
    found = language.identify(frame(spark, rows + odd, clashing=True)).collect()
    names = {r[0]: r[2] for r in rows}
    tested = [r for r in found if r["held_out"] and r["doc_id"] in names]
    assert len(tested) > 50 and sum(r["lang_pred"] == names[r["doc_id"]] for r in tested) >= 0.98 * len(tested)
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in found)
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1003]["lang_pred"] == "en" and by_id[None]["lang_pred"] == "de" and not by_id[None]["held_out"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found if r["doc_id"] is not None)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = labelled()
    lied = [(i, t, name if zlib.crc32(str(i).encode()) % 3 != 1 else "xx", s) for i, t, name, s in rows]
    pick = lambda rows: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(frame(spark, rows)).collect())
    assert pick(rows) == pick(lied)


def test_counts_as_one_by_one(spark):
    rows = labelled(60)
    model = language.train(frame(spark, rows))
    assert model.languages == sorted(LANGUAGES)
    for i, name in enumerate(model.languages):
        found, *_ = language.ngrams([t.lower() for _, t, n, _ in rows if n == name], language.BUCKETS)
        counts = [0] * language.BUCKETS
        for b in found:
            counts[b] += 1
        total = len(found) + language.ALPHA * language.BUCKETS
        for b in set(found[:50].tolist()):
            assert abs(model.slices[0].value.weights[i, b] - __import__("math").log((counts[b] + language.ALPHA) / total)) < 1e-4


def test_no_labels_no_rows(spark):
    assert language.identify(frame(spark, [])).collect() == []
    assert {r["lang_pred"] for r in language.identify(frame(spark, [(i, t, None, s) for i, t, _, s in corpus()])).collect()} == {"und"}


def test_long_texts_in_parts(monkeypatch):
    text = "Ünd the İÇ nicht; " * 5000 + "x"
    found, first, _ = language.ngrams([text.lower()], language.BUCKETS)
    monkeypatch.setattr(language, "_STEP", 1000)
    parts = list(language.counted([text]))
    assert len(parts) > 80 and np.array_equal(np.sort(np.concatenate([p[0] for p in parts])), np.sort(found))
    assert [len(p[0]) for p in language.counted([text, "a"])] == [len(found) + 1]


def test_very_long_texts(spark):
    rows = [*labelled(60), (1000, "und nicht schön über " * 100_000, None, "s"), (1001, "x" * 2_000_000, "fr", "s"), (1002, ". " * 1_000_000, None, "s")]
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(frame(spark, rows)).collect()}
    assert found[1000] == "de" and found[1002] == "und"


def test_very_many_labels(spark):
    """More labels than a slice has, some of them rare, change nothing but what they teach themselves."""
    rows = [(i, t, n, s) for i, t, n, s in labelled(200)]
    rows += [(1000 + i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 5, f"x{i:03}", "s") for i in range(300)]
    docs = frame(spark, rows)
    model = language.train(docs)
    assert len(model.languages) == 303 and [len(part.value.weights) for part in model.slices] == [128, 128, 47]
    few = language.train(docs.filter("doc_id < 1000"))
    for i, name in enumerate(few.languages):
        at = model.languages.index(name)
        assert np.array_equal(model.slices[at // 128].value.weights[at % 128], few.slices[0].value.weights[i])
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert all(found[r[0]] == r[2] for r in rows)
