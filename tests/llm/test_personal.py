import hashlib
import random
import re
import time

import pytest

from plinth.llm import personal
from plinth.llm.personal import KINDS, base_spans, detect, find, mask, masked, normalised
from tests.llm.support import corpus, frame


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
    return total % 10 == 0


def plain(text):
    """The base kinds as their definition reads."""
    count = lambda s: len(re.sub("[^0-9]", "", s))
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= count(m.group()) <= 19 and luhn(re.sub("[^0-9]", "", m.group()))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= count(m.group()) <= 15],
    }


def test_base_spans_of_random_texts():
    rng = random.Random(3)
    parts = [*"ab1289.@+-% ()é", "255", "@x.y", "4111111111111111", "1.2.3.4", " at ", " dot ", "(at)", "five ", "٣", "а"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        base, every = find(text)
        assert base == plain(text) == base_spans(text)
        assert all(set(base[k]) <= set(every[k]) and len(set(every[k])) == len(every[k]) for k in KINDS)


DISGUISED = [
    ("email", "write to ", "john.doe (at) mail7 (dot) example (dot) com", " now"), ("email", "", "john [at] mail.example.com", "."), ("email", "x: ", "john at mail7 dot example dot com", "!"), ("email", "", "jоhn@exаmple.com", ""),
    ("email", "", "john＠mail．example．com", ""), ("email", "é ", "jo​hn@mail.example.com", ""), ("email", "", "john @ mail.example.com", ""), ("phone", "call ", "+１ (７３６) ５５５-２６７８", " or"), ("phone", "", "plus one five five five one two three four five six seven", ""),
    ("phone", "", "+1 (five five five) 555-2678", ""), ("card", "", "four one one one one one one one one one one one one one one one", ""), ("card", "ñ ", "５５５５ 5555 5555 4444", ""), ("ip", "", "192[.]168[.]1[.]1", ""), ("ip", "", "one nine two dot one six eight dot one dot one", ""), ("card", "", "4111​1111​1111​1111", ""),
    ("card", "", "4lll 1111 1111 I11l", "."), ("phone", "", "+1 (O17) 555-77l3", ""), ("email", "", "john&#64;example.com", ""), ("email", "", "a.b%40example&period;org", ""), ("email", "", "juan arroba correo punto es", " y"), ("email", "", "john@example . com", ""),
]


@pytest.mark.parametrize("kind, before, what, after", DISGUISED)
def test_disguises_map_back(kind, before, what, after):
    every = find(before + what + after)[1]
    assert (len(before), len(before) + len(what)) in every[kind]
    assert masked(before + what + after) == f"{before}<{kind.upper()}>{after}"


@pytest.mark.parametrize("text", ["", "meet me at noon dot", "the dot at the end", "one two three", "dos 9807915762804490 x", "point at it. com", "vier fünf sechs", "at dot at dot", "почта и текст", "a@b", "1.2.3", "+1 2", "up to 256.1.1.1", "10 l of oil", "Il y a 10 ans", "100% 40 &#65;", "look at this point now", "look at a dot", "2 dot 3 dot 4", "0 dot 300 dot 1 dot 1"])
def test_clean_texts_stay(text):
    base, every = find(text)
    assert base == every == plain(text)


UNGATED = [
    ("email", "write to ", "jane at example.com", " today"), ("email", "", "juan arroba correo.es", ""), ("card", "", "4111\u00a01111\u00a01111\u00a01111", "."), ("phone", "", "+1\u00a0(736)\u00a0555\u00a02678", ""), ("phone", "", "+1 736 555 26²³", ""),
    ("ip", "", "five dot five dot five dot five", ""), ("email", "", "joªn@example.com", ""), ("email", "", "john@maıl.com", ""),
    ("ip", "ping ", "192 dot 168 dot 0 dot 1", " now"), ("ip", "", "10 point 0.0 point 7", ""), ("email", "so ", "a dot b dot c dot d dot e dot f at mail dot example dot com", ""), ("email", "", "jean arobase exemple point fr", "."), ("ip", "", "1\u20242\u20243\u20244", ""), ("phone", "", "plus fİve five five five five five five five", ""), ]


@pytest.mark.parametrize("kind, before, what, after", UNGATED)
def test_disguises_in_otherwise_plain_texts(kind, before, what, after):
    assert (len(before), len(before) + len(what)) in find(before + what + after)[1][kind]


@pytest.mark.parametrize("text", ["look at example.com", "visit us at www.example.com now", "it opened at 9.30 today", "stay at home.Then go", "look at example.com — now"])
def test_at_in_sentences_is_no_address(text):
    assert find(text)[1]["email"] == []


TEN = {
    "en": "zero one two three four five six seven eight nine", "de": "null eins zwei drei vier fünf sechs sieben acht neun", "fr": "zéro un deux trois quatre cinq six sept huit neuf", "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}


@pytest.mark.parametrize("language", TEN)
def test_all_ten_digits_spelled(language):
    spell = lambda digits: " ".join(TEN[language].split()[int(c)] for c in digits)
    point = {"en": "dot", "de": "punkt", "fr": "point", "es": "punto"}[language]
    card = next(c for x in range(10) if luhn(c := f"987654321098765{x}"))
    for kind, what in (("phone", "plus " + spell("1234567890")), ("card", spell(card)), ("ip", f" {point} ".join(map(spell, ("10", "234", "56", "178"))))):
        assert (2, 2 + len(what)) in find(f": {what}.")[1][kind]
        assert (2, 2 + len(what)) in find(f": {what.upper()}.")[1][kind]


def test_other_forms_of_digits_and_of_null():
    for what in ("plus vier neun eins sieben zwo zwo null acht null", "plus trois trois une un une deux une cinq"):
        assert masked(f"ruf {what} an") == "ruf <PHONE> an"
    for text in ("[" + ", ".join(["null"] * 16) + "]", "null null null null punkt null", "un jour, une nuit, un an", "(null, null, 4111, null, null, 1111)"):
        assert masked(text) == text


def test_what_steps_need_decides_nothing(monkeypatch):
    rng = random.Random(8)
    signs = [*"ab1289.@+-% ()[]{}<>éOoIl,&\n", "\u00a0", "²", "ª", "…", "İ", "–", "·", "\u00ad", "а", "٣", "１", " at ", " AT ", " arroba ", " dot ", " punkt ", " . ", "(at)", "[dot]", "plus ", "Plus-", "&#64;", "%40", "&period;", "jane", "example.com", "555", "4111 1111", "five ", "Six-", "vier, ", "cinq dot ", "uno ", "zéro", "ZÉRO "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 24))) for _ in range(30000)]
    gated = [find(t) for t in texts]
    monkeypatch.setattr(personal, "_STEPS", [(lambda t: True, step) for _, step in personal._STEPS])
    assert gated == [find(t) for t in texts]
    assert sum(every != base for base, every in gated) > 100


def test_written_characters_know_their_source():
    text = "ａ​b (at) c [dot] d five five five five"
    out = normalised(text)
    assert len(out.text) == len(out.begins) == len(out.ends) and all(a < b for a, b in zip(out.begins, out.ends, strict=True))
    assert out.begins.tolist() == sorted(out.begins.tolist())


def test_detect_and_mask(spark):
    rows = corpus() + [(None, "a@b.cd", "en", "s"), (90, "x 1.2.3.4 y@z.org é y@z.org +1 (017) 555-7713", "en", "s")]
    found = {r["doc_id"]: r for r in detect(frame(spark, rows, clashing=True)).collect()}
    r = found[90]
    listed = "email:10:17,email:20:27,ip:2:9,phone:28:45"
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["spans"]) == (2, 1, 0, 1, listed) and r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert found[60]["spans"] == "" and found[60]["base_sha256"] == hashlib.sha256(b"").hexdigest() and found[None]["n_email"] == 1
    docs = frame(spark, rows, clashing=True)
    changed = mask(docs)
    assert changed.schema == docs.schema and changed.count() == len(rows)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in changed.collect()}[90] == ("x <IP> <EMAIL> é <EMAIL> <PHONE>", 32)
    assert detect(frame(spark, [])).collect() == [] and mask(frame(spark, [])).collect() == []


LONG = {
    "1.": "1" * 10**6 + ".", "@": "@" * 10**6, "a@": "a@" * 500_000, "labels": ("a@" + "b-" * 5) * 80_000, "a.": "a." * 500_000 + "@", "dots": "a dot " * 160_000 + "at b dot c", "ones": "1 " * 500_000 + "one two three",
    "words": "five " * 200_000, "points": "five dot " * 110_000, "signs": "x @ " * 250_000, "brackets": "( . " * 250_000, "spaces": " " * 10**6 + "(at)", "zeros": "1." + "0" * 10**6 + ".1.1", "numbers": "1 dot " * 160_000, "hidden": "a\u200b" * 500_000, "found": "a.b@c.de " * 110_000 + "(at)",
}


@pytest.mark.parametrize("name", LONG)
def test_very_long_texts_take_time_in_proportion(name):
    text, began = LONG[name], time.process_time()
    base, every = find(text)
    assert time.process_time() - began < 8  # about 1.5 s; a scan that grows with the square takes hours
    assert all(set(base[k]) <= set(every[k]) for k in KINDS)
