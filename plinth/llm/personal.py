"""Personal data, found also where it is disguised, with spans in the source's characters.

Base identifiers are plain patterns over the text.  For disguised ones a chain of
transducers rewrites the text and keeps, for every character written, the span of
source characters that it came from:

1. characters: compatibility forms, decimal digits of any script and look-alike
   letters become ASCII, invisible characters go;
2. words: runs of spelled digits become digits, "plus" before a digit becomes +;
3. signs: "(at)", "[dot]" and the like become @ and ., and the bare words do if a
   whole address or four numbers are joined by them.

The same patterns run over what is written, and a match is mapped back through the
spans.  Each step names something that a text must have for the step to change it; a
text with none of these skips all of this.

Every scan takes time in proportion to the text, whatever the text is: patterns begin
only where their first run begins, repeat without giving back, or are tried only at
the signs that they need.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plinth.llm.arrays import slices

KINDS = ("email", "ip", "card", "phone")
_PATTERNS = {
    # A number is tried from its first digit only: from a later one the rest would be the same.
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: What follows a mailbox; the mailbox itself is read backwards from the sign.
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: What a text must have for a pattern to be worth running.
_NEEDS = {"ip": ".", "card": "", "phone": "+"}
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")

#: Letters of other scripts that look like ASCII ones (fixed values, Unicode's confusables).
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "ϲ": "c", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "İ": "I", "ɑ": "a", "ɡ": "g", "ɩ": "i", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "·": ".",
}
#: Characters without any width of their own.
INVISIBLE = "­͏᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
#: Spelled digits in the corpus's languages (fixed values).
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Spelled digits that a run needs; fewer are words of a sentence beside a number.
SPELLED = 3
#: Also the word for no value in data and code: it counts as a digit beside others, but not towards SPELLED.
NO_VALUE = "null"
#: Real digits that a run needs before its letters count as digits.
DIGITS = 6
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: Words and digits in turn, joined by a space, a hyphen, a comma or the word for a full stop.
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORD}|[0-9])(?:(?:[ ,()-]{{1,3}}|\ ?(?:\.|\(?\b(?:dot|point|punkt|punto)\b\)?)\ ?)?(?:(?<!\w)(?:{_WORD})(?!\w)|[0-9])){{3,}}(?!\w)", re.I)
_ONE = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)", re.I)
_STOP = re.compile(r" ?\(?\b(?:dot|point|punkt|punto)\b\)? ?|[ ,()-]{1,3}(?=[0-9])", re.I)
_PLUS = re.compile(r"(?<!\w)plus[ -]?(?=[0-9(])", re.I)
_AT = re.compile(r"\s{0,2}(?:[\[({<]\s?(?:at|@|arroba|arobase)\s?[\])}>]|(?<=\s)@|@(?=\s))\s{0,2}", re.I)
_DOT = re.compile(r"\s{0,2}[\[({<]\s?(?:dot|\.|punkt|point|punto)\s?[\])}>]\s{0,2}", re.I)
#: Words for a full stop between words; the French one is too common to count beside "at".
_POINT, _ANY_POINT, _LABEL = r"\s(?:dot|punto|punkt|\.)\s", r"\s(?:dot|punto|punkt|point|\.)\s", "[A-Za-z0-9-]++"
#: An address in bare words from its sign on: at host dot domain (dot domain).
_BARE_HOST = re.compile(rf"(?:\s(?:at|arroba)\s{_LABEL}(?:(?:{_POINT}|\.){_LABEL})+|(?:\sarobase\s|@){_LABEL}(?:(?:{_ANY_POINT}|\.){_LABEL})+)(?![\w-])", re.I)
#: A spelled full stop that ends where a run of a mailbox's name begins.
_BEFORE_RUN = re.compile(r"\s(?:dot|punto|punkt)\s\Z", re.I)
_BARE_SIGN = re.compile(r"\s(at|arroba|arobase|dot|punto|punkt|point|\.)\s", re.I)
#: Four numbers joined by spelled or spaced full stops.
_BARE_IP = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:(?:{_ANY_POINT}|\.)[0-9]{{1,3}}){{3}}(?!\w|\.[0-9])", re.I)
#: Signs as markup writes them.
_SIGNS = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "%40": "@", "&#46;": ".", "&#x2e;": ".", "&period;": "."}
_MARKUP = re.compile(r"&(?:#64|#x40|commat);|%40|&(?:#46|#x2e|period);", re.I)
#: Letters among digits that stand for digits, in runs with digits enough.
_MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl](?:[ ().-]{0,2}[0-9OoIl]){7,}(?![A-Za-z0-9])")
_LETTER_DIGITS = str.maketrans("OoIl", "0011")
#: A spelled digit's end; searched for in lower case, where no look-alikes are left.
_SOME = re.compile(rf"(?:{_WORD})\b")
#: Words before "at" that name no mailbox, as in "look at example.com".
BEFORE_AT = frozenset(
    "a also an and are arrive arrived at available be been buy come directly do down find for found free get go good had has have he help her here him home hosted in is it just learn listed "
    "located look looked looking looks me meet met more not now of on one only or over page posted published read see seen sent she stay staying that the them there these they this those us view "
    "visit was watch we were worked working works write you".split()
)

Span = tuple[int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _sound(kind: str, found: str) -> bool:
    """What has to hold of a match besides its pattern."""
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in found.split(".")))
    digits = _NOT_DIGIT.sub("", found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return 8 <= len(digits) <= 15


def _run_start(text: str, low: int, stop: int) -> int:
    """Where the characters of a mailbox's name begin that end at `stop`, at `low` at the earliest."""
    at = stop
    while at > low and text[at - 1].isascii() and (text[at - 1].isalnum() or text[at - 1] in "._%+-"):
        at -= 1
    return at


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each kind that are sound; a match that isn't is dropped without a retry."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    done = 0
    for m in _HOST.finditer(text):
        start = _run_start(text, done, m.start())
        if start < m.start():
            out["email"].append((start, m.end()))
            done = m.end()
    if _DIGIT.search(text):
        for kind, pattern in _PATTERNS.items():
            if _NEEDS[kind] in text:
                out[kind] = [m.span() for m in pattern.finditer(text) if _sound(kind, m.group())]
    return out


class Written:
    """A rewritten text with the source span of each character."""

    def __init__(self, text: str, begins: np.ndarray | None = None, ends: np.ndarray | None = None):
        # Arrow's strings are shorter than 2 GB.
        self.text, self.begins = text, np.arange(len(text), dtype=np.int32) if begins is None else begins
        self.ends = self.begins + np.int32(1) if ends is None else ends

    def rewrite(self, pattern: re.Pattern, by: Callable[[re.Match], str]) -> None:
        """Replaces matches; each character written for one stands for all of its source."""
        parts, begins, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            new = by(m)
            if new == m.group() and b - a <= 1:
                continue
            parts += [self.text[at:a], new]
            begins.append(self.begins[at:a])
            ends.append(self.ends[at:a])
            if b > a and new:
                begins.append(np.full(len(new), self.begins[a]))
                ends.append(np.full(len(new), self.ends[b - 1]))
            at = b
        if parts:
            self.text = "".join(parts) + self.text[at:]
            self.begins, self.ends = np.concatenate([*begins, self.begins[at:]]), np.concatenate([*ends, self.ends[at:]])

    def inside(self, spans: Iterable[Span], change: Callable[[Written], None]) -> None:
        """Lets `change` rewrite each span on its own; spans come in order."""
        parts: list[Written] = []
        at = 0
        for a, b in spans:
            parts += [self.part(at, a), inner := self.part(a, b)]
            change(inner)
            at = b
        if parts:
            parts.append(self.part(at, len(self.text)))
            self.text = "".join(p.text for p in parts)
            self.begins, self.ends = np.concatenate([p.begins for p in parts]), np.concatenate([p.ends for p in parts])

    def part(self, start: int, stop: int) -> Written:
        return Written(self.text[start:stop], self.begins[start:stop], self.ends[start:stop])


_KNOWN: dict[str, str] = {}


def _plain(c: str) -> str:
    """The ASCII that a character stands for, or itself; invisible characters stand for nothing."""
    if c not in _KNOWN:
        new = c
        if c in INVISIBLE:
            new = ""
        elif c in LOOKALIKES:
            new = LOOKALIKES[c]
        elif c.isdecimal():
            new = str(unicodedata.decimal(c))
        elif (form := unicodedata.normalize("NFKC", c)) != c and form.isascii():
            new = form
        _KNOWN[c] = new
    return _KNOWN[c]


_OTHER = re.compile(r"[^\x00-\x7f]")


def _spell(run: Written) -> None:
    if sum(w.lower() != NO_VALUE for w in _ONE.findall(run.text)) < SPELLED:
        return
    run.rewrite(_ONE, lambda m: DIGIT_WORDS[m.group().lower()])
    run.rewrite(_STOP, lambda m: "" if m.group().strip(" ,()-") == "" else ".")


def _digits(run: Written) -> None:
    if len(_DIGIT.findall(run.text)) >= DIGITS:
        run.text = run.text.translate(_LETTER_DIGITS)


def _prose(text: str) -> bool:
    """Whether a match of _BARE whose only disguise is "at" reads as a sentence: "look at example.com", "opened at 9.30", "stay at home.Then"."""
    name, _, host = re.split(r"\s(at)\s", text, maxsplit=1, flags=re.I) if len(_BARE_SIGN.findall(text)) == 1 and re.search(r"\sat\s", text, re.I) else ("", "", "")
    last = host.rpartition(".")[2]
    return bool(host) and (name.lower() in BEFORE_AT or not last.isalpha() or host[0].islower() and last[0].isupper() and not last.isupper())


def _name_start(text: str, low: int, stop: int) -> int:
    """Where a mailbox's name begins that ends at `stop`, runs joined by any number of spelled full stops; `stop` if there is none."""
    best = at = stop
    while (start := _run_start(text, low, at)) < at:
        if start == 0 or not (text[start - 1].isalnum() or text[start - 1] == "_"):
            best = start
        before = _BEFORE_RUN.search(text, max(low, start - 8), start)
        if before is None:
            break
        at = before.start()
    return best


def _addresses(text: str) -> Iterator[Span]:
    """Spans of whole addresses whose signs may be bare words."""
    done = 0
    for m in _BARE_HOST.finditer(text):
        start = _name_start(text, done, m.start())
        if start < m.start():
            yield start, m.end()
            done = m.end()


def _bare(run: Written) -> None:
    if not _prose(run.text):
        run.rewrite(_BARE_SIGN, lambda m: "@" if m.group(1).lower() in ("at", "arroba", "arobase") else ".")


def _points(run: Written) -> None:
    run.rewrite(_BARE_SIGN, lambda m: ".")


def _spans(pattern: re.Pattern, text: str) -> Iterator[Span]:
    return (m.span() for m in pattern.finditer(text))


def _bracket(text: str) -> bool:
    return "(" in text or "[" in text or "{" in text or "<" in text


#: The steps in turn, each after what a text must have for it to change anything.
_STEPS: list[tuple[Callable[[str], object], Callable[[Written], None]]] = [
    (lambda t: not t.isascii() and any(_plain(c) != c for c in set(t) if c > "\x7f"), lambda out: out.rewrite(_OTHER, lambda m: _plain(m.group()))),
    (lambda t: "&" in t or "%40" in t, lambda out: out.rewrite(_MARKUP, lambda m: _SIGNS[m.group().lower()])),
    (lambda t: sum(map(t.count, "0123456789")) >= DIGITS, lambda out: out.inside(_spans(_MIXED, out.text), _digits)),
    (lambda t: len(_SOME.findall(t.lower())) >= SPELLED, lambda out: out.inside(_spans(_SPELLED, out.text), _spell)),
    (lambda t: "plus" in t.lower(), lambda out: out.rewrite(_PLUS, lambda m: "+")),
    (lambda t: "@" in t or _bracket(t), lambda out: out.rewrite(_AT, lambda m: "@")),
    (_bracket, lambda out: out.rewrite(_DOT, lambda m: ".")),
    (lambda t: _BARE_SIGN.search(t) and _DIGIT.search(t), lambda out: out.inside(_spans(_BARE_IP, out.text), _points)),
    (_BARE_SIGN.search, lambda out: out.inside(_addresses(out.text), _bare)),
]


def normalised(text: str) -> Written:
    out = Written(text)
    for needs, step in _STEPS:
        if needs(out.text):
            step(out)
    return out


def disguised_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans in the source of identifiers that only show after rewriting.

    One that overlaps base spans of its kind counts only if it is wider than each of them.
    """
    none: dict[str, list[Span]] = {k: [] for k in KINDS}
    # Where no step changes the source, none sees anything else.
    if not any(needs(text) for needs, _ in _STEPS):
        return none
    written = normalised(text)
    if written.text == text:
        return none
    for kind, found in base_spans(written.text).items():
        taken = base[kind]
        stops = [b for _, b in taken]
        for a, b in found:
            start, stop = int(written.begins[a]), int(written.ends[b - 1])
            # Unchanged text has no disguise: the base patterns have judged it.
            if text[start:stop] == written.text[a:b]:
                continue
            # Base spans don't overlap, so those that meet this one are neighbours.
            i, wider = bisect.bisect_right(stops, start), True
            while i < len(taken) and taken[i][0] < stop:
                wider &= start <= taken[i][0] and taken[i][1] <= stop and taken[i] != (start, stop)
                i += 1
            if wider:
                none[kind].append((start, stop))
    return none


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and all spans, by kind and start."""
    base = base_spans(text or "")
    more = disguised_spans(text or "", base)
    return base, {k: sorted(base[k] + more[k]) for k in KINDS}


def _listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_disguised.

    spans: "kind:start:end" of all spans by kind and start, code points of the
    source, end exclusive.  A null text is empty.  Rows are judged alone, so ties,
    repeated rows and null doc_ids are rows like others; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    base, every = find(text)
                    rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every), sum(len(every[k]) - len(base[k]) for k in KINDS)))
                columns = [pa.array(c, pa.string() if i in (4, 5) else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")


def masked(text: str | None) -> str | None:
    """The text with every span, overlapping ones together, replaced by <KIND> (null: null)."""
    if not text:
        return text
    spans = sorted((a, b, k) for k, found in find(text)[1].items() for a, b in found)
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def mask(docs: DataFrame) -> DataFrame:
    """docs, all columns, with `text` masked; a column n_chars holds the new length where docs have one."""
    names, schema = docs.columns, docs.schema

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [masked(t) for t in part.column("text").to_pylist()]
                new = {"text": pa.array(texts, part.schema.field("text").type)}
                if "n_chars" in names:
                    new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in names], names=names)

    return docs.mapInArrow(change, schema)
