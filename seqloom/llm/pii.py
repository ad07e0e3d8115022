"""Personal data in plain and disguised form, with offsets into the source text.

Plain forms are found by fixed patterns (leftmost, non-overlapping, failing matches dropped).
For disguised forms a chain of transducers, each one pass from left to right, rewrites the text and
keeps, for every character written, the source characters it stands for:

1. characters: what Unicode's compatibility and canonical forms, letter names and categories make of a character
   (full width, mathematical, circled, accented, foreign digits, spaces, dashes), and look-alikes of other
   scripts become ASCII; invisible characters vanish;
2. spelled digits become digits, three in a row or as parts of a number that with its numerals has the
   digits of a phone or card;
3. bracketed at and dot signs become ``@`` and ``.``;
4. spoken ones do in chains of words joined by *dot* and *at*: from the last at sign of a chain to the first, one with a
   domain after it and a local part before it becomes an address.

The patterns run again on the rewritten text, and matches that touch a rewritten place are mapped back and
merged with the plain ones.  All scans are linear in the text.

Defined cases: a null text is empty; null and repeated ids give one row each; plain spans always
stay, and a disguised span is added unless a plain one of its kind holds it (one that reaches further, as
where an invisible character cuts an address, stands beside the plain one); ``find`` ignores other
columns, ``redact`` passes them through.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.session import ship

KINDS = ("email", "ip", "card", "phone")

# The character classes of the base patterns.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Letters and signs of other scripts that look like ASCII ones (Cyrillic, Greek, Armenian, signs).
LOOK_ALIKE = dict(
    zip(
        "АВЕКМНОРСТУХаеорсухіјѕԁһԛԝѵүкгЅІЈԚԜҮӏӀ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρικτυγηε" + "օոսհցյզՏԼՍՕ" + "。∙·•",
        "ABEKMHOPCTYXaeopcyxijsdhqwvykrSIJQWYlI" + "ABEZHIKMNOPTYXaovpiktuyne" + "onuhgjqSLUO" + "....",
        strict=True,
    )
)
INVISIBLE = re.compile("[\u00ad\u0300-\u036f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
SIGNS = "@.+-_%()"
LETTER_NAME = re.compile(r"LATIN (?:(SMALL|CAPITAL) LETTER (?:DOTLESS |SCRIPT )?|LETTER (SMALL) CAPITAL )([A-Z])(?: WITH .+)?")


def plain_character(c: str) -> str:
    """The ASCII character that ``c`` can be read as, or ``c``."""
    if c in LOOK_ALIKE:
        return LOOK_ALIKE[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    kind = unicodedata.category(c)
    if kind in ("Zs", "Pd"):
        return " " if kind == "Zs" else "-"
    if unicodedata.decomposition(c).startswith(("<super>", "<sub>", "<fraction>")):
        return c
    one = unicodedata.normalize("NFKC", c)
    if len(one) == 1 and one.isascii() and (one.isalnum() or one in SIGNS):
        return one
    base, *marks = unicodedata.normalize("NFKD", c)
    if marks and base.isascii() and base.isalpha() and all(map(unicodedata.combining, marks)):
        return base
    m = LETTER_NAME.fullmatch(unicodedata.name(c, ""))
    return c if m is None else m[3] if m[1] == "CAPITAL" else m[3].lower()


class Characters(dict):
    """The character transducer, for ``str.translate``: code points, looked up when first met."""

    def __missing__(self, code: int) -> int:
        put = self[code] = ord(plain_character(chr(code))) if code > 127 else code
        return put


CHARACTERS = Characters()

# Digits in words, in four languages.
SPELLED = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, word in enumerate(words.split())
    for w in {word, word.translate(CHARACTERS)}
}
#: So many spelled digits in a row are taken as a number.
SPELLED_RUN = 3

_word = "|".join(sorted(map(re.escape, SPELLED), key=len, reverse=True))
SPELLED_NUMBER = re.compile(rf"(?<!\w)(?:plus[ -])?(?:{_word})(?:[ -](?:{_word})){{{SPELLED_RUN - 1},}}(?!\w)", re.I)
SPELLED_ONE = re.compile(rf"(?<!\w)(?:{_word}|plus)(?!\w)", re.I)
_part = rf"(?:{_word}|[0-9]{{1,3}})(?:[ -](?:{_word})){{0,2}}"
SPELLED_QUAD = re.compile(rf"(?<!\w)(?:{_part} dot ){{3}}{_part}(?!\w)", re.I)
#: Parts of a number in words and numerals, what may lie between two of them, and the fewest digits of a card or phone.
NUMBER_PART = re.compile(rf"(?<!\w)(?:{_word}|plus)(?!\w)|(?<!\w)\+?[0-9]++(?!\w)", re.I)
BESIDE_WORD = re.compile(r"[\s,()-]{1,6}")
BETWEEN = re.compile(r"[,()-]")
BESIDE_NUMERAL = re.compile(r"[\x20().-]{1,3}")
LEAST_DIGITS = 10
BRACKETED = re.compile(r"\s?[\[({<]\s?(at|arroba|@|dot|punkt|point|punto|\.)\s?[\])}>]\s?", re.I)
#: Words joined by spoken or written signs, and the signs.
CHAIN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?: dot | at |@)[A-Za-z0-9._%+-]++)++", re.I)
JOINT = re.compile(r" dot | at |@", re.I)
LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
LABEL = re.compile(r"[A-Za-z0-9-]+")
#: A spoken at before a plain domain counts if the local part is like no word: a dot, digit or underscore, and not a year or time.
AT_DOMAIN = re.compile(r" at [a-z0-9-]+\.[a-z0-9]", re.I)
PLAIN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
ODD_LOCAL = re.compile(r"(?=.*[A-Za-z]).*(?:[0-9_]|\.[A-Za-z])|[0-9]{5,}\Z|.* dot ", re.S | re.I)
DOTTED_DIGITS = re.compile(r"(?<=[0-9]) dot (?=[0-9])", re.I)
#: Any of these in the lower-cased text asks for a look at disguised signs.
SIGN_HINTS = tuple(b + s for b in "[({<" for s in ("at", "arroba", "@", "dot", "punkt", "point", "punto", ".", " at", " dot"))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def find_plain(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base matches, in order."""
    found = []
    last, at = 0, text.find("@")
    while at >= 0:
        head = text[last:at]
        start = last + len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, 0, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    if DIGIT.search(text):
        if text.count(".") >= 3:
            for m in IP.finditer(text):
                if "." in (g := m.group()) and all(len(p) < 3 or len(p) == 3 and p <= "255" for p in (x.lstrip("0") for x in g.split("."))):
                    found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start():
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


class Tape:
    """A text under rewriting, as long as its source at first; each character knows its source span."""

    def __init__(self, text: str, source: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.new = bytearray(len(text)) if text == source else bytearray(map(str.__ne__, text, source))

    def rewrite(self, edits: Iterator[tuple[int, int, str]]) -> None:
        """Replaces each ``text[a:b]`` by a string of at most one character; ordered, disjoint.

        What follows a removed character counts as rewritten.
        """
        text, start, end, new, last = [], [], [], bytearray(), 0
        for a, b, put in edits:
            text += [self.text[last:a], put]
            start += self.start[last:a]
            end += self.end[last:a]
            new += self.new[last:a]
            if put:
                start.append(self.start[a])
                end.append(self.end[b - 1])
                new.append(1)
            elif b < len(self.new):
                self.new[b] = 1
            last = b
        if last:
            self.text = "".join([*text, self.text[last:]])
            self.start, self.end, self.new = start + self.start[last:], end + self.end[last:], new + self.new[last:]


def _invisible(text: str) -> Iterator[tuple[int, int, str]]:
    for m in INVISIBLE.finditer(text):
        yield m.start(), m.end(), ""


def _numbers(text: str) -> Iterator[tuple[int, int, list[re.Match]]]:
    """Runs of spelled digits and numerals with the digits of a card or phone; ``start, end, parts``."""
    run: list[re.Match] = []
    for m in [*NUMBER_PART.finditer(text), None]:
        if run and m and m.group().lower() != "plus" and m.group()[0] != "+":
            words = not run[-1].group()[-1].isdigit() or not m.group().isdigit()
            if (BESIDE_WORD if words else BESIDE_NUMERAL).fullmatch(text, run[-1].end(), m.start()):
                run.append(m)
                continue
        spelled = [x for x in run if x.group().lower() in SPELLED]
        if spelled and len(spelled) + sum(c.isdigit() for x in run for c in x.group()) >= LEAST_DIGITS:
            # A number that is whole in numerals is no longer for a word beside it.
            a, b = run[0].start(), run[-1].end()
            if len(spelled) == len(run) or not any(k > 1 for _, k, _ in find_plain(text[a:b])):
                yield a, b, run
        run = [m] if m else []


def _digits(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits of numbers by their digits, and of runs and quads of spelled digits."""
    edits, taken = [], []
    for a, b, parts in _numbers(text):
        taken.append((a, b))
        for x, y in zip(parts, [*parts[1:], None], strict=True):
            if not x.group()[-1].isdigit():
                edits.append((x.start(), x.end(), SPELLED.get(x.group().lower(), "+")))
            if y and not (x.group()[-1].isdigit() and y.group().isdigit()):
                edits.append((x.end(), y.start(), ""))
    last = at = 0
    for a, b, put in _runs(text):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at == len(taken) or b <= taken[at][0]:
            edits.append((a, b, put))
    for a, b, put in sorted(edits):
        if a >= last:
            yield a, b, put
            last = b


def _runs(text: str) -> Iterator[tuple[int, int, str]]:
    runs = sorted({(m.start(), m.end()) for p in (SPELLED_NUMBER, SPELLED_QUAD) for m in p.finditer(text)})
    last = 0
    for a, b in runs:
        a = max(a, last)
        for m in SPELLED_ONE.finditer(text, a, b):
            put = SPELLED.get(m.group().lower(), "+")
            stop = m.end()
            if stop < b and text[stop] in " -" and (n := SPELLED_ONE.match(text, stop + 1, b)) and n:
                stop += 1
            yield m.start(), stop, put
        last = max(last, b)


def _signs(text: str) -> Iterator[tuple[int, int, str]]:
    for m in BRACKETED.finditer(text):
        yield m.start(), m.end(), "@" if m.group(1).lower() in ("at", "arroba", "@") else "."


def _addresses(text: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
    """Edits of the spoken signs of addresses in a chain; from the last at sign to the first, words belong to one address only."""
    joints = list(JOINT.finditer(text, a, b))
    starts, ends = [a, *(m.end() for m in joints)], [*(m.start() for m in joints), b]
    spoken = [len(m.group()) == 5 for m in joints]  # a dot
    limit = len(starts)
    for j in range(len(joints) - 1, -1, -1):
        if spoken[j]:
            continue
        # The domain: labels in words after the sign, up to the next at sign or address.
        last, stop = j, starts[j + 1]
        while last + 1 < limit and (last == j or spoken[last]) and (m := LABELS.match(text, starts[last + 1], ends[last + 1])):
            last, stop = last + 1, m.end()
            if stop < ends[last]:
                break
        first = j
        while first and spoken[first - 1] and LABEL.fullmatch(text, starts[first], ends[first]):
            first -= 1
        if last == j:
            pass
        elif joints[j].group() == "@":
            accepted = (last > j + 1 or first < j) and (last > j + 1 or "." in text[starts[j + 1] : stop])
        elif last > j + 1:
            accepted = True
        else:
            accepted = PLAIN_DOMAIN.fullmatch(text, starts[j + 1], stop) and ODD_LOCAL.match(text[starts[first] : ends[j]])
        if last > j and accepted:
            yield joints[j].start(), joints[j].end(), "@"
            for m in joints[first:last]:
                if len(m.group()) == 5:
                    yield m.start(), m.end(), "."
            limit = first
        else:
            limit = min(limit, j + 1)


def _spoken_signs(text: str) -> Iterator[tuple[int, int, str]]:
    edits = {(m.start(), m.end(), ".") for m in DOTTED_DIGITS.finditer(text)}
    for m in CHAIN.finditer(text):
        edits.update(_addresses(text, m.start(), m.end()))
    last = 0
    for a, b, put in sorted(edits):
        if a >= last:
            yield a, b, put
            last = b


def find_disguised(text: str) -> list[tuple[int, int, int]]:
    """Matches on the rewritten text that touch a rewritten place, in source offsets."""
    ascii_only = text.isascii()
    plain = text if ascii_only else text.translate(CHARACTERS)
    low = plain.lower()
    invisible = not ascii_only and INVISIBLE.search(plain)
    signs = any(h in low for h in SIGN_HINTS) if any(b in low for b in "[({<") else False
    spoken = " dot " in low or (" at " in low and AT_DOMAIN.search(low) is not None)
    spelled = not SPELLED.keys().isdisjoint(BETWEEN.sub(" ", low).split())
    if not (invisible or signs or spoken or spelled):
        return [] if plain == text else [(a, k, b) for a, k, b in find_plain(plain) if plain[a:b] != text[a:b]]
    tape = Tape(plain, text)
    if invisible:
        tape.rewrite(_invisible(tape.text))
    tape.rewrite(_digits(tape.text))
    tape.rewrite(_signs(tape.text))
    tape.rewrite(_spoken_signs(tape.text))
    if 1 not in tape.new:
        return []
    return [(tape.start[a], k, tape.end[b - 1]) for a, k, b in find_plain(tape.text) if 1 in tape.new[a:b]]


def find_all(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and those with the disguised ones added."""
    base, extra = find_plain(text), find_disguised(text)
    if not extra:
        return base, base
    # Spans of one kind don't overlap, so only the last that starts before can hold another.
    own: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    for a, k, b in base:
        own[k].append((a, b))

    def held(a: int, k: int, b: int) -> bool:
        at = bisect_right(own[k], a, key=lambda s: s[0])
        return at > 0 and b <= own[k][at - 1][1]

    extra = [x for x in extra if not held(*x)]
    return base, sorted([*base, *extra]) if extra else base


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def _structs(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans``: arrays of ``struct<kind, start, end>`` in code points."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1):
                a, b = find_all(text.as_py() or "")
                base.append(_structs(a))
                spans.append(_structs(b))
            columns = [batch.column(0), pa.array(base, pa.list_(SPAN)), pa.array(spans, pa.list_(SPAN))]
            yield pa.record_batch(columns, names=["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {SPANS}, spans {SPANS}")


def redact_text(text: str) -> str:
    """``text`` with each span replaced by its kind, as in ``<EMAIL>``; overlapping spans as one."""
    out, last = [], 0
    for a, k, b in find_all(text)[1]:
        if a >= last:
            out += [text[last:a], f"<{KINDS[k].upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]]) if last else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null texts stay null."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redact_text(t) for t in (x.as_py() for x in batch.column(at))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digests(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans")
    )
