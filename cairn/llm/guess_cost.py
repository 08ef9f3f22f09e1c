"""Secret scans: fixed patterns, and password guess-cost dynamic programming on values in credential contexts.

Base spans.  Three kinds of matches, leftmost and non-overlapping within a kind: ``assign``, ``access``, ``hex``.

Method.  A value that stands after a credential word (or before the ``@`` of a url) is cut into words, dates, repeats, keyboard walks and
brute-force spans, each with the logarithm of the guesses it takes; the cheapest segmentation is found from left to right over
the value's positions.  A value whose cheapest segmentation still takes ``LIMIT`` decades of guesses is a secret, and
where it overlaps no base span it is added as kind ``guess``.  After a credential word stand a colon, an equals sign or an arrow, or the word "is"; what follows
"is" and looks like a word of prose (letters only, no inner capitals), or like a name made of such words, is no secret.

Whole values of other kinds.  A media type and a time stamp are no secrets, and neither is one word of prose with letters beyond ASCII.  A url without user and password, and a path, are judged by
their parts between marks: each that is no word of prose must stay below the limit by itself, so a key in a url is found.

Vocabulary.  Words of all documents, and of all languages, are ranked by the number of documents that hold them; a word takes the guesses of its rank.
Values that stand after a credential word are left out of the count, and a word counts from two documents on, so a secret does not
make itself a word.  At most ``VOCABULARY`` words are broadcast; rarer ones are brute force.  A run of letters of a script written without
spaces is prose and takes as much as a rare word.

Each document is one row; only words and their counts are shuffled.  A text is searched by patterns only where it holds their fixed parts.

Defined results: null text counts as empty; a text without spans gives zeros and the digest of the empty string; repeated
rows come back once each; a very long text is searched whole, in time that grows with its length; null ids pass through; ids are of any type; an empty table gives an empty
result; other columns are not read, except that ``redact`` passes them on.  Positions are code points.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log10
from unicodedata import category

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, written
from .textblock import slices

LIMIT = 10.0
VOCABULARY = 100_000
KINDS = ("assign", "access", "hex", "guess")
LOW, LOW_HEX, LOW_ACCESS = 6, 24, 20
_A = re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | _A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", _A)
HEX = re.compile(r"[0-9a-f]{24,}", _A)
# A credential word, alone or at the end of a name (``db_password``, ``dbPassword``), but not inside another word (``bypass``).
_WORD = r"(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_ -]?key|auth(?:orization)?|bearer|credentials?|login)"
CONTEXT = re.compile(
    _WORD + r"""(?:["']?\x20*(?:[:=]|->)\x20*["']?([^\s"'<>,;]{8,})|\x20+is\x20+["']?([^\s"'<>,;]{8,}))|://[^\s/:@"'<>]+:([^\s/@"'<>]{8,})@""",
    re.I | _A,
)
_HINTS = ("passw", "passp", "passc", "pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "login", "://")
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")

# Common passwords and words in them, by rank.
COMMON = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login princess sunshine shadow football baseball superman batman "
    "iloveyou trustno1 hello freedom whatever michael jordan hunter secret summer winter spring autumn love god money test guest root user "
    "pass access default change changeme temp example sample demo dummy fake null none true false token key api the and for you that with this "
    "from have word http www com org net home work house apple orange banana computer internet server system service account private public data "
    "file name mail email phone number date time year month day king queen star blue green red black white gold silver"
).split()
WORD_COST = {w: log10(rank + 1) for rank, w in enumerate(COMMON, 1)}
LONGEST = 40  # code points of a word
# Patterns over lower-cased text: what follows a credential word, and whole words with their compounds (letters and marks).
_VALUES = re.compile(
    r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_ -]?key|auth(?:orization)?|bearer|credentials?|login)"""
    r"""(?:["']?\x20*(?:[:=]|->)\x20*|\x20+is\x20+)["']?[^\s"'<>,;]+|://[^\s/:@"'<>]+:[^\s/@"'<>]+@""",
    _A,
)
_LETTER = "(?:[^\\W\\d_]|[" + "".join(c for c in map(chr, range(0x300, 0x20000)) if category(c).startswith("M")) + "])"
_WHOLE = re.compile(rf"(?<!\w){_LETTER}++(?:[-_./]{_LETTER}++)*+(?![\d_])")
_PARTS = re.compile("[-_./]")
# Scripts written without spaces (Thai, Lao, Burmese, Khmer, kana, Han), with their punctuation.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff9f\U00020000-\U0003ffff]+")
_LEET = str.maketrans("013457@$!", "oleastasi")
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_PLACES: dict[str, set[tuple[int, int]]] = {}
for _r, _row in enumerate(ROWS):
    for _i, _c in enumerate(_row):
        _PLACES.setdefault(_c, set()).add((_r, _i))
# Whole values that are no secrets: a media type, and a time stamp.
_MEDIA = re.compile(r"(?:application|audio|font|image|message|model|multipart|text|video)/[a-z0-9][a-z0-9.+-]*(?:;[^\s]*)?", re.I | _A)
_STAMP = re.compile(r"(?:19|20)\d\d-?(?:0[1-9]|1[0-2])-?(?:0[1-9]|[12]\d|3[01])[T_]?(?:[01]\d|2[0-3]):?[0-5]\d(?::?[0-5]\d(?:[.]\d{1,9})?)?(?:Z|[+-]\d\d:?\d\d)?", re.I | _A)
_URL = re.compile(r"(?:[a-z][a-z0-9+.-]{1,9}:)?//?[^\s@]+|(?:[a-z0-9-]+[.])+[a-z]{2,}/[^\s@]*", re.I | _A)
_MARKS = re.compile(r"[^A-Za-z0-9\u0080-\U0010ffff]+")
_DATE = re.compile(r"(?=((?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d))", _A)


def _char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else 1.415 if c.isalpha() and c.isascii() else 1.519 if c.isascii() else 3.0


def _words(text: str, known: dict[str, tuple[str, ...]]) -> set[str]:
    """Words and compounds of a text outside credential values; ``known`` remembers those of runs between blanks."""
    low = text.lower()
    if any(h in low for h in _HINTS):
        low = _VALUES.sub(" ", low)
    if len(known) > 100_000:
        known.clear()
    out: set[str] = set()
    for run in set(low.split()):
        if (some := known.get(run)) is None:
            plain = run.strip(".,;:!?()")
            whole = [plain] if plain.isalpha() else _WHOLE.findall(run)
            some = tuple(w for w in {*whole, *(x for w in whole for x in _PARTS.split(w))} if 3 <= len(w) <= LONGEST)
            if len(run) <= 2 * LONGEST:
                known[run] = some
        out.update(some)
    return out


def vocabulary(docs: DataFrame, bound: int = VOCABULARY) -> dict[str, float]:
    """Costs of at most ``bound`` words of ``docs``, by the number of documents that hold them, and of the fixed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        counts: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    counts.update(_words(text or "", known))
                    if len(counts) > 200_000:  # the sums follow after the shuffle
                        yield counted(counts)
                        counts = Counter()
        yield counted(counts)

    def counted(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "docs"])

    words = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, docs bigint")
    counts = words.groupBy("word").agg(F.sum("docs").alias("docs")).filter("docs > 1")
    counts = written(counts, "words")
    room, least, part = bound, None, F.lit(False)
    for n, some in sorted(counts.groupBy("docs").count().collect(), reverse=True):
        if some > room:  # the level that does not fit: as many of its words as do
            part = (F.col("docs") == n) & (F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < 1_000_000 * room // some)
            break
        room, least = room - some, n
    wanted = part if least is None else (F.col("docs") >= least) | part
    ranked = sorted(counts.filter(wanted).collect(), key=lambda r: (-r.docs, r.word))[:bound]
    dropped(counts)
    costs = {r.word: log10(rank + 1) for rank, r in enumerate(ranked, 1)}
    return costs | {w: min(cost, costs.get(w, cost)) for w, cost in WORD_COST.items()}


def pieces(value: str, words: dict[str, float] = WORD_COST) -> Iterator[tuple[int, int, float]]:
    """Spans (start, end, decades of guesses) that are cheaper than brute force."""
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            for text, extra in ((low, 0.0), (plain, 0.5)):
                if (cost := words.get(text[i:j])) is not None:
                    yield i, j, cost + extra + (0.0 if value[i:j] == low[i:j] else 0.3 if value[i:j].istitle() or value[i:j].isupper() else 1.0)
                    break
    for m in _UNSPACED.finditer(value):
        yield m.start(), m.end(), log10(VOCABULARY)
    for m in _DATE.finditer(value):
        yield m.start(1), m.end(1), 2.1 if len(m[1]) == 4 else 4.7
    for period in range(1, 5):  # the unit once, and the logarithm of how often
        i = 0
        while i + period < n:
            j = i
            while j + period < n and value[j] == value[j + period]:
                j += 1
            if j - i >= max(2, period):
                yield i, j + period, sum(map(_char_cost, value[i : i + period])) + log10((j + period - i) / period)
            i = max(i + 1, j - period + 1 if j - i >= max(2, period) else i + 1)
    for step in (1, -1):  # runs along a keyboard row
        i = 0
        while i < n:
            j, at = i, _PLACES.get(low[i], set())
            while j + 1 < n and (at := {(r, k + step) for r, k in at} & _PLACES.get(low[j + 1], set())):
                j += 1
            if j - i >= 2:
                yield i, j + 1, 1.7 + log10(j + 1 - i)
            i = max(i + 1, j)


def guess_cost(value: str, words: dict[str, float] = WORD_COST) -> float:
    """Decades of guesses of the cheapest segmentation."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in pieces(value, words):
        ending.setdefault(j, []).append((i, cost))
    best = [0.0] * (len(value) + 1)
    for j in range(1, len(value) + 1):
        best[j] = min([best[j - 1] + _char_cost(value[j - 1]), *(best[i] + cost + 0.3 for i, cost in ending.get(j, ()))])
    return best[-1]


def _plain(value: str) -> bool:
    """A word of prose, as may follow "is": letters, hyphens and apostrophes, with no capitals but the first or all."""
    letters = re.sub("[-'\u2019]", "", value)
    return letters.isalpha() and (letters[1:].islower() or letters.isupper() or not letters.isascii())


def _named(value: str) -> bool:
    """A name made of words of prose: ``user_name_field``, ``self-explanatory``, ``docs.index``."""
    parts = _MARKS.split(value.strip("_-./"))
    return all(_plain(x) for x in parts)


def judged(value: str, words: dict[str, float] = WORD_COST) -> float:
    """Decades of guesses of a value in a credential context; zero where it is of a kind that is no secret."""
    if _MEDIA.fullmatch(value) or _STAMP.fullmatch(value) or _plain(value) and not value.isascii():
        return 0.0
    if _URL.fullmatch(value):
        return max((guess_cost(x, words) for x in _MARKS.split(value) if x and not _plain(x)), default=0.0)
    return guess_cost(value, words)


def _covered(found: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order and apart from each other."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in sorted(found):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def spans(text: str, words: dict[str, float] = WORD_COST) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start and then kind."""
    low = text.lower() if text.isascii() else text.translate(_ASCII_LOW)
    found: list[tuple[int, int, int]] = []
    if any(h in low for h in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LOW]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LOW_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(h in low for h in _HINTS):
        starts, ends = _covered(found)
        for m in CONTEXT.finditer(text):
            start, end = next(m.span(g) for g in (1, 2, 3) if m[g] is not None)
            value = text[start:end].rstrip(".)!?")
            end = start + len(value)
            if len(value) < 8 or m[2] is not None and _named(value):
                continue
            at = bisect_left(starts, end) - 1  # the last covered stretch that begins before the value ends
            if (at < 0 or ends[at] <= start) and judged(value, words) >= LIMIT:
                found.append((start, 3, end))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


_ASCII_LOW = {c: c + 32 for c in range(65, 91)}


def written_out(some: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in some)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess`` of every row."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"]
        for batch in batches:
            for part in slices(batch, "text"):
                found = [spans(x or "", words.value) for x in part.column("text").to_pylist()]
                counts = [pa.array([sum(s[0] == kind for s in f) for f in found], pa.int64()) for kind in KINDS]
                digests = [hashlib.sha256(written_out([s for s in f if s[0] != "guess"]).encode()).hexdigest() for f in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts[:3], pa.array(digests, pa.string()), pa.array(map(written_out, found), pa.string()), counts[3]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans are replaced together.  Null texts stay null."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary(docs))

    @F.pandas_udf("string")
    def without(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for _, a, b in spans(text, words.value):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]]) if out else text

        return texts.map(one)

    return docs.withColumn("text", without("text"))
