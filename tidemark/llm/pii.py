"""Personal data: exact identifiers, and disguised ones found through offset-preserving normalisation.

Three transducers run one after the other: the first folds look-alikes and drops invisible characters, the second writes
spelled digits as digits, the third turns at/dot disguises into signs. Each is a state table over characters, which gives
the longest phrase at each place and what it stands for, and a decision on the context of each phrase found; each hands
on a text of which every character knows the source characters that it came from. Identifiers are detected in the last
text and mapped back to spans of the source. Texts without any trigger are dismissed by a few vectorised searches.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.common import batches_of, only_for

KINDS = ("email", "ip", "card", "phone")
CHUNK = 4 << 20

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")

# Letters of other scripts that look like ASCII ones, number words of four languages, and words for the signs.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅοανρικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTYXIJSoavpikABEZHIKMNOPTYX", strict=True))
HOMOGLYPHS |= {"。": ".", "．": ".", "−": "-", "⓪": "0"}
NUMBERS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Number words that are other words as well: they count in runs of three or more only.
DOUBTFUL = ("un", "uno", "neuf", "dos", "null", "oh")
AT_WORDS, SURE_AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at",), ("arobase", "arroba", "klammeraffe"), ("dot", "punkt", "point", "punto"), ("plus", "más")
#: Letters of the longest word for a sign.
LONGEST_WORD = max(map(len, AT_WORDS + SURE_AT_WORDS + DOT_WORDS + PLUS_WORDS))
OPEN, CLOSE = "[({<*_\"'-", "])}>*_\"'-"
LETTER_DIGITS = {"o": "0", "O": "0", "l": "1", "I": "1"}


def fold(c: str) -> str | None:
    """The ASCII character that a character looks like or is a form of, nothing for an invisible one; None if it stays."""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Pd":
        return "-"
    if kind == "Zs":
        return " "
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and " " < plain <= "~" else None


FOLDED = {c: x for k in (range(0x80, 0x3100), range(0xFE00, 0x20000)) for c in map(chr, k) if not 0xD800 <= ord(c) < 0xE000 and (x := fold(c)) is not None}


def _ranges(characters) -> str:
    """The inside of a class of characters, by ranges."""
    out, codes = [], sorted(map(ord, characters))
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in out)


_LOOKALIKE = f"[{_ranges(FOLDED)}]"
_NUMBER = "(?:" + "|".join(sorted(NUMBERS, key=len, reverse=True)) + ")"
_OPEN, _CLOSE = f"[{re.escape(OPEN)}]", f"[{re.escape(CLOSE)}]"
_AT, _DOT = "(?:" + "|".join(AT_WORDS + SURE_AT_WORDS) + ")", "(?:" + "|".join(DOT_WORDS) + ")"
_PLUS = "(?:" + "|".join(PLUS_WORDS) + ")"
#: What Python takes for white space; the gate's engine knows only the ASCII part.
_SPACE = "[\\t-\\r\\x1c-\\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BESIDE = _SPACE[:-1] + ",.-]"
#: A letter, digit or none of both on the other side: number words of some languages have letters that the engine's word boundary does not know.
_EDGE = r"(?:^|[^\p{L}\p{N}_])"
_ENDS = r"(?:$|[^\p{L}\p{N}_])"
#: What a disguise needs: otherwise a text is not rewritten. Each rule has its part here, with its surroundings and without limits of length.
TRIGGER = (
    rf"(?s){_LOOKALIKE}|(?i:{_OPEN}{_SPACE}*(?:{_AT}|{_DOT}|@|\.){_SPACE}*{_CLOSE})|[0-9][oOlI]+[0-9]"
    rf"|(?i:[a-z0-9_](?:{_SPACE}*@{_SPACE}|{_SPACE}+@){_SPACE}*[a-z0-9-]+{_SPACE}*(?:\.|{_DOT}\b))|(?i:{_SPACE}(?:{'|'.join(SURE_AT_WORDS)}){_SPACE})"
    rf"|(?i:[a-z0-9_]{_SPACE}+at{_SPACE}+[a-z0-9-]+(?:{_SPACE}+{_DOT}{_SPACE}|{_SPACE}*{_OPEN}{_SPACE}*(?:{_DOT}|\.)))"
    rf"|(?i:[._0-9][a-z0-9._%+-]*{_SPACE}+at{_SPACE}+(?:[a-z0-9-]+\.)+[a-z]{{2}})"
    rf"|(?i:@[a-z0-9.-]*[a-z0-9]{_SPACE}+{_DOT}{_SPACE}+[a-z0-9])|(?i:[0-9]{_SPACE}+{_DOT}{_SPACE}+[0-9])|(?i:\b{_PLUS}{_SPACE}+(?:{_NUMBER}{_ENDS}|[0-9]))"
    rf"|(?i:{_EDGE}{_NUMBER}(?:{_BESIDE}+{_NUMBER}){{2}}{_ENDS})"
    rf"|(?i:{_EDGE}{_NUMBER}{_BESIDE}*[0-9]|[0-9]{_BESIDE}*{_NUMBER}{_ENDS}|\+{_SPACE}*{_NUMBER}{_ENDS}|{_DOT}{_SPACE}+{_NUMBER}{_ENDS}|{_EDGE}{_NUMBER}{_SPACE}+{_DOT}{_ENDS})"
)


class Trail:
    """A text of which each character knows the source characters it stands for: from start to before end."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.start = list(range(len(text))) if start is None else start
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Trail:
        """The text with every (from, to, instead) done, in order; what is written instead stands for all that it replaces."""
        if not edits:
            return self
        out, start, end, at = [], [], [], 0
        for a, b, instead in edits:
            out += [self.text[at:a], instead]
            start += self.start[at:a] + [self.start[a]] * len(instead)
            end += self.end[at:a] + [self.end[b - 1]] * len(instead)
            at = b
        return Trail("".join([*out, self.text[at:]]), start + self.start[at:], end + self.end[at:])


class StateTable:
    """Phrases as a table of states: from each state the next one for a character, and what the phrase that ends there stands for.

    In a phrase a space is one or more white characters, and a tilde any number of them. Letters match in either case.
    """

    def __init__(self, phrases: dict[str, str]):
        self.next: list[dict[str, int]] = [{}]
        self.out: list[str | None] = [None]
        for phrase, out in phrases.items():
            at = 0
            for c in phrase:
                if c == "~":
                    self.next[at][" "] = at
                    continue
                if c not in self.next[at]:
                    self.next.append({" ": len(self.next)} if c == " " else {})
                    self.out.append(None)
                    self.next[at][c] = len(self.next) - 1
                at = self.next[at][c]
            self.out[at] = out
        first = "".join(c for c in self.next[0] if c != " ")
        self.starts = re.compile(f"[{re.escape(first)}{r'\s' if ' ' in self.next[0] else ''}]", re.IGNORECASE)

    def find(self, text: str):
        """(from, to, what it stands for) of the longest phrases, from left to right."""
        table, outs, at, n = self.next, self.out, 0, len(text)
        while m := self.starts.search(text, at):
            k, state, found = m.start(), 0, None
            at = k
            while k < n:
                c = text[k]
                state = table[state].get(" " if c.isspace() else c.lower())
                if state is None:
                    break
                k += 1
                if outs[state] is not None:
                    found = k
                    out = outs[state]
            if found is None:
                at += 1
            else:
                yield at, found, out
                at = found


_DIGITS = StateTable(NUMBERS | {f"{w} ": "+" for w in PLUS_WORDS} | {c: d for c, d in LETTER_DIGITS.items() if c.islower()})
_SIGNS = StateTable(
    {f"{lead}{o}~{w}~{c}{tail}": sign for sign, names in (("@", (*AT_WORDS, *SURE_AT_WORDS, "@")), (".", (*DOT_WORDS, "."))) for w in names for o in OPEN for c in CLOSE for lead in ("", " ") for tail in ("", " ")}
    | {f" {w} ": "at" for w in AT_WORDS} | {f" {w} ": "@" for w in SURE_AT_WORDS} | {f" {w} ": "dot" for w in DOT_WORDS} | {" @ ": "sign", "@ ": "sign", " @": "sign"}
)
_BETWEEN, _LOOSE = re.compile(r"[\s,-]+"), re.compile(r"[\s,.-]*")
_DOT_WORD, _PLUS_WORD = re.compile(rf"\b{_DOT}\Z", re.IGNORECASE), re.compile(rf"\b{_PLUS}\Z", re.IGNORECASE)
_DIGITS_AFTER = re.compile(rf"\s*{_OPEN}?\s*{_DOT}\b|[\s,.-]*[0-9]", re.IGNORECASE)
_NUMBER_AFTER = re.compile(rf"(?:{_NUMBER}\b|[0-9])", re.IGNORECASE)
_LETTERS_IN_DIGITS = re.compile(r"(?<=[0-9])[oOlI]+(?=[0-9])")
_NAME_AFTER = re.compile(rf"[a-z0-9-]+(?:\s+{_DOT}\s+|\s*{_OPEN}\s*(?:{_DOT}|\.))", re.IGNORECASE)
_HOST_AFTER = re.compile(r"(?:[a-z0-9-]+\.)+[a-z]{2,63}\b", re.IGNORECASE)
_SPACED_AFTER = re.compile(rf"[a-z0-9-]+\s*(?:\.|{_DOT}\b)", re.IGNORECASE)
#: What a name has of which " at " before a plain domain makes an address: prose has none like it.
_NAME_SIGNS = frozenset("._0123456789")
_FOLDABLE = re.compile(_LOOKALIKE)


def _back(text: str, at: int, also: str = "") -> int:
    """Where the white space and other characters before a place begin, however many they are."""
    while at and (text[at - 1].isspace() or text[at - 1] in also):
        at -= 1
    return at


def _word_before(text: str, at: int, word: re.Pattern) -> bool:
    """Whether one of a pattern's words ends there; one character before it tells whether it is whole."""
    return word.search(text[max(0, at - LONGEST_WORD - 1) : at]) is not None


def _dot_before(text: str, at: int) -> bool:
    """Whether a word for a dot stands before a place, with white space and a closing sign between or none."""
    at = _back(text, at)
    return _word_before(text, at, _DOT_WORD) or (at > 0 and text[at - 1] in CLOSE and _word_before(text, _back(text, at - 1), _DOT_WORD))


def _digits_before(text: str, at: int) -> bool:
    """Whether digits, a plus sign or a word for it stand before a place."""
    near = _back(text, at)
    if near and text[near - 1] == "+" or near < at and _word_before(text, near, _PLUS_WORD):
        return True
    far = _back(text, near, ",.-")
    return far > 0 and text[far - 1] in "0123456789"


def _is_name(text: str, at: int) -> bool:
    """Whether the run of a mailbox's characters before a place has a sign that prose has not."""
    while at and text[at - 1] in _LOCAL:
        at -= 1
        if text[at] in _NAME_SIGNS:
            return True
    return False


def fold_lookalikes(trail: Trail) -> Trail:
    """Every look-alike as the character it looks like, without invisible ones: a table of one state."""
    return trail.rewrite([(m.start(), m.end(), FOLDED[m[0]]) for m in _FOLDABLE.finditer(trail.text)])


def write_digits(trail: Trail) -> Trail:
    """Number words as digits, plus as a sign, and letters among digits as the digits that they look like.

    Number words are taken in runs. A run of three or more is written as digits; a shorter one only beside a word for a
    dot, a plus sign or digits, since prose has number words too.
    """
    text = trail.text
    whole = lambda a, b: (a == 0 or not (text[a - 1].isalnum() or text[a - 1] == "_")) and (b == len(text) or not (text[b].isalnum() or text[b] == "_"))
    runs: list[list[tuple[int, int, str]]] = []
    edits = [(a, b, "".join(LETTER_DIGITS[c] for c in text[a:b])) for a, b in (m.span() for m in _LETTERS_IN_DIGITS.finditer(text))]
    for a, b, out in _DIGITS.find(text):
        if out == "+":
            if (a == 0 or not text[a - 1].isalnum()) and _NUMBER_AFTER.match(text, b):
                edits.append((a, b, "+"))
        elif b - a > 1 and whole(a, b):
            if runs and _BETWEEN.fullmatch(text, runs[-1][-1][1], a):
                runs[-1].append((a, b, out))
            else:
                runs.append([(a, b, out)])
    last = -1
    for run in runs:
        a, b = run[0][0], run[-1][1]
        sure = all(text[x:y].lower() not in DOUBTFUL for x, y, _ in run)
        if len(run) > 2 or sure and (last >= 0 and _LOOSE.fullmatch(text, last, a) or _DIGITS_AFTER.match(text, b) or _dot_before(text, a) or _digits_before(text, a)):
            # what stands between two words of a run goes with the first
            last = b
            edits += [(x, run[k + 1][0] if k + 1 < len(run) else y, d) for k, (x, y, d) in enumerate(run)]
    out = trail.rewrite(sorted(edits))
    # a word's own end is where its digit ends
    ends = {trail.start[x]: trail.end[y - 1] for run in runs for x, y, _ in run}
    return Trail(out.text, out.start, [ends.get(a, b) if b - a > 1 else b for a, b in zip(out.start, out.end, strict=True)]) if edits else out


def write_signs(trail: Trail) -> Trail:
    """Words and signs in brackets, and words and spaced signs that stand where an address has them, as @ and dots."""
    text, edits = trail.text, []
    word = lambda k: 0 <= k < len(text) and (text[k].isascii() and text[k].isalnum() or text[k] == "_")
    for a, b, out in _SIGNS.find(text):
        if out == "at":
            if word(a - 1) and (_NAME_AFTER.match(text, b) or (_HOST_AFTER.match(text, b) and _is_name(text, a))):
                edits.append((a, b, "@"))
        elif out == "dot":
            if word(a - 1) and word(b):
                edits.append((a, b, "."))
        elif out == "sign":
            if word(a - 1) and _SPACED_AFTER.match(text, b):
                edits.append((a, b, "@"))
        else:
            edits.append((a, b, out))
    return trail.rewrite(edits)


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: at each @ the run of local characters before it, if a domain follows."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers of at most 255."""
    return [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    """16 to 19 digits, single spaces or hyphens between, with a right check digit."""
    return [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    """A plus sign and 8 to 15 digits."""
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


_DETECT = (emails, ips, cards, phones)


def plain_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind as they stand in the text."""
    digit = any(c in text for c in "0123456789")
    return [emails(text) if "@" in text else [], ips(text) if digit else [], cards(text) if digit else [], phones(text) if digit and "+" in text else []]


def normalise(text: str) -> Trail:
    """The text without disguises."""
    return write_signs(write_digits(fold_lookalikes(Trail(text))))


def disguised_spans(text: str, plain: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Spans, of each kind, that only show in the rewritten text; a plain span of that kind lies inside or apart, as where a look-alike had cut it short."""
    clean = normalise(text)
    if clean.text == text:
        return [[] for _ in KINDS]
    out: list[list[tuple[int, int]]] = []
    for found, known in zip(plain_spans(clean.text), plain, strict=True):
        out.append([])
        spans = [(clean.start[a], clean.end[b - 1]) for a, b in found if text[clean.start[a] : clean.end[b - 1]] != clean.text[a:b]]
        starts, ends = [k[0] for k in known], [k[1] for k in known]
        for a, b in spans:  # of plain spans, those that end behind a and start before b must lie inside
            first, last = bisect_right(ends, a), bisect_left(starts, b)
            if first >= last or (a <= starts[first] and ends[last - 1] <= b and _FOLDABLE.search(text, a, b)):
                out[-1].append((a, b))
    return out


_SPAN = StructType([StructField("kind", IntegerType()), StructField("start", LongType()), StructField("end", LongType())])
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def _triggered(texts: pa.Array, pattern: str):
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)


def find(documents: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry's columns, and for each row the arrays base and added of (kind, start, end), ordered by kind and start.

    kind counts KINDS from 0; offsets are code points, the end is exclusive. Whole texts are searched; a null or empty
    text has no spans. base are the plain matches, added those that were disguised; base spans are never dropped.
    """
    return _positional(documents, text_col, carry).select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)], "base", "added")


def _positional(documents: DataFrame, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """find() with carry's columns named c_0, c_1 and so on."""
    fields = documents.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)], F.col(text_col).cast("string").alias("body"))
    held = [f"c_{i}" for i in range(len(carry))]
    schema = StructType([*(f for f in fields.schema.fields if f.name != "body"), StructField("base", ArrayType(_SPAN)), StructField("added", ArrayType(_SPAN))])

    def scan(batches):
        only_for()
        for batch in batches:
            for part in batches_of(batch, "body", CHUNK):
                texts = part.column("body")
                plain, hidden = _triggered(texts, "[0-9@]"), _triggered(texts, TRIGGER)
                base, added = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
                for k in (plain | hidden).nonzero()[0].tolist():
                    text = texts[k].as_py()
                    spans = plain_spans(text)
                    base[k] = [{"kind": i, "start": a, "end": b} for i, x in enumerate(spans) for a, b in x]
                    if hidden[k]:
                        added[k] = [{"kind": i, "start": a, "end": b} for i, x in enumerate(disguised_spans(text, spans)) for a, b in x]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in held), pa.array(base, _ARROW_SPAN), pa.array(added, _ARROW_SPAN)], names=[*held, "base", "added"])

    return fields.mapInArrow(scan, schema)


def spans_text(spans):
    """kind:start:end, comma-joined, of an array column of spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result columns of the query: counts and digest of the base spans, and all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def redact(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, whatever their names, with every span of the text replaced by its kind in brackets, as [EMAIL].

    Of overlapping spans the one that starts first (then the longer one) names the replacement, which covers them all.
    """
    columns = documents.columns
    found = _positional(documents, text_col, tuple(columns))
    text = F.col(f"c_{columns.index(text_col)}")
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    joined = F.aggregate(
        spans,
        F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], -s["back"]).alias("end"), F.element_at(acc, -1)["kind"].alias("kind"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind"))))),
    )
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    parts = F.aggregate(
        F.col("joined"),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.get(names, s["kind"])).alias("out"),
            s["end"].alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    clean = F.when(F.size("joined") == 0, text).otherwise(parts)
    return found.withColumn("joined", joined).select(*[clean.alias(c) if c == text_col else F.col(f"c_{i}").alias(c) for i, c in enumerate(columns)])


def base_digest(text: str | None) -> str:
    """The digest of a text's base spans, for checks."""
    rows = [f"{k}:{a}:{b}" for k, x in zip(KINDS, plain_spans(text or ""), strict=True) for a, b in x]
    return hashlib.sha256(",".join(rows).encode()).hexdigest()
