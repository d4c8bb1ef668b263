"""SentencePiece's merge-type encoding by a table of the last token of every prefix.

Merging takes, of all neighbours whose joint text is a piece, those of the highest score, leftmost first. What it leaves
for a prefix of a text is what it leaves for a shorter prefix, and one token more: the one token that ends there and
goes together with the last token of the prefix before it. So the table holds one token for each prefix, found among
the matches of an Aho-Corasick automaton of the pieces; the ids are read off backwards. Two tokens go together if
merging leaves their joint text as the two. That is seen from the tokens alone: as one is merged by itself, its last
part grows (for the other, its first part), each from some step to some step of merging; no two parts that exist
together may be a piece that has its turn before either grows on.

Texts fall into units that no piece reaches over, blanks with what follows; short units are remembered, up to a bound.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tidemark.llm.common import only_for, worker_tables

#: The sign that stands for a blank in pieces.
BLANK = "▁"
#: Units that a worker remembers (twice as many at most), the longest of these, and pairs of tokens whose verdict it remembers.
REMEMBERED, LONGEST, JUDGED = 250_000, 48, 2_000_000
NEVER = 1 << 60


class Token:
    """A text that is one token: its ids, and its last and first parts as merging makes it from single letters.

    ends and starts have (text, from, to) of each part: the steps of merging, by rank of the worst merge so far, from
    which and before which the part exists. whole is whether merging makes the text one token at all; plain is whether
    no two steps have the same rank, so that ranks alone tell the order. They are worked out when first asked for.
    after has the verdicts on tokens that stand behind this one.
    """

    __slots__ = ("after", "ends", "ids", "plain", "size", "starts", "text", "whole")

    def __init__(self, text: str, ids: list[int]):
        self.text, self.size, self.ids, self.after, self.whole = text, len(text), ids, {}, None

    def work_out(self, ranks: dict[str, int]) -> bool:
        parts, worst = list(self.text), -1
        ends, starts, born = [(parts[-1], -1)], [(parts[0], -1)], []
        while len(parts) > 1 and (at := best_pair(parts, ranks)) is not None:
            worst = max(worst, ranks[parts[at] + parts[at + 1]])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            born.append(worst)
            if at == len(parts) - 1:
                ends.append((parts[-1], worst))
            if at == 0:
                starts.append((parts[0], worst))
        self.whole = len(parts) == 1
        self.plain = len(set(born)) == len(born)
        self.ends, self.starts = ([(t, low, high) for (t, low), (_, high) in zip(grown, [*grown[1:], ("", NEVER)], strict=True)] for grown in (ends, starts))
        return self.whole


def best_pair(parts: list[str], ranks: dict[str, int]) -> int | None:
    """The first of the pairs of neighbours that are merged next, None if no two make a piece."""
    best, at = NEVER, None
    for k in range(len(parts) - 1):
        rank = ranks.get(parts[k] + parts[k + 1], NEVER)
        if rank < best:
            best, at = rank, k
    return at


def merged(text: str, ranks: dict[str, int]) -> list[str]:
    """What merging leaves of a text, step by step: for pairs of tokens that ranks alone do not tell apart, and tests."""
    parts = list(text)
    while (at := best_pair(parts, ranks)) is not None:
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Pieces:
    """A model file of merge type without normalisation; encodes and decodes whole texts."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a  Ａ ") != f"{BLANK}{BLANK}a{BLANK}{BLANK}Ａ{BLANK}":
            raise ValueError("a model without normalisation, with a blank put in front, is needed")
        n = model.vocab_size()
        kind = [model.is_byte(i) * 1 or model.is_control(i) * 2 or model.is_unknown(i) * 3 or model.is_unused(i) * 4 for i in range(n)]
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not kind[i]]
        if 4 in kind:
            raise ValueError("all pieces must be in use")
        self.end_id, self.unknown_id = model.eos_id(), model.unk_id()
        self.ids = {names[i]: i for i in plain}
        self.byte_ids = {int(names[i][1:-1], 16): i for i in range(n) if kind[i] == 1}
        places = {score: k for k, score in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        self.ranks = {names[i]: places[model.get_score(i)] for i in plain if len(names[i]) > 1}
        self.judged, self.verdicts = [], 0
        self.matches = ahocorasick.Automaton()
        for i in plain:
            self.matches.add_word(names[i], Token(names[i], [i]))
        self.matches.make_automaton()
        self.units: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.unit_re = self._splitter()
        # what each id decodes to: text, a byte, or nothing
        self.spelled: list[bytes] = [bytes([int(names[i][1:-1], 16)]) if kind[i] == 1 else b"" if kind[i] == 2 else " ⁇ ".encode() if kind[i] == 3 else names[i].replace(BLANK, " ").encode() for i in range(n)]
        self.is_piece = [not k for k in kind]

    def _splitter(self) -> re.Pattern:
        """Cuts a text where no piece reaches over: before blanks that follow other letters, and around line ends."""
        letters = "".join(self.ids)
        alone = "".join(c for c in "\n\r\t" if c not in letters)
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            return re.compile(rf"[{alone}]|[^{alone}]+" if alone else "(?s:.+)")
        return re.compile(rf"[{alone}]|{BLANK}+[^{BLANK}{alone}]*|[^{BLANK}{alone}]+" if alone else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")

    def _letter(self, letter: str) -> Token:
        """A letter that is no piece: a token of its own, spelled in bytes."""
        out = Token(letter, [self.byte_ids[x] for x in letter.encode("utf-8")] if len(self.byte_ids) == 256 else [self.unknown_id])
        out.work_out(self.ranks)
        return out

    def _judge(self, a: Token, b: Token) -> bool:
        """Whether merging leaves the joint text of two tokens as these two; remembered for tokens of the model."""
        fit = (b.work_out(self.ranks) if b.whole is None else b.whole) and self.go_together(a, b)
        if not a.after:
            self.judged.append(a.after)
        a.after[b] = fit
        self.verdicts += 1
        if self.verdicts > JUDGED:
            for known in self.judged:
                known.clear()
            self.judged.clear()
            self.verdicts = 0
        return fit

    def go_together(self, a: Token, b: Token) -> bool:
        """Whether merging leaves the joint text of two whole tokens as these two."""
        ranks = self.ranks
        if not (a.plain and b.plain):
            return merged(a.text + b.text, ranks) == [a.text, b.text]
        for end, from_a, to_a in a.ends:
            for start, from_b, to_b in b.starts:
                # steps of one rank: those on the left come first
                if from_b < to_a and from_a <= to_b:
                    rank = ranks.get(end + start)
                    if rank is not None and rank < to_a and rank <= to_b:
                        return False
        return True

    def _table(self, unit: str) -> list[Token | None]:
        """The last token of every prefix of a unit, as merging leaves it; None where a letter is no piece."""
        last: list[Token | None] = [None] * (len(unit) + 1)
        for end, t in self.matches.iter(unit):  # at one end the longest first
            end += 1
            if last[end] is None:
                start = end - t.size
                if start:
                    before = last[start]
                    if before is None:
                        before = last[start] = self._letter(unit[start - 1])
                    fit = before.after.get(t)
                    if fit is None:
                        fit = self._judge(before, t)
                else:
                    fit = t.work_out(self.ranks) if t.whole is None else t.whole
                if fit:
                    last[end] = t
        return last

    def _unit(self, unit: str) -> bytes:
        ids = self.elder.get(unit)
        if ids is None:
            out, at = [], len(unit)
            last = self._table(unit)
            while at:
                t = last[at] or self._letter(unit[at - 1])
                out += t.ids[::-1]
                at -= t.size
            out.reverse()
            ids = array("I", out).tobytes()
        if len(unit) <= LONGEST:
            if len(self.units) >= REMEMBERED:
                self.elder, self.units = self.units, {}
            self.units[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of the text and the end id, as little-endian unsigned 32-bit integers."""
        known = self.units.get
        units = self.unit_re.findall(BLANK + text.replace(" ", BLANK)) if text else []
        parts = list(map(known, units))
        if None in parts:
            for k, p in enumerate(parts):
                if p is None:
                    parts[k] = known(units[k]) or self._unit(units[k])
        parts.append(array("I", [self.end_id]).tobytes())
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text that ids spell: without the blank put in front, and bytes that are no UTF-8 replaced one by one."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if numbers and numbers[-1] == self.end_id:
            numbers.pop()
        parts = [self.spelled[i] for i in numbers]
        first = next((k for k, p in enumerate(parts) if p), None)
        if first is not None and self.is_piece[numbers[first]] and parts[first][:1] == b" ":
            parts[first] = parts[first][1:]
        if b"" not in parts[(first or 0) + 1 :]:
            return _text(b"".join(parts))
        # pieces without text end a character's bytes
        return "".join(_text(b"".join(parts[k] for k in run)) for _, run in groupby(range(len(parts)), key=lambda k: parts[k] != b""))


#: Bytes that were no part of UTF-8.
_LOST = {0xDC00 + b: "�" for b in range(128, 256)}


def _text(spelled: bytes) -> str:
    try:
        return spelled.decode("utf-8")
    except UnicodeDecodeError:
        return spelled.decode("utf-8", "surrogateescape").translate(_LOST)


@worker_tables(2)
def pieces(path: str) -> Pieces:
    """A worker reads a model once."""
    return Pieces(path)


def encode(documents: DataFrame, model_path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry's columns, ids (binary, little-endian unsigned 32-bit integers, with the end id) and decoded.

    Whole texts are encoded; a null or empty text has the end id alone and decodes to an empty one. model_path must be
    readable on every worker. Other columns are not read, so none can clash. Names of control pieces in a text are
    ordinary letters, and letters without a piece are spelled in bytes.
    """
    fields = documents.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)], F.col(text_col).cast("string").alias("body"))
    held = [f"c_{i}" for i in range(len(carry))]
    schema = StructType([*(f for f in fields.schema.fields if f.name != "body"), StructField("ids", BinaryType()), StructField("decoded", StringType())])

    def run(batches):
        only_for(pieces)
        p = pieces(model_path)
        for batch in batches:
            ids = [p.encode(t.as_py() or "") for t in batch.column("body")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(ids, pa.binary()), pa.array(map(p.decode, ids), pa.string())], names=[*held, "ids", "decoded"])

    return fields.mapInArrow(run, schema).select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)], "ids", "decoded")


def digests(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and digest of each text's ids (in decimal, a blank between), and the digest of what they decode to."""
    fields = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    schema = StructType([fields.schema["id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    def run(batches):
        only_for(pieces)
        p = pieces(model_path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for t in batch.column("body"):
                ids = p.encode(t.as_py() or "")
                numbers = np.frombuffer(ids, "<u4").tolist()
                n.append(len(numbers))
                ids_hash.append(hashlib.sha256(" ".join(map(str, numbers)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(p.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return fields.mapInArrow(run, schema).withColumnRenamed("id", id_col)
