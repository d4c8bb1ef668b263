"""Byte-pair encoding by a tokenization automaton.

The automaton reads token labels and accepts exactly the label sequences that byte-pair merging would give. It is made
from one state with a loop for every byte, by one gadget for each merge (a, b) -> ab in rank order: the state that a
leads to is split into a copy without the arc b; wherever an arc a leaves, an arc ab is added, which leads to where b
leads at that time. So each label leads to one state, whichever state it leaves, and a state differs from the one it was
split from by the arcs that the split took: b and the labels made later of which b is the first part, or the first part
of the first part, and so on. With labels numbered in preorder by first parts, elder ones first, these are one number
and one range of numbers. The tables hold that difference for every state; a state's row of missing arcs, as sorted
bounds of ranges, is put together from them when the state is first entered.

A pre-split word is encoded by one pass over its bytes: a second automaton, a trie of the labels with failure links,
gives the labels that end at each byte; of these, one alone has an arc from the state that its start has reached, and
that is the arc taken. The arcs are read backwards from the end. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tidemark.llm.common import Memory, only_for, worker_tables

#: White space as the vocabulary's splitting pattern sees it (it is not what str.split() uses).
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A text falls into these units whatever stands around them: words with the space before, and runs of white space.
_UNITS = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The published splitting pattern of byte-level vocabularies.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Units and pieces of units that a worker remembers, and the longest of these.
KNOWN, LONGEST = 320_000, 48


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """The automaton of a list of merges over byte strings."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """labels: bytes of each token id; merges: (left id, right id, merged id) in rank order, each merged id once."""
        self.labels = labels
        made = [ab for _, _, ab in merges]
        if len(set(made)) < len(made):
            raise ValueError("two merges make one token")
        self._number({ab: (a, rank) for rank, (a, _, ab) in enumerate(merges)})
        # states: the one each was split from, and the numbers of the arcs it lost: one, and a range
        self.parent, self.lost, self.lost_from, self.lost_to = array("i", [-1]), array("i", [-1]), array("i", [0]), array("i", [0])
        self.state = {i: 0 for i, b in labels.items() if len(b) == 1}
        for rank, (a, b, ab) in enumerate(merges):
            self._gadget(a, b, ab, rank)
        self.rows: list[array | None] = [None] * len(self.parent)
        self.ends = ahocorasick.Automaton()
        for i, state in self.state.items():
            self.ends.add_word(labels[i].decode("latin-1"), (len(labels[i]), self.number[i], state, i))
        self.ends.make_automaton()

    def _number(self, first_part: dict[int, tuple[int, int]]) -> None:
        """Numbers the labels in preorder of the tree in which a label hangs below its first part, elder ones first."""
        below: dict[int, list[int]] = {}
        for ab, (a, _) in first_part.items():  # in order of rank
            below.setdefault(a, []).append(ab)
        self.below = below
        self.born = {ab: rank for ab, (_, rank) in first_part.items()}
        self.number: dict[int, int] = {}
        self.last: dict[int, int] = {}  # the number after those below the label
        for root in self.labels:
            if root in first_part:
                continue
            waiting = [(root, False)]
            while waiting:
                x, done = waiting.pop()
                if done:
                    self.last[x] = len(self.number)
                    continue
                self.number[x] = len(self.number)
                waiting.append((x, True))
                waiting += [(c, False) for c in reversed(below.get(x, ()))]

    def _gadget(self, a: int, b: int, ab: int, rank: int) -> None:
        """Splits the state that a leads to from its arc b, and adds the arc ab, which leads where b does."""
        old, to = self.state.get(a), self.state.get(b)
        if old is None or to is None or self._is_missing(old, self.number[b]):
            return  # no word comes to this merge
        younger = [c for c in self.below.get(b, ()) if self.born[c] >= rank]
        self.parent.append(old)
        self.lost.append(self.number[b])
        self.lost_from.append(self.number[younger[0]] if younger else 0)
        self.lost_to.append(self.last[b] if younger else 0)
        self.state[a] = len(self.parent) - 1
        self.state[ab] = to

    def _is_missing(self, state: int, number: int) -> bool:
        """While the tables are made: whether a state has lost the arc of that number."""
        parent, lost, low, high = self.parent, self.lost, self.lost_from, self.lost_to
        while state > 0:
            if lost[state] == number or low[state] <= number < high[state]:
                return True
            state = parent[state]
        return False

    def row(self, state: int) -> array:
        """A state's row: bounds of the ranges of numbers whose arcs it has not, in order."""
        ranges = []
        k = state
        while k > 0:
            ranges.append((self.lost[k], self.lost[k] + 1))
            if self.lost_to[k]:
                ranges.append((self.lost_from[k], self.lost_to[k]))
            k = self.parent[k]
        out = array("i")
        for low, high in sorted(ranges):
            if out and low <= out[-1]:
                out[-1] = max(out[-1], high)
            else:
                out.extend((low, high))
        self.rows[state] = out
        return out

    def encode(self, word: bytes) -> list[int]:
        """The labels that the automaton accepts for the word."""
        rows = self.rows
        last = len(word) - 1
        at = [-1] * len(word)  # the state that is reached by an arc over each byte, if any, and that arc
        at.append(0)  # found at -1 as well: the start
        by = [None] * len(word)
        for end, arc in self.ends.iter(word.decode("latin-1")):
            if at[end] < 0:
                here = at[end - arc[0]]
                if here > 0:
                    row = rows[here]
                    if row is None:
                        row = self.row(here)
                    if not bisect_right(row, arc[1]) & 1:
                        at[end], by[end] = arc[2], arc
                elif not here:  # the start lacks no arc
                    at[end], by[end] = arc[2], arc
        out = []
        while last >= 0:
            size, _, _, label = by[last]
            out.append(label)
            last -= size
        out.reverse()
        return out


class Vocabulary:
    """A byte-level vocabulary file with its automaton; encodes and decodes whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = spec["model"]["vocab"]
        labels = {i: bytes(letters[c] for c in s) for s, i in names.items() if s not in special}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.automaton = Automaton(labels, [(names[a], names[b], names[a + b]) for a, b in pairs])
        self.special = special
        self.special_re = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.arc_labels = dict(labels) | {i: s.encode() for s, i in special.items()}
        self.known = Memory(KNOWN)  # of units and pieces alike: a piece that stands alone is a unit of that one piece

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            ids = array("I", self.automaton.encode(piece.encode("utf-8"))).tobytes()
            if len(piece) <= LONGEST:
                self.known.put(piece, ids)
        return ids

    def _unit(self, unit: str) -> bytes:
        """The ids of a unit that is not remembered, as little-endian 32-bit integers; short ones are remembered, up to a bound."""
        pieces = _PIECES.findall(unit)
        if len(pieces) == 1:  # remembered once
            return self._piece(unit)
        ids = b"".join(map(self._piece, pieces))
        if len(unit) <= LONGEST:
            self.known.put(unit, ids)
        return ids

    def _plain(self, text: str) -> bytes:
        units = _UNITS.findall(text)
        new = {u: self._unit(u) for u in self.known.missing(set(units))}
        young = self.known.young
        parts = list(map(young.get, units))
        if None in parts:  # too long to be remembered, or not of the younger generation any more
            old = self.known.old
            parts = [p or new.get(u) or old.get(u) or self._unit(u) for u, p in zip(units, parts, strict=True)]
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """All ids of the text, as little-endian unsigned 32-bit integers."""
        if not self.special_re or not self.special_re.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """Emits the label of every arc; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.arc_labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@worker_tables(2)
def vocabulary(path: str) -> Vocabulary:
    """A worker compiles a vocabulary once."""
    return Vocabulary(path)


def encode(documents: DataFrame, vocab_path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry's columns, ids (binary, little-endian unsigned 32-bit integers) and decoded (the text those ids spell).

    Whole texts are encoded; a null or empty text has no ids and decodes to an empty one. vocab_path must be readable
    on every worker. Other columns are not read, so none can clash. Special tokens in a text become their ids.
    """
    fields = documents.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)], F.col(text_col).cast("string").alias("body"))
    held = [f"c_{i}" for i in range(len(carry))]
    schema = StructType([*(f for f in fields.schema.fields if f.name != "body"), StructField("ids", BinaryType()), StructField("decoded", StringType())])

    def run(batches):
        only_for(vocabulary)
        v = vocabulary(vocab_path)
        for batch in batches:
            ids = [v.encode(t.as_py() or "") for t in batch.column("body")]
            text = [v.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(ids, pa.binary()), pa.array(text, pa.string())], names=[*held, "ids", "decoded"])

    return fields.mapInArrow(run, schema).select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)], "ids", "decoded")


def digests(documents: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and digest of each text's ids, and the digest of what they decode to; the ids stay in the task."""
    fields = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    schema = StructType([fields.schema["id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    def run(batches):
        only_for(vocabulary)
        v = vocabulary(vocab_path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for t in batch.column("body"):
                ids = v.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(v.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return fields.mapInArrow(run, schema).withColumnRenamed("id", id_col)
