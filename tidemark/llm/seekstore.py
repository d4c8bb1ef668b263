"""Seekable Zstandard files, and token ids stored in them.

A file is a row of independent Zstandard frames, then an index of what they hold, then the seek table of the public
seekable format: for each frame its compressed and decompressed size and the low 32 bits of its XXH64. A reader loads
the end of the file and then just the frames it wants. Index and table are skippable frames, so that any Zstandard
tool reads the file as the plain concatenation.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Memory, filesystem, only_for, shared_dir, worker_tables

# Fixed values of the published formats.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Decompressed bytes after which a frame ends, and level of compression.
FRAME_BYTES, LEVEL = 256 << 10, 3


class Writer:
    """Appends blobs to a stream as frames; finish() adds the index and the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.most = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.open, self.size, self.table = [], 0, []

    def add(self, blob: bytes) -> tuple[int, int]:
        """Frame number and offset in the frame at which the blob will be found. A blob is never cut."""
        if self.size and self.size + len(blob) > self.most:
            self._close()
        place = (len(self.table), self.size)
        self.open.append(blob)
        self.size += len(blob)
        return place

    def _close(self) -> None:
        data = b"".join(self.open)
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def finish(self, index: bytes) -> None:
        if self.size or self.open:
            self._close()
        packed = self.packer.compress(index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed) + 4) + packed + struct.pack("<I", len(packed)))
        body = b"".join(struct.pack("<III", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(body) + 9) + body + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE))


class Reader:
    """Reads the end of a file, then frames on demand; every frame's checksum is compared."""

    def __init__(self, source):
        self.source, size = source, source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table at the end of the file")
        start = size - 9 - 12 * frames
        self.table = list(struct.iter_unpack("<III", self._at(start, 12 * frames)))
        self.starts = np.concatenate(([0], np.cumsum([x[0] for x in self.table], dtype=np.int64)))
        (packed,) = struct.unpack("<I", self._at(start - 8 - 4, 4))
        self.index = zstandard.ZstdDecompressor().decompress(self._at(start - 8 - 4 - packed, packed))

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        packed, size, check = self.table[k]
        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data


# ---- token ids ----

#: Chunks and words that a worker remembers, the longest of these, and words that the library gets as one text.
CHUNKS, WORDS, LONGEST, JOINED = 800_000, 600_000, 48, 100
#: Letters, then signs: no normal form, special token or short form of a word reaches over their border.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
#: The normal form and the splitting of tokenizers whose words are those of _WORD in lower case.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class ChunkTokenizer:
    """The tokenizers library with a memory: white space never joins tokens, so a text's ids are those of its chunks.

    A chunk of letters and signs behind them has the ids of its letters in lower case and of its signs, where the
    tokenizer splits and lowers like that; the library gets such words many at a time and tells whose an id is.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known, self.words = Memory(CHUNKS), Memory(WORDS)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [*((spec["normalizer"] or {}).get("normalizers") or []), *((spec["pre_tokenizer"] or {}).get("pretokenizers") or [])]
        split = [(x["pattern"], x["behavior"], x["invert"]) for x in steps if x["type"] == "Split"]
        self.splits = [x["type"] for x in steps] == [*_NORMAL, "Split", "ByteLevel"] and split == [({"Regex": _SPLIT}, "Removed", True)] and not spec["post_processor"]
        self.splits = self.splits and not steps[-1]["add_prefix_space"] and not steps[-1]["use_regex"] and all(x["content"][:1] in "<[" for x in spec["added_tokens"])

    def _alone(self, chunks: list[str]) -> Iterator[bytes]:
        for at in range(0, len(chunks), 20_000):
            for e in self.library.encode_batch_fast(chunks[at : at + 20_000], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _joined(self, words: list[str]) -> Iterator[bytes]:
        parts = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        for part, e in zip(parts, self.library.encode_batch([" ".join(x) for x in parts], add_special_tokens=False), strict=True):
            of, ids = e.word_ids, array("I", e.ids)
            first = [k for k in range(len(of)) if not k or of[k] != of[k - 1]]
            if len(first) != len(part):
                yield from self._alone(part)
                continue
            for a, z in zip(first, [*first[1:], len(of)], strict=True):
                yield ids[a:z].tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Adds the ids of chunks to what is known."""
        cut, alone, known = [], [], self.known.young
        for c in chunks:
            m = _WORD.fullmatch(c) if self.splits and len(c) <= LONGEST else None
            if m:
                word, signs = m.groups()
                cut.append((c, word.lower(), signs))
            else:
                alone.append(c)
        known.update(zip(alone, self._alone(alone), strict=True))
        wanted = {x for _, x, _ in cut}
        wanted.update(x for _, _, x in cut)
        wanted.discard("")
        new, words = self.words.missing(wanted), self.words.young
        words.update(zip(new, self._joined(new), strict=True))
        words[""] = b""
        for c, word, signs in cut:
            known[c] = words[word] + words[signs]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        chunks = [t.replace("\n", " ").split(" ") for t in texts]
        new = self.known.missing(set().union(*chunks))
        if new:
            self._learn(new)
        known = self.known.young
        out = [b"".join(map(known.__getitem__, x)) for x in chunks]
        for c in new:
            if len(c) > LONGEST:
                del known[c]
        return out


@worker_tables(2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """A worker loads a tokenizer once."""
    return ChunkTokenizer(path)


def _index(ids: list, counts: list[int]) -> bytes:
    """Documents of a file: number, null flags, ids, and numbers of tokens."""
    return struct.pack("<q", len(ids)) + bytes(x is None for x in ids) + np.array([x or 0 for x in ids], "<i8").tobytes() + np.array(counts, "<i8").tobytes()


def _parse_index(index: bytes) -> tuple[list, np.ndarray]:
    (n,) = struct.unpack_from("<q", index)
    null = np.frombuffer(index, np.uint8, n, 8)
    ids = np.frombuffer(index, "<i8", n, 8 + n).tolist()
    return [None if x else i for i, x in zip(ids, null, strict=True)], np.frombuffer(index, "<i8", n, 8 + 9 * n)


def write_ids(documents: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> list[tuple[str, int, int]]:
    """Tokenizes every whole text and writes ids, end_id after each document, in ascending order of the id.

    Documents are range-partitioned by id (ties by a hash of the text; nulls first) and each partition becomes one
    file. Returns the manifest in that order: file URI, documents and ids of each; just this goes to the driver. A null
    or empty text has the end id alone. File names are unique to the attempt of a task and only those of attempts that
    succeeded are listed, so lost executors leave no half file that could be read.
    """
    spark = documents.sparkSession
    folder = folder or shared_dir(spark, "token-ids")
    fields = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).withColumn("tie", F.xxhash64("body"))
    ordered = fields.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def write(batches):
        only_for(chunk_tokenizer)
        store, place = filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"ids-{part:06d}-{uuid.uuid4().hex}.zst"
        tok, ids, counts, out = chunk_tokenizer(tokenizer_path), [], [], None
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(place, recursive=True)
                stream = store.open_output_stream(f"{place}/{name}", compression=None)
                out = Writer(stream)
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                for i, data in zip(piece.column("id").to_pylist(), tok.encode([t or "" for t in piece.column("body").to_pylist()]), strict=True):
                    out.add(data + end)
                    ids.append(i)
                    counts.append(len(data) // 4 + 1)
        if out is not None:
            out.finish(_index(ids, counts))
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/{name}"], "docs": [len(ids)], "tokens": [sum(counts)]}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    rows = ordered.mapInArrow(write, "part int, file string, docs long, tokens long").collect()
    return [(r["file"], r["docs"], r["tokens"]) for r in sorted(rows, key=lambda r: r["part"])]


def documents_of(file: str, wanted: set | None = None) -> Iterator[tuple]:
    """(id, place of the first id in the file, ids as bytes) of the file's documents, or of the wanted ones: frames without any are not decompressed."""
    store, place = filesystem(file)
    with store.open_input_file(place) as source:
        reader = Reader(source)
        ids, counts = _parse_index(reader.index)
        edges = np.concatenate(([0], np.cumsum([x[1] for x in reader.table], dtype=np.int64)))
        begin = np.concatenate(([0], np.cumsum(counts))) * 4
        frame = np.searchsorted(edges, begin[:-1], "right") - 1
        held, data = -1, b""
        for k, i in enumerate(ids):
            if wanted is not None and i not in wanted:
                continue
            if frame[k] != held:
                held, data = int(frame[k]), reader.frame(int(frame[k]))
            at = int(begin[k] - edges[held])
            yield i, int(begin[k]) // 4, data[at : at + 4 * int(counts[k])]


def read_ids(spark: SparkSession, manifest: list[tuple[str, int, int]], wanted: set | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary) from the files; all documents, or a small set of wanted ids."""
    rows, start = [], 0
    for file, _, tokens in manifest:
        rows.append((file, start))
        start += tokens

    def read(batches):
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                kept, size = [], 0
                for i, at, data in documents_of(file, wanted):
                    kept.append((i, base + at, data))
                    size += len(data)
                    if size > 8 << 20:
                        yield _rows(kept)
                        kept, size = [], 0
                if kept:
                    yield _rows(kept)

    files = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)), "file")
    return files.mapInArrow(read, "doc_id long, start long, ids binary")


def _rows(kept: list[tuple]) -> pa.RecordBatch:
    ids, starts, data = zip(*kept, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "ids"])


def id_digest(found: DataFrame) -> DataFrame:
    """The result columns of the query, from what was read back."""
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    """The checksum of a list of ids, for checks."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
