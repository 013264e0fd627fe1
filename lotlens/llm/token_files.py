"""Token ids as flat binary files with 64-bit document offsets.

Layout of a folder, for each part p of the documents in ascending order of ``doc_id``:
``p.tokens`` flat little-endian unsigned ids (16 bits if the vocabulary allows, else 32), ``p.offsets``
n + 1 unsigned 64-bit offsets into the part, ``p.ids`` n signed 64-bit document ids; and ``manifest.json`` with the
number type and, per part, documents, tokens and base (tokens in all parts before: a prefix sum of the part totals).
A document's place in the whole is base + offset. Files are read by memory map where the folder is mounted, else by range.

A part is one partition of a range partitioning; a task streams its documents, writes under a name of its own
and renames at the end, so a repeated attempt replaces whole files by equal ones. Only one row per part reaches the
driver.

Defined results: null text is empty, its ids are the end id alone; a null id comes first and is written as
-2^63; ties go by text; repeated rows are documents of their own; an empty table gives no parts; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

NULL_ID = -(2**63)
PART = "part int, docs long, tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"

# The byte-to-character table and the splitting pattern of byte-level vocabularies.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Kinds of characters for ``Encoder._starts``; white space last.
LETTER, OTHER, SPACE, BLANK = 1, 2, 3, 4
#: Bytes of texts encoded at once; a longer text goes alone.
BLOCK = 2**23


class Encoder:
    """Ids of whole texts as bytes, with the ids of frequent words kept.

    A byte-level vocabulary splits a text into words first, and no merge crosses a word; so texts are cut by arrays where
    a word begins in any case, and the library's model runs once per block of texts for each different word that is not
    yet known. ``kept`` bounds the memory; other tokenizers encode whole texts.
    """

    def __init__(self, path: str, end_id: int = 0, kept: int = 300_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.wide = self.tokenizer.get_vocab_size() > 2**16
        self.type = "<u4" if self.wide else "<u2"
        self.code = "I" if self.wide else "H"
        self.end = self._bytes([end_id])
        first = self.tokenizer.pre_tokenizer
        self.by_word = repr(first).startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in repr(first) and self.tokenizer.normalizer is None
        self.model = self.tokenizer.model
        self.words = regex.compile(SPLIT).findall
        spare = iter(range(256, 512))
        self.table = {b: chr(b if b in set(PLAIN_BYTES) else next(spare)) for b in range(256)}
        self.kinds = np.full(2**16, OTHER, np.uint8)
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 2**16)]))
        for pattern, kind in ((r"\p{L}", LETTER), (r"[\s\x1c-\x1f\x85]", BLANK), (" ", SPACE)):
            self.kinds[[ord(c) for c in regex.findall(pattern, points)]] = kind
        self.ascii = np.where(np.arange(256) < 128, self.kinds[:256], 0).astype(np.uint8)
        self.kept, self.most = {}, kept

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, word: str) -> bytes:
        return self._bytes([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.table))])

    def _chunk(self, chunk: str) -> bytes:
        """Mostly one word, seen by its letters alone."""
        if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha():
            return self._piece(chunk)
        return b"".join(map(self._piece, self.words(chunk)))

    def _starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Places in UTF-8 texts where a word begins in any case, in ascending order, and the end.

        These are the starts of texts, a space after a character other than white space, another ASCII character that
        follows a letter and is none, and what follows a single line feed.
        """
        kinds = self.ascii[data]
        at = np.flatnonzero(kinds >= OTHER)
        here, before = kinds[at], kinds[at - 1]
        far = np.flatnonzero(before == 0)
        c, b, a = (data[at[far] - k].astype(np.int32) for k in (1, 2, 3))
        point = np.where(b >= 0xC0, (b & 31) << 6 | c & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63)
        before[far] = np.where((b >= 0xC0) | (a >= 0xE0), self.kinds[point], OTHER)  # beyond 2^16 no white space, letters are not told
        mark = np.zeros(len(data) + 1, bool)
        mark[at[np.where(here == SPACE, before < SPACE, before == LETTER)]] = True
        line = at[(here == BLANK) & (before < SPACE)]
        line = line[data[line] == 10] + 1
        line = line[line < len(data)]
        mark[line[(kinds[line] == LETTER) | (kinds[line] == OTHER)]] = True
        mark[bounds] = True
        return np.flatnonzero(mark)

    def _block(self, texts: pa.LargeStringArray) -> tuple[bytes | pa.Buffer, np.ndarray]:
        if not self.by_word:
            ids = [self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids) + self.end for text in texts.to_pylist()]
            return b"".join(ids), np.array([len(i) for i in ids]) // len(self.end)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        starts = self._starts(data, bounds)
        found = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data)).dictionary_encode()
        chunks, places = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        ids, often = [*map(self.kept.get, chunks)], np.bincount(places, minlength=len(chunks)) > 1
        for i in [i for i, known in enumerate(ids) if known is None]:
            ids[i] = self._chunk(chunks[i])
            if often[i] and len(self.kept) < self.most:
                self.kept[chunks[i]] = ids[i]
        last = np.searchsorted(starts, bounds[1:])
        every = pa.array([*ids, self.end], pa.large_binary()).take(pa.array(np.insert(places, last, len(ids))))
        ends = np.frombuffer(every.buffers()[1], np.int64)[last + np.arange(1, len(last) + 1)]
        return every.buffers()[2], np.diff(ends, prepend=0) // len(self.end)

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[bytes | pa.Buffer, np.ndarray]]:
        """By blocks of texts: the ids of each text and the end id, little-endian, one after another; numbers of ids."""
        texts = texts.cast(pa.large_string())
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK, "right")))
            yield self._block(texts.slice(at, stop - at))
            at = stop

    def encode(self, text: str) -> bytes:
        """The ids and the end id, little-endian."""
        return b"".join(bytes(ids) for ids, _ in self.encode_all(pa.array([text])))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    """One per Python worker: its words serve all tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def _name(part: int) -> str:
    return f"part-{part:06d}"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> dict:
    """Writes the documents' ids; returns the manifest. ``folder`` must be seen by all executors."""
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (store, base), part = _encoder(tokenizer, end_id), _open(folder), TaskContext.get().partitionId()
        place, own = f"{base}/{_name(part)}", uuid.uuid4().hex
        offsets, ids, out = array("Q", [0]), array("q"), None
        for batch in batches:
            if batch.num_rows and out is None:
                out = store.open_output_stream(f"{place}.tokens.{own}")
            for data, counts in encoder.encode_all(batch.column(1)):
                out.write(data)
                offsets.frombytes((offsets[-1] + np.cumsum(counts)).astype("<u8").tobytes())
            ids.frombytes(batch.column(0).fill_null(NULL_ID).to_numpy().tobytes())
        if out is not None:
            out.close()
            for kind, data in (("offsets", offsets), ("ids", ids)):
                with store.open_output_stream(f"{place}.{kind}.{own}") as f:
                    f.write(data.tobytes())
            for kind in ("tokens", "offsets", "ids"):
                store.move(f"{place}.{kind}.{own}", f"{place}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([offsets[-1]], pa.int64())], names=["part", "docs", "tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    parts, base = [], 0
    for part, n, tokens in sorted(tuple(r) for r in ordered.mapInArrow(encode, PART).collect()):
        if n:
            parts.append({"part": part, "docs": n, "tokens": tokens, "base": base})
            base += tokens
    manifest = {"type": _encoder(tokenizer, end_id).type, "end_id": end_id, "parts": parts}
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _mapped(store: pyarrow.fs.FileSystem, path: str, kind: str) -> np.ndarray:
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=kind)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and the checksum of the ids as 32-bit integers, from the files."""
    fs, root = _open(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    parts = manifest["parts"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for number in (n for batch in batches for n in batch.column(0).to_pylist()):
            part = parts[number]
            place = f"{base}/{_name(part['part'])}"
            offsets = _mapped(store, f"{place}.offsets", "<u8").astype(np.int64)
            ids, tokens = _mapped(store, f"{place}.ids", "<i8"), _mapped(store, f"{place}.tokens", manifest["type"])
            for at in range(0, len(ids), 5000):
                ends = offsets[at : at + 5001]
                sums = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
                own = np.asarray(ids[at : at + 5000])
                yield pa.RecordBatch.from_arrays([
                    pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(part["base"] + ends[:-1]), pa.array(np.diff(ends)), pa.array(sums, pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(load, ROWS)
