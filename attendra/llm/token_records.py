"""Length-delimited binary records of token ids, with a separate offset index.

A data file is a run of records::

    length    u64 little-endian, bytes of the payload
    check     u32 masked CRC-32 of the eight length bytes
    payload   doc_id i64, flags u8 (1: doc_id is null), width u8 (2 or 4), ids
    check     u32 masked CRC-32 of the payload

Ids are little-endian unsigned integers of ``width`` bytes, two where every id
of the record fits. The mask rotates the checksum right by 15 bits and adds a
constant, so that a checksum stored inside data is not taken for its own. The
index file beside each data file (``.idx``) has a fixed-size entry per record
(doc_id i64, flags u8, offset u64, payload length u64, ids u64), so any record can
be read with one seek.

Documents are dealt by ranges of doc_id and sorted, hence file and record order
is ascending doc_id (nulls first, ties by text). A file is closed at
``file_bytes``; one longer record has a file of its own. Files are written under
another name and then renamed; a repeated task writes the same bytes again, so
lost executors leave no half-written or doubled records.

A null text counts as empty; every record ends with the end id. The string of a
special token in a text gives that token's id, as the tokenizer's plain call does. An empty table
gives no files, and reading it gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate
from uuid import uuid4

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attendra.sources.storage import materialize

#: A fixed value of the record format's checksum mask.
MASK = 0xA282EAD8
HEAD = "<qBB"
ENTRY = "<qBQQQ"
FILE_BYTES = 16 << 20
#: Short chunks that a Python worker remembers (some 60 bytes each); then those not used of late go.
CACHE = 1_000_000
#: Longer chunks that it remembers, and the longest of them.
CACHE_LONG = 50_000
LONGEST = 256
#: Bytes of text whose chunks are looked up together.
BYTES_AT_ONCE = 4 << 20
#: Bytes of a short chunk: two machine words. ``HEADS[n]`` keeps the first n bytes of one word.
SHORT = 16
HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: A blank and Latin letters: one piece for a byte-level tokenizer's pattern, whatever stands around it.
WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: Fixed values of byte-level vocabularies: visible bytes stand for themselves, the others, in order, for
#: the signs from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


class Known:
    """Short chunks, as two machine words and a size, and their ids; sorted by a mix of the words.

    The first entry is the empty chunk, which no text has.
    """

    def __init__(self):
        self.mixed = self.low = self.high = np.zeros(1, np.uint64)
        self.sizes, self.counts, self.used = np.zeros(1, np.uint8), np.zeros(1, np.uint8), np.ones(1, bool)
        self.starts, self.ids, self.end = np.zeros(1, np.int64), np.empty(1 << 16, np.uint16), 0

    def places(self, mixed: np.ndarray) -> np.ndarray:
        """Where each of ``mixed`` (sorted) is or would be."""
        return np.searchsorted(self.mixed, mixed)

    def holds(self, at: np.ndarray, mixed: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray):
        """Whether ``mixed`` is at its place, and whether the chunk there is the same."""
        near = np.minimum(at, len(self.mixed) - 1)
        there = self.mixed[near] == mixed
        return there, there & (self.low[near] == low) & (self.high[near] == high) & (self.sizes[near] == sizes)

    def add(self, at, mixed, low, high, sizes, found: list[bytes]) -> None:
        """New chunks at their places ``at``, with their ids as little-endian bytes of four each."""
        new = np.frombuffer(b"".join(found), "<u4")
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        if len(new) and int(new.max()) >= 1 << 16 and self.ids.dtype == np.uint16:
            self.ids = self.ids.astype(np.uint32)
        if self.end + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids) + len(new), self.ids.dtype)])
        self.ids[self.end : self.end + len(new)] = new
        starts = self.end + np.cumsum(counts) - counts
        self.end += len(new)
        for name, values in (("mixed", mixed), ("low", low), ("high", high), ("sizes", sizes), ("counts", counts), ("starts", starts), ("used", True)):
            setattr(self, name, np.insert(getattr(self, name), at, values))

    def shrink(self) -> None:
        """Keeps what was used since the last time; nothing where that is most of it."""
        keep = np.flatnonzero(self.used) if 2 * np.count_nonzero(self.used) <= CACHE else np.zeros(1, np.int64)
        old = Known()
        old.__dict__.update(self.__dict__)
        self.__init__()
        counts = old.counts[keep].astype(np.int64)
        self.starts, self.end = np.cumsum(counts) - counts, int(counts.sum())
        self.ids = np.append(old.ids[spread(old.starts[keep], counts)], np.empty(1 << 16, old.ids.dtype))
        for name in ("mixed", "low", "high", "sizes", "counts"):
            setattr(self, name, getattr(old, name)[keep])
        self.used = np.arange(len(keep)) == 0


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each run, one run after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 ``data`` where the tokenizer's own pattern always cuts.

    Before a blank or line feed behind a visible character, and between an ASCII letter or digit and
    a full stop or comma; never inside the string of a special token. Behind other characters than
    ASCII and those of two bytes, which may be blanks, nothing is cut.
    """
    before, here = data[:-1], data[1:]
    folded = before | 0x20
    wide = np.zeros(len(before), bool)
    wide[1:] = (before[1:] >= 0x80) & (before[:-1] >= 0xC3) & (before[:-1] <= 0xDF)
    visible = ((before > 0x20) & (before < 0x7F)) | wide
    alnum = ((folded >= 0x61) & (folded <= 0x7A)) | ((before >= 0x30) & (before <= 0x39))
    blank, stop = (here == 0x20) | (here == 0x0A), (here == 0x2E) | (here == 0x2C)
    return np.flatnonzero((blank & visible) | (stop & alnum)) + 1


class Encoder:
    """Ids by the tokenizers library; repeated chunks are encoded once per worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.ordinary = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # Cheaper, with equal ids for pieces without a special token's string.
        self.ordinary.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.ordinary.no_truncation()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        # A normalizer may make a special token's string of another one.
        self.special = re.compile("" if self.tokenizer.normalizer else "|".join(special) or r"(?!)")
        self.model = self._word_model()
        self.known = Known()
        self.long: dict[bytes, bytes] = {}

    def _word_model(self):
        """The library's merges alone, where a word passes the steps before them as one piece; else None."""
        from tokenizers import models, pre_tokenizers

        before, model = self.ordinary.pre_tokenizer, self.ordinary.model
        bytewise = isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space
        plain = self.ordinary.normalizer is None and isinstance(model, models.BPE) and model.dropout is None
        return model if bytewise and plain else None

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        held, size = [], 0
        for text in texts:
            held.append((text or "").encode())
            size += len(held[-1])
            if size >= BYTES_AT_ONCE:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Equal chunks are found by sorting machine words; each distinct one is looked up once."""
        data = b"".join(texts)
        ends = np.cumsum([0, *map(len, texts)])
        first = np.zeros(len(data) + 1, bool)
        first[ends[:-1]] = True
        first[cuts(np.frombuffer(data, np.uint8))] = True
        starts = np.flatnonzero(first[:-1])
        sizes = np.diff(starts, append=len(data))
        word = np.ndarray(len(data) + 8, "<u8", data + bytes(SHORT), strides=(1,))
        low = word[starts] & HEADS[np.minimum(sizes, 8)]
        high = word[starts + 8 * (sizes > 8)] & HEADS[np.clip(sizes - 8, 0, 8)]
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(1)) ^ high
        mixed ^= mixed >> np.uint64(29)
        mixed, shown, kind = np.unique(mixed, return_index=True, return_inverse=True)
        known = self.known
        at = known.places(mixed)
        there, same = known.holds(at, mixed, low[shown], high[shown], sizes[shown])
        fresh = ~there & (sizes[shown] <= SHORT)
        one = shown[fresh]
        found = self._ids([data[a:b] for a, b in zip(starts[one].tolist(), (starts[one] + sizes[one]).tolist())])
        known.add(at[fresh], mixed[fresh], low[one], high[one], sizes[one], found)
        at += np.cumsum(fresh) - fresh
        usable = same | fresh
        known.used[at[usable]] = True
        # Long chunks, and those whose mix of words only seems equal to another's, are looked up on their own.
        of_kind = shown[kind]
        alike = (low == low[of_kind]) & (high == high[of_kind]) & (sizes == sizes[of_kind]) & usable[kind] & (sizes <= SHORT)
        alone = np.flatnonzero(~alike)
        rest = self._long([data[a:b] for a, b in zip(starts[alone].tolist(), (starts[alone] + sizes[alone]).tolist())])
        at[~usable] = 0
        counts, begins = known.counts[at][kind].astype(np.int64), known.starts[at][kind]
        counts[alone] = np.fromiter(map(len, rest), np.int64, len(rest)) // 4
        ids = known.ids
        if len(alone):
            ids = np.concatenate([ids[: known.end], np.frombuffer(b"".join(rest), "<u4")])
            begins[alone] = known.end + np.cumsum(counts[alone]) - counts[alone]
        reached = np.append(0, np.cumsum(counts))
        ids = ids[spread(begins, counts)].astype(np.uint32, copy=False)
        bounds = reached[np.searchsorted(starts, ends)].tolist()
        if len(known.mixed) > CACHE:
            known.shrink()
        for a, b in zip(bounds, bounds[1:]):
            yield ids[a:b]

    def _long(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk, by the dictionary of long ones."""
        here = {chunk: self.long.get(chunk) for chunk in chunks}
        fresh = [chunk for chunk, ids in here.items() if ids is None]
        here.update(zip(fresh, self._ids(fresh)))
        if len(self.long) > CACHE_LONG:
            self.long = {}
        self.long.update((chunk, here[chunk]) for chunk in fresh if len(chunk) <= LONGEST)
        return [here[chunk] for chunk in chunks]

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk by the library, as little-endian bytes."""
        found: list[bytes] = [b""] * len(chunks)
        other = []
        for number, chunk in enumerate(chunks):
            text = chunk.decode()
            if self.special.search(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            elif self.model is not None and WORD.fullmatch(text):
                ids = [t.id for t in self.model.tokenize(chunk.decode("latin-1").translate(BYTE_SIGNS))]
            else:
                other.append((number, text))
                continue
            found[number] = array("I", ids).tobytes()
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            every = self.ordinary.encode_batch_fast([text for _, text in part], add_special_tokens=False)
            for (number, _), one in zip(part, every):
                found[number] = array("I", one.ids).tobytes()
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def record(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = struct.pack(HEAD, doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join(
        (length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)))
    )


def parse(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """The record at ``at``: doc_id, ids, and where the next one starts."""
    length = data[at : at + 8]
    if len(length) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(length):
        raise ValueError(f"damaged length at byte {at}")
    size = struct.unpack("<Q", length)[0]
    payload = data[at + 12 : at + 12 + size]
    if len(payload) < size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    doc_id, flags, width = struct.unpack_from(HEAD, payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(HEAD)).astype(np.uint32)
    return None if flags & 1 else doc_id, ids, at + 16 + size


def put(folder: str, name: str, data: bytes) -> None:
    """Writes a whole file and then gives it its name."""
    system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    system.create_dir(root, recursive=True)
    waiting = f"{root}/_waiting-{uuid4().hex}"
    with system.open_output_stream(waiting) as out:
        out.write(data)
    system.move(waiting, f"{root}/{name}")


def write(
    documents: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Writes ``documents`` under ``folder``; returns a row per file.

    Columns: ``part`` and ``file`` (numbers in doc_id order), ``records``,
    ``tokens``. ``folder`` must be on storage that all executors share. Memory
    holds one open file and one batch of texts.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer_path).encode
        data, index, size, tokens, number = [], [], 0, 0, 0

        def close() -> pd.DataFrame:
            nonlocal data, index, size, tokens, number
            name = f"part-{part:06d}-{number:06d}"
            put(folder, f"{name}.idx", b"".join(index))
            put(folder, f"{name}.rec", b"".join(data))
            row = pd.DataFrame({"part": [part], "file": [number], "records": [len(data)], "tokens": [tokens]})
            data, index, size, tokens, number = [], [], 0, 0, number + 1
            return row

        for batch in batches:
            ids_of = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            for doc_id, ids in zip(ids_of, encode(batch["text"].tolist())):
                ids = np.append(ids, np.uint32(end_id))
                doc_id = None if doc_id is None else int(doc_id)
                one = record(doc_id, ids)
                if data and size + len(one) > file_bytes:
                    yield close()
                index.append(struct.pack(ENTRY, doc_id or 0, doc_id is None, size, len(one) - 16, len(ids)))
                data.append(one)
                size += len(one)
                tokens += len(ids)
        if data:
            yield close()

    dealt = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(
        dealt.mapInPandas(build, "part int, file int, records long, tokens long"), "token-files"
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records in file order: ``part, file, place, doc_id, ids``; checks every checksum."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                part, file = map(int, re.search(r"part-(\d+)-(\d+)\.rec$", path).groups())
                rows, at = [], 0
                while at < len(content):
                    doc_id, ids, at = parse(content, at)
                    rows.append((part, file, len(rows), doc_id, ids.astype(np.int32)))
                frame = pd.DataFrame(rows, columns=["part", "file", "place", "doc_id", "ids"])
                yield frame.astype({"doc_id": "Int64"})

    return data_files(spark, folder).mapInPandas(build, "part int, file int, place long, doc_id long, ids array<int>")


def data_files(spark: SparkSession, folder: str, suffix: str = "rec") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder).select("path", "content")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """``path, doc_id, offset, length, n_tokens`` of every record, without reading data files."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = [
                    (path.removesuffix("idx") + "rec", None if flags & 1 else doc_id, offset, length, n)
                    for doc_id, flags, offset, length, n in struct.iter_unpack(ENTRY, content)
                ]
                yield pd.DataFrame(rows, columns=["path", "doc_id", "offset", "length", "n_tokens"])

    return data_files(spark, folder, "idx").mapInPandas(
        build, "path string, doc_id long, offset long, length long, n_tokens long"
    )


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """``doc_id, ids`` in a random order that ``seed`` fixes, one seek per record."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, offset, length in zip(batch["path"], batch["offset"], batch["length"]):
                system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                with system.open_input_file(name) as file:
                    file.seek(int(offset))
                    rows.append(parse(file.read(int(length) + 16))[:2])
            yield pd.DataFrame({"doc_id": [r[0] for r in rows], "ids": [r[1].astype(np.int32) for r in rows]})

    order = F.xxhash64("path", "offset", F.lit(seed))
    mixed = read_index(spark, folder).repartitionByRange(order).sortWithinPartitions(order)
    return mixed.mapInPandas(build, "doc_id long, ids array<int>")


def digests(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per record as read back: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all records before it: one sum per part reaches
    the driver, the rest is summed over each part's files.
    """
    parts = sorted(files.groupBy("part").agg(F.sum("tokens")).collect())
    before = dict(zip((p for p, _ in parts), accumulate((n for _, n in parts), initial=0)))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    first = files.select(
        F.format_string("part-%06d-%06d.rec", "part", "file").alias("name"),
        "part",
        F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("inside"),
    )

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, inside, content in zip(batch["part"], batch["inside"], batch["content"]):
                start, at, out = before[part] + inside, 0, []
                while at < len(content):
                    doc_id, ids, at = parse(content, at)
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                frame = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield frame.astype({"doc_id": "Int64"})

    named = data_files(spark, folder).withColumn("name", F.element_at(F.split("path", "/"), -1))
    # A row per 16 MB of data: the small side, broadcast while Spark measures it so.
    placed = named.join(first, "name").select("part", "inside", "content")
    return placed.mapInPandas(build, "doc_id long, start long, n_tokens long, ids_crc32 long")
