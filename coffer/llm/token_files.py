"""Token ids as binary files of independent Zstandard frames.

File layout, little-endian throughout; any Zstandard reader can decode it, as
the tables are skippable frames:

* data frames: each the Zstandard form of ``frame_ids`` unsigned 32-bit token
  ids (the last one of what is left); the frames joined are the ids of the
  file's documents in ascending doc_id order;
* document table (skippable, magic 0x184D2A50): a Zstandard frame of n int64
  doc_ids, n bytes that say whether the doc_id is null, and n + 1 uint64
  starts in ids;
* seek table (skippable, magic 0x184D2A5E): one entry per frame before it of
  compressed size, decompressed size and checksum (low 32 bits of xxh64 of the
  decompressed bytes), then the frame count, descriptor 0x80 and 0x8F92EAB1,
  as in the public seekable format.

A reader finds a document's ids by two small reads from the file's end and
decompresses only the frames that hold them.

Each writing task gives its file a name of its own and only files that the
committed manifest names count, so a retried or duplicated task does no harm.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import saved, shared_path, shuffle_partitions
from coffer.llm.shingles import mix

DOC_MAGIC, SEEK_MAGIC, END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_IDS = 1 << 16
END_ID = 2
#: Texts of these characters only are split before encoding; others are encoded whole.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")
#: Slots of a worker's piece cache (16 + 5 bytes each) and token ids kept for them (4 bytes each).
SLOTS, KEPT_IDS = 1 << 21, 1 << 23
SEGMENT = 1 << 18


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def segments(text: str) -> Iterator[str]:
    """The text in parts of about half SEGMENT characters, cut only where a piece starts:
    at a space between two characters that are no white space."""
    at = 0
    while len(text) - at > SEGMENT:
        end = at + SEGMENT // 2
        while end < len(text) and not (
            text[end] == " " and not text[end - 1].isspace() and not text[end + 1 : end + 2].isspace()
        ):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _kinds() -> np.ndarray:
    out = np.zeros(0x250, "u1")  # 0: other
    for c in range(0x250):
        x = chr(c)
        out[c] = 1 if x.isspace() else 2 if x.isalpha() else 3 if x in "0123456789" else 0
    return out


_KIND = _kinds()
_BASES = (0x9E3779B97F4A7C15 | 3, 0xD1342543DE82EF95 | 3)


def _powers(base: int) -> np.ndarray:
    out = np.full(SEGMENT + 1, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def piece_starts(points: np.ndarray, joined: str, first: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-splitting rule starts a piece, in texts of ``PLAIN``
    characters joined without separators; ``first`` are the texts' starts."""
    n = len(points)
    kind = _KIND[points]
    fresh = np.zeros(n + 1, bool)
    fresh[first] = True  # also at n, where the last texts may be empty
    fresh[n] = True
    run = fresh[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # the last white space before other characters of its text: a blank goes with them
    last = np.flatnonzero((kind[:-1] == 1) & (kind[1:] != 1) & ~fresh[1:n]) if n > 1 else np.empty(0, "i8")
    start[last] = True
    start[last + 1] = points[last] != 32
    # contractions: an apostrophe that starts a piece alone, with a letter after it
    for i in np.flatnonzero((points == 39) & start):
        if i + 1 < n and run[i + 1] and not fresh[i + 1] and kind[i + 1] == 2:
            for tail in _CONTRACTIONS:
                if joined.startswith(tail, i + 1) and not fresh[i + 2 : i + 1 + len(tail)].any():
                    start[i + 1] = False
                    if i + 1 + len(tail) < n:
                        start[i + 1 + len(tail)] = True
                    break
    return np.flatnonzero(start)


class Encoder:
    """The tokenizers library, with frequent pieces encoded once.

    No merge crosses the pieces of a byte-level tokenizer's pre-splitting
    rule, so a text's ids are its pieces' ids joined. Groups of texts are
    split and looked up in array operations; pieces are known by two 64-bit
    hashes, in a cache of fixed size whose slots go to those seen first. Only
    texts of ``PLAIN`` characters are split here; others, where Unicode tables
    of two engines may differ, texts that hold an added token's content and
    texts for other tokenizers are encoded whole.

    With ``text_only``, special tokens in a text are spelt like any other text.
    """

    def __init__(self, tokenizer_file: str, text_only: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = text_only
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens") or () if not (text_only and x["special"])]
        rule = spec.get("pre_tokenizer") or {}
        self.splits = (
            rule.get("type") == "ByteLevel"
            and rule.get("use_regex", True)
            and not rule.get("add_prefix_space", True)
            and not spec.get("normalizer")
            # pieces of a space and letters are joined for encoding
            and not any(x.replace(" ", "").isalpha() for x in self.added)
        )
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that start with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("\u0120")
        if self.splits:
            self.up = [_powers(b) for b in _BASES]
            self.down = [_powers(pow(b, -1, 1 << 64)) for b in _BASES]
            self.keys = np.zeros((2, SLOTS), "u8")
            self.at, self.n = np.zeros(SLOTS, "i4"), np.zeros(SLOTS, "u1")
            self.kept, self.used = np.zeros(KEPT_IDS, "<u4"), 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, joined, and how many each has. Those of a space and
        letters are encoded as one text: each starts a piece there too, and at a
        token that starts with a space."""
        spaced = np.array([x[0] == " " and x[1:].isalpha() for x in pieces], bool)
        out = np.empty(len(pieces), object)
        rest = [x for x, s in zip(pieces, spaced, strict=True) if not s]
        if rest:
            out[~spaced] = self._whole(rest)
        if spaced.any():
            ids = np.frombuffer(self._whole(["".join(x for x, s in zip(pieces, spaced, strict=True) if s)])[0], "<u4")
            data = ids.tobytes()
            cuts = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), len(data)]
            out[spaced] = [data[s:e] for s, e in pairwise(cuts)]
        return np.frombuffer(b"".join(out.tolist()), "<u4"), np.array([len(x) // 4 for x in out], "i8")

    def _split(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of texts of PLAIN characters."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "u4")
        first = np.cumsum([0, *map(len, texts)])
        if not len(points):
            yield from (np.empty(0, "<u4") for _ in texts)
            return
        starts = piece_starts(points, joined, first)
        ends = np.append(starts[1:], len(points))
        hashes = []
        for up, down in zip(self.up, self.down, strict=True):
            sums = np.zeros(len(points) + 1, "u8")
            np.cumsum((points + np.uint64(1)) * up[: len(points)], out=sums[1:])
            hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype("u8")) | np.uint64(1))
        slot = (hashes[0] >> np.uint64(64 - SLOTS.bit_length() + 1)).astype("i8")
        hit = (self.keys[0, slot] == hashes[0]) & (self.keys[1, slot] == hashes[1])
        at, n = self.at[slot].astype("i8"), self.n[slot].astype("i8")
        pool = self.kept
        miss = np.flatnonzero(~hit)
        if len(miss):
            order = miss[np.lexsort((hashes[1][miss], hashes[0][miss]))]
            new = np.concatenate(([True], (np.diff(hashes[0][order]) != 0) | (np.diff(hashes[1][order]) != 0)))
            which = order[new]
            ids, size = self._pieces([joined[s:e] for s, e in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])
            place = np.cumsum(size) - size
            if self.used + len(ids) <= KEPT_IDS:  # else the cache stays as it is
                self.kept[self.used : self.used + len(ids)] = ids
                place += self.used
                self.used += len(ids)
                free = np.flatnonzero((self.keys[0, slot[which]] == 0) & (size < 256))
                free = free[np.unique(slot[which[free]], return_index=True)[1]]  # one per slot
                taken = slot[which[free]]
                for k in (0, 1):
                    self.keys[k, taken] = hashes[k][which[free]]
                self.at[taken], self.n[taken] = place[free], size[free]
            else:
                pool = np.concatenate((self.kept[: self.used], ids))
                place += self.used
            group = np.cumsum(new) - 1
            at[order], n[order] = place[group], size[group]
        total = np.cumsum(n)
        out = pool[np.repeat(at - (total - n), n) + np.arange(total[-1])]
        cuts = np.concatenate(([0], total))[np.searchsorted(starts, first)]
        yield from (out[s:e] for s, e in pairwise(cuts.tolist()))

    def _plain(self, text: str) -> bool:
        return self.splits and PLAIN.fullmatch(text) is not None and not any(x in text for x in self.added)

    def _group(self, group: list[tuple[int, str, bool]]) -> Iterator[tuple[int, bytes, bool]]:
        # a part without a place to cut may be longer than the tables of powers
        plain = [len(x) <= SEGMENT and self._plain(x) for _, x, _ in group]
        split = self._split([x for (_, x, _), p in zip(group, plain, strict=True) if p]) if any(plain) else iter(())
        for (k, text, last), p in zip(group, plain, strict=True):
            yield k, next(split).tobytes() if p else self._whole([text])[0], last

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes, bool]]:
        """(place of the text, little-endian uint32 ids, whether they are its last) in order."""
        group, size = [], 0
        for k, text in enumerate(texts):
            parts = list(segments(text)) if len(text) > SEGMENT and self._plain(text) else [text]
            for j, part in enumerate(parts):
                if size and size + len(part) > SEGMENT:
                    yield from self._group(group)
                    group, size = [], 0
                group.append((k, part, j == len(parts) - 1))
                size += len(part)
        yield from self._group(group)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _encoder(tokenizer_file: str, text_only: bool) -> Encoder:
    """One encoder per Python worker, so that its pieces serve later tasks too."""
    key = (tokenizer_file, text_only)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokenizer_file, text_only)
    return _ENCODERS[key]


class Writer:
    """One file; ids are appended in parts, documents end with ``end_document``."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        self.out, self.frame_bytes = out, 4 * frame_ids
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.left, self.entries = bytearray(), []
        self.doc_ids, self.nulls, self.starts, self.n = [], bytearray(), [0], 0

    def add(self, ids: bytes) -> None:
        self.left += ids
        self.n += len(ids) // 4
        whole = len(self.left) // self.frame_bytes * self.frame_bytes
        if whole:
            for at in range(0, whole, self.frame_bytes):
                self._frame(bytes(self.left[at : at + self.frame_bytes]))
            del self.left[:whole]

    def end_document(self, doc_id: int | None) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.n)

    def _frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.left:
            self._frame(bytes(self.left))
        table = np.array(self.doc_ids, "<i8").tobytes() + bytes(self.nulls) + np.array(self.starts, "<u8").tobytes()
        packed = struct.pack("<Q", len(self.doc_ids)) + self.zstd.compress(table)
        self.out.write(struct.pack("<II", DOC_MAGIC, len(packed)) + packed)
        self.entries.append((len(packed) + 8, 0, xxhash.xxh64_intdigest(table) & 0xFFFFFFFF))
        seek = b"".join(struct.pack("<III", *e) for e in self.entries)
        seek += struct.pack("<IBI", len(self.entries), 0x80, END_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)


class Reader:
    """Random access to one file; every frame is checked against its checksum."""

    def __init__(self, f):
        self.f, self.zstd = f, zstandard.ZstdDecompressor()
        size = f.size()
        n, kind, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != END_MAGIC or kind != 0x80:
            raise ValueError("no seek table")
        self.entries = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate(([0], np.cumsum(self.entries[:, 0].astype("int64"))))
        packed = self._at(int(self.offsets[-2]) + 8, int(self.entries[-1, 0]) - 8)
        (docs,) = struct.unpack("<Q", packed[:8])
        table = self.zstd.decompress(packed[8:], max_output_size=17 * docs + 8)
        self._check(table, len(self.entries) - 1)
        self.doc_ids = np.frombuffer(table, "<i8", docs)
        self.nulls = np.frombuffer(table, "u1", docs, 8 * docs)
        self.starts = np.frombuffer(table, "<u8", docs + 1, 9 * docs).astype("int64")
        self.frame_bytes = int(self.entries[0, 1]) if len(self.entries) > 1 else 4
        self.latest: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def _check(self, data: bytes, k: int) -> None:
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.entries[k, 2]):
            raise ValueError(f"frame {k}: checksum differs")

    def frame(self, k: int) -> bytes:
        if self.latest[0] != k:
            packed = self._at(int(self.offsets[k]), int(self.entries[k, 0]))
            data = self.zstd.decompress(packed, max_output_size=int(self.entries[k, 1]))
            self._check(data, k)
            self.latest = (k, data)
        return self.latest[1]

    def ids(self, i: int) -> Iterator[bytes]:
        """The i-th document's ids, frame by frame, as bytes."""
        at, end = 4 * int(self.starts[i]), 4 * int(self.starts[i + 1])
        while at < end:
            k, skip = divmod(at, self.frame_bytes)
            part = self.frame(k)[skip : skip + end - at]
            yield part
            at += len(part)


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_file: str,
    end_id: int = END_ID,
    frame_ids: int = FRAME_IDS,
    text_only: bool = True,
) -> DataFrame:
    """Writes all documents as token files; returns the manifest (part, path, n_docs, n_ids).

    Files follow each other in ascending doc_id order (null doc_ids first).
    A null text is encoded as an empty one: its end id only. An empty table
    gives an empty manifest. ``text_only`` as for ``Encoder``.
    """
    spark = docs.sparkSession
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_tie"))
    ranged = cols.repartitionByRange(shuffle_partitions(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    end = struct.pack("<I", end_id)

    def write(batches):
        writer = stream = path = None
        encoder = _encoder(tokenizer_file, text_only)
        part = TaskContext.get().partitionId()
        for b in batches:
            if writer is None and b.num_rows:
                path = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.bin"
                fs, name = filesystem(path)
                fs.create_dir(name.rpartition("/")[0], recursive=True)
                stream = fs.open_output_stream(name)
                writer = Writer(stream, frame_ids)
            doc_ids = b.column("doc_id").to_pylist()
            for k, ids, last in encoder.encode([x or "" for x in b.column("text").to_pylist()]):
                writer.add(ids)
                if last:
                    writer.add(end)
                    writer.end_document(doc_ids[k])
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": len(writer.doc_ids), "n_ids": writer.n}])

    return saved(ranged.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files.

    ``start`` counts the ids of all documents before it, over all files; one
    task reads one file, frame by frame.
    """
    spark = manifest.sparkSession
    files = manifest.orderBy("part").collect()  # one row per file
    base = [0, *accumulate(f["n_ids"] for f in files)]
    listed = spark.createDataFrame([(base[i], f["path"]) for i, f in enumerate(files)], "base long, path string")

    def read(batches):
        for b in batches:
            for at, path in zip(b.column("base").to_pylist(), b.column("path").to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    r = Reader(f)
                    for lo in range(0, len(r.doc_ids), 10_000):
                        rows = range(lo, min(lo + 10_000, len(r.doc_ids)))
                        sums = []
                        for i in rows:
                            crc = 0
                            for part in r.ids(i):
                                crc = zlib.crc32(part, crc)
                            sums.append(crc)
                        starts = r.starts[lo : rows.stop + 1]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(r.doc_ids[lo : rows.stop], mask=r.nulls[lo : rows.stop].astype(bool)),
                                pa.array(at + starts[:-1]),
                                pa.array(np.diff(starts)),
                                pa.array(sums, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return listed.repartition(max(1, len(files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, text_only: bool = False) -> DataFrame:
    """Writes the documents' token files to the shared folder and reads them back.

    The ids are those of the library's ``encode(text, add_special_tokens=False)``,
    which takes a special token's content in a text for that token.
    """
    folder = shared_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer_file, end_id, text_only=text_only))
