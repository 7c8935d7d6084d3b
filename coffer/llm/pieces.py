"""Sampled SentencePiece segmentations, and their lossless decoding.

A text's lattice has its UTF-8 bytes as nodes' gaps and the vocabulary's
pieces as edges. Forward filtering sums, for every node, the weights of all
segmentations up to it; backward sampling then walks from the end, choosing
each edge by its share of that sum, so a segmentation is drawn exactly in
proportion to its weight. Random numbers are a hash of the row key and the
place in the text: a row's sample does not depend on partitions or retries.

No piece has a blank after another character and none holds a line feed, so
the lattice falls apart into units (blanks and the word after them; line
feeds), and each distinct unit is filtered once for all its occurrences in a
group of texts. Within a group all steps run over all units at once.

Encoding keeps every byte: blanks are the blanks of the pieces (their U+2581
mark; a literal U+2581 is spelt in byte pieces), there is no dummy prefix and
no normalisation, and characters that no piece spells alone are byte pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.llm.common import kept_in_worker, tidied
from coffer.llm.shingles import mix

#: Bytes of a piece that the table of edges has room for at first; longer pieces widen it where a text has some.
MAX_PIECE = 16
_UNIT = re.compile(rb" *[^ \n]+| +|\n")
_GROUP = 1 << 19
#: Units of more bytes (base64, scripts without blanks) are filtered one by one, in windows of so many bytes.
_LONG, _WINDOW = 1 << 12, 1 << 16


class Pieces:
    """The vocabulary as byte strings, weights and a dense trie."""

    def __init__(self, model_file: str, temperature: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.surface: list[bytes] = [b""] * n
        self.logs = np.full(n + 1, -np.inf)
        bytes_at = np.full(256, -1, "i4")
        words: dict[bytes, int] = {}
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            # vocabularies are ordered by frequency: a Zipf weight by rank
            self.logs[i] = -np.log(i + 2.0) / temperature
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.surface[i] = bytes([value])
                bytes_at[value] = i
            else:
                self.surface[i] = piece.replace("▁", " ").encode()
                words.setdefault(self.surface[i], i)
        if (bytes_at < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.byte_ids = bytes_at
        self.lengths = np.array([len(s) for s in self.surface], "i8")
        self.pool = np.frombuffer(b"".join(self.surface), "u1")
        self.at = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.widest = max(map(len, words), default=1)
        self.words, self.next = words, None

    def _trie(self) -> None:
        """The dense trie, made for the first text: decoding needs none."""
        words = self.words
        used = sorted({c for w in words for c in w})
        self.classes = np.zeros(256, "i4")  # class 0: bytes of no piece
        for k, c in enumerate(used):
            self.classes[c] = k + 1
        nodes: list[dict[int, int]] = [{}]
        ends = [-1]
        for w, i in words.items():
            v = 0
            for c in w:
                if c not in nodes[v]:
                    nodes[v][c] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                v = nodes[v][c]
            ends[v] = i
        # nodes that go on come first, so that the others share one empty row
        order = sorted(range(len(nodes)), key=lambda v: (not nodes[v], v))
        place = {v: k for k, v in enumerate(order)}
        self.inner = sum(map(bool, nodes))
        self.next = np.zeros((self.inner + 1, len(used) + 1), "i4")  # 0: none, as nothing leads to the root
        for v, d in enumerate(nodes):
            for c, u in d.items():
                self.next[place[v], self.classes[c]] = place[u]
        self.ends = np.array([ends[v] for v in order], "i2" if len(self.surface) < 1 << 15 else "i4")

    def edges(self, data: np.ndarray, unit_end: np.ndarray) -> np.ndarray:
        """ids[i, l - 1]: the piece of the l bytes from i on, -1 if there is none; as wide as the widest."""
        if self.next is None:
            self._trie()
        n = len(data)
        out = np.full((n, min(MAX_PIECE, self.widest)), -1, self.ends.dtype)
        classes = self.classes[data]
        active = np.arange(n)
        node = np.zeros(n, "i4")
        for k in range(self.widest):
            node = self.next[np.minimum(node, self.inner), classes[active + k]]
            inside = node > 0
            active, node = active[inside], node[inside]
            if k == out.shape[1] and len(active):
                out = np.pad(out, ((0, 0), (0, self.widest - k)), constant_values=-1)
            if len(active):
                out[active, k] = self.ends[node]
            going = active + k + 1 < unit_end[active]
            active, node = active[going], node[going]
            if not len(active):
                break
        # characters without a piece of their own are spelt in byte pieces
        lead = (data & 0xC0) != 0x80
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        starts = np.flatnonzero(lead)
        alone = out[starts, width[starts] - 1] >= 0
        spelt = np.repeat(~alone, np.diff(np.concatenate((starts, [n]))))
        out[spelt, 0] = self.byte_ids[data[spelt]]
        widest = int(np.flatnonzero((out >= 0).any(axis=0))[-1]) + 1
        return np.ascontiguousarray(out[:, :widest])


_UP, _SMALL = 2.0**600, 2.0**-500


class Sampler:
    def __init__(self, pieces: Pieces, seed: int):
        self.pieces, self.seed = pieces, np.uint64(seed & 0xFFFFFFFFFFFFFFFF)

    def _filter(self, units: list[bytes]):
        """For distinct units: edges, and by node the cumulative shares of the edges that end there."""
        sizes = np.array([len(u) for u in units])
        base = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        data = np.frombuffer(b"".join(units), "u1")
        ids = self.pieces.edges(data, np.repeat(base + sizes, sizes))
        logs = np.append(self.pieces.logs, -np.inf)
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max())
        long_enough = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), "right")  # units of at least j bytes
        sums = np.full(len(data) + len(units), -np.inf)  # by node: byte place + number of the unit
        node = base + np.arange(len(units))
        sums[node] = 0.0
        most = ids.shape[1]
        shares = np.zeros((len(data), most), "f4")  # of the node after each byte
        for j in range(1, longest + 1):
            u = order[: long_enough[j - 1]]
            widths = np.arange(1, min(most, j) + 1)
            edge = ids[(base[u] + j)[:, None] - widths, widths - 1]
            used = np.flatnonzero((edge >= 0).any(axis=0))  # most widths are rare
            if not len(used):
                continue  # inside a character everywhere
            part = sums[(node[u] + j)[:, None] - widths[used]] + logs[edge[:, used]]
            top = part.max(axis=1)
            reached = np.isfinite(top)
            top[~reached] = 0.0  # a place inside a character: no segmentation ends here
            mass = np.exp((part - top[:, None]).astype("f4"))
            total = mass.sum(axis=1)
            total[~reached] = 1.0
            sums[node[u] + j] = np.where(reached, top + np.log(total), -np.inf)
            full = np.zeros((len(u), most), "f4")
            full[:, used] = mass / total[:, None]
            full = np.cumsum(full, axis=1)
            # the widest edge takes what rounding leaves
            widest = used[len(used) - 1 - (mass[:, ::-1] > 0).argmax(axis=1)]
            full[np.arange(most) >= widest[:, None]] = 1.0
            shares[base[u] + j - 1] = full
        return sizes, base, ids, shares

    def _draw(self, which: np.ndarray, keys: np.ndarray, filtered) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all unit occurrences in order, and how many each has.

        ``which`` are their numbers among the distinct units, ``keys`` their random keys."""
        sizes, base, ids, shares = filtered
        left, active, steps = sizes[which].copy(), np.arange(len(which)), []
        n = np.zeros(len(which), "i8")
        while len(active):
            at = base[which[active]] + left[active]
            r = (mix(keys[active] + left[active].astype("u8")) >> np.uint64(40)).astype("f4") / np.float32(1 << 24)
            width = (shares[at - 1] <= r[:, None]).sum(axis=1) + 1
            steps.append((active, ids[at - width, width - 1]))
            n[active] += 1
            left[active] -= width
            active = active[left[active] > 0]
        ends = np.cumsum(n)
        out = np.empty(int(ends[-1]) if len(ends) else 0, "i4")
        for k, (a, piece) in enumerate(steps):
            out[ends[a] - 1 - k] = piece
        return out, n

    def _edges_of(self, data: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, width and piece of the edges that start at lo (a character's first byte) up to hi, by start."""
        part = data[lo : min(len(data), hi + self.pieces.widest)]
        ids = self.pieces.edges(part, np.full(len(part), len(part)))[: hi - lo]
        start, width = np.nonzero(ids >= 0)
        return start + lo, width + 1, ids[start, width]

    def _long(self, unit: bytes, keys: list[int]) -> list[np.ndarray]:
        """Piece ids of a long unit for each random key.

        As ``_filter`` and ``_draw``, but byte by byte in windows: only the
        sum at each byte is kept. Sums are scaled up by _UP whenever they get
        small; ``scale`` counts how often, so that shares are exact.
        """
        data = np.frombuffer(unit, "u1")
        n, widest = len(data), self.pieces.widest
        weights = np.exp(self.pieces.logs)
        cuts = [0]
        while cuts[-1] < n:  # windows end before a character
            end = min(n, cuts[-1] + _WINDOW)
            while end < n and data[end] & 0xC0 == 0x80:
                end += 1
            cuts.append(end)
        sums, scale, ups = array("d", bytes(8 * (n + 1))), array("i", bytes(4 * (n + 1))), 0
        sums[0] = 1.0
        for lo, hi in pairwise(cuts):
            start, width, piece = self._edges_of(data, lo, hi)
            first = np.searchsorted(start, np.arange(lo, hi + 1)).tolist()
            width, weight = width.tolist(), weights[piece].tolist()
            for i in range(lo, hi):
                here = sums[i]
                if 0 < here < _SMALL:
                    ups += 1
                    for j in range(i, min(n, i + widest) + 1):
                        sums[j] *= _UP
                    here = sums[i]
                scale[i] = ups
                if here:
                    for k in range(first[i - lo], first[i - lo + 1]):
                        sums[i + width[k]] += here * weight[k]
        scale[n] = ups
        drawn: list[list[int]] = [[] for _ in keys]
        left = [n] * len(keys)
        for lo, hi in reversed(list(pairwise(cuts))):
            near = max(0, lo - widest)
            while near and data[near] & 0xC0 == 0x80:
                near -= 1
            start, width, piece = self._edges_of(data, near, hi)
            end = start + width
            by_end = np.lexsort((width, end))
            by_end = by_end[(end[by_end] > lo) & (end[by_end] <= hi)]
            first = np.searchsorted(end[by_end], np.arange(lo + 1, hi + 2)).tolist()
            width, piece = width[by_end], piece[by_end]
            width, weight, piece = width.tolist(), weights[piece].tolist(), piece.tolist()
            for d, key in enumerate(keys):
                places = np.arange(lo + 1, hi + 1, dtype="u8")
                r = ((mix(np.uint64(key) + places) >> np.uint64(40)).astype("f8") / (1 << 24)).tolist()
                j, out = left[d], drawn[d]
                while j > lo:
                    want, seen, chosen = r[j - lo - 1] * sums[j], 0.0, -1
                    for k in range(first[j - lo - 1], first[j - lo]):
                        i = j - width[k]
                        if sums[i]:
                            chosen = k  # the widest edge takes what rounding leaves
                            seen += sums[i] * weight[k] * _UP ** (scale[j] - scale[i])
                            if seen > want:
                                break
                    out.append(piece[chosen])
                    j -= width[chosen]
                left[d] = j
        return [np.array(x[::-1], "i4") for x in drawn]

    def _units(self, units: list[bytes], which: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all unit occurrences in order, and how many each has."""
        long = np.array([len(u) > _LONG for u in units])
        if not long.any():
            return self._draw(which, keys, self._filter(units))
        n = np.zeros(len(which), "i8")
        short = ~long[which]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if short.any():
            number = np.cumsum(~long) - 1
            out, n[short] = self._draw(
                number[which[short]], keys[short], self._filter([u for u, x in zip(units, long, strict=True) if not x])
            )
            found.append((np.flatnonzero(short), out))
        for u in np.flatnonzero(long):
            at = np.flatnonzero(which == u)
            drawn = self._long(units[u], keys[at].tolist())
            n[at] = [len(x) for x in drawn]
            found.append((at, np.concatenate(drawn)))
        begin = np.cumsum(n) - n
        whole = np.empty(int(n.sum()), "i4")
        for at, out in found:
            here = n[at]
            whole[np.repeat(begin[at] - (np.cumsum(here) - here), here) + np.arange(len(out))] = out
        return whole, n

    def encode(self, texts: list[bytes], keys: np.ndarray) -> Iterator[np.ndarray]:
        """Piece ids of each text; ``keys`` are the rows' 64-bit keys."""
        k = 0
        while k < len(texts):
            stop, size = k, 0
            while stop < len(texts) and (stop == k or size + len(texts[stop]) <= _GROUP):
                size += len(texts[stop])
                stop += 1
            split = [_UNIT.findall(t) for t in texts[k:stop]]
            counts = np.array([len(x) for x in split])
            number = dict(zip(dict.fromkeys(chain.from_iterable(split)), count()))
            which = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), "i8", int(counts.sum()))
            if len(which):
                first = np.cumsum(counts) - counts
                place = np.arange(len(which)) - np.repeat(first, counts)
                row = mix(keys[k:stop].astype("u8") ^ self.seed)
                key = mix(np.repeat(row, counts) + place.astype("u8") * np.uint64(0x9E3779B97F4A7C15))
                out, n = self._units(list(number), which, key)
                ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum(counts)]
            else:
                out, ends = np.empty(0, "i4"), np.zeros(stop - k, "i8")
            yield from np.split(out, ends[:-1])
            k = stop


def decode_ids(pieces: Pieces, ids: np.ndarray) -> bytes:
    n = pieces.lengths[ids]
    ends = np.cumsum(n)
    if not len(ids) or not ends[-1]:
        return b""
    return pieces.pool[np.repeat(pieces.at[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


def load(model_file: str, temperature: float = 1.0) -> Pieces:
    """One vocabulary per Python worker."""
    return kept_in_worker((model_file, temperature), lambda: Pieces(model_file, temperature))


def encode(
    docs: DataFrame, model_file: str, seed: int = 17, temperature: float = 1.0, key: str = "doc_id"
) -> DataFrame:
    """``docs`` with piece_ids array<int>, n_pieces and ids_crc32 (of little-endian uint32 ids).

    The sample depends on the seed, the row key and the text only; repeated
    rows get the same one, null keys share one. A null or empty text has no
    pieces. Columns of these names are replaced.
    """
    added = ["piece_ids", "n_pieces", "ids_crc32"]
    cols = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    names = [c for c in docs.columns if c.lower() not in added]
    keyed = docs.select(*cols, F.xxhash64(F.col(key)).alias("__key"))

    @tidied
    def run(batches):
        sampler = Sampler(load(model_file, temperature), seed)
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                b = big.slice(at, 1000)
                texts = [(t or "").encode() for t in b.column("text").to_pylist()]
                ids = list(sampler.encode(texts, b.column("__key").to_numpy(zero_copy_only=False).view("u8")))
                n = np.array([len(x) for x in ids], "i8")
                offsets = np.concatenate(([0], np.cumsum(n))).astype("i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c) for c in names),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, "i4"))),
                        pa.array(n),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    ],
                    [*names, *added],
                )

    schema = keyed.drop("__key").schema
    schema = schema.add("piece_ids", T.ArrayType(T.IntegerType())).add("n_pieces", "long").add("ids_crc32", "long")
    return keyed.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str, out: str = "decoded") -> DataFrame:
    """``encoded`` with the text that piece_ids spell as column ``out``; null ids give null.

    Ids outside the vocabulary are an error; bytes that are no UTF-8 text
    (ids that no encoding gave) decode to replacement characters.
    """
    names = [c for c in encoded.columns if c != out]

    @tidied
    def run(batches):
        pieces = load(model_file)
        for b in batches:
            ids = b.column("piece_ids")
            texts = [
                None if x is None else decode_ids(pieces, np.asarray(x, "i8")).decode("utf-8", "replace")
                for x in (v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in ids)
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string())], [*names, out])

    kept = encoded.select(*[F.col(f"`{c}`") for c in names])
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))


def round_trip(docs: DataFrame, model_file: str, seed: int = 17, temperature: float = 1.0) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, n_chars and lossless (the decoded ids equal the text) per input row."""
    encoded = encode(docs.select("doc_id", "text"), model_file, seed, temperature)
    text = F.coalesce("text", F.lit(""))
    return decode(encoded, model_file).select(
        "doc_id", "n_pieces", "ids_crc32", F.length(text).cast("long").alias("n_chars"), (F.col("decoded") == text).alias("lossless")
    )
