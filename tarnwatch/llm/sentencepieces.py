"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is indexed as its distinct words (nothing is kept between batches): they are
concatenated, their suffixes sorted, and every piece of the vocabulary binary-searched for its
range of occurrences.  The ranges give all edges (position, length, piece) of the batch, which
are put in order of position.  Words are then relaxed over these edges.

For a unigram model the relaxation would be the best path by summed scores.  The vocabulary
file here is of the BPE kind, where that path differs from the library's ids, so the edges
are relaxed in order of merge priority instead: of all adjacent tokens of a word whose union
is an edge, the one of the best score (leftmost of equals) is joined until none is left.
That gives the library's ids exactly; characters outside the vocabulary become byte pieces.

The model is read with the sentencepiece library: identity normalisation, one space before the
text, spaces as U+2581.  Other normalisers are refused.

What is held follows ``SUFFIX_CHARS``: a longer word (a text without spaces, say) is indexed window
by window and parted where no edge of two or more characters crosses; only a stretch that pieces
chain together without such a place is held whole, about 200 bytes a character.

Defined cases: null and empty texts have no ids and decode to the empty text; very long words
are relaxed with a heap; a text of white space only keeps each space; repeated rows are
encoded each for itself; :func:`encode` passes the columns named in ``keep`` on, but for those whose
names are its own; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches
from .textbytes import blocks, column_bytes, tidy
from .wordcache import WordCache

SPACE = "▁"
SUFFIX_CHARS = 1 << 17
HEAP_CHARS = 96
BLOCK_BYTES = 1 << 21
_FAR = np.iinfo(np.int64).max


class SuffixMatcher:
    """Edges of all pieces in a concatenated text."""

    def __init__(self, pieces: list[str], numbers: list[int]):
        self.numbers = np.array(numbers, np.int32)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.longest = max(16, -(-int(self.sizes.max()) // 4) * 4)
        alphabet = sorted({c for p in pieces for c in p})
        if len(alphabet) >= 0xFFFE:
            raise ValueError("alphabet of over 65,533 characters")
        self.alphabet = np.array([ord(c) for c in alphabet], np.int64)
        table = np.zeros((len(pieces), self.longest), np.uint64)
        for i, p in enumerate(pieces):
            table[i, : len(p)] = self.ranks(np.array([ord(c) for c in p]))
        mask = np.arange(self.longest)[None, :] < self.sizes[:, None]
        self.low, self.high = self._pack(table), self._pack(np.where(mask, table, np.uint64(0xFFFF)))

    def ranks(self, chars: np.ndarray) -> np.ndarray:
        """1.. for characters of the alphabet, 0 for all others."""
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == chars, at + 1, 0).astype(np.uint64)

    @staticmethod
    def _pack(table: np.ndarray) -> list[np.ndarray]:
        return [(table[:, k] << np.uint64(48)) | (table[:, k + 1] << np.uint64(32)) | (table[:, k + 2] << np.uint64(16)) | table[:, k + 3] for k in range(0, table.shape[1], 4)]

    def edges(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Array (position, length) -> piece number, -1 where there is none: the edges by position; and the longest of each."""
        n, r = len(chars), self.ranks(chars)
        padded = np.concatenate([r, np.zeros(self.longest + 4, np.uint64)])
        four = (padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:]
        # suffixes sorted by their first `longest` characters: ranks of 4 characters, then doubled
        rank = np.unique(four, return_inverse=True)[1].astype(np.int64)
        width = 4
        while True:
            second = np.concatenate([rank[width:], np.zeros(width, np.int64)])
            rank, width = rank * (int(second.max()) + 1) + second, 2 * width
            if width >= self.longest:
                break
            rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        order = np.argsort(rank[:n])
        keys = [four[np.minimum(order + k, len(four) - 1)] for k in range(0, self.longest, 4)]
        low, high = np.searchsorted(keys[0], self.low[0], "left"), np.searchsorted(keys[0], self.high[0], "right")
        longer = np.flatnonzero((self.sizes > 4) & (high > low))
        low[longer], high[longer] = self._bound(keys, self.low, longer, low[longer], high[longer], False), self._bound(keys, self.high, longer, low[longer], high[longer], True)
        count = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(count)), count)
        where = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        out = np.full((n, self.longest + 1), -1, np.int32)
        out[where, self.sizes[piece]] = self.numbers[piece]
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, where, self.sizes[piece])
        return out, longest

    @staticmethod
    def _bound(keys, wanted, rows, low, high, after: bool):
        low, high = low.copy(), high.copy()
        left = np.flatnonzero(low < high)
        while len(left):
            mid = (low[left] + high[left]) // 2
            down, open_ = np.zeros(len(left), bool), np.ones(len(left), bool)
            for k, w in zip(keys[1:], wanted[1:], strict=True):
                a, b = k[mid], w[rows[left]]
                down |= open_ & (a < b)
                open_ &= a == b
            if after:
                down |= open_
            low[left] = np.where(down, mid + 1, low[left])
            high[left] = np.where(down, high[left], mid)
            left = left[low[left] < high[left]]
        return low


class PieceEncoder(WordCache):
    def __init__(self, model_file: str, suffix_chars: int = SUFFIX_CHARS):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        how = model.normalizer_spec
        if how.precompiled_charsmap or how.remove_extra_whitespaces or not how.add_dummy_prefix or model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        super().__init__("<u2" if len(model.pieces) <= 65536 else "<u4", 0)
        self.suffix_chars = suffix_chars
        normal = [(p.piece, i) for i, p in enumerate(model.pieces) if p.type == 1]
        inner = [p for p, _ in normal if SPACE in p.lstrip(SPACE)]
        if inner or any("\n" in p for p, _ in normal):
            raise ValueError("pieces that cross words")
        self.matcher = SuffixMatcher([p for p, _ in normal], [i for _, i in normal])
        scores = np.full(len(model.pieces), -np.inf)
        for _, i in normal:
            scores[i] = model.pieces[i].score
        # equal scores share a priority: of these the leftmost goes first
        self.priority = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.byte_ids = np.zeros(256, np.int64)
        self.text_of: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.text_of.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.text_of.append(p.piece.replace(SPACE, " ").encode() if p.type == 1 else b"")

    def opens(self, data: np.ndarray) -> np.ndarray:
        """Words begin at a line feed or at the first of a run of spaces; no piece crosses there."""
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        return begins | (data == 10)

    def encode_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        raw = b"\0".join(words) + b"\0"
        # characters of each word: its bytes that continue none
        first_byte = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
        solid = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        chars = np.diff(solid[first_byte]) - 1
        upto = np.cumsum(chars + 1)
        first = 0
        while first < len(words):
            if chars[first] > self.suffix_chars:
                parts = [self._relax(t + "\0", np.array([len(t)]))[0] for t in self._parted(words[first].decode().replace(" ", SPACE))]
                ids = np.concatenate(parts)
                begin[first], size[first] = self.add(ids), len(ids)
                first += 1
                continue
            last = max(first + 1, int(np.searchsorted(upto, upto[first] - chars[first] - 1 + self.suffix_chars, side="right")))
            text = raw[first_byte[first] : first_byte[last]].decode().replace(" ", SPACE)
            ids, count = self._relax(text, chars[first:last])
            begin[first:last] = self.add(ids) + np.cumsum(count) - count
            size[first:last] = count
            first = last
        return begin, size

    def _parted(self, text: str):
        """Parts of a long word that no edge of two or more characters crosses."""
        begin, width = 0, self.suffix_chars
        while begin < len(text):
            chars = np.frombuffer(text[begin : begin + width].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            if begin + width >= len(text):
                yield text[begin:]
                return
            crossed = self._crossed(self.matcher.edges(chars)[1])
            free = np.flatnonzero(crossed[1 : len(chars) - self.matcher.longest] == 0)
            if len(free):
                yield text[begin : begin + 1 + int(free[-1])]
                begin, width = begin + 1 + int(free[-1]), self.suffix_chars
            else:
                width *= 2

    @staticmethod
    def _crossed(longest: np.ndarray) -> np.ndarray:
        """Per place, how many positions' longest edges begin before it and end behind it."""
        wide = np.flatnonzero(longest > 1)
        ends = wide + longest[wide]
        n = len(longest) + 1
        return np.cumsum(np.bincount(wide + 1, minlength=n)[:n] - np.bincount(ends, minlength=n)[:n])

    def _relax(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        edges, longest = self.matcher.edges(chars)
        ends = np.cumsum(sizes + 1)
        word = np.repeat(np.arange(len(sizes)), sizes + 1)
        at = np.delete(np.arange(len(chars)), ends - 1)
        word = word[at]
        # a place that no edge of two or more characters covers parts a word
        joined = self._crossed(longest)[at] > 0
        joined[0] = False
        group = np.cumsum(~joined | (np.concatenate([[-1], word[:-1]]) != word)) - 1
        start, length = at.copy(), np.ones(len(at), np.int64)
        done_start, done_length = [], []
        big = np.bincount(group)[group] > HEAP_CHARS
        for g in np.unique(group[big]).tolist():
            s, n = self._heap(start[group == g], edges)
            done_start.append(s)
            done_length.append(n)
        start, length, group = start[~big], length[~big], group[~big]
        top = edges.shape[1] - 1
        while len(start):
            both = length[:-1] + length[1:]
            piece = np.where((group[1:] == group[:-1]) & (both <= top), edges[start[:-1], np.minimum(both, top)], -1)
            key = np.where(piece >= 0, self.priority[piece] << 32, _FAR)
            key[piece >= 0] += np.flatnonzero(piece >= 0)
            key = np.append(key, _FAR)
            head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            best = np.minimum.reduceat(key, head)
            over = best == _FAR
            if over.any():
                gone = np.repeat(over, np.diff(np.append(head, len(start))))
                done_start.append(start[gone])
                done_length.append(length[gone])
            pick = (best[~over] & 0xFFFFFFFF).astype(np.int64)
            length[pick] += length[pick + 1]
            keep = np.ones(len(start), bool)
            keep[pick + 1] = False
            if over.any():
                keep &= ~gone
            start, length, group = start[keep], length[keep], group[keep]
        start, length = np.concatenate(done_start), np.concatenate(done_length)
        order = np.argsort(start)
        start, length = start[order], length[order]
        ids = edges[start, length].astype(np.int64)
        owner = np.searchsorted(ends, start, side="right")
        strange = np.flatnonzero(ids < 0)
        if len(strange):
            raw = [chr(c).encode() for c in chars[start[strange]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[strange] = [len(b) for b in raw]
            place = (np.cumsum(times) - times)[strange]
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            for p, b in zip(place.tolist(), raw, strict=True):
                ids[p : p + len(b)] = self.byte_ids[list(b)]
        return ids, np.bincount(owner, minlength=len(sizes))

    def _heap(self, start: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same relaxation of one long word, with a heap of its joins."""
        n, first, top = len(start), int(start[0]), edges.shape[1] - 1
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and size[i] + size[j] <= top and (p := int(edges[first + i, size[i] + size[j]])) >= 0:
                heap.append((int(self.priority[p]), i, size[i], size[j])) if not ready else heapq.heappush(heap, (int(self.priority[p]), i, size[i], size[j]))

        ready = False
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if size[i] != a or j >= n or size[j] != b:
                continue
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        live = [i for i in range(n) if size[i]]
        return start[live], np.array([size[i] for i in live])

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each document of a block; a space goes before each that is not empty."""
        full = np.flatnonzero(np.diff(offsets))
        data = np.insert(data, offsets[:-1][full], 32)
        shift = np.zeros(len(offsets), np.int64)
        shift[full + 1] = 1
        return self.encode_block(data, offsets + np.cumsum(shift))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; byte pieces that are not UTF-8 become U+FFFD."""
        raw = b"".join(map(self.text_of.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def kept_encoder(model_file: str) -> PieceEncoder:
    """One encoder per Python worker: its tables are built once, and the words it knows serve later tasks."""
    return PieceEncoder(model_file)


OUT = {"n_pieces": pa.int64(), "ids_crc32": pa.int64(), "round_trip": pa.bool_(), "ids": pa.list_(pa.int32())}


@tidy
def _encode(batches, model_file: str):
    """One output batch per block, so what a task holds follows the block and not Spark's batch."""
    encoder = kept_encoder(model_file)
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for a, b in blocks(offsets, BLOCK_BYTES):
            bodies = encoder.encode_texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            crc, same = [], []
            for d, body in enumerate(bodies, a):
                one = np.frombuffer(body, encoder.dtype)
                crc.append(zlib.crc32(one.astype("<u4").tobytes()))
                raw = b"".join(map(encoder.text_of.__getitem__, one.tolist()))
                same.append(raw[1:] == data[offsets[d] : offsets[d + 1]].tobytes())
            sizes = [len(x) // encoder.dtype.itemsize for x in bodies]
            flat = np.frombuffer(b"".join(bodies), encoder.dtype).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            made = [pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), lists]
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(0), *made, *part.columns[2:]], ["doc_id", *OUT, *batch.schema.names[2:]])
            del bodies, crc, same, flat, lists, made, part
    encoder.slim()


def encode(docs: DataFrame, model_file: str, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (as unsigned 32-bit little-endian), round_trip (decoding gives the text), ids, and the columns of ``keep``."""
    own = {"doc_id", "text", *OUT}
    keep = [c for c in keep or [] if c.lower() not in own]
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    schema = T.StructType([*T._parse_datatype_string("doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, ids array<int>").fields, *rows.schema.fields[2:]])
    return rows.mapInArrow(lambda it: _encode(it, model_file), schema)


@tidy
def _decode(batches, model_file: str):
    encoder = kept_encoder(model_file)
    for batch in batches:
        out = [encoder.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids are the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decode(it, model_file), "doc_id long, text string")
