"""Pieces of text and their token ids: whole blocks of bytes cut into pieces, each distinct piece encoded once."""

from __future__ import annotations

import numpy as np

from .textbytes import RunHasher, same_runs

KEPT_BYTES = 64


class WordCache:
    """Cuts texts into pieces that encode independently and joins the ids of the pieces.

    Pieces are looked up by 64-bit hash in an open-addressed table, and a hit counts only if length
    and bytes are those of the piece that the table holds; a piece whose hash belongs to another one
    is encoded wherever it occurs.  New pieces of a block are handed to :meth:`encode_new` together.
    Once the table holds ``limit`` pieces, further ones are encoded wherever they occur, as are those
    of over ``KEPT_BYTES`` bytes, so memory is bounded and no text is treated otherwise.
    """

    def __init__(self, dtype, limit: int):
        self.dtype, self.limit, self.held, self.hasher = np.dtype(dtype), limit, 0, RunHasher(7)
        slots = 1 << max(12, int(limit * 1.6).bit_length())
        self.mask = np.uint64(slots - 1)
        self.keys, self.begin, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        self.raw_begin, self.raw_size = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        self.raw, self.raw_used = np.zeros(1 << 16, np.uint8), 0

    def opens(self, data: np.ndarray) -> np.ndarray:
        """True at bytes where a piece begins; each document begins one too."""
        raise NotImplementedError

    def encode_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Adds the ids of the pieces to the pool; their places and numbers, -1 for odd pieces."""
        raise NotImplementedError

    def encode_whole(self, text: str) -> bytes:
        """Ids of a text that has an odd piece."""
        raise NotImplementedError

    def add(self, ids: np.ndarray) -> int:
        """Puts ids into the pool; where they begin."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def slim(self) -> None:
        """Drops what only speeds up the next block: tables as long as the longest one, and room for ids beyond those kept."""
        self.hasher = RunHasher(7)
        self.pool = self.pool[: max(1 << 16, self.used)].copy()

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or of the empty slot where it belongs."""
        at = (h & self.mask).astype(np.int64)
        left = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(self.mask)
            k = self.keys[at[left]]
            left = left[(k != h[left]) & (k != 0)]
        return at

    def _put(self, h: np.ndarray, begin: np.ndarray, size: np.ndarray, words: list[bytes]) -> None:
        """Keeps pieces of different hashes that the table doesn't have."""
        body = np.frombuffer(b"".join(words), np.uint8)
        if self.raw_used + len(body) > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros(max(len(self.raw), len(body)), np.uint8)])
        self.raw[self.raw_used : self.raw_used + len(body)] = body
        sizes = np.array([len(w) for w in words], np.int64)
        where = self.raw_used + np.cumsum(sizes) - sizes
        self.raw_used += len(body)
        left = np.arange(len(h))
        while len(left):
            at = self._find(h[left])
            self.keys[at] = h[left]
            mine = self.keys[at] == h[left]
            for table, values in ((self.begin, begin), (self.size, size), (self.raw_begin, where), (self.raw_size, sizes)):
                table[at[mine]] = values[left[mine]]
            left = left[~mine]
        self.held += len(h)

    def _encode_distinct(self, h: np.ndarray, free: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and numbers of ids of pieces that the table doesn't have, and how much of the pool is to stay."""
        _, one, back = np.unique(h, return_index=True, return_inverse=True)
        same = (sizes == sizes[one][back]) & same_runs(data, starts, data, starts[one][back], np.where(sizes == sizes[one][back], sizes, 0))
        raw = data.tobytes()
        begins, ends = starts.tolist(), (starts + sizes).tolist()
        word_of = lambda i: raw[begins[i] : ends[i]]
        if not same.all():  # pieces that share a hash
            number, extra = {}, []
            for i in np.flatnonzero(~same).tolist():
                n = number.setdefault(word_of(i), len(one) + len(number))
                if n == len(one) + len(extra):
                    extra.append(i)
                back[i] = n
            known = len(one)
            one = np.concatenate([one, np.array(extra, one.dtype)])
        else:
            known = len(one)
        words = [word_of(i) for i in one.tolist()]
        stay = free[one] & (sizes[one] <= KEPT_BYTES) & (np.arange(len(one)) < known)
        if self.held + int(stay.sum()) > self.limit:
            stay[:] = False
        place, number = np.zeros(len(one), np.int64), np.zeros(len(one), np.int32)
        keep = self.used
        for part in (np.flatnonzero(stay), np.flatnonzero(~stay)):
            if len(part):
                some = [words[k] for k in part.tolist()]
                place[part], number[part] = self.encode_new(some)
                if stay[part[0]]:
                    self._put(h[one[part]], place[part], number[part], some)
                    keep = self.used
        return place[back], number[back], keep

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each document of a block as little-endian bytes."""
        opens = self.opens(data)
        opens[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(opens)
        if not len(starts):
            return [b""] * (len(offsets) - 1)
        ends = np.append(starts[1:], len(data))
        sizes = ends - starts
        h = self.hasher(data, starts, ends)
        h[h == 0] = 1
        at = self._find(h)
        begin, size, keep = self.begin[at], self.size[at], self.used
        hit = (self.keys[at] == h) & (self.raw_size[at] == sizes)
        some = np.flatnonzero(hit)
        hit[some] = same_runs(data, starts[some], self.raw, self.raw_begin[at[some]], sizes[some])
        new = np.flatnonzero(~hit)
        if len(new):
            begin[new], size[new], keep = self._encode_distinct(h[new], self.keys[at[new]] == 0, data, starts[new], sizes[new])
        first = np.searchsorted(starts, offsets)
        odd = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(size < 0, out=odd[1:])
        odd_docs = np.flatnonzero(odd[first[1:]] > odd[first[:-1]])
        size = np.maximum(size, 0)
        edge = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(size, out=edge[1:])
        ids = self.pool[np.repeat(begin - edge[:-1], size) + np.arange(edge[-1])]
        body, cut = ids.tobytes(), (edge[first] * self.dtype.itemsize).tolist()
        out = [body[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        for d in odd_docs.tolist():
            text = data[offsets[d] : offsets[d + 1]].tobytes().decode()
            out[d] = self.encode_whole(text)
        self.used = keep
        return out
