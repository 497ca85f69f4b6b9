"""Benchmark decontamination: a broadcast hash set of test windows, scanned over training words.

A text is lower-cased (A-Z) and its words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window
is ``width`` consecutive words of a benchmark item; an item of fewer words, but not none, is
one window.  Rolling hashes of the document's words are looked up in the set, every find is
confirmed on the bytes, and each word inside a confirmed window counts as hit.

Defined cases: a null or wordless text has no words and no hits; a null item id is skipped
together with its text; repeated rows are scanned each for itself; an empty benchmark hits
nothing; other columns of the documents pass through :func:`remove_spans` unchanged.

The set holds the lower-cased text once and 24 bytes a window (hash, place, list of owners), and
each distinct list of owning items once.  It is broadcast in blocks of at most ``max_set_bytes`` of
benchmark text, built, used and dropped one at a time.  A benchmark of one block is one pass; a larger
one takes one pass of the documents per block, each of which adds to a bitmap of hit words that
travels with the row and is settled in the shared folder before the next, so neither broadcasts nor
the driver grow with the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled, small_batches
from .textbytes import ALNUM, LOWER, RunHasher, blocks, column_bytes, runs, same_runs, tidy

WIDTH = 8
CONTAMINATED_ITEMS = 2
MAX_SET_BYTES = 32 << 20
HIT, ITEMS = "_tarnwatch_hit", "_tarnwatch_items"
_STEP = np.uint64(0x2545F4914F6CDD1D)


def _window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, width):
        h *= _STEP
        h += words[k : k + n]
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Windows:
    """Distinct windows of one size, sorted by hash."""

    hashes: np.ndarray  # uint64
    places: np.ndarray  # by window: number of its first word
    lists: np.ndarray  # by window: number of its list of owners

    def __post_init__(self):
        bits = max(16, min(24, len(self.hashes).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, bool)
        self.some[self.hashes >> self.shift] = True


class WindowSet:
    """Windows of a block of benchmark items, found by hash and confirmed by their words' bytes."""

    def __init__(self, items: list[tuple[str, str]], width: int = WIDTH):
        self.items = [i for i, _ in items]
        self.hasher = RunHasher()
        raw, offsets = column_bytes(pa.array([t or "" for _, t in items], pa.large_string()))
        self.data, hashes = LOWER[raw], []
        begins, sizes, owners = [], [], []
        for a, b in blocks(offsets):
            part, where = self.data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends = runs(ALNUM[part], where)
            hashes.append(self.hasher(part, starts, ends))
            begins.append(starts + offsets[a])
            sizes.append((ends - starts).astype(np.int32))
            owners.append(np.repeat(np.arange(a, b, dtype=np.int32), np.diff(np.searchsorted(starts, where))))
        whole = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        self.begins, self.sizes = whole(begins, np.int64), whole(sizes, np.int32)
        words, owner = whole(hashes, np.uint64), whole(owners, np.int32)
        count = np.bincount(owner, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        self.by_size: dict[int, Windows] = {}
        lists: dict[bytes, int] = {}
        own = np.minimum(width, count)  # the window size of each item
        for size in np.unique(own[own > 0]).tolist():
            h = _window_hashes(words, size)
            place = np.flatnonzero(owner[: len(h)] == owner[size - 1 :][: len(h)])
            place = place[own[owner[place]] == size]
            self.by_size[size] = self._distinct(h[place], place, size, owner, len(items), lists)
        # owners of window list ``len(items) + k``; a number below that is the one item itself
        self.owners = [np.frombuffer(x, np.int32) for x in lists]
        self.hasher = RunHasher()  # without the tables that the build has grown

    def _distinct(self, h: np.ndarray, place: np.ndarray, size: int, owner: np.ndarray, items: int, lists: dict[bytes, int]) -> Windows:
        """One window for each distinct content; different contents of the same hash stay apart."""
        order = np.argsort(h, kind="stable")
        h, place = h[order], place[order]
        name, left, kept = np.zeros(len(h), np.int64), np.arange(len(h)), []
        while len(left):
            head = np.ones(len(left), bool)
            head[1:] = h[left[1:]] != h[left[:-1]]
            first = left[head][np.cumsum(head) - 1]
            same = self.same_words(self, place[left], place[first], size)
            name[left[same]] = first[same]
            kept.append(left[head])
            left = left[~same]
        kept = np.sort(np.concatenate([np.zeros(0, np.int64), *kept]))
        pairs = np.unique(np.searchsorted(kept, name) << 32 | owner[place].astype(np.int64))
        edge = np.searchsorted(pairs >> 32, np.arange(len(kept) + 1))
        members = (pairs & 0xFFFFFFFF).astype(np.int32)
        numbers = members[edge[:-1]]
        for k in np.flatnonzero(np.diff(edge) > 1).tolist():
            numbers[k] = items + lists.setdefault(members[edge[k] : edge[k + 1]].tobytes(), len(lists))
        return Windows(h[kept], place[kept], numbers)

    def same_words(self, other, mine: np.ndarray, theirs: np.ndarray, size: int) -> np.ndarray:
        """Whether ``size`` words from word ``mine`` of ``other`` (with data, begins, sizes) are those from ``theirs`` on here."""
        out = np.zeros(len(mine), bool)
        for first in range(0, len(mine), 1 << 17):
            live = np.arange(first, min(len(mine), first + (1 << 17)))
            for k in range(size):
                a, b = mine[live] + k, theirs[live] + k
                equal = other.sizes[a] == self.sizes[b]
                live, a, b = live[equal], a[equal], b[equal]
                live = live[same_runs(other.data, other.begins[a], self.data, self.begins[b], self.sizes[b].astype(np.int64))]
            out[live] = True
        return out


@dataclass
class _Words:
    data: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray


def scan_block(data: np.ndarray, offsets: np.ndarray, windows: WindowSet):
    """Word starts and ends, each document's first word, hit flags by word, and (document, item) pairs."""
    data = LOWER[data]
    starts, ends = runs(ALNUM[data], offsets)
    first = np.searchsorted(starts, offsets)
    words = windows.hasher(data, starts, ends)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hit = np.zeros(len(words) + 1, np.int64)
    mine = _Words(data, starts, ends - starts)
    found: set[tuple[int, int]] = set()
    for size, known in windows.by_size.items():
        h = _window_hashes(words, size)
        maybe = np.flatnonzero(known.some[h >> known.shift])
        maybe = maybe[owner[maybe] == owner[maybe + size - 1]]
        at = np.searchsorted(known.hashes, h[maybe])
        while len(maybe):  # more than once only where contents share a hash
            live = at < len(known.hashes)
            live[live] = known.hashes[at[live]] == h[maybe[live]]
            maybe, at = maybe[live], at[live]
            same = windows.same_words(mine, maybe, known.places[at], size)
            np.add.at(hit, maybe[same], 1)
            np.subtract.at(hit, maybe[same] + size, 1)
            found.update(zip(owner[maybe[same]].tolist(), known.lists[at[same]].tolist(), strict=True))
            maybe, at = maybe[~same], at[~same] + 1
    # a list of owners counts once a document, however many of its windows occur there
    alone = len(windows.items)
    pairs = {(doc, n) for doc, k in found for n in ([k] if k < alone else windows.owners[k - alone].tolist())}
    return starts, ends, first, np.cumsum(hit[:-1]) > 0, pairs


def benchmark_blocks(benchmark: DataFrame, width: int = WIDTH, max_set_bytes: int = MAX_SET_BYTES) -> Iterator[tuple[WindowSet, bool]]:
    """The benchmark as window sets, each of a block of items of about ``max_set_bytes`` of text, and whether it is the last."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // max_set_bytes) or 1
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else rows
        yield WindowSet(sorted(tuple(r) for r in part.collect()), width), k == parts - 1


@tidy
def _scan(batches, windows: WindowSet, key: str, text: str, last: bool):
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        data, offsets = column_bytes(column)
        old_bits = batch.column(batch.schema.get_field_index("_hit")).to_pylist() if "_hit" in batch.schema.names else None
        old_items = batch.column(batch.schema.get_field_index("_items")).to_pylist() if old_bits else None
        n_words, bits_out, items_out = [], [], []
        for a, b in blocks(offsets):
            starts, _, first, hit, pairs = scan_block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], windows)
            items: list[set[str]] = [set() for _ in range(b - a)]
            for doc, n in pairs:
                items[doc].add(windows.items[n])
            for d in range(b - a):
                bits = hit[first[d] : first[d + 1]]
                if old_bits:
                    bits = bits | np.unpackbits(np.frombuffer(old_bits[a + d], np.uint8), count=len(bits)).astype(bool)
                    items[d].update(old_items[a + d])
                n_words.append(len(bits))
                bits_out.append(int(bits.sum()) if last else np.packbits(bits).tobytes())
                items_out.append(sorted(items[d]))
        keys = batch.column(batch.schema.get_field_index(key))
        if last:
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n_words, pa.int64()), pa.array(bits_out, pa.int64()), pa.array([len(x) for x in items_out], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items_out], pa.string()), pa.array([len(x) >= CONTAMINATED_ITEMS for x in items_out], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )
        else:
            yield pa.RecordBatch.from_arrays([keys, column, pa.array(bits_out, pa.binary()), pa.array(items_out, pa.list_(pa.string()))], ["doc_id", "text", "_hit", "_items"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_set_bytes: int = MAX_SET_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for windows, last in benchmark_blocks(benchmark, width, max_set_bytes):
        held = docs.sparkSession.sparkContext.broadcast(windows)
        del windows
        schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if last else "doc_id long, text string, _hit binary, _items array<string>"
        out = out.mapInArrow(lambda it, held=held, last=last: _scan(it, held.value, "doc_id", "text", last), schema)
        if not last:
            out = settled(out)
            held.destroy()
    return out


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, flags: np.ndarray) -> str:
    """A document's text without the spans of its flagged words."""
    raw, out, begin = data.tobytes(), [], 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(raw[begin : starts[x]])
        begin = int(ends[y - 1])
    return b"".join([*out, raw[begin:]]).decode()


@tidy
def _clean(batches, windows: WindowSet, text: str, first_pass: bool, last: bool):
    """One output batch per block of documents; between passes hit bits and items travel as the last two columns."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        width = len(batch.columns) - (0 if first_pass else 2)
        data, offsets = column_bytes(batch.column(at))
        for a, b in blocks(offsets):
            start = offsets[a]
            starts, ends, first, hit, pairs = scan_block(data[start : offsets[b]], offsets[a : b + 1] - start, windows)
            part = batch.slice(a, b - a)
            columns, found = list(part.columns[:width]), [set() for _ in range(b - a)]
            for doc, n in pairs:
                found[doc].add(windows.items[n])
            if not first_pass:
                for d, (bits, items) in enumerate(zip(part.column(width).to_pylist(), part.column(width + 1).to_pylist(), strict=True)):
                    words = first[d + 1] - first[d]
                    hit[first[d] : first[d + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=words).astype(bool)
                    found[d].update(items)
            if not last:
                bits = [np.packbits(hit[first[d] : first[d + 1]]).tobytes() for d in range(b - a)]
                columns += [pa.array(bits, pa.binary()), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:width], HIT, ITEMS])
                continue
            marked = [d for d, x in enumerate(found) if x]
            if marked:
                texts = columns[at].to_pylist()
                for d in marked:
                    base, word = offsets[a + d] - start, slice(first[d], first[d + 1])
                    texts[d] = _cut(data[offsets[a + d] : offsets[a + d + 1]], starts[word] - base, ends[word] - base, hit[word])
                columns[at] = pa.array(texts, columns[at].type)
            stay = pa.array([len(x) < CONTAMINATED_ITEMS for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:width]).filter(stay)


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_set_bytes: int = MAX_SET_BYTES) -> DataFrame:
    """Documents with windows of two or more items go; from the others, hit spans are cut out.

    All columns stay; ``n_chars``, where there is one, follows the new text.  A benchmark beyond
    ``max_set_bytes`` is handled block by block: hit words and items travel with the row, and
    only the last pass cuts, so the result does not depend on the number of blocks.
    """
    from pyspark.sql import types as T

    out = small_batches(docs).withColumn("text", F.col("text").cast("string"))
    plain = out.schema
    extra = [T.StructField(HIT, T.BinaryType()), T.StructField(ITEMS, T.ArrayType(T.StringType()))]
    first_pass = True
    for windows, last in benchmark_blocks(benchmark, width, max_set_bytes):
        held = docs.sparkSession.sparkContext.broadcast(windows)
        del windows
        how = {"text": "text", "first_pass": first_pass, "last": last}
        schema = plain if how["last"] else T.StructType([*plain.fields, *extra])
        out = out.mapInArrow(lambda it, held=held, how=how: _clean(it, held.value, **how), schema)
        first_pass = False
        if not last:
            out = settled(out)
            held.destroy()
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
