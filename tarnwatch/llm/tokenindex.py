"""Token ids in raw binary shards, with a minimal perfect hash index for keyed access.

Layout of a shard: ``<name>.ids`` holds the ids of its documents, one after another, as
little-endian unsigned integers of 2 bytes (4 for vocabularies over 65,536), and ``<name>.idx``
holds the index.  The index has no keys: a multi-level minimal perfect hash (bitmaps of 64-bit
words, one running count a word: about 4 bits a key) maps each of the shard's n distinct keys to a
number below n; that slot stores a 32-bit fingerprint of the key, and which documents of the shard
are the key's; document numbers give byte offsets.  The sections are flat arrays behind a header of
fixed size, so a lookup is a few array reads whatever the size, and :class:`ShardIndex` works on the
file as it is, without rebuilding anything.  A key that was never written is refused by its
fingerprint (but for one in about 4 billion).

Documents are dealt to shards by ranges of doc_id, about ``SHARD_BYTES`` of text each but
``MAX_SHARDS`` shards at most, so the manifest that the driver holds is bounded (some 10 MB).  Rows of
one doc_id are in order of their texts' first 64 characters, then of their place in the input, and
may span shards: a hot key is split like any other.  Each task streams its ids to a file of its own
name and reports it; only files that the finished job reports are in the manifest, so retried or lost
tasks leave nothing that is read.

Defined cases: null texts are empty and have the end id only; null doc_ids come first, as one key (as
does -2**63, which stands for them in the files); repeated doc_ids are one key with several documents;
extra columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder, small_batches
from .textbytes import blocks, column_bytes, tidy
from .wordcache import WordCache

END_ID = 0
NULL_KEY = -(2**63)
MAGIC = 0x3130584449505054  # fixed value: the format's first eight bytes
CACHE_WORDS = 1_000_000
SHARD_BYTES = 32 << 20
MAX_SHARDS = 1 << 16


def open_folder(uri: str):
    """The Arrow file system and path of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class WordEncoder(WordCache):
    """Encodes texts with the tokenizers library, keeping the ids of words met before.

    A text is cut before each space and each line feed.  The byte-level pre-tokeniser never
    joins characters across a single space or line feed before a solid character (the space
    opens the token of what follows, the line feed is a token of its own), so such pieces
    encode independently.  A text with any other piece (white space runs, say) is encoded whole.
    New pieces are encoded together as one text, which is cut again by the byte lengths of its tokens.
    """

    def __init__(self, tokenizer_file: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        super().__init__("<u2" if max(vocabulary.values()) < 65536 else "<u4", cache_words)
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.token_bytes[number] = len(token)  # the byte-level alphabet has a character for each byte

    def opens(self, data: np.ndarray) -> np.ndarray:
        return (data == 32) | (data == 10)

    def encode_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        begin, size = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int32)
        plain, texts = [], []
        for i, raw in enumerate(words):
            t = raw.decode()
            opened = raw[0] == 32 or raw[0] == 10
            if t[opened : opened + 1].strip():
                plain.append(i)
                texts.append(t if opened else "\n" + t)
        for k in range(0, len(plain), 1024):
            part, rows = texts[k : k + 1024], np.array(plain[k : k + 1024])
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.int64)
            stop = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum([len(t.encode()) for t in part])) + 1
            start = np.concatenate([[0], stop[:-1]]) + np.array([words[i][0] not in b" \n" for i in rows.tolist()])
            begin[rows], size[rows] = self.add(ids) + start, stop - start
        return begin, size

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


@functools.lru_cache(maxsize=1)
def kept_encoder(tokenizer_file: str) -> WordEncoder:
    """One encoder per Python worker, so the words it knows serve the worker's later tasks too."""
    return WordEncoder(tokenizer_file)


def _mix(keys: np.ndarray, salt: int) -> np.ndarray:
    h = keys.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """n distinct 64-bit keys -> 0..n-1, by levels of bitmaps: a key's number is the rank of its bit.

    A level's bitmap marks the places hit by exactly one of the keys that are left; keys that
    collide go on to the next level.  ``words`` are the levels' bitmaps one after another,
    ``ranks`` the number of bits set before each word, ``sizes`` the levels' numbers of places.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.first = np.concatenate([[0], np.cumsum(-(-sizes // 64))])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.25) -> PerfectHash:
        sizes, parts, left = [], [], keys
        while len(left):
            size = max(1, int(len(left) * gamma))
            at = (_mix(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            single = np.zeros(-(-size // 64) * 64, bool)
            single[:size] = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(single, bitorder="little").view("<u8"))
            left = left[~single[at]]
            if len(sizes) > 200:
                raise ValueError("keys are not distinct")
        words = np.concatenate([np.zeros(0, "<u8"), *parts])
        return cls(np.array(sizes, np.int64), words, np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 where no level has a bit for it (surely a stranger)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = (_mix(keys[left], level + 1) % np.uint64(size)).astype(np.int64)
            place, bit = self.first[level] + (at >> 6), (at & 63).astype(np.uint64)
            word = self.words[place]
            here = (word >> bit) & np.uint64(1) > 0
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = self.ranks[place[here]] + below[here]
            left = left[~here]
        return out


@dataclass
class ShardIndex:
    """Perfect hash, fingerprints and places of one shard's documents."""

    hash: PerfectHash
    prints: np.ndarray  # by slot: fingerprint of the key
    first: np.ndarray  # by slot: number of its first document
    count: np.ndarray  # by slot: how many documents it has
    offsets: np.ndarray  # by document: its first id; one more at the end
    id_bytes: int

    @classmethod
    def build(cls, keys: np.ndarray, sizes: np.ndarray, id_bytes: int) -> ShardIndex:
        distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
        hashed = PerfectHash.build(distinct)
        slot = hashed(distinct)
        prints, begin, several = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i8"), np.zeros(len(distinct), "<i8")
        prints[slot] = (_mix(distinct, 0) >> np.uint64(32)).astype(np.uint32)
        begin[slot], several[slot] = first, count
        return cls(hashed, prints, begin, several, np.concatenate([[0], np.cumsum(sizes)]), id_bytes)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; -1 and 0 for strangers."""
        slot = self.hash(keys)
        good = slot >= 0
        good[good] = self.prints[slot[good]] == (_mix(keys[good], 0) >> np.uint64(32)).astype(np.uint32)
        return np.where(good, self.first[slot] if len(self.first) else -1, -1), np.where(good, self.count[slot] if len(self.count) else 0, 0)

    def to_bytes(self) -> bytes:
        parts = [self.hash.sizes, self.hash.words, self.hash.ranks, self.first, self.count, self.offsets, self.prints]
        head = np.array([MAGIC, self.id_bytes, *map(len, parts)], "<i8")
        return head.tobytes() + b"".join(np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes() for x in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> ShardIndex:
        """Views of the file's bytes."""
        head, at, parts = np.frombuffer(raw, "<i8", 9), 72, []
        if head[0] != MAGIC:
            raise ValueError("not an index of this format")
        for n, kind in zip(head[2:].tolist(), ("<i8", "<u8", "<i8", "<i8", "<i8", "<i8", "<u4"), strict=True):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += parts[-1].nbytes
        return cls(PerfectHash(*parts[:3]), parts[6], parts[3], parts[4], parts[5], int(head[1]))


@tidy
def _write_shard(batches, folder: str, tokenizer_file: str):
    encoder, shard = kept_encoder(tokenizer_file), TaskContext.get().partitionId()
    end = np.array([END_ID], encoder.dtype).tobytes()
    files, path = open_folder(folder)
    files.create_dir(path, recursive=True)
    name, keys, sizes = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}", [], []
    stream = None
    for batch in batches:
        ids = batch.column(0)
        if not len(ids):
            continue
        stream = stream or files.open_output_stream(f"{path}/{name}.ids")
        keys.append(ids.fill_null(NULL_KEY).to_numpy(zero_copy_only=False))
        data, offsets = column_bytes(batch.column(1))
        for a, b in blocks(offsets):
            for body in encoder.encode_block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                stream.write(body)
                stream.write(end)
                sizes.append(len(body) // encoder.dtype.itemsize + 1)
    if stream is None:
        return
    stream.close()
    index = ShardIndex.build(np.concatenate(keys), np.array(sizes, np.int64), encoder.dtype.itemsize)
    with files.open_output_stream(f"{path}/{name}.idx") as f:
        f.write(index.to_bytes())
    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "n_docs": [len(sizes)], "n_tokens": [int(index.offsets[-1])], "first_key": [int(keys[0][0])], "last_key": [int(keys[-1][-1])]})


def write_tokens(docs: DataFrame, tokenizer_file: str, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes and writes all documents; returns the manifest, a row per shard, in key order.

    The manifest (about 150 bytes for each of at most ``MAX_SHARDS`` shards) is what the driver
    holds; ``start`` is the number of ids before the shard.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MAX_SHARDS, max(spark.sparkContext.defaultParallelism, -(-size // shard_bytes)))
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first(), F.col("_place")]
    dealt = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = "shard int, name string, n_docs long, n_tokens long, first_key long, last_key long"
    found = sorted(dealt.mapInArrow(lambda it: _write_shard(it, folder, tokenizer_file), schema).collect())
    start, out = 0, []
    for r in found:
        out.append((folder, *r, start))
        start += r.n_tokens
    return spark.createDataFrame(out, f"folder string, {schema}, start long")


@functools.lru_cache(maxsize=4)
def _opened(folder: str, name: str):
    """A shard's index as its file holds it, and its ids' file, for the tasks of a worker."""
    files, path = open_folder(folder)
    with files.open_input_stream(f"{path}/{name}.idx") as f:
        return ShardIndex.from_bytes(f.read()), files.open_input_file(f"{path}/{name}.ids")


def _manifest(manifest: DataFrame) -> list[tuple]:
    return sorted((r.shard, r.folder, r.name, r.first_key, r.last_key, r.start) for r in manifest.collect())


@tidy
def _documents(batches, shards: list[tuple]):
    """(key, place of the first id, ids) of every document of the keys, each fetched by key: range, hash, seek."""
    firsts, lasts = np.array([s[3] for s in shards], np.int64), np.array([s[4] for s in shards], np.int64)
    for batch in batches:
        keys = np.unique(batch.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False))
        # shards whose ranges hold a key: one, or several neighbours where a key spans them
        low, high = np.searchsorted(lasts, keys, side="left"), np.searchsorted(firsts, keys, side="right")
        out = []
        for k in range(int(low.min(initial=len(shards))), int(high.max(initial=0))):
            mine = keys[(low <= k) & (k < high)]
            if not len(mine):
                continue
            _, folder, name, _, _, start = shards[k]
            index, f = _opened(folder, name)
            place, count = index.find(mine)
            for key, first, n in zip(mine.tolist(), place.tolist(), count.tolist(), strict=True):
                for d in range(first, first + n):
                    a, b = int(index.offsets[d]), int(index.offsets[d + 1])
                    f.seek(a * index.id_bytes)
                    out.append((key, start + a, np.frombuffer(f.read((b - a) * index.id_bytes), f"<u{index.id_bytes}")))
                    if len(out) == 1024:
                        yield out
                        out = []
        yield out


def _keys(keys: DataFrame, shards: int) -> DataFrame:
    """Distinct keys in ranges, so that a task needs few shards and each of them once."""
    distinct = keys.select(F.col("doc_id").cast("long")).distinct()
    return distinct.repartitionByRange(max(1, shards), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([None if r[0] == NULL_KEY else r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]


def read_back(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the keys (doc_id), fetched by key from the files."""
    shards = _manifest(manifest)

    def run(batches):
        for rows in _documents(batches, shards):
            crc = [zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows]
            yield pa.RecordBatch.from_arrays([*_columns(rows), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _keys(keys, len(shards)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, start and ids of the documents of given keys; keys that were never written have no row."""
    shards = _manifest(manifest)

    def run(batches):
        for rows in _documents(batches, shards):
            ids = pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*_columns(rows), ids], ["doc_id", "start", "ids"])

    return _keys(keys, len(shards)).mapInArrow(run, "doc_id long, start long, ids array<int>")


def token_index(spark: SparkSession, docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Writes all documents and reads each back through its key."""
    return read_back(write_tokens(docs, tokenizer_file), docs)
