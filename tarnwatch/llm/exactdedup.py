"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Each text (white space runs ``[\\x20\\x09-\\x0D]+`` made one space) is cut into blocks of
``block_bytes`` bytes.  The distinct blocks are sorted and get integer names.  Then, level by
level, adjacent names are paired, the distinct pairs sorted and named in turn, until each
document has one name.  Two documents have the same (level, name) exactly if their texts are
equal: unlike a digest of the text, a name cannot collide.

How it scales: distinct blocks are pre-aggregated before the one shuffle that moves content.
Documents look their blocks up by a pair of 64-bit digests, so content moves only once; the
digests are accepted only after a count over all distinct blocks shows that each stands for
one block (else other seeds are tried).  A block or pair that a third of the rows share is
one row in the name tables, and the joins to them are plain sort-merge joins of two exchanges,
which Spark splits where a key is hot.  Names are settled in the checkpoint folder before they
are used, so a lost executor can't make them differ between two uses.

Defined cases: a null text counts as empty, and the empty text has one empty block; of rows
repeated with the same doc_id, one is kept; a null doc_id ranks behind all others and names
a group only if it has no other id; extra columns are ignored by :func:`groups` and kept by
:func:`drop_copies`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import likely, settled

BLOCK_BYTES = 1024
MAX_BROADCAST_ROWS = 100_000


def normalised(text):
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _blocks(block_bytes: int):
    """Array of the blocks of the binary column ``body``."""
    return F.expr(f"transform(sequence(0, greatest(0, cast(ceil(octet_length(body) / {block_bytes}) as int) - 1)), i -> substring(body, i * {block_bytes} + 1, {block_bytes}))")


def _digests(block: str, seed: int, bits: int) -> str:
    mask = (1 << bits) - 1 if bits < 64 else -1
    return f"named_struct('h1', xxhash64({2 * seed}, {block}) & {mask}L, 'h2', xxhash64({2 * seed + 1}, {block}) & {mask}L)"


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """Integer names in sorted order within each partition, settled before any use."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _block_names(bodies: DataFrame, block_bytes: int, digest_bits: int) -> tuple[DataFrame, int]:
    for seed in range(16):
        distinct = bodies.select(F.explode(_blocks(block_bytes)).alias("block")).distinct()
        names = settled(_named(distinct, "block").select(F.expr(_digests("block", seed, digest_bits)).alias("h"), "name").select("h.h1", "h.h2", "name"))
        if not names.groupBy("h1", "h2").count().where("count > 1").limit(1).count():
            return names, seed
        digest_bits = 64
    raise RuntimeError("no seed gives distinct digests")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, digest_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Settled rows (rid, doc_id, text_sha256) and their identities (rid, level, name)."""
    bodies = docs.select(F.col("doc_id").cast("long"), normalised(F.col("text")).cast("binary").alias("body"))
    names, seed = _block_names(bodies, block_bytes, digest_bits)
    mask_bits = digest_bits if seed == 0 else 64
    rows = settled(
        bodies.select("doc_id", F.sha2("body", 256).alias("text_sha256"), _blocks(block_bytes).alias("blocks"))
        .select("doc_id", "text_sha256", F.expr(f"transform(blocks, b -> {_digests('b', seed, mask_bits)})").alias("h"))
        .withColumn("rid", F.monotonically_increasing_id())
    )
    most = rows.agg(F.max(F.size("h"))).first()[0] or 1
    now = rows.select("rid", F.size("h").alias("n"), F.posexplode("h").alias("pos", "h")).select("rid", "n", "pos", "h.h1", "h.h2")
    now = settled(now.join(names, ["h1", "h2"]).select("rid", "n", "pos", "name"))
    level, done = 0, [now.where("n = 1").select("rid", F.lit(0).alias("level"), "name")]
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        pairs = now.where("n > 1").groupBy("rid", "n", F.expr("cast(pos div 2 as int)").alias("half")).agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("b"))
        names = settled(_named(pairs.select("a", "b").distinct(), "a", "b"))
        now = settled(pairs.join(names, ["a", "b"]).select("rid", F.expr("cast((n + 1) div 2 as int)").alias("n"), F.col("half").alias("pos"), "name"))
        done.append(now.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return rows.select("rid", "doc_id", "text_sha256"), found


def groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, digest_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, found = identities(docs, block_bytes, digest_bits)
    rows = settled(rows.join(found, "rid"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rid")).alias("first")
    heads = settled(rows.groupBy("level", "name").agg(first, F.count("*").alias("group_size")).select("level", "name", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), "group_size"))
    return rows.join(heads, ["level", "name"]).select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def without(docs: DataFrame, lost: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Documents whose doc_id is not in ``lost``; the ids are broadcast only if they are few, else rows that may be among them are joined."""
    lost = settled(lost.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct())
    if lost.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        return docs.join(F.broadcast(lost), "doc_id", "left_anti").select(*docs.columns)
    maybe = likely(docs, lost, "doc_id")
    return likely(docs, lost, "doc_id", kept=False).unionByName(maybe.join(lost, "doc_id", "left_anti").select(*docs.columns))


def drop_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows that stay, with all their columns."""
    found = settled(groups(docs, **how))
    twice = found.where("not kept and doc_id <=> keep_id or not kept and doc_id is null").limit(1).count()
    if not twice and not found.groupBy("doc_id").agg(F.count_if("kept").alias("k"), F.count_if(~F.col("kept")).alias("d")).where("k > 0 and d > 0").limit(1).count():
        return without(docs, found.where("not kept"))
    # the same doc_id on several rows: decide by id and text, then keep one of the equal rows
    keep = found.where("kept").select("doc_id", "text_sha256").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("sha"))
    out = rows.join(keep, rows["id"].eqNullSafe(keep["doc_id"]) & (rows["sha"] == keep["text_sha256"]), "left_semi")
    return out.dropDuplicates(["id", "sha"]).select("row.*")
