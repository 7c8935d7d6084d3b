"""Conversation prefix trie by whole-sequence collapse.

1. Turns are numbered within their conversation by range partitions, not by
   one task per conversation; text drops out as an MD5 digest at once.
2. A prefix is named by sums: turn i with its digest gives four 32-bit numbers,
   and a prefix is the sums over its turns (128 bits and more). Sums combine
   before shuffles and run over segments of a long conversation.
3. Collapse: conversations with the same whole sequence become one weighted
   sequence with its list of ends; only one of them is expanded to prefixes.
4. Leaves are the sequences that an anti-join leaves after taking out those
   that are proper prefixes of others.
5. Weighted prefixes are aggregated to nodes. A node's gain belongs to its
   smallest member's sequence, so a subtree's gain is what the sequences
   through its top own, less what the owner of the top has above it: linear in
   the prefixes, where adding each node to all its ancestors would be a square.

Lists of ends are hashed as a stream: consecutive members are joined to pieces
of bounded size where they are sorted, and the pieces pass through SHA-256.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import saved, shuffle_partitions
from coffer.operators.segments import numbered, running

#: Depths of a segment of a long conversation, members of a piece of an end list.
SEGMENT, PIECE = 4096, 4096
#: Contract of the rebuilding: conversations a base serves, and most turns that come from it.
FAMILY, HEADS = 100, 6

SUMS = ["p1", "p2", "p3", "p4"]
STEP = ["s1", "s2", "s3", "s4"]
KEY = ["depth", *SUMS]
_KEY_TYPE = "depth long, p1 long, p2 long, p3 long, p4 long"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, digest, chars: each conversation's turns in order, texts as digests."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    return numbered(turns, ["conv_id"], ["turn", "digest"]).select("conv_id", "pos", "digest", "chars")


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id of every conversation; conv_id, depth, digest, chars of the rebuilt turns).

    Conversation c starts with the first h turns of conversation c - c % 100,
    h = crc32 of c in decimal % 6, and goes on with its own turns behind its
    first h.
    """
    turns = saved(number_turns(conversations), "trie-turns")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    plan = convs.select("conv_id", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    bases = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), "n")
    plan = saved(
        plan.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken")),
        "trie-plan",
    )
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    start = plan.where("h > 0").join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    rest = (
        turns.join(plan, "conv_id")
        .where("pos > h")
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars")
    )
    return plan.select("conv_id"), start.unionByName(rest)


def _step() -> list[Column]:
    """Four 32-bit numbers of a turn at its depth."""
    whole = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest").cast("binary"))
    return [F.conv(F.substring(whole, 8 * i + 1, 8), 16, 10).cast("long").alias(s) for i, s in enumerate(STEP)]


def _pieces(batches):
    """Sorted members to pieces of a list: (key, first member, ids joined by commas)."""
    key, ids = None, []

    def out():
        return pa.RecordBatch.from_pylist(
            [dict(zip([*KEY, "first", "ids"], [*key, ids[0], ",".join(map(str, ids))], strict=True))], schema=schema
        )

    schema = pa.schema([(k, pa.int64()) for k in [*KEY, "first"]] + [("ids", pa.string())])
    for b in batches:
        cols = [b.column(k).to_pylist() for k in [*KEY, "conv_id"]]
        for *k, i in zip(*cols, strict=True):
            if ids and (k != key or len(ids) >= PIECE):
                yield out()
                ids = []
            key = k
            ids.append(i)
    if ids:
        yield out()


def _digest(batches):
    """Pieces sorted by key and first member to one SHA-256 per key."""
    key, sha = None, None
    schema = pa.schema([(k, pa.int64()) for k in KEY] + [("ends_sha256", pa.string())])

    def out():
        return pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], [*key, sha.hexdigest()], strict=True))], schema=schema)

    for b in batches:
        cols = [b.column(k).to_pylist() for k in [*KEY, "ids"]]
        for *k, ids in zip(*cols, strict=True):
            if k == key:
                sha.update(b",")
            else:
                if key is not None:
                    yield out()
                key, sha = k, hashlib.sha256()
            sha.update(ids.encode())
    if key is not None:
        yield out()


def end_lists(members: DataFrame) -> DataFrame:
    """SHA-256 of each whole sequence's members, in ascending order and joined by commas."""
    n = shuffle_partitions(members.sparkSession)
    pieces = (
        members.repartitionByRange(n, *KEY, "conv_id")
        .sortWithinPartitions(*KEY, "conv_id")
        .mapInArrow(_pieces, f"{_KEY_TYPE}, first long, ids string")
    )
    return pieces.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digest, f"{_KEY_TYPE}, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of all prefixes of the sequences ``turns`` (conv_id, depth from 1 without gaps, digest, chars) of ``convs``."""
    turns = saved(turns.select("conv_id", "depth", "digest", "chars", *_step()), "trie-rebuilt")
    whole = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("depth"), *[F.sum(s).alias(p) for s, p in zip(STEP, SUMS, strict=True)]
    )
    members = saved(convs.join(whole, "conv_id", "left").na.fill(0, KEY), "trie-members")
    sequences = saved(
        members.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id")), "trie-sequences"
    )

    one = sequences.select("conv_id", "weight", F.col("depth").alias("ends_at"))
    expanded = turns.join(one, "conv_id").withColumn("segment", F.expr(f"depth div {SEGMENT}"))
    expanded = running(expanded, ["conv_id"], "segment", ["depth"], sums=dict(zip(SUMS, STEP, strict=True)))
    above = [(F.col(p) - F.col(s)).alias(f"up_{p}") for p, s in zip(SUMS, STEP, strict=True)]
    zero = F.lit(0).cast("long")
    root = one.select("conv_id", "weight", "ends_at", zero.alias("depth"), zero.alias("chars"), *[zero.alias(p) for p in SUMS])
    root = root.select("*", *[F.lit(None).cast("long").alias(f"up_{p}") for p in SUMS])
    prefixes = saved(
        expanded.select("conv_id", "weight", "ends_at", "depth", "chars", *SUMS, *above).unionByName(root), "trie-prefixes"
    )
    up = [f"up_{p}" for p in SUMS]
    nodes = saved(
        prefixes.groupBy(*KEY)
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.max("chars").alias("chars"),
            F.max("ends_at").alias("deepest"),
            *[F.max(u).alias(u) for u in up],
        )
        .withColumn("gain", (F.col("n_convs") - 1) * F.col("chars")),
        "trie-nodes",
    )

    inner = nodes.where("deepest > depth").select(*KEY)
    leaves = sequences.join(inner, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    owned = nodes.groupBy("conv_id").agg(F.sum("gain").alias("owned"))
    per_sequence = owned.join(leaves, "conv_id", "left").where("owned > 0 or leaf = 1")
    through = (
        prefixes.select("conv_id", *KEY)
        .join(per_sequence, "conv_id")
        .groupBy(*KEY)
        .agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum("owned").alias("owned"))
    )
    chain = nodes.withColumn("segment", F.expr(f"depth div {SEGMENT}"))
    chain = running(chain, ["conv_id"], "segment", ["depth"], sums={"upto": "gain"})
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(u).alias(p) for u, p in zip(up, SUMS, strict=True)])
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(
        F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), *[F.col(p).alias(u) for u, p in zip(up, SUMS, strict=True)]
    )
    none = F.lit(0).cast("long")
    return (
        chain.join(through, KEY, "left")
        .join(children, KEY, "left")
        .join(end_lists(members), KEY, "left")
        .join(parents, ["depth", *up], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", none).alias("n_children"),
            F.coalesce("n_leaves", none).alias("n_leaves"),
            (F.coalesce("owned", none) - (F.col("upto") - F.col("gain"))).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations (conv_id, turn, role, text).

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the
    root), n_convs, n_children, n_leaves, saved_tokens (code points of last
    texts that members beyond the first repeat, over the subtree),
    ends_sha256. Turns are ordered by turn (null first), equal ones by the MD5
    of role and text; null role or text counts as empty; repeated rows are
    turns of their own. Rows without a conv_id belong to no conversation and
    take no part; other columns are ignored. An empty table has no nodes.
    """
    return trie(*rebuild(conversations))


def oracle_sql() -> str:
    """The same result as DuckDB SQL; pairs of a node and its ancestors make it a check for small tables."""
    bits = "list_transform(range(8 * strlen(s)), lambda i: (ord(s[CAST(i // 8 + 1 AS INTEGER)]) >> CAST(i % 8 AS INTEGER)) & 1)"
    step = "lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))"
    return f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    n AS (
      SELECT conv_id, md5(length(r) || ':' || r || x) AS digest, length(x) AS chars,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS pos FROM t),
    c AS (
      SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, conv_id - conv_id % {FAMILY} AS base, count(*) AS n FROM n GROUP BY conv_id),
    h AS (
      SELECT conv_id, base, n,
        xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), {step}), 4294967295) % {HEADS} AS h FROM c),
    p AS (
      SELECT h.conv_id, h.base, h.h, least(h.h, coalesce(o.n, 0)) AS taken FROM h LEFT JOIN h o ON o.conv_id = h.base),
    rb AS (
      SELECT p.conv_id, n.pos AS depth, digest, chars FROM p JOIN n ON n.conv_id = p.base AND n.pos <= p.h
      UNION ALL
      SELECT p.conv_id, n.pos - p.h + p.taken, digest, chars FROM p JOIN n ON n.conv_id = p.conv_id AND n.pos > p.h),
    k AS (
      SELECT conv_id, depth, chars, string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM rb
      UNION ALL SELECT conv_id, 0, 0, '' FROM p),
    e AS (SELECT conv_id, arg_max(key, depth) AS key FROM k GROUP BY conv_id),
    ends AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM e GROUP BY key),
    up AS (SELECT *, CASE WHEN depth > 0 THEN coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), '') END AS up FROM k),
    nodes AS (
      SELECT key, any_value(depth) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
        (count(*) - 1) * any_value(chars) AS gain FROM up GROUP BY key),
    kids AS (SELECT up AS key, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
    below AS (
      SELECT DISTINCT a.key, b.key AS sub FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
    subtree AS (
      SELECT b.key, CAST(sum(n.gain) AS BIGINT) AS saved_tokens, count(*) FILTER (kids.key IS NULL) AS n_leaves
      FROM below b JOIN nodes n ON n.key = b.sub LEFT JOIN kids ON kids.key = b.sub GROUP BY b.key)
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
      saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
    FROM nodes n JOIN subtree USING (key) LEFT JOIN kids ON kids.key = n.key LEFT JOIN ends ON ends.key = n.key
    LEFT JOIN nodes u ON u.key = n.up"""
