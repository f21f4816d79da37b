"""A prefix trie over conversations, from minimal-perfect-hash tables of bounded shards.

Order.  Turns are ordered by turn (null first), then role and text, by a range sort whose stretches carry their counts over
(:mod:`attesta.operators.running`), so one conversation may hold any share of the rows.  From there on no text travels:
a turn is three 64-bit hashes of its place, role and text, and its number of bytes.

Digests.  The digest of the first d turns sums, lane by lane, what the turns' placed hashes give: sums run along a conversation
without gathering it.  Equal digests are verified: all rows of a digest must agree on the parent's digest and on the last turn's
own third hash, else the job fails.  A collision would need 128 bits and, undetected, another 64 to agree.

Shards.  A node's weight is the number of (member, deeper turn) rows of its subtree, which bounds the subtree's nodes and comes
from the count of the nodes themselves.  The topmost nodes of at most ``limit`` rows are cut points: the subtree of each goes to one
task as a whole, many subtrees to a table.  A table enumerates its digests, gives each a slot by a minimal perfect hash whose
stored digests verify every lookup, scatters the counts into flat arrays, and adds each depth to its parents' slots, the
deepest first.  The nodes above the cut points, few unless a conversation is very long or a beginning very common, add up by
doubling steps towards the root: a number of rounds that grows with the logarithm of their depth.

Edge cases: a null role or text is empty; a null turn comes first; rows without a conv_id belong to no conversation and are left out;
repeated rows are turns of their own; an empty table gives an empty table (there is no member that could name the root); other
input columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import in_order, running
from .bytewise import mix
from .common import discard, owned, written

#: Rows under a cut point at most, nodes in a table at about, conversations in one row of ids that end at a node.
LIMIT, TABLE, PACK = 256, 1 << 17, 4096
LOW = (1 << 32) - 1


class SlotTable:
    """A minimal perfect hash of distinct 128-bit digests: slots 0 to n - 1, verified by the stored digests.

    Keys that meet no other in a level's bit array get their slot there: the number of set bits before theirs.  The rest go to the next level.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray, gamma: float = 2.0, levels: int = 64):
        self.n = len(hi)
        self.bits: list[np.ndarray] = []
        rest = np.arange(self.n)
        for level in range(levels):
            if not len(rest):
                break
            size = max(8, int(gamma * len(rest)))
            at = self._place(hi[rest], lo[rest], level, size)
            alone = np.bincount(at, minlength=size) == 1
            self.bits.append(alone)
            rest = rest[~alone[at]]
        if len(rest):
            raise ValueError("equal digests cannot have slots of their own")
        self.ranks = [np.cumsum(b) - b for b in self.bits]
        self.base = np.concatenate([[0], np.cumsum([b.sum() for b in self.bits])]).astype(np.int64)
        self.hi = np.zeros(self.n, np.uint64)
        self.lo = np.zeros(self.n, np.uint64)
        at = self._raw(hi, lo)
        self.hi[at], self.lo[at] = hi, lo

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        return (mix(hi ^ seed) ^ mix(lo + seed)) % np.uint64(size)

    def _raw(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(hi), -1), np.arange(len(hi))
        for level, (bits, rank) in enumerate(zip(self.bits, self.ranks)):
            at = self._place(hi[rest], lo[rest], level, len(bits))
            hit = bits[at]
            out[rest[hit]] = self.base[level] + rank[at[hit]]
            rest = rest[~hit]
        return out

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where the table doesn't hold it."""
        at = self._raw(hi, lo)
        known = (at >= 0) & (self.hi[at] == hi) & (self.lo[at] == lo) if self.n else np.zeros(len(hi), bool)
        return np.where(known, at, -1)


def accumulate(hi, lo, parent_hi, parent_lo, depth, conv, n_convs, n_bytes) -> tuple[np.ndarray, ...]:
    """(n_children, n_leaves, saved, parent's conv or None's mask) of each node of whole subtrees, in the order given."""
    table = SlotTable(hi, lo)
    at = table.slots(hi, lo)
    n = table.n
    up = np.full(n, -1)
    up[at] = table.slots(parent_hi, parent_lo)
    flat = lambda x: (lambda out: (out.__setitem__(at, x), out)[1])(np.zeros(n, np.int64))
    level, convs, first = flat(depth), flat(n_convs), flat(conv)
    saved = (convs - 1) * flat(n_bytes)
    children = np.bincount(up[up >= 0], minlength=n)
    leaves = (children == 0).astype(np.int64)
    order = np.argsort(-level, kind="stable")
    edges = np.flatnonzero(np.diff(level[order])) + 1
    for some in np.split(order, edges):
        some = some[up[some] >= 0]
        np.add.at(leaves, up[some], leaves[some])
        np.add.at(saved, up[some], saved[some])
    parent = np.where(up >= 0, first[np.maximum(up, 0)], 0)
    return children[at], leaves[at], saved[at], parent[at], up[at] >= 0


def rebuilt(conversations: DataFrame, group: int = 5, share: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): turns (conv_id, depth from 1, a, b of the prefix, pa, pb of the one before, check, n_bytes, length) and convs (conv_id, length).

    Conversation c becomes the first h turns of conversation c - c % group and its own turns after its first h; h is crc32 of its number, modulo ``share``.
    """
    base_of = lambda c: c - c % group
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    ordered = rows.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "role", "text", F.rand(5)).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    # hashes of the content; the place is mixed in once it is known
    content = [F.xxhash64(F.lit(s), "role", "text").alias(n) for s, n in ((1, "x"), (2, "y"), (3, "check"))]
    rows = written(ordered.select("conv_id", *content, F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("place")), "turns")
    numbered = written(running(rows, ["conv_id"], {"i": ("sum", F.lit(1).cast("long"))}).withColumn("i", F.col("i") - 1), "numbered")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % share).cast("long")
    sizes = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    sizes = written(sizes.select("conv_id", "own", h.alias("h"), base_of(F.col("conv_id")).alias("base")), "sizes")
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = sizes.join(lent, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("of_base", F.lit(0))).alias("nb"), F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("after"))
    convs = written(convs.withColumn("length", F.col("nb") + F.col("after")), "convs")
    # the sums' lanes: 32 bits each, so that two thousand million turns fit a long
    lanes = lambda d: {f"s{k}": F.shiftrightunsigned(F.xxhash64(F.lit(k), d, "x"), 32) if k % 2 else F.shiftrightunsigned(F.xxhash64(F.lit(k), d, "y"), 32) for k in range(4)}
    # a base lends its first turns to a few conversations: eight rows for each of these at most
    first = numbered.where(F.col("i") < share - 1).select(F.col("conv_id").alias("base"), "i", "x", "y", "check", "n_bytes")
    given = first.join(convs.where("nb > 0").select("base", "conv_id", "nb", "length"), "base").where("i < nb").withColumn("depth", F.col("i") + 1)
    given = given.withColumns(lanes(F.col("depth")))
    few = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    given = given.withColumns({f"r{k}": F.sum(f"s{k}").over(few) for k in range(4)})
    total = given.groupBy("conv_id").agg(*[F.sum(f"s{k}").alias(f"t{k}") for k in range(4)])
    kept = written(numbered.join(convs.where("after > 0").select("conv_id", "h", "nb", "length"), "conv_id").where("i >= h").withColumn("depth", F.col("nb") + F.col("i") - F.col("h") + 1), "kept")
    kept = running(kept.withColumns(lanes(F.col("depth"))), ["conv_id"], {f"r{k}": ("sum", F.col(f"s{k}")) for k in range(4)})
    kept = written(kept.select("conv_id", "depth", "check", "n_bytes", "length", *[f"s{k}" for k in range(4)], *[f"r{k}" for k in range(4)]), "summed")
    kept = kept.join(total, "conv_id", "left").withColumns({f"r{k}": F.col(f"r{k}") + F.coalesce(f"t{k}", F.lit(0)) for k in range(4)})
    columns = ["conv_id", "depth", "check", "n_bytes", "length", *[f"s{k}" for k in range(4)], *[f"r{k}" for k in range(4)]]
    turns = given.select(columns).unionAll(kept.select(columns))
    packed = lambda i, j, own: F.shiftleft(((F.col(f"r{i}") - (0 if own else F.col(f"s{i}"))).bitwiseAND(LOW)), 32).bitwiseOR((F.col(f"r{j}") - (0 if own else F.col(f"s{j}"))).bitwiseAND(LOW))
    turns = turns.select("conv_id", "depth", packed(0, 1, True).alias("a"), packed(2, 3, True).alias("b"), packed(0, 1, False).alias("pa"), packed(2, 3, False).alias("pb"), "check", "n_bytes", "length")
    return written(turns, "prefixes"), convs.select("conv_id", "length")


def _sha(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the nodes (a, b) at which conversations end: their numbers, ascending, comma-joined.

    Numbers are packed first, ``PACK`` of them in a row at most, so a node where many end has few rows; a task then reads a
    node's rows in order and feeds the hash, holding one row.
    """
    block = F.floor(F.col("conv_id") / PACK)
    rows = ends.groupBy("a", "b", block.alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def work(batches):
        import pyarrow as pa

        node, h, out = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if node == (a, b):
                    h.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, h.hexdigest()))
                node, h = (a, b), hashlib.sha256(ids.encode())
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "ends_sha256"])
                    out = []
        if node is not None:
            out.append((*node, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "ends_sha256"])

    return rows.repartition("a", "b").sortWithinPartitions("a", "b", "block").mapInArrow(work, "a long, b long, ends_sha256 string")


NODE = ["a", "b", "pa", "pb", "depth", "conv_id", "n_convs", "n_bytes"]
TALLY = "n_children long, n_leaves long, saved_tokens long, parent_conv_id long"


def _tables(nodes: DataFrame) -> DataFrame:
    """The nodes under cut points (``ca, cb``) with what their subtrees come to; a cut point's parent is null here."""

    def work(batches):
        import pyarrow as pa

        held, n, names = [], 0, [*NODE, "ca", "cb"]

        def table(columns):
            u = lambda k: columns[k].view(np.uint64)
            kids, leaves, saved, parent, inner = accumulate(u("a"), u("b"), u("pa"), u("pb"), columns["depth"], columns["conv_id"], columns["n_convs"], columns["n_bytes"])
            return pa.RecordBatch.from_arrays([*(pa.array(columns[k]) for k in NODE), pa.array(kids), pa.array(leaves), pa.array(saved), pa.array(parent, mask=~inner)], names=[*NODE, *(x.split()[0] for x in TALLY.split(", "))])

        for batch in batches:
            held.append({k: batch.column(k).to_numpy() for k in names})
            n += batch.num_rows
            if n >= TABLE:
                columns = {k: np.concatenate([x[k] for x in held]) for k in names}
                last = (columns["ca"] == columns["ca"][-1]) & (columns["cb"] == columns["cb"][-1])
                if not last.all():
                    yield table({k: v[~last] for k, v in columns.items()})
                    columns = {k: v[last] for k, v in columns.items()}
                held, n = [columns], len(columns["a"])
        if n:
            yield table({k: np.concatenate([x[k] for x in held]) for k in names})

    dealt = nodes.repartition("ca", "cb").sortWithinPartitions("ca", "cb").select(*NODE, "ca", "cb")
    return dealt.mapInArrow(work, ", ".join(f"{c} long" for c in NODE) + ", " + TALLY)


def _upwards(spine: DataFrame, deepest: int) -> DataFrame:
    """(a, b, n_leaves, saved_tokens): the sums of ``spine`` (a, b, pa, pb, depth and own values) over subtrees, by doubling.

    After round r a node holds the sums of those fewer than 2**r steps below it, and knows its ancestor 2**r steps above.
    """
    now = written(spine.select("a", "b", F.when(F.col("depth") > 0, F.struct(F.col("pa").alias("a"), F.col("pb").alias("b"))).alias("up"), "n_leaves", "saved_tokens"), "spine")
    step = 1
    while step <= deepest:
        sent = now.where("up is not null").groupBy(F.col("up.a").alias("a"), F.col("up.b").alias("b")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        above = now.select(F.struct("a", "b").alias("up"), F.col("up").alias("next"))
        new = now.join(sent, ["a", "b"], "left").join(above, "up", "left")
        new = new.select("a", "b", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"))
        before, now = now, written(new, "spine")
        discard(before)
        step *= 2
    return now.drop("up")


def _nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix, the root included: NODE, weight, and how many members end there."""
    rest = F.col("length") - F.col("depth")
    some = turns.groupBy("a", "b").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.sum(rest + 1).alias("weight"),
        ((F.min("pa") != F.max("pa")) | (F.min("pb") != F.max("pb")) | (F.min("check") != F.max("check")) | (F.min("depth") != F.max("depth"))).alias("bad"),
    )
    bad = F.when(F.col("bad"), F.raise_error(F.lit("two prefixes share a digest"))).otherwise(F.lit(0))
    some = some.withColumn("n_bytes", F.col("n_bytes") + bad).drop("bad")
    zero = lambda n: F.lit(0).cast("long").alias(n)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("length").alias("weight")).where("n_convs > 0")
    return some.unionByName(root.select(zero("a"), zero("b"), zero("pa"), zero("pb"), zero("depth"), "conv_id", "n_convs", zero("n_bytes"), "weight"))


def prefix_trie(conversations: DataFrame, group: int = 5, share: int = 9, limit: int = LIMIT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.  Tables are written when this is called."""
    with owned(conversations.sparkSession):
        return written(_trie(conversations, group, share, limit), "trie", own=False)


def _trie(conversations: DataFrame, group: int, share: int, limit: int) -> DataFrame:
    turns, convs = rebuilt(conversations, group, share)
    nodes = written(_nodes(turns, convs), "nodes")
    heavy: Column = (F.col("weight") > limit) | (F.col("depth") == 0)
    spine = written(nodes.where(heavy), "heavy")
    light = nodes.where(~heavy)
    # cut points: light nodes under a heavy one; every conversation passes one at most
    cuts = written(light.join(spine.select(F.col("a").alias("pa"), F.col("b").alias("pb")), ["pa", "pb"], "left_semi").select("a", "b"), "cuts")
    of = written(turns.select("a", "b", "conv_id").join(cuts, ["a", "b"]).select("conv_id", F.col("a").alias("ca"), F.col("b").alias("cb")), "cut-of")
    # a node's smallest member passes the same cut point as all its members
    done = written(_tables(light.join(of, "conv_id")), "tables")
    tops = done.where("parent_conv_id is null")
    children = tops.select("pa", "pb", "n_leaves", "saved_tokens").unionAll(spine.where("depth > 0").select("pa", "pb", F.lit(0).cast("long"), F.lit(0).cast("long")))
    under = written(children.groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "under")
    own = spine.join(under.toDF("a", "b", "n_children", "l", "s"), ["a", "b"], "left").na.fill(0, ["n_children", "l", "s"])
    own = own.withColumns({"n_leaves": F.col("l") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("s") + (F.col("n_convs") - 1) * F.col("n_bytes")})
    own = written(own, "own")
    deepest = own.agg(F.max("depth")).first()[0] or 0
    sums = _upwards(own, deepest)
    upper = own.drop("n_leaves", "saved_tokens").join(sums, ["a", "b"])
    named = spine.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("p"))
    columns = ["a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    above = upper.select(*NODE, "n_children", "n_leaves", "saved_tokens").unionByName(tops.drop("parent_conv_id")).join(named, ["pa", "pb"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("p")))
    every = above.select(columns).unionAll(done.where("parent_conv_id is not null").select(columns))
    ends = turns.where("depth = length").select("a", "b", "conv_id").unionAll(convs.where("length = 0").select(F.lit(0).cast("long"), F.lit(0).cast("long"), "conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = every.join(_sha(ends), ["a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: The same in SQL: every conversation's prefixes as keys, and each node's descendants by the prefixes they share.
ORACLE = r"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, role, text FROM (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT DISTINCT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: list_prepend(ord(c)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
  lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END), 4294967295) % 9 AS h FROM own),
raw AS (
  SELECT ids.conv_id, 0 AS part, o.i, o.role, o.text FROM ids JOIN own o ON o.conv_id = ids.conv_id - ids.conv_id % 5 AND o.i < ids.h
  UNION ALL SELECT ids.conv_id, 1, o.i, o.role, o.text FROM ids JOIN own o ON o.conv_id = ids.conv_id AND o.i >= ids.h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d, md5(length(role) || ',' || role || text) AS turn_key, octet_length(encode(text)) AS bytes FROM raw),
chain AS (SELECT conv_id, d, bytes, md5(string_agg(turn_key, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM turns UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
members AS (SELECT c.*, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS up, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM chain c),
nodes AS (SELECT node, any_value(d) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM members GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
below AS (SELECT DISTINCT a.node, b.node AS inner_ FROM members a JOIN members b ON b.conv_id = a.conv_id AND b.d >= a.d),
sums AS (SELECT b.node, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.bytes) AS BIGINT) AS saved_tokens FROM below b JOIN nodes n ON n.node = b.inner_ LEFT JOIN kids k ON k.node = n.node GROUP BY b.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.up AND n.depth > 0 LEFT JOIN kids k ON k.node = n.node JOIN sums s ON s.node = n.node"""
