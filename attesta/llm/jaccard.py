"""N-gram Jaccard join: classes of documents that a chain of similar ones connects.

A document's set holds its distinct word n-grams, in one global order.  Two documents link when ``percent`` of their
union is in both.  Documents of equal sets are one class, so copies never meet as pairs.

1.  Prefixes.  A set of size n, in order of hash, emits its first n - ceil(percent n) + l(n) n-grams, l(n) = ceil(n / 10).  Similar
    sets share at least min(l(n), l(m)) of these.  N-grams that one class alone has are dropped; a class with fewer shared ones than
    its smallest possible partner asks for is alone.  Of the rest, ordered by how many classes hold them, the same bound
    leaves a short prefix of the rarest n-grams, and what two classes share there puts them in one block.
    No link crosses blocks.
2.  Tiles.  The classes of a block, in order of size, are cut into tiles of a bounded number of n-grams.  A class goes to the pairs of
    its own tile with those that hold sizes it can link with; it reckons these from counts by size, so no block is ever
    gathered or paired in one task.  Two classes of possible sizes meet in one pair of tiles, and in no other.
3.  Prefix tree.  Within a pair the sets, rarest n-gram first, form a trie.  A set walks it once, and the overlap counted down to a
    node serves all sets below.  A subtree is left when its sizes can't reach the threshold, or when the overlap
    so far plus the n-grams that remain on the shorter side can't.  Each similar pair is found once, in one group.
4.  Links of all tiles are counted: a task sends a class's number of linked documents and, of the pairs, those that connect.
    These make components; a component's id is its smallest doc_id.

A text goes out once for each pair of tiles that it meets in: for a block of k classes of like sizes k / tile times.  That is the
price of counting every link of a group of near copies; blocks of unlike documents stay small as long as the rare n-grams
tell them apart.  N-grams and classes are known by 64-bit hashes; two of a million different ones collide with a chance of 3e-8.

Edge cases: null and empty texts have empty sets and link with nothing; fewer words than n make one n-gram; repeated
rows share their class; a null doc_id never names a component unless all its members' are null; an empty table gives an
empty table; columns of the input are not passed on but for doc_id and those asked for.  Components that don't settle in 40 rounds
(a path of some billions of links) raise an error.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewise import SPACED, batches_of_texts, mix, words
from .common import connected_components, discard, free_name, owned, row_key, utf8, written

SHARD_BYTES = 4 << 20
MULT = np.uint64(0xD6E8FEB86659FD93)
#: What a class counts for in a tile, in n-grams, at least.
UNIT = 256


def ngram_sets(texts, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of an Arrow string array."""
    data, starts = utf8(texts)
    out: list[np.ndarray] = []
    for lo, hi in batches_of_texts(starts, SHARD_BYTES):
        part = starts[lo : hi + 1]
        h, bounds = words(data[part[0] : part[-1]], part - part[0], SPACED)
        grams = np.zeros(max(len(h) - n + 1, 0), np.uint64)
        for j in range(n):
            grams = mix(grams * MULT + h[j : j + len(grams)])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= n:
                g = np.sort(grams[a : b - n + 1])
                out.append(g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) > 1 else g)
            elif b > a:
                x = np.full(1, b - a, np.uint64)
                for w in h[a:b]:
                    x = mix(x * MULT + w)
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def least(size, percent: int):
    """The smallest size, and the smallest overlap, of a partner of a set of ``size``."""
    return (size * percent + 99) // 100


def surplus(size):
    """How many n-grams two prefixes share beyond none: the more, the fewer classes that share a passage alone meet in a block."""
    return (size + 9) // 10


class Node:
    """A run of elements below its parent; ``first`` to ``last`` are the places, in trie order, of the rows under it."""

    __slots__ = ("run", "kids", "ends", "low", "high", "rest", "end", "first", "last")

    def __init__(self, run, first: int):
        self.run, self.kids, self.ends, self.first, self.end = run, [], [], first, int(run[-1]) if len(run) else -1


def build_trie(rows: list[np.ndarray], sizes: list[int], order: list[int]) -> Node:
    """A compressed trie of the rows; ``rest`` is the most elements under a node, low and high bound the whole sets' sizes."""
    common = [0] * len(order)
    for i in range(1, len(order)):
        a, b = rows[order[i - 1]], rows[order[i]]
        m = min(len(a), len(b))
        diff = np.flatnonzero(a[:m] != b[:m])
        common[i] = int(diff[0]) if len(diff) else m

    root = Node(np.zeros(0, np.int64), 0)
    stack: list[tuple[Node, int]] = [(root, 0)]  # the path to the row before, with each node's depth at its end
    for i, r in enumerate(order):
        keep = common[i]
        while stack[-1][1] > keep:
            node, depth = stack.pop()
            above = stack[-1][1]
            if above < keep:  # split the node's run where the new row leaves it
                top = Node(node.run[: keep - above], node.first)
                node.run = node.run[keep - above :]
                top.kids.append(node)
                stack[-1][0].kids[-1] = top
                stack.append((top, keep))
        row = rows[r]
        if len(row) > keep:
            node = Node(row[keep:], i)
            stack[-1][0].kids.append(node)
            stack.append((node, len(row)))
        stack[-1][0].ends.append(r)

    todo, seen = [root], []
    while todo:
        node = todo.pop()
        seen.append(node)
        todo += node.kids
    for node in reversed(seen):
        own = [sizes[r] for r in node.ends]
        node.low = min(own + [k.low for k in node.kids])
        node.high = max(own + [k.high for k in node.kids])
        node.rest = max([k.rest + len(k.run) for k in node.kids], default=0)
        node.last = max([node.first + len(node.ends)] + [k.last for k in node.kids])
    return root


def similar_pairs(sets: list[np.ndarray], percent: int, probes: list[bool]) -> list[tuple[int, int]]:
    """Each similar pair (i, j) once: of a probe and a set that is none or, where all are probes, of any two sets.

    Similar sets share one of their rarest n - ceil(percent n) + 1 elements; a probe enters only subtrees with a row that does.
    """
    k, every = len(sets), all(probes)
    if k < 2:
        return []
    sizes = [len(s) for s in sets]
    flat = np.concatenate(sets)
    tokens, back, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, counts))] = np.arange(len(tokens))
    rare = int((counts == 1).sum())  # these rank first and are in no other set
    ranks = rank[back]
    rows, at = [], 0
    for n in sizes:
        r = np.sort(ranks[at : at + n])
        rows.append(r[np.searchsorted(r, rare) :] - rare)
        at += n
    order = sorted((i for i in range(k) if every or not probes[i]), key=lambda i: rows[i].astype(">u4").tobytes())
    if not order:
        return []
    root = build_trie(rows, sizes, order)
    prefixes = [row[: max(0, n - least(n, percent) + 1 - (n - len(row)))] for row, n in zip(rows, sizes)]
    own = [prefixes[r] for r in order]
    where = np.repeat(np.arange(len(order)), [len(x) for x in own])
    token = np.concatenate(own)
    by = np.argsort(token, kind="stable")
    where, begin = where[by], np.searchsorted(token[by], np.arange(len(tokens) - rare + 1))
    pairs = []
    has = np.zeros(max(len(tokens) - rare, 1), bool)
    for x in range(k):
        if not probes[x]:
            continue
        spans = [where[begin[t] : begin[t + 1]] for t in prefixes[x].tolist()]
        if not spans or sum(map(len, spans)) <= every:  # at most itself
            continue
        mark = np.zeros(len(order), bool)
        mark[np.concatenate(spans)] = True
        upto = np.concatenate([[0], np.cumsum(mark)]).tolist()
        own, n = rows[x], sizes[x]
        has[own] = True
        todo = [(root, 0)]
        while todo:
            node, got = todo.pop()
            if upto[node.last] == upto[node.first] or 100 * node.high < percent * n or percent * node.low > 100 * n:
                continue
            if len(node.run):
                got += int(np.count_nonzero(has[node.run]))
            need = (percent * (n + max(node.low, least(n, percent))) + 99 + percent) // (100 + percent)
            left = len(own) - int(np.searchsorted(own, node.end, "right"))
            for y in node.ends:
                if (y > x or not every) and 100 * got >= percent * (n + sizes[y] - got):
                    pairs.append((x, y))
            if node.kids and got + min(node.rest, left) >= need:
                todo += [(kid, got) for kid in node.kids]
        has[own] = False
    return pairs


def connecting(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Those of the pairs of numbers under ``size`` that connect what all of them connect."""
    parent = list(range(size))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for x, y in pairs:
        a, b = find(x), find(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((x, y))
    return links


def _sets(docs: DataFrame, schema: str, row, n: int) -> DataFrame:
    """``row(part, sets)``, a list of Arrow columns, for each part of ``docs`` (key, doc_id, text) and its n-gram sets."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays(row(part, ngram_sets(part.column("text"), n)), names=[c.split()[0] for c in schema.split(", ")])

    return docs.mapInArrow(work, schema)


def _class(s: np.ndarray) -> int | None:
    return int(mix(mix(s).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else None


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and cls (null for an empty set) of each document, with its key's fields id, h, n."""

    def row(part, sets):
        import pyarrow as pa

        return [part.column("id"), part.column("h"), part.column("n"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.int64())]

    rows = docs.select("key.*", "doc_id", "text")
    return _sets(rows, "id long, h long, n boolean, doc_id long, n_shingles long, cls long", row, n).select(F.struct("id", "h", "n").alias("key"), "doc_id", "n_shingles", "cls")


def _prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """cls, n and the prefix of each document that has a set."""

    def row(part, sets):
        import pyarrow as pa

        sets = [s for s in sets if len(s)]
        size = np.array([len(s) for s in sets], np.int64)
        take = size - least(size, percent) + surplus(size)
        ends = np.concatenate([[0], np.cumsum(take)])
        flat = np.concatenate([s[:t] for s, t in zip(sets, take.tolist())]) if len(sets) else np.zeros(0, np.uint64)
        return [pa.array([_class(s) for s in sets], pa.int64()), pa.array(size), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))]

    return _sets(docs.select("text"), "cls long, n long, prefix array<long>", row, n)


def _blocks(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, component): classes that may have links, with their block."""
    bound = lambda n: F.floor((F.floor((n * percent + 99) / 100) + 9) / 10)  # noqa: E731  the surplus of the smallest partner
    # hashes hardly compress, so a class's prefix is stored once, whatever the number of its documents
    prefixes = _prefixes(docs, n, percent).groupBy("cls").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    prefixes = written(prefixes, "prefixes")
    grams = prefixes.select("cls", "n", F.explode("prefix").alias("t"))
    # written, so that the join splits a hot n-gram's rows
    counts = written(grams.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c >= 2"), "counts")
    shared = grams.join(counts, "t").groupBy("cls").agg(F.first("n").alias("n"), F.collect_list(F.struct("c", "t")).alias("s"))
    shared = shared.where(F.size("s") >= bound(F.col("n"))).select("cls", F.explode(F.slice(F.sort_array("s"), 1, (F.size("s") - bound(F.col("n")) + 1).cast("int"))).alias("s"))
    rare = written(shared.select("cls", F.col("s.t").alias("t")), "rare")
    discard(prefixes, counts)
    hubs = written(rare.groupBy("t").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("c")).where("c >= 2").select("t", "hub"), "hubs")
    out = connected_components(rare.join(hubs, "t").select("cls", "hub"), "cls", "hub")
    discard(rare, hubs)
    return out


def _tiles(members: DataFrame, percent: int, tile: int) -> DataFrame:
    """Rows (block, i, j, cls, copies, probe, text): ``members`` (cls, n, copies, block, text) dealt to the pairs i <= j of tiles of their block.

    What runs over a whole block are counts by size, one row for each size that occurs in it.
    """
    room = tile * UNIT
    w = Window.partitionBy("block").orderBy((F.log("n") * 1e9).cast("long"))
    near = int(math.log(100 / percent) * 1e9) + 2  # sizes beyond 100 / percent times each other never link; a little more is harmless
    sizes = members.groupBy("block", "n").agg(F.count(F.lit(1)).alias("c"), F.sum(F.greatest(F.col("n"), F.lit(UNIT))).alias("weight"))
    upto = lambda lo, hi: F.coalesce(F.sum("weight").over(w.rangeBetween(lo, hi)), F.lit(0))
    past = Window.unboundedPreceding
    sizes = sizes.select("block", "n", (upto(past, 0) - F.col("weight")).alias("a"), upto(past, 0).alias("b"), (upto(past, near) - 1).alias("last"), (upto(past, near) - upto(-near, near)).alias("first"))
    part = lambda x: F.floor(F.col(x) / room) if isinstance(x, str) else F.floor(x / room)
    sizes = sizes.select("block", "n", part("a").alias("lo"), part(F.col("b") - 1).alias("hi"), part("first").alias("first"), part("last").alias("last"))
    own = F.col("lo") + F.pmod(F.xxhash64("cls"), F.col("hi") - F.col("lo") + 1)
    dealt = members.join(sizes, ["block", "n"]).withColumn("own", own).withColumn("other", F.explode(F.sequence("first", "last")))
    # the first tile's classes are the probes
    return dealt.select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "copies", (F.col("own") <= F.col("other")).alias("probe"), "text")


def _tile_links(tiles: DataFrame, n: int, percent: int) -> DataFrame:
    """Of each group (block, i, j) of rows (cls, copies, probe, text): links (a, b, 0) that connect it, and (a, a, n) for a class with n linked documents."""

    def work(batches):
        import pyarrow as pa

        now, rows = None, []

        def links():
            if len(rows) < 2:
                return []
            cls, copies, probes, sets = zip(*rows)
            alone = now[1] != now[2] and all(probes)  # the second tile is empty
            pairs = [] if alone else similar_pairs(list(sets), percent, list(probes))
            near = [0] * len(rows)  # summed here, so that a large group's pairs are never shuffled
            for a, b in pairs:
                near[a] += copies[b]
                near[b] += copies[a]
            return [(cls[a], cls[b], 0) for a, b in connecting(pairs, len(rows))] + [(c, c, m) for c, m in zip(cls, near) if m]

        def table(out):
            return pa.RecordBatch.from_pydict({name: pa.array([x[k] for x in out], pa.int64()) for k, name in enumerate("abn")})

        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                cols = [part.column(c).to_pylist() for c in ("block", "i", "j", "cls", "copies", "probe")]
                for (block, i, j, *row), s in zip(zip(*cols), ngram_sets(part.column("text"), n)):
                    if (block, i, j) != now:
                        out += links()
                        now, rows = (block, i, j), []
                    rows.append((*row, s))
            yield table(out)
        if rows:
            yield table(links())

    order = ["block", "i", "j"]
    dealt = tiles.repartition(*order).sortWithinPartitions(*order)
    return dealt.select(*order, "cls", "copies", "probe", "text").mapInArrow(work, "a long, b long, n long")


def jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85, tile: int = 256) -> DataFrame:
    """(doc_id, key, n_shingles, component, component_id, n_links) for each document; ``key`` is :func:`.common.row_key`, ``n_links`` the number of other documents it links with.

    ``component`` tells components apart (null for an empty set); components whose members have null or repeated ids may share a ``component_id``.
    ``tile`` is how many classes of up to ``UNIT`` n-grams a tile holds.
    """
    with owned(docs.sparkSession):
        return written(_joined(docs, n, percent, tile), "joined", own=False)


def _joined(docs: DataFrame, n: int, percent: int, tile: int) -> DataFrame:
    docs = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(_signatures(docs, n), "sets")
    classes = signed.where("cls is not null").groupBy("cls").agg(F.min(F.col("n_shingles")).alias("n"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "classes")
    blocks = _blocks(docs, n, percent)
    # one document of each class stands for it
    heads = blocks.select(F.col("node").alias("cls"), F.col("component").alias("block")).join(classes, "cls")
    members = docs.select("key", "text").join(heads, "key").select("cls", "n", "copies", "block", "text").dropDuplicates(["cls"])
    members = written(members, "members")
    links = written(_tile_links(_tiles(members, percent, tile), n, percent).groupBy("a", "b").agg(F.sum("n").alias("n")), "links")
    discard(members)
    near = links.where("a = b").select(F.col("a").alias("cls"), F.col("n").alias("near"))
    components = connected_components(links)
    # copies of one set link with each other and with all that their class links with
    each = classes.select("cls", "copies").join(components.select(F.col("node").alias("cls"), "component"), "cls", "left").join(near, "cls", "left")
    each = each.select("cls", F.coalesce("component", "cls").alias("component"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    # written, so that the join splits a large component
    named = written(signed.join(each, "cls", "left"), "named")
    ids = written(named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-ids")
    out = named.join(ids, "component", "left")
    return out.select("doc_id", "key", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id.  Repeated rows (same id and text) become one; documents without words all stay."""
    classes = jaccard_join(docs, n, percent)
    best = classes.where("n_shingles > 0").groupBy("component").agg(F.min("key").alias("key"))
    key = free_name(docs, "key")
    stay = best.select("key").unionByName(classes.where("n_shingles = 0").select("key")).distinct().withColumnRenamed("key", key)
    return docs.withColumn(key, row_key()).join(stay, key, "left_semi").dropDuplicates([key]).drop(key)
