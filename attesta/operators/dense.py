"""Exact cosine search of any number of questions against all rows, and an opt-in inverted file of cells."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import written

#: Question vectors that a task holds at once: at 1024 dimensions 16 MB, the bound of what is broadcast too.
BLOCK = 2048
#: Rows of a cell that one task meets with a block of questions.
STRIPE = 1 << 18


def cosine(a, b):
    """The dot product of two arrays (unit vectors), summed as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


class Best:
    """The k best rows so far of each of some questions; of equal scores the smallest id."""

    def __init__(self, ids: list, vectors, k: int, digits: int, pa_type):
        import numpy as np
        import pyarrow as pa

        self.ids, self.q, self.k, self.digits, self.pa_type = ids, np.asarray(vectors, np.float64), k, digits, pa_type
        self.best, self.place = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)  # scores, and whose they are
        self.names = pa.array([], pa_type)

    def meet(self, names, vectors) -> None:
        """One matrix product a batch."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(self.ids)
        m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1)
        s = np.concatenate([self.best, np.round(self.q @ m.T, self.digits)], axis=1)
        c = np.concatenate([self.place, np.broadcast_to(np.arange(len(self.names), len(self.names) + len(m)), (n, len(m)))], axis=1)
        every = pa.concat_arrays([self.names, names.cast(self.pa_type)])
        rank = np.empty(len(every), np.int64)
        rank[pc.sort_indices(every).to_numpy()] = np.arange(len(every))
        keep = np.lexsort((rank[c], -s), axis=1)[:, : self.k]
        self.best, place = np.take_along_axis(s, keep, 1), np.take_along_axis(c, keep, 1)
        used, place = np.unique(place, return_inverse=True)
        self.names, self.place = every.take(pa.array(used)), place.reshape(self.best.shape)

    def rows(self) -> Iterator:
        import pyarrow as pa

        wide = self.best.shape[1]
        if wide and len(self.ids):
            yield pa.RecordBatch.from_arrays([pa.array([i for i in self.ids for _ in range(wide)]), self.names.take(pa.array(self.place.ravel())), pa.array(self.best.ravel())], names=["question_id", "id", "dense"])


def _met_by_broadcast(rows: DataFrame, questions: DataFrame, k: int, digits: int, schema: str) -> DataFrame:
    """A block of questions goes out whole; every task keeps their k best of its rows."""
    asked = questions.collect()
    sent = rows.sparkSession.sparkContext.broadcast(([r[0] for r in asked], [r[1] for r in asked]))
    pa_type = to_arrow_type(rows.schema["id"].dataType)

    def work(batches):
        best = Best(*sent.value, k, digits, pa_type)
        for batch in batches:
            if batch.num_rows and len(best.ids):
                best.meet(batch.column(0), batch.column(1))
        yield from best.rows()

    return rows.select("id", "vector").mapInArrow(work, schema)


def _met_in_tiles(rows: DataFrame, questions: DataFrame, k: int, digits: int, schema: str) -> DataFrame:
    """rows (tile, id, vector) meet the questions (tile, question_id, vector) of their tile: these come first, ``BLOCK`` of them at most, then the rows stream past."""
    r_type, q_type = rows.schema["id"].dataType, questions.schema["question_id"].dataType
    pa_type = to_arrow_type(r_type)
    both = questions.select("tile", F.lit(0).alias("kind"), "question_id", F.lit(None).cast(r_type).alias("id"), "vector").unionByName(rows.select("tile", F.lit(1).alias("kind"), F.lit(None).cast(q_type).alias("question_id"), "id", "vector"))

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        tile, ids, vecs, best = None, [], [], None
        for batch in batches:
            t = batch.column("tile").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(t)) + 1).tolist(), len(t)] if len(t) else [0]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if t[a] != tile:
                    if best is not None:
                        yield from best.rows()
                    tile, ids, vecs, best = t[a], [], [], None
                asked = part.filter(pc.equal(part.column("kind"), pa.scalar(0, part.column("kind").type)))
                ids += asked.column("question_id").to_pylist()
                vecs += asked.column("vector").to_pylist()
                rest = part.slice(asked.num_rows)  # sorted by kind
                if rest.num_rows and ids:
                    best = best or Best(ids, vecs, k, digits, pa_type)
                    best.meet(rest.column("id"), rest.column("vector"))
        if best is not None:
            yield from best.rows()

    return both.repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(work, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("dense"), "id")
    return found.withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= k).withColumn("dense_rank", F.col("dense_rank") - 1)


def _sides(corpus: DataFrame, questions: DataFrame, cid: str, cvec: str, qid: str, qvec: str) -> tuple[DataFrame, DataFrame, str]:
    rows = corpus.where(F.col(cvec).isNotNull() & F.col(cid).isNotNull()).select(F.col(cid).alias("id"), F.col(cvec).alias("vector"))
    asked = questions.where(F.col(qvec).isNotNull()).select(F.col(qid).alias("question_id"), F.col(qvec).alias("vector"))
    return rows, asked, f"question_id {asked.schema['question_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, dense double"


def dense_topk(corpus: DataFrame, questions: DataFrame, k: int = 40, *, cid: str = "id", cvec: str = "embedding", qid: str = "question_id", qvec: str = "vector", digits: int = 9, block: int = BLOCK, stripes: int | None = None) -> DataFrame:
    """(question_id, id, dense, dense_rank from 0) of the ``k`` nearest rows of each question; ties by id.

    Up to ``block`` questions are broadcast, and each task keeps its k best, so what is shuffled is k rows a question and task.  More are cut
    into blocks by their hash and rows into stripes; a tile of a block and a stripe meets in one task, which holds the block and
    its k best while the rows stream past, and no question passes the driver.  The best of all tiles are merged in two steps, in each task and then by question.
    Rows without a vector and questions without one have no results.
    """
    rows, asked, schema = _sides(corpus, questions, cid, cvec, qid, qvec)
    n = asked.count()
    if n <= block:
        return _ranked(_met_by_broadcast(rows, asked, k, digits, schema), k)
    # a third more blocks than needed, so that an uneven hash fills none beyond what a task may hold
    blocks = -(-4 * n // (3 * block))
    stripes = stripes or int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = lambda b, s: F.col(b) * stripes + F.col(s)
    asked = asked.withColumn("b", F.pmod(F.xxhash64("question_id"), F.lit(blocks))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    rows = rows.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(stripes))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return _ranked(_met_in_tiles(rows.withColumn("tile", tile("b", "s").cast("long")), asked.withColumn("tile", tile("b", "s").cast("long")), k, digits, schema), k)


def centroids(corpus: DataFrame, cells: int, *, cid: str = "id", cvec: str = "embedding", sample: int = 50_000, rounds: int = 12, seed: int = 0):
    """``cells`` unit vectors by k-means over about ``sample`` rows, chosen by the hash of their id: the documented bound of what one task fits."""
    import numpy as np

    rows = corpus.where(F.col(cvec).isNotNull() & F.col(cid).isNotNull())
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64(F.lit(seed), cid), F.lit(1 << 20)) < min(1.0, sample / max(n, 1)) * (1 << 20)).select(F.xxhash64(cid).alias("h"), F.col(cvec).alias("v"))

    def work(batches):
        import pyarrow as pa

        parts = [(b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)) for b in batches if b.num_rows]
        if not parts:
            return
        x = np.concatenate([p[1] for p in parts])[np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")]
        c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
        for _ in range(rounds):
            near = np.argmax(x @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.float64()))], names=["c"])

    return np.array([r.c for r in some.repartition(1).mapInArrow(work, "c array<double>").collect()])


def _cells_of(df: DataFrame, center, probes: int) -> DataFrame:
    """``df`` (with ``vector``) and ``cell``: a row for each of the ``probes`` nearest centers."""
    import numpy as np

    sent = df.sparkSession.sparkContext.broadcast(np.asarray(center))

    @F.arrow_udf("array<int>")
    def nearest(vectors):
        import pyarrow as pa

        m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, sent.value.shape[1]))
        near = np.argsort(-(m @ sent.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
        return pa.ListArray.from_arrays(np.arange(0, near.size + 1, max(1, near.shape[1]), dtype=np.int32), pa.array(near.ravel()))

    return df.withColumn("cell", F.explode(nearest("vector")))


def inverted_file(corpus: DataFrame, path: str, cells: int = 64, *, cid: str = "id", cvec: str = "embedding", **kw):
    """Writes every row under its cell, and gives the centers.  The centers come from a bounded sample; all rows are indexed."""
    center = centroids(corpus, cells, cid=cid, cvec=cvec, **kw)
    rows = corpus.where(F.col(cvec).isNotNull() & F.col(cid).isNotNull()).select(F.col(cid).alias("id"), F.col(cvec).alias("vector"))
    (_cells_of(rows, center, 1) if len(center) else rows.withColumn("cell", F.lit(0))).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(path)
    return center


def probe(corpus: DataFrame, center, questions: DataFrame, k: int = 40, probes: int = 8, *, qid: str = "question_id", qvec: str = "vector", digits: int = 9, block: int = BLOCK, stripe: int = STRIPE) -> DataFrame:
    """Like :func:`dense_topk`, among the rows (cell, id, vector) of the ``probes`` cells nearest to each question.

    An approximation: with all cells probed it is exact.  A large cell is cut into stripes and its questions into blocks, by sizes counted first.
    """
    asked = questions.where(F.col(qvec).isNotNull()).select(F.col(qid).alias("question_id"), F.col(qvec).alias("vector"))
    schema = f"question_id {asked.schema['question_id'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, dense double"
    asked = written(_cells_of(asked, center, probes), "probes")
    # one row a cell: a bounded table of how it is cut
    sizes = corpus.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / stripe).alias("ns")).join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) * 4 / (3 * block)).alias("nb")), "cell")
    sizes = F.broadcast(written(sizes, "cells"))
    tile = F.xxhash64("cell", F.col("b").cast("long"), F.col("s").cast("long")).alias("tile")
    many = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = asked.join(sizes, "cell").withColumn("b", F.pmod(F.xxhash64("question_id"), F.col("nb"))).withColumn("s", many("ns")).select(tile, "question_id", "vector")
    r = corpus.join(sizes, "cell").withColumn("s", F.pmod(F.xxhash64("id"), F.col("ns"))).withColumn("b", many("nb")).select(tile, "id", "vector")
    return _ranked(_met_in_tiles(r, q, k, digits, schema), k)


def best_dense(questions: DataFrame, hits: DataFrame, qid: str = "question_id") -> DataFrame:
    """(question_id, best): the highest similarity of each question, 0 without hits."""
    top = hits.groupBy("question_id").agg(F.max("dense").alias("m"))
    return questions.select(F.col(qid).alias("question_id")).join(top, "question_id", "left").select("question_id", F.coalesce("m", F.lit(0.0)).alias("best"))


def gate(best: DataFrame, floor: float | None = 0.59) -> DataFrame:
    """``best`` with ``refused``: the best similarity is under the floor; without a floor nothing is refused."""
    return best.withColumn("refused", F.lit(False) if floor is None else F.col("best") < F.lit(floor))
