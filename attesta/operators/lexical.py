"""A stored positional index, and what is read from it: BM25, phrases, proximity.

The index is split by document: a document belongs to one of many windows by the hash of its id, and all postings of a window lie in
one bucket of the table, sorted by term.  A row is the block of one term in one window: ids, frequencies and lengths side by side and
delta-coded places packed behind one another, with the largest frequency and the shortest length of the block, which bound what any of its documents can score.
So scores add up within a window, without a shuffle of postings, and only each question's best rows travel.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.analyze import PLAIN, Analyzer
from ..sources.scratch import _remove, scratch, shared_dir, written

K1, B = 1.2, 0.75
#: Documents of a window at about, windows of a bucket at most.
WINDOW, BUCKET = 512, 8
TERMS = "term string, df long, cf long"
#: Counts the forms that stored blocks have had, so that none is read as another.
LAYOUT = 2


def tf_part(tf: Column, dl: Column, avgdl: float) -> Column:
    """What a term's frequency gives in a document of ``dl`` words, before the term's own weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def idf(df: Column, n: int) -> Column:
    return F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))


def postings(docs: DataFrame, cid: str = "id", text: str = "text", analyzer: Analyzer = PLAIN, keep: list[str] | None = None) -> DataFrame:
    """(keep, id, dl, term, places): where each term of each document stands; dl counts all words, those of the stop list too."""
    keep = keep or []
    words = docs.select(*keep, F.col(cid).alias("id"), analyzer.words(text).alias("w"))
    rows = words.select(*keep, "id", F.size("w").cast("long").alias("dl"), F.posexplode("w").alias("at", "word"))
    if analyzer.stop:
        rows = rows.where(analyzer.kept(F.col("word")))
    found = rows.groupBy(*keep, "id", "dl", "word").agg(F.collect_list("at").alias("places"))
    if analyzer.stem:  # once for each distinct word of a document
        found = found.withColumn("word", analyzer.term(F.col("word"))).groupBy(*keep, "id", "dl", "word").agg(F.flatten(F.collect_list("places")).alias("places"))
    return found.select(*keep, "id", "dl", F.col("word").alias("term"), F.array_sort("places").alias("places"))


def index(docs: DataFrame, cid: str = "id", text: str = "text", analyzer: Analyzer = PLAIN) -> DataFrame:
    """(term, df, cf): in how many documents a term stands, and how often."""
    return postings(docs, cid, text, analyzer).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("places").cast("long")).alias("cf"))


@dataclass(frozen=True)
class Index:
    """blocks: window, term, df, max_tf, min_dl, ids, tfs, dls, gaps; terms: term, df, cf; n documents of avgdl words each.

    gaps: each place's distance from the document's one before, 32 bits each, for all documents of the block in turn; the first is the place itself.
    """

    blocks: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    analyzer: Analyzer
    path: str

    def asked(self, questions: DataFrame, qid: str = "question_id", qtext: str = "question") -> DataFrame:
        """(question_id, offset, term) of each kept word of the questions, in order."""
        a = self.analyzer
        rows = questions.select(F.col(qid).alias("question_id"), F.posexplode(a.words(qtext)).alias("offset", "word"))
        return rows.where(a.kept(F.col("word"))).select("question_id", "offset", a.term(F.col("word")).alias("term"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _columns(blocks: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)


def _window_blocks(batches):
    """Blocks of the windows that follow one another in ``batches`` (window, id, words, dl, perhaps kinds and terms), sorted by window and id."""
    import numpy as np
    import pyarrow as pa

    held = []
    for batch in batches:
        w = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(w[1:] != w[:-1]) + 1), len(w)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and hi > lo and held[0].column(0)[0].as_py() != w[lo]:
                yield from _blocks(pa.Table.from_batches(held).combine_chunks())
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield from _blocks(pa.Table.from_batches(held).combine_chunks())


def _blocks(rows):
    """The blocks of one window's documents."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def columns(rows):
        one = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        return {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in one.items()}

    one = columns(rows)
    ids, size = one["id"], one["dl"].to_numpy()
    # rows of one id and length are one document
    same = np.zeros(len(ids), bool)
    same[1:] = pc.equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
    if same.any():
        one = columns(rows.take(pa.array(np.lexsort((size, np.cumsum(~same))))))
        size = one["dl"].to_numpy()
        same[1:] &= size[1:] == size[:-1]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    doc = np.repeat(np.cumsum(~same) - 1, size)
    coded = one["words"].flatten().dictionary_encode()
    code, names = coded.indices.to_numpy(), coded.dictionary
    if "terms" in one:
        terms = one["terms"].flatten().take(pc.index_in(names, one["kinds"].flatten())).dictionary_encode()
        term = terms.indices.fill_null(-1).to_numpy()[code]
        code, names, at, doc = term[term >= 0], terms.dictionary, at[term >= 0], doc[term >= 0]
    if not len(code):
        return
    order = np.lexsort((at, doc, code)) if same.any() else np.argsort(code, kind="stable")
    code, doc, at = code[order], doc[order], at[order].astype(np.int32)
    new_term = np.ones(len(code), bool)
    new_term[1:] = code[1:] != code[:-1]
    new = new_term.copy()
    new[1:] |= doc[1:] != doc[:-1]
    posting = np.flatnonzero(new)
    gaps = at.copy()
    gaps[1:] -= at[:-1]
    gaps[posting] = at[posting]
    tf = np.diff(np.append(posting, len(code))).astype(np.int32)
    row = np.flatnonzero(~same)[doc[posting]]
    dl = size[row]
    block = np.flatnonzero(new_term[posting])
    bounds = pa.array(np.append(block, len(posting)).astype(np.int32))
    side = lambda x: pa.ListArray.from_arrays(bounds, x)
    ends = 4 * np.append(posting[block], len(code)).astype(np.int32)
    places = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(ends), pa.py_buffer(gaps)])
    window = np.full(len(block), one["window"][0].as_py(), np.int64)
    df = np.diff(np.append(block, len(posting))).astype(np.int64)
    cols = [pa.array(window), names.take(pa.array(code[posting[block]])), pa.array(df), pa.array(np.maximum.reduceat(tf, block)), pa.array(np.minimum.reduceat(dl, block))]
    cols += [side(ids.take(pa.array(row))), side(pa.array(tf)), side(pa.array(dl)), places]
    yield pa.RecordBatch.from_arrays(cols, names=["window", "term", "df", "max_tf", "min_dl", "ids", "tfs", "dls", "gaps"])


def build_index(docs: DataFrame, path: str, cid: str = "id", text: str = "text", analyzer: Analyzer = PLAIN, window: int = WINDOW) -> None:
    """Writes blocks, then terms, then stats, whose presence says that the index is whole.

    The texts are shuffled once, to their windows' buckets, and sorted by window; a task turns one window after the other into blocks and holds no
    more than one and a batch of rows, so a bucket's size costs time and no memory.  A null id is left out; a null text has no words, but counts as a document.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col(cid).isNotNull())
    n = docs.count()
    windows = max(1, -(-n // window))
    buckets = max(min(windows, 8), -(-windows // BUCKET))
    placed = docs.select(F.pmod(F.xxhash64(F.col(cid)), F.lit(windows)).alias("window"), F.col(cid).alias("id"), F.col(text).alias("text")).repartition(buckets, "window")
    # the texts are sorted, not their words, which take many times the room
    words = placed.sortWithinPartitions("window", "id").withColumn("words", analyzer.words("text")).drop("text").withColumn("dl", F.size("words").cast("long"))
    if analyzer.stop or analyzer.stem:  # once for each distinct word of a document
        words = words.withColumn("kinds", F.array_distinct("words")).withColumn("terms", F.transform("kinds", lambda w: F.when(analyzer.kept(w), analyzer.term(w))))
    kind = dict(placed.dtypes)["id"]
    schema = f"window long, term string, df long, max_tf int, min_dl long, ids array<{kind}>, tfs array<int>, dls array<long>, gaps binary"
    blocks = words.mapInArrow(_window_blocks, schema)
    name = "attesta_" + hashlib.sha1(path.encode()).hexdigest()
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    blocks.write.mode("overwrite").format("parquet").option("path", f"{path}/blocks").option("compression", "zstd").bucketBy(buckets, "window").sortBy("term").saveAsTable(name)
    stored = spark.read.schema(blocks.schema).parquet(f"{path}/blocks")
    cf = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
    stored.groupBy("term").agg(F.sum("df").alias("df"), F.sum(cf).alias("cf")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    words = docs.select(F.size(analyzer.words(text)).cast("long").alias("dl")).agg(F.sum("dl").alias("words")) if analyzer.stop else spark.read.schema(TERMS).parquet(f"{path}/terms").agg(F.sum("cf").alias("words"))
    words.select(F.lit(n).cast("long").alias("n"), F.coalesce("words", F.lit(0).cast("long")).alias("words"), F.lit(buckets).alias("buckets"), F.lit(_columns(blocks)).alias("columns")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str, analyzer: Analyzer = PLAIN) -> Index:
    """The index at ``path``; its blocks are read as a table bucketed by window, in a session that hasn't built it too."""
    s = spark.read.parquet(f"{path}/stats").first()
    name = "attesta_" + hashlib.sha1(path.encode()).hexdigest()
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({s.columns}) USING parquet CLUSTERED BY (window) SORTED BY (term) INTO {s.buckets} BUCKETS LOCATION '{path}/blocks'")
    return Index(spark.table(name), spark.read.schema(TERMS).parquet(f"{path}/terms"), s.n, s.words / s.n if s.words else 1.0, analyzer, path)


def fingerprint(docs: DataFrame) -> str:
    """A name for what ``docs`` would read now: its plan, and its files with their sizes and times."""
    context = docs.sparkSession.sparkContext
    conf, parts = context._jsc.hadoopConfiguration(), [str(docs.semanticHash()), str(docs.schema)]
    for f in sorted(docs.inputFiles()):
        p = context._jvm.org.apache.hadoop.fs.Path(f)
        status = p.getFileSystem(conf).getFileStatus(p)
        parts.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha1("\n".join(parts).encode()).hexdigest()


def stored_index(docs: DataFrame, cid: str = "id", text: str = "text", analyzer: Analyzer = PLAIN, prepare=None, tag: str = "") -> Index:
    """The index of ``docs`` in the shared folder, built where there is none yet of these files and this analyzer.

    Documents that come from no file have an index of their own each time, which goes like any scratch table.
    prepare: a function of the text column, for an index of what it gives; ``tag`` is its name.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(cid).alias("id"), F.col(text).alias("text"))
    files = bool(own.inputFiles())
    name = f"lexical-{fingerprint(own)}-{hashlib.sha1(f'{LAYOUT} {analyzer!r} {tag}'.encode()).hexdigest()[:8]}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}" if files else scratch(spark, "lexical")
    if not files or not _exists(spark, f"{path}/stats/_SUCCESS"):
        build_index(own.withColumn("text", prepare(F.col("text"))) if prepare else own, path, analyzer=analyzer)
    return read_index(spark, path, analyzer)


def drop_index(ix: Index) -> None:
    spark = ix.terms.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS attesta_{hashlib.sha1(ix.path.encode()).hexdigest()}")
    _remove(spark, [ix.path])


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("bm25"), "id")
    return scores.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def _scores(ix: Index, wanted: DataFrame, digits: int | None, live: DataFrame | None = None) -> DataFrame:
    """(question_id, id, bm25): the sums over ``wanted`` (question_id, term, idf); live: (window, asks), the questions that read a window, or all do.

    ``live`` grows with the documents: it is dealt to the windows' buckets, and never broadcast.
    """
    hit = ix.blocks.select("window", "term", "ids", "tfs", "dls").join(wanted, "term")
    if live is not None:
        hit = hit.join(live.hint("shuffle_hash"), "window").where(F.array_contains("asks", F.col("question_id")))
    rows = hit.select("window", "question_id", "idf", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("d"))
    weight = F.col("idf") * tf_part(F.col("d.tfs"), F.col("d.dls"), ix.avgdl)
    total = F.sum(weight) if digits is None else F.round(F.sum(weight), digits)
    return rows.groupBy("window", "question_id", F.col("d.ids").alias("id")).agg(total.alias("bm25")).drop("window")


def search(ix: Index, questions: DataFrame, k: int = 40, *, qid: str = "question_id", qtext: str = "question", digits: int = 6) -> DataFrame:
    """(question_id, id, bm25, lex_rank from 0) of the ``k`` best documents of each question; ties by id.

    First each question's rarest words are scored alone, enough of them to meet about four times ``k`` documents: the k-th best of these
    sums is a floor under the k-th best score.  Then a window of documents is read only where its blocks' bounds add up to the
    floor.  Both steps run when this is called, and what they write is a few rows a question and window.
    A question of no known term has no results.
    """
    asked = ix.asked(questions, qid, qtext).select("question_id", "term").distinct()
    asked = written(asked.join(ix.terms, "term").select("question_id", "term", "df", idf(F.col("df"), ix.n).alias("idf")), "asked")
    seen = F.sum("df").over(Window.partitionBy("question_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
    seeds = written(asked.withColumn("seen", seen).where((F.col("seen") < 4 * k) | F.col("seen").isNull()).select("question_id", "term", "idf"), "seeds")
    floor = _best(_scores(ix, seeds, None), k).where(F.col("r") == k).select("question_id", F.col("bm25").alias("floor"))
    bounds = ix.blocks.select("window", "term", "max_tf", "min_dl").join(asked.select("question_id", "term", "idf"), "term")
    bound = F.sum(F.col("idf") * tf_part(F.col("max_tf"), F.col("min_dl"), ix.avgdl))
    live = bounds.groupBy("window", "question_id").agg(bound.alias("bound")).join(written(floor, "floors"), "question_id", "left")
    live = live.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 10.0**-digits))
    live = written(live.groupBy("window").agg(F.collect_list("question_id").alias("asks")), "windows")
    best = _best(_scores(ix, asked.select("question_id", "term", "idf"), digits, live), k)
    return best.select("question_id", "id", "bm25", (F.col("r") - 1).alias("lex_rank"))


def bm25_topk(docs: DataFrame, questions: DataFrame, k: int = 40, *, cid: str = "id", text: str = "text", qid: str = "question_id", qtext: str = "question", digits: int = 6, analyzer: Analyzer = PLAIN) -> DataFrame:
    """:func:`search` in the stored index of ``docs``."""
    return search(stored_index(docs, cid, text, analyzer), questions, k, qid=qid, qtext=qtext, digits=digits)


def holding(ix: Index, wanted: DataFrame, rarest: int = 4) -> DataFrame:
    """(question_id, id) of the documents that hold the ``rarest`` terms of each question, or all where it has fewer; wanted: (question_id, term).

    A term that the index lacks is held by no document.
    """
    return _holding(ix, wanted, rarest).select("question_id", "id")


def _known(ix: Index, wanted: DataFrame) -> DataFrame:
    """(term, df) of the wanted terms that the index has: the terms of all documents are never the side that an outer join would broadcast."""
    return written(ix.terms.select("term", "df").join(wanted.select("term").distinct(), "term", "left_semi"), "known")


def _holding(ix: Index, wanted: DataFrame, rarest: int = 4) -> DataFrame:
    """:func:`holding`, with the window."""
    known = wanted.distinct().join(_known(ix, wanted), "term", "left")
    order = Window.partitionBy("question_id").orderBy(F.asc_nulls_first("df"), "term")
    few = written(known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rarest).select("question_id", "term"), "rarest")
    need = few.groupBy("question_id").agg(F.count(F.lit(1)).alias("need"))
    rows = ix.blocks.select("window", "term", "ids").join(few, "term").select("window", "question_id", F.explode("ids").alias("id"))
    held = rows.groupBy("window", "question_id", "id").agg(F.count(F.lit(1)).alias("have"))
    return held.join(need, "question_id").where("have = need").select("window", "question_id", "id")


def _kind(ix: Index) -> str:
    return ix.blocks.schema["ids"].dataType.elementType.simpleString()


def _spread(rows: DataFrame, keep: list[str], kind: str, joined: bool = False) -> DataFrame:
    """(keep, id, places) of each document in ``rows`` (keep, ids, tfs, gaps, perhaps some: the ids that are wanted); joined: places as text, parted by commas."""
    types = dict(rows.dtypes)
    some = "some" in types

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def spread(part):
            one = {c: part.column(c) for c in part.schema.names}
            each = one["ids"].value_lengths().to_numpy(zero_copy_only=False)
            ids, tf = one["ids"].flatten(), one["tfs"].flatten().to_numpy()
            at = np.frombuffer(one["gaps"].buffers()[1], np.int32)[one["gaps"].offset : one["gaps"].offset + len(part) + 1]
            gaps = np.frombuffer(one["gaps"].buffers()[2], np.uint8)[at[0] : at[-1]].view(np.int32).astype(np.int64)
            parent = np.repeat(np.arange(len(part)), each)
            first = np.cumsum(tf) - tf
            run = np.cumsum(gaps)
            places = (run - np.repeat(run[first] - gaps[first], tf)).astype(np.int32)
            if some:
                wanted = np.zeros(len(ids), bool)
                ends = np.cumsum(each)
                for k in range(len(part)):
                    lo, hi = int(ends[k] - each[k]), int(ends[k])
                    wanted[lo:hi] = pc.is_in(ids[lo:hi], one["some"][k].values).to_numpy(zero_copy_only=False)
                places, tf, parent, ids = places[np.repeat(wanted, tf)], tf[wanted], parent[wanted], ids.filter(pa.array(wanted))
            bounds = pa.array(np.concatenate([[0], np.cumsum(tf)]).astype(np.int32))
            out = pa.ListArray.from_arrays(bounds, pa.array(places).cast(pa.string()) if joined else pa.array(places))
            up = pa.array(parent)
            return pa.RecordBatch.from_arrays([*(one[c].take(up) for c in keep), ids, pc.binary_join(out, ",") if joined else out], names=[*keep, "id", "places"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                yield spread(batch.slice(lo, 256))

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f", id {kind}, places {'string' if joined else 'array<int>'}"
    return rows.select(*keep, "ids", "tfs", "gaps", *(["some"] if some else [])).mapInArrow(work, schema)


def positions(ix: Index) -> DataFrame:
    """(term, id, tf, places) as the index holds them."""
    return _spread(ix.blocks, ["term"], _kind(ix)).select("term", "id", F.size("places").cast("long").alias("tf"), "places")


def places_digest(ix: Index) -> DataFrame:
    """(term, df, places_md5): the md5 of ``id:place,place;id:place...`` of each term, in the order of ids.

    Blocks go to their term's task, and are spread and sorted there; a digest runs over the rows as they come, so no term is held whole.
    """
    rows = _spread(ix.blocks.select("term", "ids", "tfs", "gaps").repartition("term"), ["term"], _kind(ix), joined=True).sortWithinPartitions("term", "id")
    one = F.concat(F.lit(";"), F.col("id").cast("string"), F.lit(":"), "places")
    return rows.select("term", one.alias("x")).mapInArrow(_digests, "term string, df long, places_md5 string")


def _digests(batches):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def out(done):
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["term", "df", "places_md5"])

    term = df = md5 = None
    for batch in batches:
        terms, x, done = batch.column(0), batch.column(1), []
        if not len(terms):
            continue
        bounds = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
        data = memoryview(x.buffers()[2])
        cuts = [0, *(np.flatnonzero(pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)) + 1), len(terms)]
        for lo, hi in zip(cuts, cuts[1:]):
            name, first = terms[lo].as_py(), 0
            if name != term:
                if term is not None:
                    done.append((term, df, md5.hexdigest()))
                term, df, md5, first = name, 0, hashlib.md5(), 1  # the first row's semicolon parts it from nothing
            md5.update(data[int(bounds[lo]) + first : int(bounds[hi])])
            df += int(hi - lo)
        yield out(done)
    if term is not None:
        yield out([(term, df, md5.hexdigest())])


def _placed(ix: Index, asked: DataFrame) -> DataFrame:
    """(window, question_id, offset, id, places) of the asked terms in the documents that hold the rarest terms of a question, which may lack others.

    Places are read and decoded for these documents alone: a window's are joined to its blocks in its bucket, and blocks are cut to them before they are spread.
    """
    ids = _holding(ix, asked.select("question_id", "term")).groupBy("window", "question_id").agg(F.collect_list("id").alias("some"))
    live = written(ids.groupBy("window").agg(F.map_from_entries(F.collect_list(F.struct("question_id", "some"))).alias("asks")), "holders")
    rows = ix.blocks.select("window", "term", "ids", "tfs", "gaps").join(asked, "term").join(live.hint("shuffle_hash"), "window")
    rows = rows.withColumn("some", F.try_element_at("asks", F.col("question_id"))).where("some is not null").where(F.arrays_overlap("ids", "some"))
    return _spread(rows, ["window", "question_id", "offset"], _kind(ix))


def phrase_match(ix: Index, questions: DataFrame, *, qid: str = "question_id", qtext: str = "question") -> DataFrame:
    """(question_id, id, times, first): documents that hold the question's kept words at the same distances, how often and where first.

    A start is a place minus the word's offset; it counts where all offsets agree.
    """
    asked = written(ix.asked(questions, qid, qtext), "phrases")
    need = asked.groupBy("question_id").agg(F.count(F.lit(1)).alias("words"), F.min("offset").alias("lead"))
    starts = _placed(ix, asked).select("window", "question_id", "id", F.explode(F.transform("places", lambda p: p - F.col("offset"))).alias("at"))
    agreed = starts.groupBy("window", "question_id", "id", "at").agg(F.count(F.lit(1)).alias("n")).join(need, "question_id").where("n = words")
    return agreed.groupBy("window", "question_id", "id").agg(F.count(F.lit(1)).alias("times"), F.min(F.col("at") + F.col("lead")).cast("long").alias("first")).drop("window")


def near(ix: Index, questions: DataFrame, slop: int | None = None, *, qid: str = "question_id", qtext: str = "question") -> DataFrame:
    """(question_id, id, span): the fewest words in a row that hold all the question's terms, in any order; ``slop``: at most so many more than there are terms.

    A document's places are merged in order; at each the latest place of every term is known, and the span reaches back to the oldest of these.
    """
    asked = ix.asked(questions, qid, qtext).select("question_id", "term").distinct()
    number = F.row_number().over(Window.partitionBy("question_id").orderBy("term")) - 1
    asked = written(asked.withColumn("offset", number), "near")
    need = asked.groupBy("question_id").agg(F.max("offset").alias("top"))
    rows = _placed(ix, asked).groupBy("window", "question_id", "id").agg(F.count(F.lit(1)).alias("have"), F.sort_array(F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.alias("p"), F.col("offset").alias("t")))))).alias("m"))
    rows = rows.join(need, "question_id").where("have = top + 1").drop("have")
    none = F.lit(-(1 << 30))
    start = F.struct(F.transform(F.sequence(F.lit(0), F.col("top")), lambda _: none).alias("last"), F.lit(1 << 30).alias("best"))

    def step(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda v, i: F.when(i == x["t"], x["p"]).otherwise(v))
        oldest = F.array_min(last)
        return F.struct(last.alias("last"), F.least(s["best"], F.when(oldest >= 0, x["p"] - oldest + 1)).alias("best"))

    out = rows.select("question_id", "id", "top", F.aggregate("m", start, step, lambda s: s["best"]).cast("long").alias("span"))
    return (out if slop is None else out.where(F.col("span") <= F.col("top") + 1 + slop)).drop("top")
