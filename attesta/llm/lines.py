"""Line deduplication by a log-template tree.

A line's variable fields (tokens with a digit or an at sign) become ``<*>``.  The tree has a fixed depth: the first
level is the number of tokens, the next ``depth`` levels are the leading tokens.  A leaf that too few documents reach
is closed.  In an open leaf a token that fewer than ``min_docs`` documents have at its position is a variable field
too, so that lines which differ in such fields meet in one template.  A template that ``min_docs`` or more documents
hold, with enough constant tokens, recurs.  Two kinds of line need no template: one of fewer than ``min_tokens`` tokens
recurs where ``min_docs`` documents hold just this line, and one of ``long_tokens`` tokens or more where ``long_docs`` do.

Of a recurring template the first occurrence (smallest doc_id, then line) stays and all later ones go, so that no content
vanishes where many documents are near copies; with ``keep_first=False`` all go.

Everything counts documents of different text: a document counts once however many alike lines it holds, and documents of
equal text count together as one.  A sum over lines would count a document with two alike lines twice; such documents are
found by themselves (their lines meet in one leaf) and what they count too much is taken off.  The tree's levels are
grouping keys, so no leaf is ever gathered: support is summed before each shuffle, and the joins back are sort-merge joins
that split hot lines.

Edge cases: a null text stays null and has no lines; an empty text stays empty; blank lines always stay; null doc_ids count
as the smallest id; of repeated rows (same id and text) all keep what the first keeps; an empty table gives an empty table;
of the input's columns only ``text`` and, if there is one, ``n_chars`` change, and ``n_lines`` and ``n_dropped`` are set.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, let, replaced, row_key, written

VARIABLE = r"[^\s]*[0-9@][^\s]*"


@dataclass(frozen=True)
class LineParams:
    depth: int = 3
    min_docs: int = 10
    #: shorter lines have no template: only the very line recurs
    min_tokens: int = 4
    #: share of a recurring template's tokens that are constant, at least
    constant_share: float = 0.6
    #: a line of so many tokens is a passage, and recurs in ``long_docs`` documents
    long_tokens: int = 50
    long_docs: int = 2
    keep_first: bool = True


def masked_tokens(line: Column) -> Column:
    masked = F.when(line.rlike("[0-9@]"), F.regexp_replace(line, VARIABLE, "<*>")).otherwise(line)
    return F.array_remove(F.split(masked, r"\s"), "")


def _lines(docs: DataFrame, p: LineParams) -> DataFrame:
    """A row for each line with a token: key, idx, its number of tokens, the hash lh of its masked tokens and the leaf it falls into; a short line has no leaf and its own hash."""
    rows = docs.select(row_key().alias("key"), F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    rows = rows.select("key", "idx", "line", masked_tokens(F.col("line")).alias("tok")).where(F.size("tok") > 0)
    short = F.size("tok") < p.min_tokens
    own = F.xxhash64(F.lit("short"), F.trim(F.regexp_replace("line", r"\s+", " ")))
    leaf = F.when(~short, F.xxhash64(F.size("tok"), F.slice("tok", 1, p.depth)))
    return rows.select("key", "idx", F.size("tok").alias("size"), F.when(short, own).otherwise(F.xxhash64("tok")).alias("lh"), leaf.alias("leaf"))


def templates(docs: DataFrame, rows: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """(lh, first) for each line that recurs, with the place where its template first stands; ``rows`` are the written lines of ``docs``."""
    # documents of equal text count once, by the text's hash; hashes alone are shuffled
    held = rows.groupBy("lh", F.col("key.h").alias("c")).agg(F.first("leaf").alias("leaf"), F.first("size").alias("size"), F.min(F.struct("key", "idx")).alias("first"))
    counts = held.groupBy("lh").agg(F.first("leaf").alias("leaf"), F.first("size").alias("size"), F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    counts = written(counts.where(F.col("leaf").isNotNull() | (F.col("n") >= p.min_docs)), "line-counts")
    exact = (F.col("leaf").isNull() & (F.col("n") >= p.min_docs)) | ((F.col("size") >= p.long_tokens) & (F.col("n") >= p.long_docs))
    # a sum over a leaf's lines is at least its number of documents
    leaves = counts.where("leaf is not null").groupBy("leaf").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("lines")).where(F.col("s") >= p.min_docs)
    leaves = written(leaves.select("leaf", "lines"), "leaves")
    open_lines = written(counts.join(leaves.select("leaf"), "leaf", "left_semi").select("leaf", "lh", "n", "first"), "open-lines")
    # lines of one document in one leaf: what they share is counted once for each of them
    several = rows.where("leaf is not null").join(leaves.where("lines > 1").select("leaf"), "leaf", "left_semi")
    several = several.groupBy("leaf", F.col("key.h").alias("c")).agg(F.collect_set("lh").alias("lhs")).where(F.size("lhs") > 1).select("leaf", "c", F.explode("lhs").alias("lh"))
    several = written(several, "several")
    # the words of an open line are read where it first stands
    places = open_lines.groupBy(F.col("first.key").alias("key")).agg(F.collect_list(F.struct("first.idx", "lh")).alias("places"))
    # the number of open lines grows with the input: sorted and merged at every size, never broadcast
    text = docs.select(row_key().alias("key"), "text").join(places.hint("merge"), "key").select(let(F.split("text", "\n"), lambda x: F.transform("places", lambda y: F.struct(y["lh"].alias("lh"), F.get(x, y["idx"]).alias("line")))).alias("x"))
    text = text.select(F.explode("x").alias("x")).select("x.lh", masked_tokens(F.col("x.line")).alias("tok")).dropDuplicates(["lh"])
    tokens = written(open_lines.join(text, "lh").select("leaf", "lh", "n", "first", "tok"), "tokens")
    sizes = tokens.select("leaf", "lh", "n", "first", F.size("tok").alias("size"))
    each = tokens.select("leaf", "lh", "n", F.posexplode("tok").alias("pos", "t")).where("t <> '<*>'")
    twice = several.join(tokens.select("leaf", "lh", "tok"), ["leaf", "lh"]).select("leaf", "c", F.posexplode("tok").alias("pos", "t")).where("t <> '<*>'")
    twice = twice.groupBy("leaf", "c", "pos", "t").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("leaf", "pos", "t", (1 - F.col("k")).alias("n"))
    constant = each.select("leaf", "pos", "t", "n").unionByName(twice).groupBy("leaf", "pos", "t").agg(F.sum("n").alias("s")).where(F.col("s") >= p.min_docs).drop("s")
    constant = written(constant, "constant")  # so that the join splits a hot token's lines
    fixed = each.join(constant, ["leaf", "pos", "t"]).groupBy("leaf", "lh").agg(F.collect_list(F.struct("pos", "t")).alias("fixed"))
    # in a leaf, whose lines have equally many tokens, the constant tokens and their places are the template
    enough = F.size("fixed") >= p.constant_share * F.col("size")
    general = sizes.join(fixed, ["leaf", "lh"]).where(enough).select("leaf", "lh", "n", "first", F.xxhash64(F.sort_array("fixed")).alias("th"))
    general = written(general, "general")
    again = several.join(general.select("leaf", "lh", "th"), ["leaf", "lh"]).groupBy("leaf", "c", "th").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    again = again.select("leaf", "th", (1 - F.col("k")).alias("n"), F.lit(None).cast(general.schema["first"].dataType).alias("first"))
    support = general.select("leaf", "th", "n", "first").unionByName(again).groupBy("leaf", "th").agg(F.sum("n").alias("s"), F.min("first").alias("first"))
    support = written(support.where(F.col("s") >= p.min_docs).select("leaf", "th", "first"), "support")
    alike = general.select("leaf", "lh", "th").join(support, ["leaf", "th"]).select("lh", "first")
    out = written(alike.unionByName(counts.where(exact).select("lh", "first")).groupBy("lh").agg(F.min("first").alias("first")), "recurring")
    discard(counts, leaves, open_lines, several, tokens, constant, general, support)
    return out


def line_dedup(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """``docs`` with ``text`` less its recurring lines, ``n_lines`` and ``n_dropped``; ``n_chars``, where there is one, follows the text."""
    rows = written(_lines(docs, p), "lines")
    recurring = templates(docs, rows, p)
    found = rows.select("key", "idx", "lh").join(recurring, "lh")
    gone = found.where(F.struct("key", "idx") != F.col("first")) if p.keep_first else found
    name, key = free_name(docs, "gone"), free_name(docs, "key")
    gone = written(gone.groupBy("key").agg(F.collect_set("idx").alias(name)).withColumnRenamed("key", key), "gone")
    discard(rows, recurring)
    df = docs.withColumn(key, row_key()).join(gone.hint("merge"), key, "left")
    lines, gone = F.split("text", "\n"), F.col(name)
    stay = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)), "\n"))
    kept = F.when(gone.isNull(), F.col("text")).otherwise(stay)
    new = {
        "text": kept,
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_dropped": F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long"),
    }
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(gone.isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return replaced(df, new).drop(name, key)
