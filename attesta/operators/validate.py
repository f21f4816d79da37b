"""Checks of numbered sequences, and of order between two conversions of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The Roman numerals one to twenty.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX")


#: Rows that a task sorts, at about.
ROWS = 250_000


def _dealt(df: DataFrame, by: str, rows: int = ROWS) -> DataFrame:
    """``df`` dealt to as many tasks as it has ``rows`` rows, each ``by`` whole in one, so that a task's memory doesn't grow with the input.  Counts when called."""
    return df.repartition(max(1, -(-df.count() // rows)), by)


def sequence_faults(rows: DataFrame, by: str, order: str | list[str], label: str) -> DataFrame:
    """(by, order, label, stem, fault): labels that are no number, repeat one, fall below the running maximum or leave a gap.

    A label is digits and perhaps letters; letters excuse a gap.  The running maximum is per ``by``, which bounds a window.
    """
    keys = [order] if isinstance(order, str) else order
    df = rows.select(by, *keys, F.col(label).cast("string").alias("label"))
    df = df.withColumns({"stem": F.expr("try_cast(regexp_extract(label, '^([0-9]+)[a-z]*$', 1) as bigint)"), "letter": F.regexp_extract("label", "^[0-9]+([a-z]*)$", 1) != ""})
    df = _dealt(df, by)
    w = Window.partitionBy(by).orderBy(*keys)
    top = F.max("stem").over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = F.row_number().over(Window.partitionBy(by, "label").orderBy(*keys))
    fault = F.when(F.col("stem").isNull(), "not-a-number").when(seen > 1, "repeat").when(F.col("stem") < top, "out-of-order").when((F.col("stem") > top + 1) & ~F.col("letter"), "gap")
    return df.withColumn("fault", fault).where("fault is not null").select(by, *keys, "label", "stem", "fault")


def roman_faults(rows: DataFrame, by: str, order: str, label: str) -> DataFrame:
    """(by, order, label, value): Roman numerals that are not the former's successor."""
    value = F.array_position(F.array(*[F.lit(r) for r in ROMAN]), F.upper(F.col(label))).cast("int")
    df = rows.select(by, order, F.col(label).alias("label"), value.alias("value"))
    before = F.lag("value").over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("before", before).where((F.col("value") == 0) | (F.col("value") != F.coalesce("before", F.lit(0)) + 1)).select(by, order, "label", "value")


def numbering_faults(rows: DataFrame, by: str, order: str | list[str], number: str) -> DataFrame:
    """(by, n, repeats, reversals, gaps, first_not_one): repeats and reversals are faults, skips and a late start only gaps."""
    keys = [order] if isinstance(order, str) else order
    w = Window.partitionBy(by).orderBy(*keys)
    df = rows.select(by, *keys, F.col(number).cast("long").alias("v"))
    top = F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumns({"top": top, "again": F.row_number().over(Window.partitionBy(by, "v").orderBy(*keys)) > 1})
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), count(F.col("again")).alias("repeats"), count((F.col("v") < F.col("top")) & ~F.col("again")).alias("reversals"), count(F.col("v") > F.col("top") + 1).alias("gaps"),
        F.max(F.col("top").isNull() & (F.col("v") != 1)).alias("first_not_one"),
    )


def empty_headings(marked: DataFrame) -> DataFrame:
    """Headings (rows with a level) that another heading or the end follows at once."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    nxt = marked.withColumns({"next": F.lead("level").over(w), "last": F.lead("pos").over(w).isNull()})
    return nxt.where(F.col("level").isNotNull() & (F.col("next").isNotNull() | F.col("last"))).select("doc_id", "pos", "level", "title")


def paragraph_numbers(marked: DataFrame) -> DataFrame:
    """(doc_id, pos, heading, number): numbers at the margin with the heading they stand under."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    df = marked.withColumn("heading", F.last("title", ignorenulls=True).over(w))
    return df.where(F.col("level").isNull() & F.col("par").rlike(r"^\d+[a-z]?\.")).select("doc_id", "pos", "heading", F.regexp_extract("par", r"^(\d+[a-z]?)\.", 1).alias("number"))


def order_splices(source: DataFrame, corpus: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """(key, pos, place, before): lines whose place in the corpus lies before that of the line before them in the source.

    Lines are joined by hash within a key; only those that occur once on either side count, so dropouts are no splices.
    """
    once = lambda df, name: df.select(key, F.col(pos).alias(name), F.sha2(F.col(text), 256).alias("h")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key, "h"))).where("n = 1").drop("n")
    both = once(source, "pos").join(once(corpus, "place"), [key, "h"])
    before = F.lag("place").over(Window.partitionBy(key).orderBy("pos"))
    return both.withColumn("before", before).where("place < before").select(key, "pos", "place", "before")


def reconcile(rows: DataFrame, base: str, state: Column, chars: str) -> DataFrame:
    """(base, emitted, dropped, difference) of characters: what one part drops should be what its sibling emits."""
    df = rows.select(base, state.alias("state"), F.col(chars).cast("long").alias("c"))
    out = df.groupBy(base).agg(F.coalesce(F.sum(F.when(F.col("state") == "emitted", F.col("c"))), F.lit(0)).alias("emitted"), F.coalesce(F.sum(F.when(F.col("state") != "emitted", F.col("c"))), F.lit(0)).alias("dropped"))
    return out.withColumn("difference", F.col("emitted") - F.col("dropped"))


def grid_faults(cells: DataFrame) -> DataFrame:
    """Tables (doc_id, table_no, row, col, ...) whose cells are not width times height many."""
    size = cells.groupBy("doc_id", "table_no").agg(F.count(F.lit(1)).alias("cells"), (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    return size.where("cells <> height * width")
