"""Pages as trees of numbered nodes, and what part of a document each node plays.

A node's ``pre`` counts nodes in page order and ``last`` is the ``pre`` of the last node below it, so that one node holds another where
its interval does: ancestors, descendants and everything under an id are range tests on two numbers, without a path or a loop.
Page ids name pages: rows of one id are taken as one tree.  A page is one row of its table, which bounds every window here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .convert import parse

TREE_SCHEMA = "doc_id long, pre int, last int, up int, depth int, tag string, ident string, classes string, href string, text string"

# How the parts of an act are marked, first match first: role, part of the document, what its id looks like, its class names.
ROLES = (
    ("drop:script", None, None, "script", ()),
    ("drop:amendment-marker", None, None, None, ("modref", "arrow")),
    ("drop:disclaimer", None, None, None, ("disclaimer",)),
    ("drop:reference", None, None, None, ("reference",)),
    ("drop:modifiers-toc", None, None, None, ("hd-modifiers",)),
    ("recital", "recitals", r"^rct_([0-9]+)$", None, ()),
    ("article", "enacting", r"^art_([0-9]+[a-z]*)$", None, ()),
    ("annex", "enacting", r"^anx_([IVXL]+[a-z]*)$", None, ()),
    ("formula", "enacting", r"^fnp_(.*)$", None, ()),
    ("drop:title", None, None, None, ("eli-main-title", "title-doc-first", "title-doc-last", "title-doc-oj-reference", "oj-hd-ti", "oj-hd-coll", "oj-hd-lg", "oj-hd-date", "oj-hd-uniq")),
    ("division", "enacting", None, None, ("title-division-1", "oj-ti-section-1")),
    ("division-title", "enacting", None, None, ("title-division-2", "oj-ti-section-2")),
    ("footnote", "both", None, None, ("footnote", "oj-note")),
    ("drop:eli-line", "enacting", None, None, ("oj-normal",)),
)
# Class names of an article's number and title and of an annex's headings.
NUMBER, TITLE, ANNEX = ("title-article-norm", "oj-ti-art"), ("stitle-article-norm", "oj-sti-art"), ("title-annex-1", "title-annex-2", "oj-doc-ti")
CELEX = r"(?i)celex[:/](3\d{4}[A-Z]\d{4}(?:R(?:%28|\()\d+(?:%29|\)))?)"


def page_tree(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """A row for each element and each text of each page (``TREE_SCHEMA``); the root is no node, a null or empty page has none."""

    def work(batches):
        import pyarrow as pa

        types = (pa.int64(), *[pa.int32()] * 4, *[pa.string()] * 5)
        names = [x.split()[0] for x in TREE_SCHEMA.split(", ")]
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part, rows = batch.slice(lo, 64), []
                for d, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    # open nodes: their row, and the children still to come
                    stack = [(-1, iter(parse(page or "").kids))]
                    base = len(rows)
                    while stack:
                        up, kids = stack[-1]
                        kid = next(kids, None)
                        if kid is None:
                            stack.pop()
                            if up >= 0:
                                rows[base + up][2] = len(rows) - base - 1
                            continue
                        pre = len(rows) - base
                        a = kid.attrs
                        rows.append([d, pre, pre, None if up < 0 else up, len(stack) - 1, kid.tag, a.get("id") or None, " ".join(a.get("class", "").split()) or None, a.get("href"), kid.text])
                        if kid.text is None:
                            stack.append((pre, iter(kid.kids)))
                cols = list(zip(*rows)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return pages.select(F.col(doc).cast("long"), html).mapInArrow(work, TREE_SCHEMA)


def under(nodes: DataFrame, tops: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, top, pre) of the nodes within the intervals of ``tops`` (doc_id, pre, last); ``strict``: without the tops themselves."""
    t = tops.select(F.col("doc_id").alias("__d"), F.col("pre").alias("top"), F.col("last").alias("__l"))
    inside = (F.col("pre") > F.col("top")) if strict else (F.col("pre") >= F.col("top"))
    return nodes.join(t, F.col("doc_id").eqNullSafe(F.col("__d")) & inside & (F.col("pre") <= F.col("__l"))).select("doc_id", "top", "pre")


def has_class(names: tuple[str, ...], classes: str = "classes") -> Column:
    return F.arrays_overlap(F.split(F.coalesce(F.col(classes), F.lit("")), " "), F.array(*[F.lit(n) for n in names]))


def outermost(nodes: DataFrame, mark: Column, name: str = "owner") -> DataFrame:
    """``nodes`` with ``name``: the ``pre`` of the topmost marked node that holds a node or is it, null where none does.

    One pass in page order: a marked node beyond everything that earlier marked ones reach is topmost, and what follows belongs to the last of these as far as it reaches.
    """
    before = Window.partitionBy("doc_id").orderBy("pre")
    reach = F.max(F.when(F.col("__m"), F.col("last"))).over(before.rowsBetween(Window.unboundedPreceding, -1))
    df = nodes.withColumn("__m", F.coalesce(mark, F.lit(False))).withColumn("__r", reach)
    df = df.withColumn("__t", F.when(F.col("__m") & (F.col("__r").isNull() | (F.col("__r") < F.col("pre"))), F.struct("pre", "last")))
    df = df.withColumn("__o", F.last("__t", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn(name, F.when(F.col("__o.last") >= F.col("pre"), F.col("__o.pre"))).drop("__m", "__r", "__t", "__o")


def roles(nodes: DataFrame, part: str) -> DataFrame:
    """``nodes`` with ``role`` and ``number``: the first rule that a node meets, ``drop:not-this-part`` where the rule belongs to the other part of the document."""
    role, number = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, where, ident, tag, classes in reversed(ROLES):
        fits = F.col("ident").rlike(ident) if ident else F.col("tag").isin("script", "style") if tag else has_class(classes)
        fits = F.col("text").isNull() & F.coalesce(fits, F.lit(False))
        if where and where not in ("both", part) and name.startswith("drop:"):
            continue
        told = name if where in (None, "both", part) else "drop:not-this-part"
        role = F.when(fits, F.lit(told)).otherwise(role)
        number = F.when(fits, F.regexp_extract("ident", ident, 1) if ident else F.lit(None).cast("string")).otherwise(number)
    return nodes.withColumns({"role": role, "number": number})


def _text(rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, owner, name): the texts of each owner in page order, on one line."""
    return rows.groupBy("doc_id", "owner").agg(_line(F.array_sort(F.collect_list(F.struct("pre", "text")))).alias(name))


def _line(texts: Column | str) -> Column:
    """The texts of an array of (pre, text), which is sorted, on one line."""
    joined = F.array_join(F.transform(texts, lambda x: x["text"]), "")
    return F.trim(F.regexp_replace(joined, r"(?U)\s+", " "))


def structural_walk(nodes: DataFrame, part: str = "enacting") -> DataFrame:
    """(doc_id, ord, role, number, heading, anchor, text): the parts of each act in order.

    part: enacting (articles, annexes, divisions, formula, footnotes) or recitals.  The topmost node that a rule knows claims all below it; what a
    rule drops has a row of role ``drop:<rule>``, so that every text is in one row, and text that no rule knows is in rows ``unaccounted``, one for each
    node.  heading: an article's number and title, an annex's label and titles, a division's label with the title that follows it at once.
    ``nodes`` is read once and shuffled once, by page.
    """
    if part not in ("enacting", "recitals"):
        raise ValueError("an act has enacting terms and recitals")
    kind = F.when(has_class(NUMBER), 0).when(has_class(TITLE), 1).when(has_class(ANNEX), 2)
    # the other elements have neither a role nor a heading
    telling = nodes.where("text is not null or ident is not null or classes is not null or tag in ('script', 'style')")
    marked = roles(telling, part).withColumn("__k", F.when(F.col("text").isNull() & F.col("classes").isNotNull(), kind))
    claimed = outermost(marked.select("doc_id", "pre", "last", "ident", "text", "role", "number", "__k"), F.col("role").isNotNull())
    heads = outermost(claimed, F.col("__k").isNotNull() & (F.col("pre") != F.col("owner")), "head")
    # a text that nothing claims is a row of its own; all groups lie within a page, so no more is shuffled
    one = heads.where(F.col("owner").isNotNull() | F.col("text").rlike(r"(?U)\S")).withColumn("ord", F.coalesce("owner", "pre"))
    said = one.groupBy("doc_id", "ord", "head").agg(
        F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pre", "text")))).alias("texts"), F.max(F.when(F.col("head") == F.col("pre"), F.col("__k"))).alias("__k"),
        F.max(F.when(F.col("owner") == F.col("pre"), F.struct("role", "number", "ident"))).alias("own"),
    )
    head = F.when(F.size("texts") > 0, F.struct("head", _line("texts").alias("said")))
    rows = said.groupBy("doc_id", "ord").agg(_line(F.array_sort(F.flatten(F.collect_list("texts")))).alias("text"), F.max("own").alias("own"), *[F.array_sort(F.collect_list(F.when(F.col("__k") == k, head))).alias(n) for k, n in enumerate(("numbers", "titles", "labels"))])
    rows = rows.select("doc_id", "ord", F.coalesce("own.role", F.lit("unaccounted")).alias("role"), "own.number", F.col("own.ident").alias("anchor"), "text", "numbers", "titles", "labels")
    first = lambda c: F.try_element_at(c, F.lit(1))["said"]
    more = F.transform(F.slice("labels", F.lit(2), F.greatest(F.size("labels"), F.lit(1))), lambda x: x["said"])
    annex = F.concat_ws(" — ", F.coalesce(first(F.col("labels")), F.concat(F.lit("ANNEX "), F.col("number"))), _blank(F.array_join(more, " ")))
    heading = F.when(F.col("role") == "article", F.concat_ws(" — ", _blank(first(F.col("numbers"))), _blank(first(F.col("titles"))))).when(F.col("role") == "annex", annex).when(F.col("role").isin("division", "division-title"), F.col("text"))
    rows = rows.select("doc_id", "ord", "role", "number", heading.alias("heading"), "anchor", "text")
    # a division's title goes to the division's label where it follows at once
    kept = Window.partitionBy("doc_id", "__d").orderBy("ord")
    rows = rows.withColumn("__d", F.startswith("role", F.lit("drop:")).cast("int") + 2 * (F.col("role") == "unaccounted").cast("int"))
    rows = rows.withColumns({"__n": F.lead("role").over(kept), "__h": F.lead("heading").over(kept), "__p": F.lag("role").over(kept)})
    takes = (F.col("role") == "division") & (F.col("__n") == "division-title")
    rows = rows.withColumn("heading", F.when(takes, F.concat_ws(" — ", "heading", "__h")).otherwise(F.col("heading"))).where(~((F.col("role") == "division-title") & F.coalesce(F.col("__p") == "division", F.lit(False))))
    return rows.drop("__d", "__n", "__h", "__p")


def _blank(c: Column) -> Column:
    return F.when(c != "", c)


def modifying_acts(nodes: DataFrame) -> DataFrame:
    """(doc_id, relation, acts): what a consolidation folds in, and whether it amends or corrects.

    The relation is read from the last modifiers' table that names one, and is ``amended_by`` without; acts are the distinct ids in links, in page order.
    """
    tables = nodes.where(F.col("text").isNull() & has_class(("hd-modifiers",)))
    texts = nodes.where("text is not null").select("doc_id", "pre", "text")
    held = under(texts, tables).join(texts, ["doc_id", "pre"]).select("doc_id", F.col("top").alias("owner"), "pre", "text")
    named = _text(held, "t").select("doc_id", "owner", F.lower(F.regexp_extract("t", r"(?i)(amended|corrected)\s+by", 1)).alias("r")).where("r <> ''")
    relation = named.groupBy("doc_id").agg(F.max_by("r", "owner").alias("r"))
    acts = nodes.select("doc_id", "pre", F.regexp_extract(F.coalesce("href", F.lit("")), CELEX, 1).alias("a")).where("a <> ''")
    acts = acts.select("doc_id", "pre", F.upper(F.replace(F.replace("a", F.lit("%28"), F.lit("(")), F.lit("%29"), F.lit(")"))).alias("a"))
    own = acts.groupBy("doc_id", "a").agg(F.min("pre").alias("pre")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pre", "a"))).alias("x"))
    every = nodes.select("doc_id").distinct().join(relation, "doc_id", "left").join(own, "doc_id", "left")
    return every.select("doc_id", F.concat(F.coalesce("r", F.lit("amended")), F.lit("_by")).alias("relation"), F.coalesce(F.transform("x", lambda s: s["a"]), F.array().cast("array<string>")).alias("acts"))
