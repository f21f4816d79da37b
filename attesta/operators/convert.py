"""HTML to block rows, with every character accounted for.

A page is one row, so the tree work is a small helper inside ``mapInArrow``, with stacks instead of recursion, so that no depth
of markup stops a job; all that follows is relational.  A null or empty page has no rows, null ids pass through.  Each
text node ends ``emitted`` or ``drop:<rule>``; a node that nothing claims is ``unaccounted`` and :func:`require_accounted` fails on it.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The most columns and rows that HTML lets a cell span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
# HTML's void elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Which elements, classes or ids are dropped under which rule.
DROP_RULES = (
    ("script", ("script", "style", "noscript", "template"), ()),
    ("metadata", ("head", "title"), ()),
    ("navigation", ("nav", "menu"), ("nav", "menu", "toc", "breadcrumb")),
    ("advert", (), ("ad", "ads", "advert", "promo", "sponsor")),
    ("disclaimer", (), ("disclaimer", "notice", "cookie")),
    ("aside", ("aside",), ("sidebar",)),
    ("form", ("form", "button", "select", "textarea"), ()),
    ("masthead", ("header",), ("masthead",)),
    ("footer", ("footer",), ("footer",)),
)
CONTAINERS = frozenset("html body div section article main header footer nav aside table tbody thead tfoot ul ol dl form blockquote figure".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre figcaption caption address".split())
# What a point's marker looks like, and the beginnings of anchors by part of a document.
MARKER = re.compile(r"\(?[0-9A-Za-z]{1,5}[.)]|[—–•-]")
PARTS = (("recitals", "rct_"), ("enacting", "enc_"), ("enacting", "cpt_"), ("enacting", "art_"), ("annexes", "anx_"))
BLOCK_SCHEMA = "doc_id long, ord int, kind string, level int, text string, anchor string, table_no int, row int, col int"
NODE_SCHEMA = "doc_id long, node int, tag string, state string, chars int"
SIBLINGS = frozenset("p li dt dd tr td th".split())
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "text", "state")

    def __init__(self, tag: str, attrs: dict, up: Node | None, text: str | None = None):
        self.tag, self.attrs, self.kids, self.up, self.text, self.state = tag, attrs, [], up, text, None


class _Tree(HTMLParser):
    """A tolerant tree: an end tag closes up to the nearest open one of its name, and is ignored without one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: Counter[str] = Counter()

    def handle_starttag(self, tag, attrs):
        if tag == self.at.tag and tag in SIBLINGS:  # an open one of these ends where the next begins
            self.open[tag] -= 1
            self.at = self.at.up
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.open[tag] += 1
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        while self.open[tag]:
            done, self.at = self.at, self.at.up
            self.open[done.tag] -= 1
            if done.tag == tag:
                return

    def handle_data(self, data):
        self.at.kids.append(Node("#text", {}, self.at, data))


def parse(page: str) -> Node:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    return tree.root


def descend(node: Node, into=lambda kid: True):
    """All below a node in page order; ``into`` says below which of them to go on."""
    stack = [iter(node.kids)]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
            continue
        yield kid
        if into(kid):
            stack.append(iter(kid.kids))


def texts(node: Node):
    if node.text is not None:
        yield node
    yield from (kid for kid in descend(node) if kid.text is not None)


def drop_rule(node: Node) -> str | None:
    names = set(re.split(r"[\s_-]+", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()))
    for rule, tags, words in DROP_RULES:
        if node.tag in tags or names.intersection(words):
            return rule
    return None


def settle(node: Node, state: str) -> None:
    """Gives every text below a state; the first writer wins."""
    for t in texts(node):
        t.state = t.state or state


def inline(node: Node) -> str:
    """The running text below a node; a raised number directly after an opening parenthesis is a note mark, any other is written ``^n``."""
    frames: list[tuple] = [(iter(node.kids), [], False)]  # kids to come, text so far, whether it is raised
    while True:
        kids, out, raised = frames[-1]
        for kid in kids:
            if kid.text is not None:
                out.append(kid.text)
                kid.state = kid.state or "emitted"
            elif kid.tag == "br":
                out.append(" ")
            elif rule := drop_rule(kid):
                settle(kid, f"drop:{rule}")
            elif kid.tag == "sup" and next((x for x in reversed(out) if x.strip()), "").rstrip().endswith("("):
                settle(kid, "drop:note-mark")
            else:
                frames.append((iter(kid.kids), [], kid.tag == "sup"))
                break
        else:
            frames.pop()
            text = "^" + "".join(out).strip() if raised else "".join(out)
            if not frames:
                return text
            frames[-1][1].append(text)


def flat(text: str) -> str:
    return SPACE.sub(" ", text).strip()


def span(cell: Node, name: str, most: int) -> int:
    digits = cell.attrs.get(name, "1").strip()
    return max(1, min(most, int(digits[:7]))) if digits.isascii() and digits.isdigit() else 1


def grid(table: Node) -> list[list[str]]:
    """A table's cells with spans spread out: a continued cell is empty, rows without text are left out, all have one width."""
    rows, carried = [], {}
    for tr in (n for n in walk(table) if n.tag == "tr"):
        row, col = {}, 0
        held, carried = carried, {}
        for c, left in held.items():
            row[c] = ""
            if left > 1:
                carried[c] = left - 1
        for cell in (k for k in tr.kids if k.tag in ("td", "th")):
            while col in row:
                col += 1
            wide, high = span(cell, "colspan", MOST_COLUMNS), span(cell, "rowspan", MOST_ROWS)
            body = flat(inline(cell)).replace("|", "\\|")
            for i in range(wide):
                row[col + i] = body if i == 0 else ""
                if high > 1:
                    carried[col + i] = high - 1
            col += wide
        if any(row.values()):
            rows.append(row)
    width = max((max(r) + 1 for r in rows if r), default=0)
    return [[r.get(c, "") for c in range(width)] for r in rows]


def pair(node: Node) -> tuple[Node, Node] | None:
    """(marker, body) of an element that sets a point's marker beside its body: a grid-list of two blocks, or a table of one row and two cells."""
    if node.tag == "div" and "grid-list" in " ".join(node.attrs.get("class", "").split()):
        kids = [k for k in node.kids if k.tag in ("div", "p")]
    elif node.tag == "table":
        rows = [n for n in walk(node) if n.tag == "tr"]
        kids = [k for k in rows[0].kids if k.tag in ("td", "th")] if len(rows) == 1 else []
    else:
        return None
    return (kids[0], kids[1]) if len(kids) == 2 and MARKER.fullmatch(flat("".join(t.text for t in texts(kids[0])))) else None


def walk(node: Node):
    """All below a node, but for what tables hold."""
    return descend(node, lambda kid: kid.tag != "table")


def blocks(root: Node) -> list[tuple]:
    """(kind, level, text, anchor, table number, row, column) in page order."""
    out: list[tuple] = []
    tables = 0

    def say(kind, level, text, node, lead):
        if text and lead and kind != "heading":  # the marker belongs to the first line of its body
            kind, text = "point", f"{lead.pop()} {text}"
        if text:
            out.append((kind, level, text, node.attrs.get("id") or None, None, None, None))

    def flush(node: Node, depth: int, loose: list[Node], lead: list[str]) -> None:
        if loose:
            say("paragraph", depth, flat(inline(_gather(loose))), node, lead)
            loose.clear()

    # a node, its depth of lists, kids to come, inline kids not yet said, a marker not yet said
    frames: list[tuple] = [(root, 0, iter(root.kids), [], [])]
    while frames:
        node, depth, kids, loose, lead = frames[-1]
        for kid in kids:
            rule = drop_rule(kid) if kid.text is None else None
            if rule:
                flush(node, depth, loose, lead)
                settle(kid, f"drop:{rule}")
            elif both := pair(kid):
                flush(node, depth, loose, lead)
                mark, body = both
                frames.append((body, depth + 1, iter(body.kids), [], [flat(inline(mark))]))
                break
            elif kid.tag == "table":
                flush(node, depth, loose, lead)
                for r, row in enumerate(grid(kid)):
                    out.extend(("cell", 0, cell, None, tables, r, c) for c, cell in enumerate(row))
                tables += 1
                settle(kid, "emitted")
            elif kid.tag in LEAVES or kid.tag in CONTAINERS:
                flush(node, depth, loose, lead)
                if kid.tag in CONTAINERS or any(k.tag in LEAVES or k.tag in CONTAINERS for k in walk(kid)):
                    frames.append((kid, depth + (kid.tag in ("ul", "ol", "dl")), iter(kid.kids), [], lead))
                    break
                kind = "heading" if re.fullmatch("h[1-6]", kid.tag) else "point" if kid.tag in ("li", "dd", "dt") else "paragraph"
                say(kind, int(kid.tag[1]) if kind == "heading" else depth, flat(inline(kid)), kid, lead)
            else:
                loose.append(kid)
        else:
            flush(node, depth, loose, lead)
            frames.pop()
            if lead and (not frames or frames[-1][4] is not lead):  # nothing below had a line: the marker stands alone
                out.append(("point", depth, lead.pop(), node.attrs.get("id") or None, None, None, None))
    return out


def _gather(nodes: list[Node]) -> Node:
    top = Node("", {}, None)
    top.kids = list(nodes)
    return top


def _slices(batches, rows: int = 64):
    """A few pages at a time, so that a task holds the rows of these alone."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def convert(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """Block rows of each page (``BLOCK_SCHEMA``)."""

    def work(batches):
        import pyarrow as pa

        for part in _slices(batches):
            rows = [(d, i, *b) for d, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for i, b in enumerate(blocks(parse(page or "")))]
            cols = list(zip(*rows)) or [()] * 9
            types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

    return pages.select(F.col(doc).cast("long"), html).mapInArrow(work, BLOCK_SCHEMA)


def dispositions(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """(doc_id, node, tag, state, chars): each non-blank text node with what became of it; chars counts stripped text."""

    def work(batches):
        import pyarrow as pa

        for part in _slices(batches):
            rows = []
            for d, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                root = parse(page or "")
                blocks(root)
                rows += [(d, i, t.up.tag, t.state or "unaccounted", len(t.text.strip())) for i, t in enumerate(texts(root)) if t.text.strip()]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32()))], names=[x.split()[0] for x in NODE_SCHEMA.split(", ")])

    return pages.select(F.col(doc).cast("long"), html).mapInArrow(work, NODE_SCHEMA)


def disposition_report(nodes: DataFrame) -> DataFrame:
    """(doc_id, state, nodes, chars)."""
    return nodes.groupBy("doc_id", "state").agg(F.count(F.lit(1)).alias("nodes"), F.sum("chars").cast("long").alias("chars"))


def require_accounted(nodes: DataFrame) -> DataFrame:
    """``nodes``; an unaccounted one fails the job."""
    wrong = F.raise_error(F.concat(F.lit("unaccounted text in document "), F.col("doc_id").cast("string"))).cast("string")
    return nodes.withColumn("state", F.when(F.col("state") == "unaccounted", wrong).otherwise(F.col("state")))


def parts(rows: DataFrame) -> DataFrame:
    """Block rows with ``part``: recitals, enacting or annexes, from the last anchor that begins one; null before the first."""
    start = F.coalesce(*[F.when(F.startswith(F.col("anchor"), F.lit(prefix)), part) for part, prefix in PARTS])
    return rows.withColumn("part", F.last(start, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("ord")))


def merged_headings(rows: DataFrame) -> DataFrame:
    """Block rows in which a heading that a heading of the same level follows takes that one's text: ``label — title``."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    df = rows.withColumns({"nk": F.lead("kind").over(w), "nl": F.lead("level").over(w), "nt": F.lead("text").over(w), "pk": F.lag("kind").over(w), "pl": F.lag("level").over(w)})
    label = F.col("text").rlike(r"(?i)^(chapter|section|title|part|annex|article)\b[^—]*$")
    takes = (F.col("kind") == "heading") & (F.col("nk") == "heading") & (F.col("nl") == F.col("level")) & label
    df = df.withColumn("takes", F.coalesce(takes, F.lit(False)))
    df = df.withColumn("taken", F.coalesce(F.lag("takes").over(w), F.lit(False)))
    return df.where(~F.col("taken") | F.col("takes")).withColumn("text", F.when(F.col("takes"), F.concat_ws(" — ", "text", "nt")).otherwise(F.col("text"))).select(*rows.columns)


def markdown(rows: DataFrame) -> DataFrame:
    """(doc_id, text): block rows as markdown; a blank line parts blocks, but not the rows of a table."""
    cells = rows.where("kind = 'cell'").groupBy("doc_id", "table_no", "row").agg(F.min("ord").alias("ord"), F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), " | "), F.lit(" |")).alias("line"), F.count(F.lit(1)).alias("width"))
    rule = F.when(F.col("row") == 0, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("width").cast("int")))).otherwise("")
    table = cells.select("doc_id", "ord", F.concat("line", rule).alias("line"), F.lit(True).alias("is_row"))
    anchor = F.when(F.col("anchor").isNotNull(), F.concat(F.lit(" {#"), "anchor", F.lit("}"))).otherwise("")
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.least("level", F.lit(4))), F.lit(" "), "text", anchor)).when(F.col("kind") == "point", F.concat(F.repeat(F.lit("   "), F.greatest(F.col("level") - 1, F.lit(0))), F.lit("- "), "text")).otherwise(F.col("text"))
    rest = rows.where("kind <> 'cell'").select("doc_id", "ord", line.alias("line"), F.lit(False).alias("is_row"))
    both = table.unionByName(rest)
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = F.lag("is_row").over(w)
    gap = F.when(before.isNull(), "").when(F.col("is_row") & before, "\n").otherwise("\n\n")
    spaced = both.withColumn("line", F.concat(gap, F.col("line")))
    return spaced.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "").alias("text"))


def nested(rows: DataFrame) -> DataFrame:
    """Block rows with ``owner``: the last numbered paragraph of the section, to which unnumbered siblings belong."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    df = rows.withColumn("section", F.sum((F.col("kind") == "heading").cast("int")).over(w))
    number = F.when(F.col("kind") != "heading", F.when(F.col("text").rlike(r"^\d+[a-z]*\.(\s|$)"), F.regexp_extract("text", r"^(\d+[a-z]*)\.", 1)))
    return df.withColumn("owner", F.last(number, ignorenulls=True).over(Window.partitionBy("doc_id", "section").orderBy("ord")))
