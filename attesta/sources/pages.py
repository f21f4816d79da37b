"""Page sources: hashes, shape checks, identity, dates, links and versions, and front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A page shorter than this is not a whole act.
MIN_LENGTH = 100_000
VOLATILE = r'\s(?:data-nonce|nonce|data-timestamp)="[^"]*"'


def hashes(html: Column) -> dict[str, Column]:
    """sha256 of the page, and of the page without volatile attributes."""
    return {"sha256": F.sha2(html, 256), "sha256_normalized": F.sha2(F.regexp_replace(html, VOLATILE, ""), 256)}


def shape_problems(html: Column, own: Column, mark: str, least: int = MIN_LENGTH) -> Column:
    """An array of problems: too short, the marker missing, the page's own number missing."""
    tests = {f"shorter than {least}": F.length(html) < least, "marker missing": ~F.contains(html, F.lit(mark)), "own number missing": ~F.contains(html, own)}
    return F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(True)), k) for k, v in tests.items()]))


def plain_text(html: Column) -> Column:
    """The page without scripts, styles and tags, on one line."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(?:script|style)>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)", 1)


def stated_id(text: Column) -> Column:
    """The identifier with date that a consolidated text states of itself, ``0yyyyXnnnn-yyyymmdd``; null without one."""
    found = F.regexp_extract(text, r"\b(0\d{4}[A-Z]\d{4}-\d{8})\b", 1)
    return F.when(found != "", found)


def require_identity(stated: Column, wanted: Column) -> Column:
    """``ok``, or ``missing`` where nothing is stated; another identity fails the job."""
    return F.when(stated.isNull(), "missing").when(stated == wanted, "ok").otherwise(F.raise_error(F.concat(F.lit("identity differs: "), stated)).cast("string"))


def document_date(stated: Column, text: Column) -> tuple[Column, Column]:
    """(ISO date, basis): from the consolidated identifier, else from the first ``d.m.yyyy``; neither fails the job."""
    suffix = F.regexp_extract(stated, r"-(\d{4})(\d{2})(\d{2})$", 0)
    own = F.when(suffix != "", F.concat_ws("-", F.substring(suffix, 2, 4), F.substring(suffix, 6, 2), F.substring(suffix, 8, 2)))
    pattern = r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b"
    part = lambda i: F.regexp_extract(text, pattern, i)
    printed = F.when(text.rlike(pattern), F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))
    return F.coalesce(own, printed, F.raise_error(F.lit("no date")).cast("string")), F.when(own.isNotNull(), "consolidation").otherwise("publication")


def links(html: Column) -> Column:
    """Distinct link targets in order of first appearance, parentheses decoded."""
    raw = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))
    return F.array_distinct(F.transform(raw, lambda x: F.replace(F.replace(x, F.lit("%28"), F.lit("(")), F.lit("%29"), F.lit(")"))))


def manifest(pages: DataFrame, source: str = "table", language: str = "EN", mark: str = "</body>", least: int = MIN_LENGTH) -> DataFrame:
    """One row a page that says what was stored: hashes, size, title, the identity it states and its shape problems."""
    html = F.col("html")
    h = hashes(html)
    return pages.select(
        "page_id", F.lit(source).alias("source"), F.lit(language).alias("language"), F.col("url").alias("requested_url"), *[c.alias(k) for k, c in h.items()], F.lit(VOLATILE).alias("normalization"), stated_id(html).alias("stated_consolidation"),
        F.octet_length(html).cast("long").alias("bytes"), title(html).alias("doc_title"), shape_problems(html, F.col("page_id").cast("string"), mark, least).alias("shape_problems"),
    )


def write_raw(pages: DataFrame, path: str, **about) -> None:
    """``path/raw``: the pages as they came, as Parquet; ``path/manifest``: :func:`manifest` as JSON lines with nulls kept."""
    pages.select("page_id", "url", "html").write.mode("overwrite").parquet(f"{path}/raw")
    manifest(pages, **about).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/manifest")


def versions_of(catalog: DataFrame, base: str, column: str = "id") -> DataFrame:
    """Distinct consolidated ids of an act, sorted: those with its number behind a leading 0."""
    return catalog.where(F.startswith(F.col(column), F.concat(F.lit("0"), F.substring(F.lit(base), 2, len(base))))).select(column).distinct().orderBy(column)


def latest_version(catalog: DataFrame, by: str, version: str, stated: DataFrame | None = None) -> DataFrame:
    """(by, latest, versions): each key's greatest version; with a second opinion (by, stated), ``agrees`` too."""
    out = catalog.groupBy(by).agg(F.max(version).alias("latest"), F.countDistinct(version).alias("versions"))
    return out if stated is None else out.join(stated, by).withColumn("agrees", F.col("latest") == F.col("stated"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """(head as map of string to array of string, body) of a text that may begin with a ``---`` block of scalars and ``  - x`` lists."""
    pattern = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
    has = text.rlike(pattern)
    entries = F.split(F.regexp_extract(text, pattern, 1), r"\n(?=\S)")
    pair = lambda e: F.struct(
        F.regexp_extract(e, r"\A([^:\n]+):", 1).alias("k"),
        F.when(F.contains(e, F.lit("\n")), F.regexp_extract_all(e, F.lit(r"\n\s+-\s+([^\n]*)"), F.lit(1))).otherwise(F.array(F.trim(F.regexp_extract(e, r"\A[^:\n]+:\s*(.*)", 1)))).alias("v"),
    )
    return F.when(has, F.map_from_entries(F.transform(F.filter(entries, lambda e: e.rlike(r"\A[^:\n]+:")), pair))), F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text)


def with_front_matter(head: Column, body: Column) -> Column:
    """The inverse: one value is written as a scalar, several as a list, none not at all."""
    lines = F.transform(F.filter(F.map_entries(head), lambda e: F.size(e["value"]) > 0), lambda e: F.when(F.size(e["value"]) == 1, F.concat_ws(": ", e["key"], e["value"][0])).otherwise(F.concat(e["key"], F.lit(":\n  - "), F.array_join(e["value"], "\n  - "))))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), body)


def read_html(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(page_id, url, html) of HTML files, by name; any store Spark reads."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))
