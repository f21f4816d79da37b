"""The registered queries on the given tables, each with DuckDB SQL that must give the same rows where SQL can say it.

Questions are the items of ``benchmark``; a question's vector is the row of ``embeddings`` of its number, and vectors belong to the
documents of their number.  Answers are written around what lexical search found.  Markdown is made of documents' lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.models import REFUSAL
from ..operators import chunk as K
from ..operators import convert, dense, evaluate, fuse, lexical, order, regime, tree, validate, verify
from ..sources import chunks as C
from ..sources import pages as P
from ..sources.scratch import written
from .session import RagSession, pack_context

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            return df.select(*[F.col(c).cast("long") if t == "int" else F.col(c) for c, t in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def joined(c: Column | str) -> Column:
    return F.array_join(c, ",")


# ---- retrieval -------------------------------------------------------------------------------------------------------------

DENSE_SQL = """
dense AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dense DESC, id) - 1 AS dense_rank FROM (
      SELECT b.item_id AS question_id, e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS dense
      FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id CROSS JOIN embeddings e)) WHERE dense_rank < 40
)"""
TOKENS_SQL = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
LEX_SQL = f"""
toks AS (SELECT doc_id AS id, {TOKENS_SQL.format("text")} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM toks) GROUP BY id, dl, term),
asked AS (SELECT DISTINCT question_id, term FROM (SELECT item_id AS question_id, unnest({TOKENS_SQL.format("text")}) AS term FROM benchmark)),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
lex AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, id) - 1 AS lex_rank FROM (
      SELECT question_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25
      FROM asked JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY question_id, id)) WHERE lex_rank < 40
)"""
FUSED_SQL = """
fused AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, dense_rank ASC NULLS LAST, lex_rank ASC NULLS LAST) - 1 AS rank FROM (
      SELECT question_id, id, coalesce(dense, 0.0) AS dense, dense_rank, lex_rank, round(coalesce(1 / (60 + dense_rank), 0.0) + coalesce(1 / (60 + lex_rank), 0.0), 9) AS rrf
      FROM dense FULL OUTER JOIN lex USING (question_id, id))) WHERE rank < 20
)"""
RERANK_SQL = f"""
kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank DESC, rank) - 1 AS place FROM (
      SELECT f.question_id, f.id, f.dense, f.rrf, f.rank,
             round(len(list_intersect(list_distinct({TOKENS_SQL.format("b.text")}), list_distinct({TOKENS_SQL.format("d.text")}))) / len(list_distinct({TOKENS_SQL.format("b.text")})), 6) AS rerank
      FROM fused f JOIN documents d ON d.doc_id = f.id JOIN benchmark b ON b.item_id = f.question_id)) WHERE place < 5
)"""


def questions(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def vectors(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), "embedding")


def asked_vectors(t) -> DataFrame:
    return questions(t).join(t("embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")), "question_id")


def documents(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def dense_leg(t) -> DataFrame:
    return dense.dense_topk(vectors(t), asked_vectors(t), 40)


def lexical_leg(t) -> DataFrame:
    return lexical.bm25_topk(documents(t), questions(t), 40)


def kept(t) -> DataFrame:
    return fuse.rerank(fuse.rrf(dense_leg(t), lexical_leg(t)), questions(t), documents(t))


@query("""
SELECT question_id, id, dense, dense_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dense DESC, id) - 1 AS dense_rank FROM (
    SELECT q.vec_id AS question_id, e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS dense
    FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 50 = 0)) WHERE dense_rank < 40""")
def dense_topk(t):
    """The 40 nearest vectors of the stated query set, the vectors whose number 50 divides."""
    q = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return dense.dense_topk(vectors(t), q, 40)


GATE_SQL = """
SELECT question_id, best{} FROM (
  SELECT q.vec_id AS question_id, coalesce(max(CASE WHEN e.vec_id <> q.vec_id THEN round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) END), 0.0) AS best
  FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id)"""


def _best(t) -> DataFrame:
    q = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return dense.best_dense(q, dense.dense_topk(vectors(t), q, 2).where("id <> question_id"))


@query(GATE_SQL.format(""))
def best_dense(t):
    return _best(t)


@query(GATE_SQL.format(", best < 0.59 AS refused"))
def gate(t):
    return dense.gate(_best(t))


def stored(t) -> lexical.Index:
    return lexical.stored_index(documents(t))


def build_indexes(spark: SparkSession, sf_dir: str) -> None:
    """Builds what the queries below find stored: the index of the documents, and that of their normalised texts."""
    docs = documents(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    lexical.stored_index(docs)
    verify.normalized_index(docs)


@query(f"WITH {LEX_SQL} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term")
def bm25_index(t):
    return stored(t).terms


PLACES_SQL = f"places AS (SELECT id, unnest(w) AS term, unnest(range(0, len(w))) AS p FROM (SELECT doc_id AS id, {TOKENS_SQL.format('text')} AS w FROM documents))"


@query(f"""WITH {PLACES_SQL} SELECT term, count(*) AS df, md5(string_agg(id || ':' || pl, ';' ORDER BY id)) AS places_md5 FROM (SELECT term, id, string_agg(p, ',' ORDER BY p) AS pl FROM places GROUP BY term, id) GROUP BY term""")
def bm25_positions(t):
    """Every place of every term, as the index holds them."""
    return lexical.places_digest(stored(t))


@query(f"""WITH {PLACES_SQL}, asked AS (SELECT question_id, len(q) AS n, unnest(q) AS term, unnest(range(0, len(q))) AS k FROM (SELECT item_id AS question_id, {TOKENS_SQL.format("text")} AS q FROM benchmark)),
starts AS (SELECT question_id, id, p - k AS start FROM places JOIN asked USING (term) GROUP BY question_id, id, p - k, n HAVING count(*) = n)
SELECT question_id, id, count(*) AS times, min(start) AS first FROM starts GROUP BY question_id, id""")
def phrase_match(t):
    """Documents that hold an item's words in a row."""
    return lexical.phrase_match(stored(t), questions(t))


@query(f"""WITH {PLACES_SQL}, asked AS (SELECT DISTINCT item_id AS question_id, unnest({TOKENS_SQL.format("text")}) AS term FROM benchmark),
need AS (SELECT question_id, count(*) AS n FROM asked GROUP BY question_id),
hits AS (SELECT question_id, id, term, p FROM places JOIN asked USING (term)),
full_ AS (SELECT question_id, id FROM hits GROUP BY question_id, id HAVING count(DISTINCT term) = (SELECT n FROM need WHERE need.question_id = hits.question_id)),
own AS (SELECT h.* FROM hits h JOIN full_ USING (question_id, id)),
latest AS (SELECT a.question_id, a.id, a.p, b.term, max(b.p) AS last FROM own a JOIN own b ON b.question_id = a.question_id AND b.id = a.id AND b.p <= a.p GROUP BY ALL),
spans AS (SELECT question_id, id, p - min(last) + 1 AS span, count(*) AS n FROM latest GROUP BY question_id, id, p)
SELECT question_id, id, min(span) AS span FROM spans JOIN need USING (question_id, n) GROUP BY question_id, id""")
def near_match(t):
    """The fewest words in a row that hold all terms of an item, in every document that has them all."""
    return lexical.near(stored(t), questions(t))


@query(f"WITH {LEX_SQL} SELECT question_id, id, bm25, lex_rank FROM lex")
def bm25_topk(t):
    return lexical_leg(t)


@query(f"WITH {DENSE_SQL}, {LEX_SQL}, {FUSED_SQL} SELECT question_id, id, dense, rrf, rank FROM fused")
def rrf_fusion(t):
    return fuse.rrf(dense_leg(t), lexical_leg(t))


@query(f"WITH {DENSE_SQL}, {LEX_SQL}, {FUSED_SQL}, {RERANK_SQL} SELECT question_id, id, dense, rrf, rank, rerank, place FROM kept")
def hybrid_retrieve(t):
    return kept(t).select("question_id", "id", "dense", "rrf", "rank", "rerank", "place")


@query(f"""WITH {LEX_SQL}
SELECT question_id, md5(string_agg('[' || id || '] Document ' || id || chr(10) || text, chr(10) || chr(10) ORDER BY lex_rank)) AS context_md5, CAST(count(*) AS BIGINT) AS sources
FROM lex JOIN documents ON doc_id = id WHERE lex_rank < 5 GROUP BY question_id""")
def context_pack(t):
    docs = documents(t).select("id", F.concat(F.lit("Document "), F.col("id").cast("string")).alias("citation"), F.col("text").alias("body"))
    best = written(lexical_leg(t).where("lex_rank < 5").select("question_id", "id", F.col("lex_rank").alias("place")), "best")
    n = best.groupBy("question_id").agg(F.count(F.lit(1)).alias("sources"))
    return pack_context(best, docs).select("question_id", F.md5("context").alias("context_md5")).join(n, "question_id")


# ---- text ------------------------------------------------------------------------------------------------------------------

FOLD_SQL = "replace(translate({}, '‘’“”—–', '''''\"\"--'), '…', '...')"
NORM_SQL = "lower(trim(regexp_replace(regexp_replace(" + FOLD_SQL + r", '\[[a-z0-9-]+#[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g')))"
NEEDLE_SQL = "trim(" + NORM_SQL + ", ' .,;:')"


@query(f"SELECT doc_id, md5({FOLD_SQL.format('text')}) AS folded FROM documents")
def fold_punct(t):
    return t("documents").select("doc_id", F.md5(T.fold_punct("text")).alias("folded"))


@query(f"SELECT doc_id, md5({NORM_SQL.format('text')}) AS normalized FROM documents")
def normalize_text(t):
    return t("documents").select("doc_id", F.md5(T.normalize("text")).alias("normalized"))


# ---- answers and their verification ----------------------------------------------------------------------------------------

#: An answer quotes the item and cites the best document, quotes two parts of it with a refined id of the second best, repeats the
#: item without an id, and ends in an invented quote with an unknown id.
ANSWER_SQL = f"""
tops AS (SELECT question_id, max(CASE WHEN lex_rank = 0 THEN id END) AS a, max(CASE WHEN lex_rank = 1 THEN id END) AS b FROM lex GROUP BY question_id),
answers AS (
  SELECT item_id AS question_id, 'It says “' || text || '” [doc-s#' || a || '].' || chr(10)
    || 'Also "' || substr(text, 1, 30) || '" and "' || substr(text, 31, 40) || '" [doc-s#' || coalesce(b, a) || '(2)] as well.' || chr(10)
    || 'Again: "' || text || '".' || chr(10) || 'Lastly "nobody ever wrote this sentence" [doc-x#9] stands.' AS answer
  FROM benchmark JOIN tops ON question_id = item_id),
sources AS (SELECT question_id, lex_rank AS rank, 'doc-s#' || id AS id, {NORM_SQL.format("text")} AS body_norm FROM lex JOIN documents ON doc_id = id WHERE lex_rank < 5),
segs AS (SELECT question_id, unnest(s) AS segment, generate_subscripts(s, 1) - 1 AS seg_no FROM (SELECT question_id, regexp_split_to_array({FOLD_SQL.format("answer")}, '\\n+') AS s FROM answers)),
spanned AS (
  SELECT question_id, seg_no, segment, trim(regexp_extract(segment, '(?s)^[^"]*"(.*)"', 1)) AS outer_,
         list_filter(list_transform(regexp_extract_all(segment, '"([^"]*)"', 1), lambda x: trim(x)), lambda x: length(x) >= 20) AS pairs
  FROM segs WHERE regexp_matches(segment, '(?s)".*"')),
long_ AS (SELECT * FROM spanned WHERE length(outer_) >= 20)"""
SEGMENT_SQL = f"""
outers AS (
  SELECT l.*, (SELECT arg_min(s.id, s.rank) FROM sources s WHERE s.question_id = l.question_id AND {NEEDLE_SQL.format("l.outer_")} <> '' AND contains(s.body_norm, {NEEDLE_SQL.format("l.outer_")})) AS source_id FROM long_ l),
split_ AS (SELECT question_id, seg_no, unnest(pairs) AS span, generate_subscripts(pairs, 1) - 1 AS pos FROM outers WHERE source_id IS NULL AND len(pairs) > 0),
quotes AS (
  SELECT question_id, seg_no, 0 AS pos, outer_ AS span, source_id, 'outer' AS reading FROM outers WHERE source_id IS NOT NULL OR len(pairs) = 0
  UNION ALL
  SELECT p.question_id, p.seg_no, p.pos, p.span, (SELECT arg_min(s.id, s.rank) FROM sources s WHERE s.question_id = p.question_id AND {NEEDLE_SQL.format("p.span")} <> '' AND contains(s.body_norm, {NEEDLE_SQL.format("p.span")})), 'pair' FROM split_ p)"""
IDS_SQL = r"""
cited AS (
  SELECT question_id, cid, CAST(row_number() OVER (PARTITION BY question_id ORDER BY i) - 1 AS BIGINT) AS pos FROM (
    SELECT question_id, cid, min(i) AS i FROM (
      SELECT question_id, unnest(m) AS cid, generate_subscripts(m, 1) AS i FROM (SELECT question_id, regexp_extract_all(answer, '\[([a-z0-9-]+#[^\]]*)\]', 1) AS m FROM answers)) GROUP BY question_id, cid)),
classes AS (
  SELECT question_id, pos, cid, base, CASE WHEN base IS NULL THEN 'unknown' WHEN base = cid THEN 'known' ELSE 'refined' END AS class FROM (
    SELECT c.*, (SELECT arg_min(s.id, CASE WHEN s.id = c.cid THEN -1 ELSE s.rank END) FROM sources s WHERE s.question_id = c.question_id AND (s.id = c.cid OR starts_with(c.cid, s.id || '('))) AS base FROM cited c))"""
ATTRIBUTION_SQL = r"""
marks AS (
  SELECT question_id, seg_no, m[i] AS mark, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS mpos FROM (
    SELECT question_id, seg_no, regexp_extract_all(segment, '\[[a-z0-9-]+#[^\]]*\]') AS m, regexp_split_to_array(segment, '\[[a-z0-9-]+#[^\]]*\]') AS gaps,
           unnest(range(1, len(regexp_extract_all(segment, '\[[a-z0-9-]+#[^\]]*\]')) + 1)) AS i FROM segs)),
near AS (
  SELECT q.*, (SELECT arg_min(substr(m.mark, 2, length(m.mark) - 2), m.mpos) FROM marks m WHERE m.question_id = q.question_id AND m.seg_no = q.seg_no AND m.mpos >= instr(s.segment, q.span) - 1 + length(q.span)) AS cid
  FROM quotes q JOIN segs s ON s.question_id = q.question_id AND s.seg_no = q.seg_no),
attributed AS (
  SELECT n.question_id, n.seg_no, n.pos, n.span, n.source_id, n.reading, n.cid, c.base,
         CASE WHEN n.cid IS NULL THEN 'unattributed' WHEN c.base IS NULL THEN 'unknown' WHEN contains(s.body_norm, """ + NEEDLE_SQL.format("n.span") + r""") THEN 'ok' ELSE 'misattributed' END AS status
  FROM near n LEFT JOIN classes c ON c.question_id = n.question_id AND c.cid = n.cid LEFT JOIN sources s ON s.question_id = n.question_id AND s.id = c.base),
wrong AS (
  SELECT question_id, span, cid AS cited, source_id AS actual FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id, span ORDER BY seg_no DESC, pos DESC) AS r FROM attributed WHERE source_id IS NOT NULL) WHERE r = 1 AND status = 'misattributed')"""
CHECK_SQL = f"WITH {LEX_SQL}, {ANSWER_SQL}, {SEGMENT_SQL}, {IDS_SQL}, {ATTRIBUTION_SQL}"


def answers(t, leg: DataFrame | None = None) -> DataFrame:
    top = (lexical_leg(t) if leg is None else leg).groupBy("question_id").agg(F.max(F.when(F.col("lex_rank") == 0, F.col("id"))).alias("a"), F.max(F.when(F.col("lex_rank") == 1, F.col("id"))).alias("b"))
    x, a, b = F.col("question"), F.col("a").cast("string"), F.coalesce("b", "a").cast("string")
    line = F.concat(
        F.lit("It says “"), x, F.lit("” [doc-s#"), a, F.lit("].\nAlso \""), F.substring(x, 1, 30), F.lit('" and "'), F.substring(x, 31, 40), F.lit('" [doc-s#'), b,
        F.lit('(2)] as well.\nAgain: "'), x, F.lit('".\nLastly "nobody ever wrote this sentence" [doc-x#9] stands.'),
    )
    return questions(t).join(top, "question_id").select("question_id", line.alias("answer"))


def sources(t, leg: DataFrame | None = None) -> DataFrame:
    best = (lexical_leg(t) if leg is None else leg).where("lex_rank < 5")
    rows = best.join(documents(t), "id").select("question_id", F.col("lex_rank").alias("rank"), F.concat(F.lit("doc-s#"), F.col("id").cast("string")).alias("id"), F.col("text").alias("body"))
    return verify.normalized_sources(rows)


def _checked(t):
    leg = written(lexical_leg(t), "leg")
    a, s = written(answers(t, leg), "answers"), written(sources(t, leg), "sources")
    q = written(verify.read_segments(a, s), "quotes")
    return a, s, q, verify.attribution(a, q, s)


@query(f"""WITH {LEX_SQL}, {ANSWER_SQL} SELECT question_id, seg_no, outer_ AS span, array_to_string(pairs, '|') AS pairs FROM long_""")
def quote_spans(t):
    seg = verify.answer_segments(answers(t)).withColumn("span", T.outer_span("segment")).where(F.length("span") >= T.MIN_SPAN)
    return seg.select("question_id", "seg_no", "span", F.array_join(T.quote_pairs("segment"), "|").alias("pairs"))


@query(f"{CHECK_SQL} SELECT question_id, seg_no, pos, span, source_id, reading FROM quotes")
def segment_reading(t):
    return _checked(t)[2].select("question_id", "seg_no", "pos", "span", "source_id", "reading")


@query(f"SELECT b.item_id AS span_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains({NORM_SQL.format('d.text')}, {NEEDLE_SQL.format('b.text')}) WHERE {NEEDLE_SQL.format('b.text')} <> ''")
def verify_spans(t):
    """Every benchmark item against every document."""
    return verify.indexed_containment(t("benchmark").select(F.col("item_id").alias("span_id"), F.col("text").alias("span")), documents(t).select("id", "text"))


@query(f"{CHECK_SQL} SELECT question_id, string_agg(cid, ' ' ORDER BY pos) AS ids FROM cited GROUP BY question_id")
def cited_ids(t):
    return answers(t).select("question_id", F.array_join(T.cited_ids("answer"), " ").alias("ids"))


@query(f"{CHECK_SQL} SELECT question_id, pos, cid, class, base FROM classes")
def id_classes(t):
    leg = written(lexical_leg(t), "leg")
    return verify.classify_ids(answers(t, leg), sources(t, leg))


@query(f"{CHECK_SQL} SELECT question_id, seg_no, pos, span, source_id, reading, cid, base, status FROM attributed")
def attribution(t):
    return _checked(t)[3].select("question_id", "seg_no", "pos", "span", "source_id", "reading", "cid", "base", "status")


@query(f"{CHECK_SQL} SELECT * FROM wrong")
def misattributed(t):
    return verify.misattributed(_checked(t)[3])


@query(f"""{CHECK_SQL} SELECT count(*) AS spans, count(cid) AS attributed, CAST(sum(CASE WHEN source_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unverified,
CAST(sum(CASE WHEN source_id IS NOT NULL AND status = 'misattributed' THEN 1 ELSE 0 END) AS BIGINT) AS misattributed, CAST(sum(CASE WHEN status = 'unattributed' THEN 1 ELSE 0 END) AS BIGINT) AS without_id, CAST(sum(CASE WHEN status = 'unknown' THEN 1 ELSE 0 END) AS BIGINT) AS unknown_id FROM attributed""")
def attribution_totals(t):
    return evaluate.attribution_totals(_checked(t)[3])


@query(f"""{CHECK_SQL} SELECT a.question_id, coalesce(n_quotes, 0) AS n_quotes, CAST(coalesce(n_missed, 0) AS BIGINT) AS n_missed, CAST(coalesce(n_unknown, 0) AS BIGINT) AS n_unknown, coalesce(n_wrong, 0) AS n_wrong,
  coalesce(n_missed, 0) = 0 AND coalesce(n_unknown, 0) = 0 AND coalesce(n_wrong, 0) = 0 AS verified FROM answers a
LEFT JOIN (SELECT question_id, count(*) AS n_quotes, sum(CASE WHEN source_id IS NULL THEN 1 ELSE 0 END) AS n_missed FROM quotes GROUP BY 1) USING (question_id)
LEFT JOIN (SELECT question_id, sum(CASE WHEN class = 'unknown' THEN 1 ELSE 0 END) AS n_unknown FROM classes GROUP BY 1) USING (question_id)
LEFT JOIN (SELECT question_id, count(*) AS n_wrong FROM wrong GROUP BY 1) USING (question_id)""")
def verified_answers(t):
    a, s, q, x = _checked(t)
    return verify.verified(a, q, verify.classify_ids(a, s), verify.misattributed(x))


@query("""SELECT doc_id, source || ', Article ' || doc_id || CASE WHEN lang = 'en' THEN ' (consolidated text as of 2024-01-' || lpad(CAST(n_chars % 28 + 1 AS VARCHAR), 2, '0') || ')' ELSE ' (act as published, 2024-01-' || lpad(CAST(n_chars % 28 + 1 AS VARCHAR), 2, '0') || ')' END AS rendered FROM documents""")
def cite_render(t):
    date = F.concat(F.lit("2024-01-"), F.lpad((F.col("n_chars") % 28 + 1).cast("string"), 2, "0"))
    basis = F.when(F.col("lang") == "en", "consolidation").otherwise("publication")
    return t("documents").select("doc_id", T.render_citation(F.col("source"), F.concat(F.lit("Article "), F.col("doc_id").cast("string")), basis, date).alias("rendered"))


# ---- closed-set membership -------------------------------------------------------------------------------------------------

REPLY_SQL = """
replies AS (
  SELECT c_custkey AS reply_id, c_mktsegment AS segment, r_name, c_acctbal, CASE WHEN c_acctbal < 0 THEN ' General. ' ELSE 'the ' || upper(n_name) || ' (' || c_mktsegment || '); old ' || r_name || ' order.' END AS reply
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
aliases AS (SELECT DISTINCT instrument, alias FROM (SELECT r_name AS instrument, lower(n_name) AS alias FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE' UNION ALL SELECT r_name, lower(r_name) FROM region WHERE r_name <> 'EUROPE')),
parts AS (SELECT reply_id, x FROM (SELECT reply_id, unnest(list_transform(string_split(reply, ';'), lambda s: regexp_replace(trim(lower(regexp_replace(s, '\\s+', ' ', 'g')), ' .,:'), '^the\\s+', ''))) AS x FROM replies) WHERE x <> ''),
cands AS (
  SELECT reply_id, x AS c FROM parts UNION
  SELECT reply_id, regexp_replace(trim(lower(regexp_extract(x, '^(.+?)\\s*\\(([^()]*)\\)$', 1)), ' .,:'), '^the\\s+', '') FROM parts WHERE regexp_matches(x, '^(.+?)\\s*\\(([^()]*)\\)$') UNION
  SELECT reply_id, regexp_replace(trim(lower(regexp_extract(x, '^(.+?)\\s*\\(([^()]*)\\)$', 2)), ' .,:'), '^the\\s+', '') FROM parts WHERE regexp_matches(x, '^(.+?)\\s*\\(([^()]*)\\)$')),
exact AS (SELECT r.reply_id, coalesce((SELECT string_agg(DISTINCT instrument, ',' ORDER BY instrument) FROM cands c JOIN aliases a ON a.alias = c.c WHERE c.reply_id = r.reply_id), '') AS declared FROM replies r),
loose AS (SELECT r.reply_id, coalesce((SELECT string_agg(DISTINCT instrument, ',' ORDER BY instrument) FROM aliases a WHERE regexp_matches(lower(r.reply), '(^|[^a-z0-9])' || a.alias || '($|[^a-z0-9])')), '') AS declared FROM replies r),
verdicts AS (
  SELECT r.*, e.declared, CASE WHEN e.declared = '' AND rtrim(upper(trim(reply)), '.') <> 'GENERAL' THEN 'refuse' ELSE 'pass' END AS verdict, CASE WHEN e.declared = '' THEN 'refuse' ELSE 'pass' END AS strict,
         CASE WHEN l.declared = '' AND rtrim(upper(trim(reply)), '.') <> 'GENERAL' THEN 'refuse' ELSE 'pass' END AS loose
  FROM replies r JOIN exact e USING (reply_id) JOIN loose l USING (reply_id))"""


def replies(t) -> DataFrame:
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    reply = F.when(F.col("c_acctbal") < 0, " General. ").otherwise(F.concat(F.lit("the "), F.upper("n_name"), F.lit(" ("), "c_mktsegment", F.lit("); old "), "r_name", F.lit(" order.")))
    return c.select(F.col("c_custkey").alias("reply_id"), F.col("c_mktsegment").alias("segment"), "r_name", "c_acctbal", reply.alias("reply"))


def aliases(t) -> DataFrame:
    names = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'EUROPE'").select(F.col("r_name").alias("instrument"), F.col("n_name").alias("alias"))
    known = t("region").where("r_name <> 'EUROPE'").select(F.col("r_name").alias("instrument"))
    return regime.require_total(known, names)


def verdicts(t) -> DataFrame:
    r, a = replies(t), aliases(t)
    both = r.join(regime.declared(r, a), "reply_id").join(regime.declared_by_substring(r, a).withColumnRenamed("declared", "loosely"), "reply_id")
    v = lambda c, strict=False: regime.verdict(F.col(c), F.col("reply"), strict)
    return both.withColumns({"verdict": v("declared"), "strict": v("declared", True), "loose": v("loosely")})


def _truth(df: DataFrame) -> DataFrame:
    return df.withColumns({"truth": F.when(F.col("r_name") == "EUROPE", "out").otherwise("in"), "debatable": F.col("c_acctbal") > 9000, "mode": F.when(F.col("c_acctbal") > 5000, "answered").when(F.col("c_acctbal") > 2000, "refused-gate").otherwise("refused-generation")})


TRUTH_SQL = f"WITH {REPLY_SQL}, judged AS (SELECT *, CASE WHEN r_name = 'EUROPE' THEN 'out' ELSE 'in' END AS truth, c_acctbal > 9000 AS debatable, CASE WHEN c_acctbal > 5000 THEN 'answered' WHEN c_acctbal > 2000 THEN 'refused-gate' ELSE 'refused-generation' END AS mode FROM verdicts)"


@query("SELECT r_name AS instrument FROM region WHERE r_name = 'EUROPE'")
def alias_totality(t):
    names = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'EUROPE'").select(F.col("r_name").alias("instrument"), F.col("n_name").alias("alias"))
    return regime.missing_aliases(regime.closed_set(t("region"), "r_name"), names)


@query(f"WITH {REPLY_SQL} SELECT reply_id, declared FROM exact")
def regime_match(t):
    return regime.declared(replies(t), aliases(t)).withColumn("declared", joined("declared"))


@query(f"WITH {REPLY_SQL} SELECT reply_id, declared FROM loose")
def regime_match_substring(t):
    return regime.declared_by_substring(replies(t), aliases(t)).withColumn("declared", joined("declared"))


@query(f"WITH {REPLY_SQL} SELECT reply_id, verdict, strict FROM verdicts")
def preflight_verdict(t):
    return verdicts(t).select("reply_id", "verdict", "strict")


@query(f"WITH {REPLY_SQL} SELECT reply_id AS id, strict AS before, loose AS after FROM verdicts WHERE strict <> loose")
def verdict_flips(t):
    v = verdicts(t)
    return evaluate.verdict_flips(v.select(F.col("reply_id").alias("id"), F.col("strict").alias("verdict")), v.select(F.col("reply_id").alias("id"), F.col("loose").alias("verdict")))


def _sum(cond: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT)"


@query(f"""{TRUTH_SQL} SELECT segment, count(*) AS n, {_sum("truth = 'out' AND verdict = 'refuse'")} AS caught, {_sum("truth = 'out' AND verdict <> 'refuse'")} AS missed, {_sum("truth <> 'out' AND verdict = 'refuse'")} AS false_refusals, {_sum("(verdict = 'pass') = (truth = 'in')")} AS ok FROM judged GROUP BY segment""")
def confusion(t):
    return evaluate.confusion(_truth(verdicts(t)), ["segment"])


@query(f"""{TRUTH_SQL} SELECT segment AS band, count(*) AS n, {_sum("mode = 'answered'")} AS answered, {_sum("mode = 'refused-gate'")} AS refused_gate, {_sum("mode = 'refused-preflight'")} AS refused_preflight, {_sum("mode = 'refused-generation'")} AS refused_generation FROM judged GROUP BY segment""")
def mode_by_band(t):
    return evaluate.modes_by_band(_truth(verdicts(t)), "segment")


@query(f"""{TRUTH_SQL} SELECT count(*) AS n, {_sum("mode = 'answered' AND truth = 'out'")} AS wrongly_answered, {_sum("verdict = 'refuse' AND truth = 'out'")} AS caught, {_sum("verdict <> 'refuse' AND truth = 'out'")} AS missed,
{_sum("mode = 'answered' AND verdict = 'refuse' AND truth = 'out'")} AS fixed, {_sum("verdict = 'refuse' AND truth <> 'out'")} AS false_refusals FROM judged WHERE NOT debatable""")
def joint_scorecard(t):
    return evaluate.joint_scorecard(_truth(verdicts(t)))


@query(f"""{TRUTH_SQL} SELECT {_sum("truth = 'out' AND verdict = 'refuse'")} AS caught, {_sum("truth <> 'out' AND verdict = 'refuse'")} AS false_refusals, {_sum("truth = 'out' AND verdict = 'refuse'")} >= 12 AND {_sum("truth <> 'out' AND verdict = 'refuse'")} <= 1 AS met FROM judged WHERE NOT debatable""")
def decision_rule(t):
    return evaluate.decision(_truth(verdicts(t)))


@query(f"{TRUTH_SQL} SELECT reply_id FROM judged WHERE mode = 'answered' AND verdict = 'refuse'")
def still_answered(t):
    v = _truth(verdicts(t)).withColumn("id", F.col("reply_id"))
    return evaluate.still_answered(v.select("id", "reply_id", "mode"), v.select("id", "verdict")).select("reply_id")


@query(f"SELECT conv_id, turn, contains(lower(substr(CASE WHEN role = 'system' THEN '> {REFUSAL} ' || text ELSE text END, 1, {len(REFUSAL) + 40})), lower('{REFUSAL}')) AS refused FROM conversations")
def refusal_mode(t):
    said = F.when(F.col("role") == "system", F.concat(F.lit(f"> {REFUSAL} "), "text")).otherwise(F.col("text"))
    return t("conversations").select("conv_id", "turn", regime.is_refusal(said).alias("refused"))


# ---- evaluation ------------------------------------------------------------------------------------------------------------

HOLD_SQL = f"expected AS (SELECT b.item_id AS question_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains({NORM_SQL.format('d.text')}, {NEEDLE_SQL.format('b.text')}) WHERE {NEEDLE_SQL.format('b.text')} <> '')"


def expected(t) -> DataFrame:
    """(question_id, expected): the documents that hold an item word for word, for items that some document holds."""
    held = verify.indexed_containment(t("benchmark").select(F.col("item_id").alias("span_id"), F.col("text").alias("span")), documents(t).select("id", "text"))
    return held.groupBy(F.col("span_id").alias("question_id")).agg(F.sort_array(F.collect_set("id")).alias("expected"))


@query(f"WITH {LEX_SQL}, {HOLD_SQL} SELECT e.question_id, bool_or(l.id IS NOT NULL) AS hit FROM expected e LEFT JOIN (SELECT * FROM lex WHERE lex_rank < 5) l ON l.question_id = e.question_id AND l.id = e.id GROUP BY e.question_id")
def hit_at_k(t):
    return evaluate.hit_at_k(lexical_leg(t).where("lex_rank < 5"), expected(t))


CITATION_SQL = f"""WITH {LEX_SQL}, {HOLD_SQL}, tops AS (SELECT l.question_id, l.id, d.lang, d.source FROM lex l JOIN documents d ON d.doc_id = l.id WHERE lex_rank < 2),
graded AS (
  SELECT e.question_id, bool_or(t.id IS NOT NULL) AS id_ok, bool_or(t.id IS NOT NULL AND t.lang = 'en') AS basis_ok, bool_or(t.id IS NOT NULL AND contains(t.source, 'src1')) AS render_ok
  FROM expected e LEFT JOIN tops t ON t.question_id = e.question_id AND t.id = e.id GROUP BY e.question_id)"""


def _graded(t) -> DataFrame:
    top = written(lexical_leg(t).where("lex_rank < 2"), "tops").join(documents(t), "id")
    cited = top.select("question_id", F.lit("answered").alias("mode"), F.col("id").alias("base"), F.when(F.col("lang") == "en", "consolidation").otherwise("publication").alias("basis"), F.col("source").alias("rendered"))
    key = expected(t).withColumns({"expected_basis": F.lit("consolidation"), "expected_citation": F.lit("src1")})
    return evaluate.citation_correct(cited, key)


@query(f"{CITATION_SQL} SELECT question_id, id_ok, basis_ok, render_ok, id_ok AND basis_ok AND render_ok AS correct FROM graded")
def citation_correct(t):
    return _graded(t).select("question_id", "id_ok", "basis_ok", "render_ok", "correct")


@query(f"""{CITATION_SQL} SELECT {_sum("id_ok")} AS id_ok_ok, count(id_ok) AS id_ok_of, {_sum("basis_ok")} AS basis_ok_ok, count(basis_ok) AS basis_ok_of, coalesce(bool_and(id_ok AND basis_ok), true) AS passed FROM graded""")
def eval_summary(t):
    return evaluate.summary(_graded(t), ["id_ok", "basis_ok"])


@query(f"""{TRUTH_SQL} SELECT reply_id AS question_id, refusal_source, mode, coalesce(mode = CASE refusal_source WHEN 'gate' THEN 'refused-gate' WHEN 'preflight' THEN 'refused-preflight' ELSE 'refused-generation' END, false) AS correct FROM (
  SELECT *, CASE WHEN truth = 'out' THEN 'gate' WHEN verdict = 'refuse' THEN 'preflight' WHEN segment = 'BUILDING' THEN 'generation' END AS refusal_source FROM judged) WHERE refusal_source IS NOT NULL""")
def refusal_correct(t):
    v = _truth(verdicts(t)).withColumn("question_id", F.col("reply_id"))
    key = v.select("question_id", F.when(F.col("truth") == "out", "gate").when(F.col("verdict") == "refuse", "preflight").when(F.col("segment") == "BUILDING", "generation").alias("refusal_source"))
    return evaluate.refusal_correct(v.select("question_id", "mode"), key)


SCORES_SQL = f"scores AS (SELECT d.lang AS sample, l.quality = 1 AS positive, round(d.n_chars / (d.n_chars + 1000), 6) AS s1, round(len({TOKENS_SQL.format('d.text')}) / (len({TOKENS_SQL.format('d.text')}) + 100), 6) AS s2, CASE WHEN d.n_chars < 500 THEN 'near' WHEN d.n_chars < 2000 THEN 'mid' ELSE 'far' END AS band FROM documents d JOIN labels l USING (doc_id))"


def scores(t) -> DataFrame:
    n, k = F.col("n_chars"), F.size(T.tokens("text"))
    return t("documents").join(t("labels"), "doc_id").select(
        F.col("lang").alias("sample"), (F.col("quality") == 1).alias("positive"), F.round(n / (n + 1000), 6).alias("s1"), F.round(k / (k + 100), 6).alias("s2"), F.when(n < 500, "near").when(n < 2000, "mid").otherwise("far").alias("band")
    )


@query(f"""WITH {SCORES_SQL}, ends AS (SELECT max(CASE WHEN NOT positive THEN s1 END) AS max_out, min(CASE WHEN positive THEN s1 END) AS min_in FROM scores)
SELECT max_out, min_in, CASE WHEN max_out < min_in THEN round((max_out + min_in) / 2, 6) END AS floor, (SELECT count(*) FROM scores WHERE s1 <= max_out AND s1 >= min_in) AS overlapping FROM ends""")
def floor_gap(t):
    return evaluate.floor_gap(scores(t), "s1")


@query(f"WITH {SCORES_SQL} SELECT sample, s1, positive, band FROM scores WHERE s1 <= (SELECT max(s1) FROM scores WHERE NOT positive) AND s1 >= (SELECT min(s1) FROM scores WHERE positive)")
def floor_overlap(t):
    return evaluate.overlap(scores(t), "s1").select("sample", "s1", "positive", "band")


@query(f"""WITH {SCORES_SQL}, ts AS (SELECT DISTINCT sample, s1 AS t FROM scores UNION ALL SELECT DISTINCT sample, NULL FROM scores),
counts AS (SELECT ts.sample, ts.t, {_sum("positive AND (ts.t IS NULL OR s1 < ts.t)")} AS false_refusals, {_sum("NOT positive AND (ts.t IS NULL OR s1 < ts.t)")} AS caught, min(CASE WHEN positive AND s1 >= ts.t THEN s1 END) AS next FROM ts JOIN scores ON scores.sample = ts.sample GROUP BY ts.sample, ts.t),
best AS (SELECT *, row_number() OVER (PARTITION BY sample, budget ORDER BY caught DESC, t ASC NULLS LAST) AS r FROM counts, (SELECT unnest([0, 1, 2])::BIGINT AS budget) WHERE false_refusals <= budget)
SELECT sample, budget, t AS threshold, caught, false_refusals, round(next - t, 6) AS margin FROM best WHERE r = 1""")
def threshold_sweep(t):
    return evaluate.threshold_sweep(scores(t), ["sample"], "s1")


@query(f"""WITH {SCORES_SQL}, g AS (SELECT unnest(range(0, 21)) / 20 AS t), counts AS (SELECT sample, a.t AS t1, b.t AS t2, {_sum("positive AND (s1 < a.t OR s2 < b.t)")} AS false_refusals, {_sum("NOT positive AND (s1 < a.t OR s2 < b.t)")} AS caught FROM scores CROSS JOIN g a CROSS JOIN g b GROUP BY sample, a.t, b.t),
best AS (SELECT *, row_number() OVER (PARTITION BY sample, budget ORDER BY caught DESC, t1, t2) AS r FROM counts, (SELECT unnest([0, 1, 2])::BIGINT AS budget) WHERE false_refusals <= budget)
SELECT sample, budget, round(t1, 6) AS t1, round(t2, 6) AS t2, caught, false_refusals FROM best WHERE r = 1""")
def or_sweep(t):
    grid = [i / 20 for i in range(21)]
    return evaluate.or_sweep(scores(t), ["sample"], "s1", "s2", grid, grid).withColumns({"t1": F.round("t1", 6), "t2": F.round("t2", 6)})


@query(f"WITH {SCORES_SQL} SELECT band, count(*) AS n, {_sum('s1 < 0.4')} AS first, {_sum('s2 < 0.5')} AS second, {_sum('s1 < 0.4 OR s2 < 0.5')} AS either FROM scores GROUP BY band")
def band_breakdown(t):
    return evaluate.band_breakdown(scores(t), "band", F.col("s1") < 0.4, F.col("s2") < 0.5)


@query(f"WITH {SCORES_SQL} SELECT sample, s1, s2 FROM scores WHERE NOT positive AND s1 >= 0.4 AND s2 >= 0.5")
def uncatchable(t):
    return evaluate.uncatchable(scores(t), "s1", 0.4, "s2", 0.5).select("sample", "s1", "s2")


# ---- chunking --------------------------------------------------------------------------------------------------------------

#: Documents' lines as markdown: a title (but for those in other languages than English), articles, sections and numbered paragraphs.
MARK_SQL = r"""
md_lines AS (
  SELECT doc_id, i, CASE WHEN i = 1 AND lang = 'en' THEN '# ' || l WHEN i % 11 = 2 THEN '## Annex ' || ['I', 'II', 'III', 'IV', 'V'][1 + i % 5] || ' {#anx_' || i || '}' WHEN i % 11 = 4 THEN '### Section ' || i WHEN i % 11 = 7 THEN '## Article ' || i || ' {#art_' || i || '}'
    WHEN i % 11 IN (5, 6, 9, 10) THEN i || '. ' || l ELSE l END AS par
  FROM (SELECT doc_id, lang, unnest(s) AS l, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS s FROM documents))),
pars AS (SELECT doc_id, i - 1 AS pos, par, coalesce(sum(length(par) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM md_lines),
heads AS (SELECT *, CASE WHEN regexp_matches(par, '^#{1,4}\s') THEN length(regexp_extract(par, '^(#{1,4})', 1)) END AS level, CASE WHEN regexp_matches(par, '^#{1,4}\s') THEN trim(regexp_extract(par, '^#{1,4}\s+(.*?)(?:\s*\{#([^}]*)\})?\s*$', 1)) END AS title FROM pars WHERE trim(par) <> ''),
filled AS (
  SELECT *, count(level) OVER w AS unit, last_value(level IGNORE NULLS) OVER w AS own_level, last_value(title IGNORE NULLS) OVER w AS own_title,
    last_value(CASE WHEN level <= 2 THEN level END IGNORE NULLS) OVER w AS l2, last_value(CASE WHEN level <= 2 THEN title END IGNORE NULLS) OVER w AS t2
  FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
blocks AS (SELECT *, CASE WHEN regexp_matches(par, '^\d+[a-z]*\.\s+') THEN regexp_extract(par, '^(\d+[a-z]*)\.', 1) WHEN regexp_matches(par, '^\(\w+\)\s+') THEN regexp_extract(par, '^\((\w+)\)', 1) END AS marker FROM filled WHERE level IS NULL AND unit > 0),
runs AS (
  SELECT *, count(marker) OVER (PARTITION BY doc_id, unit ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, CAST(sum(length(par)) OVER (PARTITION BY doc_id, unit) AS BIGINT) AS total, count(marker) OVER (PARTITION BY doc_id, unit) AS markers FROM blocks)"""


def marked_documents(t) -> DataFrame:
    """(doc_id, text): each document as markdown with headings and numbered paragraphs between its lines."""
    lines = t("documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("p", "l")).withColumn("i", F.col("p") + 1)
    r, n = F.col("i") % 11, F.col("i").cast("string")
    roman = F.element_at(F.array(*[F.lit(x) for x in ("I", "II", "III", "IV", "V")]), 1 + F.col("i") % 5)
    par = (
        F.when((F.col("i") == 1) & (F.col("lang") == "en"), F.concat(F.lit("# "), "l")).when(r == 2, F.concat(F.lit("## Annex "), roman, F.lit(" {#anx_"), n, F.lit("}"))).when(r == 4, F.concat(F.lit("### Section "), n)).when(r == 7, F.concat(F.lit("## Article "), n, F.lit(" {#art_"), n, F.lit("}")))
        .when(r.isin(5, 6, 9, 10), F.concat(n, F.lit(". "), "l")).otherwise(F.col("l"))
    )
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", par.alias("par")))), lambda x: x["par"]), "\n\n").alias("text"))


@query("""SELECT doc_id, pos, offset_ AS "offset", md5(par) AS par_md5 FROM (
  SELECT doc_id, i - 1 AS pos, par, coalesce(sum(length(par) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM (
    SELECT doc_id, unnest(s) AS par, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))) WHERE trim(par) <> ''""")
def paragraphs(t):
    return K.paragraphs(t("documents"), separator=r"\n").select("doc_id", "pos", "offset", F.md5("par").alias("par_md5"))


@query(f"WITH {MARK_SQL} SELECT doc_id, pos, level, title, CASE WHEN l2 = 2 AND own_level > 2 THEN t2 ELSE '' END AS path FROM filled WHERE level IS NOT NULL")
def heading_paths(t):
    return K.units(K.paragraphs(marked_documents(t))).where("level is not null").select("doc_id", "pos", "level", "title", F.array_join("path", " › ").alias("path"))


@query(f"WITH {MARK_SQL} SELECT doc_id, unit, run, min(marker) AS marker, count(*) AS blocks, md5(string_agg(par, chr(10) || chr(10) ORDER BY pos)) AS body_md5 FROM runs GROUP BY doc_id, unit, run")
def marker_runs(t):
    df = K.runs(K.units(K.paragraphs(marked_documents(t))).where("level is null and unit > 0"), ["doc_id", "unit"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "par"))), lambda x: x["par"]), "\n\n")
    return df.groupBy("doc_id", "unit", "run").agg(F.min("marker").alias("marker"), F.count(F.lit(1)).alias("blocks"), F.md5(body).alias("body_md5"))


@query(f"WITH {MARK_SQL} SELECT doc_id, unit, max(total) AS total, max(markers) AS markers, NOT (max(total) <= 2000 OR max(markers) < 2) AS split FROM runs GROUP BY doc_id, unit")
def chunk_split(t):
    df = K.runs(K.units(K.paragraphs(marked_documents(t))).where("level is null and unit > 0"), ["doc_id", "unit"])
    return df.groupBy("doc_id", "unit").agg(F.max("total").alias("total"), F.max("markers").alias("markers")).withColumn("split", K.split_decision(F.col("total"), F.col("markers")))


CHUNK_SQL = MARK_SQL + r""",
leads AS (SELECT *, sum(CASE WHEN run = 0 THEN length(par) + 2 END) OVER (PARTITION BY doc_id, unit) - 2 AS lead_ FROM runs),
keyed AS (SELECT *, CASE WHEN total <= 2000 OR markers < 2 THEN -1 WHEN run = 0 AND coalesce(lead_ <= 400, true) THEN 1 ELSE run END AS key FROM leads),
pieces AS (
  SELECT doc_id, unit, key, max(own_title) AS title, max(CASE WHEN l2 = 2 AND own_level > 2 THEN t2 END) AS parent, min(offset_) AS offset_, string_agg(par, chr(10) || chr(10) ORDER BY pos) AS body, CASE WHEN key > 0 THEN arg_min(marker, CASE WHEN marker IS NOT NULL THEN pos END) END AS marker FROM keyed GROUP BY doc_id, unit, key),
labelled AS (
  SELECT *, CASE WHEN regexp_matches(title, '(?i)^article\b') THEN 'article' WHEN regexp_matches(title, '(?i)^annex\b') THEN 'annex' WHEN regexp_matches(parent, '(?i)^annex\b') THEN 'annex-section' WHEN regexp_matches(title, '(?i)^section\b') THEN 'section' ELSE 'other' END AS kind,
    CASE WHEN regexp_matches(title, '(?i)^annex\s+[ivxlc]+\b') THEN regexp_extract(title, '(?i)^annex\s+([ivxlc]+)\b', 1) WHEN regexp_matches(title, '(?i)^article\s+\d+[a-z]*\b') THEN regexp_extract(title, '(?i)^article\s+(\d+[a-z]*)\b', 1) WHEN regexp_matches(title, '(?i)^section\s+\w+\b') THEN regexp_extract(title, '(?i)^section\s+(\w+)\b', 1) END AS number FROM pieces)"""


def all_chunks(t) -> DataFrame:
    return K.chunks(marked_documents(t))


@query(f"""WITH {CHUNK_SQL} SELECT doc_id, offset_ AS "offset", kind, number AS unit_number, marker, coalesce(nullif(coalesce(CASE kind WHEN 'article' THEN 'Article ' || number WHEN 'annex' THEN 'Annex ' || number ELSE number END, '') || coalesce('(' || marker || ')', ''), ''), '—') AS citation,
  CASE WHEN parent IS NULL THEN title ELSE parent || ' › ' || title END AS parent_path, length(body) AS chars, md5(body) AS body_md5 FROM labelled""")
def citation_labels(t):
    return all_chunks(t).select("doc_id", "offset", "kind", "unit_number", "marker", "citation", "parent_path", "chars", F.md5("body").alias("body_md5"))


@query(f"""WITH {CHUNK_SQL}, src AS (SELECT doc_id, string_agg(par, chr(10) || chr(10) ORDER BY i) AS s FROM md_lines GROUP BY doc_id) SELECT doc_id, offset_ AS "offset", length(body) AS chars, substr(s, offset_ + 1, length(body)) = body AS verbatim, 'ok' AS status FROM labelled JOIN src USING (doc_id)""")
def chunk_coverage(t):
    """Every chunk is verbatim and in order."""
    return K.coverage(all_chunks(t), marked_documents(t)).select("doc_id", "offset", "chars", "verbatim", "status")


@query(f"""WITH {CHUNK_SQL} SELECT doc_id, pos, offset_ AS "offset" FROM filled WHERE level IS NULL AND unit = 0""")
def unclaimed(t):
    return K.unclaimed(K.paragraphs(marked_documents(t)), all_chunks(t)).select("doc_id", "pos", "offset")


@query(f"""WITH {CHUNK_SQL}, ranked AS (SELECT kind, length(body) AS chars, row_number() OVER (PARTITION BY kind ORDER BY length(body)) AS r, count(*) OVER (PARTITION BY kind) AS n FROM labelled)
SELECT kind, count(*) AS n, min(chars) AS smallest, max(CASE WHEN r = n // 2 + 1 THEN chars END) AS median, max(CASE WHEN r = n * 9 // 10 + 1 THEN chars END) AS p90, max(chars) AS largest, {_sum("chars > 4000")} AS over FROM ranked GROUP BY kind""")
def chunk_stats(t):
    return K.size_report(all_chunks(t))


@query("SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, n_chars, length(coalesce(text, '')) AS chars FROM documents")
def load_chunks(t):
    return C.load_chunks(t("documents").withColumn("id", F.col("doc_id")), ["id", "doc_id", "lang", "source", "n_chars", "text"]).select("doc_id", "lang", "source", "n_chars", F.length("text").alias("chars"))


# ---- sequences -------------------------------------------------------------------------------------------------------------

LINE_SQL = "l AS (SELECT l_orderkey, l_shipdate, l_partkey, l_suppkey, l_linenumber AS v, max(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS seen FROM lineitem)"
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"]


@query(f"WITH {LINE_SQL} SELECT l_orderkey, CAST(v AS VARCHAR) AS label, fault, count(*) AS n FROM (SELECT *, CASE WHEN seen > 1 THEN 'repeat' WHEN v < top THEN 'out-of-order' WHEN v > top + 1 THEN 'gap' END AS fault FROM l) WHERE fault IS NOT NULL GROUP BY ALL")
def sequence_gaps(t):
    """Lines of an order by shipping date, against their numbers."""
    return validate.sequence_faults(t("lineitem"), "l_orderkey", LINE_ORDER, "l_linenumber").groupBy("l_orderkey", "label", "fault").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINE_SQL} SELECT l_orderkey, count(*) AS n, {_sum("seen > 1")} AS repeats, {_sum("v < top AND seen = 1")} AS reversals, {_sum("v > top + 1")} AS gaps, bool_or(top IS NULL AND v <> 1) AS first_not_one FROM l GROUP BY l_orderkey""")
def numbering_faults(t):
    return validate.numbering_faults(t("lineitem"), "l_orderkey", LINE_ORDER, "l_linenumber")


@query("""WITH once AS (SELECT conv_id, turn, text, length(text) * 1000 + turn AS place, count(*) OVER (PARTITION BY conv_id, text) AS n FROM conversations)
SELECT conv_id, pos, place, before FROM (SELECT conv_id, turn AS pos, place, lag(place) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM once WHERE n = 1) WHERE place < before""")
def order_splices(t):
    """A conversation's turns against the same turns sorted by length."""
    c = t("conversations")
    return validate.order_splices(c.withColumn("p", F.col("turn")), c.withColumn("p", F.length("text") * 1000 + F.col("turn")), "conv_id", "p", "text")


#: A conversation's turns against an edited copy: every fifth is lost, others move, the second comes again at the end.
EDITED_SQL = "CASE WHEN turn % 4 = 2 THEN turn - 3 ELSE turn * 2 END"


def _order_sql(a: str, b: str, name: str) -> str:
    """One direction's tables, with chains of runs listed one by one; ``a`` and ``b`` are the sides."""
    return f"""
met_{a} AS (SELECT x.key, x.g, x.p AS i, y.p AS j FROM grams_{a} x LEFT JOIN grams_{b} y USING (key, g, r)),
runs_{a} AS (SELECT key, min(i) AS i, min(j) AS j, count(*) AS size, row_number() OVER (PARTITION BY key ORDER BY min(i)) AS rid FROM (
  SELECT key, i, j, i - row_number() OVER (PARTITION BY key, j - i ORDER BY i) AS island FROM met_{a} WHERE j IS NOT NULL) GROUP BY key, j - i, island),
chains_{a} AS (SELECT key, rid, j, size AS total, [rid] AS ids FROM runs_{a} UNION ALL SELECT c.key, r.rid, r.j, c.total + r.size, list_append(c.ids, r.rid) FROM chains_{a} c JOIN runs_{a} r ON r.key = c.key AND r.rid > c.rid AND r.j > c.j),
best_{a} AS (SELECT key, ids FROM (SELECT key, ids, row_number() OVER (PARTITION BY key ORDER BY total DESC, ids) AS z FROM chains_{a}) WHERE z = 1),
covers_{a} AS (
  SELECT r.key, CASE WHEN list_contains(b.ids, r.rid) THEN 0 ELSE 1 END AS class, r.i AS s, r.i + r.size + 3 AS e, r.j - r.i AS shift FROM runs_{a} r JOIN best_{a} b USING (key)
  UNION ALL SELECT key, 2, i, i + 4, NULL FROM met_{a} WHERE j IS NULL AND EXISTS (SELECT 1 FROM grams_{b} y WHERE y.key = met_{a}.key AND y.g = met_{a}.g)),
told_{a} AS (SELECT * FROM (SELECT w.key, w.p, coalesce(c.class, 3) AS class, CASE WHEN c.class = 1 THEN c.shift END AS shift, row_number() OVER (PARTITION BY w.key, w.p ORDER BY coalesce(c.class, 3), c.s) AS z
  FROM words_{a} w LEFT JOIN covers_{a} c ON c.key = w.key AND w.p >= c.s AND w.p < c.e) WHERE z = 1 AND class > 0),
found_{a} AS (SELECT key, class, min(p) AS start, count(*) AS words, min(p + shift) AS to_ FROM (SELECT *, p - row_number() OVER (PARTITION BY key, class, shift ORDER BY p) AS island FROM told_{a}) GROUP BY key, class, shift, island),
edges_{a} AS (SELECT key, min(p) AS s, max(p) + 1 AS e FROM words_{a} GROUP BY key, pos),
out_{a} AS (SELECT key AS conv_id, '{name}' AS direction, CASE class WHEN 1 THEN 'SPLICE' WHEN 2 THEN 'REPEAT' ELSE CASE WHEN EXISTS (SELECT 1 FROM edges_{a} x WHERE x.key = f.key AND x.s = f.start) AND EXISTS (SELECT 1 FROM edges_{a} x WHERE x.key = f.key AND x.e = f.start + f.words) THEN 'ABSENT' ELSE 'DROPOUT' END END AS class, start, words, to_ AS "to" FROM found_{a} f)"""


def _words_sql(side: str, rows: str) -> str:
    return f"""
words_{side} AS (SELECT key, pos, word, row_number() OVER (PARTITION BY key ORDER BY pos, k) - 1 AS p FROM (SELECT key, pos, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM ({rows}))),
grams_{side} AS (SELECT key, g, p, row_number() OVER (PARTITION BY key, g ORDER BY p) AS r FROM (
  SELECT key, p, concat_ws(' ', word, lead(word, 1) OVER v, lead(word, 2) OVER v, lead(word, 3) OVER v) AS g, count(*) OVER (PARTITION BY key) AS n FROM words_{side} WINDOW v AS (PARTITION BY key ORDER BY p)) WHERE p + 4 <= n OR p = 0)"""


@query(f"""WITH RECURSIVE {_words_sql("a", f"SELECT conv_id AS key, turn AS pos, {TOKENS_SQL.format('text')} AS w FROM conversations")},
{_words_sql("b", f"SELECT conv_id AS key, {EDITED_SQL} AS pos, {TOKENS_SQL.format('text')} AS w FROM conversations WHERE turn % 5 <> 3 UNION ALL SELECT conv_id, 1000, {TOKENS_SQL.format('text')} FROM conversations WHERE turn = 1")},
{_order_sql("a", "b", "source -> corpus")}, {_order_sql("b", "a", "corpus -> source")}
SELECT * FROM out_a UNION ALL SELECT * FROM out_b""")
def order_runs(t):
    """Conversations against their edited copies, both ways."""
    c = t("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    moved = c.where("turn % 5 <> 3").withColumn("turn", F.expr(EDITED_SQL))
    return order.order_runs(c, moved.unionByName(c.where("turn = 1").withColumn("turn", F.lit(1000).cast("long"))), "conv_id", "turn", "text")


@query("""SELECT source, CAST(coalesce(sum(CASE WHEN lang = 'en' THEN n_chars END), 0) AS BIGINT) AS emitted, CAST(coalesce(sum(CASE WHEN lang <> 'en' THEN n_chars END), 0) AS BIGINT) AS dropped,
CAST(coalesce(sum(CASE WHEN lang = 'en' THEN n_chars END), 0) - coalesce(sum(CASE WHEN lang <> 'en' THEN n_chars END), 0) AS BIGINT) AS difference FROM documents GROUP BY source""")
def char_reconciliation(t):
    return validate.reconcile(t("documents"), "source", F.when(F.col("lang") == "en", "emitted").otherwise("drop:not-this-part"), "n_chars")


# ---- pages -----------------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, array_to_string(list_filter([CASE WHEN length(html) < 2000 THEN 'shorter than 2000' END, CASE WHEN NOT contains(html, '</body>') THEN 'marker missing' END, CASE WHEN NOT contains(html, CAST(page_id AS VARCHAR)) THEN 'own number missing' END], lambda x: x IS NOT NULL), '; ') AS problems FROM pages""")
def page_shape(t):
    return t("pages").select("page_id", F.array_join(P.shape_problems(F.col("html"), F.col("page_id").cast("string"), "</body>", 2000), "; ").alias("problems"))


@query(r"""SELECT page_id, sha256(html) AS sha256, sha256(regexp_replace(html, '\s(?:data-nonce|nonce|data-timestamp)="[^"]*"', '', 'g')) AS sha256_normalized FROM pages""")
def page_hashes(t):
    return t("pages").select("page_id", *[c.alias(k) for k, c in P.hashes(F.col("html")).items()])


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def page_text(t):
    return t("pages").select("page_id", P.title(F.col("html")).alias("title"), F.md5(P.plain_text(F.col("html"))).alias("text_md5"))


@query("""SELECT page_id, count(*) AS n_links, md5(string_agg(x, '|' ORDER BY i)) AS links_md5 FROM (
  SELECT page_id, x, min(i) AS i FROM (SELECT page_id, replace(replace(unnest(m), '%28', '('), '%29', ')') AS x, generate_subscripts(m, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS m FROM pages)) GROUP BY page_id, x) GROUP BY page_id""")
def page_links(t):
    links = P.links(F.col("html"))
    return t("pages").select("page_id", links.alias("l")).where(F.size("l") > 0).select("page_id", F.size("l").alias("n_links"), F.md5(F.array_join("l", "|")).alias("links_md5"))


@query(r"""SELECT host, max(version) AS latest, count(DISTINCT version) AS versions FROM (SELECT regexp_extract(url, '://([^/]*)', 1) AS host, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS version FROM pages) GROUP BY host""")
def latest_version(t):
    url = F.col("url")
    return P.latest_version(t("pages").select(F.regexp_extract(url, "://([^/]*)", 1).alias("host"), F.regexp_extract(url, r"://[^/]*(/[^?#]*)", 1).alias("version")), "host", "version")


@query()
def page_blocks(t):
    """Block rows of every page; a parser's work, so tests compare it."""
    return convert.convert(t("pages"))


#: What stands between tags in the page's sections, and what becomes of it; scripts and styles are text as a whole.
DISPOSITION_SQL = r"""
WITH sections AS (
  SELECT page_id, 'drop:metadata' AS state, [regexp_extract(html, '(?s)<title>(.*?)</title>', 1), regexp_extract(html, '(?s)<style>(.*?)</style>', 1), regexp_extract(html, '(?s)<script>(.*?)</script>', 1)] AS s FROM pages
  UNION ALL SELECT page_id, 'drop:navigation', regexp_split_to_array(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<[^>]*>') FROM pages
  UNION ALL SELECT page_id, 'drop:advert', regexp_split_to_array(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), '<[^>]*>') FROM pages
  UNION ALL SELECT page_id, 'emitted', regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>') FROM pages
  UNION ALL SELECT page_id, 'drop:footer', regexp_split_to_array(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1), '<[^>]*>') FROM pages),
nodes AS (SELECT page_id, state, regexp_replace(replace(replace(replace(replace(unnest(s), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS x FROM sections)
SELECT page_id AS doc_id, state, count(*) AS nodes, CAST(sum(length(x)) AS BIGINT) AS chars FROM nodes WHERE x <> '' GROUP BY page_id, state"""


@query(DISPOSITION_SQL)
def page_disposition(t):
    """What became of every text node; an unaccounted one fails the job."""
    return convert.disposition_report(convert.require_accounted(convert.dispositions(t("pages"))))


@query(r"""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)([^>]*)>.*?</(?:script|style)>', '<\1>', 'g') AS h FROM pages),
tags AS (SELECT page_id, unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)) AS tag FROM bare),
inside AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(h, '(?s)<article>(.*?)</article>', 1), '<([a-z][a-z0-9]*)', 1)) AS tag FROM bare)
SELECT page_id, tag, count(*) AS n, coalesce(any_value(k), 0) AS in_article FROM tags LEFT JOIN (SELECT page_id, tag, count(*) AS k FROM inside GROUP BY page_id, tag) USING (page_id, tag) GROUP BY page_id, tag""")
def page_tree(t):
    """Elements by page and tag, and how many of them lie in an article's interval."""
    nodes = tree.page_tree(t("pages")).where("text is null")
    held = tree.under(nodes, nodes.where("tag = 'article'")).select("doc_id", "pre", F.lit(1).alias("k")).distinct()
    return nodes.join(held, ["doc_id", "pre"], "left").groupBy(F.col("doc_id").alias("page_id"), "tag").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("in_article"))


#: Documents' lines as an act: recitals, articles, annexes, chapters with their titles, formulas, notes, markers of amendments, and lines that nothing claims.
ACT_SQL = r"""
lines AS (SELECT doc_id, i, CAST(i AS VARCHAR) AS n, ['I', 'II', 'III', 'IV', 'V'][1 + i % 5] AS roman, trim(regexp_replace(l, '\s+', ' ', 'g')) AS t FROM (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
walked AS (
  SELECT doc_id, i, CASE i % 9 WHEN 1 THEN 'drop:not-this-part' WHEN 2 THEN 'article' WHEN 3 THEN 'annex' WHEN 4 THEN 'division' WHEN 6 THEN 'formula' WHEN 7 THEN 'footnote' WHEN 8 THEN 'drop:amendment-marker' ELSE 'unaccounted' END AS role,
    CASE i % 9 WHEN 1 THEN n WHEN 2 THEN n WHEN 3 THEN roman WHEN 6 THEN n END AS number,
    CASE i % 9 WHEN 2 THEN 'Article ' || n || ' — Title ' || n WHEN 3 THEN 'ANNEX ' || roman WHEN 4 THEN 'CHAPTER ' || n || coalesce(' — ' || lead(t) OVER (PARTITION BY doc_id ORDER BY i), '') END AS heading,
    CASE i % 9 WHEN 1 THEN 'rct_' || n WHEN 2 THEN 'art_' || n WHEN 3 THEN 'anx_' || roman WHEN 6 THEN 'fnp_' || n END AS anchor,
    CASE i % 9 WHEN 2 THEN 'Article ' || n || 'Title ' || n || t WHEN 3 THEN 'ANNEX ' || roman || t WHEN 4 THEN 'CHAPTER ' || n ELSE t END AS t FROM lines)"""


def acts(t) -> DataFrame:
    """(doc_id, html): each document as an act."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "l")).withColumn("i", F.col("p") + 1)
    x = F.replace(F.replace(F.replace("l", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    n, r, roman = F.col("i").cast("string"), F.col("i") % 9, F.element_at(F.array(*[F.lit(v) for v in ("I", "II", "III", "IV", "V")]), 1 + F.col("i") % 5)
    said = lambda *parts: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in parts])
    line = (
        F.when(r == 1, said('<div id="rct_', n, '"><p>', x, "</p></div>")).when(r == 2, said('<div id="art_', n, '"><p class="oj-ti-art">Article ', n, '</p><p class="oj-sti-art">Title ', n, "</p><p>", x, "</p></div>"))
        .when(r == 3, said('<div id="anx_', roman, '"><p class="oj-doc-ti">ANNEX ', roman, "</p><p>", x, "</p></div>")).when(r == 4, said('<p class="oj-ti-section-1">CHAPTER ', n, "</p>")).when(r == 5, said('<p class="oj-ti-section-2">', x, "</p>"))
        .when(r == 6, said('<div id="fnp_', n, '"><p>', x, "</p></div>")).when(r == 7, said('<p class="oj-note">', x, "</p>")).when(r == 8, said('<p class="modref">', x, "</p>")).otherwise(said("<p>", x, "</p>"))
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("x")))), lambda v: v["x"]), "")
    return lines.groupBy("doc_id").agg(F.concat(F.lit('<div class="eli-container">'), body, F.lit("</div>")).alias("html"))


@query(f"""WITH {ACT_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no, role, number, heading, anchor, md5(t) AS text_md5 FROM walked WHERE i % 9 <> 5 AND (i % 9 <> 0 OR t <> '')""")
def structural_walk(t):
    rows = tree.structural_walk(tree.page_tree(acts(t), "doc_id"))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return rows.select("doc_id", no.alias("no"), "role", "number", "heading", "anchor", F.md5("text").alias("text_md5"))


@query("""WITH recorded AS (SELECT 'd' || doc_id AS path, sha256(text) AS h FROM documents), now AS (SELECT 'd' || doc_id AS path, sha256(CASE WHEN source = 'src2' THEN upper(text) ELSE text END) AS h FROM documents WHERE source <> 'src1' UNION ALL SELECT 'p' || page_id, sha256(html) FROM pages)
SELECT coalesce(r.path, n.path) AS path, CASE WHEN r.h IS NULL THEN 'UNINDEXED' WHEN n.h IS NULL THEN 'MISSING' WHEN r.h = n.h THEN 'same' ELSE 'DIFFERS' END AS status FROM recorded r FULL OUTER JOIN now n ON r.path = n.path""")
def index_currency(t):
    """Recorded hashes of the documents against a state in which one source is gone, one altered and the pages new."""
    d = t("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text", "source")
    new = d.where("source <> 'src1'").select("path", F.sha2(F.when(F.col("source") == "src2", F.upper("text")).otherwise(F.col("text")), 256).alias("sha256"))
    new = new.unionAll(t("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")), F.sha2("html", 256)))
    return C.currency(d.select("path", F.sha2("text", 256).alias("sha256")), new)


@query("""WITH recorded AS (SELECT 'd' || doc_id AS path, sha256(text) AS h FROM documents WHERE source <> 'src3'), known AS (SELECT 'd' || doc_id AS path FROM documents WHERE source <> 'src4'),
now AS (SELECT 'd' || doc_id AS path, sha256(CASE WHEN source = 'src2' THEN upper(text) ELSE text END) AS h FROM documents WHERE source <> 'src1'),
j AS (SELECT coalesce(r.path, n.path, k.path) AS path, r.h AS old, n.h AS new, k.path IS NOT NULL AS known FROM recorded r FULL OUTER JOIN now n ON r.path = n.path FULL OUTER JOIN known k ON k.path = coalesce(r.path, n.path))
SELECT path, CASE WHEN NOT known THEN 'ORPHAN' WHEN new IS NULL THEN 'MISSING' WHEN old IS NULL THEN 'UNINDEXED' WHEN old = new THEN 'same' ELSE 'DIFFERS' END AS status FROM j WHERE known OR old IS NOT NULL""")
def index_statuses(t):
    """An index that never saw one source, against a list that no longer has another, with a third gone and a fourth altered."""
    d = t("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text", "source")
    old = d.where("source <> 'src3'").select("path", F.sha2("text", 256).alias("sha256"))
    new = d.where("source <> 'src1'").select("path", F.sha2(F.when(F.col("source") == "src2", F.upper("text")).otherwise(F.col("text")), 256).alias("sha256"))
    return C.currency(old, new, d.where("source <> 'src4'"))


# ---- the whole session -----------------------------------------------------------------------------------------------------


def session(t) -> RagSession:
    docs = documents(t)
    corpus = docs.join(vectors(t), "id").select(F.concat(F.lit("doc-s#"), F.col("id").cast("string")).alias("id"), F.col("source").alias("instrument"), F.concat(F.lit("Document "), F.col("id").cast("string")).alias("citation"), F.col("text").alias("body"), "text", "embedding")
    named = docs.select(F.col("source").alias("instrument"), F.col("source").alias("alias")).distinct()
    return RagSession(docs.sparkSession, corpus, named, preflight=lambda q: F.when(F.length(q) < 150, "src1; something else").when(F.length(q) < 200, "nothing known").otherwise("GENERAL"), floor=0.35)


@query()
def answer_modes(t):
    """Every benchmark item answered and checked, with the offline models."""
    q = asked_vectors(t)
    # a question's own vector would always be found: ask with that of the next number
    v = t("embeddings").select((F.col("vec_id") - 1).alias("question_id"), F.col("embedding").alias("vector"))
    return session(t).answer(q.drop("vector").join(v, "question_id")).select("question_id", "mode", F.round("best_dense", 6).alias("best_dense"), joined("declared").alias("declared"), "n_quotes", "n_missed", "n_unknown", "n_wrong", "verified")
