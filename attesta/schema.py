"""Explicit schemas of the records that travel between stages."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _l, _d, _b = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: A chunk as it is indexed; ``offset`` stays behind.
CHUNK = _struct(
    id=_s, instrument=_s, part=_s, kind=_s, unit_number=_s, marker=_s, anchor=_s, citation=_s, parent_path=_s,
    celex=_s, source_url=_s, version_date=_s, date_basis=_s, language=_s, chars=_i, body=_s, text=_s,
)
FIELDS = CHUNK.names
SOURCE = _struct(rank=_i, id=_s, dense=_d, rerank=_d)
QUOTE = _struct(span=_s, source_id=_s)
MISATTRIBUTION = _struct(span=_s, cited=_s, actual=_s)
ANSWER = _struct(
    question_id=_l, question=_s, mode=_s, text=_s, sources=T.ArrayType(SOURCE), best_dense=_d, floor=_d, preflight=_s, declared=T.ArrayType(_s), quotes=T.ArrayType(QUOTE),
    unknown_ids=T.ArrayType(_s), refined_ids=T.ArrayType(_s), misattributed=T.ArrayType(MISATTRIBUTION), verified=_b,
)
EVAL = _struct(id=_s, kind=_s, question=_s, expected_behavior=_s, expected_chunk_ids=T.ArrayType(_s), expected_citation=_s, expected_date_basis=_s, gate_expectation=_s, refusal_source=_s, notes=_s)
INDEX_MANIFEST = _struct(written_by=_s, embed_model=_s, dim=_i, rows=_l, chunk_files=T.MapType(_s, _s))
FETCH_MANIFEST = _struct(
    source=_s, celex=_s, language=_s, requested_url=_s, final_url=_s, http_status=_i, content_type=_s, fetched_at_utc=_s, sha256=_s, sha256_normalized=_s, bytes=_l, stated_consolidation=_s, shape_problems=T.ArrayType(_s),
    discovery=_struct(landing_url=_s, discovery_route=_s, current_consolidated=_s, consolidated_versions=T.ArrayType(_s), status_line_agrees=_b),
)
MODES = ("answered", "refused-gate", "refused-preflight", "refused-generation")
KINDS = ("recital", "annex", "article", "annex-section", "section", "division", "other")
