from pyspark.sql import functions as F

from attesta.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_fold_and_normalize(spark):
    assert one(spark, "‘a’ “b” c–d—e…", T.fold_punct) == "'a' \"b\" c-d-e..."
    assert one(spark, "  The “ﬁrst”\n１２ [doc-a#x(1)] End ", T.normalize) == 'the "first" 12 end'
    assert one(spark, None, T.normalize) is None
    assert one(spark, "Done.,;:", T.needle) == "done"


def test_spans(spark):
    assert one(spark, 'a "one real quotation here" b "another real quotation" c', T.outer_span) == 'one real quotation here" b "another real quotation'
    assert one(spark, 'a "one real quotation here" b "short" "another real quotation"', T.quote_pairs) == ["one real quotation here", "another real quotation"]
    assert one(spark, 'only " one mark', T.outer_span) is None


def test_cited_ids_keep_order_and_reject_upper_case(spark):
    assert one(spark, "[b-1#x(2)] [a#y] [b-1#x(2)] [B#z]", T.cited_ids) == ["b-1#x(2)", "a#y"]


def test_tokens(spark):
    assert one(spark, "Ab-c 12é3", T.tokens) == ["ab", "c", "12", "3"]
    assert one(spark, None, T.tokens) == []
