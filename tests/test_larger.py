"""What larger tables bring: ids beyond those of the given tables, and very long lines."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from lectern import plans  # noqa: F401
from lectern.functions import similarity
from lectern.plans.segments import SLICE, _per_row
from lectern.registry import QUERIES


@pytest.fixture
def texts(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return lambda pairs: write([(i, t, "en", "src1", len(t)) for i, t in pairs])


def test_ids_of_many_documents(spark, texts):
    """LRN12: the key of a sentence of document 4,000,000 is no overflow; the order is that of the whole product."""
    docs = list(range(4_000_000, 4_000_030))
    ids = [i * 10_000_000_000 + 100_001 for i in docs]
    got = QUERIES["LRN12"](spark, texts([(i, "Some words.") for i in docs])).collect()
    assert [r.level for r in got] == ["easy"] * 10
    assert sorted(r.id for r in got) == sorted(sorted(ids, key=lambda i: ((i * 7919 + 101) % 10007, i))[:10])


def test_long_lines_of_words(spark, texts):
    """PDF1, PDF3 and PDF4-6: a line of 40,000 words, in small letters and with capitals, is a paragraph like another, and none goes down the stack."""
    folder = texts([(1, "\n".join(["Some Title of a Text", "reerwh " * 40_000, "Anna Miller, Ben Jones", "Reerwh " * 40_000, "1" + ".1" * 40_000, "a" + "-a" * 40_000, "The end."]))])
    classes = {(r.line_no, r.profile): r["class"] for r in QUERIES["PDF1"](spark, folder).collect()}
    assert len(classes) == 21 and {classes[2, p] for p in ("journal", "arxiv", "essay_academic")} == {"paragraph"}
    assert {r.line_no: r["class"] for r in QUERIES["PDF3"](spark, folder).collect()}[2] == "paragraph"
    assert [QUERIES[q](spark, folder).count() for q in ("PDF4", "PDF5")] == [21, 21]
    stands = {(r.line_no, r.profile): r.stands for r in QUERIES["PDF6"](spark, folder).collect()}
    assert not stands[2, "journal"] and not stands[7, "journal"]
    assert QUERIES["PDF7"](spark, folder).count() > 0


def test_few_rows_are_texts_at_a_time(spark):
    """SEG2-4, SEG7-11, STR18: of a batch of rows no more than a slice has results that are not yet handed on."""

    def make(x):
        import gc

        return f"{x},{sum(type(o) is list and len(o) > SLICE and all(type(s) is str and s.endswith('!') for s in o) for o in gc.get_objects())}"

    rows = spark.range(0, 3000, 1, 1).select("id", F.concat(F.col("id").cast("string"), F.lit("!")).alias("x"))
    got = {r.id: r.out for r in _per_row(rows, ["id"], ["x"], make, "string").collect()}
    assert got == {i: f"{i}!,0" for i in range(3000)}


def test_long_common_subsequences(spark, tmp_path):
    """MTH5, MTH8: turns of 4,000 words, in a time that a table filled by copying its rows does not reach; the length is that of the table."""
    a, b = ([str(random.Random(k).randrange(i)) for i in range(1, 4001)] for k in (1, 2))
    row = [0] * 301
    for x in a[:300]:
        row = list(itertools.accumulate(range(1, 301), lambda new, j, x=x, old=row: old[j - 1] + 1 if x == b[j - 1] else max(old[j], new), initial=0))
    assert similarity.lcs(a[:300], b[:300]) == row[-1] and similarity.lcs([], b) == 0 and similarity.lcs(None, b) is None and similarity.lcs(a, a) == 4000
    spark.createDataFrame([(1, 0, "u", " ".join(a)), (1, 1, "u", " ".join(b)), (2, 0, "u", " a b"), (2, 1, "u", "a b ")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    began = time.monotonic()
    got = {r.conv_id: r.similarity for r in QUERIES["MTH5"](spark, str(tmp_path)).collect()}
    assert got == {1: similarity.lcs(a, b) / 4000, 2: 2 * 2 / 6} and time.monotonic() - began < 60


def test_lines_are_not_joined_by_patterns(spark):
    """PDF1 and what reads its classes: a join sorts by columns, as a pattern in its key runs for every comparison; a second reading reads its documents alone."""
    from lectern.plans import pages

    folder = "/root/testdata/sf0.001"
    plan = QUERIES["PDF7"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and not [x for x in plan.splitlines() if "Join" in x and "regexp_replace" in x]
    only = spark.createDataFrame([(3,), (8,)], "doc_id bigint")
    every, some = pages.lines_of(spark, folder), pages.lines_of(spark, folder, only=only)
    ours = [sorted(map(str, rows.collect())) for rows in (every.join(only, "doc_id", "left_semi").select(every.columns), some.select(every.columns))]
    assert ours[0] and ours[0] == ours[1]


def test_normal_forms_are_made_once(spark):
    """ANC1 and JN26: what the joins read is stored with its normal form, so no pattern runs again; the form drops all signs that the SQL drops."""
    from lectern.plans import scalars
    from lectern.plans.base import ORACLE, SPARK

    plan = QUERIES["JN26"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
    signs = [(f"A{chr(i)}B {chr(i) * 2} c",) for i in (*range(1, 0x3100), 0xABFF, 0xAC00, 0xD7A3, 0xD7A4, 0xFEFF, 0xFFFD, 0x1F600) if not 0xD800 <= i <= 0xDFFF]
    theirs = scalars.normal(ORACLE, "t").replace("\\", "\\\\").replace(", 'g')", ")")
    assert spark.createDataFrame(signs, "t string").selectExpr(f"count_if({scalars.normal(SPARK, 't')} <> {theirs}) as n").first().n == 0


def test_shared_tokens_are_counted_once(spark):
    """ANC1 and JN26: a likeness counts the shared tokens of a pair once, and walks the tokens only where the first one is there at all."""
    told = similarity.light("x", "y")
    assert told.count("array_intersect") == told.count("array_union") == 1
    pairs = spark.createDataFrame([("a b c", "a c d"), ("b c", "a b c"), ("a", "b"), ("", "a"), ("a b", "a b"), ("a a b", "a b b")], "x string, y string")
    got = [r.s for r in pairs.select(F.expr(told).alias("s")).collect()]
    assert got == pytest.approx([max(0.5, 0.3 + 0.4 * 2 / 3), 2 / 3, 0, 0, 1, 1])
