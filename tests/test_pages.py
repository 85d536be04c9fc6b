"""Blocks of documents from typed lines: every transition by hand rows, promotions and evidence against direct simulations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions.page_blocks import Line, Machine, Stats, glue, goes_on, heading_goes_on, paragraph_ends
from lectern.plans import pages

STATS = Stats(12, 14.4, 468)
WIDE = "Some words of a long line that fills the whole width of the body text and goes"


def lines(*rows):
    """Lines (text, kind, page, y, x, x_end, font, definite, table), each below the one before unless y is said."""
    out, y = [], 100.0
    for row in rows:
        text, kind, more = row[0], row[1] if len(row) > 1 else "paragraph", row[2] if len(row) > 2 else {}
        y = more.get("y", y + 14)
        out.append(Line(text, kind, more.get("page", out[-1].page if out else 1), y, more.get("x", 72.0), more.get("x_end", 540.0), more.get("font", 12.0), more.get("definite", False), more.get("table", False)))
    return out


def blocks(*rows, profile="journal", strict=False):
    return [(b.kind, b.content) for b in Machine(STATS, profile, strict).blocks(iter(lines(*rows)))]


def test_heading_and_paragraph_stay_apart():
    assert blocks(("Introduction", "heading", {"font": 16.0}), (f"{WIDE} on",), ("to its end.",)) == [("heading", "Introduction"), ("paragraph", f"{WIDE} on to its end.")]


def test_headings_of_several_lines_and_numbers_join():
    rows = [("4", "heading"), ("Provocations from the", "heading", {"font": 12.0}), ("Northern River", "heading"), (f"{WIDE} far.",)]
    assert blocks(*rows)[0] == ("heading", "4 Provocations from the Northern River")
    assert blocks(("Post-", "heading"), ("Humanism", "heading"), (f"{WIDE} far.",))[0] == ("heading", "Post-Humanism")
    assert blocks(("Results", "heading"), ("The river was low in the year of the great drought", "paragraph"))[0] == ("heading", "Results")


def test_no_heading_in_an_open_sentence_unless_definite():
    rows = [(f"{WIDE} to",), ("Small Words", "heading"), ("the end of it.",)]
    assert blocks(*rows) == [("paragraph", f"{WIDE} to the end of it.")]
    rows[1] = ("SMALL WORDS", "heading", {"definite": True})
    assert [k for k, _ in blocks(*rows)] == ["paragraph", "heading"]


def test_titles_join_and_metadata_end_paragraphs():
    rows = [("A Long Title of the", "document_title", {"font": 18.0}), ("Northern River.", "document_title", {"font": 18.0}), ("Jane Roe", "author"), ("doi:10.1/x", "doi"), (f"{WIDE} to",), ("University of X", "affiliation"), ("the end of the paragraph that was cut.",)]
    assert blocks(*rows) == [("document_title", "A Long Title of the Northern River"), ("author", "Jane Roe"), ("doi", "doi:10.1/x"), ("paragraph", f"{WIDE} to"), ("affiliation", "University of X"), ("paragraph", "the end of the paragraph that was cut.")]


def test_abstract_runs_to_a_heading_or_keywords():
    rows = [("Abstract", "abstract_label"), (f"{WIDE} on",), ("to its end.",), ("Introduction", "heading"), (f"{WIDE} far.",)]
    assert blocks(*rows) == [("abstract_label", "Abstract"), ("abstract_body", f"{WIDE} on to its end."), ("heading", "Introduction"), ("paragraph", f"{WIDE} far.")]
    rows[3] = ("Keywords: rivers and stones and their many names in the long valley",)
    assert [k for k, _ in blocks(*rows)][:3] == ["abstract_label", "abstract_body", "paragraph"]


def test_references_run_to_a_real_section():
    rows = [("References", "heading"), ("[1] A. Roe. Rivers. 2001.",), ("Doi Fragment", "heading"), ("[2] B. Roe. Stones. 2002.",), ("Appendix", "heading", {"y": 400.0}), (f"{WIDE} far.",)]
    assert blocks(*rows) == [("heading", "References"), ("reference_block", "[1] A. Roe. Rivers. 2001.\nDoi Fragment\n[2] B. Roe. Stones. 2002."), ("heading", "Appendix"), ("paragraph", f"{WIDE} far.")]
    pages_ = [("References", "heading"), ("[1] A. Roe. Rivers. 2001.",), ("[2] B. Roe. Stones. 2002.", "paragraph", {"page": 2, "y": 80.0})]
    assert [k for k, _ in blocks(*pages_)] == ["heading", "reference_block", "reference_block"]
    footer = [("References", "heading"), ("[1] A. Roe. Rivers. 2001.",), ("NOTES", "footer"), (f"{WIDE} far.",)]
    assert blocks(*footer)[2] == ("heading", "NOTES") and ("heading", "NOTES") not in blocks(*footer[2:])


def test_fragments_wait_for_the_next_paragraph():
    rows = [("However, not", "paragraph", {"x_end": 130.0}), ("Metadata", "journal"), (f"{WIDE} far.",)]
    assert blocks(*rows) == [("journal", "Metadata"), ("paragraph", f"However, not {WIDE} far.")]
    assert blocks(("Over.", "paragraph"), ("Metadata", "journal"), (f"{WIDE} far.",))[-1] == ("paragraph", f"{WIDE} far.")


def test_tables_float_in_a_paragraph_and_captions_follow():
    rows = [(f"{WIDE} to",), ("cell 1", "paragraph", {"table": True, "y": 300.0}), ("cell 2", "heading", {"table": True}), ("Table 1. Rivers and stones", "paragraph"), ("the end of the sentence.", "paragraph", {"page": 2, "y": 80.0})]
    assert blocks(*rows) == [("paragraph", f"{WIDE} to the end of the sentence."), ("table", "cell 1\ncell 2"), ("paragraph", "Table 1. Rivers and stones")]
    assert blocks(("cell 1", "paragraph", {"table": True})) == [("table", "cell 1")]


def test_page_breaks_by_profile():
    rows = [(f"{WIDE} to",), ("12", "footer"), ("Running Head", "header", {"page": 2, "y": 30.0}), ("Fake", "heading", {"y": 60.0}), ("the end.",), (f"{WIDE} far.", "paragraph", {"y": 300.0})]
    assert blocks(*rows) == [("paragraph", f"{WIDE} to"), ("heading", "Fake"), ("paragraph", f"{WIDE} far.")]
    assert blocks(*rows, profile="arxiv")[0] == ("paragraph", f"{WIDE} to the end.")
    assert blocks(*rows, profile="essay_academic")[0] == ("paragraph", f"{WIDE} to the end.")


def test_paragraph_breaks_by_layout_and_strictness():
    two = lines((f"{WIDE} to.",), (f"{WIDE} far.",))
    for down, strict, relaxed in ((20, False, False), (25, True, False), (30, True, True)):
        two[1].y = two[0].y + down
        assert paragraph_ends(two[0], "paragraph", two[1], "paragraph", STATS, "journal", True) == strict
        assert paragraph_ends(two[0], "paragraph", two[1], "paragraph", STATS, "journal", False) == relaxed
    two[1].y, two[1].x = two[0].y - 600, 330.0  # the next column
    assert not paragraph_ends(two[0], "paragraph", two[1], "paragraph", STATS, "journal", False)
    two[1].y, two[1].x = two[0].y + 14, 84.0  # an indent after a full stop
    assert paragraph_ends(two[0], "paragraph", two[1], "paragraph", STATS, "arxiv", False) and not paragraph_ends(two[0], "paragraph", two[1], "paragraph", STATS, "journal", False)
    assert paragraph_ends(two[0], "paragraph", two[1], "footnote", STATS, "arxiv", False) and paragraph_ends(two[0], "paragraph", None, "paragraph", STATS, "arxiv", False)


@pytest.mark.parametrize(
    "a, b, want",
    [("a broken-", "word", True), ("It ended.", "and more", False), ("as by et al.", "and more", True), ("so it was i.e.", "And more", True), ("so it was i.e.", "More", False), ("first, second,", "Third", True), ("three words here", "and more", True), ("three words here", "Not so", False), ("(three words here", "and more", False), ("two words", "and more", False), ("see the note.1", "and more", False)],
)
def test_sentences_go_on(a, b, want):
    x, y = lines((a,), (b,))
    assert goes_on(x, "paragraph", y, "paragraph") == want and not goes_on(x, "paragraph", y, "heading")


def test_hyphens_and_heading_lines():
    assert [glue(*x) for x in (("Post-", "Humanism", True), ("Post-", "Humanism"), ("exam-", "ple word continuation"), ("some-", "thing"), ("word", "next"))] == ["Post-Humanism", "Post-Humanism", "exam- ple word continuation", "some-thing", "word next"]
    x, y = lines(("2.1", "heading"), ("Much longer headings than a line would be let to have if no number stood before it",))
    assert heading_goes_on(x, y, STATS) and not heading_goes_on(y, x, STATS)


def test_standing_lines_are_paragraphs_of_their_own():
    rows = [(f"{WIDE} far.",), ("A short remark in between", "paragraph", {"x_end": 200.0}), (f"{WIDE} off.",)]
    out = list(Machine(STATS).blocks(iter(lines(*rows))))
    assert [(b.content, b.standalone) for b in out] == [(f"{WIDE} far.", False), ("A short remark in between", True), (f"{WIDE} off.", False)]
    rows[2] = ("and goes on in small letters to the end.",)
    assert len(blocks(*rows)) == 1


def test_machine_takes_lines_as_they_come():
    """A long document is never held: a thousand pages, a block out for a few lines in."""
    taken, most = 0, 0

    def feed():
        nonlocal taken
        for i in range(20_000):
            taken += 1
            yield Line(f"{WIDE} number {i}.", "paragraph", 1 + i // 20, 100.0 + 30 * (i % 20), 72.0, 540.0, 12.0)

    for n, _ in enumerate(Machine(STATS).blocks(feed()), 1):
        most = max(most, taken - n)
    assert n == 20_000 and most <= 4


def test_blocks_across_arrow_batches(spark):
    of = [x for d in range(3) for x in [(d, i, *r) for i, r in enumerate((y.text, y.kind, y.page, y.y, y.x, y.x_end, y.font, y.definite, y.table) for y in lines(("Title", "heading", {"font": 16.0}), *[(f"{WIDE} {k}.", "paragraph", {"y": 130.0 + 40 * k}) for k in range(12)]))]]
    names = "doc_id long, line_no long, line string, class string, page int, y double, x double, x_end double, font double, definite boolean, is_table boolean"
    frame = spark.createDataFrame(of, names).selectExpr("*", "12d as body_font", "14.4d as line_gap", "468d as body_width", "'journal' as profile", "false as strict")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = sorted((r.doc_id, r.block_no, r.kind) for r in pages.to_blocks(frame).collect())
        assert pages.to_blocks(frame.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [(d, n, "heading" if n == 0 else "paragraph") for d in range(3) for n in range(13)]


BLOCK = "doc_id long, block_no int, kind string, content string, page int, x double, y double, standalone boolean, profile string"


def walk(rows):
    """The promotions of one document, block after block."""
    kinds = [r[2] for r in rows]
    t = [r[3].strip() for r in rows]
    seen = {}
    for r in rows:
        if r[2] in ("paragraph", "heading"):
            seen.setdefault(r[3].strip().lower(), set()).add(r[4])
    for i, r in enumerate(rows):
        ended = lambda x: re.search("[.!?][\"']?\\s*$", x)
        near = sum(len(t[j]) <= 60 and not re.search(r"[.!?]\s*$", t[j]) for j in range(max(0, i - 4), min(len(t), i + 5)) if j != i)
        author = r[1] <= 10 and len(t[i]) < 120 and not ended(t[i]) and " " in t[i] and (re.search(pages.NAME, t[i]) or re.search(pages.SCHOOL, t[i]))
        if kinds[i] != "paragraph" or author or t[i].lower() in ("references", "works cited") or r[6] / 792 > 0.8 or ended(t[i]) or len(t[i]) > 120:
            continue
        if (near >= 3 and len(t[i]) <= 40) or (len(t[i].split()) <= 1 and len(t[i]) <= 20) or (len(seen[t[i].lower()]) >= 3 and 20 <= len(t[i]) <= 120) or re.match(r"\[\d+\]|https?://|doi:", t[i]):
            continue
        before, after = (i > 0 and kinds[i - 1] == "paragraph"), (i + 1 < len(rows) and kinds[i + 1] == "paragraph")
        if not (r[7] or (before and after)) or (before and not ended(t[i - 1])) or (after and re.match("[a-z]", t[i + 1])):
            continue
        kinds[i] = "heading"
    return kinds


def test_promotion_equals_the_walk(spark):
    rng = random.Random(5)
    texts = ["A phrase that stands on its own here", "Another short phrase", f"{WIDE} far.", "and small letters go on.", "Ended.", "Jane Roe", "University of X", "[1] Roe, Rivers", "Word", "The same header text of all pages", "no end of this"]
    rows = [(d, i, rng.choice(["paragraph"] * 6 + ["heading", "table"]), rng.choice(texts), rng.randrange(1, 5), 72.0, rng.choice([100.0, 700.0, 300.0]), rng.random() < 0.4, "journal") for d in range(300) for i in range(rng.randrange(1, 30))]
    got = {(r.doc_id, r.block_no): r.kind for r in pages.promoted(spark.createDataFrame(rows, BLOCK)).collect()}
    want = {}
    for d in range(300):
        of = [r for r in rows if r[0] == d]
        want |= dict(zip([(d, r[1]) for r in of], walk(of), strict=True))
    assert got == want and sum(want[r[0], r[1]] != r[2] for r in rows) > 15


def test_promotion_hangs_on_the_block_before(spark):
    body, phrase = f"{WIDE} far.", "A phrase that stands in between"
    rows = [(1, 0, "paragraph", body), (1, 1, "paragraph", phrase), (1, 2, "paragraph", "Another phrase that stands in between"), (1, 3, "paragraph", body)]
    frame = spark.createDataFrame([(*r, 1, 72.0, 100.0, False, "journal") for r in rows], BLOCK)
    assert [r.kind for r in sorted(pages.promoted(frame).collect(), key=lambda r: r.block_no)] == ["paragraph", "heading", "paragraph", "paragraph"]
    rows = [(*r, 1, 72.0, 100.0, r[1] == 2, "journal") for r in rows]  # the second stands alone: it needs no paragraph before, only none that is open
    assert [r.kind for r in sorted(pages.promoted(spark.createDataFrame(rows, BLOCK)).collect(), key=lambda r: r.block_no)] == ["paragraph", "heading", "heading", "paragraph"]


def evidence(spark, **docs):
    rows = [(i, n, k, t, 1, 72.0, 100.0, False, "journal") for i, (_, bs) in enumerate(docs.items()) for n, (k, t) in enumerate(bs)]
    return spark.createDataFrame(rows, BLOCK)


def test_archetypes_by_points_and_source(spark):
    p = lambda *ts: [("paragraph", t) for t in ts]
    docs = {
        "academic": [("doi", "doi:10.1/x"), ("abstract_label", "Abstract"), *p("We show results.")],
        "authors": [("author", "A B"), ("author", "C D"), *p("nothing")],
        "literary": p("Chapter 1", '"a" ' * 11, "once upon a time"),
        "essay": p("In my opinion I believe it."),
        "generic": p("nothing at all"),
        "tie": p("Chapter 2", "the methodology of Roe et al. in 2001"),
        "beyond": p(*["x"] * 20, "arXiv:1234.5678 is too late"),
        "arxiv": p("nothing"),
        "guardian": p("nothing"),
    }
    sources = spark.createDataFrame([(7, "my arXiv list"), (8, "The Guardian"), (0, None)], "doc_id long, source string")
    got = {r.doc_id: (r.archetype, round(r.confidence, 4), r.found_by) for r in pages.archetypes(evidence(spark, **docs), sources).collect()}
    auto = [("academic", 0.95, "auto"), ("academic", 0.7, "auto"), ("literary", 0.9, "auto"), ("essay", 0.85, "auto"), ("generic", 0.5, "auto"), ("academic", 0.7, "auto"), ("generic", 0.5, "auto")]
    assert [got[i] for i in range(9)] == [*auto, ("academic", 1.0, "source"), ("essay", 0.9, "source")]


def test_strictness_bands_override_and_fail_safe(spark):
    formulas, figures = "= = = =", "Figure 1 and Table 2"
    heads = [("heading", "1. Methods"), ("heading", "2. Results")]
    long_ = [("paragraph", "word " * 100)] * 5
    docs = {"strict": [*heads, ("paragraph", formulas + figures)], "fail_safe": [*heads, *long_, ("paragraph", formulas + figures)], "essay": [("heading", "On rivers"), ("heading", "On stones"), ("paragraph", "I think so. I believe so.")], "arxiv": [*heads, ("paragraph", formulas + figures + " arXiv:1234.5678")], "two": [*heads, ("paragraph", "plain")]}
    got = {r.doc_id: (r.score, r.strictness, r.profile, r.confidence) for r in pages.strictness(evidence(spark, **docs)).collect()}
    assert [got[i] for i in range(5)] == [(0, "strict", "journal", 0.9), (2, "relaxed", "essay_academic", 0.6), (6, "relaxed", "essay_academic", 0.8), (0, "relaxed", "arxiv", 0.9), (2, "relaxed", "journal", 0.6)]


def test_running_lines_go(spark):
    head = "A running head of every page"
    rows = [(1, 3 * q + k, kind, t, q, 72.0, y, False, "journal") for q in range(1, 4) for k, (kind, t, y) in enumerate([("paragraph", head, 50.0), ("paragraph", f"{WIDE} {q}.", 200.0), ("paragraph", "17", 750.0)])]
    rows += [(2, q, "heading", head, q, 72.0, 50.0, False, "journal") for q in range(3)] + [(3, q, "paragraph", "Vol. 2 of rivers", q, 72.0, 300.0, False, "essay_academic") for q in range(2)] + [(3, 9, "paragraph", "Vol. 3 of rivers", 1, 72.0, 300.0, False, "essay_academic")]
    got = sorted((r.doc_id, r.content) for r in pages.without_running(spark.createDataFrame(rows, BLOCK)).collect())
    assert got == [*((1, f"{WIDE} {q}.") for q in range(1, 4)), (2, head), (3, "Vol. 3 of rivers")]


def test_only_documents_of_another_reading_are_read_again(spark):
    first = evidence(spark, a=[("heading", "1. Methods"), ("heading", "2. Results"), ("paragraph", "= = = = Figure 1, Table 2. Two sentences here.")], b=[("paragraph", "One day it rained. The end of the story.")])
    asked = []

    def second(again):
        asked.extend(again.collect())
        return spark.createDataFrame([(0, 0, "paragraph", "Read again as one. And strictly so.", 1, 72.0, 100.0, False, "journal")], BLOCK)

    sources = spark.createDataFrame([(0, "arXiv"), (1, "Project Gutenberg")], "doc_id long, source string")
    got = sorted((r.doc_id, r.archetype, r.block_no, r.sentence_no, r.sentence) for r in pages.two_passes(spark, first, sources, second).collect())
    assert [(r.doc_id, r.strictness) for r in asked] == [(0, "strict")]
    assert got == [(0, "academic", 1, 1, "Read again as one."), (0, "academic", 1, 2, "And strictly so."), (1, "literary", 1, 1, "One day it rained."), (1, "literary", 1, 2, "The end of the story.")]


def test_authors_zone(spark):
    from lectern.plans.base import SPARK

    rows = ["A Title of Rivers|document_title", "Jane Roe|author", "John Doe, Stones|paragraph", "Department of Rivers|heading", "roe@river.org|paragraph", "Abstract|abstract_label", "John Doe, Stones|paragraph"]
    frame = [(1, i, 1, 100.0 + i, *r.split("|"), "journal") for i, r in enumerate(rows)] + [(1, 9, 2, 50.0, "John Doe, Stones", "paragraph", "journal")]
    spark.createDataFrame(frame, "doc_id long, line_no long, page int, y double, line string, class string, profile string").createOrReplaceTempView("typed")
    got = {r.line_no: r["class"] for r in spark.sql(pages.authors_mended(SPARK, "typed", "line_no")).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 6, 9)] == ["document_title", "author", "author", "affiliation", "author", "abstract_label", "paragraph", "paragraph"]


def test_definite_headings(spark):
    from lectern.plans.base import SPARK

    rows = [("CONCLUSIONS", "It ended.", True), ("Works Cited", "It ended.", True), ("Works Cited", "it goes on", False), ("CONCLUSIONS", "one, two,", False), ("AI", None, False), ("RIVERS AND STONES", None, True), ("1441", None, False), ("A Title", None, False), ("THE END.", None, False), ("A B C D E F G", None, False)]
    frame = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(rows)], "i int, t string, prev string")
    got = {r.i: r.d for r in frame.select("i", F.expr(pages.definite(SPARK)).alias("d")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for *_, w in rows]


def test_rules_for_two_lines_say_the_same_in_sql(spark):
    """The SQL of continuation, paragraph ends, headings and standing lines against the machine's functions, on all lines and on odd pairs."""
    from lectern.functions.page_blocks import stands_alone
    from lectern.plans.base import SPARK
    from lectern.plans.segments import view

    names = {"goes_on": pages.sentence_goes_on, "ends": pages.ends_paragraph, "merges": pages.heading_continues, "stands": pages.standing}
    rng = random.Random(6)
    texts = ["A broken-", "It ended.", "as by et al.", "(open one two", "and more", "More words here, and", "2.1", "Results and Discussion", "a-b-c-d", "The river was", "Jane Roe, 2, John Doe", "Abstract of it", "x. Yes", "100 words", "$5 more", '"quoted', "short", f"{WIDE} to", f"{WIDE} far.", "end:)", "w" * 90]
    kinds = ["paragraph"] * 5 + ["heading", "author", "footnote", "document_title"]
    odd = []
    for i in range(1500):
        a, b, c = (rng.choice(texts) for _ in "abc")
        odd.append((i, a, rng.choice(kinds), 1, 100.0, rng.choice([72.0, 330.0]), rng.choice([540.0, 300.0]), rng.choice([12.0, 16.0]), b, rng.choice(kinds), rng.choice([1, 1, 2]), 100.0 + rng.choice([14, 25, 30, 100, -300]), rng.choice([72.0, 84.0, 330.0]), rng.choice([12.0, 16.0]), rng.choice([c, None]), rng.choice(["journal", "arxiv", "essay_academic"])))
    columns = "line_no long, t string, class string, page int, y double, x double, x_end double, font double, r string, r_class string, r_page int, r_y double, r_x double, r_font double, b string, profile string"
    made = spark.createDataFrame(odd, columns).selectExpr("*", "12d as body_font", "14.4d as line_gap", "468d as body_width")
    real = view(spark, "/root/testdata/sf0.001", f"select * from {pages.around(SPARK)} n", "documents")
    for frame in (made, real.select(made.columns)):
        for r in frame.select("*", *(F.expr(f(SPARK)).alias(k) for k, f in names.items())).collect():
            line = Line(r.t, r["class"], r.page, r.y, r.x, r.x_end, r.font)
            after = None if r.r is None else Line(r.r, r.r_class, r.r_page, r.r_y, r.r_x, r.x_end, r.r_font)
            before = None if r.b is None else Line(r.b, "paragraph", 1, 0.0, 0.0, 0.0, 12.0)
            s = Stats(r.body_font, r.line_gap, r.body_width)
            want = after is not None and goes_on(line, r["class"], after, r.r_class), paragraph_ends(line, r["class"], after, r.r_class, s, r.profile, False), after is not None and heading_goes_on(line, after, s), stands_alone(line, before, after, s)
            assert (r.goes_on, r.ends, r.merges, r.stands) == tuple(map(bool, want)), r


def test_markdown(spark):
    frame = evidence(spark, a=[("document_title", "T"), ("author", "A"), ("heading", "H"), ("paragraph", "p"), ("abstract_body", "b")])
    assert pages.markdown(frame).first().markdown == "T\n\n[AUTHOR] A\n\n\n## H\n\np\n\nb"


def test_blocks_are_dealt_once_for_promotion(spark):
    """PDF10, PDF12: all windows of a document go over one exchange of its blocks, and no join has them a second time."""
    plan = pages.promoted(spark.createDataFrame([(1, 0, "paragraph", "x", 1, 72.0, 100.0, False, "journal")], BLOCK))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_second_stage_reads_stored_blocks_once(spark):
    """PDF12: promotions are made once and stored; all blocks, prose or not, go through one scan by archetype, academic and not."""
    rows = [(1, 0, "paragraph", "A sentence here. Another one there.", 1, 72.0, 100.0, False, "journal"), (1, 1, "heading", "Some Heading", 1, 72.0, 130.0, False, "journal")]
    sources = spark.createDataFrame([(1, "somewhere")], "doc_id long, source string")
    out = pages.two_passes(spark, spark.createDataFrame(rows, BLOCK), sources, lambda again: None)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert [(r.kind, r.sentence) for r in sorted(out.collect(), key=lambda r: (r.block_no, r.sentence_no))] == [("paragraph", "A sentence here."), ("paragraph", "Another one there."), ("heading", "Some Heading")]
