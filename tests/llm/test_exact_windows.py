"""Benchmark passages in other case, rich in placeholders, or short: found by the decontamination operator and the pipeline's stage."""

from lectern.llm import templates

ITEM = "Alice buys 12 apples for 3 dollars each and then sells half of them to her neighbour for twice the price she paid"


def test_exact_copies_in_any_case_and_of_any_length(spark):
    names = "Anna Bela Carl Dora Emil Fritz 1 2 3 4 5 6 7 8"
    items = spark.createDataFrame([(1, ITEM), (2, "What is 12 times 7?"), (3, names), (4, "Who won?"), (5, "12")], "item_id long, text string")
    other = ITEM.replace("12", "40").replace(" 3 ", " 7 ")
    texts = [f"a b {ITEM.upper()} c", ITEM.title(), "so: what IS 12 times 7, they asked", f"x {names.lower()} y", "and WHO won", "only 12.", other.upper()]
    texts += ["what is 12 times 8", "who has won", "120 and 1 2", names.replace("Carl", "Cora"), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.id, r.item): (r.matched, r.windows, r.same_values) for r in templates.contaminated(docs, items).collect()}
    assert {k: v for k, v in got.items() if k[1] != 5} == {
        (0, 1): (11, 11, True), (1, 1): (11, 11, True), (2, 2): (1, 1, True), (3, 3): (2, 2, True), (4, 4): (1, 1, True), (7, 2): (1, 1, False), (6, 1): (11, 11, False),
    }
    assert {k[0] for k in got if k[1] == 5} == {0, 1, 2, 5, 7}  # whatever holds the word 12


def test_exact_windows_count_by_themselves_on_both_sides_of_the_broadcast_bound(spark, monkeypatch):
    """A partly exact copy with a muddled rest is found by its exact windows, against all windows by brute force; shuffled or broadcast alike."""
    base = "Alice had 9 apples and 9 more pears when the long summer of the old valley came to its end and sold all 9 more"
    words = base.split()
    muddled = base.removesuffix("9 more") + "7 more"
    texts = [base, muddled, muddled.replace("Alice", "Berta"), " ".join(words[:12]) + " otherwise", base.replace("9", "4"), "x " * 30 + " ".join(words[4:17]) + " y", None, ""]
    items = spark.createDataFrame([(1, base)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    item = [w.lower() for w in words]
    wins = {tuple(item[i : i + templates.WIDTH]) for i in range(len(item) - templates.WIDTH + 1)}
    exact = {i for i, t in enumerate(texts) if t and any(tuple(t.lower().split()[k : k + templates.WIDTH]) in wins for k in range(len(t.split())))}
    found = {}
    for bound in (templates.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(templates, "BROADCAST_WINDOWS", bound)
        found[bound] = {(r.id, r.item, r.matched, r.same_values) for r in templates.contaminated(docs, items).collect()}
    assert len(set(map(frozenset, found.values()))) == 1
    assert {i for i, *_ in found[0]} == exact == {0, 1, 2, 4, 5}
    assert {(i, same) for i, _, _, same in found[0]} == {(0, True), (1, True), (2, True), (4, False), (5, True)}
