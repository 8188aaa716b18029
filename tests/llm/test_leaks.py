from skyquilt.llm import decontam

BIG = 2**60 + 1


def test_short_items_and_null_ids(spark):
    """Items of few words and letters are reported with a flag, against a plain search; null and large ids stay as they are."""
    items = [(1, "the cat"), (None, "photosynthesis converts sunlight"), (BIG, "a b"), (2, "one two three four five six seven eight nine ten"), (3, None), (4, "...")]
    docs = [(None, "The CAT sat on a, b"), (BIG, "photosynthesis converts sunlight, a cat"), (None, "one two four five six seven eight nine ten"), (5, None), (6, ""), (None, "The CAT sat on a, b"), (7, "clean")]
    docs_table = spark.createDataFrame([(*d, "x", True) for d in docs], "doc_id long, text string, item_id string, by_chance boolean")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for block in (8.0, 0.00001):
        got = decontam.find_leaks(docs_table, bench, chance=True, max_block_mb=block)
        assert got.columns == ["doc_id", "item_id", "item_words", "distance", "first_word", "end_word", "by_chance"]
        want = [(None, 1, 2, 0, 0, 2, True), (None, BIG, 2, 0, 4, 6, True)] * 2 + [(BIG, None, 3, 0, 0, 3, False), (None, 2, 10, 1, 0, 9, False)]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {tuple(r)[:2] for r in decontam.find_leaks(docs_table, bench).collect()} == {(BIG, None), (None, 2)}
    kept = decontam.drop_leaks(docs_table, bench)
    assert kept.columns == docs_table.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([None, None, 5, 6, 7], key=str)
