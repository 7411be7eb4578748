"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest

from tally.llm import decontam, langid, lengths, licenses, lm, pieces, quality, shards, simhash, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row int, _key string, measures int, kept int, h int, spans int"
LONG = "word of the text " * 3000
ROWS = [(1, None, None, None, None), (None, "", "en", "s", 0), (None, None, None, None, None), (3, LONG, "en", "s", len(LONG)), (4, "one", "de", None, 3),
        (4, "one", "de", None, 3), (5, "ONE", "fr", "s", 3), (6, "\0 \t\n", None, "s", 4), (7, "a b c d e f g h i j k", "en", None, 21)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "x", 1, "k", 2, 3, 4, 5) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "e f g h i j"), (2, None), (None, "one")], "item_id long, text string")


OPERATORS = {
    "quality": lambda d, i: quality.quality(d), "keep_good": lambda d, i: quality.keep_good(d),
    "simhash": lambda d, i: simhash.simhash_groups(d), "keep_first": lambda d, i: simhash.simhash_keep_first(d),
    "suffix": lambda d, i: suffix.remove_repeats(d), "drop_repeats": lambda d, i: suffix.drop_repeats(d),
    "drop_contaminated": lambda d, i: decontam.drop_contaminated(d, i), "pieces": lambda d, i: pieces.encode(d),
    "licenses": lambda d, i: licenses.scan(d), "lm": lambda d, i: lm.backoff_scores(d),
    "langid": lambda d, i: langid.identify(d, langid.fit(d)), "shards": lambda d, i: shards.shuffle_into_shards(d),
    "lengths": lambda d, i: lengths.suffix_sums(lengths.length_histogram(lengths.token_counts(d))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(table, items, name):
    assert OPERATORS[name](table.limit(0), items).collect() == []


@pytest.mark.parametrize("name", ["quality", "simhash", "suffix", "pieces", "lm", "langid", "shards"])
def test_one_row_out_for_each_row(table, items, name):
    got = OPERATORS[name](table, items).collect()
    ids = [r.row.doc_id if name in ("suffix", "pieces", "shards") else r.doc_id for r in got]
    assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", ["keep_good", "keep_first", "drop_repeats", "drop_contaminated"])
def test_columns_pass_through(table, items, name):
    got = OPERATORS[name](table, items)
    assert got.columns == table.columns and got.dtypes == table.dtypes
    got.collect()


def test_what_stays(table, items):
    def texts(name):
        return [(r.doc_id, r.text) for r in OPERATORS[name](table, items).collect()]
    # one of the texts without words (the smallest id), one "one", and the others; a null character is a word
    assert sorted(texts("keep_first")) == [(1, None), (3, LONG), (4, "one"), (6, "\0 \t\n"), (7, ROWS[-1][1])]
    assert sorted(i for i, _ in texts("drop_contaminated") if i) == [1, 3, 6]
    left = {i: t for i, t in texts("drop_repeats")}
    assert left[3] == "" and left[7] == ROWS[-1][1] and left[1] is None
    assert {r.doc_id: r.lang_pred for r in OPERATORS["langid"](table, items).collect()}[1] == "und"
    pieces_ = [(r.row.doc_id, r.n_pieces, r.round_trip) for r in OPERATORS["pieces"](table, items).collect()]
    assert all(ok for *_, ok in pieces_) and [n for i, n, _ in pieces_ if i == 1] == [0]


@pytest.mark.parametrize("name", OPERATORS)
def test_very_long_texts(spark, items, name):
    """Long runs without a break and one very long text of words go through every operator whole."""
    texts = [" " * 300_000, "a" * 300_000, "\n" * 300_000, "x" + " " * 300_000 + "y", "word " * 100_000]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = OPERATORS[name](d, items).collect()
    if name in ("quality", "simhash", "suffix", "pieces", "lm", "langid", "shards"):
        assert len(got) == len(texts)
    if name == "pieces":
        assert all(r.round_trip for r in got)


def test_no_items(table, items):
    assert decontam.matches(table.select("doc_id", "text").toDF("row_id", "text"), items.limit(0)).collect() == []
    assert decontam.drop_contaminated(table, items.limit(0)).count() == len(ROWS)


def test_components_without_ids(spark):
    rows = [(None, "same words here now"), (None, "same words here now"), (None, "another text of words")]
    got = simhash.simhash_keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == ["another text of words", "same words here now"]
    again = spark.createDataFrame([(5, "same words here now"), (5, "totally different things there"), (3, "totally different things there")], "doc_id long, text string")
    assert sorted(simhash.simhash_keep_first(again).collect()) == [(3, "totally different things there"), (5, "same words here now")]


def test_wrong_arguments(table, items):
    for f in (lambda: pieces.encode(table, n=0), lambda: suffix.remove_repeats(table, gram=4), lambda: lm.backoff_scores(table, order=0),
              lambda: simhash.block_masks(99), lambda: licenses.scan(table, containment=0), lambda: shards.shuffle_into_shards(table, shards=0),
              lambda: decontam.matches(table, items, similarity=2)):
        with pytest.raises(ValueError):
            f()


def test_searches_and_counts_of_odd_rows(table, items):
    rows = table.select(table.doc_id.alias("row_id"), "text", "lang", "h")
    got = decontam.matches(rows, items).collect()
    # "one" is an item of one word: the repeated row is one document's part, the upper-case one its match too
    assert sorted((r.row_id, r.item_id, r.similarity) for r in got) == [(4, None, 1.0), (5, None, 1.0), (7, 1, 1.0)]
    assert licenses.scan(table).collect() == []
    counts = [(r.doc_id, r.n_tokens) for r in lengths.token_counts(table).collect()]
    assert len(counts) == len(ROWS) and counts.count((None, 0)) == 2 and counts.count((4, 1)) == 2 and (1, 0) in counts
    assert sum(r.docs for r in lengths.length_histogram(lengths.token_counts(table)).collect()) == len(ROWS)


def test_decoding_of_odd_rows(spark):
    rows = spark.createDataFrame([((1,), None), ((2,), []), ((None,), None)], "row struct<text: int>, ids array<int>")
    assert sorted(((r.row.text, r.text) for r in pieces.decode(rows).collect()), key=str) == [(1, None), (2, ""), (None, None)]
    assert pieces.decode(rows.limit(0)).collect() == []
