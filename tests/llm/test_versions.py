from palimpsest.llm import versions


def test_a_text_of_ordinary_lines_shares_its_first_half(spark):
    """Whatever a line's length: the sentences of the unchanged half are common."""
    def line(name, n):
        return " ".join(f"Sentence {i} of {name}." for i in range(n))

    rows = [(1, line("one", 8)), (2, line("two", 20) + "\n" + line("three", 20)), (3, line("four", 45)), (4, line("five", 60))]
    assert {len(t) > 1000 for _, t in rows} == {True, False}
    for r in versions.versions(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert 0.3 < r.near_edited < 0.7, r.doc_id


def test_spaces_around_line_ends(spark):
    df = spark.createDataFrame([("a. b\n\nc! \n d",), ("a.\nb\nc!\n d",)], "t string")
    assert [len(r[0]) for r in df.select(versions.digests(df.t)).collect()] == [4, 4]
