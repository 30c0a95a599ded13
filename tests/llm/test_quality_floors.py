from glyphlake.llm import quality

DOCS = "doc_id long, text string, lang string, source string"


def kept(spark, rows):
    return {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(rows, DOCS)).collect()}


def test_repetition_out_of_line_with_its_group_goes(spark):
    """Half of the lines or 40 % of the words repeat in one of 400; in a group where that is common they stay."""
    plain = lambda i: " ".join(f"w{i:03}x{j:03}" for j in range(100))
    # rare repetition: ten lines of which five are copies, short so that few words repeat
    lines = lambda i: "\n".join([*(" ".join(f"w{i:03}x{10 * k + j:03}" for j in range(20)) for k in range(0, 10, 2)), *["a b"] * 6])
    words = lambda i: plain(i) + " " + " ".join(f"w{i:03}x{j:03}" for j in range(25))
    rows = [(i, plain(i), "en", "a") for i in range(400)] + [(1000, lines(990), "en", "a"), (1001, words(991), "en", "a")]
    rows += [(2000 + i, lines(i), "log", "b") for i in range(300)] + [(3000 + i, words(i), "verse", "c") for i in range(300)]
    found = kept(spark, rows)
    assert not found.pop(1000) and not found.pop(1001)
    assert all(found.values())


def test_few_symbols_and_long_words_out_of_line_go(spark):
    plain = lambda i: " ".join(f"w{i:03}x{j:03}" for j in range(100))
    rows = [(i, plain(i), "en", "a") for i in range(300)]
    rows += [(1000, plain(990).replace("x09", "#x09"), "en", "a"), (1001, plain(991).replace("x", "xyz"), "en", "a")]
    found = kept(spark, rows)
    assert not found.pop(1000) and not found.pop(1001)
    assert all(found.values())
