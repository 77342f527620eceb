from castmill.plans import pairs, queries

LONG = [f"w{i}" for i in range(60)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_whole_turns_are_compared(spark, tmp_path):
    """Turns that differ after word 40 only."""
    a, b = " ".join(LONG), " ".join([*LONG[:45], "other", *LONG[46:]])
    spark.createDataFrame([(1, 1, "user", a), (1, 2, "assistant", b)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    one = lambda name: pairs.QUERIES[name](spark, str(tmp_path)).first()
    assert one("char_errors_whole")["edits"] == edits(a, b) > 0
    assert one("word_errors")["substitutions"] == 1 and one("word_errors")["hits"] == 59
    assert one("wer_report")["wer"] == round(1 / 60, 6)
    assert one("rouge1_whole")["recall"] == round(59 / 60, 6) and one("rouge2_whole")["recall"] == round(57 / 59, 6)


def test_every_vector_takes_part(spark):
    d = "/root/testdata/sf0.1"
    used = queries.embedded(spark, d).agg({"vec_id": "max"}).first()[0]
    assert used == 1999 and {"similar_lines_whole", "scenes_whole", "highlight_whole"} <= set(queries.QUERIES)
    assert queries.QUERIES["similar_lines_whole"](spark, "/root/testdata/sf0.001").count() > 0
