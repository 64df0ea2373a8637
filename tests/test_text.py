from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import ids, text
from lexiloom.sources.lines import FALLBACK_LINES, drop_blank, explode_lines, read_lines, with_fallback

EDGE = [
    "", "  ", "A\tB\nC\rD", "  two  spaces  ", "Äpfel ÉTÉ", "no\xa0break\xa0", "\x0bx\x1c y z　", "ABC xyz",
    "ΑΣ", "\x1f a \x85", "a​b",
]


def test_normalize_collapses_strips_and_lowers(column):
    expected = [" ".join(t.split()).lower() for t in EDGE]
    assert column(EDGE, text.normalize(F.col("t"))) == expected


def test_sanitize_unicode_strips_only_the_ends(column):
    spaced = [t.replace("\n", " ").replace("\r", " ").replace("\t", " ") for t in EDGE]
    assert column(EDGE, text.sanitize_unicode(F.col("t"))) == [t.lower().strip() for t in spaced]


def test_sanitize_ascii_touches_ascii_only(column):
    out = column(["A\tÄ\nZ ", "  É"], text.sanitize_ascii(F.col("t")))
    assert out == ["a Ä z ", "  É"]


def test_byte_heads_and_tails_may_cut_characters(column):
    values = ["", "ab", "aé", "éé"]
    data = [v.encode() for v in values]
    assert [bytes(x) for x in column(values, text.byte_head(F.col("t"), 3))] == [d[:3] for d in data]
    assert [bytes(x) for x in column(values, text.byte_tail(F.col("t"), 3))] == [d[-3:] for d in data]


def test_byte_ids_give_every_byte(column):
    values = ["", "a\x00b", "é€\U0001f600"]
    assert column(values, text.byte_ids(text.utf8(F.col("t")))) == [list(v.encode()) for v in values]


def test_word_count_counts_unicode_blanks(column):
    assert column(EDGE, text.word_count(F.col("t"))) == [len(t.split()) for t in EDGE]


def test_lines_split_on_any_break_and_keep_blank_ones(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\r\r\n \n\nc"), (2, ""), (3, "last")], "doc_id int, text string")
    lines = explode_lines(docs)
    assert [tuple(r) for r in lines.orderBy("doc_id", "line_no").collect()] == [
        (1, 0, "a"), (1, 1, "b"), (1, 2, " "), (1, 3, "c"), (3, 0, "last"),
    ]
    assert drop_blank(lines).count() == 4


def test_line_files_drop_empty_lines(spark, tmp_path):
    (tmp_path / "corpus.txt").write_bytes(b"one\r\n\r\ntwo\rthree\n \nfour")
    lines = read_lines(spark, str(tmp_path / "corpus.txt"))
    assert sorted(r["line"] for r in lines.collect()) == [" ", "four", "one", "three", "two"]


def test_fallback_only_for_an_empty_corpus(spark):
    lines = spark.createDataFrame([("x",)], "line string")
    assert [r["line"] for r in with_fallback(lines).collect()] == ["x"]
    empty = with_fallback(lines.where("line = 'y'"))
    assert sorted(r["line"] for r in empty.collect()) == FALLBACK_LINES


def test_tail_tokens(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), ([1],)], "t array<int>")
    out = [r[0] for r in df.select(ids.tail_tokens(F.col("t"), 2)).collect()]
    assert out == [[2, 3], [], [1]]


def test_id_lists_are_rejected_as_a_whole(column):
    values = ["1,2 3", "", " , \t", "1,x", "10", "-1", "+4", "-0", "1.5", "99999999999999999999", "9,\r\n8"]
    out = column(values, ids.parse_id_list(F.col("t"), 10))
    assert out == [[1, 2, 3], [], [], None, None, None, [4], [0], None, None, [9, 8]]
    assert column(["1 2 3"], ids.parse_id_list(F.col("t"), 10, max_ids=2)) == [None]


def test_shifted_arrays(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([5],), ([],)], "t array<int>")
    out = [r[0] for r in df.select(ids.next_token_arrays(F.col("t"))).collect()]
    assert [tuple(r) for r in out] == [([5, 6], [6, 7]), ([], []), ([], [])]


def test_column_functions_work_on_a_stream(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("  Hello\tWORLD ",)], "text string").write.parquet(str(source))
    stream = spark.readStream.schema("text string").parquet(str(source))
    query = (
        stream.select(text.normalize(F.col("text")).alias("text"))
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(sink))
    )
    query.awaitTermination(60)
    assert [r["text"] for r in spark.read.parquet(str(sink)).collect()] == ["hello world"]
