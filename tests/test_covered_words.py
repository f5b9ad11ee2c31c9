"""What a reference covers: its box and text are put together once for each row, not for each use."""

from pyspark.sql import functions as F

from cardloom.operators import spans

BOX = "box struct<left:double,top:double,width:double,height:double>"


def test_box_of_covered_words_is_found_once(spark, capsys):
    words = [("ab", 0, 2, (0.1, 0.2, 0.1, 0.1)), ("cd", 3, 2, (0.3, 0.1, 0.2, 0.1)), ("e", 6, 1, (0.6, 0.2, 0.1, 0.1))]
    lines = spark.createDataFrame([(1, 1, 0, "ab cd e", 0.9, 3, words), (1, 1, 1, "x", 0.9, None, None)], f"job_id long, page_number long, line_index long, text string, confidence double, n_words long, words array<struct<text:string,char_start:long,char_length:long,{BOX}>>")
    rows = [(1, 1, 0, 0, 0, 0, 5), (1, 1, 1, 0, 0, 1, 3), (1, 1, 2, 0, 9, 0, 5), (1, 1, 3, 0, 1, 0, 5), (1, 1, 4, 0, 0, None, 5)]
    refs = spark.createDataFrame(rows, "job_id long, page_number long, span_ord long, ref_ord long, line_index long, char_start long, char_length long")
    cover = spans.covers(refs, lines)
    got = {r.span_ord: (r.n_covered, r.text, tuple(r.box)) for r in cover.collect()}
    # "ab cd" from 0 on covers two words; from 1 on, "cd" begins at 3 and ends beyond; no such line, no words, no place: nothing
    assert got == {0: (2, "ab cd", (0.1, 0.1, 0.5 - 0.1, 0.2 + 0.1 - 0.1))}
    spans.span_boxes(cover).select("span_ord", F.col("box.left").alias("left"), F.col("box.width").alias("width")).explain()
    assert capsys.readouterr().out.count("array_min") <= 6
