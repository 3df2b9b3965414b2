"""Cells of an experiment: the ledger that runs along the segments, and what has no denominator."""

from textflow.operators import experiment as E

SEGMENTS = "cell long, ord long, source string, first string, final string"


def measured(spark, rows):
    lexicon = spark.createDataFrame([(w, False) for w in "the by it is old stood".split()], "word string, pending boolean")
    out = E.cell_metrics(spark.createDataFrame(rows, SEGMENTS), lexicon)
    return {r.cell: (r.segments, r.final_segments, r.first_missing, r.gen_coverage, r.final_coverage, round(r.gain, 6), r.duplicate_rate) for r in out.collect()}


def test_words_annotated_earlier_are_settled(spark):
    got = measured(spark, [
        (1, 1, "The mill stood by.", "The mill stood.", "The mill（磨） stood."),
        (1, 2, "The mills stood by barns.", "The mills stood by barns.", "The mill stood by barn（仓） barn（仓）."),  # mill is settled; barns is noted by its form
        (1, 3, "A tarn.", "A tarn（湖）.", None),  # no final text: in no sum
    ])
    assert got == {1: (3, 2, 0, 0.0, 1.0, 100.0, 1 / 3)}


def test_an_earlier_cell_or_a_later_segment_settles_nothing(spark):
    got = measured(spark, [(1, 1, "mill", "mill", "mill（磨）"), (2, 1, "mill", "mill", "mill"), (2, 2, "mill", None, "mill（磨）")])
    assert got == {1: (1, 1, 0, 0.0, 1.0, 100.0, 0.0), 2: (2, 2, 1, 0.5, 0.5, 0.0, 0.0)}


def test_nothing_to_annotate(spark):
    assert measured(spark, [(1, 1, "the old", "it is", "it is"), (2, 1, None, None, None), (3, 1, None, "it", "it")]) == {1: (1, 1, 0, 1.0, 1.0, 0.0, 0.0), 2: (1, 0, 0, 1.0, 1.0, 0.0, 0.0), 3: (1, 1, 0, 1.0, 1.0, 0.0, 0.0)}
    assert measured(spark, []) == {}
