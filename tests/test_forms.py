"""Verb classes, form profiles, numerals, constructions of English sentences, and the SQL table function."""

import pytest
from pyspark.sql import functions as F

from textflow.functions import forms as M
from textflow.functions import sql
from textflow.functions import text as T
from textflow.operators import lexicon as L


def test_classes_give_the_usual_forms():
    for row in "begin began begun, know knew known, keep kept kept, lend lent lent, spell spelt spelt, kneel knelt knelt, feed fed fed, lead led led, meet met met, rise rose risen, ride rode ridden, write wrote written, speak spoke spoken, tear tore torn, grind ground ground, tell told told, lay laid laid, understand understood understood, take took taken, hide hid hidden, slide slid slid, flee fled fled, string strung strung, spring sprang sprung, deal dealt dealt".split(", "):
        verb, *forms = row.split()
        assert M.VERBS[verb] == tuple(forms), verb


# participles of the traps, and words that only look like some
PARTICIPLES = "drawn torn frozen blown flown hidden ridden drunk struck stuck lit spun born begun left run understood driven made given beaten broken taken chosen seen heard told taught caught fed sent set put cut hit built sung known grown thrown shown shaken worn won bitten spoken laid lent swept".split()
OTHERS = "down brown crown renown token kitten oven garden golden open seven red mixed exhausted interested naked need".split()


@pytest.fixture(scope="module")
def counted(spark):
    def run(*texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.syntax(T.strip_quotes(F.col("t"))).alias("c")).orderBy("i").collect()
        return [(r.c.passive, r.c.relcl, r.c.pastperf) for r in rows]

    return run


def test_participles(counted):
    assert [c[0] for c in counted(*(f"The thing was {w} here." for w in PARTICIPLES))] == [1] * len(PARTICIPLES)
    assert [c[0] for c in counted(*(f"It was {w} here." for w in OTHERS))] == [0] * len(OTHERS)
    assert [c[2] for c in counted(*(f"He had {w} it." for w in [*PARTICIPLES, "been", "gone", "risen", "fallen", "become"]))] == [1] * (len(PARTICIPLES) + 5)
    assert [c[2] for c in counted(*(f"He had {w} paint." for w in OTHERS))] == [0] * len(OTHERS)


@pytest.mark.parametrize(
    ("text", "passive", "relcl", "pastperf"),
    [
        ("Never had we met so old a man.", 0, 0, 1),
        ("Scarcely had the boat left when it rained.", 0, 0, 1),
        ("No sooner had they eaten than it rained.", 0, 0, 1),
        ("We had met the miller before.", 0, 0, 1),
        ("She had already not finished.", 0, 0, 1),
        ("We left that evening.", 0, 0, 0),
        ("They began that morning with that thing.", 0, 0, 0),
        ("She hoped that they were well and that it rains.", 0, 0, 0),
        ('A man said, "The gate was opened by a boy."', 0, 0, 0),
        ("The gate was soon opened.", 1, 0, 0),
        ("The gate has been opened.", 1, 0, 0),
        ("The gate had been opened.", 1, 0, 1),
        ("The cart, pulled by a mule, stood still.", 1, 0, 0),
        ("The mule that pulled the cart was old.", 0, 1, 0),
        ("The aunt who sang and the dog, which ran, slept.", 0, 2, 0),
        ("The man had gone.", 0, 0, 1),
        ("The geese were driven home.", 1, 0, 0),
        ("", 0, 0, 0),
    ],
)
def test_traps(counted, text, passive, relcl, pastperf):
    assert counted(text) == [(passive, relcl, pastperf)]


def test_irregular_forms_are_resolved(spark):
    lexicon = spark.createDataFrame([(w,) for w in ("go", "bad", "goose", "carry", "stop", "be", "good", "well")], "word string")
    types = spark.createDataFrame([(w,) for w in ("went", "gone", "worse", "geese", "carried", "stopped", "were", "better", "xyz")], "tok string")
    got = {r.tok: r.base for r in L.resolve(types, lexicon).collect()}
    assert got == {"went": "go", "gone": "go", "worse": "bad", "geese": "goose", "carried": "carry", "stopped": "stop", "were": "be", "better": "good", "xyz": None}


def test_families_are_classes(spark):
    pairs = {tuple(r) for r in M.families(spark).collect()}
    assert {("went", "gone"), ("gone", "went"), ("go", "went"), ("worst", "worse"), ("was", "been")} <= pairs
    assert pairs == {(b, a) for a, b in pairs}


@pytest.mark.parametrize(
    ("word", "profile", "has", "lacks"),
    [
        ("horses", "adapt", {"horse"}, {"hors"}),
        ("boxes", "adapt", {"box"}, set()),
        ("running", "adapt", {"run"}, set()),
        ("chose", "adapt", {"choose"}, set()),
        ("happiest", "adapt", {"happy"}, set()),
        ("forest", "adapt", {"forest"}, {"for"}),
        ("stopped", "acceptance", {"stop"}, set()),
        ("happier", "acceptance", {"happy"}, set()),
        ("ties", "acceptance", {"ti", "tie"}, {"ty"}),
        ("running", "grade", {"runn"}, {"run"}),
        ("nicer", "grade", {"nice", "nic"}, set()),
    ],
)
def test_profiles(spark, word, profile, has, lacks):
    got = spark.createDataFrame([(word,)], "w string").select(M.profile(F.col("w"), profile)).first()[0]
    assert got[0] == word and has <= set(got) and not lacks & set(got) and len(got) == len(set(got))


def test_numerals_both_ways(spark):
    rows = spark.range(1, 10_000).select("id", M.chinese_name(F.col("id")).alias("n"))
    rows = rows.select("id", "n", M.chinese_number(F.col("n")).alias("back"), M.chapter_number(F.concat(F.lit("第"), "n", F.lit("章"))).alias("chapter"))
    got = {r.id: (r.n, r.back, r.chapter) for r in rows.collect()}
    assert all(b == c == i for i, (_, b, c) in got.items()) and len({n for n, _, _ in got.values()}) == 9_999
    for i, n in {10: "十", 12: "十二", 20: "二十", 99: "九十九", 101: "一百零一", 110: "一百一十", 1010: "一千零一十", 2005: "二千零五"}.items():
        assert got[i][0] == n
    names = {"第12章": 12, " 第两百章 ": 200, "第十十章": None, "第二十十章": None, "第一幕": None, "第章": None, "": None, "第零章": None, "一": None}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", M.chapter_number(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in rows} == names
    assert spark.range(2).select(M.chinese_name(F.col("id") * 10_000)).first()[0] is None


def test_table_function_in_sql(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "Mr. Low came. He sat."), (2, None), (3, "12")], "a int, t string").createOrReplaceTempView("forms_texts")
    got = spark.sql("SELECT a, s.* FROM forms_texts, LATERAL text_sentences(t) s").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "Mr. Low came."), (1, 2, "He sat.")]
