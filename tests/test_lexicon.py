"""Lexicon forms, by the rules and by the rules turned round."""

def test_known_forms_are_those_that_resolve(spark):
    """The rules turned round give each type that has a base its base, and no other."""
    from textflow.operators import lexicon as L

    words = ["be", "go", "stop", "make", "carry", "fast", "man", "wolf", "see", "bee", "a", "s", "lay", "lie", "more", "good", "x", "e", "ed", "ing", "hope", "hop", "str", "es", "di", "free", "b", "leaf", "be's"]
    lex = spark.createDataFrame([(w, len(w) % 2 == 0) for w in words], "word string, pending boolean")
    ends = ["", "s", "es", "ies", "d", "ed", "ied", "ing", "er", "ier", "est", "iest", "ped", "pped", "r", "st", "t"]
    stems = sorted({w[: len(w) - k] for w in words for k in range(3)} - {""})
    irregular = "was were been went gone men wolves leaves better best lain laid lay saw seen made".split()
    types = spark.createDataFrame([(t,) for t in sorted({s + e for s in stems for e in ends} | set(irregular))], "tok string")
    want = {tuple(r) for r in L.resolve(types, lex).where("base IS NOT NULL").collect()}
    assert {tuple(r) for r in L.known_forms(lex).join(types, "tok", "left_semi").collect()} == want and len(want) > 60
    assert {r.tok for r in L.pending_forms(lex).join(types, "tok", "left_semi").collect()} == {r.tok for r in L.pending_types(types, lex).collect()}
