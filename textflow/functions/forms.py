"""Families of English word forms: irregular verbs by class, comparatives, and suffix profiles.

An irregular form belongs to a base, and a base to all its forms: families are classes of that
relation, so a lookup goes both ways. The table is fixed and small (a few hundred forms).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: verbs by the way they form the past and the participle: (verbs, past, participle) as rules of (pattern, replacement)
_SAME = (r"$", "")
_CLASSES: tuple[tuple[str, tuple[str, str], tuple[str, str]], ...] = (
    ("burst cast cost cut hit hurt let put set shut split spread thrust", _SAME, _SAME),
    ("begin drink ring shrink sing sink spring stink swim", ("i(?=[a-z]*$)(?!.*i)", "a"), ("i(?=[a-z]*$)(?!.*i)", "u")),
    ("cling dig fling sling spin stick sting string swing wring", ("i", "u"), ("i", "u")),
    ("blow grow know throw", ("ow$", "ew"), ("$", "n")),
    ("creep keep sleep sweep weep", ("eep$", "ept"), ("eep$", "ept")),
    ("bend build lend send spend", ("d$", "t"), ("d$", "t")),
    ("burn deal dream lean leap learn mean", ("$", "t"), ("$", "t")),
    ("smell spell spill", ("l$", "t"), ("l$", "t")),
    ("feel kneel", ("el$", "lt"), ("el$", "lt")),
    ("bleed breed feed lead meet speed", ("(?<=e)[ea](?=[dt]$)", ""), ("(?<=e)[ea](?=[dt]$)", "")),
    ("arise drive rise strive", ("i(?=[a-z]e$)", "o"), ("$", "n")),
    ("ride stride write", ("i(?=[a-z]e$)", "o"), ("([dt])e$", r"\1\1en")),
    ("break speak steal", ("ea([kl])$", r"o\1e"), ("ea([kl])$", r"o\1en")),
    ("bear swear tear wear", ("ear$", "ore"), ("ear$", "orn")),
    ("bind find grind wind", ("ind$", "ound"), ("ind$", "ound")),
    ("sell tell", ("ell$", "old"), ("ell$", "old")),
    ("say pay lay", ("y$", "id"), ("y$", "id")),
    ("stand understand", ("and$", "ood"), ("and$", "ood")),
    ("forsake mistake shake take", ("ake$", "ook"), ("$", "n")),
    ("bite hide", ("e$", ""), ("([dt])e$", r"\1\1en")),
    ("slide", ("e$", ""), ("e$", "")),
)
#: verbs of no class: base, past, participle
_SINGLE = """be was been, become became become, bring brought brought, buy bought bought, catch caught caught, choose chose chosen,
come came come, do did done, draw drew drawn, eat ate eaten, fall fell fallen, flee fled fled, fight fought fought, fly flew flown, forget forgot forgotten, freeze froze frozen,
get got got, give gave given, go went gone, hang hung hung, have had had, hear heard heard, hold held held, leave left left, lie lay lain, light lit lit,
lose lost lost, make made made, run ran run, see saw seen, seek sought sought, shine shone shone, shoot shot shot, show showed shown, sit sat sat,
strike struck struck, teach taught taught, think thought thought, wake woke woken, weave wove woven, win won won,
beat beat beaten"""
#: adjectives and adverbs: base, comparative, superlative
_COMPARED = "good better best, bad worse worst, far farther farthest, little less least, much more most, many more most, old older oldest, well better best"
_ALSO_OF_BE = "am are is were"
#: participles that take no object and so make no passive
INTRANSITIVE = ("arisen", "become", "been", "come", "fallen", "gone", "lain", "risen", "sat", "slept", "stood", "striven", "swum", "wept")


def _verbs() -> dict[str, tuple[str, str]]:
    out = {}
    for verbs, past, participle in _CLASSES:
        for verb in verbs.split():
            out[verb] = (re.sub(*past, verb, count=1), re.sub(*participle, verb, count=1))
    for row in _SINGLE.split(","):
        verb, past, participle = row.split()
        out[verb] = (past, participle)
    return out


VERBS = _verbs()
PARTICIPLES = tuple(sorted({p for _, p in VERBS.values()} | {"borne"}))


def irregular_pairs() -> tuple[tuple[str, str], ...]:
    """(form, base) of irregular verbs and comparatives; a form may have two bases (``more``, ``lay``)."""
    pairs = {(form, verb) for verb, forms in VERBS.items() for form in forms if form != verb}
    pairs |= {(w, "be") for w in _ALSO_OF_BE.split()}
    for row in _COMPARED.split(","):
        base, *forms = row.split()
        pairs |= {(form, base) for form in forms}
    return tuple(sorted(pairs))


def irregular_bases(word: Column) -> Column:
    """The bases of an irregular form (none for other words), by name."""
    by: dict[str, list[str]] = {}
    for form, base in irregular_pairs():
        by.setdefault(form, []).append(base)
    table = F.from_json(F.lit(json.dumps(by)), "map<string, array<string>>")  # one literal in the plan
    return F.when(word.isin(*by), table[word]).otherwise(F.array().cast("array<string>"))


def families(spark: SparkSession) -> DataFrame:
    """word, relative: all irregular forms of a base and the base, each with every other; a fixed table of a few hundred rows."""
    by: dict[str, set[str]] = {}
    for form, base in irregular_pairs():
        by.setdefault(base, {base}).add(form)
    rows = sorted({(a, b) for family in by.values() for a in family for b in family if a != b})
    return spark.createDataFrame(rows, "word string, relative string")


def _cut(w: Column, k: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - k)


#: profile -> rules (ending, letters to cut, what is put on, shortest word): the forms a word may come from
PROFILES: dict[str, tuple[tuple[str, int, str, int], ...]] = {
    "acceptance": (
        ("ies$", 3, "y", 5), ("es$", 2, "", 4), ("s$", 1, "", 4), ("ing$", 3, "e", 5), ("ing$", 4, "", 5), ("ing$", 3, "", 5), ("ied$", 3, "y", 1),
        ("ed$", 2, "e", 4), ("ed$", 3, "", 4), ("ed$", 2, "", 4), ("est$", 3, "", 5), ("est$", 4, "", 5), ("ier$", 3, "y", 4), ("(?<!i)er$", 2, "", 4), ("er$", 3, "", 4), ("er$", 2, "e", 4),
    ),
    "grade": (("ies$", 3, "y", 1), ("es$", 2, "", 1), ("s$", 1, "", 1), ("ed$", 2, "", 1), ("ed$", 2, "e", 1), ("ed$", 1, "", 1), ("ing$", 3, "", 1), ("ing$", 3, "e", 1), ("er$", 1, "", 1), ("er$", 2, "", 1)),
    "adapt": (
        ("ies$", 3, "y", 1), ("(?:ch|sh|ss|x|z)es$", 2, "", 1), ("[^s]s$", 1, "", 1), ("ed$", 2, "", 1), ("ed$", 1, "", 1), ("ed$", 2, "e", 1), ("ing$", 3, "", 1), ("ing$", 3, "e", 1), ("ing$", 4, "", 1),
        ("ied$", 3, "y", 1), (r"(.)\1ing$", 4, "", 1), (r"(.)\1ed$", 3, "", 1), (r"(.)\1ing$", 4, "e", 1), (r"(.)\1ed$", 3, "e", 1), ("er$", 2, "", 1), ("er$", 1, "", 1), ("ier$", 3, "y", 1), ("iest$", 4, "y", 1),
    ),
}


def profile(word: Column, name: str) -> Column:
    """The word and the forms it may come from by a profile's rules, in their order, each once; the adapt profile puts irregular bases second."""
    found = [F.when(word.rlike(end) & (F.length(word) >= least), F.concat(_cut(word, cut), F.lit(add))) for end, cut, add, least in PROFILES[name]]
    forms = F.concat(F.array(word), irregular_bases(word), F.array(*found)) if name == "adapt" else F.array(word, *found)
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull()))


def injected(word: Column) -> Column:
    """The forms by which a learned word counts as used: -s, -es, -ed, -ing, also without a last e or with the last letter doubled."""
    last = F.right(word, F.lit(1))
    bare = F.regexp_replace(word, "(?<=[^aeiou])e$", "")
    return F.array(word, *(F.concat(word, F.lit(s)) for s in ("s", "es", "ed", "ing")), F.concat(bare, F.lit("ing")), F.concat(word, last, F.lit("ing")), F.concat(word, last, F.lit("ed")))


DIGITS = "零一二三四五六七八九"
UNITS = {"十": 10, "百": 100, "千": 1000}


def chinese_number(text: Column) -> Column:
    """The number (1 to 9,999) that Chinese numerals write; null for anything that is not written as ``chinese_name`` writes it (两 for 二 is)."""
    chars = F.split(F.translate(text, "两", "二"), "(?<=.)(?=.)")
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("digit"))

    def step(s: Column, c: Column) -> Column:
        unit = F.when(c == "十", 10).when(c == "百", 100).when(c == "千", 1000).otherwise(0)
        digit = F.position(c, F.lit(DIGITS)) - 1
        return F.struct(
            F.when(unit > 0, s["sum"] + unit * F.when(s["digit"] == 0, 1).otherwise(s["digit"])).otherwise(s["sum"]).alias("sum"),
            F.when(unit > 0, 0).otherwise(digit).alias("digit"),
        )

    value = F.aggregate(chars, start, step, lambda s: s["sum"] + s["digit"])
    plain = text.rlike("^[一二两三四五六七八九十百千零]{1,8}$")
    read = F.element_at(F.transform(F.array(value), lambda v: F.when(chinese_name(v) == F.translate(text, "两", "二"), v)), 1)
    return F.when(plain, read)


def chinese_name(n: Column) -> Column:
    """Numerals of 1 to 9,999: 十 for 10, 二十一, 一百零三, 一千零一十; null beyond."""
    n = n.cast("int")
    digit = lambda unit: F.floor(n / unit).cast("int") % 10
    name = lambda d: F.substring(F.lit(DIGITS), d + 1, F.lit(1))
    parts = []
    for sign, unit in sorted(UNITS.items(), key=lambda x: -x[1]):
        parts.append(F.when(digit(unit) > 0, F.concat(name(digit(unit)), F.lit(sign))).when(n > unit * 10, F.lit("零")).otherwise(F.lit("")))
    parts.append(F.when(digit(1) > 0, name(digit(1))).otherwise(F.lit("")))
    whole = F.regexp_replace(F.regexp_replace(F.concat(*parts), "零+", "零"), "零$", "")
    return F.when(n.between(1, 9999), F.regexp_replace(whole, "^一十", "十"))


def chapter_number(name: Column) -> Column:
    """The number of ``第三章`` or ``第12章``; null for other names."""
    raw = F.regexp_extract(F.trim(name), "^第([0-9]+|[一二两三四五六七八九十百千零]+)章$", 1)
    return F.when(raw.rlike("^[0-9]{1,9}$"), raw.try_cast("int")).otherwise(chinese_number(raw))
