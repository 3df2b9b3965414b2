"""Common table expressions of the text operators for DuckDB."""

from ..functions.forms import irregular_pairs
from ..functions.text import ABBREVIATIONS, IRREGULAR_NOUNS

TOKENS = r"""list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z''-]*'), lambda w: regexp_replace(regexp_replace(regexp_replace(lower(w), '^[''-]+', ''), '[''-]+$', ''), '''s$', '')), lambda w: w <> '')"""
SEG = """seg AS (SELECT doc_id, lang, (i + 1)::INT AS seg_idx, l[i + 1] AS body FROM (SELECT doc_id, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents) d, unnest(range(len(l))) AS t(i))"""
SQUEEZE = r"""trim(regexp_replace(regexp_replace({0}, '[>—-]+', ' ', 'g'), '\s+', ' ', 'g'))"""
_JOIN = r"""'(^|[ \x01])((?i:""" + ABBREVIATIONS + r""")\.|(?:[A-Z]\.)+) \x01', '\1\2 ', 'g')"""
SENT = (
    SEG
    + r""", cutm AS (SELECT doc_id, lang, seg_idx, list_transform(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace("""
    + SQUEEZE.format("body")
    + r""", '([.!?"] )', '\1' || chr(1), 'g'), """
    + f"{_JOIN}, {_JOIN}"
    + r""", chr(1)), lambda p: regexp_matches(p, '[A-Za-z]{2,}')), lambda p: trim(p)) AS l FROM seg),
sent AS (SELECT doc_id, lang, seg_idx, (i + 1)::INT AS sent_idx, l[i + 1] AS sent FROM cutm, unnest(range(len(l))) AS t(i))"""
)
TOK = SENT + ", tok AS (SELECT doc_id, lang, seg_idx, sent_idx, (i + 1)::INT AS tok_idx, l[i + 1] AS tok FROM (SELECT doc_id, lang, seg_idx, sent_idx, " + TOKENS.format("sent") + " AS l FROM sent) s, unnest(range(len(l))) AS t(i))"
LEX = "lex AS (SELECT word, length(word) % 5 = 0 AS pending FROM (SELECT DISTINCT unnest(" + TOKENS.format("text") + ") AS word FROM benchmark))"
_CUT = "left(tok, length(tok) - {0})"
_FORMS_HEAD = [("tok LIKE '%s'", _CUT.format(1)), ("tok LIKE '%es'", _CUT.format(2))]
_ED = [("tok LIKE '%ed'", _CUT.format(1)), ("tok LIKE '%ed'", _CUT.format(2)), ("tok LIKE '%ed'", _CUT.format(2) + " || 'e'")]
_ING = [("tok LIKE '%ing'", _CUT.format(3)), ("tok LIKE '%ing'", _CUT.format(3) + " || 'e'")]
_ALL = (
    _FORMS_HEAD
    + [("tok LIKE '%ies'", _CUT.format(3) + " || 'y'")]
    + _ED
    + [("tok LIKE '%d' AND tok NOT LIKE '%ed'", _CUT.format(1))]
    + _ING
    + [("tok LIKE '%ied'", _CUT.format(3) + " || 'y'"), ("tok LIKE '%ier'", _CUT.format(3) + " || 'y'")]
    + [("tok LIKE '%ed' AND length(tok) > 5 AND substr(tok, length(tok) - 2, 1) = substr(tok, length(tok) - 3, 1)", _CUT.format(3))]
    + [("tok LIKE '%er'", _CUT.format(1)), ("tok LIKE '%er'", _CUT.format(2)), ("tok LIKE '%est'", _CUT.format(3)), ("tok LIKE '%est'", _CUT.format(2))]
)
_IRR = "CASE tok " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in sorted(IRREGULAR_NOUNS.items())) + " END"
_BASES: dict = {}
for _form, _base in irregular_pairs():
    _BASES.setdefault(_form, []).append(_base)
_IRRV = "CASE tok " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in sorted(_BASES.items())) + " ELSE []::VARCHAR[] END"


def forms(pairs) -> str:
    return "list_filter([tok, " + ", ".join(f"CASE WHEN {c} THEN {f} END" for c, f in pairs) + "], lambda x: x IS NOT NULL)"


FORMS, FORMS_PENDING = forms(_ALL), forms(_FORMS_HEAD + _ED + _ING)
#: types -> res(tok, base); needs tok and lex
RES = f"""types AS (SELECT DISTINCT tok FROM tok),
form AS (SELECT tok, i AS p, l[i + 1] AS word FROM (SELECT tok, list_concat(list_filter([tok, {_IRR}], lambda x: x IS NOT NULL), {_IRRV}, {FORMS}) AS l FROM types) f, unnest(range(len(l))) AS t(i)),
res AS (SELECT t.tok, b.base FROM types t LEFT JOIN (SELECT tok, arg_min(word, p) AS base FROM form SEMI JOIN lex USING (word) GROUP BY tok) b USING (tok)),
pend AS (SELECT DISTINCT tok FROM (SELECT tok, unnest({FORMS_PENDING}) AS word FROM types) f WHERE word IN (SELECT word FROM lex WHERE pending))"""
WC = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
KEY = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9''\s]', ' ', 'g'), '\s+', ' ', 'g'))"
CONTENT = "list_distinct(list_filter(string_split(" + KEY + ", ' '), lambda w: length(w) > 2))"
