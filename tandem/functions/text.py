"""Tokens, stop words, stemming and token overlap as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions.cells import as_column

# Fixed value: a token is a run of letters and digits.
TOKEN = r"([\p{L}\p{N}]+)"

# The public Snowball English stop-word list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()

ANALYZERS = ("simple", "english_unstemmed", "english")


def tokens(text: Column | str) -> Column:
    """Lower-cased tokens in text order."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(TOKEN), F.lit(1))


def is_stop_word(term: Column | str) -> Column:
    return as_column(term).isin(STOP_WORDS)


def distinct_tokens(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def token_jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all tokens of two arrays of distinct tokens; 0 when both are empty."""
    shared = F.size(F.array_intersect(as_column(a), as_column(b)))
    counts = F.array(F.struct(shared.alias("s"), (F.size(as_column(a)) + F.size(as_column(b))).alias("n")))
    return F.transform(counts, lambda c: F.when(c["n"] > 0, c["s"] / (c["n"] - c["s"])).otherwise(F.lit(0.0)))[0]


# --- English stemmer: the published Porter2 algorithm as one CASE per step ---------------
#
# Region R1 begins after the first vowel + non-vowel pair, R2 after the next such pair
# inside R1. "Suffix in R1" is therefore a plain pattern, so every step is a CASE over
# suffixes, evaluated once per distinct term.

# Fixed values of the algorithm: vowels, late-R1 prefixes, exception words, suffix tables.
_V = "[aeiouy]"
_C = "[^aeiouy]"
_LATE_R1 = "gener|commun|arsen"
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEEP_AFTER_PLURALS = (
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
)
_DOUBLED = "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)"
_DERIVED = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive",
    "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble",
}
_ADJECTIVAL = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ness": "", "ful": "",
}
_RESIDUAL = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
    "ive", "ize", "al", "er", "ic",
)

_TO_R1 = f"(?:(?:{_LATE_R1})|(?!{_LATE_R1}).*?{_V}{_C})"
_R1 = f"{_TO_R1}.*"
_R2 = f"{_TO_R1}.*?{_V}{_C}.*"
_SHORT_SYLLABLE = f"(?:.*{_C}{_V}[^aeiouywxY]|{_V}{_C})"


def _in(region: str, word: Column, suffix: str, replacement: str = "") -> Column:
    return F.regexp_replace(word, f"^({region}){suffix}$", f"$1{replacement}")


def _case(word: Column, rules: list[tuple[Column, Column]]) -> Column:
    """Result of the first rule that applies, else the word itself."""
    (test, result), *rest = rules
    chain = F.when(test, result)
    for test, result in rest:
        chain = chain.when(test, result)
    return chain.otherwise(word)


def _mark_consonant_y(w: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(w, "^y", "Y"), f"({_V})y", "$1Y")


def _plurals(w: Column) -> Column:
    return _case(w, [
        (w.endswith("sses"), F.regexp_replace(w, "es$", "")),
        (w.rlike("^..+ie[ds]$"), F.regexp_replace(w, "e[ds]$", "")),
        (w.rlike("ie[ds]$"), F.regexp_replace(w, "[ds]$", "")),
        (w.rlike("(?:us|ss)$"), w),
        (w.rlike(f"{_V}.+s$"), F.regexp_replace(w, "s$", "")),
    ])


def _participles(w: Column) -> Column:
    removable = f"^(.*{_V}.*)(?:ingly|edly|ing|ed)$"
    return _case(w, [
        (w.rlike("eed(?:ly)?$"), _in(_R1, w, "eed(?:ly)?", "ee")),
        # The trailing '+' marks a word that lost its ending here.
        (w.rlike(removable), F.regexp_replace(w, "(?:ingly|edly|ing|ed)$", "+")),
    ])


def _repair_participle(w: Column) -> Column:
    return _case(w, [
        (~w.endswith("+"), w),
        (w.rlike(r"(?:at|bl|iz)\+$"), F.regexp_replace(w, r"\+$", "e")),
        (w.rlike(_DOUBLED + r"\+$"), F.regexp_replace(w, r".\+$", "")),
        (w.rlike(rf"^{_SHORT_SYLLABLE}\+$") & ~w.rlike(rf"^{_TO_R1}.+\+$"),
         F.regexp_replace(w, r"\+$", "e")),
        (F.lit(True), F.regexp_replace(w, r"\+$", "")),
    ])


def _final_y(w: Column) -> Column:
    return F.regexp_replace(w, f"^(.+{_C})[yY]$", "$1i")


def _derived(w: Column) -> Column:
    rules = [(w.endswith(s), _in(_R1, w, s, r)) for s, r in _DERIVED.items()]
    rules.append((w.endswith("ogi"), _in(_R1 + "(?<=l)", w, "ogi", "og")))
    rules.append((w.endswith("li"), _in(_R1 + "(?<=[cdeghkmnrt])", w, "li")))
    return _case(w, rules)


def _adjectival(w: Column) -> Column:
    rules = [(w.endswith(s), _in(_R1, w, s, r)) for s, r in _ADJECTIVAL.items()]
    rules.append((w.endswith("ative"), _in(_R2, w, "ative")))
    return _case(w, rules)


def _residual(w: Column) -> Column:
    rules = [(w.endswith(s), _in(_R2, w, s)) for s in _RESIDUAL]
    rules.append((w.endswith("ion"), _in(_R2 + "(?<=[st])", w, "ion")))
    return _case(w, rules)


def _final_e_or_l(w: Column) -> Column:
    droppable_e = w.rlike(f"^{_R2}e$") | (w.rlike(f"^{_R1}e$") & ~w.rlike(f"^{_SHORT_SYLLABLE}e$"))
    return _case(w, [
        (droppable_e, F.regexp_replace(w, "e$", "")),
        (w.rlike(f"^{_R2}(?<=l)l$"), F.regexp_replace(w, "l$", "")),
    ])


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _after_plurals(w: Column) -> Column:
    stemmed = w
    for step in (_participles, _repair_participle, _final_y, _derived, _adjectival, _residual,
                 _final_e_or_l):
        stemmed = _bind(stemmed, step)
    return F.when(w.isin(*_KEEP_AFTER_PLURALS), w).otherwise(stemmed)


def english_stem(term: Column | str) -> Column:
    """Stem of a lower-case token."""
    w = as_column(term)
    stemmed = F.lower(_bind(_bind(_mark_consonant_y(w), _plurals), _after_plurals))
    exceptions = F.create_map(*[F.lit(x) for kv in _EXCEPTIONS.items() for x in kv])
    return F.when(F.length(w) <= 2, w).otherwise(
        F.coalesce(F.try_element_at(exceptions, w), stemmed)
    )
