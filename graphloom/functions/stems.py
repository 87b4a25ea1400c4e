"""English stems by Porter's rules (1980, with the later endings -bli and -logi), as one expression that the JVM evaluates.

The rules are written once as SQL; ``stem_sql`` gives them in Spark's words or in another dialect's.  As in common full-text
tokenizers, terms of fewer than 3 or more than 63 characters stay as they are, and letters beyond a-z count as consonants.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: How many times a vowel group is followed by a consonant group: at least once, at least twice, once; and whether there is a vowel.
_ONCE, _TWICE, _JUST_ONCE, _VOWEL = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?[aeiouy]"
#: Ends in consonant, vowel, consonant (not w, x, y), all there is but consonants ahead.
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
_DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)$"

#: The endings of the rules' second, third and fourth step and what they become.
SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


class _Dialect:
    def __init__(self, spark: bool):
        self.spark, self.depth = spark, 0

    def bound(self, value: str, body) -> str:
        """``body`` of a name that stands for ``value``, which is evaluated once."""
        self.depth += 1
        name = f"x{self.depth}"
        inner = body(name)
        return f"element_at(transform(array({value}), {name} -> {inner}), 1)" if self.spark else f"list_transform([{value}], lambda {name}: {inner})[1]"

    def like(self, value: str, pattern: str) -> str:
        return f"{'rlike' if self.spark else 'regexp_matches'}({value}, '{pattern}')"

    def ending(self, value: str, endings) -> str:
        return f"regexp_extract({value}, '({'|'.join(endings)})$', 1)"


def _cut(t: str, n: int | str) -> str:
    return f"substr({t}, 1, length({t}) - {n if isinstance(n, int) else f'length({n})'})"


def _cases(*cases: tuple[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {then}" for test, then in cases) + f" ELSE {other} END"


def stem_sql(term: str, spark: bool = True) -> str:
    """The stem of an expression of lower-case words."""
    d = _Dialect(spark)

    def plural(t: str) -> str:
        return _cases((f"{t} LIKE '%sses'", _cut(t, 2)), (f"{t} LIKE '%ies'", _cut(t, 2)), (f"{t} LIKE '%ss'", t), (f"{t} LIKE '%s'", _cut(t, 1)), other=t)

    def mended(t: str) -> str:
        """What -ed and -ing leave."""
        return _cases((d.like(t, "(at|bl|iz)$"), f"{t} || 'e'"), (d.like(t, _DOUBLE), _cut(t, 1)), (f"{d.like(t, _JUST_ONCE)} AND {d.like(t, _SHORT)}", f"{t} || 'e'"), other=t)

    def past(t: str) -> str:
        gone = lambda n: _cases((d.like(_cut(t, n), _VOWEL), d.bound(_cut(t, n), mended)), other=t)
        return _cases((f"{t} LIKE '%eed'", _cases((d.like(_cut(t, 3), _ONCE), _cut(t, 1)), other=t)), (f"{t} LIKE '%ed'", gone(2)), (f"{t} LIKE '%ing'", gone(3)), other=t)

    def final_y(t: str) -> str:
        return _cases((f"{t} LIKE '%y' AND {d.like(_cut(t, 1), _VOWEL)}", f"{_cut(t, 1)} || 'i'"), other=t)

    def replaced(rules: dict[str, str]):
        def step(t: str) -> str:
            def by(e: str) -> str:
                new = _cases(*((f"{e} = '{k}'", f"'{v}'") for k, v in rules.items()), other="''")
                return _cases((f"{e} <> '' AND {d.like(_cut(t, e), _ONCE)}", f"{_cut(t, e)} || {new}"), other=t)

            return d.bound(d.ending(t, rules), by)

        return step

    def removed(t: str) -> str:
        def by(e: str) -> str:
            return _cases((f"{e} = '' OR NOT {d.like(_cut(t, e), _TWICE)} OR ({e} = 'ion' AND NOT {d.like(_cut(t, e), '[st]$')})", t), other=_cut(t, e))

        return d.bound(d.ending(t, FOURTH), by)

    def final_e(t: str) -> str:
        own = _cut(t, 1)
        return _cases((f"{t} LIKE '%e' AND ({d.like(own, _TWICE)} OR ({d.like(own, _JUST_ONCE)} AND NOT {d.like(own, _SHORT)}))", own), other=t)

    def final_l(t: str) -> str:
        return _cases((f"{t} LIKE '%ll' AND {d.like(t, _TWICE)}", _cut(t, 1)), other=t)

    def all_steps(t: str) -> str:
        out = f"CASE WHEN {t} LIKE 'y%' THEN 'Y' || substr({t}, 2) ELSE {t} END"  # at the beginning it is a consonant
        for step in (plural, past, final_y, replaced(SECOND), replaced(THIRD), removed, final_e, final_l):
            out = d.bound(out, step)
        return _cases((f"length({t}) < 3 OR length({t}) > 63 OR NOT {d.like(t, '[a-z]$')}", t), other=f"lower({out})")

    return d.bound(term, all_steps)


def stem(column: str) -> Column:
    """The stems of a column of lower-case words."""
    return F.expr(stem_sql(f"`{column}`"))


def _marked() -> tuple[str, str]:
    """Latin letters with marks, and the plain letters below them, by their canonical decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in r]
    kept = [(c, p) for c, p in pairs if c != p and p.isascii() and p.isalpha()]
    return "".join(c for c, _ in kept), "".join(p for _, p in kept)


def without_marks(text: Column) -> Column:
    """Latin letters without accents, cedillas and the like."""
    return F.translate(text, *_marked())
