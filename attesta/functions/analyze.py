"""English text to index terms: folding to ASCII, a stop list, and Porter's stemmer as rule tables over column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Letters that do not decompose, and their ASCII forms.
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i", "ŋ": "n", "ŧ": "t", "ĸ": "k"}
# The English words that an index may leave out.
STOP = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters below the marks."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if c.lower() == c]
    pairs = [(c, b) for c, b in pairs if b != c and b.isascii() and b.isalpha()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def fold_ascii(c: Column | str) -> Column:
    """Lower-case letters without their marks: ``Straße, Élan`` gives ``strasse, elan``.  Combining marks of their own go."""
    c = F.translate(F.regexp_replace(F.lower(col(c)), r"[\x{300}-\x{36F}]", ""), *_accents())
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


# ---- Porter's stemmer ------------------------------------------------------------------------------------------------------
# A consonant is no vowel, and no y after a consonant; m counts the vowel-consonant sequences of a stem.

_C, _V = "[^aeiou]", "[aeiouy]"
_CS, _VS = _C + "[^aeiouy]*", _V + "[aeiou]*"
M_OVER_0 = f"^({_CS})?{_VS}{_CS}"
M_IS_1 = f"^({_CS})?{_VS}{_CS}({_VS})?$"
M_OVER_1 = f"^({_CS})?{_VS}{_CS}{_VS}{_CS}"
HAS_VOWEL = f"^({_CS})?{_V}"
ENDS_CVC = f"^{_CS}{_V}[^aeiouwxy]$"

# Suffixes of steps 2 and 3 and what they become where m > 0, and those of step 4, which go where m > 1.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _table(w: Column, rules: dict[str, str], needs: str, also: dict[str, str] | None = None) -> Column:
    """The longest suffix of ``rules`` decides: it is replaced where the stem before it matches ``needs``, and else the word stays."""
    out = w
    for suffix in sorted(rules, key=len):  # the last that is wrapped around is tested first
        stem = _cut(w, len(suffix))
        fits = stem.rlike(needs)
        if also and suffix in also:
            fits = fits & stem.rlike(also[suffix])
        out = F.when(w.endswith(suffix), F.when(fits, F.concat(stem, F.lit(rules[suffix]))).otherwise(w)).otherwise(out)
    return out


def _plural(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w)


def _mended(stem: Column) -> Column:
    """A stem that lost -ed or -ing: an e comes back, or a doubled consonant becomes one."""
    double = stem.rlike(r"([^aeiouylsz])\1$")
    return F.when(stem.rlike("(at|bl|iz)$") | stem.rlike(ENDS_CVC), F.concat(stem, F.lit("e"))).when(double, _cut(stem, 1)).otherwise(stem)


def _past(w: Column) -> Column:
    eed = F.when(_cut(w, 3).rlike(M_OVER_0), _cut(w, 1)).otherwise(w)
    lost = lambda n: F.when(_cut(w, n).rlike(HAS_VOWEL), _let(_cut(w, n), _mended)).otherwise(w)
    return F.when(w.endswith("eed"), eed).when(w.endswith("ed"), lost(2)).when(w.endswith("ing"), lost(3)).otherwise(w)


def _final_y(w: Column) -> Column:
    return F.when(w.endswith("y") & _cut(w, 1).rlike(HAS_VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _final_e(w: Column) -> Column:
    stem = _cut(w, 1)
    return F.when(w.endswith("e") & (stem.rlike(M_OVER_1) | (stem.rlike(M_IS_1) & ~stem.rlike(ENDS_CVC))), stem).otherwise(w)


def _final_ll(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(M_OVER_1), _cut(w, 1)).otherwise(w)


STEPS: tuple[Callable[[Column], Column], ...] = (
    _plural, _past, _final_y, lambda w: _table(w, STEP2, M_OVER_0), lambda w: _table(w, STEP3, M_OVER_0), lambda w: _table(w, dict.fromkeys(STEP4, ""), M_OVER_1, {"ion": "[st]$"}), _final_e, _final_ll,
)


def porter(word: Column | str) -> Column:
    """The stem of a lower-case word.  Words of fewer than three letters, or with anything but a to z, stay."""

    def stemmed(w: Column, steps=STEPS) -> Column:
        return _let(steps[0](w), lambda x: stemmed(x, steps[1:])) if steps else w

    c = col(word)
    return F.when((F.length(c) > 2) & c.rlike("^[a-z]+$"), _let(c, lambda w: stemmed(w))).otherwise(c)


@dataclass(frozen=True)
class Analyzer:
    """What a text's terms are.  ``plain`` terms are runs of a to z and 0 to 9 in the lower-cased text.

    fold: marks off letters first; stop: words left out, whose places stay counted; stem: Porter's stems of the rest.
    """

    fold: bool = False
    stop: tuple[str, ...] = ()
    stem: bool = False

    def words(self, text: Column | str) -> Column:
        """All words in order, before the stop list and stems, so that a word's index is its place."""
        c = F.coalesce(col(text), F.lit(""))
        return F.regexp_extract_all(fold_ascii(c) if self.fold else F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))

    def kept(self, word: Column) -> Column:
        return ~word.isin(*self.stop) if self.stop else F.lit(True)

    def term(self, word: Column) -> Column:
        """A kept word's term: computed once for each distinct word of a document."""
        return porter(word) if self.stem else word


PLAIN = Analyzer()
ENGLISH = Analyzer(fold=True, stop=STOP, stem=True)
