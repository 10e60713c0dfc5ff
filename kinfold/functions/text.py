"""Text functions, Column to Column, evaluated in the JVM. The empty string stands for a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import ADDRESS_FORMS, ADDRESS_STOP_WORDS, INDIC_ZEROS, LANDMARK_WORDS, LEGAL_FORMS, STOP_WORDS, sounds

SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"
WORD = r"\p{L}\p{N}_"
BEFORE, AFTER = rf"(?<![{WORD}])", rf"(?![{WORD}])"


def _icu(call: str, text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(call), text, F.lit(True))


def is_non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def raw(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")


def base(text: Column) -> Column:
    """NFKC, lower case, white space collapsed; ASCII needs no normalisation."""
    text = F.coalesce(text, F.lit(""))
    return collapse(F.lower(F.when(is_non_ascii(text), _icu("compose", text)).otherwise(text)))


def ascii_digits(text: Column) -> Column:
    digits = "".join(chr(z + i) for z in INDIC_ZEROS for i in range(10))
    return F.translate(text, digits, "0123456789" * len(INDIC_ZEROS))


def level2(text: Column) -> Column:
    """Base without punctuation."""
    return collapse(F.regexp_replace(base(text), rf"[^{WORD}\s]", " "))


def clean(text: Column) -> Column:
    """Base with ASCII digits, & spelt out and no punctuation."""
    spelt = F.replace(ascii_digits(base(text)), F.lit("&"), F.lit(" and "))
    return collapse(F.regexp_replace(spelt, rf"[^{WORD}\s]", " "))


def _forms(text: Column, table) -> Column:
    for pattern, word in table:
        text = F.regexp_replace(text, f"(?i){BEFORE}(?:{pattern}){AFTER}", word)
    return text


def legal_from_clean(text: Column) -> Column:
    return _forms(text, LEGAL_FORMS)


def legal(text: Column) -> Column:
    """Clean, with the words of legal forms spelt out."""
    return legal_from_clean(clean(text))


def address(text: Column, canonical: bool = False) -> Column:
    return _forms(clean(text), ADDRESS_FORMS) if canonical else clean(text)


def transliterate(text: Column) -> Column:
    """Letters of seven scripts by their sound, other letters without their accents; ASCII comes back as it is."""
    table = F.create_map(*[F.lit(x) for pair in sounds().items() for x in pair])

    def latin(c: Column) -> Column:
        plain = F.regexp_replace(_icu("decompose", c), r"\p{M}", "")
        return F.coalesce(F.element_at(table, c), F.when(plain == "", c).otherwise(plain))

    spelt = F.array_join(F.transform(F.split(text, ""), latin), "")
    # Without a letter of the seven scripts the whole text goes at once; a mark that stands for itself is a gap either way.
    plain = F.regexp_replace(_icu("decompose", F.regexp_replace(text, r"\p{M}", " ")), r"\p{M}", "")
    spelt = F.when(text.rlike(f"[{chr(0x900)}-{chr(0xD7F)}]"), spelt).otherwise(plain)
    return F.when(~is_non_ascii(text), text).otherwise(F.lower(collapse(F.regexp_replace(spelt, r"[^a-zA-Z0-9\s]", " "))))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"(.)\1+", "$1")


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _not_in(w: Column, stop: list[str]) -> Column:
    return ~w.isin(*stop)


def name_words(text: Column) -> Column:
    return F.filter(words(text), lambda w: _not_in(w, STOP_WORDS))


def name_tokens(text: Column) -> Column:
    return F.filter(words(text), lambda w: (F.length(w) >= 3) & _not_in(w, STOP_WORDS))


def is_digits(w: Column) -> Column:
    return w.rlike(r"^\p{Nd}+$")


def address_words(text: Column, least: int = 1) -> Column:
    """Words without digits-only ones and without the stop words of names."""
    return F.filter(words(text), lambda w: (F.length(w) >= least) & ~is_digits(w) & _not_in(w, STOP_WORDS))


def address_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) >= 3) & ~is_digits(w) & _not_in(w, ADDRESS_STOP_WORDS)))


def acronym(found: Column) -> Column:
    return F.array_join(F.transform(F.filter(found, lambda w: F.substring(w, 1, 1).rlike(r"^[\p{L}\p{N}]")), lambda w: F.lower(F.substring(w, 1, 1))), "")


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngrams(text: Column, n: int = 3) -> Column:
    """Grams of the text between spaces, repeats kept; none of an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(_grams(F.concat(F.lit(" "), text, F.lit(" ")), n))


def ngrams_caret(text: Column, n: int = 3) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(_grams(F.concat(F.lit("^"), F.replace(text, F.lit(" "), F.lit("_")), F.lit("$")), n))


def ngrams_bare(text: Column, n: int = 3) -> Column:
    """Distinct grams without padding; a shorter text is its own gram."""
    return F.array_distinct(F.when((F.length(text) < n) & (text != ""), F.array(text)).otherwise(_grams(text, n)))


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"{BEFORE}(\p{{Nd}}+){AFTER}"), 1)


def postals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"{BEFORE}(\p{{Nd}}{{5,6}}){AFTER}"), 1)


def landmarks(text: Column) -> Column:
    announce = "|".join([*LANDMARK_WORDS, r"next\s+to", r"opp\."])
    return F.regexp_extract_all(text, F.lit(rf"(?i){BEFORE}(?:{announce})\s+([a-zA-Z0-9]+)"), 1)


def prefix_length(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    limit = F.least(F.length(a), F.length(b))
    return F.aggregate(F.sequence(F.lit(0), limit), F.lit(0), lambda best, i: F.when(F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i), i).otherwise(best))


def char_class(c: Column) -> Column:
    return (
        F.when(~is_non_ascii(c), "ascii").when(c.rlike(r"^[ऀ-ॿ]"), "devanagari").when(c.rlike(r"^[À-ɏ]"), "latin_accented").otherwise("other")
    )


def scripts(text: Column) -> Column:
    """Sorted names of the scripts of a text's letters."""
    names = {"LATIN": r"\p{IsLatin}", "DEVANAGARI": r"\p{IsDevanagari}", "BENGALI": r"\p{IsBengali}", "GUJARATI": r"\p{IsGujarati}", "TAMIL": r"\p{IsTamil}", "TELUGU": r"\p{IsTelugu}",
             "KANNADA": r"\p{IsKannada}", "MALAYALAM": r"\p{IsMalayalam}", "GURMUKHI": r"\p{IsGurmukhi}", "ORIYA": r"\p{IsOriya}", "ARABIC": r"\p{IsArabic}", "CYRILLIC": r"\p{IsCyrillic}",
             "GREEK": r"\p{IsGreek}", "CJK": r"\p{IsHan}"}
    return F.array_sort(F.filter(F.array(*[F.when(text.rlike(rf"[{p}&&\p{{L}}]"), F.lit(n)) for n, p in names.items()]), lambda x: x.isNotNull()))


def cardinality(n: Column) -> Column:
    return F.when(n == 0, "singleton").when(n == 1, "1").when(n == 2, "2").when(n <= 4, "3-4").otherwise("5+")


def entity_text(name: Column, addr: Column, country: Column) -> Column:
    return F.concat_ws(" | ", legal(name), clean(addr), country)
