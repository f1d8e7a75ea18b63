"""Text functions as column expressions: normalisation, placeholders, tokens, sentences."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from string import ascii_letters

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms and what they fold to (blank, then 0x21 to 0x7E).
_WIDE = "　＀" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_NARROW = "  " + "".join(chr(c) for c in range(0x21, 0x7F))
#: Numerals that become a number placeholder.
NUMERALS = "〇一二兩三四五六七八九十百千萬億兆"
#: Punctuation before a Latin word that belongs to its placeholder.
_LATIN_JOINERS = r"\-/.~=*&_", "—’─﹒"
NUMBER, LATIN = "{{CD}}", "{{FW}}"
# Listed letters are one look at a bit set in Java, ranges and other characters one comparison each; so most text is passed over by
# one or two. A run of joiners is tried from its first only: a long one costs no square.
_JOINER = _LATIN_JOINERS[0] + f"[{_LATIN_JOINERS[1][0]}-{_LATIN_JOINERS[1][-1]}&&[{_LATIN_JOINERS[1]}]]"
_NUMBER = rf"[0-9]++|(?=[{min(NUMERALS)}-{max(NUMERALS)}])[{NUMERALS}]++"
_WORD = rf"[{ascii_letters}][{ascii_letters}{_JOINER}]*+"
_LATIN = rf"{_WORD}|[{_JOINER}](?<![{_JOINER}].)[{_JOINER}]*+{_WORD}"
#: Placeholders, the head of one that isn't closed, and runs of text between them.
_PARTS = r"(\{\{.*?\}\}|\{\{.*$|[^{]++|\{)"


def squeeze(c: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Tokens between Unicode white space; none for an empty text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def to_half_width(c: Column) -> Column:
    return F.translate(c, _WIDE, _NARROW)


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c made once however often f names it; higher-order functions share nothing else."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _apart(c: Column, mixed: Callable[[Column], Column], plain: Callable[[Column], Column]) -> Column:
    """mixed(c) where c has a placeholder or the head of one, else plain(c)."""
    return _bound(c, lambda t: F.when(F.contains(t, F.lit("{{")), mixed(t)).otherwise(plain(t)))


def _parts(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_PARTS), F.lit(1))


def _marked(c: Column, pattern: str, placeholder: str) -> Column:
    """What the pattern finds outside placeholders gives way to a placeholder."""
    mark = lambda x: F.regexp_replace(x, pattern, placeholder)
    return _apart(c, lambda t: F.array_join(F.transform(_parts(t), lambda x: F.when(x.startswith("{{"), x).otherwise(mark(x))), ""), mark)


def _originals(c: Column, pattern: str, placeholder: str) -> Column:
    found = lambda x: F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1))
    own = lambda x: F.when(x.endswith(placeholder), F.array(F.lit(placeholder))).when(x.startswith("{{"), F.array().cast("array<string>")).otherwise(found(x))
    return _apart(c, lambda t: F.flatten(F.transform(_parts(t), own)), found)


def mark_numbers(c: Column) -> Column:
    """Runs of numerals or digits outside {{...}} become {{CD}}."""
    return _marked(c, _NUMBER, NUMBER)


def number_originals(c: Column) -> Column:
    """What mark_numbers replaces, in order; placeholders already there, also behind an open {{, stand for themselves."""
    return _originals(c, _NUMBER, NUMBER)


def mark_latin(c: Column) -> Column:
    """Latin words with their joiners, outside {{...}}, become {{FW}}."""
    return _marked(c, _LATIN, LATIN)


def latin_originals(c: Column) -> Column:
    return _originals(c, _LATIN, LATIN)


def mark(c: Column) -> Column:
    """Numbers, then Latin words. Where no placeholder is, Latin words go first: {{FW}} has no digit, and no part is cut."""
    return _apart(c, lambda t: mark_latin(mark_numbers(t)), lambda t: F.regexp_replace(F.regexp_replace(t, _LATIN, LATIN), _NUMBER, NUMBER))


def restore(c: Column, placeholder: str, originals: Column) -> Column:
    """The i-th placeholder gives way to the i-th original; those without one stay."""
    quoted = placeholder.replace("{", r"\{").replace("}", r"\}")

    def filled(pieces: Column) -> Column:
        gaps = F.size(pieces) - 1
        # zipped, not looked up: the originals may be a costly expression
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.zip_with(F.slice(pieces, 2, gaps), F.slice(originals, 1, gaps), lambda x, o: F.concat(F.coalesce(o, F.lit(placeholder)), x)), ""))

    return _bound(F.split(c, quoted, -1), filled)


def preprocess(c: Column) -> Column:
    """Strip, fold width, then numbers before Latin words."""
    return mark(to_half_width(squeeze(c)))


def char_tokens(c: Column) -> Column:
    """Characters without white space; a placeholder is one token."""
    return F.regexp_extract_all(c, F.lit(r"(\{\{[^ ]+?\}\}|(?U:\S))"), F.lit(1))


def clause_split(c: Column) -> Column:
    """Cut after each of ; ! ? : 。 ,"""
    return F.filter(F.split(c, r"(?<=[;!?:。,])"), lambda x: x != "")


def chinese_sentences(c: Column) -> Column:
    """Sentences that end at 。！？；; a quotation in 「」 is never cut. Runs are possessive: long sentences cost no stack."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"((?:[^「。！？；]++|「[^」]*+」|「)*+[。！？；]*+)"), F.lit(1)), lambda x: x != "")


def english_sentences(c: Column) -> Column:
    """Sentences that end at . ! or ? with closing quotes, before white space and a capital."""
    return F.filter(F.split(c, r"(?U)(?<=[.!?][\"')\]]?)\s+(?=[\"'(\[]?\p{Lu})"), lambda x: x != "")


def word_tokens(c: Column) -> Column:
    """Treebank-style word tokens: punctuation apart, contractions cut before the apostrophe."""
    t = F.regexp_replace(c, r'^"', "`` ")
    t = F.regexp_replace(t, r'([ (\[{<])"', "$1 `` ")
    t = F.regexp_replace(t, r"\.\.\.", " ... ")
    t = F.regexp_replace(t, r"([,:])([^0-9]|$)", " $1 $2")
    t = F.regexp_replace(t, r"([;@#$%&?!\]\[(){}<>])", " $1 ")
    t = F.regexp_replace(t, r"--", " -- ")
    t = F.regexp_replace(t, r"([^.])(\.)([\])}>\"']*)\s*$", "$1 $2$3 ")
    t = F.regexp_replace(t, '"', " '' ")
    t = F.regexp_replace(t, r"([^'])' ", "$1 ' ")
    t = F.regexp_replace(t, r"(?i)([^' ])('s|'m|'d|'ll|'re|'ve|n't)(?= |$)", "$1 $2")
    t = F.regexp_replace(t, r"(?i)\b(can)(not)\b", "$1 $2")
    return tokens(t)


def _ascii_pairs() -> tuple[str, str]:
    """Letters of Latin-1 and Latin Extended-A and their base letters, from their decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x180)]
    pairs = [(a, b) for a, b in pairs if b.isascii() and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Characters that turn into several letters or into other punctuation.
_SPELT = (("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("Ø", "O"), ("ø", "o"), ("Ð", "D"), ("ð", "d"), ("Þ", "Th"), ("þ", "th"), ("Ł", "L"), ("ł", "l"), ("…", "..."))


def to_ascii(c: Column) -> Column:
    """Latin letters without their marks; the paragraph separator becomes a blank, other characters go."""
    t = F.translate(squeeze(c), "\u2029‘’‚“”„–—−\u00a0", " '',\"\"\"--- ")
    for a, b in _SPELT:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(t, *_ascii_pairs()), r"[^\x00-\x7F]", "")


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def is_number(c: Column) -> Column:
    return c.try_cast("double").isNotNull()
