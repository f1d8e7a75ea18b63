"""Grammar and collocation patterns as tables.

A grammar comes from text of lines ``POS TAB group TAB pattern`` (``read_grammar``); a pattern's slot may hold
alternatives between bars, so ``V about|at sth`` stands for two. The built-in table has the patterns of
one keyword and its commonest complements; larger tables are read from files of the same form.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

#: Keyword elements and the part of speech they stand for.
GRAMMAR_KEYWORDS = {
    "V": "V", "V-ed": "V", "N": "N", "N's": "N", "ADJ": "ADJ", "ADJER": "ADJ", "ADJEST": "ADJ",
    "ADJP": "ADJ", "ADJERP": "ADJ", "ADJESTP": "ADJ",
}
COLLOCATION_KEYWORDS = {"N": "N", "V": "V", "ADJ": "ADJ", "ADJP": "ADJ"}
#: Keyword elements that show the word form rather than the lemma.
INFLECTED = {"ADJER", "ADJEST", "V-ed", "ADJERP", "ADJESTP"}

#: Part of speech, group and pattern, separated by TABs.
BASE = """
VERB	V n	V sth
VERB	V pron-refl	V oneself
VERB	V amount	V amount
VERB	V adj	V adjp
VERB	V -ing	V doing
VERB	V to-inf	V to inf
VERB	V inf	V inf
VERB	V that	V that
VERB	V wh	V wh
VERB	V wh-to-inf	V wh to inf
VERB	V so/not	V so
VERB	V so/not	V not
VERB	V as if	V as if
VERB	V as though	V as though
VERB	V and v	V and do
VERB	V adv	V advp
VERB	V about n	V about sth
VERB	V across n	V across sth
VERB	V after n	V after sth
VERB	V against n	V against sth
VERB	V around/round n	V around sth
VERB	V around/round n	V round sth
VERB	V as adj.	V as adjp
VERB	V as n	V as sth
VERB	V as to wh	V as to wh
VERB	V at n	V at n
VERB	V between n	V between sth
VERB	V by amount	V by amount
VERB	V by -ing	V by doing
VERB	V by n	V by sth
VERB	V for n	V for sth
VERB	V from n	V from sth
VERB	V in n	V in sth
VERB	V in favor of n	V in favor of sth
VERB	V into n	V into sth
VERB	V like n	V like sth
VERB	V of n	V of sth
VERB	V off n	V off sth
VERB	V on n	V on sth
VERB	V on to n	V on to sth
VERB	V onto n	V onto sth
VERB	V out of n	V out of sth
VERB	V over n	V over sth
VERB	V through n	V through sth
VERB	V to n	V to sth
VERB	V towards/toward n	V toward sth
VERB	V towards/toward n	V towards sth
VERB	V under n	V under sth
VERB	V with n	V with sth
VERB	V n n	V sth sth
VERB	V n adj	V sth adjp
VERB	V n -ing	V sth doing
VERB	V n to-inf	V sth to inf
VERB	V n inf	V sth inf
VERB	V n wh	V sth wh
VERB	V n wh-to-inf	V sth wh to inf
VERB	V n -ed	V sth done
VERB	V n adv	V sth advp
VERB	V n about n	V sth about sth
VERB	V n against n	V sth against sth
VERB	V n as adj	V sth as adjp
VERB	V n as n	V sth as n
VERB	V n at n	V sth at sth
VERB	V n between n	V sth between sth
VERB	V n by n	V sth by sth
VERB	V n for n	V sth for sth
VERB	V n from n	V sth from sth
VERB	V n in n	V sth in sth
VERB	V n into n	V sth into sth
VERB	V n into -ing	V sth into doing
VERB	V n of n	V sth of sth
VERB	V n off n	V sth off sth
VERB	V n on n	V sth on sth
VERB	V n over n	V sth over sth
VERB	V n to n	V sth to sth
VERB	V n with n	V sth with sth
VERB	it V	it V
VERB	it V that	it V that
VERB	it V to-inf	it V to inf
VERB	it be V-ed that	it be V-ed that
VERB	V it	V it
VERB	V it that	V it that
NOUN	N that	N that
NOUN	N to-inf	N to inf
NOUN	the N to-inf	the N to inf
NOUN	N for n to-inf	N for n to inf
NOUN	N about n	N about sth
NOUN	N about -ing	N about doing
NOUN	N about wh	N about wh
NOUN	N against n	N against sth
NOUN	N among n	N among sth
NOUN	N as n	N as sth
NOUN	N as to wh	N as to wh
NOUN	N at n	N at sth
NOUN	N behind n	N behind sth
NOUN	N between n	N between sth
NOUN	N by n	N by sth
NOUN	N for n	N for sth
NOUN	N for -ing	N for doing
NOUN	N from n	N from sth
NOUN	N from n that	N from sth that
NOUN	N from n to n	N from sth to sth
NOUN	N in n	N in sth
NOUN	N in -ing	N in doing
NOUN	N into n	N into sth
NOUN	N of n	N of sth
NOUN	N of -ing	N of doing
NOUN	N of amount	N of amount
NOUN	N on n	N on sth
NOUN	N on -ing	N on doing
NOUN	N on wh	N on wh
NOUN	out of N	out of N
NOUN	to N	to N
NOUN	under N	under N
NOUN	with N	with N
NOUN	within N	within N
NOUN	without N	without N
ADJ	ADJ n	ADJ sth
ADJ	adv ADJ	adv ADJP
ADJ	adv ADJ n	adv ADJ sth
ADJ	as ADJ as n/-ing	as ADJP as sth
ADJ	as ADJ as n/-ing	as ADJP as doing
ADJ	ADJ enough	ADJP enough
ADJ	ADJ enough to-inf	ADJP enough to inf
ADJ	ADJ enough for n	ADJP enough for sth
ADJ	how ADJ	how ADJP
ADJ	how ADJ a n cl	how ADJP a sth clause
ADJ	so ADJ that	so ADJP that
ADJ	too ADJ to-inf	too ADJP to inf
ADJ	the ADJER	the ADJERP
ADJ	the ADJER	the ADJER sth
ADJ	ADJER than n/-ing	ADJERP than sth
ADJ	ADJER than n/-ing	ADJERP than doing
ADJ	the ADJEST of/among n	the ADJESTP of sth
ADJ	the ADJEST of/among n	the ADJESTP among sth
"""
#: The collocation patterns.
COLLOCATION_FRAMES = {
    "NOUN": "adj N\nn N\nN sth\ndo N\nN do\nN prep sth\nsth prep N\ndo prep N\nsth and N\nN and sth",
    "VERB": "adv V\nV sth\nsth V\nV adjp\nV prep sth\nV to v\nv to V\ndo and V\nV and do",
    "ADJ": "adv ADJ\ndo ADJP\nADJ sth\nADJ to do\nadj ADJ\nADJ adj\nADJ prep sth\nadj and ADJ\nADJ and adj",
}
MOST_TOKENS = 5


def unfold(frame: str) -> list[str]:
    """The patterns of a frame, in the order of its alternatives."""
    slots = [[" ".join(w for w in a.split("+") if w) for a in slot.split("|")] for slot in frame.split()]
    return [" ".join(choice) for choice in product(*slots)]


@dataclass
class Grammar:
    """Patterns by keyword element, length and the keyword's place; and the group of each pattern."""

    keywords: dict[str, str]
    buckets: dict[tuple[str, int, int], set[str]] = field(default_factory=dict)
    groups: dict[str, str] = field(default_factory=dict)

    def add(self, pattern: str, group: str, most: int | None = MOST_TOKENS) -> None:
        words = pattern.split(" ")
        held = [w for w in words if w in self.keywords]
        if most is not None and len(words) > most or not held:
            return
        self.buckets.setdefault((held[0], len(words), words.index(held[0])), set()).add(pattern)
        self.groups[pattern] = group  # a later group takes over


def default_grammar() -> Grammar:
    return read_grammar(BASE)


def collocation_grammar() -> Grammar:
    out = Grammar(COLLOCATION_KEYWORDS)
    for frames in COLLOCATION_FRAMES.values():
        for pattern in frames.split("\n"):
            out.add(pattern, pattern, None)
    return out


def read_grammar(text: str, keywords: dict[str, str] = GRAMMAR_KEYWORDS) -> Grammar:
    """A grammar from lines of part of speech, group and pattern, separated by TABs; of groups for one pattern the last counts."""
    out = Grammar(keywords)
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            _, group, frame = line.split("\t")
            for pattern in unfold(frame):
                out.add(pattern, group)
    return out


def buckets_rows(grammar: Grammar) -> list[tuple[str, str, int, int, str]]:
    """(keyword, pattern, length, keyword place, group) of each pattern: the grammar as a dimension table."""
    return sorted((k, p, n, at, grammar.groups[p]) for (k, n, at), ps in grammar.buckets.items() for p in ps)
