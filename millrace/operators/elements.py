"""What each token of a tagged sentence may stand for in a pattern.

A token's list holds keyword elements (upper case) and slot elements; ``_`` says that a pattern may
skip the token, and an empty list is a boundary that no pattern crosses.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

#: Word lists and element tables of the pattern notation.
LEXICAL = frozenset(
    """to as that it for of what in with where how who when be about on there from enough than one thing at by
    towards too over into between against under toward split so out onto however among way upon together such
    since off if and after a without within through round not like favor favour behind around across though""".split()
)
LINKING = frozenset(
    """average be compose comprise constitute cover equal extend feel form go keeo lie make measure number pass
    prove rank rate remain represent stand stay total weigh become come fall get grow turn creep drift edge inch
    move act apear look play seem smell sound taste amount begin consist coninue convert double end figure finish
    function tie masquerade operate originate parade pose serve reside resolve run shade start transmute appear
    keep""".split()
)
REFLEXIVE = frozenset("myself ourself ourselves yourself yourselves himself herself themself".split())
WH = frozenset("what when where who which why how".split())
THINGS = frozenset("something anything nothing".split())
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
    its itself they them their theirs themselves am is are was were be been being a an the s t""".split()
)
HEAD = {
    **dict.fromkeys(("NN", "NNS", "NNP", "NNPS", "FW"), ("sth",)),
    "VB": ("do", "inf"), "VBZ": ("do",), "VBD": ("do",), "VBG": ("do", "doing"), "VBN": ("do", "done"), "VBP": ("do",),
    **dict.fromkeys(("JJ", "JJR", "JJS"), ("adjp",)), **dict.fromkeys(("RB", "RBR", "RBS"), ("advp", "_")),
    "CD": ("amount",), "TO": ("to", "prep"), "DT": ("THIS", "sth"), "IN": ("prep",), "CC": ("and",), "EX": ("there",),
    **dict.fromkeys(("MD", "SYM", "LS", "HYPH", "POS", "UH"), ("_",)), **dict.fromkeys(("WDT", "WP", "WRB"), ("wh",)),
    "PRP$": ("'one's", "_"),
}
INSIDE = {
    **dict.fromkeys(("NN", "NNS", "NNP", "NNPS", "VB", "VBP", "VBG", "VBZ", "VBN", "VBD", "POS", "MD"), ("_",)),
    **dict.fromkeys(("JJ", "JJR", "JJS"), ("adj", "_")), **dict.fromkeys(("RB", "RBR", "RBS"), ("adv", "_")),
    "DT": ("det", "_"), "IN": ("?",), "CD": ("amount", "_"), "PRP": ("one", "sth"), "PRP$": ("'one's", "_"),
    "WP": ("wh",), "WRB": ("wh",), "TO": ("to",),
}
COLLOCATION_HEAD = HEAD | dict.fromkeys(("VB", "VBG", "VBN"), ("do",)) | {"PRP": ("sth",)}
COLLOCATION_INSIDE = INSIDE | {
    **dict.fromkeys(("NN", "NNS", "NNP", "NNPS"), ("n", "_")), **dict.fromkeys(("VB", "VBP", "VBG", "VBZ", "VBN", "VBD"), ("v", "_")),
    "DT": ("det.", "_"), "PRP": ("sth",), "CC": ("and",),
}
del COLLOCATION_INSIDE["POS"]

Tokens = tuple[Sequence[str], Sequence[str], Sequence[str], Sequence[str]]


def _special(tokens: Tokens, i: int, verbs: tuple[str, ...]) -> list[str] | None:
    """The slot elements of the constructions that come before the general tables; None if none applies."""
    words, lemmas, poss, chunks = tokens
    pos, lemma, chunk = poss[i], lemmas[i], chunks[i]
    noun = pos.startswith("NN")
    following = lambda k: lemmas[i + k] if 0 <= i + k < len(words) else None
    if pos.startswith(verbs) and i + 1 < len(words) and poss[i + 1] == "TO" and chunks[i + 1][:1] == "I":
        return ["<head>"]
    if chunk == "H-SBAR" and lemma == "in" and (following(1), following(2)) == ("order", "to"):
        return ["_"]
    if i > 0 and chunks[i - 1] == "H-SBAR" and (following(-1), lemma, following(1)) == ("in", "order", "to"):
        return ["_"]
    if pos == "PRP":
        return ["oneself" if lemma in REFLEXIVE else "one", "sth"]
    if noun and (i + 1 < len(words) and words[i + 1] == "'s" or words[i].endswith("’s")):
        return ["one's", "sth"]
    if chunk == "H-PRT" and pos == "RP":
        return ["PRT", lemma]
    if chunk == "H-SBAR":
        return ["wh" if lemma in WH else lemma]
    return [lemma] if chunk == "I-SBAR" else None


def _general(chunk: str, pos: str, head: Mapping, inside: Mapping) -> list[str]:
    """By whether the token heads its chunk (or has none) or lies inside it."""
    table = {"H": head, "O": head, "I": inside}.get(chunk[:1], {})
    return list(table.get(pos, ()))


def grammar_elements(words: Sequence[str], lemmas: Sequence[str], poss: Sequence[str], chunks: Sequence[str]) -> list[list[str]]:
    tokens, out = (words, lemmas, poss, chunks), []
    for i, (lemma, pos, chunk) in enumerate(zip(lemmas, poss, chunks, strict=True)):
        own: list[str] = []
        if chunk[:1] != "O":
            phrase = "" if chunk[:1] == "I" else "P"
            if pos.startswith("NN"):
                own = ["N", *["-thing"] * (lemma in THINGS)]
            elif pos.startswith("VB"):
                own = ["V-ed" if pos == "VBN" else "V", *["v-link"] * (lemma in LINKING)]
            elif pos in ("JJ", "JJR", "JJS"):
                own = [{"JJ": "ADJ", "JJR": "ADJER", "JJS": "ADJEST"}[pos] + phrase]
            elif pos in ("RB", "RBR", "RBS"):
                own = [{"RB": "ADV", "RBR": "ADVER", "RBS": "ADVEST"}[pos]]
        slots = _special(tokens, i, ("VB",))
        if slots == ["<head>"]:
            slots = list(HEAD.get(pos, ()))
        elif slots is None:
            slots = _general(chunk, pos, HEAD, INSIDE)
            if lemma in LEXICAL and lemma not in own + slots:
                slots.append(lemma)
        out.append(own + slots)
    return out


def collocation_elements(words: Sequence[str], lemmas: Sequence[str], poss: Sequence[str], chunks: Sequence[str], phrasal: Mapping[str, Mapping[int, set[str]]] | None = None) -> list[list[str]]:
    """phrasal: for each verb, by number of words, what follows it; those tokens may be skipped."""
    tokens, out, skip = (words, lemmas, poss, chunks), [], 0
    for i, (word, lemma, pos, chunk) in enumerate(zip(words, lemmas, poss, chunks, strict=True)):
        own: list[str] = []
        if pos.startswith("NN"):
            own = ["N"]
        elif pos.startswith("VB"):
            own = ["V"]
        elif pos.startswith("JJ"):
            own = ["ADJP" if chunk[:1] == "H" else "ADJ"]
        if skip:
            slots, skip = ["_"], skip - 1
        else:
            slots = _special(tokens, i, ("VB",))
            if slots == ["<head>"]:
                slots = list(COLLOCATION_HEAD.get(pos, ()))
            elif slots is None:
                slots = ["O"] if word in STOP or lemma in STOP else _general(chunk, pos, COLLOCATION_HEAD, COLLOCATION_INSIDE)
        lengths = (phrasal or {}).get(lemma, {})
        for n in sorted(lengths, reverse=True):
            if " ".join(lemmas[i + 1 : i + n]) in lengths[n]:
                skip = n - 1
                break
        out.append(own + slots)
    return out


ElementMaker = Callable[[Sequence[str], Sequence[str], Sequence[str], Sequence[str]], list[list[str]]]
