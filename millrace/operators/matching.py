"""Pattern candidates in tagged sentences, and the rows they give.

Matching is a search, since patterns may skip tokens, and runs in one Arrow function; all that follows is
relational. For each keyword element the patterns form a trie of the tokens to the left, read outwards;
where a left part ends hangs a trie of the right parts that go with it. A position is searched
once to the left, and once to the right for each left part found, however many patterns share them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.elements import LEXICAL, LINKING, REFLEXIVE, STOP, THINGS, WH, ElementMaker, collocation_elements, grammar_elements
from millrace.operators.grammar import INFLECTED, Grammar

#: A side is read up to REACH times the pattern's tokens on that side, and one more.
REACH = 3
#: Lemmas that change a token's elements; chunks in which every lemma does; lemmas that look at those after them.
NOTED = LEXICAL | LINKING | REFLEXIVE | STOP | THINGS | WH | {"in", "order"}
WITH_LEMMA = frozenset(("H-PRT", "H-SBAR", "I-SBAR"))
ORDERLY = frozenset(("in", "order"))
CANDIDATE = "struct<pos:string,at:int,tokens:array<string>,places:array<int>>"


class Node:
    """A place in a trie: what follows, what ends here, and the most tokens of any pattern part through it."""

    __slots__ = ("after", "deepest", "ends")

    def __init__(self) -> None:
        self.after: dict[str, Node] = {}
        self.ends = None
        self.deepest = 0

    def put(self, tokens: Sequence[str]) -> Node:
        node = self
        node.deepest = max(node.deepest, len(tokens))
        for t in tokens:
            node = node.after.setdefault(t, Node())
            node.deepest = max(node.deepest, len(tokens))
        return node


def tries(grammar: Grammar) -> dict[str, Node]:
    """For each keyword element the trie of left parts; where one ends, the trie of its right parts, which end in patterns.

    A part that holds another keyword or the mark for skipping matches nothing and is left out.
    """
    never = {"_", *grammar.keywords}
    out: dict[str, Node] = {}
    for (keyword, _, at), patterns in grammar.buckets.items():
        for pattern in sorted(patterns):
            tokens = pattern.split(" ")
            left, right = tokens[:at][::-1], tokens[at + 1 :]
            if never.isdisjoint(left) and never.isdisjoint(right):
                end = out.setdefault(keyword, Node()).put(left)
                end.ends = end.ends or Node()
                end.ends.put(right).ends = tokens
    return out


def _ways(root: Node, elements: Sequence[list[str]], start: int, step: int) -> list[tuple[object, tuple[int, ...]]]:
    """What ends at each way through the trie from a place on, and the places of its tokens.

    A token of the sentence may be passed over if its list has ``_``; a list without it must match, and an
    empty list ends the search. The last token lies within REACH places for each token of the part.
    """
    found: list[tuple[object, tuple[int, ...]]] = []
    size = len(elements)

    def walk(node: Node, seen: int, places: tuple[int, ...]) -> None:
        if node.ends is not None and seen - 1 <= len(places) * REACH:
            found.append((node.ends, places))
        after = node.after
        if not after:
            return
        most = node.deepest * REACH
        while seen <= most:
            i = start + step * seen
            if not 0 <= i < size:
                return
            own = elements[i]
            seen += 1
            for e in own:
                to = after.get(e)
                if to is not None:
                    walk(to, seen, (*places, i))
            if "_" not in own:
                return

    walk(root, 0, ())
    return found


def candidates(elements: Sequence[list[str]], words: Sequence[str], lemmas: Sequence[str], grammar: Grammar, vocab: set[str] | None, roots: dict[str, Node] | None = None) -> list[tuple[str, int, list[str], list[int]]]:
    """(keyword element, its place, tokens, their places) of each way a pattern matches; vocab None lets every keyword through."""
    roots = tries(grammar) if roots is None else roots
    out = []
    for i, own in enumerate(elements):
        held = next((e for e in own if e in grammar.keywords), None)
        root = roots.get(held)
        if root is None or vocab is not None and words[i] not in vocab and lemmas[i] not in vocab:
            continue
        rights: dict[int, list] = {}
        for right, left in _ways(root, elements, i - 1, -1):
            if id(right) not in rights:
                rights[id(right)] = _ways(right, elements, i + 1, 1)
            out += [(held, i, tokens, [*left[::-1], i, *places]) for tokens, places in rights[id(right)]]
    return out


class Search:
    """The ways of ``_ways`` through a trie as an automaton over numbered element lists, built as lists are met.

    A state holds the places in the trie that wait for the next list, with the tokens' distances on the way there.
    """

    def __init__(self, root: Node, lists: list[list[str]]) -> None:
        self.lists = lists
        self.states: list[tuple[int, list[tuple[Node, tuple[int, ...]]]]] = [(0, [(root, ())])]
        self.steps: list[dict[int, tuple[list, int]]] = [{0: ([], -1)}]
        self.at_start = [(root.ends, ())] if root.ends is not None else []

    def step(self, state: int, given: int) -> tuple[list, int]:
        seen, waiting = self.states[state]
        own, found, after = self.lists[given], [], []
        for node, places in waiting:
            if not node.after or seen > node.deepest * REACH:
                continue
            for e in own:
                to = node.after.get(e)
                if to is not None:
                    way = (*places, seen + 1)
                    if to.ends is not None and seen <= len(way) * REACH:
                        found.append((to.ends, way))
                    after.append((to, way))
            if "_" in own:
                after.append((node, places))
        after = [(n, w) for n, w in after if n.after and seen + 1 <= n.deepest * REACH]
        to = -1
        if after:
            to = len(self.states)
            self.states.append((seen + 1, after))
            self.steps.append({0: ([], -1)})
        self.steps[state][given] = found, to
        return found, to

    def ways(self, numbers: list[int], i: int, step: int) -> list[tuple[object, tuple[int, ...]]]:
        """What ends on a way from place i, exclusive, and the distances of its tokens. 0 in numbers is an end of the sentence."""
        state, out, steps = 0, self.at_start, self.steps
        while state >= 0:
            i += step
            found, state = steps[state].get(numbers[i]) or self.step(state, numbers[i])
            if found:
                out = out + found
        return out


class Matcher:
    """Candidates of many sentences: element lists are made once for each kind of token and neighbours."""

    #: Most states of automata and kinds of tokens that are kept.
    STATES, KINDS = 200_000, 500_000

    def __init__(self, grammar: Grammar, kind: str, phrasal: dict | None) -> None:
        self.grammar, self.make, self.whole = grammar, maker(kind, phrasal), bool(phrasal)
        self.roots, self.sentences = tries(grammar), 0
        self.reset()

    def reset(self) -> None:
        self.lists: list[list[str]] = [[]]
        self.number: dict[tuple[str, ...], int] = {}
        self.kinds: dict[tuple, int] = {}
        self.held: list[str | None] = [None]
        self.left = {k: Search(root, self.lists) for k, root in self.roots.items()}
        self.right: dict[int, Search] = {}

    def _number(self, own: list[str]) -> int:
        n = self.number.get(tuple(own))
        if n is None:
            n = self.number[tuple(own)] = len(self.lists)
            self.lists.append(own)
            held = next((e for e in own if e in self.grammar.keywords), None)
            self.held.append(held if held in self.roots else None)
        return n

    def numbers(self, w: list[str], m: list[str], t: list[str], c: list[str]) -> list[int]:
        """A number for each token's element list, between zeros."""
        if self.whole:
            return [0, *(self._number(own) for own in self.make(w, m, t, c)), 0]
        kinds, out, size = self.kinds, [0], len(w)
        marked = [x if x in NOTED else None for x in m]
        before = None
        for i, (word, lemma, pos, chunk) in enumerate(zip(w, marked, t, c, strict=True)):
            if chunk in WITH_LEMMA:
                lemma = m[i]
            if i + 1 < size:
                following = ("I" if c[i + 1][:1] == "I" else "") if t[i + 1] == "TO" else None
                key = lemma, pos, chunk, word in STOP, word[-2:] == "’s", before, following, w[i + 1] == "'s", lemma in ORDERLY and (m[i + 1], m[i + 2] if i + 2 < size else None)
            else:
                key = lemma, pos, chunk, word in STOP, word[-2:] == "’s", before
            n = kinds.get(key)
            if n is None:
                start = max(0, i - 1)
                near = slice(start, i + 3)
                n = kinds[key] = self._number(self.make(w[near], m[near], t[near], c[near])[i - start])
            out.append(n)
            before = (m[i] == "in") if chunk == "H-SBAR" else None
        out.append(0)
        return out

    def candidates(self, w: list[str], m: list[str], t: list[str], c: list[str], vocab: set[str] | None) -> list[tuple[str, int, list[str], list[int]]]:
        self.sentences += 1
        if self.sentences % 256 == 0 and (sum(len(x.states) for x in (*self.left.values(), *self.right.values())) > self.STATES or len(self.kinds) > self.KINDS):
            self.reset()
        numbers, held, out = self.numbers(w, m, t, c), self.held, []
        for i, n in enumerate(numbers):
            keyword = held[n]
            if keyword is None or vocab is not None and w[i - 1] not in vocab and m[i - 1] not in vocab:
                continue
            rights: dict[int, list] = {}
            for root, left in self.left[keyword].ways(numbers, i, -1):
                ways = rights.get(id(root))
                if ways is None:
                    search = self.right.get(id(root))
                    if search is None:
                        search = self.right[id(root)] = Search(root, self.lists)
                    ways = rights[id(root)] = search.ways(numbers, i, 1)
                for tokens, right in ways:
                    out.append((keyword, i - 1, tokens, [*(i - 1 - d for d in left[::-1]), i - 1, *(i - 1 + d for d in right)]))
        return out


def well_formed(sents: DataFrame, vocab: set[str] | None) -> DataFrame:
    """Sentences of equal arrays without null tokens that have a word or lemma of vocab; first letters lower-cased."""
    from millrace.functions.text import lower_first

    first = lambda c: F.transform(c, lambda x, i: F.when(i == 0, lower_first(x)).otherwise(x))
    sizes, every = F.size("words"), F.concat("words", "lemmas", "poss", "chunks")
    ok = sents.filter((sizes == F.size("lemmas")) & (sizes == F.size("poss")) & (sizes == F.size("chunks")) & ~F.exists(every, lambda x: x.isNull()))
    ok = ok.withColumns({"words": first("words"), "lemmas": first("lemmas")})
    if vocab is None:
        return ok
    return ok.filter(F.arrays_overlap(F.concat("words", "lemmas"), F.array(*(F.lit(v) for v in sorted(vocab))).cast("array<string>")))


def well_formed_lists(*lists: list[str | None] | None) -> bool:
    """As in ``well_formed``: lists of equal sizes without nulls."""
    return all(x is not None and len(x) == len(lists[0]) and None not in x for x in lists)


def maker(kind: str, phrasal: dict | None) -> ElementMaker:
    return grammar_elements if kind == "grammar" else lambda *t: collocation_elements(*t, phrasal=phrasal)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Batches of few sentences, so that a task holds the candidates of few."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def with_candidates(sents: DataFrame, grammar: Grammar, vocab: set[str] | None, kind: str = "grammar", phrasal: dict | None = None, name: str = "candidates") -> DataFrame:
    """The well-formed of sents (words, lemmas, poss, chunks) with an array of candidates."""
    ok = well_formed(sents, vocab)
    shared = sents.sparkSession.sparkContext.broadcast((grammar, vocab, phrasal))
    struct = pa.struct([("pos", pa.string()), ("at", pa.int32()), ("tokens", pa.list_(pa.string())), ("places", pa.list_(pa.int32()))])
    columns = ok.columns

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, v, p = shared.value
        roots, make = tries(g), maker(kind, p)
        for batch in slices(batches):
            rows = []
            for w, m, t, c in zip(*(batch.column(n).to_pylist() for n in ("words", "lemmas", "poss", "chunks")), strict=True):
                rows.append([dict(zip(("pos", "at", "tokens", "places"), x, strict=True)) for x in candidates(make(w, m, t, c), w, m, g, v, roots)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(struct))], [*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ok.schema)
    return ok.mapInArrow(found, f"{schema}, `{name}` array<{CANDIDATE}>")


def pattern_rows(sents: DataFrame, grammar: Grammar, vocab: set[str] | None, kind: str = "grammar", phrasal: dict | None = None, instances: bool = True) -> DataFrame:
    """(wordpos, pat, iocs, example, instance_sym) of each candidate of the well-formed sents, repeats included; without
    ``instances`` (wordpos, pat).

    Rows leave the Arrow function as they are: no sentence is repeated for its candidates. It also looks for ill-formed
    sentences: as a filter, the plan would make the arrays anew for each condition.
    """
    shared = sents.sparkSession.sparkContext.broadcast((grammar, vocab, phrasal))
    types = [*[pa.string()] * 4, pa.map_(pa.int32(), pa.string())] if instances else [pa.string()] * 2
    names = ["wordpos", "pat", "iocs", "example", "instance_sym"][: len(types)]

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, v, p = shared.value
        matcher = Matcher(g, kind, p)
        for batch in slices(batches):
            rows = []
            for w, m, t, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if not w or not well_formed_lists(w, m, t, c):
                    continue
                w[0], m[0] = w[0][:1].lower() + w[0][1:], m[0][:1].lower() + m[0][1:]
                if v is not None and v.isdisjoint(w) and v.isdisjoint(m):
                    continue
                for held, at, tokens, places in matcher.candidates(w, m, t, c, v):
                    lemma, iocs = m[at].lower(), " ".join([m[i] for i in places])
                    if kind == "grammar":
                        pat = " ".join([w[at].lower() if x in INFLECTED else lemma if x in g.keywords else x for x in tokens])
                    else:
                        pat = f"({' '.join(tokens)}){iocs}"
                    if not instances:
                        rows.append((f"{lemma}:{g.keywords[held]}", pat))
                        continue
                    example = " ".join(w[places[0] : places[-1] + 1])
                    rows.append((f"{lemma}:{g.keywords[held]}", pat, iocs, f"[{example}]", [(i - places[0], x) for i, x in zip(places, tokens, strict=True)]))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(col, k) for col, k in zip(columns, types, strict=True)], names)

    return sents.select("words", "lemmas", "poss", "chunks").mapInArrow(found, "wordpos string, pat string" + ", iocs string, example string, instance_sym map<int,string>" * instances)


def combined_rows(sents: DataFrame, grammar: Grammar, collocations: Grammar, vocab: set[str] | None, phrasal: dict | None = None) -> DataFrame:
    """(wordpos, pat, iocs, example): grammar candidates joined with what collocations add to their left."""
    both = with_candidates(with_candidates(sents, grammar, vocab, "grammar", name="gra"), collocations, vocab, "collocation", phrasal, name="col")
    pos_of = lambda g, c: F.element_at(F.create_map(*(F.lit(x) for pair in g.keywords.items() for x in pair)), c)
    one = both.select("words", "lemmas", "col", F.explode("gra").alias("g")).select("*", F.explode("col").alias("c"))
    same = one.filter((F.col("g.at") == F.col("c.at")) & (pos_of(grammar, F.col("g.pos")) == pos_of(collocations, F.col("c.pos"))))
    left = F.filter(F.col("c.places"), lambda p: p < F.get(F.col("g.places"), F.lit(0)))
    added = same.withColumn("_left", left).filter(F.size(F.array_except("_left", F.col("g.places"))) > 0)
    places = F.array_sort(F.array_union(F.col("g.places"), F.col("_left")))
    rows = added.withColumn("_places", places)
    lemma_at = lambda p: F.lower(F.get("lemmas", p))
    token = lambda p: F.when(p == F.col("g.at"), lemma_at(p)).otherwise(F.coalesce(F.get(F.col("g.tokens"), (F.array_position(F.col("g.places"), p) - 1).cast("int")), lemma_at(p)))
    shown = F.transform("_places", lambda p: F.when(F.array_contains(F.col("g.places"), p), token(p)).otherwise(lemma_at(p)))
    start, end = F.get("_places", F.lit(0)), F.element_at("_places", -1)
    example = F.concat(F.lit("["), F.array_join(F.slice("words", start + 1, end - start + 1), " "), F.lit("]"))
    return rows.select(
        F.concat_ws(":", lemma_at(F.col("g.at")), pos_of(grammar, F.col("g.pos"))).alias("wordpos"), F.array_join(shown, " ").alias("pat"),
        F.array_join(F.transform("_places", lemma_at), " ").alias("iocs"), example.alias("example"),
    )


def context(words: Sequence[str], chunks: Sequence[str], places: Sequence[int]) -> tuple[str, str]:
    """Words from two chunk heads before a match, and up to the next head after it."""
    heads = [i for i in range(places[0]) if i and chunks[i][:1] == "H"]
    begin = None
    if len(heads) >= 2:
        begin = heads[-2] + (1 if words[heads[-2] + 1].replace("_", "a").isalnum() else 2)
    elif places[0] > 0:
        begin = 0
    after = next((i for i in range(places[-1] + 1, len(words)) if chunks[i][:1] == "H"), None)
    prev = " ".join(words[begin : places[0]]) + " " if begin is not None else ""
    return prev, "" if after is None else " " + " ".join(words[places[-1] + 1 : after + 1])
