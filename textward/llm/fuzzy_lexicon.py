"""A lexicon trie intersected with Levenshtein automata, made deterministic as it is used."""

from __future__ import annotations

import unicodedata

#: Signs that stand for letters in disguised words.
LEET = {"4": "a", "@": "a", "3": "e", "€": "e", "1": "il", "!": "i", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "2": "z"}
#: From this length on a term may differ by one letter; from SWAP on also by another letter in its place.
NEAR, SWAP = 5, 7


def fold(word: str) -> str:
    """Lower case without accents."""
    word = word.lower()
    if word.isascii():
        return word
    return "".join(ch for ch in unicodedata.normalize("NFD", word) if not unicodedata.combining(ch))


class FuzzyLexicon:
    """Looks up words in terms with one error, signs for letters, masks and stretched letters.

    A state of the automaton is a set of (trie node, errors: 0 none, 1 a letter too many or too
    few, 2 another letter); only the terms in ``near`` may have errors. Its moves are worked out when first
    needed and kept, so a word costs one table look-up a letter and most words die early. The
    first letter must agree. ``*`` stands for any letter; a repeated letter may be stretched.
    """

    def __init__(self, terms: dict[str, tuple], near: set[str] = frozenset()) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.letter: list[str] = [""]
        self.depth: list[int] = [0]
        self.value: list[tuple | None] = [None]
        self.longest: list[int] = [0]
        self.near: set[int] = set()
        for term, value in terms.items():
            at = 0
            for ch in fold(term):
                if ch not in self.children[at]:
                    self.children[at][ch] = len(self.children)
                    self.children.append({})
                    self.letter.append(ch)
                    self.depth.append(self.depth[at] + 1)
                    self.value.append(None)
                    self.longest.append(0)
                at = self.children[at][ch]
                if term in near:
                    self.longest[at] = max(self.longest[at], len(term))
            self.value[at] = value
            if term in near:
                self.near.add(at)
        self.states: list[frozenset] = [frozenset({(0, 0)})]
        self.index = {self.states[0]: 0}
        self.moves: list[dict[str, int]] = [{}]
        self.accept: list[tuple | None] = [None]
        self.known: dict[str, tuple | None] = {}

    def _next(self, state: frozenset, ch: str) -> frozenset:
        out: dict[int, int] = {}

        def reach(node: int, errors: int) -> None:
            if errors == 0 or self.longest[node] >= (NEAR if errors == 1 else SWAP):
                if errors < out.get(node, 9):
                    out[node] = errors

        same = LEET.get(ch, "") + ch
        for node, errors in state:
            kids = self.children[node]
            for x in same:
                if x in kids:
                    reach(kids[x], errors)
            if ch == "*" and node:
                for kid in kids.values():
                    reach(kid, errors)
            if node and errors == 0 and self.letter[node] in same:
                reach(node, 0)
            if node and errors == 0:
                reach(node, 1)  # a letter too many
                for x, kid in kids.items():
                    reach(kid, 2)  # another letter
                    for y in same:  # a letter too few
                        if y in self.children[kid]:
                            reach(self.children[kid][y], 1)
        return frozenset(out.items())

    def _accepting(self, state: frozenset) -> tuple | None:
        errors = min((e for node, e in state if self._ends(node, e)), default=None)
        if errors is None:
            return None
        # a masked word may stand for several terms
        return tuple(sorted({x for node, e in state if e == errors and self._ends(node, e) for x in self.value[node]})), errors

    def _ends(self, node: int, errors: int) -> bool:
        return self.value[node] is not None and (errors == 0 or node in self.near and self.depth[node] >= (NEAR if errors == 1 else SWAP))

    def match(self, word: str) -> tuple | None:
        """((value of the term), errors) of the best term, or None."""
        if word in self.known:
            return self.known[word]
        at = 0
        if word.isdigit():
            return None
        for ch in fold(word):
            move = self.moves[at].get(ch)
            if move is None:
                new = self._next(self.states[at], ch)
                move = self.index.get(new)
                if move is None:
                    move = self.index[new] = len(self.states)
                    self.states.append(new)
                    self.moves.append({})
                    self.accept.append(self._accepting(new))
                self.moves[at][ch] = move
            at = move
            if not self.states[at]:
                break
        found = self.accept[at] if self.states[at] else None
        if len(self.known) > 1_000_000:
            self.known.clear()
        self.known[word] = found
        return found
