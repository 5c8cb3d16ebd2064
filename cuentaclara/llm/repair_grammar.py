"""Cheapest repairs of role sequences: Re-Pair rules, and one min-plus matrix with audit ropes per rule.

A turn is one character: the initial of its role and its fault. A conversation is a word over these. Repairs are paths
through the automaton of ``(s?(ua)+)?``, so a turn is a 4 x 4 matrix of (cost, audit) and a word is the min-plus
product of its turns. Re-Pair replaces frequent pairs of symbols by rules; the matrix of a rule is the product of its two
parts, made once and used wherever the rule occurs. Audits are ropes: a product joins two ropes and copies no letters.

Of equal costs the ASCII-least audit wins. Two different audits of one cost never are prefixes of one another (the longer
one would have more insertions, which cost), so the least audit of a product is made of the least audits of its parts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from cuentaclara.llm.common import ship

ship(__name__)

#: States: nothing yet, after system, after user, after assistant.
STATES = 4
START, ACCEPTED = 0, (0, 3)
NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turn symbols: role initial (o: any other), upper case where the text is truncated; x must be deleted.
TERMINALS = "suaoSUAOx"
#: Steps after which the ropes of a word that is evaluated become leaves.
FLAT = 32


class Rope:
    """Letters as a leaf or as two ropes; the parts are shared, never copied."""

    __slots__ = ("left", "right", "text")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.left, self.right = text, left, right

    def __add__(self, other: Rope) -> Rope:
        if self.left is None and not self.text:
            return other
        if other.left is None and not other.text:
            return self
        return Rope("", self, other)

    def leaves(self) -> Iterator[str]:
        waiting = [self]
        while waiting:
            rope = waiting.pop()
            if rope.left is None:
                if rope.text:
                    yield rope.text
            else:
                waiting += [rope.right, rope.left]

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        """Compared leaf by leaf up to the first difference; nothing is joined."""
        mine, theirs = self.leaves(), other.leaves()
        a = b = ""
        while True:
            a, b = a or next(mine, ""), b or next(theirs, "")
            if not a or not b:
                return not a and bool(b)
            n = min(len(a), len(b))
            if a[:n] != b[:n]:
                return a[:n] < b[:n]
            a, b = a[n:], b[n:]


#: From state i to state j: cost and audit, or None.
Entry = tuple[int, Rope] | None
Matrix = tuple[tuple[Entry, ...], ...]


def better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if b[1] < a[1] else a


def through(row: tuple[Entry, ...], m: Matrix) -> tuple[Entry, ...]:
    """Min-plus product of a row and a matrix."""
    out: list[Entry] = [None] * STATES
    for k, left in enumerate(row):
        if left is not None:
            for j, right in enumerate(m[k]):
                if right is not None:
                    cost = left[0] + right[0]
                    if out[j] is None or cost <= out[j][0]:
                        out[j] = better(out[j], (cost, left[1] + right[1]))
    return tuple(out)


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(through(row, b) for row in a)


def _matrix(entries: list[tuple[int, int, int, str]]) -> Matrix:
    rows: list[list[Entry]] = [[None] * STATES for _ in range(STATES)]
    for i, j, cost, letter in entries:
        rows[i][j] = better(rows[i][j], (cost, Rope(letter)))
    return tuple(tuple(r) for r in rows)


def _step(state: int) -> tuple[str, int]:
    """The only role that an insertion or a new role can give after a state."""
    role = "a" if state == 2 else "u"
    return role, NEXT[role, state]


def _insertions() -> Matrix:
    """Any number of insertions; going round costs and gains nothing, so two are enough."""
    nothing = [(i, i, 0, "") for i in range(STATES)]
    once = _matrix(nothing + [(i, _step(i)[1], INSERT, "I") for i in range(STATES)])
    return product(once, once)


INSERTIONS = _insertions()


def turn(symbol: str) -> Matrix:
    """Insertions, then one edit of the turn."""
    edits = [(i, i, DELETE, "D") for i in range(STATES)]
    if symbol != "x":
        extra = TRUNCATED if symbol.isupper() else 0
        for i in range(STATES):
            kept = NEXT.get((symbol.lower(), i))
            if kept is not None:
                edits.append((i, kept, extra, "K"))
            edits.append((i, _step(i)[1], REROLE + extra, "R"))
    return product(INSERTIONS, _matrix(edits))


@dataclass
class Grammar:
    """Rules in order: symbol, left part, right part. Symbols are single characters."""

    rules: list[tuple[str, str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.matrices = {s: turn(s) for s in TERMINALS}
        for symbol, left, right in self.rules:  # bottom-up: parts come before the rule
            self.matrices[symbol] = product(self.matrices[left], self.matrices[right])

    def compressed(self, word: str) -> str:
        """The word with every rule applied, in order."""
        for symbol, left, right in self.rules:
            if left in word:
                word = word.replace(left + right, symbol)
        return word

    def with_pairs(self, counts: Counter, limit: int) -> Grammar:
        """The grammar and rules for the most frequent pairs that occur twice; pairs of a round share no symbol."""
        rules, taken = list(self.rules), set()
        for pair, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if n < 2 or len(rules) >= limit:
                break
            if not taken & set(pair):
                rules.append((chr(0x100 + len(rules)), pair[0], pair[1]))
                taken |= set(pair)
        return Grammar(rules)

    def word(self, symbols: str) -> Matrix:
        """The matrix of a compressed word."""
        m = INSERTIONS
        for i, s in enumerate(symbols):
            m = product(m, self.matrices[s])
            if i % FLAT == FLAT - 1:
                m = tuple(map(flat, m))
        return m

    def cheapest(self, symbols: str) -> tuple[int, str]:
        """Cost and audit of a whole conversation, given as a compressed word."""
        row = INSERTIONS[START]
        for i, s in enumerate(symbols):
            row = through(row, self.matrices[s])
            if i % FLAT == FLAT - 1:
                row = flat(row)
        return ended(row)


def flat(row: tuple[Entry, ...]) -> tuple[Entry, ...]:
    """The row with each rope as one leaf, so that the ropes of a long word stay shallow."""
    return tuple(e and (e[0], Rope(str(e[1]))) for e in row)


def ended(row: tuple[Entry, ...]) -> tuple[int, str]:
    """The cheapest accepted end of a row that started at the first state."""
    row = through(row, INSERTIONS)
    best = None
    for state in ACCEPTED:
        best = better(best, row[state])
    return best[0], str(best[1])


def pairs(word: str) -> Counter:
    """Adjacent pairs; in a run of one symbol every second one, as they are replaced."""
    found, i = Counter(), 0
    while i + 1 < len(word):
        found[word[i: i + 2]] += 1
        i += 2 if word[i] == word[i + 1] and word[i + 1: i + 3] == word[i: i + 2] else 1
    return found


def packed(m: Matrix) -> list[dict | None]:
    """A matrix as 16 rows for a column."""
    return [None if e is None else {"cost": e[0], "audit": str(e[1])} for row in m for e in row]


def unpacked(entries: list) -> Matrix:
    found = [None if e is None else (e["cost"], Rope(e["audit"])) for e in entries]
    return tuple(tuple(found[i: i + STATES]) for i in range(0, STATES * STATES, STATES))


class Editor:
    """Applies an audit to the turns of a conversation, one after the other."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _new_role(self) -> str:
        role, self.state = _step(self.state)
        return {"u": "user", "a": "assistant"}[role]

    def inserted(self) -> Iterator[str]:
        """Roles of the turns to insert here."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._new_role()

    def edited(self, role: str) -> str | None:
        """The role of the next turn after its edit, None if it is deleted."""
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return None
        if letter == "R":
            return self._new_role()
        self.state = NEXT[role[:1], self.state]
        return role
