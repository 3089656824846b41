"""Cheapest edits that give a conversation its form: a small automaton and a persistent store of audit strings.

Pure Python helpers of ``conversations``; they see the rows of one segment, or the segments of one conversation.
"""

from __future__ import annotations

#: Automaton of ``(s?(ua)+)?`` over role initials: nothing yet, after s, after u, after a. Nothing and after a accept.
NOTHING, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
NEXT = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: Every state allows exactly one of user and assistant next: what a rerole or an insert makes.
FREE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
FREE_ROLE = ("user", "user", "assistant", "user")
LEGAL = ("su", "ua", "au")

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

_BASE, _MODULUS = 1_000_003, (1 << 61) - 1


class Audits:
    """Strings as linked nodes: a node adds letters to its parent, so that prefixes are shared.

    Every node knows its ancestors 1, 2, 4, ... steps up and the rolling hash of its whole string. Two strings are ordered by the
    letters after their longest common prefix, which is searched by the hashes; a prefix that hashes call equal is verified
    by walking both chains back to the node they share.
    """

    def __init__(self) -> None:
        self.letters, self.length, self.hash, self.up = [""], [0], [0], [()]

    def add(self, parent: int, letters: str) -> int:
        value = self.hash[parent]
        for letter in letters:
            value = (value * _BASE + ord(letter)) % _MODULUS
        above, ups, at = parent, [], 0
        while True:
            ups.append(above)
            if at >= len(self.up[above]):
                break
            above, at = self.up[above][at], at + 1
        self.letters.append(letters)
        self.length.append(self.length[parent] + len(letters))
        self.hash.append(value)
        self.up.append(tuple(ups))
        return len(self.letters) - 1

    def cover(self, node: int, length: int) -> int:
        """The highest ancestor (or the node itself) whose string is at least so long."""
        for at in range(len(self.up[node]) - 1, -1, -1):
            while at < len(self.up[node]) and self.length[self.up[node][at]] >= length:
                node = self.up[node][at]
        return node

    def start(self, node: int) -> int:
        return self.length[node] - len(self.letters[node])

    def prefix_hash(self, node: int, length: int) -> int:
        node = self.cover(node, length)
        if self.length[node] == length:
            return self.hash[node]
        value = self.hash[self.up[node][0]]
        for letter in self.letters[node][: length - self.start(node)]:
            value = (value * _BASE + ord(letter)) % _MODULUS
        return value

    def equal(self, a: int, b: int, length: int) -> bool:
        """Whether two prefixes are equal, letter by letter."""
        a, b = self.cover(a, length), self.cover(b, length)
        while length and a != b:
            begin = max(self.start(a), self.start(b))
            mine, other = (self.letters[n][begin - self.start(n) : length - self.start(n)] for n in (a, b))
            if mine != other:
                return False
            length = begin
            a, b = (self.up[n][0] if length and self.start(n) == length else n for n in (a, b))
        return True

    def common(self, a: int, b: int) -> int:
        """Length of the longest common prefix."""
        low, high = 0, min(self.length[a], self.length[b])
        while low < high:
            middle = (low + high + 1) // 2
            if self.prefix_hash(a, middle) == self.prefix_hash(b, middle):
                low = middle
            else:
                high = middle - 1
        if self.equal(a, b, low):
            return low
        mine, other = self.text(a), self.text(b)  # equal hashes of different prefixes
        return next(i for i, (x, y) in enumerate(zip(mine, other)) if x != y)

    def letter(self, node: int, at: int) -> str:
        node = self.cover(node, at + 1)
        return self.letters[node][at - self.start(node)]

    def less(self, a: int, b: int) -> bool:
        n = self.common(a, b)
        if n in (self.length[a], self.length[b]):
            return self.length[a] < self.length[b]
        return self.letter(a, n) < self.letter(b, n)

    def text(self, node: int) -> str:
        parts = []
        while node:
            parts.append(self.letters[node])
            node = self.up[node][0]
        return "".join(reversed(parts))


Best = list["tuple[int, int] | None"]  # cost and audit by state


def offer(audits: Audits, best: Best, state: int, cost: int, parent: int, letters: str) -> bool:
    """Keep the cheaper way to a state; of equal costs the ASCII-least audit."""
    now = best[state]
    if now is not None and now[0] < cost:
        return False
    node = audits.add(parent, letters)
    if now is not None and now[0] == cost and not audits.less(node, now[1]):
        return False
    best[state] = (cost, node)
    return True


def insert(audits: Audits, best: Best) -> None:
    """Inserts that reach a state cheaper, or with a lesser audit."""
    changed = True
    while changed:
        changed = False
        for state in STATES:
            if best[state] is not None:
                cost, node = best[state]
                changed |= offer(audits, best, FREE[state], cost + INSERT, node, "I")


def read(audits: Audits, best: Best, initial: str, faulty: bool, truncated: bool) -> Best:
    """The ways after one more row; ``faulty`` rows (blank, duplicate) must go."""
    after: Best = [None] * 4
    for state in STATES:
        if best[state] is None:
            continue
        cost, node = best[state]
        offer(audits, after, state, cost + DELETE, node, "D")
        if faulty:
            continue
        cost += TRUNCATED * truncated
        kept = NEXT.get((state, initial))
        if kept is not None:
            offer(audits, after, kept, cost, node, "K")
        if kept != FREE[state]:
            offer(audits, after, FREE[state], cost + REROLE, node, "R")
    insert(audits, after)
    return after


def cheapest(audits: Audits, best: Best) -> tuple[int, str]:
    """Cost and audit of the best accepted way."""
    ends = [b for b in (best[NOTHING], best[AFTER_A]) if b is not None]
    chosen = ends[0]
    for end in ends[1:]:
        if end[0] < chosen[0] or end[0] == chosen[0] and audits.less(end[1], chosen[1]):
            chosen = end
    return chosen[0], audits.text(chosen[1])


class Segment:
    """Consecutive rows of a conversation: cheapest audits from every state it may begin in to every state it may end in."""

    def __init__(self, begins_conversation: bool) -> None:
        self.audits = Audits()
        self.ways: dict[int, Best] = {}
        for state in [NOTHING] if begins_conversation else STATES:
            best: Best = [None] * 4
            best[state] = (0, 0)
            insert(self.audits, best)
            self.ways[state] = best
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = ""
        self.first_turn: int | None = None
        self.last_turn: int | None = None

    def add(self, initial: str, turn: int | None, blank: bool, duplicate: bool, truncated: bool) -> None:
        cut = truncated and not blank and not duplicate
        for state in self.ways:
            self.ways[state] = read(self.audits, self.ways[state], initial, blank or duplicate, cut)
        if self.rows:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        self.rows += 1
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += cut
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def moves(self) -> list[dict]:
        return [
            {"entry": entry, "exit": state, "cost": way[0], "audit": self.audits.text(way[1])}
            for entry, best in self.ways.items()
            for state, way in enumerate(best)
            if way is not None
        ]


class Conversation:
    """Segments of a conversation in their order, put together."""

    def __init__(self) -> None:
        self.audits = Audits()
        self.best: Best = [(0, 0), None, None, None]
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.last: str | None = None
        self.first_turn: int | None = None
        self.last_turn: int | None = None

    def add(self, s: dict) -> None:
        after: Best = [None] * 4
        for move in s["moves"]:
            before = self.best[move["entry"]]
            if before is not None:
                offer(self.audits, after, move["exit"], before[0] + move["cost"], before[1], move["audit"])
        self.best = after
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + s[name])
        if self.last is not None:
            self.illegal += self.last + s["first"] not in LEGAL
        self.last = s["last"]
        if s["first_turn"] is not None:
            self.turns += s["turns"] - (s["first_turn"] == self.last_turn)
            self.first_turn = s["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = s["last_turn"]

    def gaps(self) -> int:
        """Turns missing between the first and the last, as 64-bit arithmetic has it."""
        if self.first_turn is None:
            return 0
        gaps = self.last_turn - self.first_turn + 1 - self.turns
        return (gaps + (1 << 63)) % (1 << 64) - (1 << 63)
