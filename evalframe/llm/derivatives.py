"""Recognition by memoised derivatives of context-free grammars.

A grammar is written as rules in a small notation (``name = 'tok' OTHER rule ( .. | .. )? x* y+``) and must
not be left-recursive. A state is the set of sequences of grammar items that may still follow; its
derivative by a token is computed from the derivatives of its first items. Items, sequences and states
are interned, so equal remainders are one object, and every (state, token) derivative is computed once a
process and then looked up, whatever file it came from. An empty derivative marks the failing token; a
state that cannot end at the end of the input means that the text breaks off.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"'(?:[^'\\]|\\.)+'|[A-Za-z_]\w*|[()|*+?=]")
#: derivatives kept before the table starts anew
KEPT = 1 << 20


class Grammar:
    def __init__(self, text: str, start: str) -> None:
        self.items: list[tuple] = []
        self._item_ids: dict[tuple, int] = {}
        self.kinds: dict[str, int] = {}
        self.rules: dict[str, int] = {}
        for name, body in self._rules(text).items():
            toks = _TOKEN.findall(body)
            item, rest = self._alt(toks, 0)
            if rest != len(toks):
                raise ValueError(f"rule {name}: unread {toks[rest:]}")
            self.rules[name] = item
        unknown = {x[1] for x in self.items if x[0] == "ref"} - set(self.rules)
        if unknown:
            raise ValueError(f"no rules for {sorted(unknown)}")
        self._nullable = self._nullables()
        self._parts: dict[tuple[int, int], frozenset] = {}
        self._first = self._item("ref", start)
        self.reset()

    def reset(self) -> None:
        """Forget all states; the derivatives of single items stay."""
        self._seqs: dict[tuple[int, int], int] = {}
        self._heads: list[tuple[int, int]] = [(-1, -1)]
        self._states: dict[frozenset, int] = {}
        self._members: list[frozenset] = []
        self.moves: dict[tuple[int, int], int] = {}
        self.dead = self._state(frozenset())
        self.start = self._state(frozenset([self._seq(self._first, 0)]))

    # the notation

    @staticmethod
    def _rules(text: str) -> dict[str, str]:
        out: dict[str, str] = {}
        name = ""
        for line in text.splitlines():
            m = re.match(r"(\w+) = (.*)", line)
            if m:
                name = m[1]
                out[name] = m[2]
            elif line.strip():
                out[name] += " " + line.strip()
        return out

    def _item(self, *key) -> int:
        if key not in self._item_ids:
            self._item_ids[key] = len(self.items)
            self.items.append(key)
        return self._item_ids[key]

    def _alt(self, toks: list[str], at: int) -> tuple[int, int]:
        options = []
        while True:
            item, at = self._sequence(toks, at)
            options.append(item)
            if at < len(toks) and toks[at] == "|":
                at += 1
                continue
            return (options[0] if len(options) == 1 else self._item("alt", tuple(options))), at

    def _sequence(self, toks: list[str], at: int) -> tuple[int, int]:
        seq = []
        while at < len(toks) and toks[at] not in "|)":
            t = toks[at]
            at += 1
            if t == "(":
                item, at = self._alt(toks, at)
                at += 1
            elif t[0] == "'" or t.isupper():
                item = self._item("tok", self.kinds.setdefault(t.strip("'"), len(self.kinds)))
            else:
                item = self._item("ref", t)
            while at < len(toks) and toks[at] in "*+?":
                if toks[at] == "?":
                    item = self._item("alt", (item, self._item("seq", ())))
                else:
                    star = self._item("star", item)
                    item = star if toks[at] == "*" else self._item("seq", (item, star))
                at += 1
            seq.append(item)
        return (seq[0] if len(seq) == 1 else self._item("seq", tuple(seq))), at

    # derivatives

    def _nullables(self) -> set[int]:
        done: set[int] = set()
        while True:
            before = len(done)
            for i, (kind, arg) in enumerate(self.items):
                if kind == "star" or kind == "seq" and all(x in done for x in arg) or kind == "alt" and any(x in done for x in arg) or kind == "ref" and self.rules[arg] in done:
                    done.add(i)
            if len(done) == before:
                return done

    def _part(self, item: int, tok: int) -> frozenset:
        """The sequences of items that remain of ``item`` after the token."""
        key = (item, tok)
        found = self._parts.get(key)
        if found is not None:
            return found
        kind, arg = self.items[item]
        out: set[tuple[int, ...]] = set()
        if kind == "tok":
            out = {()} if arg == tok else set()
        elif kind == "ref":
            out = set(self._part(self.rules[arg], tok))
        elif kind == "star":
            out = {(*s, item) for s in self._part(arg, tok)}
        elif kind == "alt":
            for x in arg:
                out |= self._part(x, tok)
        else:
            for k, x in enumerate(arg):
                out |= {s + arg[k + 1 :] for s in self._part(x, tok)}
                if x not in self._nullable:
                    break
        self._parts[key] = frozenset(out)
        return self._parts[key]

    def _seq(self, head: int, tail: int) -> int:
        key = (head, tail)
        if key not in self._seqs:
            self._seqs[key] = len(self._heads)
            self._heads.append(key)
        return self._seqs[key]

    def _state(self, members: frozenset) -> int:
        if members not in self._states:
            self._states[members] = len(self._members)
            self._members.append(members)
        return self._states[members]

    def derive(self, state: int, tok: int) -> int:
        """The state after the token; looked up, or computed and kept."""
        found = self.moves.get((state, tok))
        if found is not None:
            return found
        out: set[int] = set()
        for seq in self._members[state]:
            while seq:
                head, tail = self._heads[seq]
                for part in self._part(head, tok):
                    now = tail
                    for item in reversed(part):
                        now = self._seq(item, now)
                    out.add(now)
                if head not in self._nullable:
                    break
                seq = tail
        found = self.moves[state, tok] = self._state(frozenset(out))
        return found

    def accepts_end(self, state: int) -> bool:
        for seq in self._members[state]:
            while seq and self._heads[seq][0] in self._nullable:
                seq = self._heads[seq][1]
            if not seq:
                return True
        return False

    def failure(self, tokens: list[int]) -> int | None:
        """None if the tokens are a text of the grammar, else the index of the failing token; their number if the text breaks off."""
        if len(self.moves) > KEPT:
            self.reset()
        state, moves = self.start, self.moves
        for i, tok in enumerate(tokens):
            nxt = moves.get((state, tok))
            if nxt is None:
                nxt = self.derive(state, tok)
            if nxt == self.dead:
                return i
            state = nxt
        return None if self.accepts_end(state) else len(tokens)
