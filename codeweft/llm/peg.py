"""Packrat parsing-expression grammars over token kinds.

A grammar is text, one rule a paragraph: ``Name <- expression`` with sequence, ``/`` ordered choice,
``* + ?`` and the predicates ``! &``. Terminals: ``'x'`` a token kind, ``"x"`` a word (a NAME whose
text is x), CAPITALS a kind, ANY, EPS, ``@name`` a predicate on the position. A rule marked ``Name%`` exists
twice, as Name and as NameN; references ``Other%`` inside follow the variant and ``@lit`` holds in the first
only (composite literals are not allowed in the heads of statements).

Each rule is compiled to one Python function with a memo table of its own, so a parse is linear in the
tokens. A set of possible first kinds skips alternatives that cannot match. The parser that tracks the
furthest failure runs only on inputs that the plain one rejects.
"""

from __future__ import annotations

import re

TOKEN = re.compile(r"'[^']+'|\"[^\"]+\"|@\w+|[A-Za-z_]\w*%?|<-|[()/*+?!&]")


def _read(text: str) -> dict:
    """Rules as nested tuples, both variants of the marked ones."""
    rules: dict = {}
    for line in text.replace("\n    ", " ").split("\n"):
        if not line.strip():
            continue
        head, arrow, body = line.partition("<-")
        name = head.strip()
        if not arrow:
            raise ValueError(f"no rule: {line}")
        for variant in ("", "N") if name.endswith("%") else ("",):
            tokens = TOKEN.findall(body)
            node, rest = _choice(tokens, 0, variant)
            if rest != len(tokens):
                raise ValueError(f"{name}: {tokens[rest:]}")
            rules[name.rstrip("%") + variant] = node
    return rules


def _choice(t: list[str], i: int, variant: str) -> tuple:
    node, i = _sequence(t, i, variant)
    options = [node]
    while i < len(t) and t[i] == "/":
        node, i = _sequence(t, i + 1, variant)
        options.append(node)
    return (("alt", options) if len(options) > 1 else options[0]), i


def _sequence(t: list[str], i: int, variant: str) -> tuple:
    parts = []
    while i < len(t) and t[i] not in ("/", ")"):
        prefix = ""
        if t[i] in "!&":
            prefix, i = t[i], i + 1
        if t[i] == "(":
            node, i = _choice(t, i + 1, variant)
        elif t[i][0] == "'":
            node = ("kind", t[i][1:-1])
        elif t[i][0] == '"':
            node = ("word", t[i][1:-1])
        elif t[i][0] == "@":
            node = ("alt", []) if t[i] == "@lit" and variant else ("seq", []) if t[i] == "@lit" else ("test", t[i][1:])
        elif t[i] == "EPS":
            node = ("seq", [])
        elif t[i] == "ANY":
            node = ("any",)
        elif t[i].isupper() and len(t[i]) > 1:
            node = ("kind", t[i])
        else:
            node = ("rule", t[i].rstrip("%") + (variant if t[i].endswith("%") else ""))
        i += 1
        while i < len(t) and t[i] in ("*", "+", "?"):
            node = ({"*": "star", "+": "plus", "?": "opt"}[t[i]], node)
            i += 1
        parts.append(({"!": "not", "&": "and"}[prefix], node) if prefix else node)
    return ("seq", parts) if len(parts) != 1 else parts[0], i


class Grammar:
    """Compiled grammar; parse() gives (accepted, furthest token)."""

    def __init__(self, text: str, start: str, tests: dict):
        self.rules, self.start = _read(text), start
        for name, node in self.rules.items():
            for ref in _refs(node):
                if ref not in self.rules:
                    raise ValueError(f"{name} refers to {ref}, which is not defined")
        self.first: dict = {n: (set(), False) for n in self.rules}
        changed = True
        while changed:
            changed = False
            for n, node in self.rules.items():
                if (now := self._first(node)) != self.first[n]:
                    self.first[n], changed = now, True
        self.tests = tests
        self.plain, self.tracked = self._compile(False), self._compile(True)

    def _first(self, node: tuple) -> tuple:
        """Possible first kinds (None: any) and whether the node can match nothing."""
        kind = node[0]
        if kind == "kind":
            return {node[1]}, False
        if kind == "word":
            return {"NAME"}, False
        if kind == "any":
            return None, False
        if kind == "rule":
            return self.first[node[1]]
        if kind in ("not", "and", "test"):
            return set(), True
        if kind in ("star", "opt"):
            return self._first(node[1])[0], True
        if kind == "plus":
            return self._first(node[1])
        seen: set | None = set()
        if kind == "alt":
            empty = False
            for x in node[1]:
                f, e = self._first(x)
                seen, empty = None if seen is None or f is None else seen | f, empty or e
            return seen, empty
        for x in node[1]:
            f, e = self._first(x)
            seen = None if seen is None or f is None else seen | f
            if not e:
                return seen, False
        return seen, True

    def _compile(self, track: bool) -> dict:
        out: list[str] = []
        env: dict = {"K": [], "V": [], "L": [], "far": [0], **self.tests}
        count = iter(range(1_000_000))

        def fail(p: str) -> str:
            return f"fail({p})" if track else "-1"

        def guard(node: tuple, at: str) -> str | None:
            f, empty = self._first(node)
            if f is None or empty or track:
                return None
            if len(f) == 1:
                return f"{at} == {next(iter(f))!r}"
            env[name := f"F{next(count)}"] = frozenset(f)
            return f"{at} in {name}"

        def gen(node: tuple, d: int) -> None:
            put = lambda s, more=0: out.append(" " * (d + more) + s)
            kind = node[0]
            if kind == "kind":
                put(f"p = p + 1 if K[p] == {node[1]!r} else {fail('p')}")
            elif kind == "word":
                put(f"p = p + 1 if K[p] == 'NAME' and V[p] == {node[1]!r} else {fail('p')}")
            elif kind == "any":
                put(f"p = p + 1 if K[p] != 'EOF' else {fail('p')}")
            elif kind == "test":
                put(f"p = {node[1]}(p, K, V, L)")
            elif kind == "rule":
                put(f"p = R_{node[1]}(p)")
            elif kind == "seq":
                if not node[1]:
                    put("pass")
                for n, x in enumerate(node[1]):
                    if n:
                        out.append(" " * (d + n - 1) + "if p >= 0:")
                    gen(x, d + n)
            elif kind == "alt":
                if not node[1]:
                    put("p = -1")
                    return
                s, k = f"s{next(count)}", f"k{next(count)}"
                put(f"{s} = p; {k} = K[p]; p = -1")
                for n, x in enumerate(node[1]):
                    g = guard(x, k)
                    conditions = (["p < 0"] if n else []) + ([g] if g else [])
                    if conditions:
                        put(f"if {' and '.join(conditions)}:")
                    else:
                        put("if 1:")
                    put(f"p = {s}", 1)
                    gen(x, d + 1)
            elif kind in ("star", "plus"):
                s, g = f"s{next(count)}", guard(node[1], "K[p]")
                if kind == "plus":
                    gen(node[1], d)
                    put("if p >= 0:")
                    d += 1
                put(f"while {g or '1'}:")
                put(f"{s} = p", 1)
                gen(node[1], d + 1)
                put(f"if p <= {s}:", 1)
                put(f"p = {s}; break", 2)
            elif kind == "opt":
                s, g = f"s{next(count)}", guard(node[1], "K[p]")
                put(f"{s} = p")
                put(f"if {g or '1'}:")
                gen(node[1], d + 1)
                put(f"if p < 0: p = {s}")
            elif kind in ("not", "and"):
                s = f"s{next(count)}"
                put(f"{s} = p")
                gen(node[1], d)
                put(f"p = {s} if p {'<' if kind == 'not' else '>='} 0 else {fail(s)}")

        for n, node in self.rules.items():
            g = guard(node, "K[p]")
            out += [f"M_{n} = {{}}", f"def R_{n}(p):"]
            if g:
                out.append(f" if not ({g}): return -1")
            out += [f" r = M_{n}.get(p)", " if r is not None: return r", " q = p"]
            gen(node, 1)
            out += [f" M_{n}[q] = p", " return p"]
        if track:
            env["fail"] = lambda p, far=env["far"]: (far.__setitem__(0, p) if p > far[0] else None, -1)[1]
        exec("\n".join(out), env)
        env["memos"] = [env[f"M_{n}"] for n in self.rules]
        return env

    def _run(self, env: dict, kinds: list[str], words: list[str], breaks: list[bool]) -> bool:
        env["K"], env["V"], env["L"], env["far"][0] = kinds, words, breaks, 0
        for m in env["memos"]:
            m.clear()
        try:
            return env[f"R_{self.start}"](0) >= 0
        finally:
            for m in env["memos"]:
                m.clear()

    def parse(self, kinds: list[str], words: list[str], breaks: list[bool]) -> tuple[bool, int]:
        """Whether the whole input (its last kind is EOF) is a sentence; else the furthest token that failed."""
        n = len(kinds)
        kinds, words, breaks = [*kinds, "", ""], [*words, "", ""], [*breaks, True, True]
        if self._run(self.plain, kinds, words, breaks):
            return True, n - 1
        self._run(self.tracked, kinds, words, breaks)
        return False, min(self.tracked["far"][0], n - 1)


def _refs(node: tuple) -> list[str]:
    if node[0] == "rule":
        return [node[1]]
    if node[0] in ("seq", "alt"):
        return [r for x in node[1] for r in _refs(x)]
    return _refs(node[1]) if node[0] in ("star", "plus", "opt", "not", "and") else []
