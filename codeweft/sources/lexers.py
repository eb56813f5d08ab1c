"""Lexers of the five languages for scanning, parsing and finding functions.

lex() gives parallel lists: kind (a keyword or operator is its own kind), text, start, end and whether a line
break stands before; comments are kept apart. A LexError holds the position and the cause.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class LexError(Exception):
    def __init__(self, at: int, cause: str):
        super().__init__(cause)
        self.at, self.cause = at, cause


@dataclass
class Tokens:
    kinds: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    breaks: list[bool] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)

    def add(self, kind: str, word: str, a: int, b: int, brk: bool = False) -> None:
        self.kinds.append(kind)
        self.words.append(word)
        self.starts.append(a)
        self.ends.append(b)
        self.breaks.append(brk)


# Reserved words and operators of the languages.
PY_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
JS_KEYWORDS = frozenset("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield await enum".split())
GO_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
RUST_KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())

# ---------------------------------------------------------------- python

_PY_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?|[0-9](?:_?[0-9])*[eE][+-]?[0-9](?:_?[0-9])*[jJ]?|[0-9](?:_?[0-9])*[jJ]|(?:0(?:_?0)*|[1-9](?:_?[0-9])*)(?![0-9_]))"
_PY = re.compile(
    rf"""(?P<ws>[ \t\f]+)|(?P<nl>\r\n|\r|\n)|(?P<cm>\#[^\r\n]*)|(?P<join>\\(?:\r\n|\r|\n))
    |(?P<fs>(?:[fF][rR]?|[rR][fF])(?:'''|\"\"\"|'|\"))
    |(?P<str>(?:[rR][bB]?|[bB][rR]?|[uU])?(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|.))*'|\"(?!\"\")(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"))
    |(?P<num>{_PY_NUMBER})|(?P<name>[^\W\d]\w*)
    |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>()\[\]{{}},:.;=])""",
    re.X | re.S,
)
_PY_INDENT = re.compile(r"[ \t\f]*")


def _fstring(t: str, i: int, quote: str, raw: bool) -> int:
    """End of an f-string whose body starts at i; braces must balance."""
    n, triple = len(t), len(quote) == 3
    depth: list[str] = []  # open brackets of replacement fields; 'f' marks a field's format part
    while i < n:
        c = t[i]
        if not depth or depth[-1] == "f":
            if t.startswith(quote, i):
                if depth:
                    raise LexError(i, "brace of an f-string is not closed")
                return i + len(quote)
            if c == "\\":
                i += 2
            elif c == "{" and t.startswith("{{", i) and not depth:
                i += 2
            elif c == "{":
                depth.append("{")
                i += 1
                if re.compile(r"\s*[}!:=]").match(t, i):
                    raise LexError(i, "empty expression in an f-string")
            elif c == "}" and depth:
                depth.pop()  # the format part
                depth.pop()  # its field
                i += 1
            elif c == "}" and t.startswith("}}", i):
                i += 2
            elif c == "}":
                raise LexError(i, "single brace in an f-string")
            elif c in "\r\n" and not triple:
                raise LexError(i, "f-string is not closed")
            else:
                i += 1
        elif c in "([{":
            depth.append(c)
            i += 1
        elif c in ")]}":
            if "([{"[")]}".index(c)] != depth[-1]:
                raise LexError(i, "bracket in an f-string does not match")
            depth.pop()
            i += 1
        elif c == ":" and depth[-1] == "{" and depth.count("{") == 1 and len(depth) == 1:
            depth.append("f")
            i += 1
        elif c in "'\"" or (m := _PY.match(t, i)) and m.lastgroup in ("str", "fs"):
            m = _PY.match(t, i)
            if not m or m.lastgroup not in ("str", "fs"):
                raise LexError(i, "string in an f-string is not closed")
            i = _fstring(t, m.end(), m.group().lstrip("fFrR"), "r" in m.group().lower()) if m.lastgroup == "fs" else m.end()
        else:
            i = m.end() if m and m.end() > i else i + 1
    raise LexError(n, "f-string is not closed")


def lex_python(t: str) -> Tokens:
    if "\0" in t:
        raise LexError(t.index("\0"), "null byte")
    out, n, i = Tokens(), len(t), 1 if t.startswith("﻿") else 0
    indents, depth, fresh = [0], 0, True
    add, match = out.add, _PY.match
    while i < n:
        if fresh and not depth:
            m = _PY_INDENT.match(t, i)
            j = m.end()
            if j < n and t[j] not in "#\r\n" and not (t[j] == "\\" and t[j + 1 : j + 2] in "\r\n"):
                width = len(m.group().rpartition("\f")[2].expandtabs(8))
                if width > indents[-1]:
                    indents.append(width)
                    add("INDENT", "", j, j)
                while width < indents[-1]:
                    indents.pop()
                    add("DEDENT", "", j, j)
                    if width > indents[-1]:
                        raise LexError(j, "dedent matches no indentation")
                fresh = False
                i = j
            elif j >= n:
                i = j
                break
            else:
                i = j
        m = match(t, i)
        if not m:
            raise LexError(i, "string is not closed" if t[i] in "'\"" else f"character {t[i]!r}")
        g, j = m.lastgroup, m.end()
        if g == "name":
            w = m.group()
            add(w if w in PY_KEYWORDS else "NAME", w, i, j)
        elif g == "op":
            w = m.group()
            if w in "([{":
                depth += 1
            elif w in ")]}":
                depth = max(0, depth - 1)
            add(w, w, i, j)
        elif g == "nl":
            if not depth and not fresh:
                add("NEWLINE", "", i, j)
            if not depth:
                fresh = True
        elif g == "str":
            add("BYTES" if "b" in m.group()[:2].lower().split("'")[0].split('"')[0] else "STR", m.group(), i, j)
        elif g == "fs":
            head = m.group()
            j = _fstring(t, j, head.lstrip("fFrR"), "r" in head.lower())
            add("FSTR", t[i:j], i, j)
        elif g == "num":
            if t[j : j + 1].isalpha() and not re.compile(r"(?:and|else|for|if|in|is|not|or)\b").match(t, j) or t[j : j + 1] == "_":
                raise LexError(j, "number runs into a name")
            add("NUM", m.group(), i, j)
        elif g == "cm":
            out.comments.append((i, j))
        i = j
    if out.kinds and not depth and out.kinds[-1] not in ("NEWLINE", "DEDENT") and not fresh:
        add("NEWLINE", "", n, n)
    for _ in indents[1:]:
        add("DEDENT", "", n, n)
    add("EOF", "", n, n)
    return out


# ---------------------------------------------------------------- javascript and typescript

_JS_NUMBER = r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:(?:0|[1-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?|(?:0|[1-9](?:_?[0-9])*)n)"
_JS = re.compile(
    rf"""(?P<ws>[ \t\v\f ﻿]+)|(?P<nl>\r\n|[\r\n  ])|(?P<cm>//[^\r\n  ]*|/\*.*?\*/)
    |(?P<str>'(?:[^'\\\r\n]|\\(?:\r\n|.))*'|"(?:[^"\\\r\n]|\\(?:\r\n|.))*")|(?P<tpl>`)
    |(?P<num>(?:0|[1-9](?:_?[0-9])*)n(?!\w)|{_JS_NUMBER}n?)|(?P<name>(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{{4}})(?:[\w$‌‍]|\\u[0-9a-fA-F]{{4}})*)|(?P<priv>\#[^\W\d][\w$]*|\#[$][\w$]*)
    |(?P<op>\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|\*\*|\?\?|\?\.(?![0-9])|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||<<|[-+*/%&|^~!?:=<>()\[\]{{}},.;@])""",
    re.X | re.S,
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_VALUE_ENDS = frozenset(["NAME", "NUM", "STR", "REGEX", "TN", "TT", "PRIV", ")", "]", "this", "super", "null", "true", "false", "++", "--"])


def lex_javascript(t: str) -> Tokens:
    out, n, i = Tokens(), len(t), 0
    if t.startswith("#!"):
        i = len(re.compile(r"[^\r\n]*").match(t).group())
    add, match, brk, last, braces, heads = out.add, _JS.match, False, "", [], []
    while i < n:
        m = match(t, i)
        g = m.lastgroup if m else ""
        if g == "ws":
            i = m.end()
            continue
        if g == "nl":
            brk, i = True, m.end()
            continue
        if g == "cm":
            out.comments.append((i, m.end()))
            brk = brk or m.group()[1] == "*" and any(c in m.group() for c in "\r\n  ")
            i = m.end()
            continue
        if t[i] == "/" and last not in _VALUE_ENDS:
            if r := _JS_REGEX.match(t, i):
                add(last := "REGEX", r.group(), i, r.end(), brk)
                i, brk = r.end(), False
                continue
            if t.startswith("/*", i):
                raise LexError(i, "comment is not closed")
            raise LexError(i, "regular expression is not closed")
        if not m:
            raise LexError(i, "string is not closed" if t[i] in "'\"" else f"character {t[i]!r}")
        j, w = m.end(), m.group()
        if g == "op" and w == "/" and t.startswith("/*", i):
            raise LexError(i, "comment is not closed")
        if g == "name":
            last = w if w in JS_KEYWORDS and last not in (".", "?.") else "NAME"
            add(last, w, i, j, brk)
        elif g == "tpl" or g == "op" and w == "}" and braces and braces[-1] == "$":
            head = g == "tpl"
            m = _TEMPLATE.match(t, i + 1)
            if not m:
                raise LexError(i, "template is not closed")
            if not head:
                braces.pop()
            end = m.group(1) == "`"
            if not end:
                braces.append("$")
            last, j = ("TN" if end else "TH") if head else ("TT" if end else "TM"), m.end()
            add(last, t[i:j], i, j, brk)
        elif g == "op":
            if w == "{":
                braces.append("{")
            elif w == "}" and braces:
                braces.pop()
            elif w == "(":
                heads.append(last in ("if", "while", "for", "with"))
            add(w, w, i, j, brk)
            last = "head" if w == ")" and heads and heads.pop() else w  # a regular expression may follow a head
        elif g == "num":
            if t[j : j + 1].isalnum() or t[j : j + 1] in ("_", "$"):
                raise LexError(j, "number runs into a name")
            add(last := "NUM", w, i, j, brk)
        else:
            last = {"str": "STR", "priv": "PRIV"}[g]
            add(last, w, i, j, brk)
        i, brk = j, False
    add("EOF", "", n, n, True)
    return out


# ---------------------------------------------------------------- go

_GO_ESC = r"""\\(?:[abfnrtv\\'"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"""
_GO = re.compile(
    rf"""(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<cm>//[^\n]*|/\*.*?\*/)
    |(?P<str>"(?:[^"\\\n]|{_GO_ESC})*"|`[^`]*`)|(?P<char>'(?:[^'\\\n]|{_GO_ESC})')
    |(?P<num>(?:0[xX](?:_?[0-9a-fA-F])*(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?(?:[pP][+-]?[0-9]+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)i?)
    |(?P<name>[^\W\d]\w*)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^~<>=!()\[\]{{}},;.:])""",
    re.X | re.S,
)
_GO_ENDS = frozenset(["NAME", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def lex_go(t: str) -> Tokens:
    out, n, i = Tokens(), len(t), 1 if t.startswith("﻿") else 0
    add, match, last = out.add, _GO.match, ""
    while i < n:
        m = match(t, i)
        if not m:
            raise LexError(i, "literal is not closed" if t[i] in "'\"`" else f"character {t[i]!r}")
        g, j, w = m.lastgroup, m.end(), m.group()
        if g == "nl" or g == "cm" and w[1] == "*" and "\n" in w:
            if last in _GO_ENDS:
                add(";", "\n", i, i)
                last = ";"
        if g == "name":
            last = w if w in GO_KEYWORDS else "NAME"
            add(last, w, i, j)
        elif g == "op":
            if w == "/" and t.startswith("/*", i):
                raise LexError(i, "comment is not closed")
            add(w, w, i, j)
            last = w
        elif g == "cm":
            out.comments.append((i, j))
        elif g in ("str", "char", "num"):
            if g == "num" and (t[j : j + 1].isalnum() or t[j : j + 1] == "_"):
                raise LexError(j, "number runs into a name")
            last = {"str": "STR", "char": "CHAR", "num": "NUM"}[g]
            add(last, w, i, j)
        i = j
    if last in _GO_ENDS:
        add(";", "\n", n, n)
    add("EOF", "", n, n)
    return out


# ---------------------------------------------------------------- rust

_RS_ESC = r"\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\})"
_RUST = re.compile(
    rf"""(?P<ws>\s+)|(?P<cm>//[^\n]*)|(?P<block>/\*)
    |(?P<rstr>(?:b|c)?r\#*")|(?P<str>(?:b|c)?"(?:[^"\\]|{_RS_ESC}|\\(?:\r?\n)\s*)*")|(?P<char>b?'(?:[^'\\\n\r\t]|{_RS_ESC})')|(?P<life>'[^\W\d]\w*)
    |(?P<num>(?:0x[0-9a-fA-F_]*[0-9a-fA-F][0-9a-fA-F_]*|0o[0-7_]*[0-7][0-7_]*|0b[01_]*[01][01_]*)(?:[iu](?:8|16|32|64|128|size))?|[0-9][0-9_]*(?:\.[0-9][0-9_]*(?:[eE][+-]?_*[0-9][0-9_]*)?|[eE][+-]?_*[0-9][0-9_]*|\.(?![.\w]))?(?:_*(?:f32|f64|[iu](?:8|16|32|64|128|size)))?)
    |(?P<name>(?:r\#)?[^\W\d]\w*)
    |(?P<op><<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.\.|<<|[-+*/%&|^~<>=!?@()\[\]{{}},;.:\#$])""",
    re.X | re.S,
)
_RS_COMMENT = re.compile(r"/\*|\*/")


def lex_rust(t: str) -> Tokens:
    out, n, i = Tokens(), len(t), 1 if t.startswith("﻿") else 0
    if t.startswith("#!", i) and not re.compile(r"#!\s*\[").match(t, i):
        i = (t + "\n").index("\n", i)
    add, match = out.add, _RUST.match
    while i < n:
        m = match(t, i)
        if not m:
            raise LexError(i, "literal is not closed" if t[i] in "'\"" else f"character {t[i]!r}")
        g, j, w = m.lastgroup, m.end(), m.group()
        if g == "name":
            add(w if w in RUST_KEYWORDS else "NAME", w, i, j)
        elif g == "op":
            add(w, w, i, j)
        elif g == "cm":
            out.comments.append((i, j))
        elif g == "block":
            depth = 1
            while depth:
                c = _RS_COMMENT.search(t, j)
                if not c:
                    raise LexError(i, "comment is not closed")
                depth, j = depth + (1 if c.group() == "/*" else -1), c.end()
            out.comments.append((i, j))
        elif g == "rstr":
            close = '"' + "#" * w.count("#")
            j = t.find(close, j)
            if j < 0:
                raise LexError(i, "raw string is not closed")
            j += len(close)
            add("STR", t[i:j], i, j)
        elif g != "ws":
            if g == "num" and (t[j : j + 1].isalnum() or t[j : j + 1] == "_"):
                raise LexError(j, "number runs into a name")
            add({"str": "STR", "char": "CHAR", "life": "LIFE", "num": "NUM"}[g], w, i, j)
        i = j
    add("EOF", "", n, n)
    return out


LEXERS = {"python": lex_python, "javascript": lex_javascript, "typescript": lex_javascript, "go": lex_go, "rust": lex_rust}
