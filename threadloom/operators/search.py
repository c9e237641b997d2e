"""Full-text queries compiled to Columns.

The language is that of SQLite's FTS5: terms, "phrases", a + b, prefix*, ^start, AND, OR, NOT, NEAR(a b, n),
parentheses and column filters (`text: x`, `{role text}: x`, `- role: x`). Terms that stand side by side are
joined by AND and bind tightest, then NOT, AND, OR. Tokens are runs of letters, numbers and private-use
characters, lower-cased and without diacritics. Nothing is joined or shuffled: a query is a filter.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class QuerySyntaxError(ValueError):
    """The text is not a query."""


def _plain() -> tuple[str, str]:
    """Lower-case letters with marks, and the letters without; combining marks, which fall away, come last."""
    pairs = []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(c))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(x) for x in base[1:]):
            pairs.append((chr(c), base[0]))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


_FROM, _TO = _plain()
_FOLD = str.maketrans({**dict(zip(_FROM, _TO)), **{c: None for c in _FROM[len(_TO) :]}})


def token_list(text: str) -> list[str]:
    text = text.lower().translate(_FOLD)
    return "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in text).split()


def token_column(text: Column) -> Column:
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), _FROM, _TO)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), lambda x: x != "")


_LEX = re.compile(r'\s*(?:(?P<str>"(?:[^"]|"")*")|(?P<word>[\w\x1a]+)|(?P<op>[(){}:+*^,-]))', re.UNICODE)


class _Parser:
    def __init__(self, text: str, columns: tuple[str, ...]):
        self.tokens: list[tuple[str, str]] = []
        self.columns, self.at = columns, 0
        text, i = text.rstrip(), 0
        while i < len(text):
            m = _LEX.match(text, i)
            if not m:
                raise QuerySyntaxError(f"syntax error near {text[i:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            i = m.end()
        if not self.tokens:
            raise QuerySyntaxError("the query is empty")

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if t[0] == "end" or value is not None and t[1] != value:
            raise QuerySyntaxError(f"syntax error near {t[1]!r}" if t[1] else "the query ends too early")
        self.at += 1
        return t

    def parse(self):
        out = self.either(self.columns)
        if self.peek()[0] != "end":
            raise QuerySyntaxError(f"syntax error near {self.peek()[1]!r}")
        return out

    def is_word(self, w: str) -> bool:
        return self.peek() == ("word", w)

    def either(self, cols):
        out = self.both(cols)
        while self.is_word("OR"):
            self.take()
            out = ("or", out, self.both(cols))
        return out

    def both(self, cols):
        out = self.without(cols)
        while self.is_word("AND"):
            self.take()
            out = ("and", out, self.without(cols))
        return out

    def without(self, cols):
        out = self.beside(cols)
        while self.is_word("NOT"):
            self.take()
            out = ("not", out, self.beside(cols))
        return out

    def beside(self, cols):
        out = self.unit(cols)
        while (t := self.peek())[0] in ("str", "word") and t[1] not in ("AND", "OR", "NOT") or t[1] in ("(", "{", "^", "-"):
            out = ("and", out, self.unit(cols))
        return out

    def filter(self) -> tuple[str, ...] | None:
        start, inverse, names = self.at, False, []
        if self.peek()[1] == "-" and self.peek()[0] == "op":
            self.take()
            inverse = True
        if self.peek()[1] == "{":
            self.take()
            while self.peek()[1] != "}":
                names.append(self.take()[1].strip('"'))
            self.take()
        elif self.peek()[0] in ("word", "str") and self.peek(1)[1] == ":":
            names.append(self.take()[1].strip('"'))
        if self.peek()[1] != ":" or not names:
            if inverse or names:
                raise QuerySyntaxError("a column filter needs a colon")
            self.at = start
            return None
        self.take()
        for n in names:
            if n.lower() not in self.columns:
                raise QuerySyntaxError(f"no such column: {n}")
        names = [n.lower() for n in names]
        return tuple(c for c in self.columns if (c in names) != inverse)

    def unit(self, cols):
        own = self.filter()
        if own is not None:
            cols = tuple(c for c in cols if c in own)
            return self.unit(cols) if self.peek()[1] in ("{", "-") or self.peek(1)[1] == ":" else self.group(cols)
        return self.group(cols)

    def group(self, cols):
        if self.peek()[1] == "(":
            self.take()
            out = self.either(cols)
            self.take(")")
            return out
        if self.is_word("NEAR") and self.peek(1)[1] == "(":
            self.take()
            self.take()
            phrases, n = [], 10
            while self.peek()[1] not in (")", ","):
                phrases.append(self.phrase())
            if self.peek()[1] == ",":
                self.take()
                n = self.take()[1]
                if not str(n).isdigit():
                    raise QuerySyntaxError("NEAR needs a number")
            self.take(")")
            return ("near", cols, [p for p in phrases if p[0]], int(n))
        return ("phrase", cols, self.phrase())

    def phrase(self) -> tuple[tuple[str, ...], bool, bool]:
        first = False
        if self.peek()[1] == "^":
            self.take()
            first = True
        words: list[str] = []
        while True:
            kind, t = self.take()
            if kind == "word":
                if t in ("AND", "OR", "NOT"):
                    raise QuerySyntaxError(f"syntax error near {t!r}")
                words += token_list(t)
            elif kind == "str":
                words += token_list(t[1:-1].replace('""', '"'))
            else:
                raise QuerySyntaxError(f"syntax error near {t!r}")
            if self.peek()[1] != "+":
                break
            self.take()
        prefix = self.peek()[1] == "*"
        if prefix:
            self.take()
        return tuple(words), prefix, first


def parse(query: str, columns: tuple[str, ...] = ("role", "text")):
    return _Parser(query, columns).parse()


def _word(token: Column, word: str, prefix: bool) -> Column:
    return F.startswith(token, F.lit(word)) if prefix else token == word


def _starts_at(tokens: Column, i: Column, phrase) -> Column:
    words, prefix, _ = phrase
    tests = [_word(F.get(tokens, i + k), w, prefix and k == len(words) - 1) for k, w in enumerate(words)]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def _phrase(tokens: Column, phrase) -> Column:
    words, prefix, first = phrase
    if not words:
        return F.lit(False)
    if first:
        return _starts_at(tokens, F.lit(0), phrase)
    if len(words) == 1:
        return F.exists(tokens, lambda t: _word(t, words[0], prefix)) if prefix else F.array_contains(tokens, words[0])
    return F.exists(F.sequence(F.lit(0), F.size(tokens)), lambda i: _starts_at(tokens, i, phrase))


def _near(tokens: Column, phrases, n: int) -> Column:
    if not phrases:
        return F.lit(False)
    if len(phrases) == 1:
        return _phrase(tokens, phrases[0])
    places = F.sequence(F.lit(0), F.size(tokens))

    def go(k: int, last: Column | None, end: Column | None) -> Column:
        if k == len(phrases):
            return last - end <= n
        size = len(phrases[k][0])
        return F.exists(places, lambda i: _starts_at(tokens, i, phrases[k]) & go(k + 1, i if last is None else F.greatest(last, i), i + size if end is None else F.least(end, i + size)))

    return go(0, None, None)


def _compiled(node, tokens: dict[str, Column]) -> Column:
    kind = node[0]
    if kind in ("and", "or", "not"):
        a, b = _compiled(node[1], tokens), _compiled(node[2], tokens)
        return a & b if kind == "and" else a | b if kind == "or" else a & ~b
    tests = [_phrase(tokens[c], node[2]) if kind == "phrase" else _near(tokens[c], node[2], node[3]) for c in node[1]]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def matches(query: str, columns: dict[str, Column], are_tokens: bool = False) -> Column:
    """Whether a row matches; each column is cut into tokens once, or are_tokens: is an array of them."""
    tree = parse(query, tuple(columns))
    tokens = F.struct(*((c if are_tokens else token_column(c)).alias(n) for n, c in columns.items()))
    return F.transform(F.array(tokens), lambda s: _compiled(tree, {n: s[n] for n in columns}))[0]
