"""Reads an answer that should be an SQL query: unwraps it and tells whether the statement in it is complete.

A small recursive-descent reader of SELECT statements; it knows no names and no types. ``read`` returns
"complete", "broken" (the text ends where the statement needs more) or "foreign" (something else stands there).
"""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"""(?P<space>[\s​﻿­]+)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<open>/\*.*\Z)
    |(?P<string>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`[^`]*`|\[[^\]\n]*\])
    |(?P<cut>['"`].*\Z|\[[^\]]*\Z)
    |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<word>[^\W\d]\w*)
    |(?P<dots>\.\.\.+|…)
    |(?P<op><>|!=|>=|<=|==|\|\||::|[-+*/%=<>(),.;&|^~?:@\#$!{}\[\]\\])
    |(?P<other>.)""",
    re.X | re.S,
)
FENCE = re.compile(r"```[ \t]*\w*[ \t]*\n?|```")
#: Words of the language that end an operand or alias.
RESERVED = frozenset("select from where group having order limit offset union intersect except on join inner left right full cross outer natural using and or not in is like between case when then else end as by asc desc distinct all with exists null fetch glob escape collate over set values".split())
JOINS = frozenset("join inner left right full cross outer natural".split())
#: Words that may stand where a statement goes on.
CONTINUE = ("where", "group", "having", "order", "limit", "offset", "union", "intersect", "except", "join", "inner", "left", "right", "full", "cross", "natural", "and", "or", "like", "between", "in", "is", "not", "as", "asc", "desc", "on", "from", "then", "else", "end", "when", "by", "nulls")
#: Further words of SQL dialects, which the reader doesn't know.
EXTRA = frozenset("nulls over partition window rows range qualify top ilike rlike regexp similar to any some array lateral for update returning tablesample pivot unpivot unnest rollup cube filter within if cast interval recursive materialized connect start prior match against force ignore use index only ties percent first last next row div mod xor isnull notnull match_recognize insert into delete create values option semi anti cluster distribute sort minus straight_join sample".split())
KNOWN = RESERVED | EXTRA
LEAD = re.compile(r"(?is)(?:^|\n|[:!.]\s)\s*(?=(?:select|with)\b)")


class Broken(Exception):
    """The text ends within the statement."""


class Foreign(Exception):
    """Something stands there that is no part of a statement."""


def unfence(text: str) -> str:
    """Without code fences."""
    return FENCE.sub("\n", text) if "```" in text else text


def uncomment(text: str) -> str:
    """Only what stands in no comment."""
    return "".join(m.group() for m in TOKEN.finditer(text) if m.lastgroup not in ("comment", "open"))


def comments(text: str) -> str:
    """Only what stands in comments, without their marks."""
    return " ".join(m.group().lstrip("-/*").rstrip("*/") for m in TOKEN.finditer(text) if m.lastgroup in ("comment", "open"))


class Reader:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        for m in TOKEN.finditer(text):
            kind = m.lastgroup
            if kind in ("space", "comment"):
                continue
            self.tokens.append((kind, m.group().lower() if kind == "word" else m.group()))
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        """The token's text, marked by kind for literals; "" at the end."""
        k = self.at + ahead
        if k >= len(self.tokens):
            return ""
        kind, text = self.tokens[k]
        if kind in ("cut", "open", "dots"):
            return ""
        return text if kind in ("word", "op") else f"<{kind}>"

    def next(self) -> str:
        token = self.peek()
        if not token:
            raise Broken
        self.at += 1
        return token

    def has(self, *words: str) -> bool:
        if self.peek() in words:
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        token = self.peek()
        if token == word:
            self.at += 1
        elif not token or self.last_begins(word):
            raise Broken
        else:
            raise Foreign

    def last_begins(self, *words: str) -> bool:
        """Whether the last token is the beginning of one of the words, cut off."""
        ends = self.at + 1 >= len(self.tokens) or not self.peek(1)
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        return ends and kind == "word" and any(w != text and w.startswith(text) for w in words)

    def is_name(self) -> bool:
        token = self.peek()
        return token == "<name>" or (bool(token) and (token[0].isalpha() or token[0] == "_") and token not in RESERVED)

    def statement(self) -> None:
        if self.has("with"):
            self.has("recursive")
            while True:
                self.name()
                if self.peek() == "(":
                    self.brackets(self.names)
                self.need("as")
                self.brackets(self.query)
                if not self.has(","):
                    break
        self.query()

    def brackets(self, inside: object) -> None:
        self.need("(")
        inside()
        self.need(")")

    def name(self) -> None:
        if not self.is_name():
            raise Broken if not self.peek() else Foreign
        self.at += 1

    def names(self) -> None:
        self.name()
        while self.has(","):
            self.name()

    def query(self) -> None:
        self.core()
        while self.has("union", "intersect", "except"):
            self.has("all", "distinct")
            self.core()
        if self.has("order"):
            self.need("by")
            self.listed(self.ordered)
        if self.has("limit"):
            self.value()
            if self.has("offset", ","):
                self.value()
        if self.has("offset"):
            self.value()
            self.has("rows", "row")
        if self.has("fetch"):
            while self.peek() and self.peek() not in (";", ")"):
                self.at += 1

    def core(self) -> None:
        if self.peek() == "(":
            self.brackets(self.query)
            return
        if self.has("values"):
            self.listed(lambda: self.brackets(lambda: self.listed(self.expression)))
            return
        self.need("select")
        self.has("distinct", "all")
        if self.peek() == "top" and self.peek(1) == "<number>":
            self.at += 2
        begin = self.at
        self.listed(self.item)
        plain = any(kind in ("word", "name") and text not in RESERVED and text not in ("true", "false", "current_date", "current_timestamp") and self.follows(k) != "(" for k, (kind, text) in enumerate(self.tokens[begin : self.at], begin) if kind in ("word", "name") and not (k > begin and self.tokens[k - 1][1] == "as"))
        starred = any(text == "*" and (k == begin or self.tokens[k - 1][1] in (",", "(", ".")) for k, (_, text) in enumerate(self.tokens[begin : self.at], begin))
        if self.has("from"):
            self.source()
            while True:
                if self.has(","):
                    self.source()
                elif self.peek() in JOINS:
                    while self.has("inner", "left", "right", "full", "cross", "outer", "natural"):
                        pass
                    self.need("join")
                    self.source()
                    if self.has("on"):
                        self.condition()
                    elif self.has("using"):
                        self.brackets(self.names)
                    elif not self.peek() and self.at >= 4 and self.tokens[self.at - 2][1] == "as":
                        raise Broken
                else:
                    break
        elif plain or starred:
            raise Broken if not self.peek() or self.peek() == ")" or self.last_begins("from") else Foreign
        if self.has("where"):
            self.condition()
        if self.has("group"):
            self.need("by")
            self.listed(self.expression)
        if self.has("having"):
            self.condition()

    def follows(self, k: int) -> str:
        return self.tokens[k + 1][1] if k + 1 < len(self.tokens) else ""

    def listed(self, one: object) -> None:
        one()
        while self.has(","):
            one()

    def item(self) -> None:
        if self.has("*"):
            return
        self.expression()
        if self.has("as"):
            if self.peek() == "<string>":
                self.at += 1
            else:
                self.name()
        elif self.is_name():
            if self.last_begins(*CONTINUE):
                raise Broken
            self.at += 1

    def source(self) -> None:
        if self.peek() == "(":
            self.brackets(self.query if self.peek(1) in ("select", "with", "values", "(") else self.source)
        else:
            self.name()
            while self.has("."):
                self.name()
            if self.peek() == "(":
                self.arguments()
        if self.has("as"):
            self.name()
        elif self.is_name():
            if self.last_begins(*CONTINUE):
                raise Broken
            self.at += 1

    def ordered(self) -> None:
        self.expression()
        if self.has("collate"):
            self.name()
        self.has("asc", "desc")
        if self.has("nulls"):
            if not self.has("first", "last"):
                raise Broken if not self.peek() else Foreign

    def condition(self) -> None:
        """An expression that decides something: not a bare column, number or call at the end of the text."""
        if not self.expression() and not self.peek():
            raise Broken

    def expression(self) -> bool:
        """Whether its last part is a condition."""
        decides = self.unary()
        while self.has("and", "or"):
            decides = self.unary()
        return decides

    def unary(self) -> bool:
        if self.has("not"):
            return self.unary()
        if self.has("exists"):
            self.brackets(self.query)
            return True
        decides = self.value()
        while True:
            if self.has("=", "<>", "!=", "<", ">", "<=", ">=", "=="):
                self.has("all", "any", "some")
                self.value()
                decides = True
                continue
            if self.has("is"):
                self.has("not")
                if not self.has("null", "true", "false", "unknown"):
                    if self.has("distinct"):
                        self.need("from")
                    elif self.last_begins("null", "true", "false", "not", "distinct"):
                        raise Broken
                    self.value()
                decides = True
                continue
            negated = self.peek() == "not" and self.peek(1) in ("in", "like", "between", "glob", "")
            if negated:
                self.at += 1
                if not self.peek():
                    raise Broken
            if self.has("in"):
                self.need("(")
                if self.peek() in ("select", "with"):
                    self.statement()
                elif self.peek() != ")":
                    self.listed(self.expression)
                self.need(")")
            elif self.has("like", "glob", "ilike"):
                self.value()
                if self.has("escape"):
                    self.value()
            elif self.has("between"):
                self.value()
                self.need("and")
                self.value()
            elif negated:
                raise Foreign
            else:
                return decides
            decides = True

    def value(self) -> bool:
        decides = self.operand()
        while True:
            if self.has("+", "-", "*", "/", "%", "||", "&", "|"):
                decides = self.operand()
            elif self.has("::", "collate"):
                self.name()
            else:
                return decides

    def arguments(self) -> None:
        self.need("(")
        self.has("distinct", "all")
        if not self.has("*") and self.peek() != ")":
            if self.peek() in ("select", "with"):
                self.statement()
            else:
                self.listed(self.expression)
                if self.has("as"):
                    self.name()
                    if self.peek() == "(":
                        self.arguments()
                elif self.has("from"):
                    self.expression()
        self.need(")")
        if self.has("filter"):
            self.need("(")
            self.need("where")
            self.condition()
            self.need(")")
        if self.has("over"):
            if self.peek() != "(":
                self.name()
                return
            deep = 0
            while True:
                token = self.next()
                deep += (token == "(") - (token == ")")
                if not deep:
                    return

    def operand(self) -> bool:
        if self.has("-", "+", "~"):
            return self.operand()
        if self.has("<string>", "<number>", "null", "true", "false", "?"):
            return False
        if self.has(":", "@", "$"):
            self.next()
            return False
        if self.peek() == "(":
            self.at += 1
            if self.peek() in ("select", "with", "values"):
                self.statement()
                decides = False
            else:
                decides = self.expression()
                while self.has(","):
                    self.expression()
            self.need(")")
            return decides or True
        if self.has("case"):
            if self.peek() != "when":
                if self.last_begins("when"):
                    raise Broken
                self.expression()
            self.need("when")
            while True:
                self.expression()
                self.need("then")
                self.expression()
                if not self.has("when"):
                    break
            if self.has("else"):
                self.expression()
            self.need("end")
            return False
        if self.peek() in ("left", "right", "replace", "values") and self.peek(1) == "(":
            self.at += 1
            self.arguments()
            return False
        if not self.is_name():
            raise Broken if not self.peek() or self.last_begins("select", "null", "case", "exists", "not") else Foreign
        self.at += 1
        while self.peek() == ".":
            self.at += 1
            if not self.has("*"):
                self.name()
        if self.peek() == "(":
            self.arguments()
        elif self.peek() == "<string>" and self.tokens[self.at - 1][1] in ("date", "timestamp", "interval", "x", "n", "e"):
            self.at += 1
        return False


def read(text: str) -> str:
    """Whether ``text``, beginning with a statement, holds a complete one."""
    reader = Reader(text)
    try:
        reader.statement()
    except Broken:
        return "broken"
    except Foreign:
        return "broken" if reader.last_begins(*CONTINUE) else "foreign"
    except RecursionError:  # nested too deep to follow: judged by its brackets alone
        return "complete" if text.count("(") == text.count(")") else "broken"
    token = reader.peek()
    if token == ";":
        return "complete"
    rest = reader.tokens[reader.at :]
    if not rest:
        return "complete"
    if rest[0][0] in ("dots", "cut") or reader.last_begins(*CONTINUE):
        return "broken"
    # a closing remark on a line of its own is no part of the statement
    return "complete" if rest[0][0] in ("word", "op", "other", "number", "string", "name") and _after_line(text, reader) else "foreign"


def translated(text: str) -> bool:
    """Whether a "foreign" statement goes wrong at words that are no SQL: its keywords are translated.

    Such a word, or the alias before it, stands where a keyword must. Behind what would be a whole statement, a
    remark is told from that by what follows: a comparison or literal, or only a few words, and no end of a sentence.
    """
    reader = Reader(text)
    whole = True
    try:
        reader.statement()
    except (Broken, RecursionError):
        return False
    except Foreign:
        whole = False
    at = reader.at
    rest = reader.tokens[at:]
    if not rest or rest[0][0] != "word" or rest[0][1] in KNOWN or (at and reader.tokens[at - 1][1] in EXTRA):
        return False
    if not whole:
        return True
    if rest[-1][1] in (".", "!", "?"):
        return False
    return any(kind == "string" or word in ("=", "<>", "!=", "<", ">", "<=", ">=") for kind, word in rest) or len(rest) <= 3


def _after_line(text: str, reader: Reader) -> bool:
    seen = -1
    for m in TOKEN.finditer(text):
        if m.lastgroup in ("space", "comment"):
            if seen == reader.at - 1 and ("\n" in m.group() or m.lastgroup == "comment"):
                return True
            continue
        seen += 1
        if seen >= reader.at:
            return False
    return False


def find_statement(text: str) -> str | None:
    """The part of an unfenced answer that begins with a statement outside of comments, or null."""
    bare = uncomment(text)
    m = re.match(r"[\s​﻿(]*(?=(?:select|with)\b)", bare, re.I)
    if m:
        return bare[m.end() :]
    for m in LEAD.finditer(bare):
        rest = bare[m.end() :]
        if re.match(r"(?is)select\b.*\bfrom\b|select\s+[\w.*(]+\s*[,(.]|select\s*\Z|select\s+(?:distinct\s+)?[\w.]+\s*\Z|with\s+(?:recursive\s+)?\w+\s+as\b|with\s+\w+\s*\Z", rest):
            return rest
    return None


def only_literal(statement: str) -> str | None:
    """The text of a statement that selects nothing but one string literal, or null."""
    m = re.match(r"(?is)select\s+'((?:[^']|'')*)'?\s*(?:as\s+[\w\"`\[\]]+)?\s*;?\s*\Z", statement)
    return m.group(1).replace("''", "'") if m else None
