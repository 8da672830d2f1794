"""Text to `Query`, by recursive descent. AND and OR have one precedence and group to the left; ORDER BY is descending by default."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import date

from .model import ENTITY_TYPES, KEYWORDS, STRUCTURAL, And, Contains, Count, DateIs, Depends, Join, Ner, Not, Or, Order, ParseError, Pos, Query, Ref, Snippet

TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]+|//[^\r\n]*|/\*.*?\*/)|(?P<date>\d{4}(?:-\d\d?(?:-\d\d?)?)?(?!\d))|(?P<int>\d+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<string>"(?:[^"]|"")+"|'(?:[^']|'')+')|(?P<sign><=|>=|==|[()\[\],=*<>.;])""",
    re.DOTALL,
)
COMPARISONS = {"<": "BEFORE", ">": "AFTER", "<=": "BEFORE_EQUAL", ">=": "AFTER_EQUAL", "=": "EQUAL", "==": "EQUAL"}
DATE_WORDS = ("CONTAINS", "CONTAINED_BY", "INTERSECT", "BEFORE", "AFTER")
MAIN = "$main"


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected character {text[at]!r} at {at}")
        if m.lastgroup == "name" and m[0] in KEYWORDS:
            out.append(("key", m[0], at))
        elif m.lastgroup != "skip":
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    return [*out, ("end", "", len(text))]


def period(text: str) -> tuple[date, date]:
    """First and last day of YYYY, YYYY-MM or YYYY-MM-DD."""
    parts = [int(x) for x in text.split("-")]
    try:
        if len(parts) == 1:
            return date(parts[0], 1, 1), date(parts[0], 12, 31)
        if len(parts) == 2:
            return date(parts[0], parts[1], 1), date(parts[0], parts[1], monthrange(parts[0], parts[1])[1])
        return date(*parts), date(*parts)
    except (ValueError, IndexError) as e:
        raise ParseError(f"not a date: {text}") from e


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self, *values: str, ahead: int = 0) -> bool:
        kind, value, _ = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return kind in ("key", "sign") and value in values

    def kind(self) -> str:
        return self.tokens[self.at][0]

    def fail(self, wanted: str):
        kind, value, at = self.tokens[self.at]
        raise ParseError(f"expected {wanted} at {at}, found {value or 'the end'!r}")

    def take(self) -> str:
        value = self.tokens[self.at][1]
        self.at += 1
        return value

    def accept(self, *values: str) -> str | None:
        return self.take() if self.peek(*values) else None

    def expect(self, *values: str) -> str:
        return self.accept(*values) or self.fail(" or ".join(values))

    def name(self) -> str:
        return self.take() if self.kind() == "name" else self.fail("a name")

    def string(self) -> str:
        return self.take()[1:-1] if self.kind() == "string" else self.fail("a string")

    def integer(self) -> int:
        kind, value, _ = self.tokens[self.at]
        if kind == "int" or (kind == "date" and value.isdigit()):
            return int(self.take())
        self.fail("a number")

    def query(self) -> Query:
        q = self.body(main=True)
        self.accept(";")
        if self.kind() != "end":
            self.fail("the end of the query")
        return q

    def body(self, main: bool) -> Query:
        self.expect("SELECT")
        select = [self.column()]
        while self.accept(","):
            select.append(self.column())
        self.expect("FROM")
        source, alias, joins = self.name(), None, []
        if main:
            if self.accept("ALIAS"):
                alias = self.name()
            while self.peek("JOIN", "INNER", "LEFT", "RIGHT"):
                joins.append(self.join())
        where = self.condition_list() if self.accept("WHERE") else None
        group: list[Ref] = []
        if self.accept("GROUP"):
            self.expect("BY")
            group.append(self.reference(STRUCTURAL))
            while self.accept(","):
                group.append(self.reference(STRUCTURAL))
        granularity, window = "DOCUMENT", 0
        if self.accept("GRANULARITY"):
            granularity = self.expect("DOCUMENT", "SENTENCE")
            if granularity == "SENTENCE" and self.kind() in ("int", "date"):
                window = self.integer()
        order = []
        if self.accept("ORDER"):
            self.expect("BY")
            order.append(self.order())
            while self.accept(","):
                order.append(self.order())
        limit = self.integer() if self.accept("LIMIT") else None
        return Query(tuple(select), source, alias, tuple(joins), where, tuple(group), granularity, window, tuple(order), limit)

    def reference(self, words: tuple[str, ...] = ()) -> Ref:
        """name, alias.name, or one of `words`, alone or after an alias."""
        if self.peek(*words):
            return Ref(self.take())
        first = self.name()
        if self.accept("."):
            return Ref(self.take() if self.peek(*STRUCTURAL) else self.name(), first)
        return Ref(first)

    def column(self):
        if self.peek("COUNT"):
            return self.count()
        if self.accept("SNIPPET"):
            self.expect("(")
            target, window = self.reference(), 40
            if self.accept(","):
                window = self.integer()
            self.expect(")")
            return Snippet(target, window)
        return self.reference(("TITLE", "TIMESTAMP", "DOCUMENT_ID", "SENTENCE_ID"))

    def count(self) -> Count:
        self.expect("COUNT")
        self.expect("(")
        if self.peek("*", "DOCUMENTS"):
            out = Count(self.take())
        else:
            unique = bool(self.accept("UNIQUE"))
            out = Count(self.reference(), unique)
        self.expect(")")
        return out

    def order(self) -> Order:
        key = self.count() if self.peek("COUNT") else self.reference(("TITLE", "TIMESTAMP", "DOCUMENT_ID", "SENTENCE_ID"))
        return Order(key, (self.accept("ASC", "DESC") or "DESC") == "DESC")

    def join(self) -> Join:
        kind = self.accept("INNER", "LEFT", "RIGHT") or "INNER"
        self.expect("JOIN")
        self.expect("(")
        sub = self.body(main=False)
        self.expect(")")
        self.expect("ALIAS")
        alias = self.name()
        self.expect("ON")
        left = self.reference(STRUCTURAL)
        op = self.expect("=", "==", *DATE_WORDS)
        return Join(kind, sub, alias, left, "=" if op == "==" else op, self.reference())

    def condition_list(self):
        left = self.condition()
        while op := self.accept("AND", "OR"):
            right, kind = self.condition(), And if op == "AND" else Or
            left = kind((*(left.items if isinstance(left, kind) else (left,)), right))
        return left

    def condition(self):
        if self.accept("NOT"):
            return Not(self.atomic())
        return self.atomic()

    def atomic(self):
        if self.accept("("):
            inner = self.condition_list()
            self.expect(")")
            return inner
        kind = self.expect("NER", "CONTAINS", "DATE", "DEPENDS", "POS")
        self.expect("(")
        return getattr(self, "_" + kind.lower())()

    def bind(self) -> str | None:
        self.expect(")")
        return self.name() if self.accept("BIND") else None

    def operand(self):
        return self.string() if self.kind() == "string" else self.reference()

    def _ner(self) -> Ner:
        kind, targets = self.expect(*ENTITY_TYPES), []
        while self.accept(","):
            targets.append(self.operand())
        return Ner(kind, tuple(targets), self.bind())

    def _contains(self) -> Contains:
        terms = [self.string()]
        while self.accept(","):
            terms.append(self.string())
        if len(terms) == 1:
            terms = terms[0].split()
        return Contains(tuple(terms), self.bind())

    def _depends(self) -> Depends:
        governor = self.operand()
        self.expect(",")
        relation = self.string() if self.kind() == "string" else self.name()
        self.expect(",")
        dependent = self.take() if self.peek("*") else self.operand()
        return Depends(governor, relation, dependent, self.bind())

    def _pos(self) -> Pos:
        tag, term = self.string() if self.kind() == "string" else self.name(), None
        if self.accept(","):
            term = self.operand()
        return Pos(tag, term, self.bind())

    def literal(self) -> tuple[date, date]:
        return period(self.take()) if self.kind() == "date" else self.fail("a date")

    def _date(self) -> DateIs:
        op = self.expect(*COMPARISONS, *DATE_WORDS)
        if op in COMPARISONS:
            return DateIs(COMPARISONS[op], *self.literal(), self.bind())
        if self.accept("["):
            start = self.literal()[0]
            self.expect(",")
            end = self.literal()[1]
            self.expect("]")
        else:
            start, end = self.literal()
            if self.accept(","):
                end = self.literal()[1]
        return DateIs(op, start, end, self.bind())


def parse(text: str) -> Query:
    return Parser(text).query()
