"""The query as plain data."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


class QueryError(Exception):
    """Base of all errors in queries."""


class ParseError(QueryError):
    """The text isn't a query, or breaks a rule of the language."""


class ExecutionError(QueryError):
    """kind: INVALID_CONDITION, UNSUPPORTED_OPERATION, MISSING_INDEX, MISSING_INDEX_DATA, INDEX_ACCESS_ERROR or INTERNAL_ERROR."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@dataclass(frozen=True)
class Ref:
    """A variable or structural column: `alias` is None in the main query until qualified."""

    name: str
    alias: str | None = None

    def __str__(self) -> str:
        return f"{self.alias}.{self.name}" if self.alias else self.name


@dataclass(frozen=True)
class Contains:
    terms: tuple[str, ...]
    var: str | None = None


@dataclass(frozen=True)
class Ner:
    type: str
    targets: tuple[str | Ref, ...] = ()
    var: str | None = None


@dataclass(frozen=True)
class Pos:
    tag: str
    term: str | Ref | None = None
    var: str | None = None


@dataclass(frozen=True)
class Depends:
    governor: str | Ref
    relation: str
    dependent: str | Ref
    var: str | None = None


@dataclass(frozen=True)
class DateIs:
    """op: EQUAL, BEFORE, AFTER, BEFORE_EQUAL, AFTER_EQUAL, CONTAINS, CONTAINED_BY or INTERSECT; the period is start..end."""

    op: str
    start: date
    end: date
    var: str | None = None


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class Count:
    """target: '*', 'DOCUMENTS' or a Ref."""

    target: str | Ref
    unique: bool = False

    def __str__(self) -> str:
        return f"COUNT({'UNIQUE ' if self.unique else ''}{self.target})"


@dataclass(frozen=True)
class Snippet:
    target: Ref
    window: int = 40

    def __str__(self) -> str:
        return f"SNIPPET({self.target})"


@dataclass(frozen=True)
class Order:
    key: Ref | Count
    descending: bool = True


@dataclass(frozen=True)
class Join:
    kind: str
    query: Query
    alias: str
    left: Ref
    op: str
    right: Ref


@dataclass(frozen=True)
class Query:
    select: tuple
    source: str
    alias: str | None = None
    joins: tuple[Join, ...] = ()
    where: object | None = None
    group_by: tuple[Ref, ...] = ()
    granularity: str = "DOCUMENT"
    window: int = 0
    order_by: tuple[Order, ...] = ()
    limit: int | None = None


STRUCTURAL = ("TITLE", "TIMESTAMP", "DOCUMENT_ID", "SENTENCE_ID", "BEGIN", "END")
#: Entity types of NER(...). Fixed values.
ENTITY_TYPES = ("PERSON", "LOCATION", "ORGANIZATION", "DATE", "TIME", "DURATION", "MONEY", "NUMBER", "ORDINAL", "PERCENT", "SET", "CITY", "STATE_OR_PROVINCE", "COUNTRY", "NATIONALITY", "RELIGION", "TITLE", "IDEOLOGY", "CRIMINAL_CHARGE", "CAUSE_OF_DEATH")
#: Reserved words. Fixed values.
KEYWORDS = frozenset("SELECT FROM WHERE ALIAS BIND SNIPPET NER POS DEPENDS DATE GRANULARITY DOCUMENT SENTENCE TITLE TIMESTAMP CONTAINS CONTAINED_BY INTERSECT BEFORE AFTER AND OR NOT ORDER BY ASC DESC LIMIT COUNT UNIQUE DOCUMENTS JOIN ON INNER LEFT RIGHT BEGIN END GROUP DOCUMENT_ID SENTENCE_ID y d".split()) | set(ENTITY_TYPES)


def conditions(c):
    """All single conditions below `c`, left to right."""
    if isinstance(c, (And, Or)):
        for x in c.items:
            yield from conditions(x)
    elif isinstance(c, Not):
        yield from conditions(c.item)
    elif c is not None:
        yield c


def produced(c) -> dict[str, set[str]]:
    """Variables that conditions bind, each with its kinds."""
    out: dict[str, set[str]] = {}
    kinds = {Contains: "TEXT_SPAN", Ner: "ENTITY", Pos: "POS_TAG", Depends: "DEPENDENCY", DateIs: "TEMPORAL"}
    for x in conditions(c):
        if x.var:
            kind = "TEMPORAL" if isinstance(x, Ner) and x.type == "DATE" else kinds[type(x)]
            out.setdefault(x.var, set()).add(kind)
    return out


def consumed(x) -> list[Ref]:
    """Variables that a single condition reads."""
    if isinstance(x, Ner):
        return [t for t in x.targets if isinstance(t, Ref)]
    if isinstance(x, Pos):
        return [x.term] if isinstance(x.term, Ref) else []
    if isinstance(x, Depends):
        return [t for t in (x.governor, x.dependent) if isinstance(t, Ref)]
    return []


def variable_type(kinds: set[str]) -> str:
    """One specific kind is the type; none or several are ANY."""
    return next(iter(kinds)) if len(kinds) == 1 else "ANY"


def compatible(a: str, b: str) -> bool:
    return a == b or "ANY" in (a, b)
