"""Rules that a parsed query has to keep."""

from __future__ import annotations

from datetime import date

from .model import STRUCTURAL, Contains, Count, DateIs, Depends, Ner, Not, And, Or, ParseError, Pos, Query, Ref, Snippet, conditions, consumed, produced

#: Bounds of dates in queries. Fixed values.
FIRST_DAY, LAST_DAY = date(1925, 1, 1), date(2025, 12, 31)
MOST_JOINS, MOST_SNIPPET, MOST_WINDOW, MOST_DEPTH = 5, 150, 10, 10


def _fail(why: str):
    raise ParseError(why)


def _depth(c) -> int:
    if isinstance(c, (And, Or)):
        return 1 + max(map(_depth, c.items))
    return 1 + _depth(c.item) if isinstance(c, Not) else 1


def _condition(x) -> None:
    if isinstance(x, Contains):
        if not 1 <= len(x.terms) <= 3 or any(not t.strip() for t in x.terms):
            _fail("CONTAINS takes one to three terms, none of them blank")
        if any(t.startswith("*") and t != "*" for t in x.terms) or (len(x.terms) > 1 and "*" in x.terms) or any("*" in t[:-1] for t in x.terms) or any(t.endswith("*") for t in x.terms[:-1]):
            _fail("a wildcard may only end the last term of CONTAINS")
    elif isinstance(x, Ner):
        if any("*" in t for t in x.targets if isinstance(t, str)):
            _fail("NER takes no wildcards")
    elif isinstance(x, Pos):
        if "*" in x.tag or (isinstance(x.term, str) and "*" in x.term):
            _fail("POS takes no wildcards")
    elif isinstance(x, Depends):
        if x.governor == "*" or x.relation == "*":
            _fail("only the dependent of DEPENDS may be a wildcard")
        if not all(str(t).strip() for t in (x.governor, x.relation, x.dependent)):
            _fail("DEPENDS takes no blank operands")
    elif isinstance(x, DateIs):
        if x.start > x.end:
            _fail("the period ends before it starts")
        if x.start < FIRST_DAY or x.end > LAST_DAY:
            _fail(f"dates must lie between {FIRST_DAY} and {LAST_DAY}")


def _where(q: Query) -> set[str]:
    if q.where is not None and _depth(q.where) > MOST_DEPTH:
        _fail("conditions are nested too deeply")
    for x in conditions(q.where):
        _condition(x)
    names = set(produced(q.where))
    for x in conditions(q.where):
        for r in consumed(x):
            if r.name not in names:
                _fail(f"variable {r} is read but nothing binds it")
    return names


def validate(q: Query) -> Query:
    if len(q.joins) > MOST_JOINS:
        _fail(f"at most {MOST_JOINS} joins")
    own = q.alias or None
    scope: dict[str | None, set[str]] = {own: _where(q)}
    last = own
    for j in q.joins:
        if j.alias in scope:
            _fail(f"alias {j.alias} is used twice")
        validate(j.query)
        scope[j.alias] = _where(j.query)
        for side, wanted in ((j.left, last), (j.right, j.alias)):
            if side.alias is None and not (wanted is None and side is j.left):
                _fail(f"join column {side} needs an alias")
            if side.alias != wanted:
                _fail(f"join column {side} must belong to {wanted or 'the main query'}")
            if side.name not in STRUCTURAL and side.name not in scope[wanted]:
                _fail(f"nothing binds {side}")
        last = j.alias
    qualified = bool(q.alias or q.joins)

    def known(r: Ref, where: str) -> None:
        if r.name in STRUCTURAL and r.alias is None and where == "SELECT":
            return
        if qualified and r.alias is None and not (q.alias is None and r.name in scope[None]):
            _fail(f"{r} in {where} needs an alias")
        if r.alias not in scope and r.alias is not None:
            _fail(f"alias of {r} in {where} is unknown")
        if r.name not in STRUCTURAL and r.name not in scope.get(r.alias, set()):
            _fail(f"nothing binds {r} in {where}")

    if not q.select:
        _fail("nothing is selected")
    if len({str(s) for s in q.select}) < len(q.select):
        _fail("a column is selected twice")
    for s in q.select:
        if isinstance(s, Snippet):
            known(s.target, "SNIPPET")
            if not 0 < s.window <= MOST_SNIPPET:
                _fail(f"a snippet's window is 1 to {MOST_SNIPPET}")
        elif isinstance(s, Count):
            if isinstance(s.target, Ref):
                known(s.target, "COUNT")
        else:
            known(s, "SELECT")
    selected, counts = {str(s) for s in q.select}, [s for s in q.select if isinstance(s, Count)]
    plain = [s for s in q.select if not isinstance(s, Count)]
    for g in q.group_by:
        known(g, "GROUP BY") if g.name not in STRUCTURAL or g.alias else None
        if str(g) not in selected:
            _fail(f"{g} is grouped by but not selected")
    groups = {str(g) for g in q.group_by}
    if q.group_by and any(str(s) not in groups for s in plain):
        _fail("a selected column is neither grouped by nor counted")
    if counts and plain and not q.group_by:
        _fail("COUNT beside other columns needs GROUP BY")
    for o in q.order_by:
        if isinstance(o.key, Count):
            if str(o.key) not in selected:
                _fail(f"{o.key} must be selected to order by it")
        elif str(o.key) not in selected:
            _fail(f"{o.key} must be selected to order by it")
        elif q.group_by and str(o.key) not in groups:
            _fail(f"{o.key} must be a group key to order by it")
    if q.limit is not None and q.limit < 1:
        _fail("LIMIT must be positive")
    if not 0 <= q.window <= MOST_WINDOW:
        _fail(f"a sentence window is 0 to {MOST_WINDOW}")
    return q
