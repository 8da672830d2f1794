"""What parses, what does not, and what it becomes."""

from datetime import date

import pytest

from cellweave.plans.model import And, Contains, Count, DateIs, Depends, Ner, Not, Or, Order, ParseError, Ref, Snippet, compatible, conditions, variable_type
from cellweave.plans.parser import parse, period
from cellweave.plans.validate import validate

GOOD = [
    "SELECT p FROM news WHERE NER(PERSON) BIND p",
    "SELECT p, COUNT(*) FROM news WHERE CONTAINS('president') AND DATE(= 1988) AND NER(PERSON) BIND p GROUP BY p GRANULARITY SENTENCE ORDER BY COUNT(*) DESC",
    "SELECT DOCUMENT_ID, TITLE FROM c WHERE CONTAINS('a', 'b', 'c')",
    "SELECT SNIPPET(p, 20) FROM c WHERE NER(PERSON, 'x y') BIND p LIMIT 1000;",
    "SELECT p FROM c WHERE (CONTAINS('a') OR NOT CONTAINS('b*')) AND NER(PERSON) BIND p // note\n/* more */",
    "SELECT COUNT(UNIQUE p) FROM c WHERE NER(PERSON) BIND p",
    "SELECT COUNT(DOCUMENTS) FROM c WHERE DATE(CONTAINED_BY [2000-01, 2001])",
    "SELECT a.p, b.q FROM c ALIAS a JOIN (SELECT q FROM c WHERE DATE(< 2000) BIND q) ALIAS b ON a.p BEFORE b.q WHERE DATE(> 1999-01-01) BIND p",
    "SELECT p FROM c WHERE POS(NN, 'x') BIND p AND DEPENDS(p, 'nsubj', *) GRANULARITY SENTENCE 2",
    'SELECT DOCUMENT_ID FROM c WHERE CONTAINS("double quoted")',
]
BAD = [
    "SELECT p WHERE CONTAINS('a')",
    "SELECT p FROM c WHERE",
    "SELECT p FROM c WHERE CONTAINS('a') CONTAINS('b')",
    "SELECT p FROM c WHERE DATE(1999)",
    "SELECT p FROM c WHERE DATE(= 19)",
    "SELECT p FROM c WHERE CONTAINS('')",
    "SELECT y FROM c WHERE NER(PERSON) BIND y",
    "select p from c",
    "SELECT p FROM c WHERE NER(ANIMAL)",
    "SELECT p FROM c LIMIT x",
]
UNSOUND = [
    "SELECT p FROM c WHERE CONTAINS('a')",
    "SELECT p FROM c WHERE CONTAINS('a b c e') BIND p",
    "SELECT p FROM c WHERE CONTAINS('*a') BIND p",
    "SELECT p FROM c WHERE NER(PERSON, 'a*') BIND p",
    "SELECT p FROM c WHERE DEPENDS('a', 'r', q) BIND p",
    "SELECT SNIPPET(p, 151) FROM c WHERE CONTAINS('a') BIND p",
    "SELECT p FROM c WHERE DATE(= 1900) BIND p",
    "SELECT p, COUNT(*) FROM c WHERE CONTAINS('a') BIND p",
    "SELECT p FROM c WHERE CONTAINS('a') BIND p GROUP BY q",
    "SELECT p FROM c WHERE CONTAINS('a') BIND p ORDER BY COUNT(*)",
    "SELECT p FROM c WHERE CONTAINS('a') BIND p LIMIT 0",
    "SELECT p FROM c WHERE CONTAINS('a') BIND p GRANULARITY SENTENCE 11",
    "SELECT p, p FROM c WHERE CONTAINS('a') BIND p",
    "SELECT p FROM c ALIAS a WHERE CONTAINS('a') BIND p",
    "SELECT a.p FROM c ALIAS a JOIN (SELECT q FROM c WHERE CONTAINS('b') BIND q) ALIAS b ON b.q = a.p WHERE CONTAINS('a') BIND p",
]


@pytest.mark.parametrize("text", GOOD)
def test_accepts(text):
    validate(parse(text))


@pytest.mark.parametrize("text", BAD)
def test_rejects_syntax(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("text", UNSOUND)
def test_rejects_meaning(text):
    parse(text)
    with pytest.raises(ParseError):
        validate(parse(text))


def test_equal_precedence_groups_left():
    q = parse("SELECT DOCUMENT_ID FROM c WHERE CONTAINS('a') OR CONTAINS('b') AND CONTAINS('c')")
    assert q.where == And((Or((Contains(("a",)), Contains(("b",)))), Contains(("c",))))


def test_order_is_descending_by_default():
    q = parse("SELECT p FROM c WHERE NER(PERSON) BIND p ORDER BY p, DOCUMENT_ID ASC")
    assert q.order_by == (Order(Ref("p"), True), Order(Ref("DOCUMENT_ID"), False))


def test_shapes():
    q = parse("SELECT COUNT(UNIQUE p), SNIPPET(p) FROM c WHERE NOT NER(DATE) BIND p")
    assert q.select == (Count(Ref("p"), True), Snippet(Ref("p"), 40)) and q.where == Not(Ner("DATE", (), "p"))
    assert parse("SELECT p FROM c WHERE DEPENDS(x, 'R', *)").where == Depends(Ref("x"), "R", "*")
    assert parse("SELECT p FROM c WHERE DATE(<= 2000-02)").where == DateIs("BEFORE_EQUAL", date(2000, 2, 1), date(2000, 2, 29))
    assert parse("SELECT p FROM c WHERE CONTAINS('a b')").where == Contains(("a", "b"))


def test_periods():
    assert period("1999") == (date(1999, 1, 1), date(1999, 12, 31))
    assert period("1999-2") == (date(1999, 2, 1), date(1999, 2, 28))
    with pytest.raises(ParseError):
        period("1999-02-30")


def test_types():
    assert variable_type({"ENTITY"}) == "ENTITY" and variable_type({"ENTITY", "TEMPORAL"}) == "ANY"
    assert compatible("ANY", "ENTITY") and not compatible("TEMPORAL", "ENTITY")
    assert len(list(conditions(parse(GOOD[4]).where))) == 3
