"""Conditions as DataFrames: one row a cell, one struct column (value, begin, end) a bound variable.

Of several values in a cell the least counts, so AND is a plain equi-join that never multiplies rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import dates
from cellweave.plans.model import And, Contains, DateIs, Depends, ExecutionError, Ner, Not, Or, Pos, Ref, conditions, consumed, produced

from .features import CELL, restrict


def column_of(name: str, alias: str | None) -> str:
    return f"{alias or '$main'}${name}"


class Evaluator:
    """`document_scope` takes documents for cells; `window`, a number of sentences, lets AND meet within that distance; `multi` keeps all values that
    a variable has in a cell; `stitch` reads a word beside an annotation from the corpus' stitched tables; `allowed`: cells (document_id, sentence_id) outside which nothing counts."""

    def __init__(self, corpus, alias: str | None = None, document_scope: bool = False, window: int = 0, multi: bool = False, stitch: bool = False, allowed: DataFrame | None = None):
        self.corpus, self.alias, self.document_scope, self.window = corpus, alias, document_scope, window
        self.multi, self.stitch, self.allowed = multi, stitch, allowed

    def _table(self, name: str) -> DataFrame:
        if not self.corpus.has(name):
            raise ExecutionError("MISSING_INDEX", f"the corpus has no {name}")
        return self.corpus.table(name)

    def _name(self, var: str) -> str:
        return column_of(var, self.alias)

    def _cells(self, rows: DataFrame, var: str | None, value: Column) -> DataFrame:
        if self.document_scope:
            rows = rows.withColumn("sentence_id", F.lit(0).cast("long"))
        if self.allowed is not None:
            rows = restrict(rows, self.allowed)
        if var is None:
            return rows.select(*CELL).distinct()
        bound = F.struct(value.alias("value"), F.col("begin"), F.col("end"))
        if self.multi:
            return rows.select(*CELL, bound.alias(self._name(var))).distinct()
        return rows.groupBy(*CELL).agg(F.min(bound).alias(self._name(var)))

    def rows(self, c) -> tuple[DataFrame, Column]:
        """Occurrences that fit a single condition, and what it binds; operands that are variables are left open."""
        if isinstance(c, Contains):
            terms = [t.lower() for t in c.terms]
            text = " ".join(terms)
            wild = len(text) > 1 and text.endswith("*")
            grams = self.corpus.grams_of(len(terms), tuple((text[:-1] if wild else text).split(" ")))
            if wild:
                return grams.where(F.col("term").startswith(text[:-1])), F.col("term")
            return grams.where(F.col("term") == text), F.col("term")
        if isinstance(c, Ner):
            if c.type == "DATE":
                return self._table("dates"), F.col("date")
            found = self._table("entities").where(F.col("type") == c.type)
            fixed = [t.lower() for t in c.targets if isinstance(t, str)]
            if fixed and not consumed(c):
                found = found.where(F.col("value").isin(*fixed))
            return found, F.col("value")
        if isinstance(c, Pos):
            found = self._table("tags").where(F.col("tag") == c.tag.upper())
            return (found.where(F.col("term") == c.term.lower()) if isinstance(c.term, str) else found), F.col("term")
        if isinstance(c, Depends):
            found = self._table("dependencies").where(F.col("relation") == c.relation.lower())
            if isinstance(c.governor, str):
                found = found.where(F.col("head") == c.governor.lower())
            if isinstance(c.dependent, str) and c.dependent != "*":
                found = found.where(F.col("dependent") == c.dependent.lower())
            return found, F.col("dependent" if c.dependent == "*" else "head")
        if isinstance(c, DateIs):
            return self._table("dates").where(dates.matches(c.op, c.start, c.end, F.col("date"))), F.col("date")
        raise ExecutionError("INVALID_CONDITION", f"unknown condition {c}")

    def single(self, c) -> DataFrame:
        if isinstance(c, Contains) and not 1 <= len(c.terms) <= 3:
            raise ExecutionError("INVALID_CONDITION", "CONTAINS takes one to three terms")
        found, value = self.rows(c)
        return self._cells(found, c.var, value)

    def correlated(self, left: DataFrame, c) -> DataFrame:
        """Cells of `left` where an occurrence fits with the values that are bound there."""
        found, value = self.rows(c)
        if self.document_scope:
            found = found.withColumn("sentence_id", F.lit(0).cast("long"))
        tests: list[Column] = []
        bound = left.alias("l")
        occurrence = found.withColumn("cw_value", value).alias("o")

        def same(column: str, ref: Ref) -> Column:
            return F.col(f"o.{column}").cast("string") == F.lower(F.col(f"l.`{self._name(ref.name)}`.value").cast("string"))

        if isinstance(c, Ner):
            target = "date" if c.type == "DATE" else "value"
            any_of = F.lit(False)
            for t in c.targets:
                any_of = any_of | (same(target, t) if isinstance(t, Ref) else F.col(f"o.{target}").cast("string") == t.lower())
            tests.append(any_of)
        elif isinstance(c, Pos):
            tests.append(same("term", c.term))
        else:
            tests += [same(n, r) for n, r in (("head", c.governor), ("dependent", c.dependent)) if isinstance(r, Ref)]
        on = (F.col("l.document_id") == F.col("o.document_id")) & (F.col("l.sentence_id") == F.col("o.sentence_id"))
        for t in tests:
            on = on & t
        if not c.var or self._name(c.var) in left.columns:
            return bound.join(occurrence, on, "left_semi")
        joined = bound.join(occurrence, on).select("l.*", F.struct(F.col("o.cw_value").alias("value"), F.col("o.begin").alias("begin"), F.col("o.end").alias("end")).alias("cw_new"))
        if self.multi:
            return joined.withColumnRenamed("cw_new", self._name(c.var)).distinct()
        kept = [x for x in left.columns if x not in CELL]
        return joined.groupBy(*CELL).agg(*[F.min(f"`{x}`").alias(x) for x in kept], F.min("cw_new").alias(self._name(c.var)))

    def evaluate(self, c) -> DataFrame:
        if isinstance(c, And):
            return self._and(c)
        if isinstance(c, Or):
            out = self.evaluate(c.items[0])
            for item in c.items[1:]:
                out = self._either(out, self.evaluate(item))
            return out
        if isinstance(c, Not):
            universe = self.corpus.cells if self.allowed is None else restrict(self.corpus.cells, self.allowed)
            if universe.isEmpty():
                raise ExecutionError("INVALID_CONDITION", "NOT needs a corpus with at least one cell")
            if self.document_scope:
                universe = universe.select("document_id", F.lit(0).cast("long").alias("sentence_id")).distinct()
            return universe.join(self.evaluate(c.item).select(*CELL), CELL, "left_anti")
        if consumed(c):
            raise ExecutionError("INVALID_CONDITION", f"{c} reads a variable that no condition beside it binds")
        return self.single(c)

    def _and(self, c: And) -> DataFrame:
        """Words first, then what else stands alone, NOT last but for conditions that read variables."""
        flat: list = []
        for x in c.items:
            flat += x.items if isinstance(x, And) else [x]

        def place(x) -> int:
            if any(consumed(y) for y in conditions(x)):
                return 3
            return 0 if isinstance(x, Contains) else 2 if isinstance(x, Not) else 1

        waiting, out, known = sorted(flat, key=place), None, set()
        if self.stitch and (pair := self._stitched_pair(waiting)):
            out = self._stitched(*pair)
            known = {x.var for x in pair if x.var}
            waiting = [x for x in waiting if x is not pair[0] and x is not pair[1]]
        while waiting:
            at = next((k for k, x in enumerate(waiting) if {r.name for y in conditions(x) for r in consumed(y)} <= known or out is None and place(x) < 3), None)
            if at is None:
                raise ExecutionError("INVALID_CONDITION", "conditions read variables in a circle")
            x = waiting.pop(at)
            if out is not None and not isinstance(x, (And, Or, Not)) and consumed(x):
                out = self.correlated(out, x)
            elif out is not None and isinstance(x, Not) and not any(consumed(y) for y in conditions(x)):
                out = out.join(self.evaluate(x.item).select(*CELL), CELL, "left_anti") if self._indexed(flat) else self._both(out, self.evaluate(x))
            else:
                more = self.evaluate(x)
                out = more if out is None else self._both(out, more)
            known |= set(produced(x))
        return out

    def _stitched_pair(self, flat: list):
        """A word without wildcard and an annotation beside it that a stitched table of the corpus holds, or None."""
        kinds = {Ner: "ner", DateIs: "date", Pos: "pos"}
        if self.multi or self.window or self.document_scope or self.allowed is not None:
            return None
        for word in flat:
            if not isinstance(word, Contains) or len(" ".join(word.terms)) > 1 and word.terms[-1].endswith("*"):
                continue
            for note in flat:
                kind = kinds.get(type(note))
                if kind == "ner" and note.type == "DATE":
                    kind = "date"
                if kind and not consumed(note) and (note.var is None or note.var != word.var) and self.corpus.stitched(kind, len(word.terms)) is not None:
                    return word, note
        return None

    def _stitched(self, word, note) -> DataFrame:
        """One filter of a stitched table in place of a join of postings."""
        kind = "date" if isinstance(note, DateIs) or isinstance(note, Ner) and note.type == "DATE" else "ner" if isinstance(note, Ner) else "pos"
        rows = self.corpus.stitched(kind, len(word.terms)).where(F.col("ngram") == " ".join(word.terms).lower())
        value = F.col("value").cast("date") if kind == "date" else F.col("value")
        if isinstance(note, DateIs):
            rows = rows.where(dates.matches(note.op, note.start, note.end, value))
        elif kind == "ner":
            rows = rows.where(F.col("type") == note.type)
            if note.targets:
                rows = rows.where(F.col("value").isin(*[t.lower() for t in note.targets]))
        elif kind == "pos":
            rows = rows.where(F.col("type") == note.tag.upper())
            if isinstance(note.term, str):
                rows = rows.where(F.col("value") == note.term.lower())
        none = F.lit(None).cast("int")
        made = []
        if word.var:
            made.append(F.min(F.struct(F.col("ngram").alias("value"), F.col("begins")[0].alias("begin"), none.alias("end"))).alias(self._name(word.var)))
        if note.var:
            made.append(F.min(F.struct(value.alias("value"), none.alias("begin"), none.alias("end"))).alias(self._name(note.var)))
        return rows.groupBy(*CELL).agg(*made) if made else rows.select(*CELL).distinct()

    def _indexed(self, flat: list) -> bool:
        """Whether another condition already keeps to cells with indexed words, so that NOT needs no universe."""
        return any(isinstance(x, Contains) and len(x.terms) == 1 for x in flat) and not self.window

    def _both(self, a: DataFrame, b: DataFrame) -> DataFrame:
        if self.window and not self.document_scope:
            near = b.select("document_id", F.explode(F.sequence(F.col("sentence_id") - self.window, F.col("sentence_id") + self.window)).alias("sentence_id"), *[f"`{x}`" for x in b.columns if x not in CELL])
            b = near.groupBy(*CELL).agg(*[F.min(f"`{x}`").alias(x) for x in b.columns if x not in CELL]) if len(b.columns) > 2 and not self.multi else near.distinct()
        again = [x for x in b.columns if x in a.columns and x not in CELL]
        if len(b.columns) == 2:
            return a.join(b, CELL, "left_semi")
        if len(a.columns) == 2:
            return b.join(a, CELL, "left_semi")
        return a.join(b.drop(*again), CELL)

    def _either(self, a: DataFrame, b: DataFrame) -> DataFrame:
        if len(a.columns) == len(b.columns) == 2:
            return a.union(b).distinct()
        if self.multi:
            return a.unionByName(b, allowMissingColumns=True).distinct()
        both = [x for x in a.columns if x in b.columns and x not in CELL]
        cast = "struct<value:string,begin:int,end:int>"
        for x in both:
            if a.schema[x].dataType != b.schema[x].dataType:
                a, b = a.withColumn(x, F.col(f"`{x}`").cast(cast)), b.withColumn(x, F.col(f"`{x}`").cast(cast))
        out = a.join(b.withColumnsRenamed({x: f"{x}~" for x in both}), CELL, "full")
        return out.select(*CELL, *[(F.coalesce(f"`{x}`", f"`{x}~`") if x in both else F.col(f"`{x}`")).alias(x) for x in dict.fromkeys(a.columns + b.columns) if x not in CELL])
