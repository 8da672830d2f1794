"""Query text to a lazy DataFrame: conditions to joins, then projection, grouping, order and limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.features import CELL
from cellweave.operators.predicates import Evaluator, column_of

from .model import STRUCTURAL, Count, ExecutionError, Join, Query, Ref, Snippet
from .parser import parse
from .validate import validate


def _date(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c).cast("date"), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


class Engine:
    """`corpora`: by name. `pushdown`: bound the right side of joins by what the left side has; results are the same. `multi`: rows for all
    values that a variable has in a cell, not the least one only. `stitch`: answer a word beside an annotation from the corpus' stitched tables, where
    it has them; results are the same. `ordered`: rows come in the order of their cells; without it
    only where ORDER BY or LIMIT asks, which saves a sort of results that are written or read on."""

    def __init__(self, spark, corpora: dict[str, object], pushdown: bool = True, document_scope: bool = False, sentence_window: bool = False, multi: bool = False, stitch: bool = False, ordered: bool = True):
        self.spark, self.corpora, self.pushdown = spark, corpora, pushdown
        self.document_scope, self.sentence_window = document_scope, sentence_window
        self.multi, self.stitch, self.ordered = multi, stitch, ordered

    def sql(self, text: str) -> DataFrame:
        return self.run(validate(parse(text)))

    def corpus(self, name: str):
        if name not in self.corpora:
            raise ExecutionError("MISSING_INDEX", f"no corpus named {name}")
        return self.corpora[name]

    def _evaluator(self, q: Query, alias: str | None) -> Evaluator:
        near = q.window if self.sentence_window and q.granularity == "SENTENCE" else 0
        # stitched tables have no ends of matches
        offsets = any(isinstance(x, Snippet) or isinstance(x, Ref) and x.name in ("BEGIN", "END") for x in q.select)
        return Evaluator(self.corpus(q.source), alias, self.document_scope and q.granularity == "DOCUMENT", near, self.multi, self.stitch and not offsets)

    def matches(self, q: Query, alias: str | None = None) -> DataFrame:
        """Cells and bound variables of the WHERE clause, with cell columns named by alias; nothing without WHERE."""
        corpus = self.corpus(q.source)
        found = corpus.cells.where(F.lit(False)) if q.where is None else self._evaluator(q, alias).evaluate(q.where)
        return found.withColumnsRenamed({c: column_of(c, alias) for c in CELL})

    def _structural(self, rows: DataFrame, q: Query, alias: str | None, names: set[str], snippets: bool) -> DataFrame:
        """Adds titles, times and texts of one side's documents, if they are read, by one left join; before it, for snippets, where sentences begin."""
        fields = {"TITLE": "title", "TIMESTAMP": "timestamp"}
        need = [f for n, f in fields.items() if n in names] + ["text"] * snippets
        if not need:
            return rows
        corpus, doc, sentence = self.corpus(q.source), *(F.col(f"`{column_of(c, alias)}`") for c in CELL)
        if snippets and corpus.sentences is not None:
            at = corpus.sentences.select(F.col("document_id").alias("cw_doc"), F.col("sentence_id").alias("cw_sentence"), F.col("offset").alias(column_of("offset", alias)))
            rows = rows.join(at, (doc == F.col("cw_doc")) & (sentence == F.col("cw_sentence")), "left").drop("cw_doc", "cw_sentence")
        # texts come last: no later exchange then carries a text once for each of its cells
        found = corpus.documents.select(F.col("document_id").alias("cw_doc"), *[F.col(f).alias(column_of(f, alias)) for f in need])
        rows = rows.join(found, doc == F.col("cw_doc"), "left").drop("cw_doc")
        return rows

    def _value(self, rows: DataFrame, r: Ref, raw: bool = False) -> Column:
        def col(name: str) -> Column:
            return F.col(f"`{column_of(name, r.alias)}`")

        if r.name == "DOCUMENT_ID":
            return col("document_id")
        if r.name == "SENTENCE_ID":
            return F.when(col("sentence_id") >= 0, col("sentence_id"))
        if r.name == "TITLE":
            return F.coalesce(col("title"), F.lit(""))
        if r.name == "TIMESTAMP":
            return _date(col("timestamp"))
        if r.name in ("BEGIN", "END"):
            bound = [c for c in rows.columns if c.startswith(f"{r.alias or '$main'}$") and c not in (column_of("document_id", r.alias), column_of("sentence_id", r.alias)) and "struct" in dict(rows.dtypes)[c]]
            return F.least(*[F.col(f"`{c}`.begin") for c in bound]) if len(bound) > 1 and r.name == "BEGIN" else F.greatest(*[F.col(f"`{c}`.end") for c in bound]) if len(bound) > 1 else F.col(f"`{bound[0]}`.{r.name.lower()}") if bound else F.lit(None).cast("int")
        value = F.col(f"`{column_of(r.name, r.alias)}`.value")
        return value if raw else value.cast("string")

    def _snippet(self, rows: DataFrame, s: Snippet) -> Column:
        """The text around a match. Offsets count from the sentence's first word where the corpus tells where sentences begin, else from the text's start."""
        bound, text = column_of(s.target.name, s.target.alias), F.col(f"`{column_of('text', s.target.alias)}`")
        start = column_of("offset", s.target.alias)
        offset = F.coalesce(F.col(f"`{start}`"), F.lit(0)) if start in rows.columns else F.lit(0)
        begin, end = F.col(f"`{bound}`.begin") + offset, F.col(f"`{bound}`.end") + offset
        a, z = F.greatest(begin - s.window, F.lit(0)), F.least(end + s.window, F.length(text))
        body = F.trim(F.regexp_replace(F.substring(text, a + 1, z - a), r"\R", " "))
        return F.concat(F.when(a > 0, "...").otherwise(""), body, F.when(z < F.length(text), "...").otherwise(""))

    def run(self, q: Query) -> DataFrame:
        order = [self._order(str(o.key), o.descending) for o in q.order_by]
        counting = bool(q.group_by) or any(isinstance(s, Count) for s in q.select)
        if counting and q.joins:
            out = self._counted(q)
        else:
            out, cells = self._rows(q, counting)
            # rows come in the order of their cells where a limit cuts them, or after the asked order
            order += cells if order or self.ordered or q.limit is not None else []
        if order:
            out = out.orderBy(*order)
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.drop("cw:document_id", "cw:sentence_id")

    def _rows(self, q: Query, counting: bool) -> tuple[DataFrame, list[Column]]:
        """What SELECT asks for, and the order of cells that rows without grouping have."""
        rows = self.matches(q, q.alias)
        sides = {q.alias: q}
        for j in q.joins:
            rows = self._join(rows, sides, j)
            sides[j.alias] = j.query
        read = [x for s in q.select for x in ([s.target] if isinstance(s, (Snippet, Count)) and isinstance(s.target, Ref) else [s] if isinstance(s, Ref) else [])] + list(q.group_by)
        for alias, side in sides.items():
            mine = {r.name for r in read if r.alias == alias or (r.alias is None and alias == q.alias)}
            text = any(isinstance(s, Snippet) and s.target.alias == alias for s in q.select)
            rows = self._structural(rows, side, alias, mine, text)

        def own(r: Ref) -> Ref:
            return Ref(r.name, q.alias) if r.alias is None else r

        plain = {str(s): self._snippet(rows, s) if isinstance(s, Snippet) else self._value(rows, own(s)) for s in q.select if not isinstance(s, Count)}
        if not counting:
            cells = [F.col(f"`{column_of(c, q.alias)}`").alias(f"cw:{c}") for c in CELL]
            out = rows.select(*[c.alias(n) for n, c in plain.items()], *cells)
            return out, [F.col("`cw:document_id`").asc_nulls_last(), F.col("`cw:sentence_id`").asc_nulls_last()]
        counts = {str(s): self._count(rows, s, own, q.alias) for s in q.select if isinstance(s, Count)}
        keys = [str(g) for g in q.group_by]
        out = rows.withColumns({f"cw:{k}": plain[k] for k in keys}).groupBy(*[F.col(f"`cw:{k}`").alias(k) for k in keys]).agg(*[c.alias(n) for n, c in (counts or {"count": F.count(F.lit(1))}).items()])
        return out.select(*[f"`{n}`" for n in ([str(s) for s in q.select] if counts else [*keys, "count"])]), []

    def _count(self, rows: DataFrame, c: Count, own, alias: str | None) -> Column:
        if c.target == "*":
            return F.count(F.lit(1))
        if c.target == "DOCUMENTS":
            return F.count_distinct(f"`{column_of('document_id', alias)}`")
        value = self._value(rows, own(c.target))
        return F.count_distinct(value) if c.unique else F.count(value)

    @staticmethod
    def _order(name: str, descending: bool) -> Column:
        c = F.col(f"`{name}`")
        return c.desc_nulls_first() if descending else c.asc_nulls_last()

    def _subquery(self, j: Join) -> DataFrame:
        """The right side: its matches, cut down by its own ORDER BY, LIMIT and GROUP BY (one row a group, the first cell's)."""
        q, rows = j.query, self.matches(j.query, j.alias)
        cells = [f"`{column_of(c, j.alias)}`" for c in CELL]
        if q.group_by:
            rows = self._structural(rows, q, j.alias, {g.name for g in q.group_by}, False)
            keys = [self._value(rows, Ref(g.name, j.alias)).alias(f"cw:{k}") for k, g in enumerate(q.group_by)]
            bound = [c for c in rows.columns if c.startswith(f"{j.alias}$")]
            firsts = F.min(F.struct(*cells, *[f"`{c}`" for c in bound if f"`{c}`" not in cells])).alias("cw:first")
            rows = rows.groupBy(*keys).agg(firsts).select("`cw:first`.*")
        if q.limit is not None:
            read = {o.key.name for o in q.order_by if isinstance(o.key, Ref)}
            rows = self._structural(rows, q, j.alias, read, False)
            order = []
            for o in q.order_by:
                if isinstance(o.key, Ref):
                    v = self._value(rows, Ref(o.key.name, j.alias))
                    order.append(v.desc_nulls_first() if o.descending else v.asc_nulls_last())
            rows = rows.orderBy(*order, *[F.col(c).asc() for c in cells]).limit(q.limit)
        return rows

    def _join(self, left: DataFrame, sides: dict, j: Join) -> DataFrame:
        right = self._subquery(j)
        for r, rows_of in ((j.left, "left"), (j.right, "right")):
            if r.name in ("TITLE", "TIMESTAMP"):
                if rows_of == "left":
                    left = self._structural(left, sides[r.alias], r.alias, {r.name}, False)
                else:
                    right = self._structural(right, j.query, j.alias, {r.name}, False)
        own = next(iter(sides))
        j_left = Ref(j.left.name, own) if j.left.alias is None else j.left
        left, right = left.withColumn("cw:x", self._value(left, j_left, raw=True)), right.withColumn("cw:y", self._value(right, j.right, raw=True))
        return self._matched(left, right, j).drop("cw:x", "cw:y")

    def _matched(self, left: DataFrame, right: DataFrame, j: Join) -> DataFrame:
        """Rows of `left` and `right` whose `cw:x` and `cw:y` fit."""
        x, y = F.col("`cw:x`"), F.col("`cw:y`")
        x_type, y_type = dict(left.dtypes)["cw:x"], dict(right.dtypes)["cw:y"]
        if j.op in ("BEFORE", "AFTER") and not x_type == y_type == "date":
            x, y = (c if t == "date" else F.try_to_date(c.cast("string"), "yyyy-MM-dd") for c, t in ((x, x_type), (y, y_type)))
        elif x_type != y_type:
            x, y = x.cast("string"), y.cast("string")
        left, right = left.withColumn("cw:x", x), right.withColumn("cw:y", y)
        x, y = F.col("`cw:x`"), F.col("`cw:y`")
        how = {"INNER": "inner", "LEFT": "left", "RIGHT": "right"}[j.kind]
        on = {"BEFORE": x < y, "AFTER": x > y}.get(j.op, x == y)
        if self.pushdown and how in ("inner", "left"):
            if j.op in ("BEFORE", "AFTER"):
                bound = left.agg((F.min if j.op == "BEFORE" else F.max)("`cw:x`").alias("cw:bound"))
                right = right.join(F.broadcast(bound), y > F.col("`cw:bound`") if j.op == "BEFORE" else y < F.col("`cw:bound`")).drop("cw:bound")
            else:
                right = right.join(left.select(x.alias("cw:k")).distinct(), y == F.col("`cw:k`"), "left_semi")
        return left.join(right, on, how)

    def _counted(self, q: Query) -> DataFrame:
        """What grouping and counts read, and `cw:n`: how many joined rows have those values. Each side is reduced to its distinct
        values and their number before a join, and so is each join's result, so the joined rows themselves are never made."""

        def own(r: Ref) -> Ref:
            return Ref(r.name, q.alias) if r.alias is None else r

        targets = [c.target for c in q.select if isinstance(c, Count)]
        asked = [own(r) for r in q.group_by] + [own(t) for t in targets if isinstance(t, Ref)] + [Ref("DOCUMENT_ID", q.alias)] * ("DOCUMENTS" in targets)
        ends = [(own(j.left), j.right) for j in q.joins]
        made: list[str] = []

        def side(rows: DataFrame, of: Query, alias: str | None) -> DataFrame:
            mine = {r for r in [*asked, *(r for e in ends for r in e)] if r.alias == alias}
            rows = self._structural(rows, of, alias, {r.name for r in mine}, False)
            cols = {f"cw:v:{r}": self._value(rows, r) for r in asked if r.alias == alias} | {f"cw:j:{r}": self._value(rows, r, raw=True) for e in ends for r in e if r.alias == alias}
            made.extend(c for c in cols if c not in made)
            return rows.select(*[c.alias(n) for n, c in cols.items()]).groupBy(*[f"`{n}`" for n in cols]).agg(F.count(F.lit(1)).alias("cw:n"))

        rows = side(self.matches(q, q.alias), q, q.alias)
        for k, j in enumerate(q.joins):
            right = side(self._subquery(j), j.query, j.alias).withColumnRenamed("cw:n", "cw:m")
            left = rows.withColumn("cw:x", F.col(f"`cw:j:{ends[k][0]}`"))
            both = self._matched(left, right.withColumn("cw:y", F.col(f"`cw:j:{ends[k][1]}`")), j)
            later = {f"cw:j:{r}" for e in ends[k + 1 :] for r in e}
            keep = [c for c in made if c.startswith("cw:v:") or c in later]
            n = F.coalesce("`cw:n`", F.lit(1)) * F.coalesce("`cw:m`", F.lit(1))
            rows = both.withColumn("cw:n", n).groupBy(*[f"`{c}`" for c in keep]).agg(F.coalesce(F.sum("`cw:n`"), F.lit(0)).alias("cw:n"))

        def count(c: Count) -> Column:
            if c.target == "*":
                return F.coalesce(F.sum("`cw:n`"), F.lit(0))
            value = F.col(f"`cw:v:{Ref('DOCUMENT_ID', q.alias) if c.target == 'DOCUMENTS' else own(c.target)}`")
            return F.count_distinct(value) if c.unique or c.target == "DOCUMENTS" else F.coalesce(F.sum(F.when(value.isNotNull(), F.col("`cw:n`"))), F.lit(0))

        counts = {str(c): count(c) for c in q.select if isinstance(c, Count)}
        keys = list(dict.fromkeys((str(g), f"cw:v:{own(g)}") for g in q.group_by))
        out = rows.groupBy(*[F.col(f"`{c}`").alias(g) for g, c in keys]).agg(*[c.alias(n) for n, c in (counts or {"count": F.coalesce(F.sum("`cw:n`"), F.lit(0))}).items()])
        return out.select(*[f"`{n}`" for n in ([str(s) for s in q.select] if counts else [*(g for g, _ in keys), "count"])])


def explain(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def count_pairs(left: DataFrame, right: DataFrame, before: bool = True) -> DataFrame:
    """n: how many pairs (left.date, right.date) are in order, without making pairs: counts a day, then running sums over days."""
    from pyspark.sql import Window

    a = left.groupBy("date").agg(F.count("*").alias("n")).select("date", "n", F.lit(0).alias("m"))
    b = right.groupBy("date").agg(F.count("*").alias("m")).select("date", F.lit(0).cast("long").alias("n"), "m")
    days = a.unionByName(b).where("date is not null").groupBy("date").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    # days are few: at most as many as the bounds hold
    line = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1) if before else Window.orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("earlier", F.coalesce(F.sum("n").over(line), F.lit(0))).agg(F.coalesce(F.sum(F.col("m") * F.col("earlier")), F.lit(0)).alias("n"))


__all__ = ["Engine", "count_pairs", "explain", "STRUCTURAL"]
