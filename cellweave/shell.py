"""A session: SET commands and queries, line by line."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from cellweave.plans.engine import Engine
from cellweave.plans.model import QueryError
from cellweave.sources import sinks


class Session:
    def __init__(self, engine: Engine):
        self.engine, self.output = engine, None

    def execute(self, line: str) -> str | None:
        """What to print; None ends the session."""
        text = line.strip()
        if text.upper() in ("EXIT", "QUIT"):
            return None
        if m := re.fullmatch(r"SET\s+OUTPUT\s+NONE", text, re.I):
            self.output = None
            return "output: console"
        if m := re.fullmatch(r"SET\s+OUTPUT\s+(csv|json|html)\s+(\S+)", text, re.I):
            self.output = m[1].lower(), m[2]
            return f"output: {m[1].lower()} {m[2]}"
        if m := re.fullmatch(r"SET\s+STRATEGY\s+(.+)", text, re.I):
            asked = dict(re.findall(r"(\w+)\s*=\s*(\w+)", m[1]))
            known = {"pushdown": ("base", "optimized"), "stitch": ("base", "optimized"), "temporal": ("base",)}
            wrong = [f"{k}={v}" for k, v in asked.items() if v not in known.get(k, ())]
            if wrong or not asked:
                return f"error: unknown strategy {', '.join(wrong) or m[1]}"
            for name in ("pushdown", "stitch"):
                if name in asked:
                    setattr(self.engine, name, asked[name] == "optimized")
            return f"strategy: {', '.join(f'{k}={v}' for k, v in asked.items())}"
        try:
            found = self.engine.sql(text)
            if self.output:
                sinks.write(found, self.output[1], self.output[0])
                return f"written to {self.output[1]}"
            return sinks.console(found)
        except QueryError as e:
            return f"error: {e}"

    def run(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            if line.strip():
                said = self.execute(line)
                if said is None:
                    return
                yield said
