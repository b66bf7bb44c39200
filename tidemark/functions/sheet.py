"""A sheet of named expressions over ordered rows, laid out in as few passes as their windows allow.

Each name is defined once, whoever needs it. Definitions are scalar expressions of other names, or moving statistics of
one. Scalars are Spark projections. Moving statistics that need no other one are one pass over chunks of rows, which hold
the rows before them that their windows reach (`functions/moving.py`); statistics of statistics are a further pass over the
same chunks where they lie. A pass takes along only what is needed after it, so that a task holds one chunk, however many
windows there are.

In SQL a moving statistic is a window function, which says what it means. Spark would evaluate such a frame anew for each
row, and keep the rows of a partition in one buffer for every layer of windows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.functions.moving import Move, added, ewm_reach, inputs

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_BACK = re.compile(r"BETWEEN (\d+) PRECEDING|lag\(\w+, (\d+)\)")


@dataclass
class Sheet:
    """chunk: what tells chunks of a series apart for Spark; sql_order: for the checking engine, which needs no chunks."""

    base: tuple[str, ...]
    chunk: tuple[str, ...] = ("symbol", "chunk")
    order: str = "minute"
    sql_order: str = "PARTITION BY symbol ORDER BY minute"
    text: dict[str, str] = field(default_factory=dict)
    outs: dict[str, str] = field(default_factory=dict)
    look: dict[str, int] = field(default_factory=dict)
    moves: dict[str, Move] = field(default_factory=dict)

    def let(self, name: str, sql: str) -> str:
        """Define an intermediate name, once."""
        if name not in self.text:
            self.text[name] = sql
            own = max([int(a or b) for a, b in _BACK.findall(sql)], default=0)
            self.look[name] = own + max([self.look.get(n, 0) for n in set(_NAME.findall(sql)) if n in self.look], default=0)
        return name

    def out(self, name: str, sql: str) -> None:
        """Define a column of the result; it may be used as a name later on."""
        if name in self.outs:
            raise ValueError(f"{name} is defined twice")
        self.outs[name] = self.let(name, sql)

    def over(self, before: int, to: int) -> str:
        return f"OVER (@ORDER ROWS BETWEEN {before} PRECEDING AND {'CURRENT ROW' if to == 0 else f'{to} PRECEDING'})"

    def roll(self, f: str, x: str, n: int, before: int = 0) -> str:
        """f of the n values of x that end `before` rows back; NULL unless all n are known."""
        frame = self.over(n - 1 + before, before)
        small = lambda v: f"CASE WHEN {v} < 1e-9 THEN 0e0 ELSE {v} END" if f.startswith("stddev") else v  # noqa: E731  of equal values, but for rounding
        return self._move(f"{f}_{x}_{n}" + (f"_b{before}" if before else ""), ("roll", f, x, n, before), f"CASE WHEN count({x}) {frame} = {n} THEN {small(f'{f}({x}) {frame}')} END")

    def mean(self, x: str, n: int) -> str:
        """roll("avg", x, n) of a base column, for means that are held against each other: added up as the SQL adds them."""
        name = self.roll("avg", x, n)
        self.moves[name] = ("mean", x, n)
        return name

    def _move(self, name: str, move: Move, sql: str) -> str:
        self.moves.setdefault(name, move)
        return self.let(name, sql)

    def pair(self, f: str, y: str, x: str, n: int) -> str:
        """f(y, x), such as corr or regr_slope, of n rows in which both are known."""
        frame = self.over(n - 1, 0)
        both = self.let(f"has_{y}_{x}", f"CASE WHEN {y} IS NOT NULL AND {x} IS NOT NULL THEN 1 END")
        if f not in ("regr_slope", "corr"):
            raise ValueError(f)
        return self._move(f"{f}_{y}_{x}_{n}", ("pair", f, y, x, n), f"CASE WHEN count({both}) {frame} = {n} THEN {f}({y}, {x}) {frame} END")

    def since(self, f: str, x: str, n: int) -> str:
        """Rows since the first place of the largest (max) or smallest (min) of the n last values of x."""
        frame = self.over(n - 1, 0)
        place = "-idx" if f == "max" else "idx"
        got = f"({f}(@PAIR({x}, {place})) {frame}).b"
        return self._move(f"since_{f}_{x}_{n}", ("since", f, x, n), f"CASE WHEN count({x}) {frame} = {n} THEN cast(idx {'+' if f == 'max' else '-'} {got} AS double) END")

    def lag(self, x: str, k: int = 1) -> str:
        return self._move(f"lag_{x}_{k}", ("lag", x, k), f"lag({x}, {k}) OVER (@ORDER)")

    def ewm(self, x: str, span: int) -> str:
        """Exponential mean of x since its first known value, y = (1 - a) y' + a x, a = 2 / (span + 1); not for sql()."""
        name = self._move(f"ewm_{x}_{span}", ("ewm", x, span), x)
        self.look[name] = ewm_reach(span) + self.look.get(x, 0)
        return name

    def layers(self, text: dict[str, str]) -> list[list[str]]:
        """The names that the result needs, by the number of projections they lie above the base."""
        level: dict[str, int] = {}

        def of(name: str) -> int:
            if name not in level:
                level[name] = 1 + max([of(n) for n in set(_NAME.findall(text[name])) if n in text and n != name], default=0)
            return level[name]

        top = max([of(n) for n in self.outs], default=0)
        return [[n for n in text if level.get(n) == k] for k in range(1, top + 1)]

    def depth(self) -> int:
        """Rows before a row that its values may depend on, through windows of windows."""
        return max([self.look[n] for n in self.outs], default=0)

    def uses(self, name: str) -> set[str]:
        """The names that a definition is made from."""
        got = inputs(self.moves[name]) if name in self.moves else set(_NAME.findall(self.text[name]))
        return {n for n in got if n != name and (n in self.text or n in self.base)}

    def steps(self) -> list[tuple[list[list[str]], list[str]]]:
        """What the result needs, pass by pass: projections of scalars, each by layers, and the moves after them. A name
        is worked out as late as those that need it allow, so that all passes but the last are over few columns."""
        earliest: dict[str, int] = {n: 0 for n in self.base}

        def of(name: str) -> int:
            if name not in earliest:
                earliest[name] = max([of(n) for n in self.uses(name)], default=0) + (name in self.moves)
            return earliest[name]

        last = max([of(n) for n in self.outs], default=0)
        ordered = [n for n in earliest if n not in self.base]  # a name stands after those that it is made from
        turn = {n: last for n in ordered}
        for n in reversed(ordered):
            for used in self.uses(n) & turn.keys():
                turn[used] = min(turn[used], turn[n] - (n in self.moves))
        layer: dict[str, int] = {}
        for n in ordered:
            layer[n] = 0 if n in self.moves else 1 + max([layer[m] for m in self.uses(n) & turn.keys() if turn[m] == turn[n]], default=0)
        named = [n for n in self.text if n in turn]
        out = []
        for k in range(last + 1):
            layers = max([layer[n] for n in named if turn[n] == k], default=0)
            scalars = [[n for n in named if (turn[n], layer[n]) == (k, i)] for i in range(1, layers + 1)]
            out.append((scalars, [n for n in named if n in self.moves and turn[n] == k + 1]))
        return out

    def apply(self, df: DataFrame, keep: tuple[str, ...], own: str | None = None) -> DataFrame:
        """df with the columns `keep` and those of the sheet. df has the base columns and, if anything moves, a chunk. own
        tells the rows that are wanted; the last pass, which is the widest, lets go of the others."""
        steps = self.steps()
        blocks = [(kind, names) for scalars, moves in steps for kind, names in (*(("scalars", x) for x in scalars), ("moves", moves)) if names]
        last = {n: len(blocks) for n in (*keep, *self.outs)}
        widest = max([k for k, (kind, _) in enumerate(blocks) if kind == "moves"], default=-1)
        if own is not None and widest < 0:
            df = df.where(own)
        elif own is not None:
            last[own] = max(widest, last.get(own, 0))
        for k, (_, names) in enumerate(blocks):
            for n in names:
                last |= {m: max(k, last.get(m, 0)) for m in self.uses(n)}
        if any(kind == "moves" for kind, _ in blocks):
            wanted = {c for c in df.columns if c in last or c in (*self.chunk, self.order)}
            df = df.select(*[c for c in df.columns if c in wanted]).repartition(*self.chunk).sortWithinPartitions(*self.chunk, self.order)
        later = lambda k: [c for c in df.columns if last.get(c, -1) > k or (c in self.chunk and any(kind == "moves" for kind, _ in blocks[k + 1 :]))]
        for k, (kind, names) in enumerate(blocks):
            stay = later(k)
            if kind == "scalars":
                df = df.selectExpr(*stay, *[f"{self.text[n]} AS {n}" for n in names])
            else:
                moves = {n: self.moves[n] for n in names}
                types = [T.StructField(n, df.schema[m[1]].dataType if m[0] == "lag" else T.DoubleType()) for n, m in moves.items()]
                df = df.mapInArrow(partial(added, moves=moves, keys=self.chunk, stay=stay, own=own if k == widest else None), T.StructType([*[df.schema[c] for c in stay], *types]))
        return df.select(*keep, *self.outs)

    def sql(self, source: str, keep: tuple[str, ...], rounded: int | None = 6) -> str:
        """The same as a query over a relation `source`, outputs rounded. A tiny number keeps shares such as 1/128, which
        end in a 5 at the next digit, from being rounded by their last bit."""

        def ansi(sql: str) -> str:
            return re.sub(r"@PAIR\(([^,]+), ([^)]+)\)", r"struct_pack(a := \1, b := \2)", sql).replace("@ORDER", self.sql_order)

        steps, last = [], source
        for k, names in enumerate(self.layers(self.text)):
            steps.append(f"layer{k} AS (SELECT *, {', '.join(f'{ansi(self.text[n])} AS {n}' for n in names)} FROM {last})")
            last = f"layer{k}"
        columns = ", ".join([*keep, *(n if rounded is None else f"CASE WHEN abs({n}) < 1e3 THEN round({n} + 1e-9, {rounded}) WHEN abs({n}) < 1e9 THEN round({n} + 1e-9, 2) ELSE round({n}, 0) END + 0 AS {n}" for n in self.outs)])
        return ", ".join(steps) + f" SELECT {columns} FROM {last}"
