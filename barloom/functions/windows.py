"""Row-count window features over one ticker's own calendar.

``Trailing`` gathers every windowed quantity once, under a column name, so that any
number of features shares one exchange and one sort:

    t = Trailing("ticker")
    out = {"ret_5d": t.simple_return("adj_close", 5), "dist_ma_20": t.ma_distance("adj_close", 20)}
    features = t.compute(bars, out)

A windowed value exists only when every one of its inputs is present.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.numeric import ratio


def ticker_window(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("date")


def trailing(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows - 1), 0)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def up_label(fwd_ret: Column, threshold: float = 0.0) -> Column:
    """1 when the forward return exceeds the threshold; missing stays missing."""
    return F.when(fwd_ret.isNull(), None).otherwise((fwd_ret > threshold).cast("int"))


class Trailing:
    """Named trailing quantities of one ticker's rows by date, plus formulas on them.

    Spark evaluates a sliding frame by folding all of its rows again for every row, so a
    60-row deviation costs 60 updates a row. Here a window of n rows is put together from
    already known blocks of 1, 4, 16, 64 ... rows that end at earlier offsets, each fetched
    with `lag`: a dozen look-ups instead of n updates, all in generated code. Summaries of
    adjacent blocks combine exactly (sum; sum of squared deviations; high, low, drawdown). A
    missing input or a short history makes a block, and so the window, missing.

    The stages are kept apart by the window operators between them, which keeps each
    generated method small enough for the JIT compiler.
    """

    RADIX = 4
    FIELDS = {"mean": ("sum",), "std": ("sum", "sq"), "drawdown": ("sum", "hi", "lo", "dd")}

    def __init__(self, *keys: str):
        names = ", ".join(f"`{k}`" for k in keys or ("ticker",))
        self.over = f"OVER (PARTITION BY {names} ORDER BY `date`)"
        self.shifts: dict[str, str] = {}
        self.rolls: dict[str, tuple[str, str, int]] = {}

    # ---- what a formula may ask for

    def back(self, x: str, rows: int) -> Column:
        return self._shift(f"_{x}_back{rows}", f"lag(`{x}`, {rows})")

    def ahead(self, x: str, rows: int) -> Column:
        return self._shift(f"_{x}_ahead{rows}", f"lead(`{x}`, {rows})")

    def mean(self, x: str, rows: int) -> Column:
        return self._roll("mean", x, rows)

    def deviation(self, x: str, rows: int) -> Column:
        return self._roll("std", x, rows)

    def max_drawdown(self, price: str, rows: int) -> Column:
        """Worst fall from a peak inside each window; the peak restarts with the window."""
        return self._roll("drawdown", price, rows)

    def _shift(self, name: str, call: str) -> Column:
        self.shifts[name] = f"{call} {self.over} AS `{name}`"
        return F.col(name)

    def _roll(self, kind: str, x: str, rows: int) -> Column:
        name = f"_{x}_{kind}{rows}"
        self.rolls[name] = (kind, x, rows)
        return F.col(name)

    # ---- formulas

    def simple_return(self, price: str, rows: int) -> Column:
        if rows < 1:
            raise ValueError(f"return window must be >= 1, got {rows}")
        return ratio(F.col(price), self.back(price, rows)) - 1.0

    def volatility(
        self, daily_return: str, rows: int, annualise: bool = True, periods: int = 252
    ) -> Column:
        """Sample deviation of the last `rows` daily returns."""
        if rows < 2:
            raise ValueError(f"volatility window must be >= 2, got {rows}")
        std = self.deviation(daily_return, rows)
        return std * math.sqrt(periods) if annualise else std

    def ma_distance(self, price: str, rows: int) -> Column:
        return ratio(F.col(price), self.mean(price, rows)) - 1.0

    def ma_spread(self, price: str, fast: int, slow: int) -> Column:
        if fast >= slow:
            raise ValueError(f"ma_spread fast window ({fast}) must be below slow window ({slow})")
        return ratio(self.mean(price, fast), self.mean(price, slow)) - 1.0

    def relative_to_mean(self, x: str, rows: int) -> Column:
        return ratio(F.col(x), self.mean(x, rows))

    def forward_return(self, price: str, horizon: int) -> Column:
        if horizon < 1:
            raise ValueError("horizon must be >= 1")
        return ratio(self.ahead(price, horizon), F.col(price)) - 1.0

    # ---- evaluation

    def compute(self, df: DataFrame, keep: list, out: dict[str, Column]) -> DataFrame:
        """`keep` columns of `df` plus the finished formulas in `out`."""
        base = _quoted(df.columns)
        if self.rolls:
            df = self._with_rolls(df, base)
        if self.shifts:
            df = df.selectExpr(*base, *_quoted(self.rolls), *self.shifts.values())
        return df.select(*keep, *(c.alias(name) for name, c in out.items()))

    def _with_rolls(self, df: DataFrame, base: list[str]) -> DataFrame:
        fields: dict[str, dict[str, None]] = {}
        for kind, x, _ in self.rolls.values():
            fields.setdefault(x, {}).update(dict.fromkeys(self.FIELDS[kind]))
        longest = max(rows for _, _, rows in self.rolls.values())
        known, size = list(base), 1
        while size * self.RADIX <= longest:
            blocks = [(size, size * i) for i in range(self.RADIX)]
            size *= self.RADIX
            states = [(x, f) for x in fields if self._uses(x, size) for f in fields[x]]
            lagged = df.selectExpr(*known, *self._lags((x, f, blocks) for x, f in states))
            df = lagged.selectExpr(
                *known, *(f"{self._merge(x, f, blocks)} AS {_state(x, f, size)}" for x, f in states)
            )
            known += [_state(x, f, size) for x, f in states]
        parts = [
            (x, f, self._blocks(rows)) for kind, x, rows in self.rolls.values()
            for f in self.FIELDS[kind]
        ]
        df = df.selectExpr(*known, *self._lags(parts))
        values = (f"{self._value(*roll)} AS `{name}`" for name, roll in self.rolls.items())
        return df.selectExpr(*base, *values)

    def _uses(self, x: str, size: int) -> bool:
        return any(column == x and rows >= size for _, column, rows in self.rolls.values())

    def _blocks(self, rows: int) -> list[tuple[int, int]]:
        """(size, offset) pieces covering `rows` rows back from the current one."""
        size, pieces, offset = 1, [], 0
        while size * self.RADIX <= rows:
            size *= self.RADIX
        while rows:
            while size > rows:
                size //= self.RADIX
            pieces.append((size, offset))
            offset += size
            rows -= size
        return pieces

    def _lags(self, parts) -> list[str]:
        needed = {}
        for x, f, blocks in parts:
            for size, offset in blocks:
                source = _state(x, f, size)
                if offset and source:
                    needed[_at(source, offset)] = f"lag({source}, {offset}) {self.over}"
        return [f"{call} AS {name}" for name, call in needed.items()]

    def _piece(self, x: str, f: str, size: int, offset: int) -> str:
        source = _state(x, f, size)
        if source is None:
            return "0.0D"
        return _at(source, offset) if offset else source

    def _merge(self, x: str, f: str, blocks: list[tuple[int, int]]) -> str:
        """Field `f` of the union of adjacent blocks."""
        oldest_first = sorted(blocks, key=lambda b: -b[1])
        pieces = [self._piece(x, f, *b) for b in oldest_first]
        if len(pieces) == 1:
            return pieces[0]
        if f == "sum":
            return "(" + " + ".join(pieces) + ")"
        if f == "sq":
            # Squares inside the blocks plus those of the block means around the joint mean.
            mean = f"{self._merge(x, 'sum', blocks)} / {sum(size for size, _ in blocks)}D"
            for size, offset in oldest_first:
                gap = f"({self._piece(x, 'sum', size, offset)} / {size}D - {mean})"
                pieces.append(f"{size}D * {gap} * {gap}")
            return "(" + " + ".join(piece for piece in pieces if piece != "0.0D") + ")"
        if f in ("hi", "lo"):
            return f"{'greatest' if f == 'hi' else 'least'}({', '.join(pieces)})"
        highs = [self._piece(x, "hi", *b) for b in oldest_first]
        lows = [self._piece(x, "lo", *b) for b in oldest_first]
        for i in range(1, len(highs)):
            peak = highs[0] if i == 1 else f"greatest({', '.join(highs[:i])})"
            pieces.append(f"{lows[i]} / {peak} - 1.0D")
        return f"least({', '.join(pieces)})"

    def _value(self, kind: str, x: str, rows: int) -> str:
        blocks = self._blocks(rows)
        total = self._merge(x, "sum", blocks)
        if kind == "mean":
            return f"{total} / {rows}D"
        if kind == "std":
            return f"sqrt({self._merge(x, 'sq', blocks)} / {rows - 1}D)"
        return f"if({total} is null, null, {self._merge(x, 'dd', blocks)})"


def _state(x: str, field: str, size: int) -> str | None:
    """Column that holds a block summary; single rows need none but their value."""
    if size > 1:
        return f"`_{x}_{field}_{size}`"
    return None if field in ("sq", "dd") else f"`{x}`"


def _at(source: str, offset: int) -> str:
    return f"{source[:-1]}_at{offset}`"


def _quoted(names) -> list[str]:
    return [f"`{n}`" for n in names]
