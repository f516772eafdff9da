"""Window and recurrence kernels over bars(symbol, ts, open, high, low, close, volume).

``indexed`` numbers a symbol's rows once; every window below uses its partition and order, so one
shuffle and one sort serve all of them. Rows: W01-W23, W35, W42-W45, kernel R1.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of the linear recurrence, and blocks of a superblock.
BLOCK, SUPER = 64, 64
#: What a carry's older parts may fall to before they are left out: below the last bit of a double.
_NOTHING = 1e-18


def _all():
    return Window.partitionBy("symbol").orderBy("sup", "blk", "pos")


def _blk():
    return Window.partitionBy("symbol", "sup", "blk").orderBy("pos")


def _sup():
    return Window.partitionBy("symbol", "sup").orderBy("blk", "pos")


def before():
    """All earlier rows of the symbol."""
    return _all().rowsBetween(Window.unboundedPreceding, -1)


def next_of(c: Column, own: bool = False) -> Column:
    """The first value that is not null among the symbol's later rows, or from the row itself on (``own``).

    Rows are read backwards: a frame that ends with the symbol would be folded anew at each row.
    """
    return F.last(c, ignorenulls=True).over(Window.partitionBy("symbol").orderBy(F.desc("rn")).rowsBetween(Window.unboundedPreceding, 0 if own else -1))


def newest(c: str | Column) -> Column:
    """The value of the symbol's last row."""
    return F.last(col(c)).over(_all().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def with_ahead(df: DataFrame, flag: Column, n: int, *columns: str) -> DataFrame:
    """Rows of indexed bars that have the flag, with ``_path``: their next ``n`` rows as in ``ahead``.

    A block's rows stand in one array, the blocks that follow are looked up beside it, and flagged rows
    cut their part: work grows with the rows and the flagged ones, not with ``n`` for each row.
    """
    d = df.groupBy("symbol", "sup", "blk").agg(F.array_sort(F.collect_list(F.struct("rn", *columns))).alias("_b"), F.collect_list(F.when(flag, F.struct(*[c for c in df.columns if c not in ("symbol", "sup", "blk")]))).alias("_own"))
    blocks = Window.partitionBy("symbol").orderBy("sup", "blk")
    rest = [F.coalesce(F.lead("_b", k).over(blocks), F.slice("_b", 1, 0)) for k in range(1, -(-n // BLOCK) + 1)]
    d = d.withColumn("_all", F.concat("_b", *rest)).select("symbol", "sup", "blk", "_all", F.explode("_own").alias("_o"))
    return d.select("symbol", "sup", "blk", "_o.*", F.slice("_all", (F.col("_o.pos") + 2).cast("int"), F.lit(n)).alias("_path"))


def ahead(n: int, *columns: str) -> Column:
    """The next ``n`` rows of the symbol in order, fewer at its end, as structs of rn and ``columns``."""
    return F.collect_list(F.struct("rn", *columns)).over(_all().rowsBetween(1, n))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def indexed(bars: DataFrame) -> DataFrame:
    """Add rn (1-based), blk, pos and sup: rn = blk * BLOCK + pos + 1, and SUPER blocks stand in a superblock."""
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")).cast("long")
    return bars.withColumn("rn", rn).withColumn("blk", F.floor((F.col("rn") - 1) / BLOCK).cast("long")).withColumn("pos", (F.col("rn") - 1) % BLOCK).withColumn("sup", F.floor(F.col("blk") / SUPER).cast("long"))


def lag(c: str | Column, n: int = 1) -> Column:
    """The value n rows before."""
    return F.lag(col(c), n).over(_all())


def lead(c: str | Column, n: int = 1) -> Column:
    return F.lead(col(c), n).over(_all())


def frame(n: int, shift: int = 0):
    """The n rows that end ``shift`` rows before the current one."""
    return _all().rowsBetween(-n + 1 - shift, -shift)


def cumulative():
    return _all().rowsBetween(Window.unboundedPreceding, 0)


def guarded(value: Column, c: str | Column, n: int, w) -> Column:
    """Null until the frame holds n values."""
    return F.when(F.count(col(c)).over(w) >= n, value)


def pct_change(c: str | Column, n: int = 1) -> Column:
    """C / c[n rows ago] - 1; null where that is 0."""
    return col(c) / F.nullif(lag(c, n), F.lit(0.0)) - 1


def sma(c: str | Column, n: int, shift: int = 0) -> Column:
    """Mean of the frame, null before n values; with a shift, of the rows before."""
    return guarded(F.avg(col(c)).over(frame(n, shift)), c, n, frame(n, shift))


def rolling_min(c: str | Column, n: int, shift: int = 0) -> Column:
    """W04."""
    return guarded(F.min(col(c)).over(frame(n, shift)), c, n, frame(n, shift))


def rolling_max(c: str | Column, n: int, shift: int = 0) -> Column:
    """W04."""
    return guarded(F.max(col(c)).over(frame(n, shift)), c, n, frame(n, shift))


def rolling_sum(c: str | Column, n: int) -> Column:
    return guarded(F.sum(col(c)).over(frame(n)), c, n, frame(n))


def rolling_std(c: str | Column, n: int, ddof: int = 0) -> Column:
    """Population (ddof 0) or sample (ddof 1) deviation of the frame."""
    f = F.stddev_samp if ddof else F.stddev_pop
    return guarded(f(col(c)).over(frame(n)), c, n, frame(n))


def crossed_above(a: Column, b: Column, a_before: Column, b_before: Column) -> Column:
    """A rose over b with this row; false where anything is unknown."""
    return F.coalesce((a > b) & (a_before <= b_before), F.lit(False))


def crossed_below(a: Column, b: Column, a_before: Column, b_before: Column) -> Column:
    """W42."""
    return F.coalesce((a < b) & (a_before >= b_before), F.lit(False))


def linear(df: DataFrame, x: str, out: str, gain: float, start: int = 1) -> DataFrame:
    """Kernel R1: y = (1 - gain) * y_before + gain * x, y at row ``start`` is x there; null before. See ``linears``."""
    return linears(df, [(x, out, gain, start)])


def linears(df: DataFrame, wanted: list[tuple[str, str, float, int]]) -> DataFrame:
    """Kernel R1 for several (x, out, gain, start) side by side: each step is one window for all of them.

    Within a block a recurrence is a scaled running sum. The ends of earlier blocks are carried on by
    a scaled running sum within the superblock, and its last value by that of the superblocks before;
    a fast decay needs the last few rows or blocks alone. All windows share one sort, and the work is
    linear in the rows. ``x`` must not be null from row ``start`` on.
    """
    named = {}
    for i, (x, _, gain, start) in enumerate(wanted):
        named[f"_ru{i}"] = F.when(F.col("rn") == start, F.col(x)).when(F.col("rn") > start, F.lit(gain) * F.col(x)).otherwise(0.0)
    few = [i for i, w in enumerate(wanted) if 1.0 - w[2] < 1e-3]  # d ** -63 would overflow; five rows hold all there is
    rest = [i for i in range(len(wanted)) if i not in few]
    d = {i: 1.0 - w[2] for i, w in enumerate(wanted)}
    df = df.withColumns({c: x if int(c[3:]) in few else x * F.pow(F.lit(d[int(c[3:])]), -F.col("pos")) for c, x in named.items()})
    scaled = {f"_rl{i}": F.pow(F.lit(d[i]), F.col("pos")) * F.sum(f"_ru{i}").over(_blk().rowsBetween(Window.unboundedPreceding, 0)) for i in rest}
    df = df.withColumns(scaled) if scaled else df
    end, block, place = F.col("pos") == BLOCK - 1, {i: d[i] ** BLOCK for i in rest}, F.col("blk") % SUPER
    slow = [i for i in rest if block[i] >= 1e-4]
    if slow:
        df = df.withColumns({f"_re{i}": F.when(end, F.col(f"_rl{i}") * F.pow(F.lit(block[i]), -(place + 1))).otherwise(0.0) for i in slow})
        df = df.withColumns({f"_rs{i}": F.sum(f"_re{i}").over(_sup().rowsBetween(Window.unboundedPreceding, 0)) for i in slow})
    ends = {i: (F.pow(F.lit(block[i]), F.lit(SUPER)) * F.col(f"_rs{i}"), SUPER * BLOCK, block[i] ** SUPER) if i in slow else (F.col(f"_rl{i}"), BLOCK, block[i]) for i in rest}
    df, carries = _ends(df, ends)
    out = {}
    for i, (_, name, _, start) in enumerate(wanted):
        if i in few:
            y = sum(F.coalesce(lag(f"_ru{i}", k), F.lit(0.0)) * d[i] ** k for k in range(1, 6)) + F.col(f"_ru{i}")
        else:
            carry = F.pow(F.lit(block[i]), place) * (F.col(f"_rs{i}") - F.col(f"_re{i}") + carries[i]) if i in slow else carries[i]
            y = F.col(f"_rl{i}") + F.pow(F.lit(d[i]), F.col("pos") + 1) * carry
        out[name] = F.when(F.col("rn") >= start, y)
    return df.withColumns(out).drop(*[c for c in df.columns if re.fullmatch(r"_r[ulesvc]\d+", c)])


def _ends(df: DataFrame, values: dict[int, tuple[Column, int, float]]) -> tuple[DataFrame, dict[int, Column]]:
    """The carries from (value, rows of a stretch, decay) at the ends of stretches: the newest, the one before times ``decay``, and so on."""
    terms = {i: 1 + max(0, math.ceil(math.log(_NOTHING) / math.log(decay))) if 0 < decay < 1 else 1 for i, (_, _, decay) in values.items()}
    carries, many = {}, [i for i in values if terms[i] > 32]  # a mean over very many rows: few superblocks stand against so slow a decay
    if many:
        last = (F.col("pos") == BLOCK - 1) & (F.col("blk") % SUPER == SUPER - 1)
        df = df.withColumns({f"_rc{i}": F.collect_list(F.when(last if values[i][1] > BLOCK else F.col("pos") == BLOCK - 1, values[i][0])).over(before()) for i in many})
        for i in many:
            decay = F.lit(values[i][2])
            carries[i] = F.aggregate(f"_rc{i}", F.lit(0.0), lambda c, e: c * decay + e)  # noqa: B023 (called at once)
    rest = [i for i in values if i not in many]
    if not rest:
        return df, carries
    # From a stretch's first row all earlier ends lie at fixed distances: one window looks them all up, and another tells the stretch.
    df = df.withColumns({f"_rv{i}": values[i][0] for i in rest})
    first = {BLOCK: F.col("pos") == 0, BLOCK * SUPER: (F.col("pos") == 0) & (F.col("blk") % SUPER == 0)}
    carry = {i: sum((F.coalesce(lag(f"_rv{i}", 1 + k * values[i][1]), F.lit(0.0)) * values[i][2] ** k for k in range(terms[i])), F.lit(0.0)) for i in rest}
    df = df.withColumns({f"_rc{i}": F.when(first[values[i][1]], carry[i]) for i in rest})
    told = {BLOCK: _blk(), BLOCK * SUPER: _sup()}
    df = df.withColumns({f"_rc{i}": F.first(f"_rc{i}").over(told[values[i][1]].rowsBetween(Window.unboundedPreceding, 0)) for i in rest})
    return df, carries | {i: F.coalesce(f"_rc{i}", F.lit(0.0)) for i in rest}


class Moving(dict):
    """Moving values: out to (kind, column, rows) or (kind, column, rows, shift); see ``moving``."""


def _stretch(n: int) -> int:
    """Rows of the stretches that a frame of ``n`` rows is made of: a power of 4, under 8 of them."""
    s = 1
    while s * 8 <= n:
        s *= 4
    return s


def _parts(kind: str, n: int) -> list[tuple[int, int]]:
    """Stretches (rows, distance of their end) that make a frame of ``n`` rows; those of least and greatest values may overlap."""
    s = 1 if kind == "list" else _stretch(n)
    if kind in ("min", "max"):
        return [(s, at) for at in sorted({*range(0, n - s + 1, s), n - s})]
    out, at = [], 0
    while at < n:
        if at + s > n:
            s //= 4
            continue
        out.append((s, at))
        at += s
    return out


def moving(df: DataFrame, wanted: Moving) -> DataFrame:
    """Sums, means, least and greatest values, deviations (std, ddof 0) and lists of moving frames; null unless all rows of the frame have a value.

    A frame is put together from stretches of 4 rows, those of 16 from these, and so on, by looking
    back: one window a level serves all frames, and no frame is folded anew at each row. Sums are
    exact as far as those of the frame's rows are; deviations are merged from those of the stretches,
    by differences from the newest, so a constant has 0.
    """
    full = {out: (kind, c, n, rest[0] if rest else 0) for out, (kind, c, n, *rest) in wanted.items()}
    names: dict[tuple[str, str, int], str] = {}  # of a kind's values over stretches
    spare: list[str] = []

    def named(name: str) -> str:
        spare.append(name)
        return name

    def used(kind: str) -> tuple[str, ...]:
        return {"mean": ("sum",), "std": ("sum", "dev"), "list": ("sum",)}.get(kind, (kind,))

    def looked_up(df: DataFrame, wants: set[tuple[str, int]]) -> tuple[DataFrame, dict[tuple[str, int], Column]]:
        at = {(c, k): c if k == 0 else named(f"_mv_{c}_{k}") for c, k in sorted(wants)}
        new = {name: lag(c, k) for (c, k), name in at.items() if k and name not in df.columns}
        return (df.withColumns(new) if new else df), {x: F.col(name) for x, name in at.items()}

    def value(kind: str, c: str, rows: int) -> str | None:
        """The column of a stretch's value; single rows are their own, without deviation."""
        return names[kind, c, rows] if rows > 1 else None if kind == "dev" else c

    def merged(kind: str, c: str, parts: list[tuple[int, int]], at: dict[tuple[str, int], Column]) -> Column:
        x = [at[value("sum" if kind == "dev" else kind, c, m), k] for m, k in parts]
        if kind in ("min", "max"):
            some = x[0].isNotNull()
            for v in x[1:]:
                some = some & v.isNotNull()
            return F.when(some, (F.least if kind == "min" else F.greatest)(*x)) if len(x) > 1 else x[0]
        if kind == "sum":
            while len(x) > 1:
                x = [a + b for a, b in zip(x[::2], x[1::2])] + x[len(x) // 2 * 2:]
            return x[0]
        # Differences from the newest stretch: it is one of them, so what is taken off leaves a share of 1 in n at least.
        d = [(m, v / m - x[0] / parts[0][0]) for (m, _), v in zip(parts[1:], x[1:])]
        q = [at[value("dev", c, m), k] for m, k in parts if m > 1]
        one, two = sum((m * v for m, v in d), F.lit(0.0)), sum((m * v * v for m, v in d), F.lit(0.0))
        return F.when(x[0].isNotNull(), sum(q, F.lit(0.0)) + two - one * one / sum(m for m, _ in parts))

    def columns(kind: str, c: str, parts: list[tuple[int, int]], shift: int = 0) -> set[tuple[str, int]]:
        return {(v, k + shift) for u in used(kind) for m, k in parts if (v := value(u, c, m)) is not None}

    largest = {(u, c): max(_parts(kind, n)[0][0] for kind, c2, n, _ in full.values() if c2 == c and u in used(kind)) for k2, c, _, _ in full.values() for u in used(k2)}
    rows = 4
    while level := [key for key, most in largest.items() if most >= rows]:
        parts = [(rows // 4, k * rows // 4) for k in range(4)]
        df, at = looked_up(df, {x for u, c in level for x in columns("std" if u == "dev" else u, c, parts)})
        df = df.withColumns({f"_mv{rows}_{u}_{c}": merged(u, c, parts, at) for u, c in level})
        names |= {(u, c, rows): named(f"_mv{rows}_{u}_{c}") for u, c in level}
        rows *= 4
    df, at = looked_up(df, {x for kind, c, n, shift in full.values() for x in columns(kind, c, _parts(kind, n), shift)})
    out = {}
    for name, (kind, c, n, shift) in full.items():
        parts = _parts(kind, n)
        back = {(v, k): at[v, k + shift] for v, k in columns(kind, c, parts)}
        if kind == "list":
            x = [back[c, k] for _, k in reversed(parts)]
            out[name] = F.when(merged("sum", c, parts, back).isNotNull(), F.array(*x))
        elif kind == "mean":
            out[name] = merged("sum", c, parts, back) / n
        elif kind == "std":
            out[name] = F.sqrt(merged("dev", c, parts, back) / n)
        else:
            out[name] = merged(kind, c, parts, back)
    return df.withColumns(out).drop(*dict.fromkeys(spare))


class Recipe:
    """An indicator as steps: ``columns`` to add, ``Moving`` values, ``means`` (x, out, gain, start) to run, and so on; ``spare`` columns go at the end."""

    def __init__(self, *steps: dict[str, Column] | Moving | list[tuple[str, str, float, int]], spare: tuple[str, ...] = ()):
        self.steps, self.spare = steps, spare


def together(df: DataFrame, *recipes: Recipe, run=linears) -> DataFrame:
    """Indicators side by side: recurrences of several recipes share their windows, step by step; ``run`` is the kernel."""
    waiting = [list(r.steps) for r in recipes]
    while any(waiting):
        columns: dict[str, Column] = {}
        for w in waiting:
            if w and isinstance(w[0], dict) and not isinstance(w[0], Moving):
                columns |= w.pop(0)
        if columns:
            df = df.withColumns(columns)
            continue
        frames = Moving()
        for w in waiting:
            if w and isinstance(w[0], Moving):
                frames |= w.pop(0)
        if frames:
            df = moving(df, Moving(frames))
            continue
        means = [m for w in waiting if w for m in w.pop(0)]
        df = run(df, means)
    return df.drop(*dict.fromkeys(c for r in recipes for c in r.spare))


def _from(start: int, c: str) -> Column:
    return F.when(F.col("rn") >= start, F.col(c))


def ema_recipe(x: str, out: str, span: int, start: int = 1, min_periods: int = 0) -> Recipe:
    return Recipe([(x, out, 2.0 / (span + 1), start)], *([{out: _from(start + min_periods - 1, out)}] if min_periods else []))


def ema(df: DataFrame, x: str, out: str, span: int, start: int = 1, min_periods: int = 0) -> DataFrame:
    """Exponential mean by span, from the first value on; null before ``min_periods`` values."""
    return together(df, ema_recipe(x, out, span, start, min_periods))


def wilder(df: DataFrame, x: str, out: str, n: int, start: int = 1, min_periods: int | None = None) -> DataFrame:
    """Wilder's mean, gain 1/n; null before ``min_periods`` values (n unless told)."""
    return together(df, Recipe([(x, out, 1.0 / n, start)], {out: _from(start + (n if min_periods is None else min_periods) - 1, out)}))


def rsi_recipe(out: str, n: int, c: str = "close", rule: str = "lab") -> Recipe:
    d, g, s, ag, al = (f"_{k}_{out}" for k in ("d", "g", "s", "ag", "al"))
    gain, loss = _from(n + 1, ag), _from(n + 1, al)
    base = 100.0 - 100.0 / (1.0 + gain / F.nullif(loss, F.lit(0.0)))
    if rule == "lab":
        v = F.when(gain == 0, 0.0).when(loss == 0, 100.0).otherwise(base)
    elif rule == "fifty":
        v = F.when((loss == 0) & (gain == 0), 50.0).when(loss == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), base)))
    else:
        v = base
    return Recipe({d: F.col(c) - lag(c)}, {g: F.greatest(d, F.lit(0.0)), s: F.greatest(-F.col(d), F.lit(0.0))}, [(g, ag, 1.0 / n, 2), (s, al, 1.0 / n, 2)], {out: F.when(gain.isNotNull(), v)}, spare=(d, g, s, ag, al))


def rsi(df: DataFrame, out: str, n: int, c: str = "close", rule: str = "lab") -> DataFrame:
    """W06 (rule lab: no loss 100, then no gain 0), W07 (rule fifty: neither 50), W08 (rule null: no loss null)."""
    return together(df, rsi_recipe(out, n, c, rule))


def true_ranges() -> Column:
    """The first row's is high - low."""
    pc = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def true_range(df: DataFrame, out: str = "tr") -> DataFrame:
    """The first row's is high - low."""
    return df.withColumn(out, true_ranges())


def atr_recipe(out: str, n: int) -> Recipe:
    tr = f"_tr_{out}"
    return Recipe({tr: true_ranges()}, [(tr, out, 1.0 / n, 1)], {out: _from(n, out)}, spare=(tr,))


def atr(df: DataFrame, out: str, n: int) -> DataFrame:
    """W10."""
    return together(df, atr_recipe(out, n))


def adx_recipe(n: int, out: str = "adx") -> Recipe:
    p, m, tr, sp, sm, a, dx = (f"_{k}_{out}" for k in ("p", "m", "tr", "sp", "sm", "a", "dx"))
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    width, total = F.nullif(_from(n, a), F.lit(0.0)), F.nullif(F.col("plus_di") + F.col("minus_di"), F.lit(0.0))
    return Recipe({p: F.when((up > down) & (up > 0), up).otherwise(0.0), m: F.when((down > up) & (down > 0), down).otherwise(0.0), tr: true_ranges()}, [(p, sp, 1.0 / n, 1), (m, sm, 1.0 / n, 1), (tr, a, 1.0 / n, 1)],
                  {"plus_di": 100.0 * _from(n, sp) / width, "minus_di": 100.0 * _from(n, sm) / width}, {dx: F.when(F.col("rn") >= n, F.coalesce(100.0 * F.abs(F.col("plus_di") - F.col("minus_di")) / total, F.lit(0.0)))},
                  [(dx, out, 1.0 / n, n)], {out: _from(2 * n - 1, out)}, spare=(p, m, tr, sp, sm, a, dx))


def adx(df: DataFrame, n: int, out: str = "adx") -> DataFrame:
    """Adds adx, plus_di and minus_di; directional movement is 0 on the first row."""
    return together(df, adx_recipe(n, out))


def williams_r(n: int) -> Column:
    """-100 * (highest high - close) / range; null for no range."""
    hi, lo = rolling_max("high", n), rolling_min("low", n)
    return -100.0 * (hi - F.col("close")) / F.nullif(hi - lo, F.lit(0.0))


def macd_recipe(fast: int = 12, slow: int = 26, signal: int = 9, min_periods: bool = True) -> Recipe:
    f, w = (lambda n, c: _from(n if min_periods else 1, c)), slow if min_periods else 1
    return Recipe([("close", "_macd_f", 2.0 / (fast + 1), 1), ("close", "_macd_w", 2.0 / (slow + 1), 1)], {"macd": f(fast, "_macd_f") - f(slow, "_macd_w")}, [("macd", "macd_signal", 2.0 / (signal + 1), w)],
                  {"macd_signal": _from(w + (signal if min_periods else 1) - 1, "macd_signal")}, {"macd_hist": F.col("macd") - F.col("macd_signal")}, spare=("_macd_f", "_macd_w"))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, min_periods: bool = True) -> DataFrame:
    """Adds macd, macd_signal and macd_hist; without min_periods all start on the first row."""
    return together(df, macd_recipe(fast, slow, signal, min_periods))


def stochastic_recipe(n: int, smooth: int, out: str = "stoch_k") -> Recipe:
    lo, hi, k = (f"_{x}_{out}" for x in ("lo", "hi", "k"))
    return Recipe(Moving({lo: ("min", "low", n), hi: ("max", "high", n)}), {k: 100.0 * (F.col("close") - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0))}, Moving({out: ("mean", k, smooth)}), spare=(lo, hi, k))


def stochastic(df: DataFrame, n: int, smooth: int, out: str = "stoch_k") -> DataFrame:
    """%K smoothed by a simple mean."""
    return together(df, stochastic_recipe(n, smooth, out))


def _typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3.0


def cci_recipe(n: int, out: str = "cci") -> Recipe:
    tp, mean, rows = (f"_{x}_{out}" for x in ("tp", "m", "w"))
    mad = F.aggregate(rows, F.lit(0.0), lambda a, x: a + F.abs(x - F.col(mean))) / n
    return Recipe({tp: _typical()}, Moving({mean: ("mean", tp, n), rows: ("list", tp, n)}), {out: (F.col(tp) - F.col(mean)) / F.nullif(0.015 * mad, F.lit(0.0))}, spare=(tp, mean, rows))


def cci(df: DataFrame, n: int, out: str = "cci") -> DataFrame:
    """Distance from the mean in units of 0.015 mean absolute deviations."""
    return together(df, cci_recipe(n, out))


def mfi_recipe(n: int, out: str = "mfi") -> Recipe:
    tp, up, down, p, m = (f"_{x}_{out}" for x in ("tp", "up", "down", "p", "n"))
    flow, d = F.col(tp) * F.col("volume"), F.col(tp) - lag(tp)
    v = F.when(F.col(m) == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col(p) / F.nullif(F.col(m), F.lit(0.0))))
    return Recipe({tp: _typical()}, {up: F.when(d > 0, flow).otherwise(0.0), down: F.when(d < 0, flow).otherwise(0.0)}, Moving({p: ("sum", up, n), m: ("sum", down, n)}), {out: F.when(F.col(p).isNotNull(), v)}, spare=(tp, up, down, p, m))


def mfi(df: DataFrame, n: int, out: str = "mfi") -> DataFrame:
    """Money flow index; 100 without negative flow."""
    return together(df, mfi_recipe(n, out))


def relative_volume(n: int) -> Column:
    """Volume over the mean of the n rows before."""
    return F.col("volume") / F.nullif(sma("volume", n, 1), F.lit(0.0))


def obv_recipe(out: str = "obv") -> Recipe:
    return Recipe({f"_v_{out}": F.coalesce(F.signum(F.col("close") - lag("close")), F.lit(0.0)) * F.col("volume")}, {out: F.sum(f"_v_{out}").over(cumulative())}, spare=(f"_v_{out}",))


def obv(df: DataFrame, out: str = "obv") -> DataFrame:
    """Running sum of volume signed by the close's change."""
    return together(df, obv_recipe(out))


def vwap_recipe(n: int, out: str = "vwap") -> Recipe:
    pv, a, z = (f"_{x}_{out}" for x in ("pv", "a", "z"))
    return Recipe({pv: _typical() * F.col("volume")}, Moving({a: ("sum", pv, n), z: ("sum", "volume", n)}), {out: F.col(a) / F.nullif(F.col(z), F.lit(0.0))}, spare=(pv, a, z))


def rolling_vwap(df: DataFrame, n: int, out: str = "vwap") -> DataFrame:
    """Ratio of rolling sums."""
    return together(df, vwap_recipe(n, out))


def session_vwap(df: DataFrame, zone: str = "UTC", out: str = "session_vwap") -> DataFrame:
    """Running volume-weighted price that restarts each local day; ts must be a timestamp."""
    df = df.withColumn("_day", F.to_date(F.from_utc_timestamp("ts", zone))).withColumn("_pv", (F.col("high") + F.col("low") + F.col("close")) / 3.0 * F.col("volume"))
    w = Window.partitionBy("symbol", "_day").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum("_pv").over(w) / F.nullif(F.sum("volume").over(w), F.lit(0.0))).drop("_day", "_pv")


def bar_spacing(bars: DataFrame) -> DataFrame:
    """Median seconds between a symbol's bars, and the VWAP mode that ``auto`` picks (session under a day)."""
    gap = bars.withColumn("gap", F.unix_timestamp("ts") - F.lag(F.unix_timestamp("ts")).over(Window.partitionBy("symbol").orderBy("ts")))
    out = gap.groupBy("symbol").agg(F.percentile("gap", 0.5).alias("spacing"))
    return out.withColumn("mode", F.when(F.col("spacing") < 86400, "session").otherwise("rolling"))


def bollinger_recipe(n: int = 20, k: float = 2.0) -> Recipe:
    sd, close = F.col("_sd"), F.col("close")
    return Recipe(Moving({"bb_mid": ("mean", "close", n), "_sd": ("std", "close", n)}), {"bb_low": F.col("bb_mid") - k * sd, "bb_high": F.col("bb_mid") + k * sd},
                  {"bb_width": (F.col("bb_high") - F.col("bb_low")) / F.nullif(F.col("bb_mid"), F.lit(0.0)), "bb_z": (close - F.col("bb_mid")) / F.nullif(sd, F.lit(0.0)), "bb_pos": (close - F.col("bb_low")) / F.nullif(F.col("bb_high") - F.col("bb_low"), F.lit(0.0))}, spare=("_sd",))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """bb_mid, bb_low, bb_high, bb_width, bb_z and bb_pos (0 at the lower band, 1 at the upper)."""
    return together(df, bollinger_recipe(n, k))


def candle_patterns(df: DataFrame) -> DataFrame:
    """bull_engulf, bear_engulf, harami and piercing by the row before."""
    o, c, po, pc, pl = F.col("open"), F.col("close"), lag("open"), lag("close"), lag("low")
    no = F.lit(False)
    df = df.withColumn("bull_engulf", F.coalesce((pc < po) & (c > o) & (o <= pc) & (c >= po), no))
    df = df.withColumn("bear_engulf", F.coalesce((pc > po) & (c < o) & (o >= pc) & (c <= po), no))
    df = df.withColumn("harami", F.coalesce((pc < po) & (c > o) & (o > pc) & (c < po), no))
    return df.withColumn("piercing", F.coalesce((pc < po) & (c > o) & (o < pl) & (c > (po + pc) / 2.0) & (c < po), no))


def consecutive_lower(c: str, days: int) -> Column:
    """Days - 1 falls in a row; false on the first ``days`` rows."""
    out = F.col("rn") > days
    for k in range(days - 1):
        out = out & ((F.col(c) if k == 0 else lag(c, k)) < lag(c, k + 1))
    return F.coalesce(out, F.lit(False))


def fast_exit(mode: str = "previous_high", rsi_col: str | None = None, exit_rsi: float = 75.0) -> Column:
    """Close over the high before, a first higher close, or an oscillator over its level."""
    if mode == "previous_high":
        v = F.col("close") > lag("high")
    elif mode == "up_close":
        v = F.col("close") > lag("close")
    else:
        v = F.col(rsi_col) > exit_rsi
    return F.coalesce(v, F.lit(False))


def equity(df: DataFrame, r: str, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Equity (product of 1 + r), its running peak, drawdown, and rows under water."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.product(1.0 + F.coalesce(F.col(r), F.lit(0.0))).over(w))
    df = df.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w))).withColumn("drawdown", F.col("equity") / F.col("peak") - 1.0)
    df = df.withColumn("_i", F.sum(F.when(F.col("drawdown") >= 0, 1).otherwise(0)).over(w))
    return df.withColumn("underwater", F.sum(F.when(F.col("drawdown") < 0, 1).otherwise(0)).over(Window.partitionBy(by, "_i").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_i")
