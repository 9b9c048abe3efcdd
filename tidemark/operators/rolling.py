"""Guarded window statistics over a group's rows in order.

Every rolling value is NULL until enough non-null values are in its frame, and
nothing divides by a zero deviation. A frame ends at the current row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import scalar as S


@dataclass(frozen=True)
class Series:
    """Rows of a group in order; all statistics of one Series share one exchange and one sort."""

    by: tuple
    order: tuple

    @classmethod
    def of(cls, by, order) -> "Series":
        as_tuple = lambda x: (x,) if isinstance(x, str) else tuple(x)
        return cls(as_tuple(by), as_tuple(order))

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        return self.window.rowsBetween(1 - n, Window.currentRow)

    @property
    def so_far(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.by)

    # Neighbours

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(S.col(c), n).over(self.window)

    def lead(self, c, n: int = 1) -> Column:
        return F.lead(S.col(c), n).over(self.window)

    def change(self, c, n: int = 1) -> Column:
        return S.col(c) - self.lag(c, n)

    def returns(self, c, n: int = 1) -> Column:
        return S.div(c, self.lag(c, n)) - 1

    def forward_returns(self, c, n: int = 21) -> Column:
        return S.div(self.lead(c, n), c) - 1

    def ffill(self, c) -> Column:
        return F.last(S.col(c), ignorenulls=True).over(self.so_far)

    def pct_change(self, filled) -> Column:
        """Relative change of an already filled column."""
        return self.returns(filled)

    def carried_sign(self, change) -> Column:
        """The sign of the last change that wasn't zero; 0 before any."""
        sign = F.signum(S.col(change))
        return F.when(S.col(change).isNotNull(), F.coalesce(F.last(F.when(sign != 0, sign), ignorenulls=True).over(self.so_far), F.lit(0.0)))

    # Rolling statistics

    def _guard(self, c, n: int, least: int, value: Column) -> Column:
        return F.when(F.count(S.col(c)).over(self.last(n)) >= least, value)

    def mean(self, c, n: int, least: int | None = None) -> Column:
        return self._guard(c, n, n if least is None else least, F.avg(S.col(c)).over(self.last(n)))

    def std(self, c, n: int, least: int | None = None) -> Column:
        return self._guard(c, n, n if least is None else least, F.stddev_samp(S.col(c)).over(self.last(n)))

    def z(self, c, n: int = 252, least: int = 60) -> Column:
        w = self.last(n)
        return self._guard(c, n, least, S.div(S.col(c) - F.avg(S.col(c)).over(w), F.stddev_samp(S.col(c)).over(w)))

    def centred(self, c) -> Column:
        """The distance from the group's mean; shape statistics of it are the same and lose no digits."""
        return S.col(c) - F.avg(S.col(c)).over(self.whole)

    def _moments(self, c, n: int) -> tuple[Column, Column, Column, Column]:
        """Count and the second to fourth central moments of the last ``n`` rows.

        Each is a difference of two running sums, so a row costs the same whatever
        the window; a variance that is nothing beside the group's is NULL.
        """
        x = S.col(c)
        old = self.window.rowsBetween(Window.unboundedPreceding, -n)
        total = lambda v: F.coalesce(F.sum(v).over(self.so_far), F.lit(0.0)) - F.coalesce(F.sum(v).over(old), F.lit(0.0))
        k = (F.count(x).over(self.so_far) - F.count(x).over(old)).cast("double")
        e1, e2, e3, e4 = (S.div(total(v), k) for v in (x, x * x, x * x * x, x * x * x * x))
        m2 = e2 - e1 * e1
        m2 = F.when(m2 > 1e-10 * F.var_pop(x).over(self.whole), m2)
        return k, m2, e3 - 3 * e1 * e2 + 2 * e1 * e1 * e1, e4 - 4 * e1 * e3 + 6 * e1 * e1 * e2 - 3 * e1 * e1 * e1 * e1

    def skew(self, c, n: int = 504, least: int = 120) -> Column:
        """Sample skewness (G1) of a value, best ``centred``."""
        k, m2, m3, _ = self._moments(c, n)
        return F.when(k >= max(least, 3), S.div(F.sqrt(k * (k - 1)), k - 2) * S.div(m3, F.pow(m2, F.lit(1.5))))

    def kurt(self, c, n: int = 504, least: int = 120) -> Column:
        """Sample excess kurtosis (G2) of a value, best ``centred``."""
        k, m2, _, m4 = self._moments(c, n)
        factor = S.div(k - 1, (k - 2) * (k - 3))
        return F.when(k >= max(least, 4), factor * ((k + 1) * (S.div(m4, m2 * m2) - 3) + 6))

    def corr(self, a, b, n: int = 504, least: int = 120) -> Column:
        """Correlation over rows that have both; NULL where one doesn't vary."""
        w = self.last(n)
        both = S.col(a).isNotNull() & S.col(b).isNotNull()
        x, y = F.when(both, S.col(a)), F.when(both, S.col(b))
        value = S.div(F.covar_samp(x, y).over(w), F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w))
        return F.when(F.count(x).over(w) >= least, value)

    # Expanding and whole-group values

    def running_sum(self, c) -> Column:
        return F.sum(S.col(c)).over(self.so_far)

    def running_max(self, c) -> Column:
        return F.max(S.col(c)).over(self.so_far)

    def running_product(self, c) -> Column:
        """Product of 1 + c so far, in order (NULL as 0); one multiplication a row."""
        return F.product(1 + F.coalesce(S.col(c), F.lit(0.0))).over(self.so_far)

    def drawdown(self, curve) -> Column:
        return S.div(curve, self.running_max(curve)) - 1

    def expanding_median(self, c) -> Column:
        """Median of the values so far; a group's values are gathered per row, so for short series."""
        values = F.array_sort(F.collect_list(S.col(c)).over(self.so_far))
        n = F.size(values)
        low, high = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
        return F.when(n > 0, (F.get(values, low - 1) + F.get(values, high - 1)) / 2)

    def rank_pct(self, c) -> Column:
        """Share of the group's values at or below, ties at their mean rank; looks at the whole history."""
        value = S.col(c)
        rank = F.rank().over(Window.partitionBy(*self.by).orderBy(value.asc_nulls_last()))
        same = F.count(value).over(Window.partitionBy(*self.by, value))
        return F.when(value.isNotNull(), S.div(rank + (same - 1) / 2, F.count(value).over(self.whole)))

    def rank_pct_so_far(self, c) -> Column:
        """The same among the values so far only: safe to use at the row's time."""
        value = S.col(c)
        seen = F.collect_list(value).over(self.so_far)
        below = F.size(F.filter(seen, lambda x: x < value))
        same = F.size(F.filter(seen, lambda x: x == value))
        return F.when(value.isNotNull(), S.div(below + (same + 1) / 2, F.size(seen)))

    # Calendar

    def first_of_period(self, on: str, frequency: str) -> Column:
        """True on the first row of each day, ISO week or month after the first row; ``none`` is never true."""
        d = F.col(on)
        if frequency == "none":
            return F.lit(False)
        key = {"daily": F.struct(d), "weekly": F.struct(F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d)), "monthly": F.struct(F.year(d), F.month(d))}[frequency]
        before = F.lag(key).over(self.window)
        return before.isNotNull() & ~key.eqNullSafe(before)

    def rows_before(self) -> Column:
        return F.row_number().over(self.window) - 1
