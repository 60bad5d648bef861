"""Comparison of two snapshots of a table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from ..functions.families import choice, col, require_frame
from ..plans.kernel import ColumnStats, column_stats, duplicate_rows, rounded, table

LEVELS = ("all", "dataset", "schema", "quality", "ml")
SCHEMA = "section string, metric string, before string, after string, before_value double, after_value double, change double, status string"
SUMMARY = "column string, status string, summary string"
CUTS = ((0.25, 0), (0.5, 1), (0.75, 2), (0.95, 3))

Row = tuple[str, str, str | None, str | None, float | None, float | None, float | None, str]


def _text(v: float | None) -> str | None:
    return None if v is None else str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else repr(float(v))


def _row(section: str, metric: str, b: float | None, a: float | None, status: str, digits: int | None = None) -> Row:
    if digits is not None:
        b, a = rounded(b, digits), rounded(a, digits)
    change = None if b is None or a is None else float(a) - float(b)
    if change is not None and digits is not None:
        change = rounded(change, digits)
    return (section, metric, _text(b), _text(a), None if b is None else float(b), None if a is None else float(a), change, status)


class DataComparator:
    """Row order follows the columns of the first table, so results are the same on every run."""

    @staticmethod
    def _checked(before: DataFrame, after: DataFrame, columns: list[str] | None) -> tuple[DataFrame, DataFrame]:
        require_frame(before, "before")
        require_frame(after, "after")
        if columns is None:
            return before, after
        unknown = [c for c in columns if c not in before.columns and c not in after.columns]
        if unknown:
            raise ValueError(f"unknown columns: {', '.join(unknown)}")
        return tuple(df.select(*(col(c) for c in columns if c in df.columns)) for df in (before, after))

    def compare_dataframe(self, before: DataFrame, after: DataFrame, level: str = "all", changes_only: bool = False, columns: list[str] | None = None) -> DataFrame:
        b, a = self._checked(before, after, columns)
        level = choice(level, LEVELS, "level")
        rows: list[Row] = []
        full = columns is None or {*columns} >= {*before.columns, *after.columns}
        need_columns, need_table = level in ("all", "quality", "ml"), level in ("all", "dataset", "quality")
        sb = sa = None
        if need_columns or need_table:
            sb, sa = (column_stats(df) if df.columns else [] for df in (b, a))
        if need_table:
            fb, fa = (sb, sa) if full else (column_stats(df, spread=False, counts=False) for df in (before, after))
            rows += self._dataset(before, after, fb, fa)
        if level in ("all", "schema"):
            rows += self._schema(b, a)
        if need_columns:
            rows += self._columns({s.name: s for s in sb}, {s.name: s for s in sa})
        if changes_only:
            rows = [r for r in rows if r[0] == "Schema" or r[6]]
        return table(before, rows, SCHEMA)

    @staticmethod
    def _dataset(before: DataFrame, after: DataFrame, sb: list[ColumnStats], sa: list[ColumnStats]) -> list[Row]:
        pairs = []
        for df, s in ((before, sb), (after, sa)):
            n, twice = duplicate_rows(df)
            pairs.append((n, len(df.columns), sum(x.missing for x in s), twice, rounded(sum(x.bytes for x in s) / 1024**2, 4)))
        names = ("Rows", "Columns", "Missing Cells", "Duplicate Rows", "Memory MB")
        return [_row("Dataset", m, b, a, "Improved" if a < b else "Increased" if a > b else "Same", 4) for m, b, a in zip(names, *pairs, strict=True)]

    @staticmethod
    def _schema(before: DataFrame, after: DataFrame) -> list[Row]:
        b, a = dict(before.dtypes), dict(after.dtypes)
        rows: list[Row] = [("Schema", c, "Missing", "Added", None, None, None, "New Column") for c in a if c not in b]
        rows += [("Schema", c, "Present", "Removed", None, None, None, "Deleted Column") for c in b if c not in a]
        return rows + [("Schema", c, b[c], a[c], None, None, None, "Dtype Changed") for c in b if c in a and a[c] != b[c]]

    @staticmethod
    def _columns(before: dict[str, ColumnStats], after: dict[str, ColumnStats]) -> list[Row]:
        rows: list[Row] = []
        for name, b in before.items():
            if (a := after.get(name)) is None:
                continue
            less = lambda y, x, label: label if y < x else "Same"
            rows.append(_row("Missing", name, b.missing, a.missing, less(a.missing, b.missing, "Fixed")))
            if b.numeric and a.numeric:
                rows.append(_row("Zero", name, b.zero, a.zero, less(a.zero, b.zero, "Improved")))
                for stat in ("mean", "median", "std", "min", "max"):
                    get = lambda s: (s.q[1] if s.q else None) if stat == "median" else s.values[stat]  # noqa: B023, E731
                    x, y = rounded(get(b), 4), rounded(get(a), 4)
                    rows.append(_row("Statistics", f"{name}_{stat}", x, y, "Changed" if x != y else "Same", 4))
                for q, i in CUTS:
                    x, y = (s.q[i] if s.q else None for s in (b, a))
                    rows.append(_row("Quantile", f"{name}_Q{int(q * 100)}", x, y, "Changed" if x != y else "Same"))
                rows.append(_row("Outlier", name, b.outliers, a.outliers, less(a.outliers, b.outliers, "Reduced")))
            elif not b.numeric:
                rows.append(_row("Category", name, b.nunique, a.nunique, "Changed" if a.nunique != b.nunique else "Same"))
        return rows

    def summary(self, before: DataFrame, after: DataFrame, columns: list[str] | None = None) -> DataFrame:
        b, a = self._checked(before, after, columns)
        sb, sa = ({s.name: s for s in (column_stats(df) if df.columns else [])} for df in (b, a))
        rows = [(c, "Removed", "Column removed") for c in sorted(set(sb) - set(sa))] + [(c, "Added", "Column added") for c in sorted(set(sa) - set(sb))]
        for c in sorted(set(sb) & set(sa)):
            x, y, notes = sb[c], sa[c], []
            if x.dtype != y.dtype:
                notes.append(f"dtype {x.dtype}->{y.dtype}")
            if x.missing != y.missing:
                notes.append(f"missing {x.missing}->{y.missing}")
            if x.numeric and y.numeric:
                if x.outliers != y.outliers:
                    notes.append(f"outliers {x.outliers}->{y.outliers}")
                if rounded(x.mean, 4) != rounded(y.mean, 4):
                    notes.append(f"mean {rounded(x.mean, 2)}->{rounded(y.mean, 2)}")
            elif x.nunique != y.nunique:
                notes.append(f"unique {x.nunique}->{y.nunique}")
            rows.append((c, "Changed" if notes else "Unchanged", "; ".join(notes) or "No change"))
        return table(before, rows, SUMMARY)

    def to_html(self, before: DataFrame, after: DataFrame, path: str | None = None, level: str = "all", changes_only: bool = False, columns: list[str] | None = None, title: str = "Comparison Report") -> str:
        from ..sources.report import render_report

        page = render_report({"Summary": self.summary(before, after, columns), "Comparison": self.compare_dataframe(before, after, level, changes_only, columns)}, title)
        if path:
            Path(path).write_text(page, encoding="utf-8")
        return page
