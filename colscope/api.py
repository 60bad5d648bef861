"""Public classes: DataProfiler, ProfileReport, and the accessor ``df.profile``."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions.families import choice, project, require_frame
from .operators import alerts as _alerts
from .operators import corr, pii, score, sections
from .operators.compare import DataComparator
from .operators.relate import RelationshipAnalyzer, RelationshipConfig, RelationshipResult
from .plans.kernel import ColumnStats, column_stats, duplicate_rows
from .sources import csv
from .sources.report import render_report, terminal_dashboard

SECTION_NAMES = {"schema": "Schema", "statistics": "Statistics", "quality": "Quality", "ml": "ML", "etl": "ETL"}


class DataProfiler:
    """Reports on one table. ``approx`` trades exact percentiles and distinct counts for sketches."""

    def __init__(self, df: DataFrame, approx: bool = False):
        require_frame(df)
        self.df, self.approx = df, approx
        self.total_rows_in_source: int | None = None
        self.is_sampled = False
        self._stats: dict[tuple, list[ColumnStats]] = {}

    @classmethod
    def from_csv(cls, path: str, sample_size: int | None = 100_000, chunksize: int | None = None, random_state: int | None = None, spark: SparkSession | None = None, **options) -> DataProfiler:
        """chunksize has no meaning here (Spark reads by partitions) and is accepted for compatibility."""
        spark = spark or SparkSession.active()
        df, total, sampled = csv.read_csv(spark, path, sample_size, random_state, **options)
        out = cls(df)
        out.total_rows_in_source, out.is_sampled = total, sampled
        return out

    def stats(self, column_type: str = "all", with_pii: bool = False) -> list[ColumnStats]:
        """The kernel's result, computed once per projection and shared by all sections."""
        key = (choice(column_type, ("all", "numeric", "categorical"), "column_type"), with_pii)
        if (key[0], True) in self._stats:
            return self._stats[key[0], True]
        if key not in self._stats:
            self._stats[key] = column_stats(project(self.df, column_type), pii=with_pii, approx=self.approx)
        return self._stats[key]

    def info_dataframe(self, section: str = "All", column_type: str = "All") -> ProfileReport | DataFrame:
        name = choice(section, ("all", *SECTION_NAMES), "section")
        project(self.df, column_type)
        if name == "all":
            return ProfileReport(self, column_type)
        return sections.SECTIONS[name](self.df, self.stats(column_type))

    def quality_score(self, column_type: str = "All", by: str = "overall", weights: dict[str, float] | None = None) -> DataFrame:
        by, w = choice(by, ("overall", "column"), "by"), score.weights_of(weights)
        stats = self.stats(column_type)
        if by == "column":
            return score.by_column(self.df, stats, w)
        n, twice = duplicate_rows(project(self.df, column_type))
        return score.overall(self.df, stats, w, n, twice)

    def pii(self, min_confidence: float = 60, sample: int | None = None, mask: bool = False, mask_char: str = "*") -> DataFrame:
        """The report, or the table with all detected columns masked. sample=None looks at all rows."""
        if mask:
            return pii.masked(self.df, min_confidence, sample, mask_char)
        return pii.report(self.df, min_confidence, sample)

    def correlations(self, method: str = "pearson", by: str = "matrix", threshold: float | None = None) -> DataFrame:
        return corr.correlations(self.df, method, by, threshold)

    def alerts(self, column_type: str = "All", min_severity: str = "low") -> DataFrame:
        choice(min_severity, _alerts.SEVERITIES, "min_severity")
        return _alerts.alerts(project(self.df, column_type), min_severity, self.stats(column_type, with_pii=True))

    def relationships(self, config: RelationshipConfig | None = None) -> RelationshipResult:
        return RelationshipAnalyzer(self.df, config).analyze()

    def to_html(self, path: str | None = None, section: str = "All", column_type: str = "All", title: str = "Data Profile Report") -> str:
        got = self.info_dataframe(section, column_type)
        parts = got if isinstance(got, ProfileReport) else {SECTION_NAMES[section.lower()]: got}
        note = f"Sampled: about {self.total_rows_in_source:,} source rows" if self.is_sampled else ""
        out = render_report({k: parts[k] for k in parts}, title, note)
        if path:
            Path(path).write_text(out, encoding="utf-8")
        return out


class ProfileReport(dict):
    """Section name to report; a section is made when it is first asked for, all from one run of the kernel."""

    title = "Data Profile"

    def __init__(self, profiler: DataProfiler, column_type: str = "All"):
        super().__init__(dict.fromkeys(SECTION_NAMES.values()))
        self.profiler, self.column_type = profiler, column_type

    @property
    def stats(self) -> list[ColumnStats]:
        return self.profiler.stats(self.column_type)

    def __getitem__(self, name: str) -> DataFrame:
        if super().__getitem__(name) is None:
            super().__setitem__(name, sections.SECTIONS[name.lower()](self.profiler.df, self.stats))
        return super().__getitem__(name)

    def __iter__(self) -> Iterator[str]:
        return iter(SECTION_NAMES.values())

    def items(self):  # noqa: ANN201
        return [(k, self[k]) for k in self]

    def values(self):  # noqa: ANN201
        return [self[k] for k in self]

    def get(self, name: str, default: DataFrame | None = None) -> DataFrame | None:
        return self[name] if name in self else default

    def score(self) -> DataFrame:
        return self.profiler.quality_score(self.column_type)

    def alerts(self) -> DataFrame:
        return self.profiler.alerts(self.column_type)

    def relationships(self, config: RelationshipConfig | None = None) -> RelationshipResult:
        return self.profiler.relationships(config)

    def __repr__(self) -> str:
        return terminal_dashboard(self)

    def _repr_html_(self) -> str:
        return render_report(dict(self.items()), self.title)


class ProfileAccessor:
    """``df.profile``: the profiler's reports, the comparison with another table, and pages."""

    def __init__(self, df: DataFrame):
        self._df = df
        self._p = DataProfiler(df)

    def info(self, section: str = "All", column_type: str = "All") -> ProfileReport | DataFrame:
        return self._p.info_dataframe(section, column_type)

    def schema(self, column_type: str = "All") -> DataFrame:
        return self.info("Schema", column_type)

    def statistics(self, column_type: str = "All") -> DataFrame:
        return self.info("Statistics", column_type)

    def quality(self, column_type: str = "All") -> DataFrame:
        return self.info("Quality", column_type)

    def ml(self, column_type: str = "All") -> DataFrame:
        return self.info("ML", column_type)

    def etl(self, column_type: str = "All") -> DataFrame:
        return self.info("ETL", column_type)

    def quality_score(self, column_type: str = "All", by: str = "overall", weights: dict[str, float] | None = None) -> DataFrame:
        return self._p.quality_score(column_type, by, weights)

    def pii(self, min_confidence: float = 60, sample: int | None = None, mask: bool = False, mask_char: str = "*") -> DataFrame:
        return self._p.pii(min_confidence, sample, mask, mask_char)

    def correlations(self, method: str = "pearson", by: str = "matrix", threshold: float | None = None) -> DataFrame:
        return self._p.correlations(method, by, threshold)

    def alerts(self, column_type: str = "All", min_severity: str = "low") -> DataFrame:
        return self._p.alerts(column_type, min_severity)

    def relationships(self, config: RelationshipConfig | None = None) -> RelationshipResult:
        return self._p.relationships(config)

    def html(self, path: str | None = None, section: str = "All", column_type: str = "All", title: str = "Data Profile Report") -> str:
        return self._p.to_html(path, section, column_type, title)

    def compare(self, other: DataFrame, level: str = "all", changes_only: bool = False, columns: list[str] | None = None) -> DataFrame:
        return DataComparator().compare_dataframe(self._df, other, level, changes_only, columns)

    def compare_summary(self, other: DataFrame, columns: list[str] | None = None) -> DataFrame:
        return DataComparator().summary(self._df, other, columns)

    def compare_html(self, other: DataFrame, path: str | None = None, level: str = "all", changes_only: bool = False, columns: list[str] | None = None, title: str = "Comparison Report") -> str:
        return DataComparator().to_html(self._df, other, path, level, changes_only, columns, title)


def profile_of(df: DataFrame) -> ProfileAccessor:
    require_frame(df)
    return ProfileAccessor(df)


def install() -> None:
    """Adds the property ``profile`` to DataFrames, unless something of that name is there."""
    if not hasattr(DataFrame, "profile"):
        DataFrame.profile = property(ProfileAccessor)  # type: ignore[attr-defined]
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    if not hasattr(Classic, "profile"):
        Classic.profile = property(ProfileAccessor)  # type: ignore[attr-defined]
