"""Profiling, data quality and relationship discovery for PySpark DataFrames.

Importing the package adds ``df.profile`` to DataFrames. The corpus operators are in ``colscope.llm`` and are imported on their own.
"""

from .api import DataProfiler, ProfileAccessor, ProfileReport, install, profile_of
from .operators.compare import DataComparator
from .operators.relate import RelationshipAnalyzer, RelationshipConfig, RelationshipGraph, RelationshipResult
from .operators.semantic import detect_semantic_type, semantic_type_counts, semantic_types

__version__ = "0.1.0"
__all__ = [
    "DataComparator", "DataProfiler", "ProfileAccessor", "ProfileReport", "RelationshipAnalyzer", "RelationshipConfig", "RelationshipGraph", "RelationshipResult",
    "detect_semantic_type", "profile_of", "semantic_type_counts", "semantic_types",
]

install()
