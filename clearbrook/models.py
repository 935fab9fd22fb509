"""Records that travel between the stages, configuration, and errors."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields, is_dataclass, replace
from enum import Enum
from typing import Any


class ToolkitError(Exception):
    """Base of this package's errors."""


class SourceError(ToolkitError):
    """A file can't be read or written."""


class DetectionError(ToolkitError):
    """A detector failed."""


class TransformError(ToolkitError):
    """A transformation failed."""


class ConfigError(ToolkitError):
    """A setting has a value that isn't allowed."""


class Severity(str, Enum):
    HIGH = "high"
    MEDIUM = "medium"
    LOW = "low"


# Names and defaults of the records and settings below, which callers use.


@dataclass
class ColumnProfile:
    name: str
    dtype: str
    kind: str  # numeric, boolean, string, temporal or nested
    semantic_type: str | None = None
    null_count: int = 0
    null_ratio: float = 0.0
    unique_count: int = 0
    unique_ratio: float = 0.0
    sample_values: list[Any] = field(default_factory=list)
    statistics: dict[str, Any] = field(default_factory=dict)
    patterns: dict[str, dict[str, Any]] = field(default_factory=dict)


@dataclass
class DatasetProfile:
    row_count: int
    column_count: int
    memory_bytes: int  # estimated: fixed widths and string bytes
    columns: dict[str, ColumnProfile] = field(default_factory=dict)
    duplicate_row_count: int = 0
    sampled: bool = False
    sample_size: int | None = None


@dataclass
class Finding:
    detector: str
    issue_type: str
    severity: Severity
    columns: list[str]
    details: dict[str, Any] = field(default_factory=dict)
    message: str = ""
    confidence: float = 1.0
    rows: list[int] | None = None


@dataclass
class Suggestion:
    id: int
    finding: Finding
    action: str
    transformer: str
    params: dict[str, Any]
    priority: Severity
    impact: str = ""
    rationale: str = ""
    preview: Any = None


@dataclass
class TransformationResult:
    transformer: str
    params: dict[str, Any]
    rows_affected: int
    columns_affected: list[str]
    code: str = ""


# --- configuration ------------------------------------------------------------------------------------------------


@dataclass
class DetectorConfig:
    enabled: list[str] = field(default_factory=lambda: ["missing", "duplicates", "types", "formats", "outliers", "similarity"])
    similarity_name_threshold: float = 0.8
    similarity_value_threshold: float = 0.7
    outlier_method: str = "iqr"
    outlier_threshold: float = 1.5
    fuzzy_duplicates_enabled: bool = False
    fuzzy_duplicates_threshold: float = 0.85
    locate_rows: bool = False


@dataclass
class MLConfig:
    embedding_model: str = "all-MiniLM-L6-v2"
    device: str = "cpu"


@dataclass
class SuggestionConfig:
    max_suggestions: int = 50
    min_confidence: float = 0.7


@dataclass
class CodegenConfig:
    style: str = "function"
    include_comments: bool = True


@dataclass
class Config:
    sample_size: int = 10_000
    max_unique_ratio: float = 0.95
    null_threshold: float = 0.5
    detectors: DetectorConfig = field(default_factory=DetectorConfig)
    ml: MLConfig = field(default_factory=MLConfig)
    suggestions: SuggestionConfig = field(default_factory=SuggestionConfig)
    codegen: CodegenConfig = field(default_factory=CodegenConfig)
    use_case: str = "general"

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Config:
        made = _filled(cls(), data, "")
        allowed = (("use_case", made.use_case, ("general", "ml", "analytics", "export")), ("detectors.outlier_method", made.detectors.outlier_method, ("iqr", "zscore")), ("codegen.style", made.codegen.style, ("function", "script")))
        for name, value, among in allowed:
            if value not in among:
                raise ConfigError(f"{name} must be one of {', '.join(among)}; got {value!r}")
        made.detectors.enabled = ["formats" if x == "format" else x for x in made.detectors.enabled]
        return made


#: Names that documents use for a setting, and the setting.
ALIASES = {"detectors.min_similarity": "similarity_value_threshold"}


def _filled(base: Any, data: dict[str, Any], path: str) -> Any:
    known = {f.name for f in fields(base)}
    changes = {}
    for key, value in data.items():
        name = ALIASES.get(f"{path}{key}", key)
        if name not in known:
            warnings.warn(f"unknown setting {path}{key}", stacklevel=3)
            continue
        old = getattr(base, name)
        changes[name] = _filled(old, value, f"{path}{name}.") if is_dataclass(old) and isinstance(value, dict) else value
    return replace(base, **changes)
