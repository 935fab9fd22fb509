"""Data profiling, quality checks and cleaning on Spark DataFrames."""

__version__ = "0.1.0"

from .models import Config, DatasetProfile, Finding, Severity, Suggestion, ToolkitError
from .operators import get_transformer, register_transformer, run_transformer, transform
from .plans.codegen import generate_code
from .plans.detectors import get_detector, register_detector
from .plans.profile import profile
from .plans.report import Report, analyze
from .plans.suggestions import suggest
from .sources import load, register_adapter, save

__all__ = [
    "Config", "DatasetProfile", "Finding", "Report", "Severity", "Suggestion", "ToolkitError", "analyze", "generate_code", "get_detector", "get_transformer",
    "load", "profile", "register_adapter", "register_detector", "register_transformer", "run_transformer", "save", "suggest", "transform",
]
