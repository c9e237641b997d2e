"""Sources of conversation exports."""

from .discovery import Inspection, discover
from .export import ExportSource, read_exports

__all__ = ["ExportSource", "Inspection", "discover", "read_exports"]
