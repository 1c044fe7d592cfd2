"""folio: PDF collections as Spark tables, and back."""

__version__ = "0.1.0"
