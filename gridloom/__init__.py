"""gridloom: analytics over gridded space-time variables, expressed as PySpark plans."""

__version__ = "0.1.0"
