"""Screening of text that flows into and out of language models, as Spark plans."""

__version__ = "0.1.0"
