"""Corpus-scale analytics over documents and agent sessions, declared as Spark plans."""

__version__ = "0.1.0"
