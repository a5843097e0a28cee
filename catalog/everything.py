"""Importing this module registers every query."""

from catalog import evaluation, features, ingestion, modelling, monitoring, profiling, selection, streaming, windows  # noqa: F401
