"""Queries registered for checking, grouped like the operators."""

from . import analysis, dataset, extras, lexical, quality, ranking, sources, vectors

MODULES = (sources, dataset, quality, analysis, lexical, vectors, ranking, extras)
