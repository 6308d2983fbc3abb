"""Topology-aware retrieval on Spark. The public names are loaded when they are first asked for, so that Python workers,
which import this package for single functions, stay small."""

from __future__ import annotations

from importlib import import_module

_HOME = {
    "Engine": "engine", "Crawler": "sources.crawl", "infer_levels": "sources.crawl", "Registry": "sources.extract",
    "Artifacts": "sources.artifacts", "build": "sources.artifacts", "write_json": "sources.artifacts", "write_tables": "sources.artifacts", "load_tables": "sources.artifacts", "load_documents": "sources.artifacts", "load_manifest": "sources.artifacts",
    "Template": "plans.template", "Attempt": "plans.template", "default_attempts": "plans.template", "resolve_plan": "plans.template", "Thresholds": "functions.confidence",
    "Catalog": "operators.resolve", "resolve": "operators.resolve", "search": "operators.search", "run": "operators.retrieve", "choose": "operators.retrieve", "clarify": "operators.clarify", "attach": "operators.clarify", "Cache": "operators.cache",
    "TopographError": "errors", "MissingDependency": "errors", "UnsupportedFileType": "errors", "CorpusValidationError": "errors", "StoreError": "errors", "StoreConfigurationError": "errors",
}
__version__ = "0.1.0"
__all__ = ["__version__", *_HOME]


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
