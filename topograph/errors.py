"""What can go wrong for reasons a caller can act on."""


class TopographError(Exception):
    """Base of this package's errors."""


class MissingDependency(TopographError):
    """A file type needs a library that isn't installed."""


class UnsupportedFileType(TopographError):
    """A strict crawl met an extension without an extractor."""


class CorpusValidationError(TopographError):
    """A stored artifact can't be read as what it should be."""


class StoreError(TopographError):
    """A chunk store failed."""


class StoreConfigurationError(StoreError):
    """A chunk store is missing or has no such method or column."""
