"""Error classes of the engine."""


class LodeError(Exception):
    """Any error that the engine raises itself."""


class ParseError(LodeError):
    """The text is not a query or expression."""


class BindError(LodeError):
    """Names, types or the use of aggregates don't fit."""


class ExecutionError(LodeError):
    """A query that was bound cannot be answered."""


class IngestError(LodeError):
    """A file cannot become a dataset."""


class CatalogError(LodeError):
    """A dataset is unknown or cannot be changed."""
