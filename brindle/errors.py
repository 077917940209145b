"""Exceptions of the engine."""


class EngineError(Exception):
    """Base of all errors that the engine raises itself."""


class InvalidRequest(EngineError):
    """A filter, projection, sort, update or document breaks the language's rules."""


class CollectionNotFound(EngineError):
    pass


class CollectionAlreadyExists(EngineError):
    pass


class IndexNotFound(EngineError):
    pass


class IndexOptionsConflict(EngineError):
    pass


class DuplicateKey(EngineError):
    """A document's id is in the collection already, or twice among those given."""


class VersionConflict(EngineError):
    """Another writer committed first."""
