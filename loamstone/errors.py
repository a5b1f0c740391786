"""Exceptions of the public API."""


class LoamstoneError(Exception):
    """Base of all errors raised on purpose."""


class UnknownCollection(LoamstoneError):
    pass


class UnknownDocument(LoamstoneError):
    pass


class InvalidQuery(LoamstoneError):
    pass


class InvalidInput(LoamstoneError):
    pass


class Conflict(LoamstoneError):
    pass


class SchemaError(LoamstoneError):
    pass


class ConfigError(LoamstoneError):
    pass
