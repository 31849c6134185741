"""One exception hierarchy for the vector engine."""


class StratavecError(Exception):
    """Base of all errors raised here."""


class VectorFormatError(StratavecError, ValueError):
    """A value is no valid vector."""


class PayloadFormatError(StratavecError, ValueError):
    """A payload's header, revision, length or checksum is wrong."""


class DimensionMismatch(StratavecError, ValueError):
    """A vector's length isn't the index's."""


class GeometryMismatch(StratavecError, ValueError):
    """Dimensions or bit width differ from what is stored."""


class StorageFormatError(StratavecError, ValueError):
    """An index's storage format is unknown."""


class CorruptIndex(StratavecError):
    """Stored files contradict the manifest."""


class InvalidSearch(StratavecError, ValueError):
    """A search without a usable limit or order."""


class DuplicateId(StratavecError, ValueError):
    """An inserted id exists already."""


class UnknownId(StratavecError, KeyError):
    """An id to remove isn't there."""


class TransactionError(StratavecError, RuntimeError):
    """A savepoint or transaction is used out of turn."""
