"""Errors. Messages never repeat record text or rejected values."""


class ConflictError(RuntimeError):
    """The expected revision is not the stored one."""


class CheckpointConflictError(ConflictError):
    """The source cursor has moved."""


class OperationConflictError(ConflictError):
    """An operation id is bound to other input."""


class SnapshotError(ValueError):
    """The host's snapshot is ambiguous or malformed."""


def whole(value, name: str, least: int = 0, most: int | None = None) -> int:
    """The value, if it is a whole number from `least` to `most`."""
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{name}: not a whole number")
    if value < least or most is not None and value > most:
        raise ValueError(f"{name}: out of range")
    return value


def finite(value, name: str) -> float:
    """The value, if it is a number other than infinity and not-a-number."""
    number = not isinstance(value, bool) and isinstance(value, (int, float))
    if not number or value - value != 0:
        raise ValueError(f"{name}: not a finite number")
    return value


def identifier(value, name: str) -> str:
    """The value, if it is 1 to 100 letters, digits and signs of "_.:-"."""
    import re

    if not isinstance(value, str) or not re.fullmatch("[A-Za-z0-9_.:-]{1,100}", value):
        raise ValueError(f"{name}: not an identifier")
    return value
