"""Errors raised before, or instead of, running a Spark job."""


class SpecError(ValueError):
    """A table, column, key or option that the spec does not allow."""


class ReadOnlyTarget(PermissionError):
    """A write was asked for on a source marked read-only."""


class ClosureNotSettled(RuntimeError):
    """Following foreign keys still found new parents at the round limit."""


class MergeConflict(RuntimeError):
    """Rows that the chosen load mode cannot take."""


class DriftBlocked(RuntimeError):
    """Schema drift that the policy does not let through."""


#: Findings named in an error; how many more there are is said as well.
SHOWN = 20


def more(found, shown) -> str:
    """`` and N more``, where a message shows only the first of what was ``found``."""
    if len(shown) < SHOWN:
        return ""
    left = found.count() - len(shown)
    return f" and {left} more" if left else ""
