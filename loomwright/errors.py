"""What can go wrong while a dataset is described or assembled."""


class AssemblyError(ValueError):
    """Base of all errors of this library."""


class SpecError(AssemblyError):
    """A specification that cannot be read or contradicts itself."""


class JoinError(AssemblyError):
    """Keys that break a join's contract."""


class DataError(AssemblyError):
    """Cells that cannot be taken as declared."""
