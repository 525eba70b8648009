"""Typed failures."""


class PalimpsestError(Exception):
    pass


class FormatError(PalimpsestError):
    """Bytes that are not what their format says."""


class Truncated(FormatError):
    """Fewer bytes than the part needs."""


class BadMagic(FormatError):
    pass


class BadVersion(FormatError):
    pass


class BadPageSize(FormatError):
    """No power of two from 512 to 65536, or not the one that the other files have."""


class BadTxidRange(FormatError):
    pass


class BadPageNumber(FormatError):
    """Zero, the lock page, or beyond the database's size."""


class BadIndex(FormatError):
    pass


class BadVarint(BadIndex):
    pass


class BadCompression(FormatError):
    pass


class ChecksumMismatch(FormatError):
    pass


class PrevFrameMismatch(FormatError):
    pass


class UnalignedOffset(FormatError):
    pass


class PageOutOfOrder(FormatError):
    pass


class NotContiguous(PalimpsestError):
    """Inputs of a merge leave a gap or don't advance."""


class NoSnapshot(PalimpsestError):
    pass


class TxidTooOld(PalimpsestError):
    pass


class Equivocation(PalimpsestError):
    """Other bytes are stored under the same range already."""


class InvalidLevels(PalimpsestError):
    pass


class Locked(PalimpsestError):
    pass


class NotWal(PalimpsestError):
    """A database that can't be brought into WAL mode."""
