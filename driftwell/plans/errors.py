"""Named errors."""


class ViewError(Exception):
    """Anything the view engine refuses or finds wrong."""


class UnsupportedView(ViewError):
    """A definition outside the maintained subset."""


class UnknownTable(ViewError):
    """A table that isn't declared."""


class BrokenView(ViewError):
    """A view whose stored plan, tables or state no longer fit; it can only be dropped."""


class IllegalChange(ViewError):
    """A change that removes a row that isn't there, or doesn't fit the table."""


class SumOverflow(ViewError):
    """An integer sum outside the signed 64-bit range."""


class StateError(ViewError):
    """Maintained state that contradicts itself."""
