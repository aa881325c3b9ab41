"""Refusals: a clause the engine does not take is named, never ignored."""


class Refused(ValueError):
    """A declaration or query that is refused; the message names the clause."""
