"""Errors that name what is wrong; nothing is imputed or skipped in their place."""


class TidemarkError(Exception):
    """Base of all errors of this library."""


class MissingInput(TidemarkError):
    """A declared file is not there."""


class ContractViolation(TidemarkError):
    """Data break a rule of their contract."""


class MissingCitation(TidemarkError):
    """A window lacks its source or rationale."""


class RaggedPanel(TidemarkError):
    """A forecaster does not fill every cell of the panel."""


class ConfigError(TidemarkError):
    """A setting is unknown or unsupported."""


class CoverageError(TidemarkError):
    """A calendar does not cover the months asked for, or is missing where it is needed."""
