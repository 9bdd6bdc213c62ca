"""Errors of sources and universes."""


class DataProviderError(Exception):
    """A source can't deliver."""


class AuthenticationError(DataProviderError):
    """Credentials are missing or refused."""


class SymbolNotFoundError(DataProviderError):
    """A source doesn't know a symbol."""


class RateLimitError(DataProviderError):
    """A source asks for fewer requests."""


class UniverseError(Exception):
    """A universe can't be built."""


class UniverseDataUnavailableError(UniverseError):
    """A universe's source failed or was empty, and no fallback is allowed."""
