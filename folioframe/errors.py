"""Errors that a caller of the query functions can tell apart by code."""


class VaultError(ValueError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def filter_error(message: str) -> VaultError:
    return VaultError("FILTER_SYNTAX_ERROR", message)


def cursor_error(message: str) -> VaultError:
    return VaultError("CURSOR_INVALID", message)


def query_error(message: str) -> VaultError:
    return VaultError("QUERY_SYNTAX_ERROR", message)
