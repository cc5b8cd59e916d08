"""Failures that callers may expect; the command line turns them into exit codes."""

from __future__ import annotations


class FinweaveError(RuntimeError):
    """Base of all of them."""


class ContractError(FinweaveError, ValueError):
    """An input that breaks its contract."""


class PublishError(FinweaveError):
    """A result that cannot be put in its place safely."""


class GateError(FinweaveError):
    """Inputs of the pilot gate that are missing, changed, or of another release."""


class DownloadError(FinweaveError):
    """A snapshot that cannot be planned or fetched."""


class NoSpace(DownloadError):
    """Less free space than a download and its reserve need."""

    def __init__(self, needed: int, free: int) -> None:
        super().__init__(f"{needed} bytes needed, {free} free")
        self.needed, self.free = needed, free
