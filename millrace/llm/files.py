"""Byte files at URIs; see millrace.sources.files."""

from millrace.sources.files import list_files, open_fs, write_atomic

__all__ = ["list_files", "open_fs", "write_atomic"]
