"""Byte files at URIs that executors write and read (file, hdfs, s3, gs and others known to pyarrow)."""

from __future__ import annotations

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain path is a local one."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:") :]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def list_files(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files below a folder whose names end with ``suffix``, in order of name."""
    system, path = open_fs(uri)
    scheme = uri.split(path, 1)[0] if path in uri else ""
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((scheme + x.path, x.size) for x in found if x.is_file and x.path.endswith(suffix))


def write_atomic(uri: str, name: str, attempt: str, parts) -> str:
    """Write bytes to ``uri/name`` by way of a name of this attempt; a repeated task replaces the file whole."""
    system, path = open_fs(uri)
    system.create_dir(path, recursive=True)
    draft, final = f"{path}/.{name}.{attempt}", f"{path}/{name}"
    with system.open_output_stream(draft, compression=None) as out:
        for part in parts:
            out.write(part)
    system.move(draft, final)
    return f"{uri.rstrip('/')}/{name}"
