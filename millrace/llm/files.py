"""Binary files in a shared folder, written by tasks and named by a manifest.

A task writes under a name of its own attempt and reports it in a row; only rows that Spark
commits name files that are read. A lost executor's half-written file is never named.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder by URI or plain path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def new_file(uri: str, stem: str, suffix: str):
    """An output stream and the name of a new file; the folder is made if need be."""
    system, path = open_folder(uri)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    return system.open_output_stream(f"{path}/{name}", compression=None), name


def open_input(uri: str, name: str):
    system, path = open_folder(uri)
    return system.open_input_file(f"{path}/{name}")
