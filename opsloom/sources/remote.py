"""Files of any file system that tasks open themselves. Names are taken as they are: nothing in them is a pattern."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it. A path without scheme is of this machine."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    host = rest.split("/", 1)[0]
    system, inside = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system, f"{inside.rstrip('/')}/{rest.split('/', 1)[1]}" if "/" in rest else inside


def named(path: str, inside: str) -> str:
    """The full name of a file that lies in the file system of ``path``; :func:`opened` takes it."""
    if path.startswith("file:") or "://" not in path:
        return f"file://{inside}"
    scheme, rest = path.split("://", 1)
    host = rest.split("/", 1)[0]
    return f"{scheme}://{inside}" if inside.split("/", 1)[0] == host else f"{scheme}://{host}/{inside.lstrip('/')}"


def listed(path: str, recursive: bool = True) -> list[fs.FileInfo]:
    """Files below a folder, hidden and empty ones too, ordered by name. A folder that is not there has none."""
    return [f for f in entries(path, recursive) if f.type == fs.FileType.File]


def entries(path: str, recursive: bool = False) -> list[fs.FileInfo]:
    """Files and folders in a folder, ordered by name."""
    system, inside = opened(path)
    selector = fs.FileSelector(inside.rstrip("/") or "/", recursive=recursive, allow_not_found=True)
    return sorted(system.get_file_info(selector), key=lambda f: f.path)
