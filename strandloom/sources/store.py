"""Files by path or URI, read by byte ranges: on mounts, and in the object stores and HDFS that Arrow reaches."""

from __future__ import annotations

import fnmatch
import os
import re


def at(path: str):
    """(Arrow file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def files(paths) -> list[tuple[str, int]]:
    """(path, bytes) of files in the order given; a folder or a glob stands for its files by name, hidden ones aside."""
    from pyarrow import fs

    out = []
    for path in paths.split(",") if isinstance(paths, str) else paths:
        store, place = at(path)
        root = path[: len(path) - len(place)] if "://" in path and path.endswith(place) else ""
        if re.search(r"[*?\[]", place):
            base = place[: re.search(r"[*?\[]", place).start()].rpartition("/")[0] or "/"
            found = [f for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File and f.path.count("/") == place.count("/") and fnmatch.fnmatchcase(f.path, place)]
        else:
            info = store.get_file_info(place)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        out += [(root + f.path, f.size) for f in sorted(found, key=lambda f: f.path)]
    return out


def below(root: str, regexp: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at any depth of a folder whose paths match, by name; none if there is no folder."""
    from pyarrow import fs

    store, place = at(root)
    before = root[: len(root) - len(place)] if "://" in root and root.endswith(place) else ""
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=True))
    return sorted((before + f.path, f.size) for f in found if f.type == fs.FileType.File and re.search(regexp, f.path))


def splits(size: int, most: int) -> list[tuple[int, int]]:
    return [(a, min(a + most, size)) for a in range(0, size, most)]


def open_file(path: str):
    """A random-access file; use as a context."""
    store, place = at(path)
    return store.open_input_file(place)


def open_new(path: str):
    store, place = at(path)
    store.create_dir(os.path.dirname(place), recursive=True)
    return store.open_output_stream(place)


def move(old: str, new: str) -> None:
    store, place = at(old)
    store.create_dir(os.path.dirname(at(new)[1]), recursive=True)
    store.move(place, at(new)[1])


def remove(path: str) -> None:
    store, place = at(path)
    store.delete_file(place)


def remove_folder(path: str) -> None:
    from pyarrow import fs

    store, place = at(path)
    if store.get_file_info(place).type == fs.FileType.Directory:
        store.delete_dir(place)
