"""Files by path or URI, their stamps, and publication that never leaves half a file."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from ..errors import DestinationExists, DestinationIsSource, InvalidOption, SourceChanged


def filesystem(path: str):
    """The store of a path and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def local(path: str) -> str:
    return path.removeprefix("file://")


def is_local(path: str) -> bool:
    """Whether a path is of a mounted file system, whose files take writes at any place."""
    return "://" not in path or path.startswith("file://")


def stamp(path: str) -> tuple:
    """What changes when a file does: size, times, permission, device and number; for other stores size and time."""
    if "://" in path and not path.startswith("file://"):
        store, name = filesystem(path)
        info = store.get_file_info(name)
        return (info.size, info.mtime_ns)
    s = os.stat(local(path))
    return (s.st_size, s.st_mtime_ns, not s.st_mode & 0o222, s.st_dev, s.st_ino, s.st_ctime_ns)


def check_stamp(path: str, known: tuple) -> None:
    try:
        now = stamp(path)
    except OSError:
        raise SourceChanged() from None
    if now != known:
        raise SourceChanged()


def check_destination(source: str | None, destination: str) -> None:
    """A new file: neither the source, under whatever name, nor anything that exists."""
    if not is_local(destination):
        if source is not None and source.rstrip("/") == destination.rstrip("/"):
            raise DestinationIsSource()
        return  # whether it exists is for its own file system to say, see ``publication``
    where = os.path.abspath(local(destination))
    if source is not None and (where == os.path.abspath(local(source)) or os.path.realpath(where) == os.path.realpath(local(source))):
        raise DestinationIsSource()
    if os.path.lexists(where):
        raise DestinationExists()


def check_overwritten(path: str) -> None:
    """Whether a file may be written over: a link may not."""
    if not is_local(path):
        raise InvalidOption("only a file of a mounted file system is written over in one step")
    if os.path.islink(local(path)):
        raise InvalidOption("the file is a link")


def permissions(path: str) -> int:
    return os.stat(local(path)).st_mode & 0o7777


@contextmanager
def hidden_sibling(destination: str, mode: int | None = None):
    """An empty file beside ``destination``, under a name that no one looks for. Whatever happens, it goes."""
    where = os.path.abspath(local(destination))
    hidden = os.path.join(os.path.dirname(where), f".{os.path.basename(where)}-export-{os.getpid()}-{uuid.uuid4().hex[:8]}.tmp")
    try:
        os.close(os.open(hidden, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600 if mode is not None else 0o666))
        if mode is not None:
            os.chmod(hidden, mode)
        yield hidden
    finally:
        if os.path.lexists(hidden):
            os.unlink(hidden)


def give_name(hidden: str, destination: str, replace: bool = False) -> None:
    """Force a written file to disk and give it its name. Without ``replace`` an existing name is never taken over, not even one that appears meanwhile."""
    where = os.path.abspath(local(destination))
    for path, flags in ((hidden, os.O_RDONLY), (os.path.dirname(where), os.O_RDONLY | os.O_DIRECTORY)):
        if path != hidden:
            if replace:
                os.replace(hidden, where)
            else:
                try:
                    os.link(hidden, where)
                except FileExistsError:
                    raise DestinationExists() from None
        fd = os.open(path, flags)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)


def publish(destination: str, fill: Callable, before: Callable[[], None] = lambda: None, replace: bool = False, mode: int | None = None) -> int:
    """``fill(file)`` a hidden sibling, call ``before``, and only then give it its name."""
    with hidden_sibling(destination, mode) as hidden:
        with open(hidden, "r+b") as out:
            fill(out)
            size = out.tell()
        before()
        give_name(hidden, destination, replace)
        return size


def sibling(path: str, what: str) -> str:
    """``data.csv`` and ``filtered`` make ``data-filtered.csv``."""
    stem, extension = os.path.splitext(path)
    return f"{stem}-{what}{extension}"
