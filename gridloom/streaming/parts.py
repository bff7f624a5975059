"""What the tasks of a running job have done so far, part by part.

A task that ends writes a few numbers under its part's number to a folder that
all see; a task that runs again writes the same once more. Readers take what is
there in any order, and show the longest run of parts from the first one, which
only ever grows.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

from ..shared import shared_dir
from ..sources.files import filesystem


class PartLog:
    """Numbers by part. It goes to tasks, which ``commit``; the driver's own copy ``read``s."""

    def __init__(self, spark: SparkSession, parts: int):
        self.folder, self.parts = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}", parts
        self._known: dict[int, dict[str, int]] = {}
        store, root = filesystem(self.folder)
        store.create_dir(root, recursive=True)

    def __getstate__(self):
        return {"folder": self.folder, "parts": self.parts, "_known": {}}

    def commit(self, part: int, **numbers: int) -> None:
        """Called once for a part, at its end: a part that isn't done isn't there."""
        store, root = filesystem(self.folder)
        hidden = f"{root}/.{part}-{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as out:
            out.write(json.dumps(numbers).encode())
        try:
            store.move(hidden, f"{root}/{part}.json")
        except OSError:  # another run of the task was first, with the same numbers
            with contextlib.suppress(OSError):
                store.delete_file(hidden)

    def read(self) -> dict[int, dict[str, int]]:
        """All parts that are done. Each is read once."""
        from pyarrow import fs

        store, root = filesystem(self.folder)
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            name = info.base_name
            if name.endswith(".json") and not name.startswith(".") and (part := int(name[:-5])) not in self._known:
                with store.open_input_stream(info.path) as f:
                    self._known[part] = json.loads(f.read())
        return self._known

    def prefix(self) -> list[dict[str, int]]:
        """The numbers of the parts before the first one that isn't done."""
        known, out = self.read(), []
        while len(out) in known:
            out.append(known[len(out)])
        return out

    def total(self, name: str) -> int:
        return sum(p.get(name, 0) for p in self.read().values())

    def remove(self) -> None:
        store, root = filesystem(self.folder)
        with contextlib.suppress(OSError):
            store.delete_dir(root)


def totals(logs: Iterable[PartLog]) -> dict[str, int]:
    out: dict[str, int] = {}
    for log in logs:
        for numbers in log.read().values():
            for name, n in numbers.items():
                out[name] = out.get(name, 0) + n
    return out


__all__ = ["PartLog", "totals"]
