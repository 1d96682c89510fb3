"""A small JSON document that several writers may change, as numbered files of which the last counts."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from typing import TypeVar

from ..model import EngineError
from .files import Files

Out = TypeVar("Out")
KEPT = 16
ATTEMPTS = 200
_one_at_a_time = threading.Lock()


class Versioned:
    """Readers see whole versions; of two writers of one number, the second starts anew from the first one's."""

    def __init__(self, files: Files, folder: str):
        self.files, self.folder = files, folder

    def _latest(self) -> tuple[int, dict]:
        for _ in range(ATTEMPTS):
            numbers = [int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json")]
            if not numbers:
                return 0, {}
            if (text := self.files.read(self._path(max(numbers)))) is not None:  # else trimmed since
                return max(numbers), json.loads(text)
        raise EngineError(f"{self.folder} can't be read")

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:020d}.json"

    def load(self) -> dict:
        return self._latest()[1]

    def update(self, change: Callable[[dict], Out]) -> Out:
        """Apply ``change`` to the last version and store the result as the next; it may run several times."""
        for _ in range(ATTEMPTS):
            with _one_at_a_time:  # threads of one driver needn't collide
                number, doc = self._latest()
                before = json.dumps(doc, sort_keys=True)
                out = change(doc)
                if (after := json.dumps(doc, sort_keys=True)) == before:
                    return out
                if self.files.create(self._path(number + 1), after):
                    if number >= KEPT:
                        self.files.remove(self._path(number - KEPT))
                    return out
        raise EngineError(f"too many writers of {self.folder}")
