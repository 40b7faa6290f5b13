"""The states of a run in a shared folder, so that a new driver can go on with it.

A state is one JSON file per finished round, written aside and renamed into place: a reader
finds it whole or not at all. States are small (ledger, specs, names); tables are named by path.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

FORMAT = "round-{:06d}.json"


class RoundTaken(RuntimeError):
    """The round has a state already: another driver works on the same folder."""


@dataclass(frozen=True)
class Manifest:
    """``path`` is a folder that a driver started elsewhere can read as well."""

    spark: SparkSession
    path: str

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def rounds(self) -> list[int]:
        """Numbers of the rounds that have a state, ascending."""
        pattern, files = self._at("round-*.json")
        found = [f.getPath().getName() for f in files.globStatus(pattern) or []]
        return sorted(int(name.removeprefix("round-").removesuffix(".json")) for name in found)

    def latest(self) -> dict | None:
        """The state of the last finished round; None for a run that has not begun."""
        numbers = self.rounds()
        if not numbers:
            return None
        text = self.spark.read.text(f"{self.path.rstrip('/')}/{FORMAT.format(numbers[-1])}", wholetext=True)
        return json.loads(text.first()[0])

    def commit(self, number: int, state: dict) -> None:
        """Make ``state`` that of round ``number``; a round gets one state only."""
        text = json.dumps(state)
        target, files = self._at(FORMAT.format(number))
        aside, _ = self._at(f"_open-{uuid.uuid4().hex}")
        out = files.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        # Some file systems let a rename replace a file, so the place is looked at first.
        if files.exists(target) or not files.rename(aside, target):
            files.delete(aside, False)
            raise RoundTaken(f"round {number} of {self.path} has been finished by another driver")
