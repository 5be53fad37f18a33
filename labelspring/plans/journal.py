"""Finished epochs of an EM run, kept in the shared store so that a run can go on.

An epoch is a table of cells and a record that is written after it; the last record names the
tables that count.  Tables of earlier epochs are removed once a later record stands, so the
folder holds one epoch whatever the number of epochs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from labelspring import storage


class Journal:
    def __init__(self, spark: SparkSession, folder: str, settings):
        """``settings`` describes the run; a folder written with others is refused."""
        self.spark, self.folder = spark, folder
        self.settings = json.dumps(settings, sort_keys=True, default=str)
        self.tables: list[str] = []
        known = self.last()
        if known:
            if known["settings"] != self.settings:
                raise ValueError(f"{folder} holds a run with other settings")
            self.tables = known["finished"]

    def _epochs(self) -> list[int]:
        names = storage.children(self.spark, self.folder)
        return sorted(int(n.removeprefix("record")) for n in names if n.startswith("record"))

    def last(self) -> dict | None:
        """The record of the last epoch that was finished."""
        for epoch in reversed(self._epochs()):
            record = storage.read_record(self.spark, f"{self.folder}/record{epoch}")
            if record:
                return record
        return None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def write(self, name: str, cells: DataFrame) -> DataFrame:
        cells.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        if name.startswith("finished"):
            self.tables = [*self.tables, name]
        return self.table(name)

    def kept(self, name: str, cells: DataFrame) -> DataFrame:
        """The table of that name, written only if no complete one is there."""
        if storage.exists(self.spark, f"{self.folder}/{name}/_SUCCESS"):
            return self.table(name)
        return self.write(name, cells)

    def close_epoch(self, epoch: int, state, active: Sequence[int], trace: list[dict], like: DataFrame):
        """Record the epoch and remove the ones before it; the state over the recorded table."""
        cells = f"cells{epoch}"
        if active:
            state = state.restored(self.write(cells, state.as_table(active, like)), active)
        record = {
            "settings": self.settings, "epoch": epoch, "active": list(active), "trace": trace, "cells": cells, "finished": self.tables,
        }
        storage.write_record(self.spark, f"{self.folder}/record{epoch}", record)
        for name in storage.children(self.spark, self.folder):
            stale = name.startswith(("cells", "record")) and int(re.sub(r"\D", "", name)) < epoch
            if stale:
                storage.remove(self.spark, f"{self.folder}/{name}")
        return state
