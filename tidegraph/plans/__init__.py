"""From files to graphs. ``ANALYZERS`` is the registry: a name to what makes its graph and its targets of a full run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from ..operators.graph import Graph
from . import cargo, golang, jest, pytest


class Build(Protocol):
    def __call__(self, files: DataFrame, *args, **kwargs) -> Graph: ...


@dataclass(frozen=True)
class Analyzer:
    """``build`` takes the files of projects of its kind; ``all_targets`` is None where the runner's own default is every test."""

    name: str
    build: Build
    all_targets: Callable[[DataFrame], DataFrame] | None = None


ANALYZERS = {
    "go": Analyzer("go", golang.build, golang.patterns),
    "jest": Analyzer("jest", jest.build),
    "pytest": Analyzer("pytest", pytest.build),
    "cargo": Analyzer("cargo", cargo.build),
}
