"""Descriptors of the benchmark tables: feature count, file kind, class count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Dataset:
    name: str
    features: int
    binary: bool = False
    classes: int = 2

    @property
    def feature_names(self) -> list[str]:
        return [f"col{i}" for i in range(self.features)]

    @property
    def label(self) -> str:
        return "label"

    @property
    def record_length(self) -> int | None:
        """Bytes of a record of a binary file: one for each feature, then the label."""
        return self.features + 1 if self.binary else None

    @property
    def schema(self) -> T.StructType:
        kind, nullable = (T.ByteType(), False) if self.binary else (T.DoubleType(), True)
        return T.StructType([T.StructField(c, kind, nullable) for c in [*self.feature_names, self.label]])


# Names and widths of the public data sets.
DATASETS = {
    d.name: d
    for d in (
        Dataset("Alpha", 500), Dataset("Beta", 500), Dataset("Delta", 500),
        Dataset("OCR", 1156, True), Dataset("UCR", 1156, True), Dataset("FD", 900, True),
        Dataset("Epsilon", 2000), Dataset("Upsilon", 2000), Dataset("ECBDL", 631),
        Dataset("KDDCUPDOSR21", 128), Dataset("KDDCUPDOSPROBE", 128),
        Dataset("Traffic", 115), Dataset("Wiretap", 115), Dataset("Fuzzing", 115),
        Dataset("MNIST01", 784), Dataset("MNIST02", 784),
    )
}


def by_file_name(path: str) -> Dataset:
    """The data set whose name occurs in the path; the longest such name."""
    found = [d for d in DATASETS.values() if d.name.lower() in path.lower()]
    if not found:
        raise ValueError(f"no data set is named in {path}")
    return max(found, key=lambda d: len(d.name))
