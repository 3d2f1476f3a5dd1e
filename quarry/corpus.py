"""A corpus: an immutable set of named splits, each a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES = "documents", "train_queries", "validation_queries"
TOKENS = "tokens"


@dataclass(frozen=True)
class Corpus:
    splits: Mapping[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.splits:
            raise KeyError(f"no split {name!r}; there are {sorted(self.splits)}")
        return self.splits[name]

    def __contains__(self, name: object) -> bool:
        return name in self.splits

    def __iter__(self) -> Iterator[str]:
        return iter(self.splits)

    def replace(self, **splits: DataFrame) -> Corpus:
        """With other tables for splits that are there."""
        if missing := sorted(set(splits) - set(self.splits)):
            raise KeyError(f"no such splits to update: {missing}")
        return Corpus({**self.splits, **splits})

    def add(self, **splits: DataFrame) -> Corpus:
        """With splits that are not there yet."""
        if there := sorted(set(splits) & set(self.splits)):
            raise ValueError(f"splits exist already: {there}")
        return Corpus({**self.splits, **splits})

    def merge(self, updated: Mapping[str, DataFrame] | None = None, extra: Mapping[str, DataFrame] | None = None) -> Corpus:
        for name, df in {**(updated or {}), **(extra or {})}.items():
            if not isinstance(df, DataFrame):
                raise TypeError(f"split {name!r} is no DataFrame but {type(df).__name__}")
        return self.replace(**(updated or {})).add(**(extra or {}))

    def without(self, *names: str) -> Corpus:
        return Corpus({k: v for k, v in self.splits.items() if k not in names})

    def map(self, change: Callable[[str, DataFrame], DataFrame]) -> Corpus:
        return Corpus({k: change(k, v) for k, v in self.splits.items()})

    def check_output(self, name: str, sources: tuple[str, ...]) -> None:
        """An output split has to be new or one of the splits that it is made from."""
        if name in self.splits and name not in sources:
            raise ValueError(f"split {name!r} exists and is not one of {sources}")
