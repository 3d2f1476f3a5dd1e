"""A run as an ordered graph of steps with digests, from which it resumes at the first step that has changed.

A step's digest is made of its plugin, its parameters, the seed, what lies at its source paths, and the digest of the step before.
Every step's result is one corpus for each split set; it is checked, written under its digest, and read back. A manifest that is
written last says that a result is whole. A later run starts behind the last step whose manifest is there.
"""

from __future__ import annotations

import hashlib
import json
import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quarry.corpus import Corpus
from quarry.plans.plugins import Plugin
from quarry.sources.fingerprints import Fingerprints
from quarry.sources.readers import exists, read_text, write_text

log = logging.getLogger("quarry")
#: Raise it where steps give other results than before.
VERSION = "1"
Sets = dict[str, Corpus]


@dataclass(frozen=True)
class Node:
    """One step: what it is, with which parameters, and what its result depends on."""

    plugin: Plugin
    params: dict[str, Any]
    digest: str = ""

    @property
    def name(self) -> str:
        return f"{self.plugin.kind}:{self.plugin.name}"


@dataclass(frozen=True)
class StepReport:
    name: str
    digest: str
    reused: bool
    jobs: int


@dataclass
class Report:
    """What a run did, step by step."""

    steps: list[StepReport] = field(default_factory=list)

    def executed(self) -> list[str]:
        return [s.name for s in self.steps if not s.reused]

    def jobs(self) -> int:
        return sum(s.jobs for s in self.steps)


def checked(step: str, result: Any) -> Sets:
    """The result, if it is a corpus of DataFrames for each split set."""
    if not isinstance(result, dict) or not result:
        raise TypeError(f"{step} returned {type(result).__name__}, no split sets")
    for name, corpus in result.items():
        if not isinstance(corpus, Corpus):
            raise TypeError(f"{step} returned {type(corpus).__name__} for split set {name!r}, no corpus")
        if wrong := sorted(s for s in corpus if not isinstance(corpus[s], DataFrame)):
            raise TypeError(f"{step}: splits {wrong} of {name!r} are no DataFrames")
    return result


def with_digests(nodes: list[Node], seed: int, settings: dict[str, Any], fingerprints: Fingerprints | None) -> list[Node]:
    """The nodes, each with the digest of all that its result depends on. Without fingerprints a source is known by its path."""
    out, before = [], hashlib.sha256(json.dumps([VERSION, seed, settings], sort_keys=True, default=str).encode()).hexdigest()
    for node in nodes:
        paths = {p.name: node.params[p.name] for p in node.plugin.params if p.source and node.params.get(p.name)}
        sources = {k: fingerprints.of(v) if fingerprints else v for k, v in paths.items()}
        params = {k: v for k, v in node.params.items() if k not in sources}
        body = [before, node.name, node.plugin.version, params, sources]
        before = hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()
        out.append(Node(node.plugin, node.params, before))
    return out


class Store:
    """Results of steps under their digests."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _manifest(self, digest: str) -> str:
        return f"{self.root}/steps/{digest}/complete.json"

    def has(self, node: Node) -> bool:
        """Whether the step's result is whole; an export's also has to be where it was put."""
        if not exists(self.spark, self._manifest(node.digest)):
            return False
        return node.plugin.kind != "export" or "path" not in node.params or exists(self.spark, node.params["path"])

    def load(self, digest: str) -> Sets:
        folder = f"{self.root}/steps/{digest}"
        sets = json.loads(read_text(self.spark, self._manifest(digest)))
        read = lambda name, split: self.spark.read.schema(sets[name][split]).parquet(f"{folder}/{name}/{split}")
        return {name: Corpus({split: read(name, split) for split in splits}) for name, splits in sets.items()}

    def save(self, digest: str, result: Sets) -> Sets:
        folder = f"{self.root}/steps/{digest}"
        for name, corpus in result.items():
            for split in corpus:
                corpus[split].write.mode("overwrite").parquet(f"{folder}/{name}/{split}")
        layout = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        write_text(self.spark, self._manifest(digest), json.dumps({n: {s: layout(c[s]) for s in c} for n, c in result.items()}))
        return self.load(digest)

    def point(self, digest: str, at: str) -> None:
        """A step that changes nothing has the result of the one before."""
        write_text(self.spark, self._manifest(digest), json.dumps({"_same": at}))

    def resolve(self, digest: str) -> str:
        held = json.loads(read_text(self.spark, self._manifest(digest)))
        return self.resolve(held["_same"]) if "_same" in held else digest


def run(spark: SparkSession, nodes: list[Node], call: Callable[[Node, Sets | None], Sets], store: Store | None = None) -> tuple[Sets, Report]:
    """The last step's result, and what was done for it. call(node, state) executes one step.

    Without a store every step runs, and results stay lazy.
    """
    report, state, first, tracker = Report(), None, 0, spark.sparkContext.statusTracker()
    if store:
        for k in reversed(range(len(nodes))):
            if store.has(nodes[k]):
                state, first = store.load(store.resolve(nodes[k].digest)), k + 1
                report.steps = [StepReport(n.name, n.digest, True, 0) for n in nodes[:first]]
                break
    for k, node in enumerate(nodes[first:], first):
        log.info("%s %s", node.name, node.params)
        group = f"quarry-{uuid.uuid4().hex}"
        spark.sparkContext.setJobGroup(group, node.name)
        try:
            made = checked(node.name, call(node, state))
            if store and node.plugin.kind == "export":
                store.point(node.digest, nodes[k - 1].digest)
            elif store:
                made = store.save(node.digest, made)
            state = made
        finally:
            for key in ("spark.jobGroup.id", "spark.job.description"):
                spark.sparkContext.setLocalProperty(key, None)
        report.steps.append(StepReport(node.name, node.digest, False, len(tracker.getJobIdsForGroup(group))))
    return state, report
