"""A chain of stages that runs only what is out of date.

A stage's digest covers its name, its settings, its code and the digests of what it reads: earlier
stages, or files by path, size and time. Its result is a table named by that digest, so a stage
whose table is complete is not run again, a changed setting gives new names to that stage and all
that follow it, and a stage that failed half-way left nothing that looks complete. A stage may
have a check; what that finds is told beside the result and never stops the chain.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """`run` gets the tables named in `needs`, in that order, and the settings as keywords."""

    name: str
    run: Callable[..., DataFrame]
    needs: Sequence[str] = ()
    settings: Mapping[str, object] = field(default_factory=dict)
    check: Callable[[DataFrame], list[str]] | None = None


@dataclass
class Told:
    """What became of a stage: 'ran', 'reused', 'failed' or 'not run'."""

    stage: str
    status: str
    digest: str = ""
    path: str = ""
    concerns: list[str] = field(default_factory=list)
    error: str = ""


class Chain:
    """Stages in order; `sources` names the files (paths) that stages may need besides earlier stages."""

    def __init__(self, spark: SparkSession, folder: str, sources: Mapping[str, str], stages: Sequence[Stage]):
        self.spark, self.folder, self.sources, self.stages = spark, folder.rstrip("/"), dict(sources), list(stages)
        known = set(self.sources)
        for s in self.stages:
            lacking = [n for n in s.needs if n not in known]
            if lacking or s.name in known:
                raise ValueError(f"stage {s.name}: " + (f"needs {', '.join(lacking)} before it" if lacking else "the name is taken"))
            known.add(s.name)

    def _path(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _files(self, path: str) -> list[list]:
        """Path, size and time of each file below `path`."""
        where, store = self._path(path)
        out, every = [], store.listFiles(where, True)
        while every.hasNext():
            f = every.next()
            out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
        return sorted(out)

    def digests(self) -> dict[str, str]:
        """Of every source and stage, as things stand now."""
        made = lambda *parts: hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]
        out = {name: made("files", self._files(path)) for name, path in self.sources.items()}
        for s in self.stages:
            out[s.name] = made(s.name, dict(s.settings), _code(s.run), [out[n] for n in s.needs])
        return out

    def run(self, again: Sequence[str] = ()) -> list[Told]:
        """Bring every stage up to date, in order. The stages named in `again`, and what follows them, run whatever is there.

        A stage that raises ends the run; what was complete before it stays, and the next run goes on from there."""
        digests, told, fresh = self.digests(), [], set()
        for s in self.stages:
            if told and told[-1].status in ("failed", "not run"):
                told.append(Told(s.name, "not run", digests[s.name]))
                continue
            path = f"{self.folder}/{s.name}-{digests[s.name]}"
            where, store = self._path(f"{path}/_SUCCESS")
            record = Told(s.name, "reused", digests[s.name], path)
            told.append(record)
            try:
                if s.name in again or any(n in fresh for n in s.needs) or not store.exists(where):
                    record.status = "ran"
                    fresh.add(s.name)
                    s.run(*(self.table(n, digests) for n in s.needs), **s.settings).write.mode("overwrite").parquet(path)
                if s.check is not None:
                    record.concerns = list(s.check(self.spark.read.parquet(path)))
            except Exception as e:  # noqa: BLE001  the record tells it; what was complete stays
                record.status, record.error = "failed", f"{type(e).__name__}: {e}".splitlines()[0]
        return told

    def table(self, name: str, digests: Mapping[str, str] | None = None) -> DataFrame:
        """A source, or the table of a stage as its digest stands."""
        if name in self.sources:
            return self.spark.read.parquet(self.sources[name])
        return self.spark.read.parquet(f"{self.folder}/{name}-{(digests or self.digests())[name]}")


def _code(run: Callable) -> str:
    try:
        return inspect.getsource(run)
    except (OSError, TypeError):  # built in, or typed at a prompt
        return getattr(run, "__qualname__", repr(type(run)))
