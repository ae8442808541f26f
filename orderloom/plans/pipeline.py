"""Pipelines: tasks in order of what they depend on, sources routed to transforms, and outputs written."""

from __future__ import annotations

import graphlib
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import load_outputs
from ..sources.spec import SourceSpec, read_source


@dataclass(frozen=True)
class Task:
    """A function of the results of the tasks it depends on, in that order."""

    name: str
    fn: Callable
    depends: tuple[str, ...] = ()


def run_tasks(tasks: list[Task]) -> dict[str, object]:
    """Each task once, after those it depends on; a cycle or an unknown name raises."""
    by_name = {t.name: t for t in tasks}
    if unknown := {d for t in tasks for d in t.depends} - set(by_name):
        raise KeyError(sorted(unknown))
    out: dict[str, object] = {}
    for name in graphlib.TopologicalSorter({t.name: t.depends for t in tasks}).static_order():
        t = by_name[name]
        out[name] = t.fn(*[out[d] for d in t.depends])
    return out


def run_concurrently(spark: SparkSession, tasks: list[Task], threads: int = 4, pool: str = "tasks") -> dict[str, object]:
    """run_tasks with tasks that don't depend on each other at the same time, as Spark jobs in a scheduler pool under one tag.

    The first failure cancels the jobs of the tasks that run, no further task begins, and the failure is raised.
    """
    by_name = {t.name: t for t in tasks}
    if unknown := {d for t in tasks for d in t.depends} - set(by_name):
        raise KeyError(sorted(unknown))
    order = graphlib.TopologicalSorter({t.name: t.depends for t in tasks})
    order.prepare()
    sc, tag = spark.sparkContext, f"tasks-{uuid.uuid4().hex}"
    out: dict[str, object] = {}

    def call(t: Task) -> object:
        sc.addJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", pool)
        try:
            return t.fn(*[out[d] for d in t.depends])
        finally:
            sc.removeJobTag(tag)

    with ThreadPoolExecutor(threads) as workers:
        running: dict[Future, str] = {}
        while order.is_active():
            running |= {workers.submit(call, by_name[name]): name for name in order.get_ready()}
            for f in wait(running, return_when=FIRST_COMPLETED).done:
                name = running.pop(f)
                if f.exception() is not None:
                    for other in running:
                        other.cancel()
                    sc.cancelJobsWithTag(tag)
                    raise f.exception()
                out[name] = f.result()
                order.done(name)
    return out


@dataclass
class Pipeline:
    """Reads sources, applies a transform by name of source or by kind of processing, and writes what comes out.

    A source, transform or output that fails is noted in `errors` by its name, and the others go on.
    """

    spark: SparkSession
    transforms: dict[str, Callable[[DataFrame], DataFrame | dict[str, DataFrame]]] = field(default_factory=dict)
    roots: tuple[str, ...] = ()
    errors: dict[str, str] = field(default_factory=dict)

    def extract(self, specs: list[SourceSpec]) -> dict[str, DataFrame]:
        out = {}
        for s in specs:
            try:
                out[s.name] = read_source(self.spark, s, self.roots)
            except Exception as e:  # noqa: BLE001  one source must not stop the others
                self.errors[s.name] = f"{type(e).__name__}: {e}"
        return out

    def transform(self, specs: list[SourceSpec], frames: dict[str, DataFrame]) -> dict[str, DataFrame | dict[str, DataFrame]]:
        out = {}
        for s in specs:
            if s.name in frames:
                fn = self.transforms.get(s.name, self.transforms.get(s.processing, lambda df: df))
                try:
                    out[s.name] = fn(frames[s.name])
                except Exception as e:  # noqa: BLE001  nor one transform
                    self.errors[s.name] = f"{type(e).__name__}: {e}"
        return out

    def run(self, specs: list[SourceSpec], target: str, kind: str = "sqlite", mode: str = "replace") -> dict[str, float]:
        return load_outputs(self.transform(specs, self.extract(specs)), target, kind=kind, mode=mode, errors=self.errors)


def counted(df: DataFrame, name: str):
    """(df that counts its rows as it runs, the observation that has `rows` after an action)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def top_products(parts: tuple[DataFrame, DataFrame], product: str = "produto", quantity: str = "quantidade", k: int = 5) -> DataFrame:
    """History and new orders together: the k products of the largest total quantity."""
    history, new = parts
    both = history.unionByName(new, allowMissingColumns=True)
    return both.groupBy(product).agg(F.sum(F.col(quantity).try_cast("long")).alias("total")).orderBy(F.desc("total"), product).limit(k)
