"""A whole linkage: raw files in, two result files out, every step a finished table that a later run reads again."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.normalize import check_records, normalize_records
from ..operators import blocking as B
from ..operators import features as X
from ..operators import learn as L
from ..operators import selection as S
from ..sources import io

VERSION = 1  # of what the steps make; tables of another version are not read
_LOG = logging.getLogger("kinfold")


@dataclass(frozen=True)
class Settings:
    """Where a run works, how it blocks and learns. ``conf`` are Spark settings for the run (memory, spill, partitions), put back after it."""

    work: str
    knobs: B.Knobs = field(default_factory=B.Knobs)
    shards: int = 8
    trees: dict = field(default_factory=lambda: dict(L.PARAMETER_SETS["reference"]))
    conf: dict[str, str] = field(default_factory=dict)


@contextmanager
def step(spark: SparkSession, name: str) -> Iterator[None]:
    """Names the jobs of a step and logs how long it took."""
    began = time.monotonic()
    spark.sparkContext.setJobDescription(name)
    try:
        yield
    finally:
        spark.sparkContext.setJobDescription(None)
        _LOG.info("%s: %.1f s", name, time.monotonic() - began)


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _once(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made now unless an earlier run finished it."""
    if not io.finished(spark, path):
        io.write_table(make(), path)
    return spark.read.parquet(path)


def link(spark: SparkSession, reference: str, pool: list[str], at: Settings, truth: str | None = None, model: str | None = None) -> dict[str, int]:
    """Links the records of ``reference`` to those of the ``pool`` files (tab-separated). With ``truth`` a model is fitted and kept under
    ``model`` (or the work folder); without, the model there is used. Writes matching_results and candidate_pairs, each a line for
    every reference record in its file's order, and returns ``validate``'s counts. Blocking beyond the budget of pairs raises before any join."""
    work = io.versioned(at.work, VERSION)
    kept = model or f"{work}/model"
    with settings(spark, at.conf):
        with step(spark, "normalize"):
            s1_raw = io.read_source(spark, reference)
            s1 = _once(spark, f"{work}/reference", lambda: normalize_records(s1_raw, 1))
            parts = [(path, n) for n, path in enumerate(pool, 2)]
            pool_records = spark.read.parquet(*[_path(spark, f"{work}/pool-{n}", path, n) for path, n in parts])
            check_records(s1, s1_raw.count(), blank=1.0)
        with step(spark, "block"):
            index = B.Index(pool_records, at.knobs).persist()
            index.check_budget(s1)
            found = io.run_shards(spark, s1, at.shards, f"{work}/candidates", lambda part: B.top_k(B.union(part, index), at.knobs.top_k)).drop("shard")
        with step(spark, "features"):
            made = f"{work}/features"
            if not io.finished(spark, made):
                X.write_matrix(X.matrix(X.base(found, s1, pool_records, index), s1, pool_records), made, found.count())
            index.discard()
            rows = spark.read.parquet(made)
        with step(spark, "learn"):
            if truth is not None:
                known = io.read_truth(spark, truth, s1.select("entity_id"))
                table, names = L.without_nulls(L.split_by_entity(L.labelled(rows, known)), list(X.FEATURES))
                trees = L.fit_trees(table, names, **at.trees)
                L.save(trees, L.calibrate(L.predicted(trees, table.filter("fold = 1"))), names, kept)
            trees, calibration, names = L.load(kept)
        with step(spark, "select"):
            table, _ = L.without_nulls(rows, list(X.FEATURES))
            probs, mass = L.score_pairs(trees, calibration, table)
            probs = _once(spark, f"{work}/probabilities", lambda: probs)
            chosen = S.repair(probs, S.select_exact)
        with step(spark, "write"):
            order = io.with_row_order(s1_raw)
            ids = s1.select("entity_id")
            matches = io.match_lines(ids, chosen, "matched_entity_ids")
            lines = io.match_lines(ids, found.select("s1_id", "cand_id"), "candidate_entity_ids")
            io.write_one_file(io.in_file_order(matches, order), f"{work}/matching_results")
            io.write_one_file(io.in_file_order(lines, order), f"{work}/candidate_pairs")
            return io.validate(ids, matches, lines, pool_records)


def _path(spark: SparkSession, path: str, raw: str, source: int) -> str:
    _once(spark, path, lambda: normalize_records(io.read_source(spark, raw), source))
    return path


def resumed(spark: SparkSession, at: Settings) -> list[str]:
    """The steps whose tables are finished."""
    work = io.versioned(at.work, VERSION)
    return [n for n in ("reference", "features", "probabilities", "matching_results", "candidate_pairs") if io.finished(spark, f"{work}/{n}")]
