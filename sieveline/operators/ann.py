"""Approximate nearest neighbours: vectors in cells around centres, compared by byte codes, the best rescored exactly.

Centres are fitted on a bounded sample (``SAMPLE``), every vector is indexed in the cell of its nearest centre, and a search
reads the ``probes`` cells nearest to the query only: cells are folders, so that the scan is pruned to them. Within them the
distances of byte codes (quantised between the bounds of all vectors) choose ``rescored`` times as many vectors as are
wanted, and these are ranked by their exact distance. With all cells probed and all vectors rescored a search is exact.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.vectors import I8_METRICS, distance, quantise, quantised
from sieveline.operators.ids import only
from sieveline.operators.vector import calibration
from sieveline.sources.store import Store

#: Vectors that centres are fitted on at most, turns of fitting, and the most cells.
SAMPLE, TURNS, MOST_CELLS = 50_000, 12, 4_096
#: Of the cells the share that a search reads, and how many times k vectors are rescored. The share suits vectors without
#: any structure, such as those of the test tables (recall 0.92 to 0.95 of 10); clustered ones need far fewer probes.
PROBED, RESCORED = 0.65, 4


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)


def fit_centres(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Lloyd's means from rows of ``x``; a centre that loses all its rows stays where it is."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, replace=False)].astype(np.float64)
    for _ in range(TURNS):
        owner = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, owner, x)
        count = np.bincount(owner, minlength=cells)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


class AnnIndex:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self.meta = json.loads(self.store.read("meta.json"))

    @staticmethod
    def build(entries: DataFrame, root: str, metric: str = "l2", cells: int | None = None, sample: int = SAMPLE) -> AnnIndex:
        """Index ``entries`` (doc_id, ord, vec). By default there are about the square root of their number of cells."""
        spark = entries.sparkSession
        n = entries.count()
        chosen = entries.where(F.pmod(F.xxhash64("doc_id", "ord"), F.lit(max(1, n // sample))) == 0).limit(sample).select("vec").toArrow()
        x = np.array(chosen["vec"].to_pylist(), np.float64).reshape(chosen.num_rows, -1)
        x = _unit(x) if metric == "cosine" else x
        cells = min(cells or max(1, round(n**0.5)), MOST_CELLS, max(1, len(x)))
        centres = fit_centres(x, cells) if len(x) else np.zeros((1, 0))
        bounds = sorted(calibration(entries).collect())  # a row for each dimension
        low, high = [float(b["low"]) for b in bounds], [float(b["high"]) for b in bounds]

        def assign(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    v = np.array(batch.column("vec").to_pylist(), np.float64)
                    cell = _nearest(_unit(v) if metric == "cosine" else v, centres)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

        array = lambda xs: F.array(*[F.lit(v) for v in xs])
        rows = entries.select("doc_id", "ord", "vec")
        types = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
        placed = rows.mapInArrow(assign, f"{types}, cell int").withColumn("codes", quantised(F.col("vec"), array(low), array(high)))
        # A cell with very many vectors is written by several tasks.
        placed.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // 1_000_000)))).write.partitionBy("cell").parquet(f"{root}/cells")
        Store(spark, root).write(json.dumps({"metric": metric, "centres": centres.tolist(), "low": low, "high": high}), "meta.json")
        return AnnIndex(spark, root)

    def search(self, query: list[float], k: int, probes: int | None = None, rescored: int = RESCORED, allowed: DataFrame | None = None, per_document: int = 1) -> DataFrame:
        """(doc_id, distance) of about the k nearest documents by their nearest vector, ties by doc_id. The filter comes before
        every cut; ``per_document`` is the most vectors that a document has."""
        metric, centres = self.meta["metric"], np.array(self.meta["centres"])
        if len(query) != centres.shape[1]:
            raise ValueError(f"the query has {len(query)} dimensions, the index {centres.shape[1]}")
        q = _unit(np.array(query, np.float64)) if metric == "cosine" else np.array(query, np.float64)
        away = -(centres @ q) if metric == "dot" else ((centres - q) ** 2).sum(axis=1)
        near = np.argsort(away, kind="stable")[: probes or max(1, round(PROBED * len(centres)))]
        rows = self.spark.read.parquet(f"{self.store.root}/cells").where(F.col("cell").isin([int(c) for c in near]))
        codes = quantise([float(v) for v in query], self.meta["low"], self.meta["high"])
        # Codes of all metrics are compared by their squared distance where a shifted product would mislead.
        rough = I8_METRICS["l2"](F.col("codes"), codes) if metric != "dot" else distance("dot", F.col("vec"), query)
        best = only(rows, allowed).select("doc_id", "vec", rough.alias("rough")).orderBy("rough", "doc_id").limit(k * per_document * rescored)
        exact = best.select("doc_id", distance(metric, F.col("vec"), query).alias("distance"))
        return exact.groupBy("doc_id").agg(F.min("distance").alias("distance")).orderBy("distance", "doc_id").limit(k)
