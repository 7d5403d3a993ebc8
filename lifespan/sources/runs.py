"""Prediction runs as transactions: files by attempt, and one receipt per run that makes them count.

A task writes its rows to a file of its own attempt and reports what it wrote: rows, bytes, digest
and sums for the metrics.  The commit puts the reports of all tasks into one receipt and stores it
under the name of the run, which is the only step that others can see: a run that fails leaves
nothing that is read, and one that is repeated with the same id has one receipt again, of its own
files.  The ledger is the folder of receipts.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lifespan.operators import ledger
from lifespan.sources.delimited import PREDICTION_COLUMNS, read_prediction_csv
from lifespan.sources.storage import opened

RECEIPT = (
    "run_id string, stage string, status string, created_at string, component string, split string, route_id string, rul_unit string, "
    "inputs array<struct<name: string, n_rows: bigint, fingerprint: string>>, files array<struct<name: string, n_rows: bigint, bytes: bigint, sha256: string>>, "
    "n_windows bigint, metrics struct<rmse: double, mae: double, bias: double, n: bigint>"
)
_RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,127}")


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote, and the sums of its errors where the truth is known."""

    name: str
    n_rows: int
    n_bytes: int
    sha256: str
    known: int
    squares: float
    absolute: float
    errors: float


class _Hashed:
    """A stream that keeps the digest and the length of what goes through it."""

    def __init__(self, out):
        self.out, self.sha, self.size, self.closed = out, hashlib.sha256(), 0, False

    def write(self, data) -> int:
        self.sha.update(data)
        self.size += len(data)
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.closed = True


class RunWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.receipt = options["path"], json.loads(options["receipt"])

    @property
    def run_id(self) -> str:
        return self.receipt["run_id"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        folder, name = f"{root}/runs/{self.run_id}", f"part-{uuid.uuid4().hex}.csv"
        store.create_dir(folder, recursive=True)
        known, n, sums = 0, 0, [0.0, 0.0, 0.0]
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            hashed = _Hashed(out)
            schema = pa.schema([(c, pa.string()) for c in PREDICTION_COLUMNS])
            with pacsv.CSVWriter(pa.PythonFile(hashed, mode="w"), schema) as csv:
                for batch in iterator:
                    n += batch.num_rows
                    csv.write_batch(pa.RecordBatch.from_arrays([batch.column(c).cast(pa.string()).fill_null("") for c in PREDICTION_COLUMNS], schema=schema))
                    error = pc.subtract(batch.column("prediction").cast(pa.float64()), batch.column("truth").cast(pa.float64())).drop_null()
                    known += len(error)
                    for k, values in enumerate((pc.multiply(error, error), pc.abs(error), error)):
                        sums[k] += pc.sum(values).as_py() or 0.0
        return Written(name, n, hashed.size, hashed.sha.hexdigest(), known, *sums)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        n = sum(m.known for m in done)
        total = lambda k: math.fsum(getattr(m, k) for m in done)
        metrics = {"rmse": math.sqrt(total("squares") / n), "mae": total("absolute") / n, "bias": total("errors") / n, "n": n} if n else None
        files = [{"name": m.name, "n_rows": m.n_rows, "bytes": m.n_bytes, "sha256": m.sha256} for m in done]
        receipt = self.receipt | {
            "stage": "prediction", "status": "pass", "created_at": datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds"),
            "files": files, "n_windows": sum(m.n_rows for m in done), "metrics": metrics,
        }
        store.create_dir(f"{root}/ledger", recursive=True)
        # one object written whole: what makes the run count
        with store.open_output_stream(f"{root}/ledger/{self.run_id}.json", compression=None) as out:
            out.write(json.dumps(receipt).encode() + b"\n")
        self._remove_others(store, f"{root}/runs/{self.run_id}", {f["name"] for f in files})

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/runs/{self.run_id}/{m.name}")

    @staticmethod
    def _remove_others(store, folder: str, kept: set[str]) -> None:
        """Files of earlier runs of this id, and of attempts that did not count."""
        from pyarrow import fs

        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith("part-") and info.base_name not in kept:
                store.delete_file(info.path)


class PredictionRuns(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prediction_runs"

    def writer(self, schema, overwrite: bool) -> RunWriter:
        return RunWriter(dict(self.options))


def write_run(
    spark: SparkSession, path: str, run_id: str, predictions: DataFrame, component: str, split: str, route_id: str, rul_unit: str,
    inputs: dict[str, DataFrame],
) -> None:
    """Write the predictions of a run and its receipt: inputs with their fingerprints, files with
    their digests, split, windows and metrics.

    ``predictions`` has the columns of ``PREDICTION_COLUMNS``; ``truth`` may be null.  A repeated
    ``run_id`` replaces the run.
    """
    if not _RUN_ID.fullmatch(run_id):
        raise ValueError(f"not a run id: {run_id!r}")
    read = []
    for name in sorted(inputs):
        columns = [F.col(f"`{c}`") for c in sorted(inputs[name].columns)]
        row = ledger.fingerprint(inputs[name], columns).first()
        read.append({"name": name, "n_rows": row["n_rows"] if row else 0, "fingerprint": row["fingerprint"] if row else None})
    receipt = {"run_id": run_id, "component": component, "split": split, "route_id": route_id, "rul_unit": rul_unit, "inputs": read}
    spark.dataSource.register(PredictionRuns)
    writer = predictions.select(*PREDICTION_COLUMNS).write.format("prediction_runs").mode("append")
    writer.option("receipt", json.dumps(receipt)).save(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One receipt per run."""
    return spark.read.schema(RECEIPT).json(f"{path}/ledger")


def read_run(spark: SparkSession, path: str, run_id: str, route: str) -> DataFrame:
    """The typed predictions of a run, from the files its receipt names."""
    receipt = read_ledger(spark, path).where(F.col("run_id") == run_id).select("files.name").first()
    if receipt is None:
        raise ValueError(f"no run {run_id!r}")
    return read_prediction_csv(spark, [f"{path}/runs/{run_id}/{name}" for name in receipt["name"]], route)
