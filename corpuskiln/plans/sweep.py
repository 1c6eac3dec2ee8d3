"""Running cells of the matrix as one Spark job, a task for each cell."""

from __future__ import annotations

import multiprocessing
import resource
import shutil
import time
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.operators import archive
from corpuskiln.plans import dims
from corpuskiln.plans.matrix import KEYS

MOST_STREAM = 1 << 29
TIMEOUT = 3600.0

MEASURED = (
    "row_id string, tokenizer string, packing string, backend string, backend_transport string, tokenization_layout string, chunk_size long, batch_chunks int, threads int, corpus_bytes long, compressed_bytes long, packed_bytes long, token_count long, unsafe_boundary_cuts long, ratio double,"
    " tokenize_time_s double, pack_time_s double, compress_time_s double, total_time_s double, throughput_mbps double, decompress_time_s double, decompress_throughput_mbps double,"
    " round_trip_verified boolean, sha256_match boolean, token_count_match boolean, length_match boolean, peak_rss_mb double, error string, status string, started_utc string, finished_utc string"
)
_NAMES = [part.split()[0] for part in MEASURED.split(",")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
_TYPES = [_KINDS[part.split()[1]] for part in MEASURED.split(",")]


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def unavailable(cell: dict) -> str | None:
    """Why this machine can't run the cell as it says; it is refused then, never changed."""
    if reason := archive.refusal(cell["tokenizer"], cell["packing"]):
        return reason
    family = dims.BACKENDS[cell["backend"]][0]
    if cell["backend_transport"] == "subprocess_cli" and not shutil.which(dims.TOOL[family]):
        return f"no command named {dims.TOOL[family]}"
    if cell["backend_transport"] == "in_process_binding" and family == "lzma" and cell["threads"] > 1:
        return "in process, xz has one thread"
    return None


def measure(cell: dict, data: bytes) -> dict:
    """Builds and verifies one archive by the cell's own settings; what goes wrong is a failed row, never a lost one."""
    row = {"started_utc": _now(), "corpus_bytes": len(data), "status": "failed", "round_trip_verified": False}
    if reason := unavailable(cell):
        return row | {"status": "refused", "error": reason, "finished_utc": _now()}
    mb = len(data) / 1048576
    try:
        settings = {"transport": cell["backend_transport"], "threads": cell["threads"], "chunk": cell["chunk_size"], "layout": cell["tokenization_layout"], "batch": cell["batch_chunks"]}
        made, stats = archive.build(data, cell["tokenizer"], cell["packing"], cell["backend"], **settings)
        row |= stats | {"throughput_mbps": mb / max(stats["total_time_s"], 1e-9)}
        began = time.perf_counter()
        checks = archive.verify(made, threads=cell["threads"])
        spent = time.perf_counter() - began
        row |= {k: v for k, v in checks.items() if k != "data"} | {"decompress_time_s": spent, "decompress_throughput_mbps": mb / max(spent, 1e-9)}
        row["status"] = "ok" if checks["round_trip_verified"] else "failed"
    except Exception as e:  # a cell's failure is its result
        row["error"] = f"{type(e).__name__}: {e}"[-500:]
    return row | {"finished_utc": _now()}


def _child(send, cell: dict, data: bytes) -> None:
    row = measure(cell, data)
    used = max(resource.getrusage(who).ru_maxrss for who in (resource.RUSAGE_SELF, resource.RUSAGE_CHILDREN))
    send.send(row | {"peak_rss_mb": used / 1024})


def isolated(cell: dict, data: bytes, seconds: float = TIMEOUT) -> dict:
    """``measure`` in a process of its own, ended after some seconds; its death is a failed row too."""
    context = multiprocessing.get_context("fork")
    receive, send = context.Pipe(duplex=False)
    child = context.Process(target=_child, args=(send, cell, data))
    lost = {"started_utc": _now(), "corpus_bytes": len(data), "status": "failed", "round_trip_verified": False}
    child.start()
    send.close()
    try:
        if receive.poll(seconds):
            return receive.recv()
        return lost | {"error": f"not done after {seconds:g} s", "finished_utc": _now()}
    except EOFError:
        child.join()
        return lost | {"error": f"its process ended with {child.exitcode}", "finished_utc": _now()}
    finally:
        if child.is_alive():
            child.kill()
        child.join()


def run_cells(cells: DataFrame, corpus: DataFrame, seconds: float = TIMEOUT, carried: tuple[str, ...] = ()) -> DataFrame:
    """A measured row for each cell over the stream that ``corpus`` (one row, ``data``) holds.

    The ``carried`` text columns of the cells come last, as they are. Every task runs one cell. The stream is sent to all of them, so one of more than
    ``MOST_STREAM`` bytes is refused.
    """
    size = corpus.agg(F.max(F.octet_length("data"))).first()[0] or 0
    if size > MOST_STREAM:
        raise ValueError(f"a stream of {size} bytes is more than the {MOST_STREAM} that a task takes")
    names = ["row_id", *KEYS, *carried]
    columns, types = [*_NAMES, *carried], [*_TYPES, *[pa.string()] * len(carried)]
    work = cells.select(names).repartition(max(1, cells.count())).crossJoin(F.broadcast(corpus.select("data")))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                cell = {n: batch.column(i)[k].as_py() for i, n in enumerate(names)}
                row = cell | isolated(cell, batch.column(len(names))[k].as_py() or b"", seconds)
                yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in zip(columns, types)], columns)

    return work.mapInArrow(run, ", ".join([MEASURED, *(f"{n} string" for n in carried)]))
