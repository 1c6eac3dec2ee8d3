"""What the driver and the cluster can do: cores, memory, disk, tools, libraries."""

from __future__ import annotations

import importlib.util
import os
import platform
import re
import shutil
import subprocess

from pyspark.sql import DataFrame, SparkSession

from corpuskiln.plans.dims import TOOL

LIBRARIES = ("tiktoken", "zstandard", "numpy", "pandas", "pyarrow", "psutil")


def parse_version(text: str) -> tuple[int, int, int] | None:
    found = re.search(r"(\d+)\.(\d+)\.(\d+)", text or "")
    return tuple(map(int, found.groups())) if found else None


def memory() -> tuple[int, int, str]:
    """Total and available bytes, and where that was read; a guess says so."""
    try:
        with open("/proc/meminfo", encoding="ascii") as f:
            found = {k: int(v.split()[0]) * 1024 for k, v in (line.split(":") for line in f)}
        return found["MemTotal"], found["MemAvailable"], "meminfo"
    except (OSError, KeyError):
        return 8 << 30, 4 << 30, "guess"


def tool(name: str) -> dict:
    path = shutil.which(name)
    said = ""
    if path:
        done = subprocess.run([path, "--version"], capture_output=True, text=True, errors="replace", stdin=subprocess.DEVNULL, timeout=20)
        said = (done.stdout or done.stderr).strip().splitlines()[0] if (done.stdout or done.stderr).strip() else ""
    version = parse_version(said)
    return {"tool": name, "available": path is not None, "version": said or None, "supports_threading": name != "xz" or (version or (0, 0, 0)) >= (5, 2, 0)}


def snapshot(path: str = ".") -> dict:
    """The driver's resources and the defaults that follow from them."""
    cores = len(os.sched_getaffinity(0)) if hasattr(os, "sched_getaffinity") else os.cpu_count() or 1
    total, available, source = memory()
    chunk = 2 << 20
    return {
        "platform": platform.platform(), "cores": cores, "ram_total": total, "ram_available": available, "ram_source": source, "disk_free": shutil.disk_usage(path).free,
        "batch_chunks_default": min(max(4, int(available * 0.25) // (chunk * 5)), 128), "threads_default": cores,
    }


def tools(spark: SparkSession) -> DataFrame:
    """The tools relation that availability reasons join: command-line tools and the zstd binding."""
    rows = [tool(name) for name in TOOL.values()]
    rows.append({"tool": "zstandard", "available": importlib.util.find_spec("zstandard") is not None, "version": None, "supports_threading": True})
    return spark.createDataFrame([(r["tool"], r["available"], r["version"], r["supports_threading"]) for r in rows], "tool string, available boolean, version string, supports_threading boolean")


def libraries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, importlib.util.find_spec(n) is not None) for n in LIBRARIES], "library string, available boolean")


def cluster(spark: SparkSession) -> dict:
    """What Spark was given."""
    return {"parallelism": spark.sparkContext.defaultParallelism, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")), "adaptive": spark.conf.get("spark.sql.adaptive.enabled") == "true"}
