"""Options of the session, and what the machine and the cluster have."""

from __future__ import annotations

import os
import platform
import warnings
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass
class Options:
    """None: the session's own setting. ``block_size`` is the side of blocks, ``threads`` the number of tasks of products of
    blocks (``parallel`` False: one), ``compression`` the codec of intermediate and stored tables."""

    parallel: bool | None = None
    block_size: int | None = None
    threads: int | None = None
    compression: str | None = None


_options = Options()
CODECS = ("none", "uncompressed", "snappy", "gzip", "zstd", "lz4")


def set_options(**values) -> Options:
    """Set options for the process; unknown names or values are refused."""
    known = {f.name for f in fields(Options)}
    for name, value in values.items():
        if name not in known:
            raise ValueError(f"unknown option {name!r}")
        if name in ("block_size", "threads") and value is not None and (not isinstance(value, int) or value < 1):
            raise ValueError(f"{name} must be a positive integer")
        if name == "compression" and value is not None and value not in CODECS:
            raise ValueError(f"compression is one of {CODECS}")
        setattr(_options, name, value)
    return _options


def get_options() -> Options:
    return _options


def resolve(name: str, override=None, default=None):
    """The call's own value, else the process's, else the default."""
    own = getattr(_options, name)
    return override if override is not None else own if own is not None else default


def tasks(default: int) -> int:
    """Tasks of a product of blocks."""
    return 1 if _options.parallel is False else resolve("threads", None, default)


#: Cells of a result that one task makes, about.
TASK_CELLS = 1 << 26


def work_tasks(spark: SparkSession, cells: int) -> int:
    """Tasks of a step that makes so many cells, however few bytes it reads: those of the session, more for more cells."""
    return tasks(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-cells // TASK_CELLS)))


def apply_to(spark: SparkSession) -> None:
    if _options.threads:
        spark.conf.set("spark.sql.shuffle.partitions", _options.threads)
    if _options.compression:
        spark.conf.set("spark.sql.parquet.compression.codec", _options.compression)


def _meminfo() -> dict[str, int]:
    with open("/proc/meminfo") as f:
        return {k: int(v.split()[0]) // 1024 for k, v in (line.split(":", 1) for line in f)}


def total_ram_mb() -> int:
    return _meminfo()["MemTotal"]


def available_ram_mb() -> int:
    return _meminfo()["MemAvailable"]


def can_allocate(mb: float, share: float = 0.8) -> bool:
    return mb <= available_ram_mb() * share


# Shares of all memory, each with its greatest number of MB, up to which collecting a matrix is silent, noted,
# warned of, and done when forced; and the hundreds of MB to which they are rounded.
SHARES = {"silent": (0.15, 3072), "warning": (0.30, 8192), "force": (0.50, 16384), "blocked": (0.80, None)}
ROUNDED = 100


def memory_thresholds(total_mb: float | None = None) -> dict[str, float]:
    """MB up to which collecting a matrix is silent, noted, warned of, and done when forced."""
    total = total_ram_mb() if total_mb is None else total_mb
    return {k: float(ROUNDED * round((total * share if most is None else min(total * share, most)) / ROUNDED)) for k, (share, most) in SHARES.items()}


def may_collect(size_mb: float, *, force: bool = False, max_size_mb: float | None = None) -> None:
    """Raise or warn by size: beyond ``force`` only when forced, beyond ``blocked`` never. ``max_size_mb`` sets the silent
    size, the others are twice, four and eight times as much."""
    limit = memory_thresholds() if max_size_mb is None else {k: max_size_mb * f for k, f in zip(SHARES, (1, 2, 4, 8))}
    if size_mb > limit["blocked"]:
        raise MemoryError(f"{size_mb:.0f} MB are more than {limit['blocked']:.0f}; take a subset or keep the matrix as it is")
    if size_mb > limit["force"] and not force:
        raise MemoryError(f"{size_mb:.0f} MB are more than {limit['force']:.0f}; use force=True")
    if size_mb > limit["warning"]:
        warnings.warn(f"{size_mb:.0f} MB are collected; that takes long", ResourceWarning, stacklevel=3)
    elif size_mb > limit["silent"]:
        warnings.warn(f"{size_mb:.0f} MB are collected", ResourceWarning, stacklevel=3)


def memory_info() -> dict[str, float]:
    return {"total_mb": total_ram_mb(), "available_mb": available_ram_mb(), **memory_thresholds()}


def cpu_cores() -> int:
    return os.cpu_count() or 1


def recommended_threads(spark: SparkSession | None = None) -> int:
    return spark.sparkContext.defaultParallelism if spark else max(1, cpu_cores() // 2)


def system_info(spark: SparkSession | None = None) -> dict:
    return {"os": platform.system(), "cores": cpu_cores(), "total_mb": total_ram_mb(), "available_mb": available_ram_mb(), **({"spark": spark.version, "parallelism": spark.sparkContext.defaultParallelism} if spark else {})}
