"""Entropy coders of the experiment, in process or as command-line tools."""

from __future__ import annotations

import bz2
import lzma
import shutil
import subprocess
import tempfile
import zlib
from collections.abc import Iterable, Iterator

from corpuskiln.plans.dims import BACKENDS, TOOL

BLOCK = 1 << 20


def _xz_settings(backend: str) -> dict[str, int]:
    """lc, lp, pb and the preset from the options that the tool gets, so both mean the same."""
    options = dict(x.split("=") for x in BACKENDS[backend][5].split(","))
    preset = int(options["preset"].rstrip("e")) | (lzma.PRESET_EXTREME if options["preset"].endswith("e") else 0)
    return {"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": BACKENDS[backend][2] << 20} | {k: int(options[k]) for k in ("lc", "lp", "pb")}


def xz_block_size(dictionary: int, threads: int) -> int:
    return max(2 * dictionary, 2 * dictionary * min(threads, 4) // 4)


def tool_path(family: str) -> str:
    found = shutil.which(TOOL[family])
    if not found:
        raise RuntimeError(f"no command named {TOOL[family]}")
    return found


def compressor_argv(backend: str, threads: int, path: str | None = None) -> list[str]:
    """A block size only with several threads: one thread is one whole-dictionary block."""
    family, _, dictionary, level, window, options = BACKENDS[backend]
    tool = path or tool_path(family)
    if family == "lzma":
        blocks = [f"--block-size={xz_block_size(dictionary << 20, threads)}"] if threads > 1 else []
        return [tool, "-T", str(threads), "-c", *blocks, f"--lzma2={options}"]
    if family == "zstd":
        return [tool, f"-T{threads}", "-c", *(["--ultra"] if level > 19 else []), f"-{level}", f"--long={window}"]
    return [tool, f"-{level}", "-c"]


def decompressor_argv(backend: str, threads: int, path: str | None = None) -> list[str]:
    """zstd must be told the window again, or it refuses large ones."""
    family, window = BACKENDS[backend][0], BACKENDS[backend][4]
    tool = path or tool_path(family)
    more = {"lzma": ["-T", str(threads)], "zstd": [f"-T{threads}", f"--long={window}"]}
    return [tool, "-dc", *more.get(family, [])]


def _compressor(backend: str, threads: int):
    family, _, _, level, window, _ = BACKENDS[backend]
    if family == "lzma":  # the binding has one thread whatever ``threads`` says
        return lzma.LZMACompressor(lzma.FORMAT_XZ, filters=[_xz_settings(backend)])
    if family == "zstd":
        import zstandard

        settings = zstandard.ZstdCompressionParameters.from_level(level, threads=threads if threads > 1 else 0, enable_ldm=True, window_log=window)
        return zstandard.ZstdCompressor(compression_params=settings).compressobj()
    if family == "gzip":
        return zlib.compressobj(level, zlib.DEFLATED, 31)
    return bz2.BZ2Compressor(level)


def compress(parts: Iterable[bytes], backend: str, transport: str = "in_process_binding", threads: int = 1) -> bytes:
    """The compressed stream of some parts, fed one by one."""
    if transport == "in_process_binding":
        coder = _compressor(backend, threads)
        return b"".join([*(coder.compress(p) for p in parts), coder.flush()])
    if transport != "subprocess_cli":
        raise ValueError(f"unknown transport {transport!r}")
    with tempfile.TemporaryFile() as out:
        child = subprocess.Popen(compressor_argv(backend, threads), stdin=subprocess.PIPE, stdout=out, stderr=subprocess.PIPE)
        for p in parts:
            child.stdin.write(p)
        _, said = child.communicate()
        if child.returncode:
            raise RuntimeError(f"{backend} ended with {child.returncode}: {said.decode(errors='replace')[-400:]}")
        out.seek(0)
        return out.read()


def decompress(data: bytes, backend: str, transport: str = "in_process_binding", threads: int = 1) -> Iterator[bytes]:
    """The stream again, in blocks."""
    if transport == "subprocess_cli":
        done = subprocess.run(decompressor_argv(backend, threads), input=data, capture_output=True)
        if done.returncode:
            raise RuntimeError(f"{backend} ended with {done.returncode}: {done.stderr.decode(errors='replace')[-400:]}")
        yield from (done.stdout[k : k + BLOCK] for k in range(0, len(done.stdout), BLOCK))
        return
    family = BACKENDS[backend][0]
    if family == "lzma":
        coder = lzma.LZMADecompressor(lzma.FORMAT_XZ)
    elif family == "zstd":
        import zstandard

        coder = zstandard.ZstdDecompressor(max_window_size=1 << BACKENDS[backend][4]).decompressobj()
    elif family == "gzip":
        coder = zlib.decompressobj(31)
    else:
        coder = bz2.BZ2Decompressor()
    for k in range(0, len(data), BLOCK):
        if out := coder.decompress(data[k : k + BLOCK]):
            yield out
    if family != "zstd" and not coder.eof:
        raise ValueError(f"{backend} stream ends early")
