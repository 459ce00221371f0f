"""Python workers give back what their functions have freed."""

import ctypes
import os

import pytest

from cloakroom.llm.common import lean


def _resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def _used():
    """The last of 2000 strings below it keeps the C library from shrinking its heap by itself."""
    held = [b"x" * 100_000 for _ in range(2000)]
    return held[-1]


def _batches(batches):
    for _ in batches:
        yield _used()


@pytest.mark.skipif(not os.path.exists("/proc/self/statm") or not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="not glibc on Linux")
@pytest.mark.parametrize("run, args", [(lambda df: _used(), [None]), (lambda df, other: _used(), [None, None]), (_batches, [[1]])])
def test_freed_memory_goes_back(run, args):
    kept = run(*args) if run is not _batches else list(run(*args))
    before = _resident_mb()  # with what one call leaves behind
    kept = lean(run)(*args) if run is not _batches else list(lean(run)(*args))
    assert _resident_mb() < before - 100 and kept
