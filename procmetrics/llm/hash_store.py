"""Sorted arrays in the shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import json
import mmap
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np


def local_path(path: str) -> str | None:
    """The plain path of a folder on a file system that all machines mount; None for a remote store."""
    url = urlparse(path)
    return url.path if url.scheme in ("", "file") else None


def save_arrays(path: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes one file: a JSON header with the place of each array, then the arrays, each at a multiple of 64 bytes.

    The file appears whole or not at all, so a task may be run again at any time.
    """
    here = local_path(path)
    folder = here or tempfile.mkdtemp()
    os.makedirs(folder, exist_ok=True)
    header, at = {}, 4096
    for key, values in arrays.items():
        header[key] = [str(values.dtype), len(values), at]
        at += -(-values.nbytes // 64) * 64
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(draft, "wb") as out:
        out.write(json.dumps(header).encode().ljust(4096))
        for key, values in arrays.items():
            out.seek(header[key][2])
            out.write(np.ascontiguousarray(values).data)
        out.truncate(at)
    if here:
        os.replace(draft, f"{folder}/{name}")
        return
    from pyarrow import fs

    remote, root = fs.FileSystem.from_uri(path)
    remote.create_dir(root)
    fs.copy_files(draft, f"{root}/{name}", source_filesystem=fs.LocalFileSystem(), destination_filesystem=remote)
    shutil.rmtree(folder)


def _mapped(file: str) -> dict[str, np.ndarray]:
    with open(file, "rb") as f:
        try:
            pages = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)  # no open file for each shard
        except TypeError:  # before Python 3.13
            pages = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    header = json.loads(pages[:4096])
    return {key: np.frombuffer(pages, kind, count, at) for key, (kind, count, at) in header.items()}


def load_arrays(path: str, name: str) -> dict[str, np.ndarray]:
    """The memory-mapped arrays of one file. Of a remote store that file alone is copied; the copy's name goes at once, its pages last.

    A file that isn't there raises FileNotFoundError, so a lost file never passes for an empty one.
    """
    folder = local_path(path)
    if folder is not None:
        return _mapped(f"{folder}/{name}")
    from pyarrow import fs

    remote, root = fs.FileSystem.from_uri(path)
    copy = tempfile.mkdtemp()
    try:
        fs.copy_files(f"{root}/{name}", f"{copy}/{name}", source_filesystem=remote, destination_filesystem=fs.LocalFileSystem())
        return _mapped(f"{copy}/{name}")
    finally:
        shutil.rmtree(copy)


class HashArrays:
    """The arrays of a store's shards, each opened when it is first asked for. sizes has the rows of each shard; empty ones have no file."""

    def __init__(self, path: str, sizes: list[int]):
        self.path, self.sizes, self.opened = path, sizes, {}

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, k: int) -> dict[str, np.ndarray] | None:
        if not self.sizes[k]:
            return None
        if k not in self.opened:
            self.opened[k] = load_arrays(self.path, str(k))
        return self.opened[k]


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted keys (ascending, for few page faults) in sorted_keys, and which are there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == wanted


def find_between(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same where each wanted value has its own ascending run values[low:high]: one binary search for all of them at once."""
    low, end = low.astype(np.int64).copy(), high.astype(np.int64)
    high = end.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = values[middle] < wanted[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    there = low < end
    there[there] = values[low[there]] == wanted[there]
    return low, there


def least(values: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in the smallest unsigned type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def short_counts(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes, and those of 255 or more beside them with their places."""
    many = np.flatnonzero(counts >= 255)
    return {name: np.minimum(counts, 255).astype(np.uint8), f"{name}_at": many.astype(np.uint32 if len(counts) < 1 << 32 else np.uint64), f"{name}_many": least(counts[many])}


def whole_counts(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """Counts at the given places, as short_counts wrote them."""
    out = arrays[name][at].astype(np.int64)
    many = np.flatnonzero(out == 255)
    if len(many):
        out[many] = arrays[f"{name}_many"][np.searchsorted(arrays[f"{name}_at"], at[many])].astype(np.int64)
    return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: equal ranges of the key space, so shards follow each other in key order."""
    return ((keys >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def edges_of(sorted_keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins and ends in an ascending key array."""
    return np.searchsorted(shard_of(sorted_keys, shards), np.arange(shards + 1))


def by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ordered by shard, those of a shard in their old order; and the edges of the shards."""
    order = np.argsort(shard.astype(np.uint16 if shards <= 1 << 16 else np.uint32), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])
