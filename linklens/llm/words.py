"""Tokenizer files, a bounded cache of encoded words and what a Python worker holds, shared by the operators."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

# Words kept by each Python worker: fixed, so memory does not grow with the corpus. Frequent words come early.
CACHE_WORDS = 600_000
# Texts of one slice: larger batches are cut so that a worker holds little more than one long text.
SLICE_BYTES = 8 << 20


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file lies."""
    import public_tokenizers
    return public_tokenizers.path(name)


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver and shipped with the tasks."""
    with open(path, "rb") as file:
        return file.read()


@functools.lru_cache(maxsize=4)
def load_tokenizer(spec: str):
    os.environ.setdefault("RAYON_NUM_THREADS", "2")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    from tokenizers import Tokenizer
    return Tokenizer.from_str(spec)


def unused_name(columns: Iterable[str], name: str) -> str:
    """``name`` or the first longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


# Caches that live as long as a worker.
_CACHES: list = []


def worker_cache(build: Callable):
    """``lru_cache`` of two values that stay between the tasks of a worker, until ``lean`` runs there."""
    found = functools.lru_cache(maxsize=2)(build)
    _CACHES.append(found)
    return found


def forget() -> None:
    """Empties every ``worker_cache`` of this process."""
    held = [cache for cache in _CACHES if cache.cache_info().currsize]
    for cache in held:
        cache.cache_clear()
    if held:
        give_back()


def give_back() -> None:
    """Freed memory of this process returns to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def frugal(run: Callable) -> Callable:
    """``run`` as a function of ``mapInArrow``: what a task has freed is given back at its end.

    Workers outlive their tasks and serve every step of a job in turn, so what they hold adds to the executor's memory in all later steps.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


def lean(run: Callable) -> Callable:
    """``frugal`` for steps that use no ``worker_cache``: what earlier steps cached in this worker goes first."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from frugal(run)(batches)
    return task


class WordCache:
    """Value of each distinct word; unknown words are evaluated once a slice.

    When it is full it keeps what it has, and the rarer words are evaluated again in each slice.
    """

    def __init__(self, evaluate: Callable[[list[bytes]], Iterable], limit: int = CACHE_WORDS):
        self.evaluate, self.limit, self.known = evaluate, limit, {}

    def lookup(self, words: Iterable[bytes]) -> Callable[[bytes], object]:
        """A getter that knows all of ``words``."""
        known = self.known
        fresh = list(set(words).difference(known))
        if not fresh:
            return known.__getitem__
        values = dict(zip(fresh, self.evaluate(fresh)))
        if len(known) + len(values) <= self.limit:
            known.update(values)
            return known.__getitem__
        return lambda word: known[word] if word in known else values[word]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose texts have about ``most`` bytes; a longer text is a run of its own."""
    import pyarrow.compute as pc
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        first = total = 0
        for i, length in enumerate(lengths):
            if total and total + length > most:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += length
        if first < batch.num_rows:
            yield batch.slice(first)


def raw_texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
