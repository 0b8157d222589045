"""Sizes and limits of a build."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Bytes of memory per element of a chunk, the default chunk, and the largest: fixed values of the model.
BYTES_PER_ELEMENT, DEFAULT_CHUNK, MAX_CHUNK = 15, 1 << 24, (1 << 31) - 1

_SIZE = re.compile(r"(\d+)([KMGT]?)B?", re.IGNORECASE)


def parse_size(text: str) -> int:
    """Bytes of "8G", "512M", "2048K", "1TB" or a plain number; units are powers of 1024."""
    m = _SIZE.fullmatch(text.strip())
    if not m or not int(m[1]):
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) << 10 * " KMGT".index(m[2].upper() or " ")


def parse_count(text: str, most: int = MAX_CHUNK) -> int:
    """A whole number from 1 to most."""
    if not text.strip().isascii() or not text.strip().isdigit() or not 1 <= int(text) <= most:
        raise ValueError(f"not a number from 1 to {most}: {text!r}")
    return int(text)


@dataclass(frozen=True)
class Config:
    """memory: a budget that sets the chunk unless that is given. k: bytes of the first ranking, chosen from the chunk
    unless given. max_byte: 253 refuses texts with larger bytes. local_bytes: texts up to so many bytes are sorted where
    they are; longer ones by prefix doubling over the cluster. preaggregate: refine by counts of rank pairs."""

    memory: int | None = None
    chunk: int | None = None
    k: int | None = None
    max_byte: int | None = None
    local_bytes: int = 1 << 20
    preaggregate: bool = False

    @property
    def chunk_size(self) -> int:
        chunk = self.chunk or (self.memory // BYTES_PER_ELEMENT if self.memory else DEFAULT_CHUNK)
        if chunk < 1:
            raise ValueError("the memory budget is too small for any chunk")
        return min(chunk, MAX_CHUNK)

    @property
    def memory_budget(self) -> int:
        return BYTES_PER_ELEMENT * self.chunk_size if self.chunk or not self.memory else self.memory


def choose_k(alphabet: int, chunk: int) -> int:
    """The largest k of at least 1 for which (alphabet + 1) ** k buckets are within chunk; 1 for an empty alphabet."""
    k, base = 1, alphabet + 1
    while base > 1 and base ** (k + 1) <= chunk:
        k += 1
    return k
