"""Encoding by units: a text is cut where no token can cross, and each different unit is encoded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: Units kept by a worker; beyond it the memory starts anew. Longer units than LONG are encoded each time.
KEPT, LONG = 200_000, 64


class Units:
    """Ids of units as little-endian unsigned 32-bit bytes, remembered. `encode` takes a list of different units and gives their ids' bytes."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]]):
        self.encode = encode
        self.known: dict[str, bytes] = {}

    def of(self, cut: list[list[str]]) -> list[bytes]:
        """The ids of texts that are given as lists of units."""
        if len(self.known) > KEPT:
            self.known.clear()
        known = self.known
        new = list(set().union(*cut).difference(known))
        if new:
            known.update(zip(new, self.encode(new), strict=True))
        out = [b"".join(map(known.__getitem__, units)) for units in cut]
        for u in new:
            if len(u) > LONG:
                del known[u]
        return out


def divided(ids: np.ndarray, token_bytes: np.ndarray, units: list[str]) -> list[bytes]:
    """The ids of units that were encoded side by side, told apart by the bytes that each token stands for."""
    ends = np.searchsorted(np.cumsum(token_bytes[ids]), np.cumsum(np.fromiter((len(u.encode()) for u in units), np.int64, len(units)))) + 1
    data, at = ids.astype("<u4").tobytes(), 0
    out = []
    for end in (4 * ends).tolist():
        out.append(data[at:end])
        at = end
    return out


def slices(sizes: list[int], most: int = 1_000_000) -> Iterable[tuple[int, int]]:
    """Runs of rows of about `most` bytes together, so that a batch of long texts isn't worked on at once."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
