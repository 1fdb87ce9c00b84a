"""Terms: the maximal runs of ASCII letters and digits and of characters beyond ASCII, of which A-Z only are lower-cased.

In UTF-8 every byte of a character beyond ASCII is 128 or more, so a table of bytes tells terms from what parts them.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K

BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, bounds): text i has terms bounds[i]:bounds[i+1], each with its 64-bit hash and its byte offset."""
    return K.words(data, offsets, breaks=BREAKS)


def spelled(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> list[str]:
    """The lower-cased terms that start at these offsets, which ascend."""
    stops = np.union1d(np.flatnonzero(BREAKS[data]), offsets[1:])
    ends = stops[np.searchsorted(stops, starts, "right")]
    raw = K.LOWER[data].tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
