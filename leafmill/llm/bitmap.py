"""A bitmap of fixed size over 64-bit hashes: what it does not hold was never put in.

The bits are set by a grouped `bit_or` in Spark, so at most 2 ** (BITS - 6) rows of 16 bytes reach the driver however many
hashes there are; more hashes only let more strangers pass. Each hash sets and tests one bit for each of some places in it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26
PROBES = (0, 19, 38)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits of h."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def of(hashes: DataFrame, probes: tuple[int, ...] = PROBES) -> np.ndarray:
    """The bitmap of a DataFrame's column `h` of longs, as unsigned 64-bit words."""
    mask = (1 << BITS) - 1
    cells = F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit(mask).cast("long")) for s in probes])
    each = hashes.select(F.explode(cells).alias("cell"))
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    words = each.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def holds(bits: np.ndarray, h: np.ndarray, probes: tuple[int, ...] = PROBES) -> np.ndarray:
    """For each of the unsigned hashes, if the bitmap may hold it."""
    found = None
    for s in probes:
        here = h if found is None else h[found]
        cell = here >> np.uint64(s) & np.uint64((1 << BITS) - 1)
        ok = (bits[cell >> np.uint64(6)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)
        found = np.nonzero(ok)[0] if found is None else found[ok]
    out = np.zeros(len(h), dtype=bool)
    out[found] = True
    return out
