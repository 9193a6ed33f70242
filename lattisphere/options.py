"""Options of the identifier operators, checked once."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IdOptions:
    """How identifiers are made.

    depth of a site's environment = diameter_factor * diameter of its component + additional_depth; `depth` sets the
    factor to 0 and the extra depth to its value. `hash_bits` is the length of the final digest.
    """

    diameter_factor: int = 2
    additional_depth: int = 1
    topology_only: bool = False
    wyckoff: bool = False
    loop: bool = False
    digest_size: int = 8
    prepend_composition: bool = True
    prepend_dimensionality: bool = True
    reduce: bool = False
    symmetry_tol: float = 0.1
    rank_k: int = 3
    cutoff: float = 6.0
    depth: int | None = None
    digest: str = "blake2b"

    def __post_init__(self):
        if self.wyckoff and self.loop:
            raise ValueError("wyckoff and loop labels exclude each other")
        if self.loop and self.topology_only:
            raise ValueError("loop labels need species, topology_only drops them")
        if self.digest not in ("blake2b", "md5"):
            raise ValueError("digest is blake2b or md5")
        if not 1 <= self.digest_size <= 64:
            raise ValueError("digest_size is between 1 and 64 bytes")
        if self.depth is not None:
            object.__setattr__(self, "diameter_factor", 0)
            object.__setattr__(self, "additional_depth", self.depth)
