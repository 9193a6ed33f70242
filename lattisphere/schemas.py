"""Table layouts that every operator shares."""

STRUCTURES = "structure_id {id}, lattice array<array<double>>, pbc array<boolean>, n_sites int, formula string"
SITES = "structure_id {id}, site_i int, species string, x double, y double, z double, oxi double"
EDGE = ("structure_id", "u", "v", "ia", "ib", "ic")
IMAGE = ("ia", "ib", "ic")
