"""The same queries as SQL for DuckDB, put together from common table expressions."""

from __future__ import annotations

SITES = """sites AS (
  SELECT l_orderkey AS structure_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::INTEGER AS site_i,
         l_returnflag || l_linestatus AS species, 10 * (l_quantity / 51) AS x, 10 * (l_discount * 9) AS y, 10 * (l_tax * 11) AS z
  FROM lineitem)"""

IMAGES = "img AS (SELECT unnest([-1, 0, 1])::INTEGER AS i)"


def pairs(r: float) -> str:
    return f"""{IMAGES}, pairs AS (
  SELECT * FROM (
    SELECT s.structure_id, s.site_i AS u, t.site_i AS v, a.i AS ia, b.i AS ib, c.i AS ic, s.species AS su, t.species AS sv,
           sqrt((t.x + 10 * a.i - s.x) * (t.x + 10 * a.i - s.x) + (t.y + 10 * b.i - s.y) * (t.y + 10 * b.i - s.y) + (t.z + 10 * c.i - s.z) * (t.z + 10 * c.i - s.z)) AS dist
    FROM sites s JOIN sites t USING (structure_id), img a, img b, img c) WHERE dist >= 1e-8 AND dist < {r})"""


BONDS = "bonds AS (SELECT structure_id, u, v, ia, ib, ic, m / dist AS weight FROM (SELECT *, min(dist) OVER (PARTITION BY structure_id, u) AS m FROM pairs) WHERE dist < (1 + 0.1) * m)"
SYM = """sym AS (
  SELECT * FROM (SELECT structure_id, u, v, ia, ib, ic FROM bonds UNION SELECT structure_id, v, u, -ia, -ib, -ic FROM bonds)
  WHERE u <> v OR ia <> 0 OR ib <> 0 OR ic <> 0)"""
GRAPH = f"{SITES}, {pairs(8.4)}, {BONDS}, {SYM}"

HOPS = """near AS (SELECT DISTINCT structure_id, u, v FROM sym WHERE u <> v),
hop AS (
  SELECT structure_id, site_i AS s, site_i AS t, 0 AS d FROM sites
  UNION SELECT h.structure_id, h.s, e.v, h.d + 1 FROM hop h JOIN near e ON h.structure_id = e.structure_id AND h.t = e.u WHERE h.d < 24),
far AS (SELECT structure_id, s, t, min(d) AS d FROM hop GROUP BY ALL),
comps AS (SELECT structure_id, s AS site_i, min(t)::INTEGER AS comp, max(d) AS reach FROM far GROUP BY ALL),
wide AS (SELECT structure_id, comp, max(reach)::INTEGER AS diameter FROM comps GROUP BY ALL)"""

DIMENSION = """up AS (
  SELECT e.structure_id, e.v, arg_min({'u': e.u, 'ia': e.ia, 'ib': e.ib, 'ic': e.ic}, (e.u, e.ia, e.ib, e.ic)) AS p
  FROM sym e JOIN comps c ON e.structure_id = c.structure_id AND e.v = c.site_i
  JOIN far a ON a.structure_id = e.structure_id AND a.s = c.comp AND a.t = e.u JOIN far b ON b.structure_id = e.structure_id AND b.s = c.comp AND b.t = e.v
  WHERE b.d = a.d + 1 GROUP BY e.structure_id, e.v),
pot AS (
  SELECT structure_id, site_i, 0 AS a, 0 AS b, 0 AS c FROM comps WHERE site_i = comp
  UNION ALL SELECT up.structure_id, up.v, pot.a + p.ia, pot.b + p.ib, pot.c + p.ic FROM pot JOIN up ON pot.structure_id = up.structure_id AND p.u = pot.site_i),
vec AS (
  SELECT DISTINCT e.structure_id, c.comp, p.a + e.ia - q.a AS a, p.b + e.ib - q.b AS b, p.c + e.ic - q.c AS c
  FROM sym e JOIN pot p ON e.structure_id = p.structure_id AND e.u = p.site_i JOIN pot q ON e.structure_id = q.structure_id AND e.v = q.site_i
  JOIN comps c ON e.structure_id = c.structure_id AND e.u = c.site_i),
nz AS (SELECT * FROM vec WHERE a <> 0 OR b <> 0 OR c <> 0),
plane AS (
  SELECT x.structure_id, x.comp, x.b * y.c - x.c * y.b AS a, x.c * y.a - x.a * y.c AS b, x.a * y.b - x.b * y.a AS c
  FROM nz x JOIN nz y USING (structure_id, comp)),
flat AS (SELECT DISTINCT * FROM plane WHERE a <> 0 OR b <> 0 OR c <> 0),
dims AS (
  SELECT structure_id, 0 AS d FROM sites UNION ALL SELECT structure_id, 1 FROM nz UNION ALL SELECT structure_id, 2 FROM flat
  UNION ALL SELECT f.structure_id, 3 FROM flat f JOIN nz z USING (structure_id, comp) WHERE f.a * z.a + f.b * z.b + f.c * z.c <> 0),
dim AS (SELECT structure_id, max(d)::INTEGER AS dim FROM dims GROUP BY ALL)"""


def shells(depth: int) -> str:
    out = ["s0 AS (SELECT structure_id, site_i AS center, site_i AS site, 0 AS ia, 0 AS ib, 0 AS ic FROM sites)"]
    for k in range(1, depth + 1):
        minus = "".join(f" EXCEPT SELECT * FROM s{j}" for j in (k - 1, k - 2) if j >= 0)
        step = f"SELECT s.structure_id, s.center, e.v AS site, s.ia + e.ia AS ia, s.ib + e.ib AS ib, s.ic + e.ic AS ic FROM s{k - 1} s JOIN sym e ON s.structure_id = e.structure_id AND s.site = e.u"
        out.append(f"s{k} AS (SELECT DISTINCT * FROM ({step}){minus})")
    return ", ".join(out)


def environments(depth: int, label: str = "species") -> str:
    """lab, cnt, cum, lv, levels (l1..), cs (md5-hashed) and plain."""
    union = " UNION ALL ".join(f"SELECT *, {k} AS level FROM s{k}" for k in range(1, depth + 1))
    joins = "".join(f" LEFT JOIN lv v{k} ON v{k}.structure_id = l.structure_id AND v{k}.center = l.site_i AND v{k}.level = {k}" for k in range(1, depth + 1))
    cols = ", ".join(f"coalesce(v{k}.s, '') AS l{k}" for k in range(1, depth + 1))
    fold = "''"
    for k in range(1, depth + 1):
        fold = f"md5({fold} || '-' || l{k})"
    plain = " || '-' || ".join(f"l{k}" for k in range(1, depth + 1))
    return f"""{shells(depth)}, lab AS (SELECT structure_id, site_i, {label} AS label FROM sites),
cnt AS (SELECT q.structure_id, q.center, q.level, l.label, count(*) AS n FROM ({union}) q JOIN lab l ON q.structure_id = l.structure_id AND q.site = l.site_i GROUP BY ALL),
grid AS (SELECT DISTINCT structure_id, center, label, k.level FROM cnt, (SELECT unnest(range(1, {depth + 1})) AS level) k),
cum AS (SELECT g.structure_id, g.center, g.level, g.label, sum(c.n)::BIGINT AS n FROM grid g JOIN cnt c ON g.structure_id = c.structure_id AND g.center = c.center AND g.label = c.label AND c.level <= g.level GROUP BY ALL),
lv AS (SELECT structure_id, center, level, string_agg(label || n::VARCHAR, '' ORDER BY label) AS s FROM cum GROUP BY ALL),
levels AS (SELECT l.structure_id, l.site_i, l.label, {cols} FROM lab l{joins}),
cs AS (SELECT structure_id, site_i, label, label || '-' || {fold} AS cs, label || '-' || {plain} AS plain FROM levels)"""


DIGESTS = """comp_ids AS (SELECT cs.structure_id, c.comp, md5(string_agg(cs.cs, '-' ORDER BY cs.cs)) AS digest FROM cs JOIN comps c ON cs.structure_id = c.structure_id AND cs.site_i = c.site_i GROUP BY ALL),
ids AS (SELECT structure_id, md5(string_agg(digest, ':' ORDER BY digest)) AS graph_id FROM comp_ids GROUP BY ALL)"""


def with_ids(depth: int, label: str = "species") -> str:
    return f"WITH RECURSIVE {GRAPH}, {HOPS}, {environments(depth, label)}, {DIGESTS}"


FORMULA = """counts AS (SELECT structure_id, species, count(*) AS n FROM sites GROUP BY ALL),
divisor AS (SELECT structure_id, list_reduce(list(n), lambda x, y: gcd(x, y)) AS g FROM counts GROUP BY ALL),
formula AS (SELECT c.structure_id, string_agg(species || CASE WHEN n // g = 1 THEN '' ELSE (n // g)::BIGINT::VARCHAR END, '' ORDER BY species) AS formula FROM counts c JOIN divisor d USING (structure_id) GROUP BY ALL)"""

CLUSTERS = """near6 AS (SELECT structure_id, u, dist FROM pairs WHERE dist < 6.0 UNION ALL SELECT structure_id, site_i, 0.0 FROM sites),
gaps AS (SELECT *, CASE WHEN dist - lag(dist) OVER (PARTITION BY structure_id, u ORDER BY dist) > 0.5 THEN 1 ELSE 0 END AS new FROM near6),
runs AS (SELECT *, sum(new) OVER (PARTITION BY structure_id, u ORDER BY dist ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
bounds AS (SELECT structure_id, u, run, max(dist) AS bound FROM runs GROUP BY ALL HAVING count(*) >= 2),
clusters AS (SELECT structure_id, u, (row_number() OVER (PARTITION BY structure_id, u ORDER BY run) - 1)::INTEGER AS k, bound FROM bounds)"""


REDUCED = """m AS (SELECT cs.structure_id, c.comp, cs.cs, count(*) AS n FROM cs JOIN comps c ON cs.structure_id = c.structure_id AND cs.site_i = c.site_i GROUP BY ALL),
g AS (SELECT structure_id, comp, list_reduce(list(n), lambda x, y: gcd(x, y)) AS g FROM m GROUP BY ALL), q AS (SELECT structure_id, min(g) AS q FROM g GROUP BY ALL),
rep AS (SELECT m.structure_id, m.comp, m.cs, unnest(range(n // q.q)) AS i FROM m JOIN q USING (structure_id)),
d AS (SELECT structure_id, comp, md5(string_agg(cs, '-' ORDER BY cs)) AS digest FROM rep GROUP BY ALL)"""

COINCIDENT = """
  SELECT DISTINCT t.structure_id, t.site_i FROM sites s JOIN sites t ON s.structure_id = t.structure_id AND s.site_i < t.site_i
  WHERE sqrt(pow((t.x - s.x) - 10 * round((t.x - s.x) / 10), 2) + pow((t.y - s.y) - 10 * round((t.y - s.y) / 10), 2) + pow((t.z - s.z) - 10 * round((t.z - s.z) / 10), 2)) <= 0.01"""


def brunner(gap: str) -> str:
    return f"""WITH {SITES}, {pairs(8.0)}, g AS (
  SELECT *, {gap} AS gap, min(dist) OVER (PARTITION BY structure_id, u) AS d0 FROM (
    SELECT *, lead(dist) OVER (PARTITION BY structure_id, u ORDER BY dist, v, ia, ib, ic) AS nxt FROM pairs)),
c AS (SELECT *, count(gap) OVER w AS n, first_value(dist) OVER (PARTITION BY structure_id, u ORDER BY gap DESC NULLS LAST, dist, v, ia, ib, ic) AS d_max FROM g WINDOW w AS (PARTITION BY structure_id, u))
SELECT structure_id, u, v, ia, ib, ic, round(d0 / dist, 6) AS weight FROM c WHERE n > 0 AND dist < d_max + 1e-4"""


EDGE = "structure_id, u, v, ia, ib, ic"
CUTOFFS = "(VALUES ('AF', 'NO', 4.0), ('NO', 'AF', 4.0), ('RF', 'RF', 5.0)) t(a, b, r)"


def queries() -> dict[str, str]:
    ids1 = with_ids(1)
    ids3 = with_ids(3)
    test, train = "structure_id % 2 = 1", "structure_id % 2 = 0"
    econ_rounds = 64
    return {
        "crystal_sites": f"WITH {SITES} SELECT structure_id, site_i, species, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM sites",
        "periodic_pairs": f"WITH {SITES}, {pairs(4.0)} SELECT {EDGE}, round(dist, 6) AS dist FROM pairs",
        "periodic_pairs_r84": f"WITH {SITES}, {pairs(8.4)} SELECT structure_id, u, count(*) AS n, round(min(dist), 6) AS nearest, sum(ia + 3 * ib + 9 * ic)::BIGINT AS image_sum FROM pairs GROUP BY ALL",
        "periodic_pairs_binned": f"WITH {SITES}, {pairs(3.0)} SELECT {EDGE}, round(dist, 6) AS dist FROM pairs",
        "nn_min_distance": f"WITH {SITES}, {pairs(8.4)}, {BONDS} SELECT {EDGE}, round(weight, 6) AS weight FROM bonds",
        "nn_all_sites": f"WITH {SITES}, {pairs(10.0)} SELECT {EDGE}, round(dist, 6) AS weight FROM pairs",
        "nn_okeeffe": f"""WITH {SITES}, {pairs(8.4)}, rel AS (
  SELECT *, dist / (2.0 + 0.1 * length(su || sv) + CASE WHEN su = sv THEN 0.5 ELSE 0 END) AS rel FROM pairs)
SELECT {EDGE}, round(m / rel, 6) AS weight FROM (SELECT *, min(rel) OVER (PARTITION BY structure_id, u) AS m FROM rel) WHERE rel < (1 + 0.1) * m""",
        "nn_cutoff_dict": f"WITH {SITES}, {pairs(5.0)} SELECT {EDGE}, round(dist, 6) AS weight FROM pairs JOIN {CUTOFFS} ON su = a AND sv = b WHERE dist < r",
        "nn_brunner_reciprocal": brunner("1 / dist - 1 / nxt"),
        "nn_brunner_relative": brunner("nxt / dist"),
        "nn_brunner_real": brunner("nxt - dist"),
        "nn_econ": f"""WITH RECURSIVE {SITES}, {pairs(10.0)}, fs AS (SELECT structure_id, u, list(dist ORDER BY dist) AS fs FROM pairs GROUP BY ALL),
it AS (
  SELECT structure_id, u, fs, list_min(fs) AS m, false AS done, 0 AS k FROM fs
  UNION ALL
  SELECT structure_id, u, fs, new, abs(new - m) <= 1e-4, k + 1 FROM (
    SELECT *, list_sum([f * exp(1 - pow(f / m, 6)) FOR f IN fs]) / list_sum([exp(1 - pow(f / m, 6)) FOR f IN fs]) AS new FROM it WHERE NOT done AND k < {econ_rounds})),
mean AS (SELECT structure_id, u, arg_max(m, k) AS m FROM it GROUP BY ALL)
SELECT {EDGE}, round(w, 6) AS weight FROM (SELECT p.*, exp(1 - pow(dist / m, 6)) AS w FROM pairs p JOIN mean USING (structure_id, u)) WHERE w > 0.2""",
        "distance_clusters": f"WITH {SITES}, {pairs(6.0)}, {CLUSTERS} SELECT structure_id, u, k, round(bound, 6) AS bound FROM clusters",
        "nn_distance_cluster": f"""WITH {SITES}, {pairs(6.0)}, {CLUSTERS}, lim AS (SELECT *, round(bound, 3) AS high, lag(round(bound, 3)) OVER (PARTITION BY structure_id, u ORDER BY k) AS low FROM clusters)
SELECT p.structure_id, p.u, l.k, p.v, p.ia, p.ib, p.ic, round(p.dist, 3) AS weight FROM pairs p JOIN lim l USING (structure_id, u) WHERE round(p.dist, 3) <= high AND (low IS NULL OR round(p.dist, 3) > low)""",
        "graph_edges_symmetric": f"WITH {GRAPH} SELECT {EDGE} FROM sym",
        "graph_one_direction": f"WITH {GRAPH} SELECT {EDGE} FROM sym WHERE u <= v",
        "graph_break_site": f"WITH {GRAPH} SELECT {EDGE} FROM sym WHERE u <> 0 AND v <> 0",
        "graph_break_edges": f"WITH {GRAPH}, gone AS (SELECT * FROM sym WHERE ia <> 0) SELECT {EDGE} FROM (SELECT * FROM sym EXCEPT SELECT * FROM gone)",
        "graph_cluster_edges": f"""WITH {GRAPH}, {CLUSTERS}, c0 AS (SELECT p.* FROM pairs p JOIN clusters c USING (structure_id, u) WHERE c.k = 0 AND p.u = 0 AND p.dist < 6.0 AND round(p.dist, 3) <= round(c.bound, 3)),
own AS (SELECT {EDGE} FROM c0 UNION SELECT structure_id, v, u, -ia, -ib, -ic FROM c0)
SELECT {EDGE} FROM sym WHERE u <> 0 AND v <> 0 UNION SELECT * FROM own""",
        "graph_neighbours_of": f"WITH {GRAPH} SELECT DISTINCT structure_id, u, v, (ia + 1)::INTEGER AS ia, ib, (ic - 1)::INTEGER AS ic FROM sym WHERE u = 0",
        "graph_degree": f"WITH {GRAPH}, d AS (SELECT structure_id, u, count(*) AS n FROM sym GROUP BY ALL) SELECT s.structure_id, s.site_i, coalesce(d.n, 0) AS degree FROM sites s LEFT JOIN d ON s.structure_id = d.structure_id AND s.site_i = d.u",
        "graph_components": f"WITH RECURSIVE {GRAPH}, {HOPS} SELECT structure_id, site_i, comp FROM comps",
        "graph_components_by_joins": f"WITH RECURSIVE {GRAPH}, {HOPS} SELECT structure_id, site_i, comp FROM comps",
        "graph_diameter": f"WITH RECURSIVE {GRAPH}, {HOPS} SELECT structure_id, comp, diameter FROM wide",
        "graph_dimensionality": f"WITH RECURSIVE {GRAPH}, {HOPS}, {DIMENSION} SELECT structure_id, dim FROM dim",
        "labels_element": f"WITH {SITES} SELECT structure_id, site_i, species AS label FROM sites",
        "labels_topology": f"WITH {SITES} SELECT structure_id, site_i, 'H' AS label FROM sites",
        "labels_wyckoff_given": f"WITH {SITES} SELECT structure_id, site_i, CASE WHEN site_i % 3 = 2 THEN species ELSE species || '_' || chr((97 + site_i % 4)::INTEGER) || '_225' END AS label FROM sites",
        "shell_counts_depth3": f"WITH {GRAPH}, {environments(3)} SELECT structure_id, center, level::INTEGER AS level, label, n FROM cnt",
        "shell_counts_cumulative": f"WITH {GRAPH}, {environments(3)} SELECT structure_id, center, level::INTEGER AS level, label, sum(n) OVER (PARTITION BY structure_id, center, label ORDER BY level)::BIGINT AS n FROM cnt",
        "level_strings_depth3": f"WITH {GRAPH}, {environments(3)} SELECT structure_id, site_i, label, l1 || '|' || l2 || '|' || l3 AS levels FROM levels",
        "cs_plain_depth3": f"WITH {GRAPH}, {environments(3)} SELECT structure_id, site_i, plain AS cs FROM cs",
        "cs_topology_depth2": f"WITH {GRAPH}, {environments(2, chr(39) + 'H' + chr(39))} SELECT structure_id, site_i, plain AS cs FROM cs",
        "site_ids_md5": f"WITH {GRAPH}, {environments(3)} SELECT structure_id, site_i, label || '_' || cs AS site_id FROM cs",
        "site_ids_kernel_md5": f"WITH {GRAPH}, {environments(3)} SELECT structure_id, site_i, label || '_' || cs AS site_id FROM cs",
        "component_ids_kernel_md5": f"{ids3}, own AS (SELECT structure_id, comp, string_agg(site_i::VARCHAR, ',' ORDER BY site_i) AS sites FROM comps GROUP BY ALL) SELECT structure_id, sites, md5(digest) AS component_id FROM comp_ids JOIN own USING (structure_id, comp)",
        "graph_ids_kernel_md5": f"{ids3}, {DIMENSION}, {FORMULA} SELECT structure_id, formula || '-' || dim::VARCHAR || 'D-' || graph_id AS graph_id FROM ids JOIN dim USING (structure_id) JOIN formula USING (structure_id)",
        "maker_ids_depth2_md5": f"{with_ids(2)}, {FORMULA} SELECT structure_id, formula || '-' || graph_id AS graph_id FROM ids JOIN formula USING (structure_id)",
        "maker_ids_reduced_md5": f"{with_ids(2)}, {FORMULA}, {REDUCED}, r AS (SELECT structure_id, md5(string_agg(digest, ':' ORDER BY digest)) AS graph_id FROM d GROUP BY ALL) SELECT structure_id, formula || '-' || graph_id AS graph_id FROM r JOIN formula USING (structure_id)",
        "merged_ids_kernel_md5": f"{ids1} SELECT structure_id % 100 AS merge_key, md5(string_agg(digest, ':' ORDER BY digest)) AS graph_id FROM comp_ids GROUP BY ALL",
        "clustering_ids_md5": f"""WITH {SITES}, {pairs(6.0)}, {CLUSTERS}, lim AS (SELECT *, round(bound, 3) AS high, lag(round(bound, 3)) OVER (PARTITION BY structure_id, u ORDER BY k) AS low FROM clusters),
c AS (SELECT p.structure_id, p.u, l.k, p.v, p.ia, p.ib, p.ic FROM pairs p JOIN lim l USING (structure_id, u) WHERE l.k < 3 AND round(p.dist, 3) <= high AND (low IS NULL OR round(p.dist, 3) > low)),
own AS (SELECT * FROM c UNION SELECT structure_id, u, k, v, -ia, -ib, -ic FROM c WHERE u = v),
met AS (SELECT o.structure_id, o.u, o.k, s.species, count(*) AS n FROM own o JOIN sites s ON o.structure_id = s.structure_id AND o.v = s.site_i GROUP BY ALL),
level AS (SELECT structure_id, u, k, string_agg(species || n::VARCHAR, '' ORDER BY species) AS l FROM met GROUP BY ALL),
parts AS (SELECT s.structure_id, r.k, md5(s.species || '-' || coalesce(l.l, '')) AS p FROM sites s CROSS JOIN (SELECT unnest(range(3)) AS k) r LEFT JOIN level l ON l.structure_id = s.structure_id AND l.u = s.site_i AND l.k = r.k),
ranks AS (SELECT structure_id, k, md5(string_agg(p, ':' ORDER BY p)) AS d FROM parts GROUP BY ALL)
SELECT structure_id, md5(string_agg(d, '' ORDER BY k)) AS graph_id FROM ranks GROUP BY ALL""",
        "group_split": f"{ids1} SELECT structure_id, graph_id, (('0x' || substr(md5(graph_id), 1, 7))::BIGINT % 5)::INTEGER AS part FROM ids",
        "voronoi_volumes": f"""WITH {SITES}, d AS ({COINCIDENT})
SELECT structure_id, 1000.0::DOUBLE AS volume, round(4 * pi(), 6) AS angle, count(*) AS n_sites FROM sites WHERE (structure_id, site_i) NOT IN (SELECT structure_id, site_i FROM d) GROUP BY structure_id""",
        "component_ids_md5": f"{ids3} SELECT structure_id, comp, digest FROM comp_ids",
        "graph_ids_md5_depth3": f"{ids3} SELECT structure_id, graph_id FROM ids",
        "graph_ids_topology": f"{with_ids(2, chr(39) + 'H' + chr(39))} SELECT structure_id, graph_id FROM ids",
        "graph_ids_md5_wyckoff": f"""{with_ids(2, "CASE WHEN site_i % 3 = 2 THEN species ELSE species || '_' || chr((97 + site_i % 4)::INTEGER) || '_225' END")} SELECT structure_id, graph_id FROM ids""",
        "formulas": f"WITH {SITES}, {FORMULA} SELECT structure_id, formula FROM formula",
        "ids_prefixed": f"{ids1}, {DIMENSION}, {FORMULA} SELECT structure_id, formula || '-' || dim::VARCHAR || 'D-' || graph_id AS graph_id FROM ids JOIN dim USING (structure_id) JOIN formula USING (structure_id)",
        "merged_ids_by_customer": f"{ids1} SELECT o_custkey AS merge_key, md5(string_agg(digest, ':' ORDER BY digest)) AS graph_id FROM comp_ids JOIN orders ON structure_id = o_orderkey GROUP BY ALL",
        "reduced_ids": f"""{ids1}, {REDUCED}
SELECT structure_id, md5(string_agg(digest, ':' ORDER BY digest)) AS graph_id FROM d GROUP BY ALL""",
        "unique_structures": f"{ids1} SELECT min(structure_id) AS structure_id, graph_id FROM ids GROUP BY ALL",
        "same_structure_pairs": f"{ids1}, f AS (SELECT graph_id, min(structure_id) AS a FROM ids GROUP BY ALL) SELECT a, structure_id AS b FROM ids JOIN f USING (graph_id) WHERE a <> structure_id",
        "are_same": f"{ids1}, o AS (SELECT structure_id - structure_id % 2 AS k, min(graph_id) AS a, max(graph_id) AS b, count(*) AS n FROM ids GROUP BY ALL) SELECT k AS structure_id, a = b AS same FROM o WHERE n = 2",
        "leakage_semi": f"{ids1} SELECT structure_id, graph_id FROM ids WHERE {test} AND graph_id IN (SELECT graph_id FROM ids WHERE {train})",
        "leakage_anti": f"{ids1} SELECT structure_id, graph_id FROM ids WHERE {test} AND graph_id NOT IN (SELECT graph_id FROM ids WHERE {train})",
        "leakage_counts": f"{ids1}, s AS (SELECT DISTINCT graph_id FROM ids WHERE {train}) SELECT count(*) AS n_test, count(s.graph_id) AS n_leaked, count(*) - count(s.graph_id) AS n_novel FROM ids LEFT JOIN s USING (graph_id) WHERE {test}",
        "group_by_id": f"{ids1} SELECT graph_id, count(*) AS n, min(structure_id) AS first, string_agg(structure_id::VARCHAR, ',' ORDER BY structure_id) AS members FROM ids GROUP BY ALL",
        "isostructural_groups": f"{ids1} SELECT graph_id, count(*) AS n, min(structure_id) AS first, string_agg(structure_id::VARCHAR, ',' ORDER BY structure_id) AS members FROM ids GROUP BY ALL HAVING count(*) > 1",
        "dedup_with_first": f"{ids1} SELECT structure_id, graph_id, min(structure_id) OVER (PARTITION BY graph_id) AS first, structure_id = min(structure_id) OVER (PARTITION BY graph_id) AS is_first FROM ids",
        "site_histogram": f"WITH {GRAPH}, {environments(1)} SELECT structure_id, label || '_' || cs AS site_id, count(*) AS n FROM cs GROUP BY ALL",
        "id_lookup": f"{ids1}, q AS (SELECT DISTINCT graph_id FROM ids) SELECT structure_id, graph_id FROM ids JOIN q USING (graph_id)",
        "formula_lookup": f"WITH {SITES}, {FORMULA} SELECT structure_id, formula FROM formula WHERE formula = 'AFNO'",
        "insert_if_absent": f"{ids1} SELECT min(structure_id) AS structure_id, graph_id FROM ids WHERE {test} AND graph_id NOT IN (SELECT graph_id FROM ids WHERE {train}) GROUP BY graph_id",
        "mae_by_split": """WITH k AS (SELECT l_quantity * 1000 AS predicted, l_extendedprice AS actual, CASE WHEN l_orderkey % 2 = 0 THEN 'train' ELSE 'test' END AS kind FROM lineitem)
SELECT kind, count(*) AS n, round(avg(abs(actual - predicted)), 4) AS mae FROM k GROUP BY ALL UNION ALL SELECT 'all', count(*), round(avg(abs(actual - predicted)), 4) FROM k""",
        "site_radii": f"WITH {SITES} SELECT structure_id, site_i, CASE species WHEN 'AF' THEN 0.5 WHEN 'NO' THEN 1.25 WHEN 'RF' THEN 0.75 WHEN 'AO' THEN 2.0 WHEN 'NF' THEN 1.0 WHEN 'RO' THEN 1.75 END::DOUBLE AS radius FROM sites",
        "ionic_radii": f"""WITH {SITES}, o AS (SELECT *, (site_i % 6) / 2.0 - 1.0 AS oxi FROM sites)
SELECT structure_id, site_i, CASE
  WHEN species = 'AF' THEN CASE oxi WHEN -1.0 THEN 1.5 WHEN -0.5 THEN 1.25 WHEN 0.0 THEN 1.0 WHEN 0.5 THEN 0.75 WHEN 1.0 THEN 0.5 ELSE 0.375 END
  WHEN species = 'NO' THEN CASE WHEN oxi = -1.0 THEN 2.0 WHEN oxi = 1.0 THEN 0.75 WHEN oxi > 0 THEN 0.75 WHEN oxi < 0 THEN 2.0 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS radius FROM o""",
        "composition": f"WITH {SITES} SELECT structure_id, species, round(count(*) / sum(count(*)) OVER (PARTITION BY structure_id), 6) AS share FROM sites GROUP BY structure_id, species",
        "boxed_molecules": f"""WITH {SITES}, e AS (SELECT structure_id, min(x) AS ax, min(y) AS ay, min(z) AS az, max(x) - min(x) + 20 AS lx FROM sites GROUP BY ALL)
SELECT structure_id, site_i, round(x - ax + 10, 6) AS x, round(y - ay + 10, 6) AS y, round(z - az + 10, 6) AS z, round(lx, 6) AS edge FROM sites JOIN e USING (structure_id)""",
        "coincident_removed": f"""WITH {SITES}, d AS ({COINCIDENT})
SELECT structure_id, site_i, species FROM sites WHERE (structure_id, site_i) NOT IN (SELECT structure_id, site_i FROM d)""",
        "ring_walks_depth4": f"""WITH RECURSIVE {GRAPH}, walk AS (
  SELECT DISTINCT structure_id, u AS start, [(u, 0, 0, 0)] AS path, 0 AS k, false AS done FROM sym
  UNION ALL SELECT w.structure_id, w.start, list_append(w.path, (e.v, w.path[-1][2] + e.ia, w.path[-1][3] + e.ib, w.path[-1][4] + e.ic)), k + 1, (e.v, w.path[-1][2] + e.ia, w.path[-1][3] + e.ib, w.path[-1][4] + e.ic) = w.path[1]
  FROM walk w JOIN sym e ON w.structure_id = e.structure_id AND w.path[-1][1] = e.u
  WHERE NOT done AND k < 4 AND (NOT list_contains(w.path, (e.v, w.path[-1][2] + e.ia, w.path[-1][3] + e.ib, w.path[-1][4] + e.ic)) OR (k > 1 AND (e.v, w.path[-1][2] + e.ia, w.path[-1][3] + e.ib, w.path[-1][4] + e.ic) = w.path[1])))
SELECT structure_id, start, k AS size, count(*) AS n FROM walk WHERE done GROUP BY ALL""",
    }
