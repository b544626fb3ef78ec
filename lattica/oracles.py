"""DuckDB SQL with the rows of the registered queries, where SQL can say them."""

from __future__ import annotations

PX = "px AS (SELECT vec_id AS idx, CAST(vec_id % 25 AS INTEGER) AS px, CAST(vec_id // 25 AS INTEGER) AS py, CAST(embedding AS DOUBLE[]) AS emb, label FROM embeddings)"
AT = "placed AS (SELECT *, 52.0::DOUBLE + py * (-0.01)::DOUBLE AS lat, (-1.0)::DOUBLE + px * 0.01::DOUBLE AS lon FROM px)"
DIMS = "dims AS (SELECT idx, px, py, label, unnest(emb) AS value, generate_subscripts(emb, 1) - 1 AS dim FROM px)"
BOUNDS = "bounds AS (SELECT dim, min(value) AS low, max(value) AS high FROM dims GROUP BY dim)"
PROBES = "probes(probe, lat, lon) AS (VALUES (1, 52.0::DOUBLE, -1.0::DOUBLE), (2, 52.0, -0.99), (3, 51.985, -0.955), (4, 52.005, -1.005), (5, 10.0, 10.0), (6, 51.93, -0.74))"
CHANGED = """second AS (SELECT p.idx, p.px, p.py, p.emb AS e1, n.emb AS nx, (p.idx % 4) * 0.5::DOUBLE AS w FROM px p JOIN px n ON n.idx = (p.idx + 1) % (SELECT count(*) FROM px)),
year2 AS (SELECT idx, px, py, e1, list_transform(range(1, len(e1) + 1), lambda i: e1[i] + w * (nx[i] - e1[i])) AS emb FROM second),
changed AS (SELECT idx, px, py, list_distance(e1, emb) AS distance FROM year2)"""
SEEDS = "seeds AS (SELECT idx AS sid, emb AS q FROM px WHERE idx IN (0, 7, 42))"
SHAPES = """corners(polygon, k, x, y) AS (VALUES (1, 0, 2.0::DOUBLE, 2.0::DOUBLE), (1, 1, 22, 2), (1, 2, 22, 8), (1, 3, 12, 8), (1, 4, 12, 16), (1, 5, 2, 16), (2, 0, 14, 9), (2, 1, 24, 9), (2, 2, 19, 19)),
sides AS (SELECT polygon, x AS x1, y AS y1, coalesce(lag(x) OVER w, last_value(x) OVER w) AS x2, coalesce(lag(y) OVER w, last_value(y) OVER w) AS y2 FROM corners WINDOW w AS (PARTITION BY polygon ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
inside AS (SELECT polygon, idx FROM px, sides WHERE (y1 > py + 0.5) <> (y2 > py + 0.5) AND px + 0.5 < (x2 - x1) * (py + 0.5 - y1) / (y2 - y1) + x1 GROUP BY polygon, idx HAVING count(*) % 2 = 1)"""
CENTROIDS = f"{DIMS}, means AS (SELECT label, dim, avg(value) AS value FROM dims GROUP BY label, dim), centroids AS (SELECT label AS cluster, list(value ORDER BY dim) AS centre FROM means GROUP BY label)"
ASSIGNED = f"{CENTROIDS}, far AS (SELECT idx, cluster, pow(list_distance(emb, centre), 2) AS d2 FROM px, centroids), assigned AS (SELECT idx, d2, cluster FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d2, cluster) AS r FROM far) WHERE r = 1)"
HEIGHT = "(SELECT max(py) + 1 FROM px)"
TILED = f"""tiled AS (SELECT *, CAST(CASE WHEN py >= {HEIGHT} - 8 THEN CAST(ceil({HEIGHT} / 8.0) AS INTEGER) - 1 ELSE py // 8 END * 4 + CASE WHEN px >= 17 THEN 3 ELSE px // 8 END AS INTEGER) AS tile,
  CAST(idx % 7 AS INTEGER) AS i1, CAST(idx % 3 AS INTEGER) AS i2 FROM px)"""

STARS = """star AS (SELECT idx AS polygon, k, px + 0.63::DOUBLE + (1.5 + (idx % 5) * 0.75::DOUBLE) * dx AS x, py + 0.57::DOUBLE + (1.5 + (idx % 5) * 0.75::DOUBLE) * dy AS y
  FROM px, (VALUES (0, 0.0::DOUBLE, -1.0::DOUBLE), (1, 0.6, 0.8), (2, -0.95, -0.3), (3, 0.95, -0.3), (4, -0.6, 0.8)) c(k, dx, dy)),
star_sides AS (SELECT a.polygon, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM star a JOIN star b ON a.polygon = b.polygon AND b.k = (a.k + 4) % 5),
in_star AS (SELECT polygon, idx FROM px, star_sides WHERE (y1 > py + 0.5) <> (y2 > py + 0.5) AND px + 0.5 < (x2 - x1) * (py + 0.5 - y1) / (y2 - y1) + x1 GROUP BY polygon, idx HAVING count(*) % 2 = 1)"""

LEVEL_ROWS = f"""lv AS (SELECT CAST(l AS INTEGER) AS level, greatest(1, 25 >> CAST(l AS INTEGER)) AS w, greatest(1, {HEIGHT} >> CAST(l AS INTEGER)) AS h, {HEIGHT} AS full_h FROM range(6) r(l)),
places AS (SELECT level, c AS col, r AS row, CAST(floor((c + 0.5) * (25.0::DOUBLE / w)) AS BIGINT) AS px, CAST(floor((r + 0.5) * (full_h::DOUBLE / h)) AS BIGINT) AS py FROM lv, range(25) a(c), range(2000) b(r) WHERE c < w AND r < h),
level_rows AS (SELECT level, col, row, idx, label FROM places JOIN px USING (px, py)), years(year) AS (VALUES (2023), (2024))"""


def _book(name: str, code: str, factor: str) -> str:
    return f"""{name}_dims AS (SELECT tile, {code} AS code, unnest(emb) * {factor}::DOUBLE AS value, generate_subscripts(emb, 1) - 1 AS dim FROM tiled),
{name}_means AS (SELECT tile, code, dim, avg(value) AS value FROM {name}_dims GROUP BY ALL),
{name}_scales AS (SELECT tile, dim, min(value) AS low, max(value) AS high FROM {name}_means GROUP BY ALL),
{name} AS (SELECT tile, code, dim, floor((value - low) / (CASE WHEN high > low THEN high - low ELSE 1 END) * 255) * ((high - low) / 255) + low AS value FROM {name}_means JOIN {name}_scales USING (tile, dim))"""


STAGES = f"{TILED}, {_book('first', 'i1', '1.0')}, {_book('second', 'i2', '0.1')}"
NEIGHBOURS = """train AS (SELECT * FROM px WHERE idx % 5 <> 0), test AS (SELECT * FROM px WHERE idx % 5 = 0),
near AS (SELECT t.idx AS tid, t.label AS tlabel, t.emb[1] * 10 + t.label AS target, r.label, r.emb[1] * 10 + r.label AS rt, row_number() OVER (PARTITION BY t.idx ORDER BY list_distance(t.emb, r.emb), r.idx) AS k FROM test t, train r),
votes AS (SELECT tid, tlabel, label, count(*) AS n FROM near WHERE k <= 5 GROUP BY ALL),
predicted AS (SELECT tid AS idx, tlabel AS label, arg_min(label, n * -1000 + label) AS prediction FROM votes GROUP BY ALL),
regressed AS (SELECT tid AS idx, target, avg(rt) AS prediction FROM near WHERE k <= 5 GROUP BY ALL),
scores AS (SELECT class, sum(a) AS support, sum(c) AS claimed, sum(h) AS hits FROM (SELECT label AS class, 1 AS a, 0 AS c, CASE WHEN label = prediction THEN 1 ELSE 0 END AS h FROM predicted UNION ALL SELECT prediction, 0, 1, 0 FROM predicted) GROUP BY class),
classes AS (SELECT class, support, CASE WHEN claimed > 0 THEN hits / claimed ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall, 2 * hits / (claimed + support) AS f1 FROM scores)"""
LABELS = """given(label_id, name, type, visible, threshold, seed, polygon) AS (VALUES (1, 'wood', 'similarity', true, 1.25::DOUBLE, 0, NULL), (2, 'wood', 'point', true, 0.0, 30, NULL), (3, 'grass', 'polygon', true, 1.2, 60, 1),
  (4, 'water', 'similarity', true, 1.3, 90, NULL), (5, 'grass', 'polygon', true, 0.0, 120, 2), (6, 'water', 'point', false, 1.3, 150, NULL), (7, 'rock', 'similarity', true, 1.0, 180, NULL)),
labels_ AS (SELECT g.*, p.emb AS source, p.px AS sx, p.py AS sy FROM given g JOIN px p ON p.idx = g.seed)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join((PX, *parts[:-1])) + "\n" + parts[-1]


def oracle_sql() -> dict[str, str]:
    round_dims = "round(value, 6)"
    quantised = "floor((value - low) / (CASE WHEN high > low THEN high - low ELSE 1 END) * 255{})"
    codes = "SELECT idx, string_agg(CAST(CAST(greatest(0, least(255, {})) AS INTEGER) AS VARCHAR), ',' ORDER BY dim) AS codes FROM dims JOIN bounds USING (dim) GROUP BY idx"
    return {
        "grid_extract": _with(PROBES, """ring(ord, dx, dy) AS (VALUES (0, 0, 0), (1, -1, 0), (2, 1, 0), (3, 0, -1), (4, 0, 1), (5, -1, -1), (6, -1, 1), (7, 1, -1), (8, 1, 1)),
tried AS (SELECT probe, ord, CAST(trunc((lon - (-1.0)) / 0.01) AS INTEGER) + dx AS px, CAST(trunc((lat - 52.0) / (-0.01)) AS INTEGER) + dy AS py FROM probes, ring)""",
            "SELECT probe, idx, px, py, round(emb[1], 6) AS first, CAST(len(emb) AS INTEGER) AS dims FROM (SELECT probe, px.*, row_number() OVER (PARTITION BY probe ORDER BY ord) AS r FROM tried JOIN px USING (px, py)) WHERE r = 1"),
        "sim_range": _with(AT, "SELECT a.idx, a.px, a.py, round(a.lat, 6) AS lat, round(a.lon, 6) AS lon, round(list_distance(a.emb, q.emb), 6) AS distance FROM placed a, px q WHERE q.idx = 0 AND list_distance(a.emb, q.emb) <= 1.3"),
        "sim_multi": _with(SEEDS, "SELECT DISTINCT idx, px, py, 0.0::DOUBLE AS distance FROM px, seeds WHERE list_distance(emb, q) <= 1.2"),
        "sim_min_dist": _with(SEEDS, "SELECT idx, round(min(pow(list_distance(emb, q), 2)), 6) AS d2 FROM px, seeds GROUP BY idx"),
        "sim_rethreshold": _with(SEEDS, "d AS (SELECT idx, min(list_distance(emb, q)) AS d FROM px, seeds GROUP BY idx)", "SELECT t AS threshold, idx FROM d, (VALUES (1.2::DOUBLE), (1.25)) v(t) WHERE d <= t"),
        "sim_count_any": _with(SEEDS, "SELECT count(DISTINCT idx) AS n FROM px, seeds WHERE list_distance(emb, q) <= 1.15 + (sid % 3) * 0.05"),
        "sim_stats": _with("d AS (SELECT list_distance(a.emb, q.emb) AS d FROM px a, px q WHERE q.idx = 0)",
            "SELECT count(*) AS n, round(count(*) / (SELECT count(*) FROM px) * 100, 4) AS pct, round(min(d), 4) AS min_distance, round(max(d), 4) AS max_distance, round(avg(d), 4) AS mean_distance FROM d WHERE d <= 1.3"),
        "sim_knn": _with("SELECT a.idx, round(pow(list_distance(a.emb, q.emb), 2), 6) AS d2 FROM px a, px q WHERE q.idx = 3 ORDER BY list_distance(a.emb, q.emb), a.idx LIMIT 10"),
        "nearest_place": _with(AT, """places(which, la, lo, lim) AS (VALUES ('near', 51.95003::DOUBLE, -0.87002::DOUBLE, 1e-4), ('far', 51.9551, -0.87, 1e-4), ('any', 51.9561, -0.8699, 99))""",
            "SELECT which, idx FROM (SELECT which, idx, lim, sqrt((lat - la) ** 2 + (lon - lo) ** 2) AS d, row_number() OVER (PARTITION BY which ORDER BY (lat - la) ** 2 + (lon - lo) ** 2, idx) AS r FROM placed, places) WHERE r = 1 AND d < lim"),
        "bounds_filter": _with(AT, "SELECT idx, round(lat, 6) AS lat, round(lon, 6) AS lon FROM placed WHERE lat BETWEEN 51.9149 AND 51.9651 AND lon BETWEEN -0.9251 AND -0.8149"),
        "knn_graph": _with("SELECT source, CAST(rank AS INTEGER) AS rank, idx, round(d * d, 6) AS d2 FROM (SELECT q.idx AS source, a.idx, list_distance(a.emb, q.emb) AS d, row_number() OVER (PARTITION BY q.idx ORDER BY list_distance(a.emb, q.emb), a.idx) AS rank FROM px a, px q WHERE q.idx % 20 = 0 AND a.idx <> q.idx) WHERE rank <= 5"),
        "dim_stats": _with(DIMS, BOUNDS, "SELECT CAST(dim AS INTEGER) AS dim, round(low, 6) AS low, round(high, 6) AS high FROM bounds"),
        "mean_vector_by_label": _with(DIMS, "SELECT label, count(*) AS n, CAST(dim AS INTEGER) AS dim, round(avg(value), 6) AS mean FROM dims GROUP BY label, dim"),
        "quantize_trunc": _with(DIMS, BOUNDS, codes.format(quantised.format(""))),
        "quantize_round": _with(DIMS, BOUNDS, codes.format(quantised.format(" + 0.5"))),
        "dequant_error": _with(DIMS, BOUNDS, f"e AS (SELECT dim, abs(value - ({quantised.format('')} * ((high - low) / 255) + low)) AS e, high - low AS span FROM dims JOIN bounds USING (dim))", "SELECT CAST(dim AS INTEGER) AS dim, round(max(e), 6) AS max_error, max(e) <= max(span) / 255 + 1e-12 AS within FROM e GROUP BY dim"),
        "vector_checks": _with(DIMS, "SELECT NOT bool_or(value <> 0) AS all_zero, bool_and(isnan(value)) AS all_nan, count(DISTINCT idx) AS n FROM dims"),
        "tile_index": _with(TILED, "SELECT idx, tile FROM tiled"),
        "vq_decode": _with(STAGES, f"SELECT tile, code, CAST(dim AS INTEGER) AS dim, {round_dims} AS value FROM first"),
        "rvq_reconstruct": _with(STAGES, "SELECT t.idx, round(sum(a.value + b.value), 5) AS total, round(max(a.value + b.value) FILTER (WHERE a.dim = 0), 6) AS first FROM tiled t JOIN first a ON a.tile = t.tile AND a.code = t.i1 JOIN second b ON b.tile = t.tile AND b.code = t.i2 AND b.dim = a.dim WHERE t.px BETWEEN 3 AND 12 AND t.py BETWEEN 2 AND 17 GROUP BY t.idx"),
        "linear_fastpath": _with(STAGES, "SELECT t.idx, round(sum((a.value + b.value) / (a.dim + 1)), 6) AS score FROM tiled t JOIN first a ON a.tile = t.tile AND a.code = t.i1 JOIN second b ON b.tile = t.tile AND b.code = t.i2 AND b.dim = a.dim GROUP BY t.idx"),
        "codebook_training": _with(TILED, "d AS (SELECT tile, idx, unnest(emb) AS v, generate_subscripts(emb, 1) AS dim FROM tiled)", "s AS (SELECT tile, sum(v) AS spread FROM (SELECT tile, dim, var_pop(v) * count(*) AS v FROM d GROUP BY ALL) GROUP BY tile)",
            "SELECT tile, count(*) AS n, CAST(least(5, count(DISTINCT emb)) AS INTEGER) AS codes, round(any_value(spread), 4) AS spread, true AS lessens FROM tiled JOIN s USING (tile) GROUP BY tile"),
        "vector_choice": _with(STAGES, "ends AS (SELECT dim, min(v) AS low, max(v) AS high FROM (SELECT unnest(emb) AS v, generate_subscripts(emb, 1) AS dim FROM px) GROUP BY dim)",
            "book AS (SELECT dim, min(value) AS low, max(value) AS high FROM first GROUP BY dim)",
            "sums AS (SELECT 2022 AS year, count(*) AS dims, sum(low) AS low, sum(high) AS high FROM ends UNION ALL SELECT 2023, count(*), sum(low), sum(high) FROM ends UNION ALL SELECT 2024, count(*), sum(low), sum(high) FROM book)",
            "SELECT CAST(year AS INTEGER) AS year, idx, CAST(dims AS INTEGER) AS dims, round(low, 5) AS low, round(high, 5) AS high FROM sums CROSS JOIN px"),
        "vq_assemble": _with("n AS (SELECT (max(idx) + 5) // 5 * 8 - 2 AS h FROM px)",
            "placed AS (SELECT idx, least((idx % 5) * 8, 29) + i % 8 AS px, least((idx // 5) * 8, h - 8) + i // 8 AS py, CAST(floor((emb[i + 1] + 1) * 100) AS INTEGER) AS code FROM px, n, range(64) r(i))",
            "SELECT CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, arg_max(code, idx) AS code FROM placed GROUP BY ALL"),
        "change_distance": _with(CHANGED, "SELECT idx, px, py, round(distance, 6) AS distance FROM changed"),
        "change_stats": _with(CHANGED, "SELECT count(*) AS matched, round(min(distance), 6) AS min_distance, round(max(distance), 6) AS max_distance, round(avg(distance), 6) AS mean_distance, round(median(distance), 6) AS median_distance FROM changed"),
        "change_bins": _with(CHANGED, """m AS (SELECT median(distance) AS m, max(distance) AS top, count(*) AS total FROM changed), bins(bin, label) AS (VALUES (0, 'Stable'), (1, 'Minor change'), (2, 'Moderate change'), (3, 'Major change')),
counted AS (SELECT CASE WHEN distance < m * 0.5 THEN 0 WHEN distance < m THEN 1 WHEN distance < m * 1.5 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM changed, m GROUP BY ALL)""",
            "SELECT bin, label, round(m * 0.5 * bin, 6) AS lo, round(CASE WHEN bin = 3 THEN top ELSE m * 0.5 * (bin + 1) END, 6) AS hi, coalesce(n, 0) AS n, round(coalesce(n, 0) / total * 100, 1) AS pct FROM bins CROSS JOIN m LEFT JOIN counted USING (bin)"),
        "change_colours": _with(CHANGED, """stops(k, r, g, b) AS (VALUES (0, 68, 1, 84), (1, 72, 40, 120), (2, 62, 74, 137), (3, 47, 105, 141), (4, 39, 133, 133), (5, 92, 156, 89), (6, 181, 172, 39)),
m AS (SELECT median(distance) * 1.5 AS top FROM changed),
scaled AS (SELECT idx, CASE WHEN top > 0 THEN least(1.0::DOUBLE, distance / top) ELSE 0.0 END * 6 AS t FROM changed, m),
v AS (SELECT idx, t, CAST(least(floor(t), 5) AS INTEGER) AS k FROM scaled)""",
            "SELECT idx, " + ", ".join(f"CAST(floor(a.{x} + (b.{x} - a.{x}) * (t - v.k)) AS INTEGER) AS {x}" for x in "rgb") + " FROM v JOIN stops a ON a.k = v.k JOIN stops b ON b.k = v.k + 1"),
        "polygon_raster": _with(SHAPES, "SELECT polygon, idx, px, py FROM inside JOIN px USING (idx)"),
        "polygon_mean": _with(DIMS, SHAPES, "SELECT polygon, count(*) AS n, CAST(dim AS INTEGER) AS dim, round(avg(value), 6) AS mean FROM inside JOIN dims USING (idx) GROUP BY polygon, dim"),
        "polygon_union": _with(SHAPES, "SELECT DISTINCT p.idx, p.px, p.py, 0.0::DOUBLE AS distance FROM px p, inside i JOIN px q ON q.idx = i.idx WHERE i.polygon = 2 AND list_distance(p.emb, q.emb) <= 1.0"),
        "run_length": _with("r AS (SELECT label, px, py, px - row_number() OVER (PARTITION BY label, py ORDER BY px) AS island FROM px)",
            "SELECT label, round(-1.0 + min(px) * 0.01::DOUBLE, 6) AS west, round(52.0 + (py + 1) * (-0.01)::DOUBLE, 6) AS south, round(-1.0 + (max(px) + 1) * 0.01::DOUBLE, 6) AS east, round(52.0 + py * (-0.01)::DOUBLE, 6) AS north FROM r GROUP BY label, py, island"),
        "outline_sides": _with("""s AS (SELECT label, px AS x1, py AS y1, px + 1 AS x2, py AS y2 FROM px UNION ALL SELECT label, px, py + 1, px + 1, py + 1 FROM px
UNION ALL SELECT label, px, py, px, py + 1 FROM px UNION ALL SELECT label, px + 1, py, px + 1, py + 1 FROM px)""", "SELECT label, x1, y1, x2, y2 FROM s GROUP BY ALL HAVING count(*) = 1"),
        "vertex_mean": _with(STARS, "SELECT polygon, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM star GROUP BY polygon"),
        "polygon_cover": _with(STARS, "SELECT polygon, count(*) AS n, CAST(sum(idx) AS BIGINT) AS total, round(avg(emb[1]), 6) AS mean FROM in_star JOIN px USING (idx) GROUP BY polygon"),
        "outline_rings": _with("""around AS (SELECT label, px + dx AS x, py + dy AS y, count(*) AS n, sum((2 - dx) * (1 + 3 * (1 - dy))) AS held FROM px, range(2) a(dx), range(2) b(dy) GROUP BY 1, 2, 3),
corner AS (SELECT label, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND held IN (6, 9) THEN 2 ELSE 0 END) AS corners, sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND held IN (6, 9) THEN 2 ELSE 0 END) // 4 AS euler FROM around GROUP BY label),
side AS (SELECT label, px + dx AS x, py AS y, 'v' AS kind FROM px, range(2) a(dx) UNION ALL SELECT label, px, py + dy, 'h' FROM px, range(2) b(dy)),
outer_ AS (SELECT label, count(*) AS length FROM (SELECT label FROM side GROUP BY label, x, y, kind HAVING count(*) = 1) GROUP BY label)""",
            "SELECT label, n AS area, CAST(corners AS BIGINT) AS corners, length, CAST(euler AS BIGINT) AS outer_less_holes FROM (SELECT label, count(*) AS n FROM px GROUP BY label) JOIN corner USING (label) JOIN outer_ USING (label)"),
        "percentile_stretch": _with("c AS (SELECT " + ", ".join(f"quantile_cont(emb[{d + 1}], 0.02) AS l{d}, quantile_cont(emb[{d + 1}], 0.98) AS h{d}" for d in range(3)) + " FROM px)",
            "SELECT idx, " + ", ".join(f"CAST(floor((greatest(l{d}, least(h{d}, emb[{d + 1}])) - l{d}) / (h{d} - l{d}) * 255) AS INTEGER) AS band{d}" for d in range(3)) + " FROM px, c"),
        "pyramid_level": _with(f"w AS (SELECT 6 AS w, {HEIGHT} AS h, {HEIGHT} // 4 AS lh)", "SELECT CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row, idx FROM w, range(6) a(c), range(1000) b(r) JOIN px ON true WHERE r < lh AND px = floor((c + 0.5) * (25.0::DOUBLE / 6)) AND py = floor((r + 0.5) * (h / lh))"),
        "enlarged": _with("SELECT idx, CAST(px * 3 + a AS INTEGER) AS px, CAST(py * 3 + b AS INTEGER) AS py FROM px, range(3) x(a), range(3) y(b)"),
        "tile_window": _with("SELECT CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row, idx FROM range(16) a(c), range(16) b(r), px WHERE px = floor((c + 0.5) * 8 / 16) + 5 AND py = floor((r + 0.5) * 10 / 16) + 5"),
        "image_levels": _with(LEVEL_ROWS, "SELECT 'here' AS viewport, year, level, col, row, label AS band, idx FROM level_rows, years"),
        "tile_lookup": _with(AT, LEVEL_ROWS, """at_ AS (SELECT idx, CAST(8 + idx % 7 AS INTEGER) AS z, CAST(2023 + idx % 3 AS INTEGER) AS year, lat, lon FROM placed),
req AS (SELECT DISTINCT year, z, CAST(floor((lon + 180) / 360 * pow(2.0, z)) AS BIGINT) AS x, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2.0, z)) AS BIGINT) AS y FROM at_),
box AS (SELECT req.*, CAST(greatest(0, least(5, floor((14 - z) / 2.0))) AS INTEGER) AS level, x / pow(2.0, z) * 360 - 180 AS west, (x + 1) / pow(2.0, z) * 360 - 180 AS east,
  degrees(atan(sinh(pi() * (1 - 2 * y / pow(2.0, z))))) AS north, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2.0, z))))) AS south FROM req),
sized AS (SELECT box.*, 0.01::DOUBLE * (25.0::DOUBLE / w) AS a, (-0.01)::DOUBLE * (full_h::DOUBLE / h) AS e FROM box JOIN lv USING (level) JOIN years USING (year)),
win AS (SELECT year, z, x, y, level, round_even((west + 1.0) / a, 0) AS x0, round_even((north - 52.0) / e, 0) AS y0, round_even((east + 1.0) / a - (west + 1.0) / a, 0) AS w, round_even((south - 52.0) / e - (north - 52.0) / e, 0) AS h FROM sized),
spots AS (SELECT win.*, c, r, CAST(floor((c + 0.5) * w / 16) + x0 AS BIGINT) AS col, CAST(floor((r + 0.5) * h / 16) + y0 AS BIGINT) AS row FROM win, range(16) i(c), range(16) j(r) WHERE w > 0 AND h > 0),
seen AS (SELECT year, z, x, y, count(*) AS n, CAST(sum(idx * (c + 16 * r)) AS BIGINT) AS total FROM spots JOIN level_rows USING (level, col, row) GROUP BY ALL)""",
            "SELECT year, z, x, y, coalesce(n, 0) AS n, total FROM req LEFT JOIN seen USING (year, z, x, y)"),
        "image_bounds": _with(f"n AS (SELECT {HEIGHT} AS h), years(year) AS (VALUES (2023), (2024))", "SELECT 'here' AS viewport, year, -1.0::DOUBLE AS west, round(52 - 0.01::DOUBLE * h, 6) AS south, round(-1 + 0.01::DOUBLE * 25, 6) AS east, 52.0::DOUBLE AS north, round((52 - 0.01::DOUBLE * h + 52) / 2, 6) AS center_lat, round((-1 + (-1 + 0.01::DOUBLE * 25)) / 2, 6) AS center_lon FROM n, years"),
        "crop": _with("SELECT idx, px - 5 AS px, py - 4 AS py FROM px WHERE px >= 5 AND px < 15 AND py >= 4 AND py < 11"),
        "tile_bbox": _with("t AS (SELECT idx, CAST(6 + idx % 12 AS INTEGER) AS z, CAST(pow(2, 6 + idx % 12) AS BIGINT) AS side FROM px)",
            "SELECT idx, z, round((idx * 3) % side / pow(2.0, z) * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * ((idx * 2 + 1) % side) / pow(2.0, z))))), 6) AS north, CAST(greatest(0, least(5, floor((14 - z) / 2.0))) AS INTEGER) AS level FROM t"),
        "pixel_bounds": _with(AT, "SELECT idx, round(lon - 0.005, 6) AS west, round(lat - 0.005, 6) AS south, round(lon + 0.005, 6) AS east, round(lat + 0.005, 6) AS north FROM placed"),
        "viewport_math": _with(AT, "b AS (SELECT idx, lon - 5 / (111.32::DOUBLE * cos(radians(lat))) AS west, lat - 3 / 111.32::DOUBLE AS south, lon + 5 / (111.32::DOUBLE * cos(radians(lat))) AS east, lat + 3 / 111.32::DOUBLE AS north FROM placed)",
            "SELECT idx, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north, round((east - west) * 111320 * cos(radians((south + north) / 2)) / 10 * ((north - south) * 110540 / 10) * 128 * 4 * 0.4::DOUBLE / 1048576 * 3 * (idx % 3 + 1), 3) AS mb FROM b"),
        "nearest_centroid": _with(ASSIGNED, "SELECT idx, cluster, round(d2, 6) AS d2 FROM assigned"),
        "classify": _with(SHAPES, LABELS, """ordered AS (SELECT name, row_number() OVER (ORDER BY min(label_id)) - 1 AS class FROM labels_ WHERE visible GROUP BY name),
active AS (SELECT * FROM labels_ JOIN ordered USING (name) WHERE visible),
poly AS (SELECT idx, arg_max(class, label_id) AS class FROM inside JOIN active USING (polygon) GROUP BY idx),
near AS (SELECT p.idx, arg_min(class, list_distance(emb, source)) AS class FROM px p, active WHERE threshold > 0 AND list_distance(emb, source) <= threshold GROUP BY p.idx)""",
            "SELECT idx, CAST(coalesce(a.class, b.class, -1) AS INTEGER) AS class FROM px LEFT JOIN poly a USING (idx) LEFT JOIN near b USING (idx)"),
        "class_overlay": _with(SHAPES, LABELS, """frozen(name, px, py) AS (VALUES ('rock', 3, 3), ('rock', 4, 3), ('rock', 24, 19)),
every AS (SELECT name, idx FROM labels_ JOIN px ON px = sx AND py = sy WHERE type = 'point' AND visible UNION SELECT name, idx FROM inside JOIN labels_ USING (polygon)
UNION SELECT name, idx FROM frozen JOIN px USING (px, py) UNION SELECT name, idx FROM px, labels_ WHERE name <> 'rock' AND threshold > 0 AND visible AND list_distance(emb, source) <= threshold)""",
            "SELECT name, idx FROM every WHERE name IN ('wood', 'grass', 'rock')"),
        "class_threshold": _with(LABELS, """steps AS (SELECT 'before' AS step, label_id, name, threshold FROM labels_ UNION ALL SELECT 'after', label_id, name, CASE WHEN name = 'rock' THEN 35.0 ELSE threshold END FROM labels_)""",
            "SELECT step, name, coalesce(arg_min(threshold, label_id) FILTER (WHERE threshold > 0), 0.0)::DOUBLE AS threshold FROM steps GROUP BY step, name"),
        "label_timeline": _with(CHANGED, """years AS (SELECT 2023 AS year, idx, px, py, emb FROM px UNION ALL SELECT 2024, idx, px, py, emb FROM year2),
s(sx, sy, t) AS (SELECT CAST(trunc((lon + 1.0) / 0.01) AS INTEGER), CAST(trunc((lat - 52.0) / (-0.01)) AS INTEGER), t FROM (VALUES (51.995::DOUBLE, -0.995::DOUBLE, 1.25::DOUBLE), (51.955, -0.875, 1.3)) v(lat, lon, t)),
read AS (SELECT year, emb AS q, t FROM years JOIN s ON px = sx AND py = sy)""", "SELECT y.year, count(DISTINCT y.idx) AS n FROM years y JOIN read r ON r.year = y.year AND list_distance(y.emb, r.q) <= t GROUP BY y.year"),
        "label_recompute": _with(LABELS, """frozen(label_id, px, py) AS (VALUES (7, 3, 3), (7, 4, 3), (7, 24, 19)), sources AS (SELECT label_id, threshold, source FROM labels_ WHERE label_id <> 7 UNION ALL
SELECT 20, 1.25, emb FROM px WHERE px = CAST(trunc((-0.875::DOUBLE + 1.0) / 0.01) AS INTEGER) AND py = CAST(trunc((51.955::DOUBLE - 52.0) / (-0.01)) AS INTEGER))""",
            "SELECT label_id, idx FROM px, sources WHERE list_distance(emb, source) <= threshold UNION ALL SELECT label_id, idx FROM frozen JOIN px USING (px, py)"),
        "label_crud": """SELECT * FROM (VALUES (1, 'wood', 'similarity', true, 1.25::DOUBLE), (2, 'wood', 'point', true, 0.0), (3, 'grass', 'polygon', false, 1.2), (5, 'grass', 'polygon', false, 0.0), (7, 'stone', 'similarity', true, 1.0),
(8, 'marsh', 'point', true, 0.0), (9, 'wood', 'similarity', true, 1.25)) v(label_id, name, type, visible, threshold)""",
        "label_import": "SELECT CASE WHEN event_id % 3 <> 0 THEN event_type ELSE 'Imported' END AS name, '' AS code, count(*) AS n, round(sum(value), 4) AS lat, round(sum(user_id::DOUBLE), 4) AS lon FROM events WHERE event_id % 5 <> 0 GROUP BY 1",
        "saved_label_merge": "SELECT doc_id AS label_id, 'saved' AS name FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 3 <> 0",
        "geojson_import": _with("SELECT 'p' || idx AS name, 'point' AS type, py::DOUBLE AS lat, px + 0.5::DOUBLE AS lon, 0 AS n_vertices FROM px UNION ALL SELECT 'Imported', 'polygon', round((py + 1) / 3, 6), round(8.0::DOUBLE / 3, 6), 3 FROM px"),
        "csv_export": _with("""SELECT idx AS label_id, CASE WHEN idx % 4 = 0 THEN '"a ""b"", c"' ELSE 'plain' END || ',x,point,' || px || ',' || py || ',' || CASE WHEN idx % 3 <> 0 THEN CAST(idx % 3 AS VARCHAR) WHEN idx % 2 <> 0 THEN '1' ELSE '' END AS line FROM px"""),
        "geojson_export": _with("""SELECT idx AS label_id, '{"type":"Feature","properties":{"name":"<l&' || idx || '>","code":"c","color":"#0a64ff"},"geometry":' || CASE WHEN idx % 2 = 0
THEN '{"type":"Polygon","coordinates":[[[' || px || ',' || py || '],[' || (px + 1) || ',' || py || '],[' || px || ',' || (py + 1) || '],[' || px || ',' || py || ']]]}' ELSE '{"type":"Point","coordinates":[' || (px * 2) || ',' || py || ']}' END || '}' AS feature FROM px"""),
        "kml_export": _with("""SELECT idx AS label_id, '<Placemark><name>&lt;l&amp;' || idx || '&gt;</name><Style><LineStyle><color>ffff640a</color></LineStyle></Style>' || CASE WHEN idx % 2 = 0
THEN '<Polygon><outerBoundaryIs><LinearRing><coordinates>' || px || ',' || py || ',0 ' || (px + 1) || ',' || py || ',0 ' || px || ',' || (py + 1) || ',0 ' || px || ',' || py || ',0</coordinates></LinearRing></outerBoundaryIs></Polygon>'
ELSE '<Point><coordinates>' || (px * 2) || ',' || py || ',0</coordinates></Point>' END || '</Placemark>' AS placemark FROM px"""),
        "private_share": _with("""s AS (SELECT 'm' || label AS name, CASE WHEN idx % 2 = 0 THEN 'k' END AS code, 'point' AS type, emb[1] AS e FROM px WHERE idx % 3 <> 0
UNION ALL SELECT 'm' || label, CASE WHEN idx % 2 = 0 THEN 'k' END, 'point', emb[1] FROM px, range(2) WHERE idx % 5 = 0 UNION ALL SELECT 's', NULL, 'similarity', emb[1] FROM px WHERE idx % 4 = 0)""",
            "SELECT name, code, type, count(*) AS n, round(sum(e), 5) AS total FROM s GROUP BY ALL"),
        "shares": "SELECT 'user_' || user_id || '_at_x_org' AS owner, event_type AS viewport, max(event_id) AS submitted FROM events GROUP BY user_id, event_type HAVING max(event_id) % 2 = 0",
        "schema_filter": """WITH RECURSIVE e AS (SELECT user_id, event_id, event_id % 4 AS level, event_type FROM events),
n AS (SELECT a.user_id, a.event_id, a.event_type, max(b.event_id) AS parent FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.event_id < a.event_id AND b.level < a.level GROUP BY ALL),
shown AS (SELECT * FROM n WHERE event_type LIKE '%err%' UNION SELECT n.* FROM n JOIN shown s ON n.user_id = s.user_id AND n.event_id = s.parent)
SELECT user_id, CAST(event_id AS INTEGER) AS node_id, CAST(parent AS INTEGER) AS parent_id, 'e' || event_id AS code, event_type AS name FROM shown""",
        "point_colours": _with("SELECT idx, CASE WHEN label > 1 THEN CAST(label % 7 + CASE WHEN idx % 3 = 0 THEN 100 ELSE 0 END AS INTEGER) END AS colour FROM px"),
        "client_address": "SELECT CASE WHEN event_id % 4 = 0 THEN 'r' || user_id WHEN event_id % 3 = 0 THEN 'f' || user_id WHEN event_id % 2 = 0 THEN 'peer' ELSE 'unknown' END AS address, count(*) AS n FROM events GROUP BY 1",
        "cluster_radius": _with(ASSIGNED, "SELECT cluster, arg_min(idx, d2) AS medoid, round(sqrt(max(d2)), 6) AS radius, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 1) AS pct FROM assigned GROUP BY cluster"),
        "cluster_labels": _with(ASSIGNED, "m AS (SELECT cluster, arg_min(idx, d2) AS medoid FROM assigned GROUP BY cluster)",
            "SELECT cluster, medoid, round(max(list_distance(p.emb, q.emb)), 6) AS threshold, count(*) AS pixel_count FROM assigned a JOIN m USING (cluster) JOIN px p ON p.idx = a.idx JOIN px q ON q.idx = m.medoid GROUP BY cluster, medoid"),
        "stride_sample": _with("n AS (SELECT count(*) AS n, (count(*) + 59) // 60 AS s FROM px)", "SELECT idx FROM px, n WHERE idx % s = 0 AND idx < (n // s) * s"),
        "neighbourhood": _with("steps(dy, dx, o) AS (SELECT a - 1, b - 1, a * 3 + b FROM range(3) x(a), range(3) y(b))",
            "v AS (SELECT p.idx, o, coalesce(q.emb, p.emb) AS e FROM px p CROSS JOIN steps LEFT JOIN px q ON q.px = p.px + dx AND q.py = p.py + dy)",
            "u AS (SELECT idx, o * len(e) + generate_subscripts(e, 1) - 1 AS i, unnest(e) AS x FROM v)", "SELECT idx, CAST(count(*) AS INTEGER) AS n, round(sum(x * (i % 9)), 5) AS mixed FROM u GROUP BY idx"),
        "knn_classify": _with(NEIGHBOURS, "SELECT idx, label, prediction FROM predicted"),
        "confusion_matrix": _with(NEIGHBOURS, "SELECT label, prediction, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label) * 100, 4) AS row_pct FROM predicted GROUP BY label, prediction"),
        "f1_scores": _with(NEIGHBOURS, "SELECT class, CAST(support AS BIGINT) AS support, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM classes"),
        "f1_summary": _with(NEIGHBOURS, "SELECT round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1, (SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 4) FROM predicted) AS accuracy FROM classes WHERE support > 0"),
        "regression_metrics": _with(NEIGHBOURS, """r AS (SELECT 1 - sum((target - prediction) ** 2) / (var_pop(target) * count(*)) AS r2, sqrt(avg((target - prediction) ** 2)) AS rmse, avg(abs(target - prediction)) AS mae, least(min(target), min(prediction)) AS lo, greatest(max(target), max(prediction)) AS hi FROM regressed)""",
            "SELECT round(r2, 4) AS r2, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(lo - (hi - lo) * 0.05, 4) AS low, round(hi + (hi - lo) * 0.05, 4) AS high FROM r"),
        "stratified_quota": _with("s AS (SELECT label, count(*) AS n FROM px WHERE label < 4 OR idx % 3 = 0 GROUP BY label)",
            """SELECT mode, label, n, CAST(least(n, CASE WHEN mode = 'equal' THEN floor(w / t * 120) ELSE greatest(floor(w / t * 120), 50) END) AS BIGINT) AS quota FROM (SELECT mode, label, n, w, sum(w) OVER (PARTITION BY mode) AS t FROM
(SELECT 'equal' AS mode, label, n, 1.0::DOUBLE AS w FROM s UNION ALL SELECT 'sqrt', label, n, sqrt(n) FROM s UNION ALL SELECT 'proportional', label, n, n::DOUBLE FROM s))"""),
        "spatial_split": _with(AT, """m AS (SELECT idx, (lat BETWEEN 51.8949 AND 52.001 AND lon BETWEEN -1.001 AND -0.8951) OR (lat BETWEEN 51.9549 AND 52.001 AND lon BETWEEN -0.8551 AND -0.7949) AS a, lat BETWEEN 51.8449 AND 51.9351 AND lon BETWEEN -0.9251 AND -0.8249 AS b FROM placed)""",
            "SELECT idx, CASE WHEN a THEN 'train' ELSE 'test' END AS split FROM m WHERE a OR b"),
        "truth_pixels": _with(STARS, "SELECT idx, CAST(max(polygon) % 7 AS INTEGER) AS label FROM in_star GROUP BY idx"),
        "kfold_scores": _with("""near AS (SELECT t.idx AS tid, t.label AS tlabel, r.label, row_number() OVER (PARTITION BY t.idx ORDER BY list_distance(t.emb, r.emb), r.idx) AS k FROM px t JOIN px r ON t.idx % 5 <> r.idx % 5),
votes AS (SELECT tid, tlabel, label, count(*) AS n FROM near WHERE k <= 5 GROUP BY ALL), predicted AS (SELECT tid AS idx, tlabel AS label, arg_min(label, n * -1000 + label) AS prediction FROM votes GROUP BY ALL),
scores AS (SELECT class, sum(a) AS support, sum(c) AS claimed, sum(h) AS hits FROM (SELECT label AS class, 1 AS a, 0 AS c, CASE WHEN label = prediction THEN 1 ELSE 0 END AS h FROM predicted UNION ALL SELECT prediction, 0, 1, 0 FROM predicted) GROUP BY class),
classes AS (SELECT class, support, 2 * hits / (claimed + support) AS f1 FROM scores WHERE support > 0)""",
            "SELECT round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1, (SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 4) FROM predicted) AS accuracy FROM classes"),
        "label_export": _with(AT, "SELECT idx AS label_id, CASE WHEN idx % 4 <> 0 THEN 'n ' || label ELSE 'Imported' END AS name, '#3388ff' AS color, 'point' AS type, CASE WHEN idx % 3 <> 0 THEN round(lat, 6) END AS lat, CASE WHEN idx % 5 = 0 THEN 1.25::DOUBLE ELSE 0.0::DOUBLE END AS threshold, true AS visible FROM placed"),
        "viewport_texts": _with(AT, "s AS (SELECT *, CASE WHEN idx % 7 = 0 THEN -0.1::DOUBLE ELSE 0.1::DOUBLE END AS d FROM placed)",
            """SELECT 'v' || idx AS viewport_id, round(lat - d, 4) AS min_lat, CASE WHEN idx % 13 <> 0 THEN round(lat + d, 4) END AS max_lat, CASE WHEN idx % 2 = 0 THEN 7.5::DOUBLE ELSE 10.0::DOUBLE END AS size_km,
CASE WHEN idx % 13 = 0 THEN 'fields are missing' WHEN idx % 11 = 0 THEN 'a latitude is out of range' WHEN idx % 7 = 0 THEN 'latitudes are not in order' END AS problem FROM s"""),
        "result_files": "SELECT event_type AS field, CAST(2020 + user_id % 3 AS INTEGER) AS year, CASE WHEN user_id % 2 = 0 THEN 'classification' ELSE 'regression' END AS task, count(*) AS n, round(avg(value), 6) AS score, CAST(count(DISTINCT user_id % 4) AS INTEGER) AS models FROM events GROUP BY 1, 2, 3",
        "field_profile": "SELECT count(*) AS total, count(l) AS non_null, count(DISTINCT l) AS unique_count FROM (SELECT CASE WHEN vec_id % 11 <> 0 THEN label END AS l FROM embeddings)",
        "class_counts": "SELECT label AS class, count(*) AS n, count(*) < 50 AS excluded FROM embeddings GROUP BY label",
        "event_lines": "SELECT event_type AS event, (event_id % 4)::DOUBLE AS pct, count(*) AS n FROM events WHERE event_id % 9 <> 0 AND event_id % 10 <> 0 GROUP BY ALL",
        "event_table": "SELECT event_id % 8 AS pct, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'view') AS view, max(value) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1",
        "progress_latest": "SELECT user_id, event_id, CAST(least(100, floor(value / 20.0::DOUBLE * 100)) AS INTEGER) AS percent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
        "status_edges": "SELECT event_id, user_id, s AS \"on\" FROM (SELECT event_id, user_id, event_type = 'purchase' AS s, coalesce(lag(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts), false) AS b FROM events) WHERE s <> b",
        "rate_attempts": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS attempts FROM events",
        "rate_limit": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, n, [moment] AS held, true AS allowed, 0::BIGINT AS retry_after FROM e WHERE n = 1
UNION ALL SELECT event_id, user_id, n, CASE WHEN len(h) < 5 THEN list_append(h, moment) ELSE h END, len(h) < 5, CASE WHEN len(h) < 5 THEN 0 ELSE greatest(1, CAST(trunc(86400 - (moment - h[1])) AS BIGINT)) END
FROM (SELECT e.*, list_filter(r.held, lambda t: e.moment - t < 86400) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT event_id, user_id, allowed, retry_after FROM r""",
        "rate_release": """WITH RECURSIVE a AS (SELECT user_id, epoch_us(ts) / 1e6 AS moment, '+' || event_id AS row, CAST(NULL AS VARCHAR) AS frees FROM events
UNION ALL SELECT user_id, epoch_us(ts + INTERVAL 90 MINUTES) / 1e6, '-' || event_id, '+' || event_id FROM events WHERE event_type = 'error'),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, row) AS n FROM a),
r AS (SELECT user_id, n, row, [{'t': moment, 'r': row}] AS held, true AS allowed, 0::BIGINT AS retry_after FROM e WHERE n = 1
UNION ALL SELECT user_id, n, row, CASE WHEN frees IS NOT NULL THEN list_filter(h, lambda x: x.r <> frees) WHEN len(h) < 3 THEN list_append(h, {'t': moment, 'r': row}) ELSE h END,
  CASE WHEN frees IS NOT NULL THEN len(list_filter(h, lambda x: x.r = frees)) > 0 ELSE len(h) < 3 END,
  CASE WHEN frees IS NOT NULL OR len(h) < 3 THEN 0 ELSE greatest(1, CAST(trunc(86400 - (moment - h[1].t)) AS BIGINT)) END
FROM (SELECT e.*, list_filter(r.held, lambda x: e.moment - x.t < 86400) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, row, allowed, retry_after FROM r""",
        "knn_weights": "WITH RECURSIVE " + PX + """,
ranked AS (SELECT p.idx AS source, q.idx, list_distance(p.emb, q.emb) AS d, row_number() OVER (PARTITION BY p.idx ORDER BY list_distance(p.emb, q.emb), q.idx) AS k FROM px p JOIN px q ON p.idx <> q.idx),
edge AS (SELECT source, idx, d, min(d) FILTER (WHERE d > 0) OVER (PARTITION BY source) AS near FROM ranked WHERE k <= 15),
held AS (SELECT source, list(d) AS ds, min(near) AS near FROM edge GROUP BY source),
half(source, step, low, high, rate) AS (SELECT source, 0, 0.0::DOUBLE, 'inf'::DOUBLE, 1.0::DOUBLE FROM held
UNION ALL SELECT source, step + 1, CASE WHEN s > log2(15.0) THEN low ELSE rate END, CASE WHEN s > log2(15.0) THEN rate ELSE high END,
  CASE WHEN s > log2(15.0) THEN (low + rate) / 2 WHEN high = 'inf'::DOUBLE THEN rate * 2 ELSE (rate + high) / 2 END
FROM (SELECT half.*, list_sum(list_transform(ds, lambda d: CASE WHEN d <= near THEN 1.0::DOUBLE ELSE exp((near - d) / rate) END)) AS s FROM half JOIN held USING (source) WHERE step < 64)),
w AS (SELECT source, idx, CASE WHEN d <= near THEN 1.0::DOUBLE ELSE exp((near - d) / rate) END AS weight FROM edge JOIN half USING (source) WHERE step = 64),
undirected AS (SELECT least(source, idx) AS a, greatest(source, idx) AS b, 1 - product(1 - weight) AS weight FROM w GROUP BY ALL),
share AS (SELECT source, count(*) AS degree, round(sum(weight), 4) AS mass FROM (SELECT a AS source, weight FROM undirected UNION ALL SELECT b, weight FROM undirected) GROUP BY source)
SELECT source, count(*) AS n, round(log2(15.0), 5) AS total, round(max(weight), 6) AS top, degree, mass FROM w JOIN share USING (source) GROUP BY ALL""",
        "run_curve": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events),
s AS (SELECT *, max(CASE WHEN k % 10 = 0 AND event_id % 17 <> 0 THEN k END) OVER (PARTITION BY user_id ORDER BY k) AS started FROM e),
p AS (SELECT user_id, event_type AS model, CAST(k % 10 AS DOUBLE) AS pct, (event_id % 500) / (user_id + 1000.0::DOUBLE) * 100 AS x, user_id % 3 = 0 AS reg, value / 100.0::DOUBLE AS f, value / 400.0::DOUBLE AS fs, value / 50.0::DOUBLE AS r, value / 20.0::DOUBLE AS rs
FROM s WHERE k % 10 <> 0 AND event_type IN ('click', 'view', 'error') AND event_id % 17 <> 0 AND started IS NOT NULL)
SELECT user_id, model, pct, round(x, 6) AS x, round(CASE WHEN reg THEN r ELSE f END, 6) AS mean, round(CASE WHEN reg THEN r - rs ELSE greatest(0, f - fs) END, 6) AS low, round(CASE WHEN reg THEN r + rs ELSE least(1, f + fs) END, 6) AS high FROM p""",
        "mlp_regression": _with("SELECT idx, round(abs(emb[1]) * 8 + emb[2] * emb[3] * 40 + CASE WHEN emb[4] > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END, 6) AS target, true AS predicted FROM px WHERE idx % 5 = 0"),
        "point_fetch": _with(AT, """t AS (SELECT *, CAST(py // 8 * 4 + px // 8 AS INTEGER) AS tile FROM placed),
q AS (SELECT idx AS point, CASE WHEN idx % 17 = 0 THEN 95.0::DOUBLE WHEN idx % 23 <> 0 THEN lat - 0.003::DOUBLE END AS lat, CASE WHEN idx % 19 = 0 THEN lon + 0.003::DOUBLE + 10 ELSE lon + 0.003::DOUBLE END AS lon, tile AS own FROM t),
b AS (SELECT *, lat IS NOT NULL AND lat <= 90 AS good, idx_far AS far FROM (SELECT q.*, point % 19 = 0 AS idx_far FROM q)),
o AS (SELECT *, CASE WHEN NOT good THEN 'bad request' WHEN far THEN 'no coverage' WHEN own % 5 = 3 THEN 'timed out' WHEN own % 5 = 4 THEN 'failed' ELSE 'ok' END AS status,
  1.5 / 111.32::DOUBLE AS dy, 1.5 / (111.32::DOUBLE * cos(radians(lat))) AS dx FROM b),
hit AS (SELECT point, count(*) AS n, CAST(sum(idx) AS BIGINT) AS total FROM o JOIN t ON t.tile = o.own AND t.lon BETWEEN o.lon - dx AND o.lon + dx AND t.lat BETWEEN o.lat - dy AND o.lat + dy WHERE status = 'ok' GROUP BY point)""",
            """SELECT point, status, CASE WHEN good AND NOT far THEN own END AS tile, CASE WHEN status = 'ok' AND own % 2 = 0 THEN round(-1.0 + (own % 4) * 8 * 0.01::DOUBLE, 6) END AS origin_lon,
CASE WHEN good THEN round(lon - dx, 6) END AS west, CASE WHEN good THEN round(lat + dy, 6) END AS north, coalesce(n, 0) AS n, total FROM o LEFT JOIN hit USING (point)"""),
        "name_rules": """WITH n AS (SELECT *, event_type || CASE WHEN event_id % 7 = 0 THEN ' x' ELSE '' END AS base, CASE WHEN event_id % 3 = 0 THEN '' ELSE '_v' || (event_id % 20) END AS tail FROM events),
h AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(base || tail, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: ((a * 31 + b + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS hashed FROM n)
SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN 'u' || user_id || '_x_at_' || event_type || '-org_net' END AS folder, event_id % 7 <> 0 AS valid, base, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 20 END AS INTEGER) AS variant,
  CASE event_id % 4 WHEN 0 THEN round((event_id % 256) / 255.0::DOUBLE, 6) WHEN 1 THEN round(170 / 255.0::DOUBLE, 6) WHEN 2 THEN round((event_id % 256) / 255.0::DOUBLE, 6) END AS red, CAST(abs(hashed) % 20 AS INTEGER) AS palette FROM h""",
        "pixel_table": _with(CHANGED, "SELECT idx, round(emb[1], 6) AS first FROM year2 WHERE idx % 3 = 1 AND px >= 3 AND px < 20 AND py >= 2 AND py < 15"),
        "array_files": _with("SELECT idx, CAST(len(emb) AS INTEGER) AS width, round(emb[1], 6) AS first, round(list_sum(emb), 4) AS total FROM px"),
        "codebook_table": _with(STAGES, "SELECT t.idx, round(sum(a.value), 5) AS total FROM tiled t JOIN first a ON a.tile = t.tile AND a.code = t.i1 GROUP BY t.idx"),
        "label_file": """SELECT CASE WHEN event_id % 4 = 0 THEN 'a, "' || event_type || '"' || chr(10) || 'b' ELSE event_type END AS name, CAST(event_id % 3 AS VARCHAR) AS code, count(*) AS n, round(sum(value), 4) AS lat, round(sum(user_id::DOUBLE), 4) AS lon FROM events WHERE event_id % 6 <> 0 GROUP BY 1, 2""",
        "event_file": "SELECT event_type AS event, CASE WHEN event_id % 3 <> 0 THEN 'm' || (user_id % 5) END AS model, count(*) AS n, round(sum(value), 4) AS score FROM events WHERE event_type <> 'heartbeat' GROUP BY 1, 2",
        "geojson_extent": _with("spots(lon, lat) AS (SELECT CASE WHEN px < 3 THEN px - 3 - 0.25::DOUBLE ELSE px - 3 + 0.25 END, -(py + 0.5::DOUBLE) FROM px UNION ALL SELECT px, 95 FROM px UNION ALL SELECT -(px % 7), py % 80 FROM px)",
            "SELECT min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM spots WHERE abs(lat) <= 90 AND abs(lon) <= 180"),
        "place_keys": _with(AT, "SELECT idx, printf('%.6f,%.6f', lat, lon) AS key, label AS colour FROM placed WHERE idx % 6 = 0"),
        "class_map": _with(NEIGHBOURS, "c AS (SELECT label, row_number() OVER (ORDER BY label) AS class_id FROM (SELECT DISTINCT label FROM train))",
            "SELECT px, py, CAST(c.class_id AS INTEGER) AS class_id FROM predicted p JOIN px USING (idx) JOIN c ON c.label = p.prediction"),
        "coverage": _with("t AS (SELECT CAST(2018 + idx % 7 AS INTEGER) AS year, px * 0.1::DOUBLE AS w, py * 0.1::DOUBLE AS s FROM px)",
            "SELECT CAST(y AS INTEGER) AS year, count(t.year) AS n_tiles FROM range(2018, 2026) r(y) LEFT JOIN t ON t.year = y AND w < 1.45 AND w + 0.1::DOUBLE > 0.35 AND s < 1.35 AND s + 0.1::DOUBLE > 0.25 GROUP BY y"),
        "tile_cleanup": _with("t AS (SELECT idx AS tile, px * 0.1::DOUBLE AS w, py * 0.1::DOUBLE AS s FROM px)",
            "SELECT tile FROM t WHERE w < 0.95 AND w + 0.1::DOUBLE > 0.05 AND s < 0.75 AND s + 0.1::DOUBLE > 0.05 AND NOT (w < 1.55 AND w + 0.1::DOUBLE > 0.55 AND s < 1.35 AND s + 0.1::DOUBLE > 0.35)"),
        "viewport_list": """WITH v AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 2 <> 0 OR user_id % 4 = 0),
l AS (SELECT user_id AS id, CAST(2018 + event_id % 5 AS INTEGER) AS year, event_id % 6 AS level FROM events), r(y) AS (VALUES (2018), (2019), (2021), (2023)),
a AS (SELECT id, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS available FROM l WHERE level = 0 AND year IN (SELECT y FROM r) GROUP BY id),
m AS (SELECT v.id, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS missing FROM v, r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = v.id AND l.year = y AND level = 0) GROUP BY v.id),
y AS (SELECT id, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR) DESC) AS years FROM l WHERE level = 0 GROUP BY id)
SELECT id AS viewport_id, id % 5 <> 0 AND EXISTS (SELECT 1 FROM l WHERE l.id = v.id AND l.year IN (SELECT y FROM r)) AS has_vectors, available IS NOT NULL AS has_pyramids, coalesce(available, '') AS available, coalesce(missing, '') AS missing, coalesce(years, '') AS years
FROM v LEFT JOIN a USING (id) LEFT JOIN m USING (id) LEFT JOIN y USING (id)""",
        "storage_sizes": "SELECT user_id, round(sum(CAST(trunc(value * 100000) AS BIGINT)) / 1048576, 1) AS size_mb, round(sum(CAST(trunc(value * 100000) AS BIGINT)) / 1048576, 1) + 40 <= 100 AS fits FROM events GROUP BY user_id",
    }
