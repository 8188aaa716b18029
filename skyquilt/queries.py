"""The registered queries of the spatial and point-cloud operators and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.config import Camera, ClassifyConfig, ScreeningConfig
from skyquilt.functions import colour, geometry
from skyquilt.operators import cluster, compare, learn, metrics, neighbours, network, points, screening
from skyquilt.plans import adapters as A
from skyquilt.plans.survey import extract_buildings, screen
from skyquilt.sources import demo_scene, image_meta, pos_csv
from skyquilt.storage import saved

QUERIES: dict = {}
SQL: dict = {}
CONFIG = ScreeningConfig(threshold=0.002)
EPS, CORE = 2.0, 8


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH RECURSIVE " + A.SQL.strip() + ",\n" + sql.strip() if not sql.lstrip().startswith("SELECT") else "WITH RECURSIVE " + A.SQL.strip() + "\n" + sql.strip()
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _prints(spark: SparkSession, sf: str) -> DataFrame:
    return screening.footprints(A.poses(spark, sf), Camera())


def _covered(spark: SparkSession, sf: str):
    prints = saved(_prints(spark, sf))
    grid = screening.make_grid(*screening.study_area(prints, CONFIG), CONFIG.grid_size)
    return prints, grid, saved(screening.coverage(prints, grid))


FOOT = """
corner(k, u, v) AS (VALUES (0, 0, 0), (1, 8192, 0), (2, 8192, 5460), (3, 0, 5460)),
ray AS (SELECT p.*, k, (u - 4096) / (35 * 8192 / 36::DOUBLE) AS dx, (v - 2730) / (35 * 5460 / 24::DOUBLE) AS dy FROM pos p, corner),
turned AS (SELECT *, cos(radians(omega)) * dx - sin(radians(omega)) * dy AS a, sin(radians(omega)) * dx + cos(radians(omega)) * dy AS b FROM ray),
tilted AS (SELECT *, sin(radians(phi)) - cos(radians(phi)) * b AS q, -(sin(radians(phi)) * b + cos(radians(phi))) AS dz FROM turned),
hit AS (SELECT *, CASE WHEN abs(dz) >= 1e-9 THEN -z / dz END AS t FROM tilted),
ground AS (SELECT idx, k, x + t * (cos(radians(kappa)) * a + sin(radians(kappa)) * q) AS gx, y + t * (cos(radians(kappa)) * q - sin(radians(kappa)) * a) AS gy FROM hit WHERE t >= 0),
prints AS (
  SELECT idx, max(gx) FILTER (k = 0) AS x0, max(gy) FILTER (k = 0) AS y0, max(gx) FILTER (k = 1) AS x1, max(gy) FILTER (k = 1) AS y1,
         max(gx) FILTER (k = 2) AS x2, max(gy) FILTER (k = 2) AS y2, max(gx) FILTER (k = 3) AS x3, max(gy) FILTER (k = 3) AS y3,
         min(gx) AS xmin, min(gy) AS ymin, max(gx) AS xmax, max(gy) AS ymax
  FROM ground GROUP BY idx HAVING count(*) = 4),
shaped AS (SELECT *, abs(x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y0 - x0 * y3) / 2 AS area FROM prints)
"""
COVER = FOOT.rstrip() + """,
area AS (SELECT min(xmin) - 50 AS ax, min(ymin) - 50 AS ay, max(xmax) + 50 AS bx, max(ymax) + 50 AS bz FROM shaped WHERE area >= 1e-6),
grid AS (SELECT ax + 10 AS sx, ay + 10 AS sy, (ax + 10 + 20) - (ax + 10) AS gx, (ay + 10 + 20) - (ay + 10) AS gy, CAST(ceil((bx - (ax + 10)) / 20) AS BIGINT) AS nx, CAST(ceil((bz - (ay + 10)) / 20) AS BIGINT) AS ny FROM area),
cell AS (SELECT ix, iy, sx + ix * gx AS px, sy + iy * gy AS py FROM grid, LATERAL (SELECT unnest(range(nx)) AS ix), LATERAL (SELECT unnest(range(ny)) AS iy)),
near AS (SELECT s.*, ix, iy, px, py FROM shaped s JOIN cell ON area >= 1e-6 AND px BETWEEN xmin - 1e-6 AND xmax + 1e-6 AND py BETWEEN ymin - 1e-6 AND ymax + 1e-6),
edge AS (SELECT idx, ix, iy, px, py, unnest([[x0, y0, x1, y1], [x1, y1, x2, y2], [x2, y2, x3, y3], [x3, y3, x0, y0]]) AS e FROM near),
side AS (SELECT *, (e[3] - e[1]) * (py - e[2]) - (e[4] - e[2]) * (px - e[1]) AS cr FROM edge),
cover AS (
  SELECT idx, ix, iy FROM side GROUP BY idx, ix, iy
  HAVING count(*) FILTER ((e[2] > py) <> (e[4] > py) AND px < e[1] + (py - e[2]) * (e[3] - e[1]) / (e[4] - e[2])) % 2 = 1
      OR count(*) FILTER (abs(cr) <= 1e-9 AND px BETWEEN least(e[1], e[3]) - 1e-9 AND greatest(e[1], e[3]) + 1e-9 AND py BETWEEN least(e[2], e[4]) - 1e-9 AND greatest(e[2], e[4]) + 1e-9) > 0)
"""
SCORE = COVER.rstrip() + """,
cells AS (SELECT nx * ny AS j FROM grid),
counted AS (SELECT s.idx, count(c.idx) AS covered FROM shaped s LEFT JOIN cover c ON s.idx = c.idx WHERE s.area >= 1e-6 GROUP BY s.idx),
ranked AS (SELECT *, row_number() OVER (ORDER BY covered DESC, idx) AS rk FROM counted),
owner AS (SELECT ix, iy, min(rk) AS rk FROM cover JOIN ranked USING (idx) GROUP BY ix, iy),
owned AS (SELECT rk, count(*) AS own FROM owner GROUP BY rk),
scores AS (SELECT idx, covered, covered / j AS base_ratio, coalesce(own, 0) / j AS new_ratio, 0.5::DOUBLE * (covered / j) + 0.5::DOUBLE * (coalesce(own, 0) / j) AS score
           FROM ranked LEFT JOIN owned USING (rk), cells)
"""


@query(FOOT + "SELECT idx, " + ", ".join(f"round({a}{i}, 6) + 0.0 AS {a}{i}" for i in range(4) for a in "xy") + " FROM shaped WHERE area >= 1e-6")
def footprints(spark, sf):
    return rounded(_prints(spark, sf).select("idx", *[F.col("polygon")[i][a].alias(f"{a}{i}") for i in range(4) for a in "xy"]))


@query(FOOT + "SELECT idx, round(area, 4) AS area, round(xmin, 6) + 0.0 AS xmin, round(ymin, 6) + 0.0 AS ymin, round(xmax, 6) + 0.0 AS xmax, round(ymax, 6) + 0.0 AS ymax FROM shaped WHERE area >= 1e-6")
def footprint_area(spark, sf):
    return rounded(_prints(spark, sf).drop("polygon")).withColumn("area", F.round("area", 4))


@query(COVER + "SELECT idx, ix, iy FROM cover")
def coverage_pairs(spark, sf):
    return _covered(spark, sf)[2]


def _scores(spark, sf):
    prints, grid, cover = _covered(spark, sf)
    return screening.contribution(prints, cover, grid.cells), cover


@query(SCORE + "SELECT idx, covered, round(base_ratio, 9) AS base_ratio, round(new_ratio, 9) AS new_ratio, round(score, 9) AS score FROM scores")
def coverage_scores(spark, sf):
    return rounded(_scores(spark, sf)[0], 9)


@query(SCORE + "SELECT idx, score >= 0.002 AS keep FROM scores")
def screening_keep(spark, sf):
    return screening.select_images(_scores(spark, sf)[0], CONFIG.threshold).select("idx", "keep")


@query(SCORE + "SELECT count(*) AS n_images, count(*) FILTER (score >= 0.002) AS n_kept, count(*) FILTER (score < 0.002) AS n_removed, round(count(*) FILTER (score < 0.002) * 100 / count(*), 6) AS removed_pct FROM scores")
def screening_summary(spark, sf):
    return screening.summary(screening.select_images(_scores(spark, sf)[0], CONFIG.threshold))


@query(SCORE + """, kept_cell AS (SELECT DISTINCT ix, iy FROM cover JOIN scores USING (idx) WHERE score >= 0.002),
open_pair AS (SELECT c.idx, c.ix, c.iy FROM cover c JOIN scores s USING (idx) WHERE s.score < 0.002 AND NOT EXISTS (SELECT 1 FROM kept_cell k WHERE k.ix = c.ix AND k.iy = c.iy)),
greedy(idx, ix, iy, best) AS (
  SELECT idx, ix, iy, first_value(idx) OVER (ORDER BY gain DESC, idx) FROM (SELECT *, count(*) OVER (PARTITION BY idx) AS gain FROM open_pair)
  UNION ALL
  SELECT idx, ix, iy, first_value(idx) OVER (ORDER BY gain DESC, idx)
  FROM (SELECT idx, ix, iy, count(*) OVER (PARTITION BY idx) AS gain FROM (SELECT idx, ix, iy, bool_or(idx = best) OVER (PARTITION BY ix, iy) AS closed FROM greedy) WHERE NOT closed))
SELECT s.idx, s.score >= 0.002 OR s.idx IN (SELECT best FROM greedy) AS keep, s.idx IN (SELECT best FROM greedy) AS added FROM scores s""")
def coverage_repair(spark, sf):
    """The sequential choice: in SQL one image a step."""
    scores, cover = _scores(spark, sf)
    return screening.repair_gaps(screening.select_images(scores, CONFIG.threshold), cover).select("idx", "keep", "added")


@query(SCORE + """SELECT idx, covered AS covered_grids, CAST(j AS BIGINT) AS total_grids, printf('%.6f', base_ratio) AS base_ratio, printf('%.6f', new_ratio) AS new_ratio, printf('%.6f', score) AS score,
  CASE WHEN score >= 0.002 THEN 'yes' ELSE 'no' END AS keep FROM scores, cells""")
def coverage_report(spark, sf):
    prints, grid, cover = _covered(spark, sf)
    kept = screening.select_images(screening.contribution(prints, cover, grid.cells), CONFIG.threshold)
    return pos_csv.report_text(kept, grid.cells).withColumn("total_grids", F.col("total_grids").cast("long"))


@query("""ll AS (SELECT idx, 120.3::DOUBLE + x / 111320 AS lon, 31.2::DOUBLE + y / 110540 AS lat FROM pos), o AS (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM ll)
SELECT idx, round((lon - lon0) * 111320 * cos(radians(lat0)), 4) + 0.0 AS x, round((lat - lat0) * 110540, 4) + 0.0 AS y FROM ll, o""")
def local_coords(spark, sf):
    p = A.poses(spark, sf).select("idx", (F.lit(120.3) + F.col("x") / 111320).alias("lon"), (F.lit(31.2) + F.col("y") / 110540).alias("lat"))
    return rounded(screening.localise(p).select("idx", "x", "y"), 4)


@query("""y AS (SELECT idx, CASE WHEN idx % 5 = 0 THEN NULL ELSE idx * 37 % 720 - 360.5::DOUBLE END AS g, CASE WHEN idx % 7 = 0 THEN NULL ELSE CAST(idx * 11 % 400 AS DOUBLE) END AS f FROM pos)
SELECT idx, coalesce(g, f) - 360 * floor(coalesce(g, f) / 360) AS yaw, coalesce(g + f, g, f) - 360 * floor(coalesce(g + f, g, f) / 360) AS yaw_relative FROM y""")
def yaw_normalise(spark, sf):
    i = F.col("idx")
    g, f = F.when(i % 5 != 0, i * 37 % 720 - 360.5), F.when(i % 7 != 0, (i * 11 % 400).cast("double"))
    return A.poses(spark, sf).select("idx", geometry.yaw(g, f).alias("yaw"), geometry.yaw(g, f, relative=True).alias("yaw_relative"))


@query("""i AS (SELECT idx, kappa + idx % 13 AS yaw, CASE WHEN idx % 3 = 0 THEN -60::DOUBLE ELSE -90::DOUBLE END AS pitch FROM pos),
h AS (SELECT *, unnest([0, 90, 180, 270])::DOUBLE AS heading FROM i WHERE pitch = -60),
d AS (SELECT *, abs((yaw - heading + 180) - 360 * floor((yaw - heading + 180) / 360) - 180) AS off FROM h)
SELECT heading, idx, yaw, off FROM (SELECT *, row_number() OVER (PARTITION BY heading ORDER BY off, idx) AS rk FROM d) WHERE rk = 1""")
def nearest_yaw_images(spark, sf):
    p = A.poses(spark, sf)
    return compare.nearest_yaws(p.select("idx", (F.col("kappa") + F.col("idx") % 13).alias("yaw"), F.when(F.col("idx") % 3 == 0, -60.0).otherwise(-90.0).alias("pitch")))


@query("""n AS (SELECT unnest(range(112)) AS s), v AS (SELECT s // 16 AS line, s % 16 AS at_, w FROM n, (SELECT unnest([0, 1]) AS w)),
d AS (SELECT (line * 16 + at_) * 2 + w AS idx, printf('IMG_%05d', (line * 16 + at_) * 2 + w + 1) AS name, at_ * 60 - w * 20 AS x, line * 120 + CASE WHEN line % 2 = 1 THEN 30 ELSE -30 END AS y, w * 25 AS phi, w * 90 AS kappa FROM v
 UNION ALL SELECT 224 + k, printf('FAR_%02d', k), 1200 + 80 * k, 900 + 100 * k, 0, 0 FROM (SELECT unnest(range(6)) AS k))
SELECT CAST(idx AS BIGINT) AS idx, name, round(120.3::DOUBLE + x / 111320, 9) AS lon, round(31.2::DOUBLE + y / 110540, 9) AS lat, 120::DOUBLE AS z, 0::DOUBLE AS omega, phi::DOUBLE AS phi, kappa::DOUBLE AS kappa FROM d""")
def demo_survey(spark, sf):
    return rounded(pos_csv.demo_pos(spark).withColumn("idx", F.col("idx").cast("long")), 9)


# --- voxels, ground and classes -------------------------------------------------

@query("""k AS (SELECT *, CAST(floor(x / 5) AS BIGINT) AS kx, CAST(floor(y / 5) AS BIGINT) AS ky, CAST(floor(z / 5) AS BIGINT) AS kz FROM cloud),
m AS (SELECT kx, ky, kz, label, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY count(*) DESC, label) AS rk FROM k GROUP BY kx, ky, kz, label)
SELECT kx, ky, kz, count(*) AS n, """ + ", ".join(f"round(avg({c}), 6) + 0.0 AS {c}" for c in "xyzrgb") + """, any_value(m.label) AS label FROM k JOIN m USING (kx, ky, kz) WHERE m.rk = 1 GROUP BY kx, ky, kz""")
def voxel_mean(spark, sf):
    return rounded(points.voxel_mean(A.embedded_cloud(spark, sf), 5.0))


@query("""k AS (SELECT label, CAST(floor(x / 5) AS BIGINT) AS kx, CAST(floor(y / 5) AS BIGINT) AS ky, CAST(floor(z / 2) AS BIGINT) AS kz FROM lines),
c AS (SELECT kx, ky, kz, label, count(*) AS n FROM k GROUP BY ALL)
SELECT kx, ky, kz, CAST(sum(n) AS BIGINT) AS n, CAST(split_part(max(printf('%012d:%d', n, 9 - label)), ':', 2) AS INTEGER) AS inv FROM c GROUP BY kx, ky, kz""".replace("CAST(split_part(max(printf('%012d:%d', n, 9 - label)), ':', 2) AS INTEGER) AS inv", "CAST(9 - CAST(split_part(max(printf('%012d:%d', n, 9 - label)), ':', 2) AS INTEGER) AS INTEGER) AS label"))
def voxel_mode(spark, sf):
    p = A.line_cloud(spark, sf).select("label", F.floor(F.col("x") / 5).alias("kx"), F.floor(F.col("y") / 5).alias("ky"), F.floor(F.col("z") / 2).alias("kz"))
    return p.groupBy(*points.KEY).agg(F.count("*").alias("n"), F.mode("label", True).alias("label"))


@query("""o AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM lines),
k AS (SELECT *, CAST(floor((x - x0) / 5) AS BIGINT) AS kx, CAST(floor((y - y0) / 5) AS BIGINT) AS ky, CAST(floor((z - z0) / 5) AS BIGINT) AS kz FROM lines, o)
SELECT kx, ky, kz, l_orderkey, l_linenumber, l_partkey, label, round(y, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY idx) AS rk FROM k) WHERE rk = 1""")
def voxel_first(spark, sf):
    return rounded(points.voxel_first(A.line_cloud(spark, sf), 5.0).select(*points.KEY, "l_orderkey", "l_linenumber", "l_partkey", "label", "y"))


@query("""SELECT CAST(floor(x / 5) AS BIGINT) AS ix, CAST(floor(y / 5) AS BIGINT) AS iy, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(quantile_cont(z, 0.05), 6) END AS ground FROM lines GROUP BY ix, iy""")
def ground_percentile(spark, sf):
    return rounded(points.ground_cells(A.line_cloud(spark, sf), 5.0, 0.05, 5))


@query("""c AS (SELECT CAST(floor(x / 4) AS BIGINT) AS ix, CAST(floor(y / 4) AS BIGINT) AS iy, count(*) AS n, quantile_cont(z, 0.05) AS q FROM cloud GROUP BY 1, 2),
g AS (SELECT ix, iy, q FROM c WHERE n >= 3),
h AS (SELECT a.ix, a.iy, g.q, row_number() OVER (PARTITION BY a.ix, a.iy ORDER BY (a.ix - g.ix) * (a.ix - g.ix) + (a.iy - g.iy) * (a.iy - g.iy), g.ix, g.iy) AS rk FROM c a, g)
SELECT p.idx, round(h.q, 6) + 0.0 AS ground, round(p.z - h.q, 6) + 0.0 AS height FROM cloud p JOIN h ON CAST(floor(p.x / 4) AS BIGINT) = h.ix AND CAST(floor(p.y / 4) AS BIGINT) = h.iy WHERE h.rk = 1""")
def height_above_ground(spark, sf):
    return rounded(points.height_above_ground(A.embedded_cloud(spark, sf), 4.0, 0.05, 3).select("idx", "ground", "height"))


@query("SELECT CAST(floor(x / 20) AS BIGINT) AS kx, CAST(floor(y / 20) AS BIGINT) AS ky, CAST(floor(z / 20) AS BIGINT) AS kz, count(*) AS n, " + ", ".join(f"round(covar_pop({a}, {b}), 6) + 0.0 AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM cloud GROUP BY 1, 2, 3")
def voxel_cov(spark, sf):
    return rounded(points.voxel_moments(A.embedded_cloud(spark, sf), 20.0, "absolute"))


def _turned(p: str, q: str, r: str, table: str) -> str:
    """A Jacobi rotation of the matrix m and of the vectors' heights h that clears one element."""
    m = lambda a, b: "m" + "".join(sorted(a + b))
    t = f"CASE WHEN {m(p, q)} = 0 THEN 0 ELSE CASE WHEN {m(q, q)} >= {m(p, p)} THEN 1 ELSE -1 END * 2 * {m(p, q)} / (abs({m(q, q)} - {m(p, p)}) + sqrt(({m(q, q)} - {m(p, p)}) * ({m(q, q)} - {m(p, p)}) + 4 * {m(p, q)} * {m(p, q)})) END"
    return (f"(SELECT kx, ky, kz, n, {m(p, p)} - t * {m(p, q)} AS {m(p, p)}, {m(q, q)} + t * {m(p, q)} AS {m(q, q)}, 0::DOUBLE AS {m(p, q)}, {m(r, r)}, c * {m(p, r)} - s * {m(q, r)} AS {m(p, r)}, s * {m(p, r)} + c * {m(q, r)} AS {m(q, r)}, "
            f"c * h{p} - s * h{q} AS h{p}, s * h{p} + c * h{q} AS h{q}, h{r} FROM (SELECT *, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s FROM (SELECT *, {t} AS t FROM {table})))")


def shape_sql(size: int) -> str:
    """The eigenvalues and normals of voxels by Jacobi rotations."""
    sweeps = "moments"
    names = []
    for k in range(8):
        names.append(f"sweep{k} AS (SELECT * FROM {_turned('y', 'z', 'x', _turned('x', 'z', 'y', _turned('x', 'y', 'z', sweeps)))})")
        sweeps = f"sweep{k}"
    return f"""corner3 AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM cloud),
vk AS (SELECT p.*, CAST(floor((x - x0) / {size}) AS BIGINT) AS kx, CAST(floor((y - y0) / {size}) AS BIGINT) AS ky, CAST(floor((z - z0) / {size}) AS BIGINT) AS kz FROM cloud p, corner3),
moments AS (SELECT kx, ky, kz, count(*) AS n, covar_pop(x, x) AS mxx, covar_pop(x, y) AS mxy, covar_pop(x, z) AS mxz, covar_pop(y, y) AS myy, covar_pop(y, z) AS myz, covar_pop(z, z) AS mzz, 0::DOUBLE AS hx, 0::DOUBLE AS hy, 1::DOUBLE AS hz FROM vk GROUP BY kx, ky, kz),
{(',' + chr(10)).join(names)},
eigen AS (SELECT kx, ky, kz, n, list_sort([{{'e': mxx, 'h': hx}}, {{'e': myy, 'h': hy}}, {{'e': mzz, 'h': hz}}]) AS v FROM {sweeps}),
cut AS (SELECT kx, ky, kz, n, v, v[3].e AS e2, CASE WHEN v[1].e <= 1e-18::DOUBLE * v[3].e THEN 0 ELSE v[1].e END AS e0, CASE WHEN v[2].e <= 1e-18::DOUBLE * v[3].e THEN 0 ELSE v[2].e END AS e1 FROM eigen),
shape AS (
  SELECT kx, ky, kz, n, (e1 - e0) / greatest(e2, 1e-12::DOUBLE) AS planarity, sqrt(e0) AS roughness,
         CASE WHEN e2 <= 0 OR e2 - e0 <= 1e-9::DOUBLE * e2 THEN 1 WHEN e1 - e0 <= 1e-9::DOUBLE * e2 THEN 1 - sqrt(v[1].h * v[1].h + v[2].h * v[2].h) ELSE 1 - abs(v[1].h) END AS verticality
  FROM cut)
"""


@query(shape_sql(20) + "SELECT kx, ky, kz, n, round(planarity, 6) + 0.0 AS planarity, round(roughness, 6) + 0.0 AS roughness, round(verticality, 6) + 0.0 AS verticality FROM shape")
def voxel_eigen(spark, sf):
    return rounded(points.voxel_shape(points.voxel_moments(A.embedded_cloud(spark, sf), 20.0)).select(*points.KEY, "n", "planarity", "roughness", "verticality"))


CLASSIFY = ClassifyConfig(ground_cell=4.0, ground_min_points=3, voxel=10.0)


@query(shape_sql(10) + """, gc AS (SELECT CAST(floor(x / 4) AS BIGINT) AS ix, CAST(floor(y / 4) AS BIGINT) AS iy, count(*) AS n, quantile_cont(z, 0.05) AS q FROM cloud GROUP BY 1, 2),
gg AS (SELECT ix, iy, q FROM gc WHERE n >= 3),
gh AS (SELECT a.ix, a.iy, gg.q, row_number() OVER (PARTITION BY a.ix, a.iy ORDER BY (a.ix - gg.ix) * (a.ix - gg.ix) + (a.iy - gg.iy) * (a.iy - gg.iy), gg.ix, gg.iy) AS rk FROM gc a, gg),
f AS (SELECT p.idx, p.r, p.g, p.b, p.z - gh.q AS h, s.planarity AS plan, s.roughness AS rough, s.verticality AS vert FROM vk p JOIN shape s USING (kx, ky, kz) JOIN gh ON CAST(floor(p.x / 4) AS BIGINT) = gh.ix AND CAST(floor(p.y / 4) AS BIGINT) = gh.iy WHERE gh.rk = 1),
c AS (SELECT *, 2 * g - r - b AS exg, g - greatest(r, b) AS dom, (r + g + b) / 3 AS bright, greatest(r, g, b) - least(r, g, b) AS sat FROM f)
SELECT idx, round(h, 6) + 0.0 AS height, round(plan, 6) + 0.0 AS planarity, round(rough, 6) + 0.0 AS roughness, round(vert, 6) + 0.0 AS verticality, CASE WHEN (exg > 0.03 AND dom > 0.01) OR (h > 0.4 AND exg > 0.01 AND rough > 0.06) THEN 3
  WHEN h > 1.5 AND ((plan > 0.35 AND rough < 0.15) OR (vert > 0.25 AND sat < 0.18)) THEN 1
  WHEN h <= 0.25 AND bright < 0.45 AND rough < 0.05 AND sat < 0.10 THEN 2 WHEN h <= 0.25 AND r - g > 0.015 AND bright > 0.25 THEN 4 WHEN h <= 0.25 OR h > 0.20 THEN 5 ELSE 0 END AS class FROM c""")
def classify_points(spark, sf):
    return rounded(points.classify(A.embedded_cloud(spark, sf), CLASSIFY).select("idx", "height", "planarity", "roughness", "verticality", "class"))


@query("""f AS (SELECT idx, r, g, b, z / 10 AS h, abs(x) / 40 AS plan, abs(y) / 200 AS rough, abs(z) / 40 AS vert FROM cloud),
c AS (SELECT *, 2 * g - r - b AS exg, g - greatest(r, b) AS dom, (r + g + b) / 3 AS bright, greatest(r, g, b) - least(r, g, b) AS sat FROM f)
SELECT idx, CASE WHEN (exg > 0.03 AND dom > 0.01) OR (h > 0.4 AND exg > 0.01 AND rough > 0.06) THEN 3
  WHEN h > 1.5 AND ((plan > 0.35 AND rough < 0.15) OR (vert > 0.25 AND sat < 0.18)) THEN 1
  WHEN h <= 0.25 AND bright < 0.45 AND rough < 0.05 AND sat < 0.10 THEN 2 WHEN h <= 0.25 AND r - g > 0.015 AND bright > 0.25 THEN 4 WHEN h <= 0.25 OR h > 0.20 THEN 5 ELSE 0 END AS class FROM c""")
def class_rules(spark, sf):
    p = A.embedded_cloud(spark, sf).select("idx", "r", "g", "b", (F.col("z") / 10).alias("height"), (F.abs("x") / 40).alias("planarity"), (F.abs("y") / 200).alias("roughness"), (F.abs("z") / 40).alias("verticality"))
    return p.select("idx", points.class_rules().alias("class"))


@query("SELECT idx, round(2 * g - r - b, 6) + 0.0 AS exg, round(g - greatest(r, b), 6) + 0.0 AS dominance, round((r + g + b) / 3, 6) + 0.0 AS brightness, round(greatest(r, g, b) - least(r, g, b), 6) + 0.0 AS saturation FROM cloud")
def colour_indices(spark, sf):
    rgb = [F.col(c) for c in "rgb"]
    p = A.embedded_cloud(spark, sf)
    return rounded(p.select("idx", *[f(*rgb).alias(n) for n, f in (("exg", colour.excess_green), ("dominance", colour.green_dominance), ("brightness", colour.brightness), ("saturation", colour.saturation))]))


QS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {q}::DOUBLE AS q, round(quantile_cont({c}, {q}), 6) + 0.0 AS value FROM cloud" for c in ("x", "z", "g") for q in QS))
def feature_quantiles(spark, sf):
    return rounded(points.feature_quantiles(A.embedded_cloud(spark, sf), ["x", "z", "g"], QS))


@query("SELECT d.label, count(l.label) AS n, round(count(l.label) * 100 / (SELECT count(*) FROM lines), 6) AS percent FROM (SELECT unnest(range(9))::INTEGER AS label) d LEFT JOIN lines l USING (label) GROUP BY d.label")
def class_counts(spark, sf):
    return points.class_counts(A.line_cloud(spark, sf), 9)


@query("SELECT label, n, printf('%d: %d of %d', label, n, t) AS line FROM (SELECT label, count(*) AS n, (SELECT count(*) FROM lines) AS t FROM lines GROUP BY label)")
def class_report(spark, sf):
    counts = points.class_counts(A.line_cloud(spark, sf), 6).where("n > 0")
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", F.format_string("%d: %d of %d", "label", "n", "t").alias("line"))


@query("SELECT 'class' AS part, label AS place, printf('%d: %d (%.2f%%)', label, n, round(n * 100 / (SELECT count(*) FROM cloud), 6)) AS line FROM (SELECT d.label, count(c.label) AS n FROM (SELECT unnest(range(6))::INTEGER AS label) d LEFT JOIN cloud c USING (label) GROUP BY d.label)"
  + "".join(f" UNION ALL SELECT 'feature', {i}, '{c}: ' || " + " || ', ' || ".join(f"(SELECT printf('%.4f', quantile_cont({c}, {q})) FROM cloud)" for q in QS) for i, c in enumerate(("x", "z", "g")))
  + " UNION ALL SELECT 'parameter', 0, 'ground_cell=4.0' UNION ALL SELECT 'parameter', 1, 'voxel=10.0'")
def class_report_full(spark, sf):
    return points.class_report(A.embedded_cloud(spark, sf), 6, ["x", "z", "g"], {"voxel": CLASSIFY.voxel, "ground_cell": CLASSIFY.ground_cell}, "label")


@query("""ll AS (SELECT idx, 120.3::DOUBLE + x / 111320 AS lon, 31.2::DOUBLE + y / 110540 AS lat, z, omega, phi, kappa FROM pos), o AS (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM ll),
pos2 AS (SELECT idx, (lon - lon0) * 111320 * cos(radians(lat0)) AS x, (lat - lat0) * 110540 AS y, z, omega, phi, kappa FROM ll, o),
""" + SCORE.replace("FROM pos p", "FROM pos2 p") + "SELECT idx, covered, round(score, 9) AS score, score >= 0.002 AS keep FROM scores")
def screen_pos(spark, sf):
    """A whole screening run from degrees, without repair of gaps."""
    i = A.poses(spark, sf)
    pos = i.select("idx", (F.lit(120.3) + F.col("x") / 111320).alias("lon"), (F.lit(31.2) + F.col("y") / 110540).alias("lat"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), "z", "omega", "phi", "kappa")
    return rounded(screen(pos, replace(CONFIG, allow_gaps=True)).kept.select("idx", "covered", "score", "keep"), 9)


# --- metrics and comparisons ----------------------------------------------------

PRED = """j AS (SELECT quality AS label, toxic AS pred FROM labels)"""


def _judged(spark, sf):
    return A.table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("pred"))


@query(PRED + " SELECT label, pred, count(*) AS n FROM j WHERE label BETWEEN 0 AND 1 AND pred BETWEEN 0 AND 1 GROUP BY ALL")
def confusion(spark, sf):
    return metrics.confusion(_judged(spark, sf), 2)


KSQL = """kc AS (SELECT label, CAST((label + CASE WHEN l_suppkey % 4 = 0 THEN l_partkey % 6 ELSE 0 END) % 6 AS INTEGER) AS pred FROM lines),
cm AS (SELECT label, pred, count(*) AS n FROM kc GROUP BY ALL),
pc AS (SELECT d.label, coalesce((SELECT sum(n) FROM cm WHERE cm.label = d.label), 0) AS support, coalesce((SELECT sum(n) FROM cm WHERE cm.pred = d.label), 0) AS guessed,
  coalesce((SELECT sum(n) FROM cm WHERE cm.label = d.label AND cm.pred = d.label), 0) AS hit FROM (SELECT unnest(range(7))::INTEGER AS label) d),
pm AS (SELECT label, support, CASE WHEN support > 0 THEN hit / support END AS recall, CASE WHEN support + guessed - hit > 0 THEN hit / (support + guessed - hit) END AS iou FROM pc)
"""


def _six(spark, sf):
    wrong = F.when(F.col("l_suppkey") % 4 == 0, F.col("l_partkey") % 6).otherwise(0)
    return metrics.confusion(A.line_cloud(spark, sf).select("label", ((F.col("label") + wrong) % 6).cast("int").alias("pred")), 7)


@query(KSQL + "SELECT label, CAST(support AS BIGINT) AS support, round(recall, 9) AS recall, round(iou, 9) AS iou FROM pm")
def class_metrics(spark, sf):
    return rounded(metrics.class_metrics(_six(spark, sf), 7), 9)


@query(KSQL + "SELECT CAST((SELECT sum(n) FROM cm) AS BIGINT) AS judged, round((SELECT sum(n) FROM cm WHERE label = pred) / (SELECT sum(n) FROM cm), 9) AS oa, round(avg(recall), 9) AS macc, round(avg(iou), 9) AS miou FROM pm")
def seg_metrics(spark, sf):
    return rounded(metrics.overall(_six(spark, sf), 7), 9)


@query(KSQL + "SELECT label, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (pred = {k}), 0) AS BIGINT) AS p{k}" for k in range(6)) + " FROM cm GROUP BY label")
def confusion_wide(spark, sf):
    wide = metrics.confusion_wide(_six(spark, sf), 6)
    return wide.select("label", *[F.col(str(k)).alias(f"p{k}") for k in range(6)])


COMMON = """vb AS (SELECT kx, ky, kz, label FROM (SELECT label, CAST(floor(x / 2) AS BIGINT) AS kx, CAST(floor(y / 2) AS BIGINT) AS ky, CAST(floor(z / 2) AS BIGINT) AS kz, row_number() OVER (PARTITION BY 2, 3, floor(x / 2), floor(y / 2), floor(z / 2) ORDER BY idx) AS rk FROM lines WHERE l_orderkey % 2 = 0) WHERE rk = 1),
va AS (SELECT kx, ky, kz, label FROM (SELECT label, CAST(floor(x / 2) AS BIGINT) AS kx, CAST(floor(y / 2) AS BIGINT) AS ky, CAST(floor(z / 2) AS BIGINT) AS kz, row_number() OVER (PARTITION BY floor(x / 2), floor(y / 2), floor(z / 2) ORDER BY idx) AS rk FROM lines WHERE l_orderkey % 2 = 1) WHERE rk = 1),
cv AS (SELECT vb.label, va.label AS pred FROM vb JOIN va USING (kx, ky, kz))
"""


def _common(spark, sf):
    p = A.line_cloud(spark, sf)
    return compare.common_voxels(p.where("l_orderkey % 2 = 0"), p.where("l_orderkey % 2 = 1"), 2.0)


@query(COMMON + "SELECT label, pred, count(*) AS n FROM cv GROUP BY ALL")
def common_voxel_confusion(spark, sf):
    return metrics.confusion(_common(spark, sf), 6)


@query(COMMON + "SELECT count(*) AS common, count(*) FILTER (label = pred) AS agreeing, round(avg((label = pred)::INTEGER), 9) AS agreement FROM cv")
def agreement(spark, sf):
    return rounded(compare.agreement(_common(spark, sf)), 9)


@query("SELECT (SELECT count(*) FROM documents) AS points, count(DISTINCT d.doc_id) AS matched, round(count(DISTINCT d.doc_id) / (SELECT count(*) FROM documents), 9) AS matched_ratio FROM documents d JOIN labels l USING (doc_id)")
def matched_ratio(spark, sf):
    ids = lambda t: A.table(spark, sf, t).select(F.col("doc_id").alias("idx"))
    return rounded(compare.matched_ratio(ids("documents"), ids("labels")), 9)


BOXES = """mb AS (SELECT c_custkey AS id, (c_custkey * 7919 % 1000)::DOUBLE AS xmin, (c_custkey * 104729 % 1000)::DOUBLE AS ymin, c_custkey * 7919 % 1000 + 5::DOUBLE + c_custkey % 17 AS xmax, c_custkey * 104729 % 1000 + 4::DOUBLE + c_custkey % 23 AS ymax FROM customer),
rb AS (SELECT p_partkey AS id, (p_partkey * 6151 % 1000)::DOUBLE AS xmin, (p_partkey * 15485863 % 1000)::DOUBLE AS ymin, p_partkey * 6151 % 1000 + 6::DOUBLE + p_partkey % 13 AS xmax, p_partkey * 15485863 % 1000 + 5::DOUBLE + p_partkey % 19 AS ymax FROM part),
"""


def _boxes(spark, sf, table, key, a, b, w, h, m, n):
    k = F.col(key)
    x, y = (k * a % 1000).cast("double"), (k * b % 1000).cast("double")
    return A.table(spark, sf, table).select(k.alias("id"), x.alias("xmin"), y.alias("ymin"), (x + w + k % m).alias("xmax"), (y + h + k % n).alias("ymax"))


@query(BOXES + """pairs AS (SELECT m.id, r.id AS rid, (m.xmax - m.xmin) * (m.ymax - m.ymin) AS ma, (r.xmax - r.xmin) * (r.ymax - r.ymin) AS ra, greatest(least(m.xmax, r.xmax) - greatest(m.xmin, r.xmin), 0) * greatest(least(m.ymax, r.ymax) - greatest(m.ymin, r.ymin), 0) AS i FROM mb m JOIN rb r ON m.xmin < r.xmax AND r.xmin < m.xmax AND m.ymin < r.ymax AND r.ymin < m.ymax),
best AS (SELECT *, i / (ma + ra - i) AS iou, row_number() OVER (PARTITION BY id ORDER BY i / (ma + ra - i) DESC, rid) AS rk FROM pairs WHERE i > 0)
SELECT m.id, (m.xmax - m.xmin) * (m.ymax - m.ymin) AS model_area, coalesce(rid, -1) AS ref_id, ra AS ref_area, round(iou, 9) AS iou, round((ma - ra) / ra * 100, 6) + 0.0 AS deviation_pct FROM mb m LEFT JOIN (SELECT * FROM best WHERE rk = 1) b USING (id)""")
def box_iou_pairing(spark, sf):
    model = _boxes(spark, sf, "customer", "c_custkey", 7919, 104729, 5.0, 4.0, 17, 23)
    reference = _boxes(spark, sf, "part", "p_partkey", 6151, 15485863, 6.0, 5.0, 13, 19)
    return compare.best_boxes(model, reference, 32.0).na.fill(-1, ["ref_id"]).withColumns({"iou": F.round("iou", 9), "deviation_pct": F.round("deviation_pct", 6) + 0.0})


TILES = """tl AS (SELECT l_suppkey % 16 AS tile, x + l_suppkey % 16 % 4 * 40 AS x, y + l_suppkey % 16 // 4 * 40 AS y, z FROM lines)"""


def _tiled(spark, sf):
    t = F.col("l_suppkey") % 16
    return A.line_cloud(spark, sf).select(t.alias("tile"), (F.col("x") + t % 4 * 40).alias("x"), (F.col("y") + F.floor(t / 4) * 40).alias("y"), "z")


@query(TILES + ", " + "th AS (SELECT tile, count(*) AS n, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM tl GROUP BY tile) SELECT th.tile, n AS points_total, (SELECT count(*) FROM tl WHERE tl.tile = th.tile AND x BETWEEN 30 AND 75 AND y BETWEEN 35 AND 90) AS points_in_box FROM th WHERE b >= 30 AND a <= 75 AND d >= 35 AND c <= 90")
def tile_overlap(spark, sf):
    p = _tiled(spark, sf)
    return compare.tiles_in_box(compare.tile_headers(p).withColumnsRenamed({f"{n}{a}": f"{n}{a}" for a in "xyz" for n in ("min", "max")}), p, (30.0, 35.0, 75.0, 90.0))


@query(TILES + ", th AS (SELECT tile, count(*) AS points FROM tl GROUP BY tile) SELECT count(*) AS files, CAST(sum(points) AS BIGINT) AS points, round(avg(points), 6) AS mean_points FROM th")
def tile_totals(spark, sf):
    return rounded(compare.tile_headers(_tiled(spark, sf)).agg(F.count("*").alias("files"), F.sum("points").alias("points"), F.avg("points").alias("mean_points")))


@query("""SELECT user_id, count(*) AS runs, round(avg(value), 6) + 0.0 AS value_mean, round(stddev_pop(value), 6) + 0.0 AS value_std FROM events GROUP BY user_id""")
def run_statistics(spark, sf):
    return rounded(metrics.run_statistics(A.table(spark, sf, "events"), "user_id", ["value"]))


@query("""j AS (SELECT user_id, count(*) AS gb, epoch(date_trunc('second', min(ts))) AS a, epoch(date_trunc('second', max(ts))) AS b FROM events GROUP BY user_id)
SELECT user_id, round((b - a) / 60, 6) AS minutes, CASE WHEN b > a THEN round(gb * 1024 / (b - a), 6) END AS mb_per_s FROM j""")
def production_rates(spark, sf):
    jobs = A.table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("gigabytes"))
    return rounded(compare.production_rates(jobs).select("user_id", "minutes", "mb_per_s"))


# --- neighbours and clusters ----------------------------------------------------

@query("SELECT a.idx, count(*) AS degree FROM cloud a JOIN cloud b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4 GROUP BY a.idx")
def radius_degree(spark, sf):
    return neighbours.radius_counts(A.embedded_cloud(spark, sf), EPS)


KNN = """d AS (SELECT a.idx AS src, b.idx AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM cloud a, cloud b),
nn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM d QUALIFY rank <= 17)
"""


@query(KNN + "SELECT src, dst, round(d2, 6) AS d2, CAST(rank AS INTEGER) AS rank FROM nn WHERE rank <= 8")
def knn(spark, sf):
    p = A.embedded_cloud(spark, sf)
    return rounded(neighbours.knn(p, p, 8))


@query(KNN + "SELECT src AS idx, round(avg(sqrt(d2)), 6) AS mean_dist FROM nn WHERE rank BETWEEN 2 AND 17 GROUP BY src")
def knn_mean_dist(spark, sf):
    return rounded(neighbours.mean_distance(A.embedded_cloud(spark, sf)))


@query(KNN + ", md AS (SELECT src AS idx, avg(sqrt(d2)) AS m FROM nn WHERE rank BETWEEN 2 AND 17 GROUP BY src) SELECT idx, round(m, 6) AS mean_dist, m <= (SELECT avg(m) + 2 * stddev_pop(m) FROM md) AS keep FROM md")
def outlier_keep(spark, sf):
    return rounded(neighbours.outlier_flags(A.embedded_cloud(spark, sf)))


@query("""q AS (SELECT a.idx, b.idx AS nearest, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2, b.label FROM cloud a, cloud b WHERE a.idx % 3 = 0 AND b.idx % 3 <> 0)
SELECT idx, nearest, round(d2, 6) AS d2, label FROM q QUALIFY row_number() OVER (PARTITION BY idx ORDER BY d2, nearest) = 1""")
def nearest_label(spark, sf):
    p = A.embedded_cloud(spark, sf)
    return rounded(neighbours.nearest(p.where("idx % 3 = 0"), p.where("idx % 3 <> 0"), ["label"]))


@query(KNN + "SELECT n.src AS idx, " + ", ".join(f"round(max(c.{c}) FILTER (rank <= {k}), 6) AS {c}_max{k}" for k in (4, 8, 16) for c in ("r", "z")) + " FROM nn n JOIN cloud c ON c.idx = n.dst WHERE rank <= 16 GROUP BY n.src")
def multi_scale_max(spark, sf):
    p = A.embedded_cloud(spark, sf)
    return rounded(neighbours.multi_scale_max(neighbours.knn(p, p, 16), p, ["r", "z"], (4, 8, 16)))


@query(KNN + "SELECT n.src AS idx, round(sum(exp(c.g) * c.z) / sum(exp(c.g)), 6) + 0.0 AS pooled FROM nn n JOIN cloud c ON c.idx = n.dst WHERE rank <= 8 GROUP BY n.src")
def attention_pool(spark, sf):
    p = A.embedded_cloud(spark, sf)
    return rounded(neighbours.attention_pool(neighbours.knn(p, p, 8), p, "g", "z"))


@query(KNN + "SELECT n.src, n.dst, CAST(n.rank AS INTEGER) AS rank, round(sqrt(d2), 6) AS dist, " + ", ".join(f"round(a.{c}, 6) + 0.0 AS c{c}, round(b.{c}, 6) + 0.0 AS n{c}, round(a.{c} - b.{c}, 6) + 0.0 AS d{c}" for c in "xyz") + " FROM nn n JOIN cloud a ON a.idx = n.src JOIN cloud b ON b.idx = n.dst WHERE rank <= 4")
def local_geometry(spark, sf):
    p = A.embedded_cloud(spark, sf)
    return rounded(neighbours.local_geometry(neighbours.knn(p, p, 4), p))


DB = """e AS (SELECT a.idx AS s, b.idx AS t FROM cloud a JOIN cloud b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4),
core AS (SELECT s FROM e GROUP BY s HAVING count(*) >= 8),
ce AS (SELECT s, t FROM e WHERE s IN (SELECT s FROM core) AND t IN (SELECT s FROM core)),
reach(s, t) AS (SELECT s, t FROM ce UNION SELECT r.s, ce.t FROM reach r JOIN ce ON r.t = ce.s),
seed AS (SELECT s AS idx, min(t) AS seed FROM reach GROUP BY s),
num AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS cluster FROM (SELECT DISTINCT seed FROM seed)),
border AS (SELECT e.s AS idx, min(seed.seed) AS seed FROM e JOIN seed ON seed.idx = e.t WHERE e.s NOT IN (SELECT s FROM core) GROUP BY e.s),
lab AS (SELECT p.idx, coalesce(n.cluster, -1) AS cluster FROM cloud p LEFT JOIN seed s ON s.idx = p.idx LEFT JOIN border b ON b.idx = p.idx AND p.idx > b.seed LEFT JOIN num n ON n.seed = coalesce(s.seed, b.seed))
"""


@query(DB + "SELECT idx, CAST(cluster AS INTEGER) AS cluster FROM lab")
def dbscan_labels(spark, sf):
    return cluster.dbscan(A.embedded_cloud(spark, sf), EPS, CORE)


@query(DB + "SELECT CAST(cluster AS INTEGER) AS cluster_id, count(*) AS points, " + ", ".join(f"round({f}({a}), 6) + 0.0 AS {a}{f}" for a in "xyz" for f in ("min", "max")) + ", round(max(z) - min(z), 6) AS height, round((max(x) - min(x)) * (max(y) - min(y)), 6) AS area FROM lab JOIN cloud USING (idx) WHERE cluster >= 0 GROUP BY cluster")
def building_targets(spark, sf):
    p = A.embedded_cloud(spark, sf)
    return rounded(cluster.targets(p, cluster.dbscan(p, EPS, CORE)))


@query(DB + ", tg AS (SELECT (max(x) - min(x)) * (max(y) - min(y)) AS area FROM lab JOIN cloud USING (idx) WHERE cluster >= 0 GROUP BY cluster) SELECT count(*) AS targets, count(*) FILTER (area >= 5) AS targets_5, count(*) FILTER (area >= 20) AS targets_20, round(sum(area), 6) AS total_area FROM tg")
def building_summary(spark, sf):
    p = A.embedded_cloud(spark, sf).withColumn("class", F.lit(1))
    return rounded(compare.target_counts(extract_buildings(p, EPS, CORE), 5.0, 20.0))


@query(DB + "SELECT CAST(cluster AS INTEGER) AS cluster_id, count(*) AS points, " + ", ".join(f"printf('%.3f', round({f}({a}), 6)) AS {a}{f}" for a in "xyz" for f in ("min", "max")) + ", printf('%.3f', round(max(z) - min(z), 6)) AS height, printf('%.2f', round((max(x) - min(x)) * (max(y) - min(y)), 6)) AS area FROM lab JOIN cloud USING (idx) WHERE cluster >= 0 GROUP BY cluster")
def building_table(spark, sf):
    p = A.embedded_cloud(spark, sf)
    return pos_csv.target_text(rounded(cluster.targets(p, cluster.dbscan(p, EPS, CORE))))


@query("half AS (SELECT *, idx % 2 AS side FROM cloud)," + """
e AS (SELECT a.side, a.idx AS s, b.idx AS t FROM half a JOIN half b ON a.side = b.side AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4),
core AS (SELECT s FROM e GROUP BY s HAVING count(*) >= 8),
ce AS (SELECT s, t FROM e WHERE s IN (SELECT s FROM core) AND t IN (SELECT s FROM core)),
reach(s, t) AS (SELECT s, t FROM ce UNION SELECT r.s, ce.t FROM reach r JOIN ce ON r.t = ce.s),
seed AS (SELECT s AS idx, min(t) AS seed FROM reach GROUP BY s),
border AS (SELECT e.s AS idx, min(seed.seed) AS seed FROM e JOIN seed ON seed.idx = e.t WHERE e.s NOT IN (SELECT s FROM core) GROUP BY e.s),
lab AS (SELECT h.side, h.x, h.y, coalesce(s.seed, b.seed) AS seed FROM half h LEFT JOIN seed s ON s.idx = h.idx LEFT JOIN border b ON b.idx = h.idx AND h.idx > b.seed),
tg AS (SELECT side, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM lab WHERE seed IS NOT NULL GROUP BY side, seed),
s2 AS (SELECT v.side, count(tg.area) AS targets, count(*) FILTER (area >= 5) AS targets_5, count(*) FILTER (area >= 20) AS targets_20, sum(area) AS total_area FROM (SELECT unnest([0, 1]) AS side) v LEFT JOIN tg USING (side) GROUP BY v.side)
SELECT b.targets AS before_targets, b.targets_5 AS before_targets_5, b.targets_20 AS before_targets_20, round(b.total_area, 6) AS before_total_area, a.targets AS after_targets, a.targets_5 AS after_targets_5, a.targets_20 AS after_targets_20,
  round(a.total_area, 6) AS after_total_area, a.targets - b.targets AS change_targets, a.targets_5 - b.targets_5 AS change_targets_5, a.targets_20 - b.targets_20 AS change_targets_20, round(a.total_area - b.total_area, 6) + 0.0 AS change_total_area FROM s2 b, s2 a WHERE b.side = 0 AND a.side = 1""")
def buildings_compared(spark, sf):
    p = A.embedded_cloud(spark, sf).withColumn("class", F.lit(1))
    before, after = (extract_buildings(p.where(F.col("idx") % 2 == k), EPS, CORE) for k in (0, 1))
    return rounded(compare.before_after(before, after, 5.0, 20.0))


@query("SELECT a.idx, b.idx AS nearest, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 6) AS d2, b.label FROM cloud a JOIN cloud b ON a.idx <> b.idx QUALIFY row_number() OVER (PARTITION BY a.idx ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.idx) = 1")
def nearest_other_label(spark, sf):
    """Of every point the nearest other one: of the two nearest, the point itself is one unless it has equals before it."""
    p = A.embedded_cloud(spark, sf)
    others = neighbours.knn(p, p, 2, keep=["label"]).where("src <> dst")
    best = others.groupBy(F.col("src").alias("idx")).agg(F.min(F.struct("rank", "dst", "d2", "label")).alias("m"))
    return rounded(best.select("idx", F.col("m.dst").alias("nearest"), "m.d2", "m.label"))


# --- samples, blocks, scenes ----------------------------------------------------

@query("SELECT idx, label FROM (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY md5('3:' || idx), idx) AS rk FROM cloud) WHERE rk <= 20")
def class_sample(spark, sf):
    return points.sample_by_class(A.embedded_cloud(spark, sf), 20, 3).select("idx", "label")


@query("SELECT idx, label FROM cloud ORDER BY md5('5:' || idx), idx LIMIT 200")
def random_sample(spark, sf):
    return points.sample_to(A.embedded_cloud(spark, sf), 200, 5).select("idx", "label")


BLOCKS = """o AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lines),
bi AS (SELECT unnest(range(CAST(ceil((x1 - x0) / 10) AS BIGINT))) AS bx FROM o), bj AS (SELECT unnest(range(CAST(ceil((y1 - y0) / 10) AS BIGINT))) AS "by" FROM o),
bp AS (SELECT bx, "by", l_orderkey, l_linenumber, l_partkey FROM lines, o, bi, bj WHERE x >= x0 + bx * 10 AND x < x0 + bx * 10 + 20 AND y >= y0 + "by" * 10 AND y < y0 + "by" * 10 + 20),
bc AS (SELECT bx, "by", count(*) AS n FROM bp GROUP BY bx, "by" HAVING count(*) >= 100)
"""


@query(BLOCKS + 'SELECT bx, "by", n FROM bc')
def block_counts(spark, sf):
    return points.blocks(A.line_cloud(spark, sf), 20.0, 0.5).groupBy("bx", "by").agg(F.count("*").alias("n"))


@query(BLOCKS + 'SELECT bx, "by", l_orderkey, l_linenumber, l_partkey, n FROM bp JOIN bc USING (bx, "by")')
def blocks(spark, sf):
    return points.blocks(A.line_cloud(spark, sf), 20.0, 0.5).select("bx", "by", "l_orderkey", "l_linenumber", "l_partkey", "n")


@query("""o AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lines),
bi AS (SELECT unnest(range(CAST(ceil((x1 - x0) / 10) AS BIGINT))) AS bx FROM o), bj AS (SELECT unnest(range(CAST(ceil((y1 - y0) / 10) AS BIGINT))) AS "by" FROM o),
bp AS (SELECT bx, "by", label FROM lines, o, bi, bj WHERE x >= x0 + bx * 10 AND x < x0 + bx * 10 + 20 AND y >= y0 + "by" * 10 AND y < y0 + "by" * 10 + 20)
SELECT bx, "by", count(*) AS points, """ + ", ".join(f"count(*) FILTER (label = {k}) AS n{k}, round(count(*) FILTER (label = {k}) / count(*), 9) AS ratio{k}" for k in range(6)) + ' FROM bp GROUP BY bx, "by" HAVING count(*) >= 100')
def block_ratios(spark, sf):
    return rounded(points.block_classes(points.blocks(A.line_cloud(spark, sf), 20.0, 0.5), 6), 9)


@query()
def block_split(spark, sf):
    return points.split_blocks(points.blocks(A.line_cloud(spark, sf), 10.0))


@query("""c AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM cloud GROUP BY label),
m AS (SELECT idx, label, x - mx AS dx, y - my AS dy, z - mz AS dz FROM cloud JOIN c USING (label)),
r AS (SELECT label, max(sqrt(dx * dx + dy * dy + dz * dz)) AS reach FROM m GROUP BY label)
SELECT idx, label, round(dx / reach, 6) + 0.0 AS nx, round(dy / reach, 6) + 0.0 AS ny, round(dz / reach, 6) + 0.0 AS nz FROM m JOIN r USING (label)""")
def normalize_scene(spark, sf):
    return rounded(points.normalise(A.embedded_cloud(spark, sf), "label").select("idx", "label", "nx", "ny", "nz"))


@query("""SELECT round(avg(-ln(CASE WHEN label = 0 THEN r WHEN label = 1 THEN g ELSE b END / (r + g + b))), 6) AS loss FROM cloud WHERE label < 3""")
def cross_entropy(spark, sf):
    p = A.embedded_cloud(spark, sf).where("label < 3")
    whole = F.col("r") + F.col("g") + F.col("b")
    share = lambda c: F.when(whole == 0, F.col(c) * float("inf")).otherwise(F.col(c) / whole)
    return rounded(metrics.cross_entropy(p.select("label", F.array(*[share(c) for c in "rgb"]).alias("probs"))))


@query("SELECT idx, CASE WHEN r >= g AND r >= b THEN 0 WHEN g >= b THEN 1 ELSE 2 END AS pred FROM cloud")
def argmax_class(spark, sf):
    return A.embedded_cloud(spark, sf).select("idx", F.array("r", "g", "b").alias("probs")).select("idx", metrics.argmax_class().alias("pred"))


def _model(spark, sf):
    """A model fitted on three of four points; the others are held out."""
    return learn.fit(A.embedded_cloud(spark, sf).where("idx % 4 <> 0"))


@query()
def predict_chunks(spark, sf):
    return learn.predict_chunks(_model(spark, sf), A.embedded_cloud(spark, sf), 512)


@query()
def ml_predict(spark, sf):
    return learn.predict(_model(spark, sf), A.embedded_cloud(spark, sf)).withColumn("held_out", F.col("idx") % 4 == 0)


@query()
def evaluate_model(spark, sf):
    return learn.evaluate(_model(spark, sf), A.embedded_cloud(spark, sf), 6)


@query()
def predict_cloud(spark, sf):
    return learn.predict_cloud(_model(spark, sf), A.embedded_cloud(spark, sf), 512, 3)


NET = network.Shape(widths=(16, 32, 64), scales=(4, 8, 16), k=8)


@query()
def network_pass(spark, sf):
    """Logits of every point by one pass of the network over all scenes at once, with seeded weights."""
    p = network.cloud_scenes(A.embedded_cloud(spark, sf), 250)
    return network.forward(network.pyramid(p, NET), network.inputs(p), network.new_weights(NET, 1), NET)


@query()
def network_training(spark, sf):
    """Some epochs over three of four scenes: of each the loss, and the scores on the others."""
    p = network.cloud_scenes(A.embedded_cloud(spark, sf), 125)
    scenes = network.packed(network.pyramid(p, NET), network.inputs(p), p.select("idx", "label"))
    _, log = network.train(scenes.where("scene % 4 <> 3"), scenes.where("scene % 4 = 3"), NET, epochs=3, rate=0.01)
    return spark.createDataFrame([(e["epoch"], e["loss"], e["oa"], e["miou"]) for e in log], "epoch int, loss double, oa double, miou double")


@query()
def dataset_items(spark, sf):
    return learn.dataset_item(A.embedded_cloud(spark, sf), 1024, 2.0, seed=3)


@query()
def demo_points(spark, sf):
    return demo_scene.demo_scene(spark)


# --- text in files --------------------------------------------------------------

@query(r"""t AS (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '<([A-Za-z0-9]+)[^>]*>([^<]+)</[A-Za-z0-9]+>', 1), regexp_extract_all(html, '<([A-Za-z0-9]+)[^>]*>([^<]+)</[A-Za-z0-9]+>', 2))) AS p FROM pages
 UNION ALL SELECT page_id, unnest(list_zip(regexp_extract_all(html, '([a-z]+)="([^"]*)"', 1), regexp_extract_all(html, '([a-z]+)="([^"]*)"', 2))) FROM pages)
SELECT page_id, p[1] AS tag, p[2] AS value FROM t""")
def html_tags(spark, sf):
    return image_meta.all_tags(A.table(spark, sf, "pages"), "page_id", "html", r"<([A-Za-z0-9]+)[^>]*>([^<]+)</[A-Za-z0-9]+>", (r'([a-z]+)="([^"]*)"', 1))


@query("""SELECT idx, CASE WHEN idx % 4 = 0 THEN NULL ELSE idx % 180 - 90.5::DOUBLE END AS pitch, CAST(idx % 360 AS DOUBLE) AS flight_yaw FROM pos""")
def xmp_numbers(spark, sf):
    i = F.col("idx")
    pitch = F.format_string("%.1f", i % 180 - 90.5)
    text = F.when(i % 4 == 0, F.lit("")).when(i % 2 == 0, F.concat(F.lit("<drone-dji:GimbalPitchDegree> "), pitch, F.lit("</drone-dji:GimbalPitchDegree>"))).otherwise(F.concat(F.lit('<d drone-dji:GimbalPitchDegree="'), pitch, F.lit('"/>')))
    text = F.concat(text, F.lit(' drone-dji:FlightYawDegree="+'), (i % 360).cast("string"), F.lit('"'))
    found = image_meta.xmp_numbers(text)
    return A.poses(spark, sf).select("idx", found["pitch"].alias("pitch"), found["flight_yaw"].alias("flight_yaw"))
