"""The query over figures' regions, on the pages of ``plans.figures``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.operators import regions
from paperloom.plans.figures import _BLOCKS, _blocks
from paperloom.plans.registry import query


@query(f"""WITH b AS (SELECT *, l + 300 AS r, t + 90 AS o FROM ({_BLOCKS})),
pg AS (SELECT doc, page, min(l) AS pl, max(r) AS pr, max(o) AS po, (min(l) + max(r)) / 2 AS mid FROM b GROUP BY doc, page),
tx AS (SELECT doc, page, count(*) FILTER (label = 'text' AND r <= mid + 30) >= 3 AND count(*) FILTER (label = 'text' AND l >= mid - 30) >= 3 AS two FROM b JOIN pg USING (doc, page) GROUP BY doc, page),
c AS (SELECT b.*, pl, pr, po, CASE WHEN two THEN b.l ELSE pl END AS cl, CASE WHEN two THEN b.r ELSE pr END AS cr FROM b JOIN pg USING (doc, page) JOIN tx USING (doc, page) WHERE label = 'figure_title'
  AND EXISTS (SELECT 1 FROM b v WHERE v.doc = b.doc AND v.page = b.page AND v.label = 'image' AND abs(v.block - b.block) = 1)),
n AS (SELECT c.doc, c.page, c.block, count(*) FILTER (v.r > cl AND v.l < cr AND v.o <= c.t) AS a, count(*) FILTER (v.r > cl AND v.l < cr AND v.t >= c.o) AS u,
  count(*) FILTER (v.o > c.t AND v.t < c.o AND v.r <= c.l) AS w, count(*) FILTER (v.o > c.t AND v.t < c.o AND v.l >= c.r) AS e
  FROM c JOIN b v ON v.doc = c.doc AND v.page = c.page AND v.label = 'image' GROUP BY ALL),
y AS (SELECT c.*, CASE WHEN a >= u AND a >= w AND a >= e THEN 'above' WHEN u >= w AND u >= e THEN 'below' WHEN w >= e THEN 'left' ELSE 'right' END AS way FROM c JOIN n USING (doc, page, block)),
s AS (SELECT y.doc, y.page, y.block, min(m.l) AS bl, min(m.t) AS bt, max(m.r) AS br, max(m.o) AS bo FROM y JOIN b m ON m.doc = y.doc AND m.page = y.page AND abs(m.block - y.block) = 1
  AND (m.label = 'image' OR (m.label = 'vision_footnote' AND CASE way WHEN 'above' THEN m.o <= y.t WHEN 'below' THEN m.t >= y.o WHEN 'left' THEN m.r <= y.l ELSE m.l >= y.r END)) GROUP BY ALL),
z AS (SELECT y.*, bl, bt, br, bo FROM y JOIN s USING (doc, page, block)),
g AS (SELECT z.*, CASE way
  WHEN 'above' THEN bt - coalesce((SELECT max(x.o) FROM b x WHERE x.doc = z.doc AND x.page = z.page AND x.block <> z.block AND x.label IN ('text', 'figure_title') AND x.r > bl AND x.l < br AND x.o < bt), 0)
  WHEN 'below' THEN coalesce((SELECT min(x.t) FROM b x WHERE x.doc = z.doc AND x.page = z.page AND x.block <> z.block AND x.label IN ('text', 'figure_title') AND x.r > bl AND x.l < br AND x.t > bo), po) - bo
  WHEN 'left' THEN bl - coalesce((SELECT max(x.r) FROM b x WHERE x.doc = z.doc AND x.page = z.page AND x.block <> z.block AND x.label IN ('text', 'figure_title') AND x.o > bt AND x.t < bo AND x.r < bl), 0)
  ELSE coalesce((SELECT min(x.l) FROM b x WHERE x.doc = z.doc AND x.page = z.page AND x.block <> z.block AND x.label IN ('text', 'figure_title') AND x.o > bt AND x.t < bo AND x.l > br), pr) - br END AS free FROM z),
h AS (SELECT *, free >= 80 AND free >= 0.3 * CASE WHEN way IN ('above', 'below') THEN bo - bt ELSE br - bl END
  AND CASE way WHEN 'above' THEN t >= bo WHEN 'below' THEN o <= bt WHEN 'left' THEN l >= br ELSE r <= bl END AS grows FROM g),
q AS (SELECT doc, page, block, way, l, t, r, o, bl - CASE WHEN grows AND way = 'left' THEN free - 8 ELSE 0 END AS x0, bt - CASE WHEN grows AND way = 'above' THEN free - 8 ELSE 0 END AS y0,
  br + CASE WHEN grows AND way = 'right' THEN free - 8 ELSE 0 END AS x1, bo + CASE WHEN grows AND way = 'below' THEN free - 8 ELSE 0 END AS y1 FROM h),
k AS (SELECT *, (x1 - x0) * (o - y0) AS lt, (x1 - x0) * (y1 - t) AS lb, (y1 - y0) * (r - x0) AS ll, (y1 - y0) * (x1 - l) AS lr, x0 < r AND l < x1 AND y0 < o AND t < y1 AS met FROM q),
d AS (SELECT *, CASE WHEN NOT met THEN 'none' WHEN lt <= lb AND lt <= ll AND lt <= lr THEN 'top' WHEN lb <= ll AND lb <= lr THEN 'bottom' WHEN ll <= lr THEN 'left' ELSE 'right' END AS side FROM k)
SELECT doc, page, block AS figure, way, CASE WHEN side = 'left' AND r + 8 < x1 THEN r + 8 ELSE x0 END AS "left", CASE WHEN side = 'top' AND o + 8 < y1 THEN o + 8 ELSE y0 END AS top,
  CASE WHEN side = 'right' AND l - 8 > x0 THEN l - 8 ELSE x1 END AS "right", CASE WHEN side = 'bottom' AND t - 8 > y0 THEN t - 8 ELSE y1 END AS bottom FROM d""")
def figure_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure is a caption with the images and notes on the lines next to it, one image at least."""
    blocks, captions = _blocks(spark, sf_dir)
    others = blocks.filter("label IN ('image', 'vision_footnote')").select("doc", "page", "block", "label")
    near = captions.select("doc", "page", F.col("caption").alias("figure")).join(others, ["doc", "page"]).filter("abs(block - figure) = 1")
    drawn = F.max(F.col("label") == "image").over(Window.partitionBy("doc", "page", "figure"))
    members = near.withColumn("drawn", drawn).filter("drawn")
    segments = members.select("doc", "page", "figure", F.explode(F.array("block", "figure")).alias("block"))
    return regions.figure_regions(segments, blocks)
