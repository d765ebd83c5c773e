"""Queries for vectors, clustering and diarization."""

from pyspark.sql import functions as F

from turnloom.catalog.ctes import FRAMES, VECTORS, sql
from turnloom.catalog.registry import query
from turnloom.catalog.sequences import SHOT_HIST, block_sql, shot_hists
from turnloom.functions import vectors as X
from turnloom.operators import vectors as V
from turnloom.session import cut
from turnloom.sources import adapters as A

# Each vector is an 8 x 8 picture; a value of -4..4 is spread over 0..256.
PIX = """
pix as (select row_id, unnest(range(64)) as k, unnest(x) as v from vectors),
px as (select row_id, cast(k % 8 as int) as x, cast(k // 8 as int) as y, least(greatest(v, -3.99), 3.99) * 32 + 128 as ch1, abs(v) * 60 as ch2 from pix)"""


def pixels(s, d):
    p = A.vectors(s, d).select("row_id", F.posexplode("x").alias("k", "v"))
    return p.select(
        "row_id", (F.col("k") % 8).alias("x"), F.expr("k div 8").cast("int").alias("y"),
        (F.least(F.greatest("v", F.lit(-3.99)), F.lit(3.99)) * 32 + 128).alias("ch1"), (F.abs("v") * 60).alias("ch2"),
    )


def _r(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("v01_block_id", sql(VECTORS, PIX, then="select row_id, x, y, cast(y // 2 * 2 + x // 3 as int) as block from px where y < 8 and x < 6"))
def _(s, d):
    # A picture of 8 rows and 7 columns in 4 x 2 blocks: the seventh column is a remainder.
    return V.block_id(pixels(s, d).where("x < 7"), 8, 7, 4, 2).select("row_id", "x", "y", "block")


@query("v02_histogram", sql(VECTORS, PIX, then="""
, b as (select row_id, cast(y // 4 * 2 + x // 4 as int) as block, cast(floor(ch1 * 8 / 256) * 4 + floor(ch2 * 4 / 180) as int) as bin from px where ch1 >= 0 and ch1 < 256 and ch2 >= 0 and ch2 < 180)
select row_id, block, bin, round(count(*) / sum(count(*)) over (partition by row_id, block), 6) as share from b group by 1, 2, 3"""))
def _(s, d):
    p = V.block_id(pixels(s, d), 8, 8, 2, 2)
    return _r(V.histogram(p, ["row_id", "block"], [("ch1", 8, 0, 256), ("ch2", 4, 0, 180)]), "share")


PAIRS = """
pr as (select a.unit, a.pos as i, b.pos as j, a.x as a, b.x as b, a.label as la, b.label as lb, a.row_id as ra, b.row_id as rb from vectors a join vectors b on a.unit = b.unit and b.pos > a.pos),
pu as (select unit, i, j, unnest(a) as x, unnest(b) as y from pr)"""

DIST = PAIRS + """,
pd as (select unit, i, j, sqrt(sum((x - y) * (x - y))) as d from pu group by 1, 2, 3)"""


@query("v03_hist_distance", sql(FRAMES, then="""
, f as (select video, frame_idx, unnest(hist) as x, unnest(lag(hist) over (partition by video order by frame_idx)) as y from frames),
g as (select * from f where y is not null)
select video, frame_idx, round(sum(abs(x - y)), 6) as l1, round(sqrt(sum((x - y) * (x - y))), 6) as l2,
 round(1 - (sum(x * y) - sum(x) * sum(y) / 64) / sqrt((sum(x * x) - sum(x) * sum(x) / 64) * (sum(y * y) - sum(y) * sum(y) / 64)), 6) as correl,
 round(sum(case when abs(x) > 2.220446049250313e-16 then (x - y) * (x - y) / x else 0 end), 5) as chisqr, round(sum(least(x, y)), 6) as intersect_,
 round(sqrt(greatest(1 - sum(sqrt(x * y)) / sqrt(sum(x) * sum(y)), 0)), 6) as hellinger from g group by 1, 2"""))
def _(s, d):
    from turnloom.plans.ordered import band

    p = band(A.frames(s, d), ["video"], "frame_idx", 1, ["hist"])
    a, b = F.col("hist2"), F.col("hist1")
    cols = [F.round(X.hist_distance(a, b, m), 5 if m == "chisqr" else 6).alias(m + ("_" if m == "intersect" else "")) for m in ("l1", "l2", "correl", "chisqr", "intersect", "hellinger")]
    return p.select("video", F.col("frame_idx2").alias("frame_idx"), *cols)


@query("v04_mean_block_distance", sql(VECTORS, then="""
select row_id, round(1 - avg(abs(1 - v)), 6) as d from (select row_id, unnest(x) as v from vectors) group by 1"""))
def _(s, d):
    return A.vectors(s, d).select("row_id", F.round(X.mean_block_distance(F.col("x")), 6).alias("d"))


@query("v05_shot_correlation", sql(FRAMES, SHOT_HIST, then="""
, pr as (select i.video, i.shot_idx as i, j.shot_idx as j, i.first_hist as a, j.last_hist as b from sh i join sh j on i.video = j.video and i.shot_idx > j.shot_idx),"""
    + block_sql("video, i, j", "pr", "bd") + " select video, i, j, round(d, 6) as d from bd"))
def _(s, d):
    return _r(V.shot_correlation(shot_hists(s, d), 4, keys=["video"]), "d")


EL = """
el as (select row_id, label, unnest(range(64)) as k, unnest(x) as v from vectors)"""


@query("v06_within_covariance", sql(VECTORS, EL, then="""
, c as (select row_id, k, v - avg(v) over (partition by label, k) as v from el)
select cast(a.k as int) as i, cast(b.k as int) as j, round(sum(a.v * b.v) / count(*), 6) as cov from c a join c b on a.row_id = b.row_id and a.k <= b.k group by 1, 2"""))
def _(s, d):
    return _r(V.within_covariance(A.vectors(s, d)), "cov")


@query("v07_covariance", sql(VECTORS, EL, then="""
select cast(a.k as int) as i, cast(b.k as int) as j, round(covar_samp(a.v, b.v), 6) as cov from el a join el b on a.row_id = b.row_id and a.k <= b.k group by 1, 2"""))
def _(s, d):
    return _r(V.covariance(A.vectors(s, d)), "cov")


@query("v08_normalise", sql(VECTORS, EL, then="""
select row_id, cast(k as int) as k, round(v / sum(v * v) over (partition by row_id), 6) as v from el"""))
def _(s, d):
    return _r(A.vectors(s, d).select("row_id", F.posexplode(X.normalise(F.col("x"))).alias("k", "v")), "v")


@query("v09_pair_distance", sql(VECTORS, DIST, then="select unit, i, j, round(d, 6) as d from pd"))
def _(s, d):
    return _r(V.pair_distance(A.vectors(s, d)), "d")


@query("v09_pair_distance_mahalanobis")
def _(s, d):
    v = A.vectors(s, d)
    return _r(V.pair_distance(v, V.inverse_factor(V.within_covariance(v))), "d")


@query("v10_mask_pairs", sql(VECTORS, DIST, then="""
select pd.unit, pd.i, pd.j, round(d, 6) as d from pd join pr on pr.unit = pd.unit and pr.i = pd.i and pr.j = pd.j where la <> lb"""))
def _(s, d):
    v = A.vectors(s, d)
    lab = v.select("unit", "pos", F.concat(F.lit("LSU"), "label", F.lit("_S"), "pos").alias("label"))
    return _r(V.mask_pairs(V.pair_distance(v), lab), "d")


@query("v11_ward_init", sql(VECTORS, DIST, then="select unit, i, j, round((1 + i % 3) * (1 + j % 3) * d * d, 5) as d from pd"))
def _(s, d):
    v = A.vectors(s, d)
    return _r(V.ward_init(V.pair_distance(v), v.withColumn("w", (1 + F.col("pos") % 3).cast("double"))), "d", n=5)


def _items(s, d):
    return cut(A.vectors(s, d).withColumn("dur", 1.0 + F.col("row_id") % 5))


def _tree(s, d, criterion="mean", temporal=False):
    v = _items(s, d)
    pairs = V.pair_distance(v)
    w = v.select("unit", "pos", F.lit(1.0).alias("w"))
    pairs = cut(V.ward_init(pairs, w) if criterion == "ward" else pairs)
    return v, pairs, cut(V.agglomerate(pairs, w, criterion, temporal))


@query("v12_agglomerate")
def _(s, d):
    return _r(_tree(s, d)[2], "height")


@query("v12_agglomerate_ward")
def _(s, d):
    return _r(_tree(s, d, "ward")[2], "height")


@query("v12_agglomerate_temporal")
def _(s, d):
    return _r(_tree(s, d, "mean", temporal=True)[2], "height")


@query("v13_cut")
def _(s, d):
    v, _, m = _tree(s, d, "max")
    mid = m.groupBy("unit").agg(F.avg("height").alias("height"))
    return V.cut_tree(m, v, mid)


@query("v13_best_cut")
def _(s, d):
    v, pairs, m = _tree(s, d)
    return _r(V.best_cut(m, pairs, v), "height")


@query("v14_silhouette", sql(VECTORS, DIST, then="""
, bo as (select unit, i as pos, j as other, d from pd union all select unit, j, i, d from pd),
m as (select bo.unit, bo.pos, v.label as oc, avg(d) as m from bo join vectors v on v.unit = bo.unit and v.pos = other group by 1, 2, 3),
ab as (select v.unit, v.pos, v.label as cluster, min(case when oc = v.label then m end) as a, min(case when oc <> v.label then m end) as b from vectors v join m on m.unit = v.unit and m.pos = v.pos group by 1, 2, 3)
select unit, pos, cluster, round(case when a is null then 0 else (b - a) / greatest(a, b) end, 6) as s from ab"""))
def _(s, d):
    v = A.vectors(s, d)
    return _r(V.silhouette(V.pair_distance(v), v.select("unit", "pos", F.col("label").alias("cluster"))), "s")


@query("v15_medoid", sql(VECTORS, DIST, then="""
, t as (select unit, pos, round(sum(d), 9) as total from (select unit, i as pos, d from pd union all select unit, j, d from pd) group by 1, 2)
select unit, arg_min(pos, total) as medoid, round(min(total), 6) as total from t group by 1"""))
def _(s, d):
    return _r(V.medoid(V.pair_distance(A.vectors(s, d))), "total")


@query("v16_centroid", sql(VECTORS, then="""
select unit, cast(k as int) as k, round(avg(v), 6) as v from (select unit, unnest(range(64)) as k, unnest(x) as v from vectors) group by 1, 2"""))
def _(s, d):
    return _r(V.centroid(A.vectors(s, d)).select("unit", F.posexplode("centroid").alias("k", "v")), "v")


def _diarized(s, d):
    v = _items(s, d)
    x = v.withColumn("x", X.normalise(F.col("x"), root=True))
    return v, V.local_diarization(x)


@query("v17_local_diarization")
def _(s, d):
    return _r(_diarized(s, d)[1], "height")


def _errors(s, d):
    v, c = _diarized(s, d)
    hyp = V.relabel(c)
    lab = v.select("unit", "pos", F.col("label").alias("ref"), "dur").join(hyp, ["unit", "pos"])
    return V.speaker_error(lab)


@query("v18_speaker_error")
def _(s, d):
    return _r(_errors(s, d), "error", "duration")


@query("v19_show_error")
def _(s, d):
    return _r(V.show_error(_errors(s, d)), "error")


@query("v20_relabel", sql(VECTORS, then="""
, f as (select unit, label, min(pos) as f from vectors group by 1, 2), n as (select *, row_number() over (partition by unit order by f) - 1 as i from f)
select v.unit, pos, concat('LSU', v.unit, '_S', i) as hyp from vectors v join n on n.unit = v.unit and n.label = v.label"""))
def _(s, d):
    return V.relabel(A.vectors(s, d).select("unit", "pos", F.col("label").alias("cluster")))


@query("o12_k_centers")
def _(s, d):
    return _r(V.k_centers(A.vectors(s, d), 4), "d", "covering")


@query("o12_covering_sweep")
def _(s, d):
    return _r(V.covering_sweep(A.vectors(s, d), 5), "covering", "fall")
