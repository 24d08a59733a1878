"""Ranking, metrics, folds, bootstraps, verdicts (W, T, E, M1, M6, M7, M13 rows)."""

from pyspark.sql import functions as F

from junctura.catalog import query, views as V
from junctura.catalog.views import bits_sql, sql
from junctura.operators import evaluation as E, folds, ranking as K, resampling as B, tiers
from junctura.plans import models as M
from junctura.session import attach, stage

_RA = "row_number() OVER (ORDER BY score_a DESC, site_id)"


@query("w1_rank_and_percentile", sql("scored", f"SELECT site_id, rank, round(greatest(0,least(100,(1-(rank-1)/(SELECT count(*) FROM scored))*100)),6) AS percentile FROM (SELECT site_id, {_RA} AS rank FROM scored)"))
def _(s, d):
    return K.rank_and_percentile(V.scored(s, d).select("site_id", "score_a"), "score_a", "site_id").select(
        "site_id", "rank", F.round("percentile", 6).alias("percentile"))


@query("w2_oof_rank_column", sql("scored", f"SELECT site_id, {_RA} AS rank, row_number() OVER (ORDER BY score_b DESC, site_id) AS oof_rank FROM scored"))
def _(s, d):
    t = V.scored(s, d)
    live = K.ranked(t.select("site_id", "score_a"), [("score_a", True), ("site_id", False)])
    oof = K.ranked(t.select("site_id", "score_b"), [("score_b", True), ("site_id", False)], "oof_rank")
    return live.select("site_id", "rank").join(oof.select("site_id", "oof_rank"), "site_id", "left")


@query("w3_decile_calibration", sql("scored", """SELECT (least((rn-1)//((SELECT count(*) FROM scored)//10),9)+1)::INT AS decile, round(avg(score_b),6) AS mean_pred, round(avg(label),6) AS mean_actual, count(*) AS n
  FROM (SELECT *, row_number() OVER (ORDER BY score_b, site_id) AS rn FROM scored) GROUP BY 1"""))
def _(s, d):
    c = E.decile_calibration(V.scored(s, d).select("site_id", "score_b", "label"), "score_b", "label", "site_id")
    return c.withColumns({"mean_pred": F.round("mean_pred", 6), "mean_actual": F.round("mean_actual", 6)})


@query("w8_first_hit_rank", sql("scored", f"SELECT min(rank) AS first_hit_rank FROM (SELECT hit, {_RA} AS rank FROM scored) WHERE hit>=1"))
def _(s, d):
    return E.first_hit(K.ranked(V.scored(s, d).select("site_id", "score_a", "hit"), [("score_a", True), ("site_id", False)]), "rank", "hit")


@query("t1_top_k", sql("scored", "SELECT site_id, score_a FROM scored ORDER BY score_a DESC, site_id LIMIT 100"))
def _(s, d):
    return K.top_k(V.scored(s, d).select("site_id", "score_a"), "score_a", "site_id", 100)


@query("e1_recall_precision", sql("scored", f"""SELECT k::INT AS k, (sum(hit) FILTER (rn<=k))::BIGINT AS hits, round(sum(hit) FILTER (rn<=k)/greatest((SELECT sum(hit) FROM scored),1),6) AS recall,
  round(avg(hit) FILTER (rn<=k),6) AS precision FROM (SELECT hit, {_RA} AS rn FROM scored) CROSS JOIN (VALUES (25),(50),(100)) k(k) GROUP BY 1"""))
def _(s, d):
    r = E.recall_precision_at(V.scored(s, d), "score_a", "site_id", "hit", (25, 50, 100))
    return r.withColumns({"recall": F.round("recall", 6), "precision": F.round("precision", 6)})


_AP = """SELECT round(sum(p*cp/cn)/max(np),6) AS auprc, round(sum(p*(nn-np-(cn-cp)+(n-p)/2.0))/max(np*(nn-np)),6) AS auroc FROM (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM
  (SELECT score_a, sum(hit)::DOUBLE AS p, count(*)::DOUBLE AS n FROM scored GROUP BY 1) WINDOW w AS (ORDER BY score_a DESC))"""


@query("e2_auprc_auroc", sql("scored", _AP))
def _(s, d):
    return E.auprc_auroc(V.scored(s, d), "score_a", "hit").select(F.round("auprc", 6).alias("auprc"), F.round("auroc", 6).alias("auroc"))


@query("e3_f17_deviances", sql("scored", """SELECT round(avg(2*(pow(y,0.7)/(-0.3*0.7)-y*pow(m,-0.3)/(-0.3)+pow(m,0.7)/0.7)),6) AS tweedie, round(avg(2*(y*ln(y/m+1e-10)-(y-m))),6) AS poisson,
  round(avg(2*(ln(m/(y+1)+1e-10)+(y+1)/m-1)),6) AS gamma FROM (SELECT label::DOUBLE AS y, greatest(score_b,1e-6::DOUBLE) AS m FROM scored)"""))
def _(s, d):
    y, m = F.col("label"), F.col("score_b")
    return V.scored(s, d).agg(F.round(E.tweedie_deviance(y, m, 1.3), 6).alias("tweedie"), F.round(E.tweedie_deviance(y, m, 1), 6).alias("poisson"),
                              F.round(E.tweedie_deviance(y + 1, m, 2), 6).alias("gamma"))


@query("e4_spearman", sql("scored", """SELECT round(corr(ra,rb),6) AS spearman_rho FROM (SELECT rank() OVER (ORDER BY score_a)+(count(*) OVER (PARTITION BY score_a)-1)/2.0 AS ra,
  rank() OVER (ORDER BY label)+(count(*) OVER (PARTITION BY label)-1)/2.0 AS rb FROM scored)"""))
def _(s, d):
    return E.spearman(V.scored(s, d), "score_a", "label").select(F.round("spearman_rho", 6).alias("spearman_rho"))


@query("e8_recall_table", sql("scored", f"""SELECT t::INT AS threshold, k::INT AS k, np AS n_positives, ne AS n_events, hits, round(hits/np::DOUBLE,4) AS recall, round(k/n::DOUBLE,6) AS baseline,
  round((hits/np::DOUBLE)/(k/n::DOUBLE),1) AS lift FROM (SELECT t, k, count(*) AS n, count(*) FILTER (label>=t) AS np, (sum(label) FILTER (label>=t))::BIGINT AS ne, count(*) FILTER (label>=t AND rn<=k) AS hits
  FROM (SELECT label, {_RA} AS rn FROM scored) CROSS JOIN (VALUES (1),(2)) t(t) CROSS JOIN (VALUES (50),(100),(200),(500),(1000)) k(k) GROUP BY 1,2)"""))
def _(s, d):
    return E.recall_table(V.scored(s, d), "score_a", "site_id", "label", (1, 2), (50, 100, 200, 500, 1000))


_W = "+".join(f"(u>={c}::DOUBLE)::INT" for c in B.POISSON1)
DRAWS, CUTS = 1000, (50, 100, 200)


def boot_sql(src: str, score: str = "score_a", label: str = "label", threshold: int = 1, draws: int = DRAWS, ks: tuple = CUTS, keys: str = "") -> str:
    """Every replicate's metrics (``per``) from the draws themselves, by windows over exploded rows."""
    k = keys + ", " if keys else ""
    cuts = "".join(f", sum(p*least(greatest(({c}-(cn-n))/n,0),1))/max(np) AS recall_{c}, sum(p*least(greatest(({c}-(cn-n))/n,0),1))/least({c},max(nn)) AS precision_{c}" for c in ks)
    return f"""h AS (SELECT {k}site_id, {score}::DOUBLE AS s, {label}::DOUBLE AS l, ({label}>={threshold})::INT AS hit, md5('bs|'||g||'|'||site_id) AS m, g FROM {src} CROSS JOIN range({-(-draws // 4)}) r(g)),
  wr AS (SELECT {k}b, s, l, hit, ({_W})::DOUBLE AS w FROM (SELECT {k}s, l, hit, g*4+j AS b, ('0x'||substr(m,(8*j+1)::INT,8))::BIGINT/4294967296.0::DOUBLE AS u FROM h CROSS JOIN range(4) q(j)) WHERE b<{draws}),
  gs AS (SELECT {k}b, s, sum(w*hit) AS p, sum(w) AS n FROM wr WHERE w>0 GROUP BY ALL),
  gc AS (SELECT *, sum(p) OVER v AS cp, sum(n) OVER v AS cn, sum(p) OVER (PARTITION BY {k}b) AS np, sum(n) OVER (PARTITION BY {k}b) AS nn FROM gs WINDOW v AS (PARTITION BY {k}b ORDER BY s DESC)),
  bm AS (SELECT {k}b, sum(p*cp/cn)/max(np) AS auprc, sum(p*(nn-np-(cn-cp)+(n-p)/2.0))/max(np*(nn-np)) AS auroc{cuts} FROM gc WHERE np>0 AND np<nn GROUP BY ALL),
  lr AS (SELECT {k}b, l, sum(sum(w)) OVER (PARTITION BY {k}b ORDER BY l)-sum(w)+(sum(w)+1)/2 AS rl FROM wr WHERE w>0 GROUP BY {k}b, l),
  rk AS (SELECT wr.*, nn-cn+(n+1)/2 AS rs, rl FROM wr JOIN gc USING ({k}b, s) JOIN lr USING ({k}b, l)),
  cm AS (SELECT {k}b, (sum(w*rs*rl)-sum(w)*pow((sum(w)+1)/2,2))/nullif(sqrt(greatest(sum(w*rs*rs)-sum(w)*pow((sum(w)+1)/2,2),0)*greatest(sum(w*rl*rl)-sum(w)*pow((sum(w)+1)/2,2),0)),0) AS spearman_rho,
    sum(w*2*(pow(l,0.7)/(-0.3*0.7)-l*pow(m,-0.3)/(-0.3)+pow(m,0.7)/0.7))/sum(w) AS tweedie_deviance, sum(w*2*(l*ln(l/m+1e-10)-(l-m)))/sum(w) AS poisson_deviance FROM (SELECT *, greatest(s,1e-6::DOUBLE) AS m FROM rk WHERE w>0) GROUP BY ALL),
  per AS (SELECT * FROM cm LEFT JOIN bm USING ({k}b))"""


_NAMES = B.metric_names(CUTS)


@query("e5_bootstrap_intervals", sql("scored", f"""SELECT metric, round(avg(v),6) AS mean, round(quantile_cont(v,0.025),6) AS lo, round(quantile_cont(v,0.975),6) AS hi FROM (
  SELECT unnest([{", ".join(f"'{n}'" for n in _NAMES)}]) AS metric, unnest([{", ".join(_NAMES)}]) AS v FROM per) WHERE v IS NOT NULL GROUP BY 1""", boot_sql("scored")))
def _(s, d):
    per = B.bootstrap_metrics(V.scored(s, d), "score_a", "label", "site_id", DRAWS, ks=CUTS)
    i = B.interval(per, _NAMES)
    return i.withColumns({c: F.round(c, 6) for c in ("mean", "lo", "hi")})


_POS = """pos AS (SELECT site_id, ra, rb, row_number() OVER (ORDER BY site_id) AS i, count(*) OVER () AS np FROM (SELECT site_id, hit, row_number() OVER (ORDER BY score_a DESC, site_id) AS ra,
  row_number() OVER (ORDER BY score_b DESC, site_id) AS rb FROM scored) WHERE hit>=1),
  dr AS (SELECT d.b, p.site_id, p.ra, p.rb, p.np FROM (SELECT b, ('0x'||substr(md5('pd|'||b||'|'||i),1,8))::BIGINT%np+1 AS j FROM pos CROSS JOIN range(200) r(b)) d JOIN pos p ON p.i=d.j)"""


def _draws(s, d):
    t = V.scored(s, d)
    a = K.ranked(t.select("site_id", "hit", "score_a"), [("score_a", True), ("site_id", False)], "ra")
    b = K.ranked(t.select("site_id", "hit", "score_b"), [("score_b", True), ("site_id", False)], "rb")
    # only positives are drawn, so only they meet, and by a shuffle
    pos = a.where("hit >= 1").join(b.where("hit >= 1").select("site_id", "rb").hint("merge"), "site_id")
    return B.draws_of_positives(pos, "site_id", "hit", 200, ["ra", "rb"])


@query("e6_recall_interval", sql("scored", """SELECT 'plain' AS variant, round(avg(v),6) AS mean, round(quantile_cont(v,0.025),6) AS lo, round(quantile_cont(v,0.975),6) AS hi FROM (SELECT b, count(*) FILTER (ra<=200)/max(np)::DOUBLE AS v FROM dr GROUP BY 1)
  UNION ALL SELECT 'unique', round(avg(v),6), round(quantile_cont(v,0.025),6), round(quantile_cont(v,0.975),6) FROM (SELECT b, count(DISTINCT site_id) FILTER (ra<=200)/max(np)::DOUBLE AS v FROM dr GROUP BY 1)""", _POS))
def _(s, d):
    dr = _draws(s, d)
    out = [B.recall_interval(dr, "site_id", "ra", 200, unique=u).select(F.lit(n).alias("variant"), *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])
           for n, u in (("plain", False), ("unique", True))]
    return out[0].unionAll(out[1])


@query("e7_paired_delta", sql("scored", """SELECT round(avg(v),6) AS delta, round(quantile_cont(v,0.025),6) AS lo, round(quantile_cont(v,0.975),6) AS hi, round(avg((v>0)::INT),6) AS p_better FROM (
  SELECT b, (count(*) FILTER (ra<=200)-count(*) FILTER (rb<=200))/max(np)::DOUBLE AS v FROM dr GROUP BY 1)""", _POS))
def _(s, d):
    return B.paired_delta(_draws(s, d), "ra", "rb", 200).select(*[F.round(c, 6).alias(c) for c in ("delta", "lo", "hi", "p_better")])


_FOLD = """bl AS (SELECT *, (floor(y/2000)*100+floor(x/2000))::INT AS block FROM scored),
  bs AS (SELECT block, row_number() OVER (ORDER BY count(*) DESC, block)-1 AS p FROM bl GROUP BY 1),
  fo AS (SELECT bl.*, (CASE WHEN p%10<5 THEN p%10 ELSE 9-p%10 END)::INT AS fold FROM bl JOIN bs USING (block))"""


def blocked(s, d):
    t = V.scored(s, d).withColumn("block", (F.floor(F.col("y") / 2000) * 100 + F.floor(F.col("x") / 2000)).cast("int"))
    return folds.block_folds(t, "block", 5)


@query("m7_block_folds", sql("scored", "SELECT site_id, block, fold FROM fo", _FOLD))
def _(s, d):
    return blocked(s, d).select("site_id", "block", "fold")


@query("m7_seeded_block_folds", sql("scored", f"""SELECT site_id, (CASE WHEN p%10<5 THEN p%10 ELSE 9-p%10 END)::INT AS fold FROM scored JOIN (
  SELECT nation, row_number() OVER (ORDER BY count(*) DESC, ('0x'||substr(md5('7|'||nation),1,8))::BIGINT, nation)-1 AS p FROM scored GROUP BY 1) USING (nation)"""))
def _(s, d):
    return folds.block_folds(V.scored(s, d), "nation", 5, seed=7).select("site_id", "fold")


@query("m6_stratified_folds", sql("scored", "SELECT site_id, ((row_number() OVER (PARTITION BY hit ORDER BY ('0x'||substr(md5('42|'||site_id),1,8))::BIGINT, site_id)-1)%5)::INT AS fold FROM scored"))
def _(s, d):
    return folds.stratified_folds(V.scored(s, d), "site_id", "hit", 5, 42).select("site_id", "fold")


@query("a42_fold_power", sql("scored", "SELECT sum(p)::BIGINT AS n_pos, min(p)::BIGINT AS min_fold, max(p)::BIGINT AS max_fold, CASE WHEN sum(p)>=6 THEN 'REPORTABLE' ELSE 'UNDERPOWERED' END AS verdict FROM (SELECT fold, sum(hit) AS p FROM fo GROUP BY 1)", _FOLD))
def _(s, d):
    return folds.power_verdict(folds.fold_positives(blocked(s, d), "fold", "hit"))


_E9 = """x AS (SELECT fo.*, t.t AS threshold, (label>=t.t)::INT AS h FROM fo CROSS JOIN (VALUES (1),(2)) t(t)),
  ap AS (SELECT threshold, fold, sum(p*cp/cn)/max(np) AS auprc FROM (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY threshold, fold) AS np FROM (
    SELECT threshold, fold, score_a, sum(h)::DOUBLE AS p, count(*)::DOUBLE AS n FROM x GROUP BY ALL) WINDOW w AS (PARTITION BY threshold, fold ORDER BY score_a DESC)) WHERE np>0 GROUP BY ALL)"""

_SPLITS = """rf AS (SELECT site_id, ((row_number() OVER (PARTITION BY hit ORDER BY ('0x'||substr(md5('42|'||site_id),1,8))::BIGINT, site_id)-1)%5)::INT AS fold FROM scored),
  lo AS (SELECT 'spatial' AS split, site_id, fold, score_a, score_b, label FROM fo UNION ALL SELECT 'random', site_id, rf.fold, score_a, score_b, label FROM scored JOIN rf USING (site_id)),
  ok AS (SELECT split, fold, t.t AS threshold FROM lo CROSS JOIN (VALUES (1),(2)) t(t) GROUP BY ALL HAVING max(label)>=t.t)"""
_E9S = """sc AS (SELECT split, threshold, unnest([fold,-1]) AS scope, site_id, score_a, label, (label>=threshold)::INT AS h FROM lo JOIN ok USING (split, fold)),
  sap AS (SELECT split, threshold, scope, sum(p*cp/cn)/max(np) AS auprc FROM (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY split, threshold, scope) AS np FROM (
    SELECT split, threshold, scope, score_a, sum(h)::DOUBLE AS p, count(*)::DOUBLE AS n FROM sc GROUP BY ALL) WINDOW w AS (PARTITION BY split, threshold, scope ORDER BY score_a DESC)) GROUP BY ALL),
  ssp AS (SELECT split, threshold, scope, corr(ra,rb) AS rho FROM (SELECT split, threshold, scope, rank() OVER (PARTITION BY split, threshold, scope ORDER BY score_a)+(count(*) OVER (PARTITION BY split, threshold, scope, score_a)-1)/2.0 AS ra,
    rank() OVER (PARTITION BY split, threshold, scope ORDER BY label)+(count(*) OVER (PARTITION BY split, threshold, scope, label)-1)/2.0 AS rb FROM sc) GROUP BY ALL),
  src AS (SELECT split, threshold, scope, sum(h) FILTER (rn<=50)/greatest(sum(h),1) AS r50, sum(h) FILTER (rn<=100)/greatest(sum(h),1) AS r100 FROM (SELECT *, row_number() OVER (PARTITION BY split, threshold, scope ORDER BY score_a DESC, site_id) AS rn FROM sc) GROUP BY ALL)"""


def both_splits(s, d):
    """Every row once for each split: stratified random folds and whole blocks."""
    t = blocked(s, d)
    r = folds.stratified_folds(t.drop("fold"), "site_id", "hit", 5, 42)
    cols = ["site_id", "fold", "score_a", "score_b", "label"]
    return t.select(F.lit("spatial").alias("split"), *cols).unionByName(r.select(F.lit("random").alias("split"), *cols))


@query("e9_pooled_and_folded", sql("scored", """SELECT split, threshold::INT AS threshold, CASE WHEN scope=-1 THEN 'pooled' ELSE 'folds' END AS estimate, count(*) AS n_folds, round(avg(rho),6) AS spearman_rho, round(avg(auprc),6) AS auprc,
  round(avg(r50),6) AS recall_50, round(avg(r100),6) AS recall_100 FROM sap JOIN ssp USING (split, threshold, scope) JOIN src USING (split, threshold, scope) GROUP BY 1,2,3""", _FOLD + ", " + _SPLITS + ", " + _E9S))
def _(s, d):
    m = M.split_estimates(both_splits(s, d), "score_a", "site_id", "label", "split", "fold", (1, 2), (50, 100))
    return m.withColumns({c: F.round(c, 6) for c in ("spearman_rho", "auprc", "recall_50", "recall_100")})


@query("e9_a38_fold_averages", sql("scored", """SELECT 'spatial' AS split, threshold::INT AS threshold, count(*) AS n_folds, round(avg(rho),6) AS spearman_rho, round(avg(auprc),6) AS auprc, round(avg(r50),6) AS recall_50, round(avg(r100),6) AS recall_100
  FROM sap JOIN ssp USING (split, threshold, scope) JOIN src USING (split, threshold, scope) WHERE scope>=0 AND split='spatial' GROUP BY 2""", _FOLD + ", " + _SPLITS + ", " + _E9S))
def _(s, d):
    t = blocked(s, d).withColumn("split", F.lit("spatial"))
    m = M.split_estimates(t, "score_a", "site_id", "label", "split", "fold", (1, 2), (50, 100)).where("estimate = 'folds'").drop("estimate")
    return m.withColumns({c: F.round(c, 6) for c in ("spearman_rho", "auprc", "recall_50", "recall_100")})


@query("a38_fold_mean_std", sql("scored", "SELECT threshold::INT AS threshold, count(*) AS n_folds, round(avg(auprc),6) AS auprc_mean, round(stddev_pop(auprc),6) AS auprc_std FROM ap GROUP BY 1", _FOLD + ", " + _E9))
def _(s, d):
    x = blocked(s, d).withColumn("threshold", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("h", (F.col("label") >= F.col("threshold")).cast("int"))
    f = E.fold_summary(E.grouped_auprc(x, ["threshold", "fold"], "score_a", "h").where("n_pos > 0"), ["threshold"], ["auprc"])
    return f.withColumns({"auprc_mean": F.round("auprc_mean", 6), "auprc_std": F.round("auprc_std", 6)})


_ARMS = """arm AS (SELECT 'model_'||split AS arm, site_id, score_a AS score, label FROM lo JOIN ok USING (split, fold) WHERE threshold=1 AND (split='spatial' OR fold=0)
  UNION ALL SELECT 'base_'||split, site_id, score_b, label FROM lo JOIN ok USING (split, fold) WHERE threshold=1 AND (split='spatial' OR fold=0))"""
_CI = """pt AS (SELECT arm, corr(ra,rb) AS rho FROM (SELECT arm, rank() OVER (PARTITION BY arm ORDER BY score)+(count(*) OVER (PARTITION BY arm, score)-1)/2.0 AS ra, rank() OVER (PARTITION BY arm ORDER BY label)+(count(*) OVER (PARTITION BY arm, label)-1)/2.0 AS rb FROM arm) GROUP BY 1),
  ci AS (SELECT arm, rho, quantile_cont(spearman_rho,0.025) AS lo, quantile_cont(spearman_rho,0.975) AS hi FROM per JOIN pt USING (arm) GROUP BY 1,2)"""


def split_arms(s, d):
    """Model and baseline scores of both splits: the held-out fifth of the random one, all
    block folds with positives of the spatial one."""
    x = both_splits(s, d)
    ok = x.groupBy("split", "fold").agg(F.max("label").alias("_m")).where("_m >= 1 and (split = 'spatial' or fold = 0)").drop("_m")
    x = x.join(ok, ["split", "fold"], "left_semi")
    return x.select("site_id", "label", F.explode(F.array(*[F.struct(F.concat(F.lit(f"{n}_"), "split").alias("arm"), F.col(c).cast("double").alias("score")) for n, c in (("model", "score_a"), ("base", "score_b"))])).alias("a")).select("site_id", "label", "a.arm", "a.score")


@query("e10_verdicts", sql("scored", """SELECT CASE WHEN m.r>0 AND m.s>0 AND m.rl>b.rh AND m.sl>b.sh THEN 'PASS' WHEN m.r>0 THEN 'WEAK' ELSE 'FAIL' END AS verdict, round(m.r,6) AS random_rho, round(m.s,6) AS spatial_rho, m.rl>b.rh AS random_separated, m.sl>b.sh AS spatial_separated
  FROM (SELECT max(rho) FILTER (arm='model_random') AS r, max(rho) FILTER (arm='model_spatial') AS s, max(lo) FILTER (arm='model_random') AS rl, max(lo) FILTER (arm='model_spatial') AS sl FROM ci) m
  CROSS JOIN (SELECT max(hi) FILTER (arm='base_random') AS rh, max(hi) FILTER (arm='base_spatial') AS sh FROM ci) b""", ", ".join([_FOLD, _SPLITS, _ARMS, boot_sql("arm", "score", draws=400, ks=(), keys="arm"), _CI])))
def _(s, d):
    """Rank correlation of model and baseline on both splits, with bootstrap intervals."""
    x = stage(split_arms(s, d), "split_arms")
    per = B.bootstrap_metrics(x, "score", "label", "site_id", 400, key="arm")
    point = E.grouped_spearman(x, ["arm"], "score", "label")
    ci = B.interval(per, ["spearman_rho"], ["arm"]).join(point, "arm")
    pick = lambda c, arm: F.max(F.when(F.col("arm") == arm, F.col(c)))
    one = ci.agg(pick("spearman_rho", "model_random").alias("r"), pick("spearman_rho", "model_spatial").alias("s"), pick("lo", "model_random").alias("rl"), pick("lo", "model_spatial").alias("sl"),
                 pick("hi", "base_random").alias("rh"), pick("hi", "base_spatial").alias("sh"))
    v = E.verdict({"random_point": F.col("r"), "spatial_point": F.col("s"), "random_lo": F.col("rl"), "spatial_lo": F.col("sl"), "base_random_hi": F.col("rh"), "base_spatial_hi": F.col("sh")})
    return one.select(v.alias("verdict"), F.round("r", 6).alias("random_rho"), F.round("s", 6).alias("spatial_rho"), (F.col("rl") > F.col("rh")).alias("random_separated"), (F.col("sl") > F.col("sh")).alias("spatial_separated"))


@query("m1_persistence_and_frequency", sql("scored", "SELECT site_id, round(label+score_b/100,6) AS persistence, label::DOUBLE AS frequency FROM scored"))
def _(s, d):
    return V.scored(s, d).select("site_id", F.round(M.persistence_score(F.col("label"), F.col("score_b")), 6).alias("persistence"),
                                 M.frequency_score(F.col("label")).alias("frequency"))


@query("m13_rank_average", sql("scored", """SELECT site_id, round(-((row_number() OVER (ORDER BY score_a DESC, site_id)-1)/(count(*) OVER ())::DOUBLE+(row_number() OVER (ORDER BY score_b DESC, site_id)-1)/(count(*) OVER ())::DOUBLE)/2,6) AS ensemble FROM scored"""))
def _(s, d):
    return K.rank_average(V.scored(s, d), ["score_a", "score_b"], "site_id").withColumn("ensemble", F.round("ensemble", 6))


@query("a24_a25_harm", sql("ev scored", """SELECT round(f,4) AS fatal_share, e AS events, round(e*(f*15988000.0+(1-f)*1705100.0))::DOUBLE AS harm_usd, round(h*(f*15988000.0+(1-f)*1705100.0)*0.3)::DOUBLE AS prevented_usd FROM
  (SELECT coalesce(avg((severity=1)::INT),0.243) AS f FROM ev WHERE severity<=2 AND date BETWEEN '2000-01-01' AND '2001-08-01' AND state_hwy IS DISTINCT FROM 'Y') CROSS JOIN (SELECT sum(label)::BIGINT AS e FROM scored)
  CROSS JOIN (SELECT sum(label) AS h FROM (SELECT label FROM scored ORDER BY score_a DESC, site_id LIMIT 500))"""))
def _(s, d):
    from junctura.config import FATAL_COST, FATAL_SHARE_FALLBACK, SEVERE_COST
    from junctura.plans.panel import closed
    from junctura.config import TABLE_WINDOWS as W
    from junctura.functions.records import is_ksi, keeps_unknown
    ksi = V.events(s, d).where(is_ksi(F.col("severity")) & closed("date", W.label_start, W.label_end) & keeps_unknown(F.col("state_hwy"), "Y"))
    f = ksi.agg(F.coalesce(F.avg((F.col("severity") == 1).cast("int")), F.lit(FATAL_SHARE_FALLBACK)).alias("f"))
    t = V.scored(s, d)
    e = t.agg(F.sum("label").alias("events"))
    top = K.top_k(t.select("site_id", "score_a", "label"), "score_a", "site_id", 500).agg(F.sum("label").alias("h"))
    cost = F.col("f") * FATAL_COST + (1 - F.col("f")) * SEVERE_COST
    return attach(attach(f, e), top).select(F.round("f", 4).alias("fatal_share"), "events", F.round(F.col("events") * cost).alias("harm_usd"),
                                                F.round(F.col("h") * cost * 0.3).alias("prevented_usd"))


@query("a39_tier_lift", sql("scored", f"""SELECT site_id, k, caught, total, CASE WHEN caught>=3 THEN round((caught/k::DOUBLE)/(total/n::DOUBLE),6) END AS lift FROM (SELECT site_id, rank,
  CASE WHEN rank<=50 THEN 50 WHEN rank<=100 THEN 100 WHEN rank<=200 THEN 200 WHEN rank<=500 THEN 500 WHEN rank<=800 THEN 800 WHEN rank<=1000 THEN 1000 END::INT AS k, n FROM r) LEFT JOIN (
  SELECT k::INT AS k, count(*) FILTER (hit=1 AND rank<=k) AS caught, count(*) FILTER (hit=1) AS total FROM r CROSS JOIN (VALUES (50),(100),(200),(500),(800),(1000)) k(k) GROUP BY 1) USING (k)""",
  f"r AS (SELECT site_id, hit, {_RA} AS rank, count(*) OVER () AS n FROM scored)"))
def _(s, d):
    r = K.ranked(V.scored(s, d).select("site_id", "score_a", (F.col("hit") == 1).alias("pos")), [("score_a", True), ("site_id", False)])
    n = r.agg(F.count("*").alias("n_candidates"))
    t = tiers.tier_lift(r.select("site_id", "rank"), tiers.catch_table(r, "rank", "pos"), n, "rank")
    return t.select("site_id", "k", "caught", "total", F.round("lift", 6).alias("lift"))


@query("j31_claims", sql("scored", """SELECT claim, stated, found, CASE WHEN found IS NULL THEN 'REVIEW' WHEN abs(stated-found)<=0.01 THEN 'YES' ELSE 'NO' END AS match FROM (VALUES ('auprc',0.5::DOUBLE),('n_sites',0.0),('spearman',0.1)) c(claim,stated)
  LEFT JOIN (SELECT 'n_sites' AS claim, count(*)::DOUBLE AS found FROM scored UNION ALL SELECT 'auprc', (""" + _AP.replace("SELECT round(sum(p*cp/cn)/max(np),6) AS auprc, round(sum(p*(nn-np-(cn-cp)+(n-p)/2.0))/max(np*(nn-np)),6) AS auroc", "SELECT round(sum(p*cp/cn)/max(np),6)") + ")) USING (claim)"))
def _(s, d):
    from junctura.plans.audits import claims
    t = V.scored(s, d)
    stated = s.createDataFrame([("auprc", 0.5), ("n_sites", 0.0), ("spearman", 0.1)], "claim string, stated double")
    found = t.agg(F.count("*").cast("double").alias("found")).select(F.lit("n_sites").alias("claim"), "found").unionAll(
        E.auprc_auroc(t, "score_a", "hit").select(F.lit("auprc").alias("claim"), F.round("auprc", 6)))
    return claims(stated, found, 0.01)
