"""The registered queries, and SQL for those that SQL can express.

Sums of numbers depend on their order, so results are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import clip_id, natural_key, of_season, session_clip
from tidemark.functions.numbers import flattened, pearson, rounded
from tidemark.operators import align, kernels, lookup, metrics, pooling, regression, report, rows, splits, windows
from tidemark.plans import encoding
from tidemark.plans.study import clips, design, recordings, responses
from tidemark.sources.storage import table
from tidemark.streaming.responses import binned

FLAGSHIP = "lag_align_pearson"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Parts of the SQL that several queries share.
CLIPS = "t AS (SELECT label::BIGINT clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 tr, vec_id, embedding FROM embeddings)"
PAIRS = f"""{CLIPS}, i AS (SELECT unnest(range(1, 65)) p), a AS (SELECT x.clip, p - 1 parcel, x.embedding[p]::DOUBLE x, y.embedding[p]::DOUBLE y
  FROM t x JOIN t y ON x.clip = y.clip AND y.tr = x.tr + 3, i)"""
R = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"
RESPONSES = """b AS (SELECT event_type subject, floor(epoch(ts) / 864000.0::DOUBLE)::BIGINT clip, floor(epoch(ts) / 21600.0::DOUBLE)::BIGINT tr,
  user_id % 5 parcel, avg(value) y FROM events GROUP BY ALL)"""
ISC = f"""{RESPONSES}, p AS (SELECT a.subject sa, b.subject sb, a.clip, a.parcel, covar_pop(a.y, b.y) / nullif(stddev_pop(a.y) * stddev_pop(b.y), 0) r
  FROM b a JOIN b ON a.subject < b.subject AND a.clip = b.clip AND a.tr = b.tr AND a.parcel = b.parcel GROUP BY ALL),
z AS (SELECT clip, parcel, tanh(avg(atanh(greatest(-0.9999::DOUBLE, least(0.9999::DOUBLE, r))))) isc, count(*) n_pairs FROM p WHERE r IS NOT NULL GROUP BY ALL)"""
WINDOWS = """w AS (SELECT doc_id, n_chars / 10.0::DOUBLE secs, unnest(range(0, ceil(n_chars / 10.0::DOUBLE / 1.49::DOUBLE)::BIGINT)) tr_index FROM documents WHERE n_chars > 0),
c AS (SELECT *, tr_index * 1.49::DOUBLE s, greatest(0::DOUBLE, tr_index * 1.49::DOUBLE - 6::DOUBLE) chunk_start FROM w),
e AS (SELECT *, least(chunk_start + 8::DOUBLE, secs) chunk_end, s - chunk_start rel_start FROM c),
f AS (SELECT doc_id, tr_index, s, chunk_start, chunk_end, rel_start, least(rel_start + 1.49::DOUBLE, chunk_end - chunk_start) rel_end FROM e)"""
TOKENS_64 = "n AS (SELECT vec_id, (vec_id % 5) * 1.49::DOUBLE s, unnest(range(0, 64)) p, unnest(embedding)::DOUBLE v FROM embeddings)"
TOKENS_65 = "n AS (SELECT vec_id, (vec_id % 5) * 1.49::DOUBLE s, unnest(range(0, 65)) p, unnest(list_append(embedding, embedding[1]))::DOUBLE v FROM embeddings)"
CROP = """g AS (SELECT *, least({steps} - 1, round_even(s / 8 * {steps}, 0))::BIGINT i, p // {grid} step, p % {grid} - {ahead} spot FROM n),
c AS (SELECT *, least({steps}, greatest(i + 1, round_even((s + 1.49::DOUBLE) / 8 * {steps}, 0)))::BIGINT j, spot // {side} y, spot % {side} x FROM g)"""
BINS_4, BINS_2 = (f"(SELECT * FROM (VALUES {x}) q(k, lo, hi))" for x in ("(0, 0, 2), (1, 1, 3), (2, 2, 4)", "(0, 0, 1), (1, 0, 2), (2, 1, 2)"))
# One feature and 63 responses at each step, and sums of them by group.
ONE = f"""{CLIPS}, i AS (SELECT unnest(range(2, 65)) p), o AS (SELECT clip, tr, vec_id, p - 2 parcel, embedding[1]::DOUBLE x, embedding[p]::DOUBLE y FROM t, i)"""
SCORES = "round(covar_pop(p, y) / nullif(stddev_pop(p) * stddev_pop(y), 0), 6) r, round(1 - sum((y - p) ** 2) / sum((y - m) ** 2), 6) r2, count(*) n"
SUMMARY = "round(avg(r), 6) mean_r, round(median(r), 6) median_r, round(max(r), 6) max_r, round(avg((r > 0)::INT::DOUBLE) * 100, 6) pct_positive"
ALPHAS = "(SELECT unnest([0.1, 1, 10, 100, 1000])::DOUBLE alpha)"
TRAINING = "h AS (SELECT clip, row_number() OVER (ORDER BY clip) <= greatest(4, least(floor(count(*) OVER () * 0.8::DOUBLE), count(*) OVER () - 1)) train FROM (SELECT DISTINCT clip FROM t))"
TOKENS = "[[embedding[4 * k + d + 1]::DOUBLE for d in range(0, 4)] for k in range(0, 16)]"


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounds(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c)) for c in columns})


@query(f"WITH {PAIRS} SELECT parcel, round({R}, 6) r, count(*) n FROM a GROUP BY parcel")
def lag_align_pearson(spark, folder):
    return rounds(encoding.lag_correlations(clips(spark, folder)), "r")


@query(f"WITH {WINDOWS} SELECT doc_id, tr_index, round(s, 6) tr_start, round(s + 1.49::DOUBLE, 6) tr_end, round(chunk_start, 6) chunk_start, round(chunk_end, 6) chunk_end, round(rel_start, 6) rel_start, round(rel_end, 6) rel_end FROM f")
def chunk_windows(spark, folder):
    d = windows.chunk_windows(recordings(spark, folder), "seconds").drop("seconds")
    return rounds(d, "tr_start", "tr_end", "chunk_start", "chunk_end", "rel_start", "rel_end")


@query("""WITH n AS (SELECT label::BIGINT clip, count(*) n FROM embeddings GROUP BY label),
k AS (SELECT *, least(n, greatest(8, round_even(n * 0.3::DOUBLE, 0)::BIGINT)) k FROM n), s AS (SELECT *, unnest(range(0, k)) sample_no FROM k)
SELECT clip, n, sample_no, CASE WHEN k = 1 THEN 0 ELSE round_even(sample_no * ((n - 1)::DOUBLE / (k - 1)::DOUBLE), 0)::BIGINT END tr_index FROM s""")
def uniform_sample(spark, folder):
    sizes = table(spark, folder, "embeddings").groupBy(F.col("label").cast("long").alias("clip")).agg(F.count("*").alias("n"))
    return windows.uniform_sample(sizes, "n", 0.3)


@query(f"WITH {WINDOWS} SELECT doc_id, tr_index, round_even(chunk_start * 25::DOUBLE, 0)::BIGINT first_frame, least(round_even(chunk_start * 25::DOUBLE, 0)::BIGINT + round_even((chunk_end - chunk_start) * 25::DOUBLE, 0)::BIGINT, floor(n_chars / 10.0::DOUBLE * 25::DOUBLE)::BIGINT) end_frame FROM f JOIN documents USING (doc_id) WHERE end_frame > first_frame")
def frame_ranges(spark, folder):
    d = recordings(spark, folder).withColumn("fps", F.lit(25.0)).withColumn("frames", F.floor(F.col("seconds") * 25.0))
    return windows.frame_ranges(windows.chunk_windows(d, "seconds"), "fps", "frames").select("doc_id", "tr_index", "first_frame", "end_frame")


@query("""WITH n AS (SELECT doc_id, n_chars n FROM documents) SELECT doc_id, CASE WHEN n <= 0 THEN []::BIGINT[] WHEN n <= 64 THEN range(0, n)
ELSE [round_even(i * ((n - 1)::DOUBLE / 63::DOUBLE), 0)::BIGINT for i in range(0, 64)] END::VARCHAR frames FROM n""")
def frame_subsample(spark, folder):
    text = F.concat(F.lit("["), F.array_join(windows.frame_indices(F.col("n_chars"), 64).cast("array<string>"), ", "), F.lit("]"))
    return table(spark, folder, "documents").select("doc_id", text.alias("frames"))


@query(f"WITH {ISC} SELECT clip, parcel, round(isc, 6) isc, n_pairs FROM z")
def isc(spark, folder):
    return rounds(metrics.inter_subject(responses(spark, folder)), "isc")


@query(f"WITH {ISC}, q AS (SELECT parcel, avg(isc) isc FROM z GROUP BY parcel) SELECT round(avg(isc), 6) noise_ceiling, count(*) n FROM q")
def noise_ceiling(spark, folder):
    return rounds(metrics.noise_ceiling(responses(spark, folder)), "noise_ceiling")


@query("""WITH c AS (SELECT DISTINCT label::BIGINT clip FROM embeddings), r AS (SELECT clip, row_number() OVER (ORDER BY clip) rank, count(*) OVER () n FROM c)
SELECT clip, rank, rank <= greatest(4, least(floor(n * 0.8::DOUBLE), n - 1)) train FROM r""")
def clip_split(spark, folder):
    return splits.clip_split(table(spark, folder, "embeddings").select(F.col("label").cast("long").alias("clip")).distinct())


@query("SELECT vec_id, ntile(5) OVER (ORDER BY vec_id) - 1 fold FROM embeddings")
def kfold_assign(spark, folder):
    return splits.folds(table(spark, folder, "embeddings").select("vec_id"), 5, "vec_id")


@query("SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 shard FROM documents")
def shard_assign(spark, folder):
    return rows.dealt(table(spark, folder, "documents").select("doc_id"), 7, "doc_id", name="shard")


@query(f"""WITH {CLIPS}, i AS (SELECT unnest(range(1, 65)) p), a AS (SELECT vec_id, clip, p - 1 feature, embedding[p]::DOUBLE v FROM t, i),
m AS (SELECT feature, avg(v) m, stddev_pop(v) s FROM a WHERE clip < 8 GROUP BY feature)
SELECT vec_id, feature, round((v - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) z FROM a JOIN m USING (feature)""")
def standardize(spark, folder):
    d = clips(spark, folder).select("vec_id", "clip", F.posexplode("embedding").alias("feature", "v"))
    d = d.select("vec_id", "clip", F.col("feature").cast("long").alias("feature"), F.col("v").cast("double").alias("v"))
    return rounds(metrics.standardised(d.where("clip < 8"), d, "v", "feature").select("vec_id", "feature", "z"), "z")


@query("SELECT l_returnflag flag, round(1 - sum((l_extendedprice - p) ** 2) / sum((l_extendedprice - m) ** 2), 6) r2, round(covar_pop(p, l_extendedprice) / nullif(stddev_pop(p) * stddev_pop(l_extendedprice), 0), 6) r, count(*) n FROM (SELECT *, l_quantity * 1500::DOUBLE p, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) m FROM lineitem) GROUP BY 1")
def r2_by_group(spark, folder):
    d = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    return rounds(metrics.scores(d, "flag"), "r", "r2")


@query(f"""WITH {PAIRS}, m AS (SELECT *, avg(y) OVER (PARTITION BY clip, parcel) m FROM a),
s AS (SELECT clip, parcel, {R} r, 1 - sum((y - x) ** 2) / nullif(sum((y - m) ** 2), 0) r2 FROM m GROUP BY clip, parcel)
SELECT clip, round(avg(r), 6) mean_r, round(median(r), 6) median_r, round(avg(r2), 6) mean_r2, round(median(r2), 6) median_r2, count(*) n_parcels FROM s GROUP BY clip""")
def per_clip_metrics(spark, folder):
    d = encoding.clip_scores(encoding.lagged_pairs(clips(spark, folder)))
    return rounds(d, "mean_r", "median_r", "mean_r2", "median_r2")


@query(f"WITH {PAIRS}, s AS (SELECT clip, parcel, {R} r FROM a GROUP BY ALL) SELECT clip, round(avg(r), 6) mean_r, round(median(r), 6) median_r, round(max(r), 6) max_r, round(avg((r > 0)::INT::DOUBLE) * 100, 6) pct_positive FROM s GROUP BY clip")
def metric_summary(spark, folder):
    r = metrics.correlations(encoding.lagged_pairs(clips(spark, folder)), "clip", "parcel")
    return rounds(metrics.summary(r, "clip"), "mean_r", "median_r", "max_r", "pct_positive")


@query(f"WITH {PAIRS} SELECT parcel, round({R}, 6) r, count(*) n FROM a GROUP BY parcel ORDER BY r DESC NULLS LAST, parcel LIMIT 20")
def top_parcels(spark, folder):
    return report.top_parcels(rounds(encoding.lag_correlations(clips(spark, folder)), "r"))


@query("""WITH e AS (SELECT min(value) lo, max(value) hi FROM events), b AS (SELECT least(59, floor((value - lo) / ((hi - lo) / 60)))::BIGINT bin, lo, hi FROM events, e)
SELECT bin, round(min(lo) + bin * (min(hi) - min(lo)) / 60, 6) lo, count(*) n FROM b GROUP BY bin""")
def r_histogram(spark, folder):
    return rounds(report.histogram(table(spark, folder, "events").select("value"), "value"), "lo")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_keys(spark, folder):
    return align.missing(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), "doc_id")


@query("SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'standard') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 1.5)")
def unmatched_keys(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    used = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return align.unmatched(parts, used, "p_partkey", of_season(F.col("p_type"), "standard"), F.col("l_quantity") < 1.5)


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def shared_clips(spark, folder):
    return align.shared_keys(table(spark, folder, "events"), "user_id", "event_type")


@query("""WITH k AS (SELECT DISTINCT o_custkey FROM orders), n AS (SELECT o_custkey, count(*) n FROM orders GROUP BY 1), m AS (SELECT o_custkey FROM n WHERE n = 1)
SELECT c_custkey, o_orderkey FROM customer JOIN m ON c_custkey = o_custkey JOIN orders USING (o_custkey)""")
def match_once(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return align.matched_once(table(spark, folder, "customer").select("c_custkey"), orders, "c_custkey").select("c_custkey", "o_orderkey")


NEEDLES = "(SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN substr(s_name, 17, 2) ELSE substr(s_name, 1 + s_suppkey % 3 * 9, 9) END needle FROM supplier)"


def _needles(spark, folder) -> DataFrame:
    """Parts of suppliers' names; the shortest have two characters."""
    part = F.when(F.col("s_suppkey") % 7 == 0, F.substring("s_name", 17, 2)).otherwise(F.substr("s_name", F.col("s_suppkey") % 3 * 9 + 1, F.lit(9)))
    return table(spark, folder, "supplier").select("s_suppkey", part.alias("needle"))


@query(f"SELECT s_suppkey, needle, c_custkey FROM {NEEDLES} JOIN customer ON contains(c_name, needle)")
def substring_match(spark, folder):
    return align.contained(_needles(spark, folder), table(spark, folder, "customer").select("c_custkey", "c_name"), "needle", "c_name").select("s_suppkey", "needle", "c_custkey")


@query(f"SELECT s_suppkey, needle, min(c_custkey) c_custkey FROM {NEEDLES} JOIN customer ON contains(c_name, needle) GROUP BY ALL HAVING count(*) = 1")
def substring_once(spark, folder):
    return align.contained_once(_needles(spark, folder), table(spark, folder, "customer").select("c_custkey", "c_name"), "needle", "c_name").select("s_suppkey", "needle", "c_custkey")


@query("""WITH k AS (SELECT c_custkey, 'file' || c_custkey || '_part' || c_nationkey || '.mkv' name FROM customer),
n AS (SELECT *, [CASE WHEN regexp_full_match(t, '\\d+') THEN lpad(length(ltrim(t, '0'))::VARCHAR, 10, '0') || ltrim(t, '0') ELSE t END FOR t IN regexp_extract_all(lower(name), '(\\d+|\\D+)', 1)] key FROM k)
SELECT c_custkey, name, row_number() OVER (ORDER BY key) - 1 rank FROM n""")
def natural_sort(spark, folder):
    d = table(spark, folder, "customer").select("c_custkey", F.concat(F.lit("file"), "c_custkey", F.lit("_part"), "c_nationkey", F.lit(".mkv")).alias("name"))
    return rows.with_index(d.withColumn("key", natural_key(F.col("name"))), "key", name="rank").drop("key")


@query("""WITH k AS (SELECT c_custkey, 'ses-00' || c_nationkey || '_task-S0' || (c_custkey % 3) || 'E' || lpad((c_nationkey)::VARCHAR, 2, '0') || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'a' END key FROM customer)
SELECT c_custkey, nullif(regexp_extract(lower(key), '(s\\d{2}e\\d{2}[a-z])', 1), '') clip, 'friends_' || split_part(key, '_task-', 2) session, contains(lower(key), 'task-s01') season_1 FROM k""")
def session_keys(spark, folder):
    number = F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    key = F.concat(F.lit("ses-00"), "c_nationkey", F.lit("_task-S0"), F.col("c_custkey") % 3, F.lit("E"), number, F.when(F.col("c_custkey") % 4 == 0, "").otherwise("a"))
    d = table(spark, folder, "customer").withColumn("key", key)
    return d.select("c_custkey", clip_id(F.col("key")).alias("clip"), session_clip(F.col("key")).alias("session"), of_season(F.col("key")).alias("season_1"))


@query("SELECT o_orderkey voxel, (o_custkey % 6000)::BIGINT label, round(coalesce(c_acctbal, 0), 6) r FROM orders LEFT JOIN customer ON c_custkey = o_custkey % 6000")
def parcel_lookup(spark, folder):
    voxels = table(spark, folder, "orders").select(F.col("o_orderkey").alias("voxel"), (F.col("o_custkey") % 6000).alias("label"))
    parcels = table(spark, folder, "customer").select(F.col("c_custkey").alias("parcel"), F.col("c_acctbal").alias("r"))
    return rounds(lookup.at_voxels(voxels, parcels), "r").select("voxel", "label", "r")


@query("""WITH v AS (SELECT p_partkey vertex, CASE WHEN p_partkey % 2 = 0 THEN 'L' ELSE 'R' END hemi, round_even(p_partkey % 1100 + 0.4::DOUBLE, 0)::BIGINT k FROM part)
SELECT vertex, hemi, round(coalesce(c_acctbal, 0), 6) r FROM v LEFT JOIN customer ON c_custkey = CASE WHEN (hemi = 'L' AND k BETWEEN 1 AND 500) OR (hemi = 'R' AND k BETWEEN 501 AND 1000) THEN k END""")
def vertex_lookup(spark, folder):
    hemi = F.when(F.col("p_partkey") % 2 == 0, "L").otherwise("R")
    vertices = table(spark, folder, "part").select(F.col("p_partkey").alias("vertex"), hemi.alias("hemi"), (F.col("p_partkey") % 1100 + F.lit(0.4)).alias("label"))
    parcels = table(spark, folder, "customer").select(F.col("c_custkey").alias("parcel"), F.col("c_acctbal").alias("r"))
    return rounds(lookup.at_vertices(vertices, parcels), "r").select("vertex", "hemi", "r")


@query(f"WITH {RESPONSES} SELECT parcel, round(avg(r), 6) r FROM (SELECT subject, parcel, avg(y) r FROM b GROUP BY ALL) GROUP BY parcel")
def mean_over_subjects(spark, folder):
    own = responses(spark, folder).groupBy("subject", "parcel").agg(F.avg("y").alias("r"))
    return rounds(lookup.over_subjects(own), "r")


@query(f"WITH k AS (SELECT vec_id, {TOKENS} t FROM embeddings) SELECT vec_id, d, round(list_sum([x[d + 1] for x in t]) / 16, 6) v FROM k, (SELECT unnest(range(0, 4)) d)")
def mean_tokens_pool(spark, folder):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("embedding", k * 4 + 1, 4))
    d = pooling.pooled(table(spark, folder, "embeddings").withColumn("t", tokens), "t", "vec_id", out=None)
    d = d.select("vec_id", F.posexplode("pooled").alias("d", "v"))
    return rounds(d.withColumn("d", F.col("d").cast("long")), "v")


@query(f"""WITH k AS (SELECT vec_id, {TOKENS} t, (vec_id % 5) * 1.49::DOUBLE a FROM embeddings), f AS (SELECT *, least(3, round_even(a / 8 * 4, 0))::BIGINT i FROM k),
l AS (SELECT *, least(4, greatest(i + 1, round_even((a + 1.49::DOUBLE) / 8 * 4, 0)))::BIGINT j FROM f)
SELECT vec_id, i first_step, j end_step, d, round(list_sum([x[d + 1] for x in t[4 * i + 1:4 * j]]) / (4 * (j - i)), 6) v FROM l, (SELECT unnest(range(0, 4)) d)""")
def crop_pool(spark, folder):
    start = (F.col("vec_id") % 5) * F.lit(1.49)
    first, last = pooling.token_range(start, start + 1.49, 8.0, 4)
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("embedding", k * 4 + 1, 4))
    d = table(spark, folder, "embeddings").select("vec_id", first.alias("first_step"), last.alias("end_step"), tokens.alias("t"))
    d = pooling.pooled(d, "t", "vec_id", "first_step", "end_step", per_step=4, out=None, first="first_step", last="end_step")
    d = d.select("vec_id", "first_step", "end_step", F.posexplode("pooled").alias("d", "v"))
    return rounds(d.withColumn("d", F.col("d").cast("long")), "v")


@query(f"WITH {RESPONSES} SELECT subject, round(min(y), 6) least, round(max(y), 6) largest, round(avg(y), 6) mean FROM b GROUP BY subject")
def response_extent(spark, folder):
    return rounds(report.extent(responses(spark, folder), "y", "subject"), "least", "largest", "mean")


@query("SELECT vec_id, round(list_sum([x::DOUBLE for x in embedding]), 6) total FROM embeddings")
def flattened_sum(spark, folder):
    nested = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, 8))
    flat = flattened(nested).cast("array<double>")
    return rounds(table(spark, folder, "embeddings").select("vec_id", F.aggregate(flat, F.lit(0.0), lambda s, v: s + v).alias("total")), "total")


def _pooled(spark, folder, overlapping: bool) -> DataFrame:
    tokens = F.transform("embedding", lambda v: F.array(v))
    d = pooling.pooled(table(spark, folder, "embeddings").withColumn("t", tokens), "t", "vec_id", per_step=64, overlapping=overlapping)
    d = d.select("vec_id", F.posexplode("pooled").alias("bin", "v"))
    return rounds(d.withColumn("bin", F.col("bin").cast("long")), "v")


def _pool_sql(ends: str) -> str:
    return f"""WITH g AS (SELECT * FROM (VALUES {ends}) g(k, lo, hi)), i AS (SELECT unnest(range(0, 64)) p)
SELECT vec_id, (a.k * 3 + b.k)::BIGINT bin, round(avg(embedding[p + 1]::DOUBLE), 6) v FROM embeddings, i, g a, g b
WHERE p // 8 >= a.lo AND p // 8 < a.hi AND p % 8 >= b.lo AND p % 8 < b.hi GROUP BY ALL"""


@query(_pool_sql("(0, 0, 2), (1, 2, 5), (2, 5, 8)"))
def spatial_pool_bins(spark, folder):
    return _pooled(spark, folder, False)


@query(_pool_sql("(0, 0, 3), (1, 2, 6), (2, 5, 8)"))
def adaptive_pool(spark, folder):
    return _pooled(spark, folder, True)


@query(f"""WITH {TOKENS_64}, {CROP.format(steps=4, grid=16, ahead=0, side=4)}
SELECT vec_id, (a.k * 3 + b.k)::BIGINT bin, round(avg(v), 6) v FROM c, {BINS_4} a, {BINS_4} b
WHERE step >= i AND step < j AND y >= a.lo AND y < a.hi AND x >= b.lo AND x < b.hi GROUP BY ALL""")
def crop_pool_video(spark, folder):
    return _crop_pooled(spark, folder, 4, 16)


@query(f"""WITH {TOKENS_65}, {CROP.format(steps=13, grid=5, ahead=1, side=2)}
SELECT vec_id, (a.k * 3 + b.k)::BIGINT bin, round(avg(v), 6) v FROM c, {BINS_2} a, {BINS_2} b
WHERE spot >= 0 AND step >= i AND step < j AND y >= a.lo AND y < a.hi AND x >= b.lo AND x < b.hi GROUP BY ALL""")
def crop_pool_images(spark, folder):
    return _crop_pooled(spark, folder, 13, 5)


def _crop_pooled(spark, folder, steps: int, per_step: int) -> DataFrame:
    """Tokens of one number each; where there is one too few, the first comes once more."""
    start = (F.col("vec_id") % 5) * F.lit(1.49)
    tokens = F.transform(F.slice(F.concat("embedding", F.slice("embedding", 1, 1)), 1, steps * per_step), lambda v: F.array(v))
    d = table(spark, folder, "embeddings").withColumn("t", tokens)
    d = pooling.crop_pooled(d, "t", "vec_id", rel_start=start, rel_end=start + 1.49, length=8.0, steps=steps, per_step=per_step)
    d = d.select("vec_id", F.posexplode("pooled").alias("bin", "v"))
    return rounds(d.withColumn("bin", F.col("bin").cast("long")), "v")


@query(f"""WITH {PAIRS} SELECT parcel, round((sum(x * y) - sum(x) * sum(y) / count(*)) / (sum(x * x) - sum(x) * sum(x) / count(*) + 1000), 6) slope FROM a GROUP BY parcel""")
def ridge_univariate(spark, folder):
    d = encoding.lagged_pairs(clips(spark, folder)).select("parcel", F.array("x").alias("x"), F.array("y").alias("y"))
    return rounds(regression.ridge_fit(d, "parcel", form="sums").select("parcel", F.get("w", F.lit(0)).alias("slope")), "slope")


@query()
def ridge_primal(spark, folder):
    return rounds(encoding.ridge_test_scores(design(spark, folder)), "r", "r2")


def _blocks(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training rows by block of 20 steps, and each block's steps as test rows of the one before."""
    d = features.withColumn("block", F.floor(F.col("tr") / 20))
    return d, d.withColumn("block", F.col("block") - 1).drop("y")


def _next_block(features: DataFrame, **how) -> DataFrame:
    """Scores of each block of 20 steps by the fit to the block before it."""
    train, test = _blocks(features)
    p = kernels.kernel_ridge(train, test, "clip", "block", order=("tr",), **how)[1]
    pairs = regression.long_form(p.join(features.select("clip", "tr", "y"), ["clip", "tr"]), "clip")
    return rounds(metrics.scores(pairs, "clip", "parcel"), "r", "r2")


def _next_block_sql(alpha: str) -> str:
    return f"""WITH {ONE}, b AS (SELECT *, tr // 20 block FROM o), f AS (SELECT clip, block, parcel, avg(x) mx, avg(y) my, (sum(x * y) - sum(x) * sum(y) / count(*)) / (sum(x * x) - sum(x) * sum(x) / count(*) + {alpha}) w FROM b GROUP BY ALL),
e AS (SELECT b.clip, b.parcel, y, my + (x - mx) * w p FROM b JOIN f ON b.clip = f.clip AND b.parcel = f.parcel AND b.block = f.block + 1),
m AS (SELECT *, avg(y) OVER (PARTITION BY clip, parcel) m FROM e) SELECT clip, parcel, {SCORES} FROM m GROUP BY clip, parcel"""


@query()
def ridge_dual(spark, folder):
    return _next_block(design(spark, folder))


@query(_next_block_sql("1000"))
def ridge_dual_one(spark, folder):
    return _next_block(design(spark, folder, 1))


def _wide(spark, folder) -> DataFrame:
    """All products of two of the first 48 numbers as features, the other 16 as responses."""
    products = F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: a * b)))
    return design(spark, folder, 48).withColumn("x", products)


def _copies(spark, folder) -> DataFrame:
    """One feature, 500 times: as good as a penalty of a 500th."""
    return design(spark, folder, 1).withColumn("x", F.flatten(F.array_repeat("x", 500)))


@query()
def ridge_wide(spark, folder):
    return _next_block(_wide(spark, folder))


@query(_next_block_sql("2.0"))
def ridge_wide_one(spark, folder):
    return _next_block(_copies(spark, folder), numbers=2048)


def _left_out(features: DataFrame) -> DataFrame:
    """Of each block of steps the alpha of least leave-one-out error."""
    train = _blocks(features)[0]
    fits = kernels.kernel_ridge(train, None, "clip", "block", order=("tr",), alphas=regression.ALPHAS, scale=True)[0]
    return rounds(fits.select("clip", "block", "alpha", "mse", "n", "feature_dim"), "mse")


@query()
def loo_wide(spark, folder):
    return _left_out(_wide(spark, folder))


@query(f"""WITH {ONE}, s AS (SELECT *, tr // 20 block, x - avg(x) OVER w a, y - avg(y) OVER w c, stddev_pop(x) OVER w s, count(*) OVER w n FROM o WINDOW w AS (PARTITION BY clip, tr // 20, parcel)),
z AS (SELECT clip, block, parcel, n, a / CASE WHEN s > 1e-12 THEN s ELSE 1 END z, c FROM s), g AS (SELECT clip, block, parcel, sum(z * z) zz, sum(z * c) zc FROM z GROUP BY ALL),
e AS (SELECT clip, block, alpha, max(n) n, avg(((c - z * zc / (zz + alpha / 500)) / greatest(1e-12, 1 - 1.0::DOUBLE / n - z * z / (zz + alpha / 500))) ** 2) mse FROM z JOIN g USING (clip, block, parcel), {ALPHAS} GROUP BY ALL)
SELECT clip, block, arg_min(alpha, mse) alpha, round(min(mse), 6) mse, max(n) n, 500 feature_dim FROM e GROUP BY clip, block""")
def loo_wide_one(spark, folder):
    return _left_out(_copies(spark, folder))


@query(f"""WITH {ONE}, {TRAINING}, f AS (SELECT parcel, avg(x) mx, avg(y) my, (sum(x * y) - sum(x) * sum(y) / count(*)) / (sum(x * x) - sum(x) * sum(x) / count(*) + 1000) w FROM o JOIN h USING (clip) WHERE train GROUP BY parcel),
e AS (SELECT parcel, y, my + (x - mx) * w p FROM o JOIN h USING (clip) JOIN f USING (parcel) WHERE NOT train), m AS (SELECT *, avg(y) OVER (PARTITION BY parcel) m FROM e) SELECT parcel, {SCORES} FROM m GROUP BY parcel""")
def ridge_primal_one(spark, folder):
    return rounds(encoding.ridge_test_scores(design(spark, folder, 1)), "r", "r2")


@query()
def ridge_loo(spark, folder):
    return rounds(regression.loo_alpha(design(spark, folder, 8), "clip"), "mse")


@query(f"""WITH {ONE}, s AS (SELECT *, x - avg(x) OVER w a, y - avg(y) OVER w c, stddev_pop(x) OVER w s, count(*) OVER w n FROM o WINDOW w AS (PARTITION BY clip, parcel)),
z AS (SELECT clip, parcel, n, a / CASE WHEN s > 0 THEN s ELSE 1 END z, c FROM s), g AS (SELECT clip, parcel, sum(z * z) zz, sum(z * c) zc FROM z GROUP BY ALL),
e AS (SELECT clip, alpha, avg(((c - z * zc / (zz + alpha)) / (1 - 1.0 / n - z * z / (zz + alpha))) ** 2) mse FROM z JOIN g USING (clip, parcel), {ALPHAS} GROUP BY ALL)
SELECT clip, arg_min(alpha, mse) alpha, round(min(mse), 6) mse FROM e GROUP BY clip""")
def ridge_loo_one(spark, folder):
    return rounds(regression.loo_alpha(design(spark, folder, 1), "clip"), "mse")


def _kfold_sql(w: str) -> str:
    return f"""WITH {ONE}, k AS (SELECT clip, tr, ntile(5) OVER (ORDER BY clip, tr) fold FROM t), b AS (SELECT o.*, fold FROM o JOIN k USING (clip, tr)),
f AS (SELECT j.fold, parcel, count(*) n, avg(x) mx, avg(y) my, stddev_pop(x) s, covar_pop(x, y) / stddev_pop(x) c FROM b JOIN (SELECT unnest(range(1, 6)) fold) j ON b.fold <> j.fold GROUP BY ALL),
e AS (SELECT parcel, y, my + (x - mx) * {w} / s p FROM b JOIN f USING (fold, parcel)), q AS (SELECT parcel, coalesce(covar_pop(p, y) / nullif(stddev_pop(p) * stddev_pop(y), 0), 0) r FROM e GROUP BY parcel)
SELECT {SUMMARY} FROM q"""


@query()
def ridge_kfold(spark, folder):
    return rounds(encoding.cross_validated(design(spark, folder), 1000.0), "mean_r", "median_r", "max_r", "pct_positive")


@query(_kfold_sql("(n * c / (n + 1000))"))
def ridge_kfold_one(spark, folder):
    return rounds(encoding.cross_validated(design(spark, folder, 1), 1000.0), "mean_r", "median_r", "max_r", "pct_positive")


@query()
def lasso_kfold(spark, folder):
    return rounds(encoding.cross_validated(design(spark, folder), 0.01, "lasso"), "mean_r", "median_r", "max_r", "pct_positive")


@query(_kfold_sql("(sign(c) * greatest(abs(c) - 0.01, 0))"))
def lasso_kfold_one(spark, folder):
    return rounds(encoding.cross_validated(design(spark, folder, 1), 0.01, "lasso"), "mean_r", "median_r", "max_r", "pct_positive")


def _study(spark, folder, features: int) -> tuple[DataFrame, DataFrame]:
    """Features, and the responses of two subjects: the first and the other parcels."""
    d = design(spark, folder, features)
    half = F.floor(F.size("y") / 2).cast("int")
    parts = (("a", F.slice("y", F.lit(1), half)), ("b", F.slice("y", half + 1, F.size("y") - half)))
    own = F.inline(F.array(*[F.struct(F.lit(s).alias("subject"), y.alias("y")) for s, y in parts]))
    return d.select("clip", "tr", "x"), d.select("clip", "tr", "y").select("clip", "tr", "y", own).toDF("clip", "tr", "_", "subject", "y").select("subject", "clip", "tr", "y")


REPORTED = ("alpha", "lag_trs", "n_train_samples", "n_test_samples", "num_matched_clips", "num_targets", "mean_test_pearson", "median_test_pearson", "mean_test_r2", "median_test_r2")


def _reports(spark, folder, features: int) -> DataFrame:
    d = encoding.subject_analysis(*_study(spark, folder, features))[1]
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    tested = F.array_join(F.transform("per_clip_test_metrics", lambda c: F.concat_ws(":", c["clip"].cast("string"), c["num_test_trs"].cast("string"))), ",").alias("tested")
    d = d.select("subject", *REPORTED, ids("train_clip_ids"), ids("test_clip_ids"), tested)
    return rounds(d, *[c for c in REPORTED if "test_" in c and c != "n_test_samples"])


@query()
def subject_analysis(spark, folder):
    return _reports(spark, folder, 8)


@query(f"""WITH {ONE}, {TRAINING}, l AS (SELECT CASE WHEN a.parcel < 31 THEN 'a' ELSE 'b' END subject, a.clip, a.tr, a.parcel, train, a.x, b.y FROM o a JOIN o b ON a.clip = b.clip AND a.parcel = b.parcel AND b.tr = a.tr + 3 JOIN h ON a.clip = h.clip),
s AS (SELECT *, x - avg(x) OVER w a, y - avg(y) OVER w c, stddev_pop(x) OVER w s, count(*) OVER w n FROM l WHERE train WINDOW w AS (PARTITION BY parcel)), z AS (SELECT subject, parcel, n, a / s z, c FROM s),
g AS (SELECT parcel, sum(z * z) zz, sum(z * c) zc FROM z GROUP BY ALL), e AS (SELECT subject, alpha, avg(((c - z * zc / (zz + alpha)) / (1 - 1.0 / n - z * z / (zz + alpha))) ** 2) mse FROM z JOIN g USING (parcel), {ALPHAS} GROUP BY ALL),
k AS (SELECT subject, arg_min(alpha, mse) alpha FROM e GROUP BY subject), f AS (SELECT parcel, avg(x) mx, avg(y) my, stddev_pop(x) s FROM l WHERE train GROUP BY parcel),
p AS (SELECT l.subject, l.parcel, l.clip, y, my + (x - mx) / s * zc / (zz + alpha) p, avg(y) OVER (PARTITION BY l.parcel) m FROM l JOIN f USING (parcel) JOIN g USING (parcel) JOIN k ON k.subject = l.subject WHERE NOT train),
r AS (SELECT subject, parcel, coalesce(covar_pop(p, y) / nullif(stddev_pop(p) * stddev_pop(y), 0), 0) r, 1 - sum((y - p) ** 2) / sum((y - m) ** 2) r2 FROM p GROUP BY ALL),
c AS (SELECT subject, clip, train, count(DISTINCT tr) n, count(DISTINCT parcel) parcels FROM l GROUP BY ALL),
d AS (SELECT subject, sum(n) FILTER (train)::BIGINT n_train_samples, sum(n) FILTER (NOT train)::BIGINT n_test_samples, count(*) num_matched_clips, max(parcels)::INT num_targets, string_agg(clip::VARCHAR, ',' ORDER BY clip) FILTER (train) train_clip_ids,
string_agg(clip::VARCHAR, ',' ORDER BY clip) FILTER (NOT train) test_clip_ids, string_agg(clip || ':' || n, ',' ORDER BY clip) FILTER (NOT train) tested FROM c GROUP BY subject)
SELECT subject, alpha, 3 lag_trs, n_train_samples, n_test_samples, num_matched_clips, num_targets, round(avg(r), 6) mean_test_pearson, round(median(r), 6) median_test_pearson, round(avg(r2), 6) mean_test_r2, round(median(r2), 6) median_test_r2, train_clip_ids, test_clip_ids, tested
FROM r JOIN k USING (subject) JOIN d USING (subject) GROUP BY ALL""")
def subject_analysis_one(spark, folder):
    return _reports(spark, folder, 1)


def _sweep_features(d: DataFrame, width: int, start: int) -> DataFrame:
    """Features of two keys, and those of a third that has too few clips."""
    v = F.col("embedding").cast("array<double>")
    key = lambda name, at: d.select(F.lit(name).alias("feature_key"), "clip", "tr", F.slice(v, at, width).alias("x"))
    return key("first", 1).union(key("second", 1 + start)).union(key("few", 1).where("clip < 3"))


def _sweep(spark, folder, width: int, start: int) -> DataFrame:
    d = clips(spark, folder)
    y = F.slice(F.col("embedding").cast("array<double>"), F.lit(1 + start + width), F.size("embedding") - start - width)
    out = encoding.analysis_sweep(_sweep_features(d, width, start), d.select("clip", "tr", y.alias("y")), (0, 3), (1.0, 1000.0))
    return rounds(out, "mean_r", "median_r", "mean_r2", "median_r2")


@query()
def analysis_sweep(spark, folder):
    return _sweep(spark, folder, 16, 16)


@query(f"""WITH {CLIPS}, i AS (SELECT unnest(range(3, 65)) p), g AS (SELECT unnest([0, 3])::INT lag),
f AS (SELECT 'first' feature_key, clip, tr, embedding[1]::DOUBLE x FROM t UNION ALL SELECT 'second', clip, tr, embedding[2]::DOUBLE FROM t UNION ALL SELECT 'few', clip, tr, embedding[1]::DOUBLE FROM t WHERE clip < 3),
a AS (SELECT feature_key, lag, f.clip, f.tr, p parcel, x, t.embedding[p]::DOUBLE y FROM f, g, t, i WHERE t.clip = f.clip AND t.tr = f.tr + lag),
n AS (SELECT feature_key, lag, clip, count(DISTINCT tr) n FROM a GROUP BY ALL HAVING count(DISTINCT tr) > 1),
h AS (SELECT *, row_number() OVER (PARTITION BY feature_key, lag ORDER BY clip) rank, count(*) OVER (PARTITION BY feature_key, lag) c FROM n),
l AS (SELECT *, rank <= greatest(4, least(floor(c * 0.8::DOUBLE), c - 1)) train FROM h WHERE c >= 5), b AS (SELECT a.*, train FROM a JOIN l USING (feature_key, lag, clip)),
s AS (SELECT feature_key, lag, parcel, avg(x) mx, avg(y) my, stddev_pop(x) s, count(*) k, covar_pop(x, y) c FROM b WHERE train GROUP BY ALL), v AS (SELECT unnest([1, 1000])::DOUBLE alpha),
e AS (SELECT feature_key, lag, alpha, parcel, y, my + (x - mx) / s * (k * c / s) / (k + alpha) p FROM b JOIN s USING (feature_key, lag, parcel), v WHERE NOT train), m AS (SELECT *, avg(y) OVER (PARTITION BY feature_key, lag, alpha, parcel) m FROM e),
r AS (SELECT feature_key, lag, alpha, parcel, coalesce(covar_pop(p, y) / nullif(stddev_pop(p) * stddev_pop(y), 0), 0) r, 1 - sum((y - p) ** 2) / sum((y - m) ** 2) r2 FROM m GROUP BY ALL),
o AS (SELECT feature_key, lag, alpha, round(avg(r), 6) mean_r, round(median(r), 6) median_r, round(avg(r2), 6) mean_r2, round(median(r2), 6) median_r2 FROM r GROUP BY ALL),
q AS (SELECT feature_key, lag, sum(n) FILTER (train)::BIGINT n_train, sum(n) FILTER (NOT train)::BIGINT n_test FROM l GROUP BY ALL), u AS (SELECT feature_key, lag, max(c) n_clips FROM h GROUP BY ALL)
SELECT feature_key, lag, alpha, CASE WHEN n_clips IS NULL THEN 'no aligned steps' WHEN n_clips < 5 THEN 'too few clips to split: ' || n_clips ELSE 'ok' END status, coalesce(n_clips, 0) n_clips, n_train, n_test, mean_r, median_r, mean_r2, median_r2
FROM (SELECT DISTINCT feature_key FROM f) JOIN g ON true JOIN v ON true LEFT JOIN u USING (feature_key, lag) LEFT JOIN q USING (feature_key, lag) LEFT JOIN o USING (feature_key, lag, alpha)""")
def analysis_sweep_one(spark, folder):
    return _sweep(spark, folder, 1, 1)


@query(f"""WITH {CLIPS}, g AS (SELECT unnest([0, 1, 2, 3, 4, 5])::INT lag), i AS (SELECT unnest(range(1, 65)) p),
a AS (SELECT lag, p, x.embedding[p]::DOUBLE x, y.embedding[p]::DOUBLE y FROM g, t x JOIN t y ON x.clip = y.clip, i WHERE y.tr = x.tr + lag),
r AS (SELECT lag, p, {R} r, count(*) n FROM a GROUP BY lag, p) SELECT lag, round(avg(r), 6) mean_r, max(n) n FROM r GROUP BY lag""")
def lag_sweep(spark, folder):
    return rounds(encoding.sweep(clips(spark, folder), [0, 1, 2, 3, 4, 5]), "mean_r")


@query("SELECT s_suppkey % 4 AS subject, n_name feature_key, count(*) n FROM supplier JOIN nation ON true GROUP BY ALL")
def task_grid(spark, folder):
    subjects = table(spark, folder, "supplier").groupBy((F.col("s_suppkey") % 4).alias("subject")).count()
    features = table(spark, folder, "nation").select(F.col("n_name").alias("feature_key"))
    return subjects.crossJoin(F.broadcast(features)).select("subject", "feature_key", F.col("count").alias("n"))  # four rows by the nations


@query("SELECT round(quantile_cont(abs(c_acctbal), 0.95), 6) AS \"limit\" FROM customer WHERE c_acctbal <> 0")
def upper_nonzero(spark, folder):
    return rounds(report.upper_nonzero(table(spark, folder, "customer"), "c_acctbal"), "limit")


@query("SELECT round(max(greatest(abs(l_quantity), abs(l_discount))) * 1.05::DOUBLE, 6) AS \"limit\" FROM lineitem")
def axis_limit(spark, folder):
    return rounds(report.axis_limit(table(spark, folder, "lineitem"), "l_quantity", "l_discount"), "limit")


@query(f"""WITH {PAIRS}, r AS (SELECT clip, parcel, {R} r FROM a GROUP BY ALL)
SELECT p.clip, p.parcel, round(p.r, 6) r_a, round(q.r, 6) r_b FROM r p JOIN r q ON p.parcel = q.parcel AND q.clip = p.clip + 1""")
def model_comparison(spark, folder):
    r = metrics.correlations(encoding.lagged_pairs(clips(spark, folder)), "clip", "parcel")
    return rounds(report.side_by_side(r, r.withColumn("clip", F.col("clip") - 1), "clip", "parcel"), "r_a", "r_b")


@query("SELECT o_orderpriority priority, count(*) n, coalesce(list_position(['5-LOW', '1-URGENT', '3-MEDIUM'], o_orderpriority), 4)::INT place FROM orders GROUP BY ALL")
def listed_order(spark, folder):
    place = report.listed_order("priority", ["5-LOW", "1-URGENT", "3-MEDIUM"]).cast("int")
    d = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return d.withColumn("place", place).orderBy("place", "priority")


@query(f"""WITH {PAIRS}, r AS (SELECT clip, parcel, {R} r, count(*) n FROM a GROUP BY ALL), c AS (SELECT clip % 3 subject, clip, max(n) n_aligned, avg(r) r FROM r GROUP BY clip)
SELECT subject, count(*) n_clips, sum(n_aligned)::BIGINT n_samples, round(avg(r), 6) mean_r, string_agg(clip::VARCHAR, ',' ORDER BY clip) clips FROM c GROUP BY subject""")
def subject_report(spark, folder):
    r = metrics.correlations(encoding.lagged_pairs(clips(spark, folder)), "clip", "parcel")
    own = r.groupBy((F.col("clip") % 3).alias("subject"), "clip").agg(F.max("n").alias("n_aligned"), F.avg("r").alias("r"))
    d = report.subject_report(own)
    return rounds(d.withColumn("clips", F.array_join(F.transform("clips", lambda c: c["clip"].cast("string")), ",")), "mean_r")


@query(f"WITH {CLIPS} SELECT clip, count(*) n_steps, max(len(embedding))::INT dim, array_to_string(list_sort(list(DISTINCT vec_id))[1:10], ',') preview FROM t GROUP BY clip")
def alignment_counts(spark, folder):
    d = clips(spark, folder)
    counts = d.groupBy("clip").agg(F.count("*").alias("n_steps"), F.max(F.size("embedding")).alias("dim"))
    first = report.least_values(d, "vec_id", "preview", "clip")
    return counts.join(first, "clip").withColumn("preview", F.array_join(F.col("preview").cast("array<string>"), ","))


@query(f"WITH {CLIPS} SELECT a.clip, a.tr, a.vec_id, b.vec_id other FROM t a JOIN t b ON a.tr = b.tr AND b.clip = a.clip + 1")
def prefix_align(spark, folder):
    d = clips(spark, folder)
    other = d.select((F.col("clip") - 1).alias("clip"), "tr", F.col("vec_id").alias("other"))
    return align.same_length(d.select("clip", "tr", "vec_id"), other)


@query("SELECT event_type subject, user_id % 5 parcel, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) // 1000000 start, round(avg(value), 6) y, count(*) n FROM events GROUP BY ALL")
def binned_responses(spark, folder):
    return rounds(binned(table(spark, folder, "events")).withColumn("start", F.unix_seconds("start")), "y")


@query(f"WITH {PAIRS}, r AS (SELECT clip, parcel, {R} r FROM a GROUP BY ALL) SELECT clip subject, parcel % 4 feature_key, round(avg(r), 6) mean_r, round(median(r), 6) median_r, round(max(r), 6) max_r, round(avg((r > 0)::INT::DOUBLE) * 100, 6) pct_positive FROM r GROUP BY ALL")
def result_table(spark, folder):
    r = metrics.correlations(encoding.lagged_pairs(clips(spark, folder)), "clip", "parcel")
    d = metrics.summary(r.select(F.col("clip").alias("subject"), (F.col("parcel") % 4).alias("feature_key"), "r"), "subject", "feature_key")
    return rounds(report.result_table(d), "mean_r", "median_r", "max_r", "pct_positive")


@query(f"WITH {PAIRS} SELECT clip, parcel, round({R}, 6) r, count(*) n FROM a GROUP BY clip, parcel")
def clip_parcel_pearson(spark, folder):
    pairs = encoding.lagged_pairs(clips(spark, folder))
    return rounds(pairs.groupBy("clip", "parcel").agg(pearson(F.col("x"), F.col("y")).alias("r"), F.count("*").alias("n")), "r")
