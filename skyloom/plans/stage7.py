"""The registered queries over incremental products, width models, basins on two grids and other summaries, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.scalar import log_grid_edges
from skyloom.operators import aggregates as A
from skyloom.operators import designed as D
from skyloom.operators import filters as Q
from skyloom.operators import lines as L
from skyloom.operators import sampling as P
from skyloom.operators import windows as W
from skyloom.plans.stage2 import COADD, EVT, GRID, IMG, LINE, MIN_SLICE, SPEC, spec_coadd
from skyloom.plans.stage3 import wcs_row
from skyloom.sources import prepared as R
from skyloom.sources import products as T
from skyloom.sources import registry as G
from skyloom.sources import views as V
from skyloom.sources.scratch import materialize, shared_dir
from skyloom.sources.views import r6
from skyloom.streaming import resume

STATES = "target_id string, bin_id string, fingerprint string, ia int, ib int, jf int, chi2 double"


def q_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints that arrive in two rounds, some of other settings, made one product: the best state of each bin, and what is still pending."""
    at = f"{shared_dir(spark)}/skyloom/consolidate-{uuid.uuid4().hex}"
    states = V.surfaces(spark, sf_dir).withColumn("chi2", F.when(F.col("jf") != 3, F.col("chi2")))
    one = states.where("jf = 4").groupBy("target_id", "bin_id").agg(F.min("chi2").alias("chi2"))
    columns = [c.split()[0] for c in STATES.split(", ")]
    fresh = states.withColumn("fingerprint", F.lit("now")).select(*columns)

    def arrive(rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{at}/checkpoints")
        resume.consolidate_available(spark, f"{at}/checkpoints", STATES, f"{at}/product", f"{at}/progress", "now").awaitTermination()

    arrive(fresh.where("bin_id = 'A'").withColumn("chi2", F.col("chi2") - 7).unionByName(states.where("bin_id = 'N'").withColumn("fingerprint", F.lit("old")).select(*columns)))
    arrive(fresh.where("bin_id in ('A', 'R')"))  # A is fitted again, N only with other settings
    product = resume.read_consolidated(spark, f"{at}/product", STATES)
    found = R.consolidated(product, one, axes=("ia", "ib", "jf"))
    todo = G.resume_pending(states.select("target_id", "bin_id").distinct(), product.select("target_id", "bin_id", "fingerprint").distinct(), ("target_id", "bin_id"), "now")
    done = found.select("bin_id", r6("chi2_two").alias("chi2_two"), "n_states", "n_failed", "ia", "ib", "jf", r6("delta").alias("delta"), F.lit(False).alias("pending"))
    return done.unionByName(todo.select("bin_id", F.lit(True).alias("pending")), allowMissingColumns=True)


CONSOLIDATE = f"""WITH {GRID}, c AS (SELECT bin_id, ia, ib, jf, CASE WHEN jf <> 3 THEN chi2 END AS chi2 FROM grid), o AS (SELECT bin_id, min(chi2) AS one FROM c WHERE jf = 4 GROUP BY 1),
    b AS (SELECT bin_id, count(*) AS n, count(*) FILTER (chi2 IS NULL) AS nf, arg_min({{'ia': ia, 'ib': ib, 'jf': jf, 'c': chi2}}, (chi2, ia, ib, jf)) FILTER (chi2 IS NOT NULL) AS b FROM c GROUP BY 1)
    SELECT bin_id, CASE WHEN bin_id <> 'N' THEN round(b.c, 6) END AS chi2_two, CASE WHEN bin_id <> 'N' THEN n END AS n_states, CASE WHEN bin_id <> 'N' THEN nf END AS n_failed, CASE WHEN bin_id <> 'N' THEN b.ia END AS ia, CASE WHEN bin_id <> 'N' THEN b.ib END AS ib,
        CASE WHEN bin_id <> 'N' THEN b.jf END AS jf, CASE WHEN bin_id <> 'N' THEN round(one - b.c, 6) END AS delta, bin_id = 'N' AS pending FROM b LEFT JOIN o USING (bin_id)"""


def q_process_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of line items, some of which arrive later, summed by supplier as they come; a line number is whole when it comes."""
    at = f"{shared_dir(spark)}/skyloom/stream-{uuid.uuid4().hex}"
    items = V.table(spark, sf_dir, "lineitem").select("l_linenumber", "l_suppkey", "l_extendedprice")
    schema = "l_linenumber int, l_suppkey long, l_extendedprice double"

    def work(batch: DataFrame) -> DataFrame:
        return batch.groupBy("l_linenumber", "l_suppkey").agg(F.sum("l_extendedprice").alias("total"), F.count("*").alias("n"))

    for part in ("l_linenumber <= 4", "l_linenumber > 4", "l_linenumber > 9"):  # the last one brings nothing
        items.where(part).write.mode("append").parquet(f"{at}/in")
        resume.process_available(spark, f"{at}/in", schema, work, f"{at}/out", f"{at}/progress", "l_linenumber").awaitTermination()
    return spark.read.schema("l_suppkey long, total double, n long, l_linenumber int").parquet(f"{at}/out").select("l_linenumber", "l_suppkey", r6("total", 2).alias("total"), "n")


PROCESS_AVAILABLE = "SELECT l_linenumber, l_suppkey, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem GROUP BY 1, 2"


def q_width_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width models of three forms, one a bin in turn: coefficients, a saved grid, accepted lines; each over its support only."""
    rows = V.spec(spark, sf_dir).groupBy("bin_id", "chan", "wave").agg((3.0 + F.avg("flux")).alias("fwhm"))
    packed = rows.groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("wave", "fwhm"))).alias("s"))
    form = F.col("bin_id") % 3
    when = lambda k, c: F.when(form == k, c)
    models = packed.select(
        F.concat(F.lit("t"), "bin_id").alias("target_id"), F.lit("red").alias("arm"), when(0, F.array(1e-4 * (1 + F.col("bin_id")), F.lit(3.0))).alias("polynomial_coefficients"),
        F.when(form < 2, 4805.0 + F.col("bin_id")).alias("measurement_wavelength_min"), F.when(form < 2, F.lit(5400.0)).alias("measurement_wavelength_max"),
        when(1, F.col("s.wave")).alias("model_wave"), when(1, F.col("s.fwhm")).alias("model_fwhm"), when(2, F.col("s.wave")).alias("line_wavelengths"), when(2, F.col("s.fwhm")).alias("line_fwhms"),
    )
    found = R.line_width_table(models, order=1)
    return found.groupBy("target_id", "form").agg(F.count("*").alias("n"), r6(F.min("wave")).alias("first_wave"), r6(F.max("wave")).alias("last_wave"), r6(F.avg("fwhm")).alias("mean_fwhm"), r6(F.max_by("fwhm", "wave")).alias("last_fwhm"))


WIDTH_MODELS = f"""WITH {SPEC}, r AS (SELECT bin_id, wave, 3.0 + avg(flux) AS fwhm FROM spec GROUP BY 1, 2), l AS (SELECT bin_id, regr_slope(fwhm, wave) AS s, regr_intercept(fwhm, wave) AS i, min(wave) AS lo, max(wave) AS hi FROM r WHERE bin_id % 3 = 2 GROUP BY 1),
    g AS (SELECT * FROM r WHERE bin_id % 3 = 1 AND fwhm > 0 AND wave BETWEEN 4805.0 + bin_id AND 5400)
    SELECT 't' || bin_id AS target_id, 'polynomial' AS form, 2048 AS n, 4805.0::DOUBLE + bin_id AS first_wave, 5400.0::DOUBLE AS last_wave, round(3 + 1e-4 * (1 + bin_id) * (4805.0 + bin_id + 5400) / 2, 6) AS mean_fwhm, round(3 + 1e-4 * (1 + bin_id) * 5400, 6) AS last_fwhm FROM (SELECT DISTINCT bin_id FROM r WHERE bin_id % 3 = 0)
    UNION ALL SELECT 't' || bin_id, 'grid', count(*), min(wave), max(wave), round(avg(fwhm), 6), round(arg_max(fwhm, wave), 6) FROM g GROUP BY bin_id
    UNION ALL SELECT 't' || bin_id, 'lines', 2048, lo, hi, round(i + s * (lo + hi) / 2, 6), round(i + s * hi, 6) FROM l"""


def q_grid_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins of the surfaces and of their every other cell, matched by the cells that they share."""
    fine = V.surfaces(spark, sf_dir)
    even = " and ".join(f"{a} % 2 = 0" for a in ("ia", "ib", "jf"))
    coarse = fine.where(even).select("bin_id", *[F.expr(f"{a} div 2").cast("int").alias(a) for a in ("ia", "ib", "jf")], "chi2")
    found = D.grid_resolution_compare(coarse, fine, 2, ("bin_id",))
    return found.select("bin_id", "n_coarse", "n_fine", "n_matched", "n_split", r6("agreement").alias("agreement"))


def basins_sql(grid: str, name: str) -> str:
    """CTEs that end in `name` (bin_id, ia, ib, jf, m): the minimum that each cell descends to."""
    return f"""{name}_n AS (SELECT a.bin_id, a.ia, a.ib, a.jf, arg_min((b.ia, b.ib, b.jf), (b.chi2, b.ia, b.ib, b.jf)) AS t, min(b.chi2) < any_value(a.chi2) AS down
        FROM {grid} a JOIN {grid} b ON a.bin_id = b.bin_id AND abs(a.ia - b.ia) <= 1 AND abs(a.ib - b.ib) <= 1 AND abs(a.jf - b.jf) <= 1 AND (a.ia, a.ib, a.jf) <> (b.ia, b.ib, b.jf) GROUP BY ALL),
    {name}_w AS (SELECT bin_id, ia, ib, jf, ia AS ca, ib AS cb, jf AS cf FROM {grid} UNION ALL
        SELECT w.bin_id, w.ia, w.ib, w.jf, t[1], t[2], t[3] FROM {name}_w w JOIN {name}_n n ON n.bin_id = w.bin_id AND n.ia = ca AND n.ib = cb AND n.jf = cf WHERE down),
    {name} AS (SELECT w.bin_id, w.ia, w.ib, w.jf, (ca, cb, cf) AS m FROM {name}_w w JOIN {name}_n n ON n.bin_id = w.bin_id AND n.ia = ca AND n.ib = cb AND n.jf = cf WHERE NOT down)"""


GRID_RESOLUTION = f"""WITH RECURSIVE {GRID}, half AS (SELECT bin_id, ia // 2 AS ia, ib // 2 AS ib, jf // 2 AS jf, chi2 FROM grid WHERE ia % 2 = 0 AND ib % 2 = 0 AND jf % 2 = 0), {basins_sql("grid", "fb")}, {basins_sql("half", "cb")},
    p AS (SELECT cb.bin_id, cb.m AS c, fb.m AS f, count(*) AS n FROM cb JOIN fb ON cb.bin_id = fb.bin_id AND cb.ia = fb.ia // 2 AND cb.ib = fb.ib // 2 AND cb.jf = fb.jf // 2 GROUP BY 1, 2, 3),
    q AS (SELECT *, row_number() OVER (PARTITION BY bin_id, c ORDER BY n DESC, f) = 1 AND row_number() OVER (PARTITION BY bin_id, f ORDER BY n DESC, c) = 1 AS matched, count(*) OVER (PARTITION BY bin_id, c) AS k FROM p)
    SELECT bin_id, count(DISTINCT c) AS n_coarse, count(DISTINCT f) AS n_fine, count(*) FILTER (matched) AS n_matched, count(DISTINCT c) FILTER (k > 1) AS n_split, round(coalesce(sum(n) FILTER (matched), 0) / sum(n), 6) AS agreement FROM q GROUP BY 1"""


def q_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two components' ages and metallicities, by weighted quantiles, for each line number as a bin."""
    rows = V.table(spark, sf_dir, "lineitem").select(
        F.lit("demo").alias("target_id"), F.col("l_linenumber").alias("bin_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("solution"), F.log("l_extendedprice").alias("log_age_a"), F.log(F.col("l_quantity") * 1000).alias("log_age_b"),
        F.col("l_discount").alias("metal_a"), F.col("l_tax").alias("metal_b"), F.col("l_quantity").alias("weight"),
    )
    found = D.contrasts(rows)
    return found.select("bin_id", "quantity", *[r6(c).alias(c) for c in ("q_16", "q_50", "q_84")])


CONTRASTS = """WITH v AS (SELECT l_linenumber AS bin_id, l_orderkey || '-' || l_linenumber AS t, 'd_age' AS quantity, ln(l_extendedprice) - ln(l_quantity * 1000) AS x, l_quantity AS w FROM lineitem
        UNION ALL SELECT l_linenumber, l_orderkey || '-' || l_linenumber, 'd_metal', l_discount - l_tax, l_quantity FROM lineitem),
    s AS (SELECT *, sum(w) OVER o / sum(w) OVER (PARTITION BY bin_id, quantity) AS c FROM v WINDOW o AS (PARTITION BY bin_id, quantity ORDER BY x, t ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT *, lag(c) OVER o AS c0, lag(x) OVER o AS x0 FROM s WINDOW o AS (PARTITION BY bin_id, quantity ORDER BY x, t)),
    q AS (SELECT bin_id, quantity, q, coalesce(min(CASE WHEN c >= q AND c0 < q THEN x0 + (x - x0) * (q - c0) / (c - c0) END), max(CASE WHEN c0 IS NULL AND c >= q THEN x END), max(x)) AS v FROM l, (VALUES (0.16), (0.5), (0.84)) t(q) GROUP BY 1, 2, 3)
    SELECT bin_id, quantity, round(max(v) FILTER (q = 0.16), 6) AS q_16, round(max(v) FILTER (q = 0.5), 6) AS q_50, round(max(v) FILTER (q = 0.84), 6) AS q_84 FROM q GROUP BY 1, 2"""


def q_inclination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the inclination prior for every part: axis ratio and its error from its price and size."""
    p = V.table(spark, sf_dir, "part")
    targets = p.select(F.col("p_partkey").alias("target_id"), (0.3 + 0.6 * (F.col("p_retailprice") - 900) / 1200).alias("q"), (0.002 * F.col("p_size")).alias("qe"), F.lit(0.2).alias("q0"), F.lit(0.03).alias("q0e"))
    return P.inclination_prior(targets, 200).select("target_id", *[r6(c, 5).alias(c) for c in ("p16", "p50", "p84")])


INCLINATION = f"""WITH d AS (SELECT p_partkey AS target_id, 0.3 + 0.6 * (p_retailprice - 900) / 1200 AS q, 0.002 * p_size AS qe, 0.5 + i * {P.PLASTIC[0]}::DOUBLE AS u, 0.5 + i * {P.PLASTIC[1]}::DOUBLE AS v FROM part, range(1, 201) r(i)),
    n AS (SELECT target_id, least(1.0, greatest(1e-4, q + qe * sqrt(-2 * ln(u - floor(u))) * cos(2 * pi() * (v - floor(v))))) AS q, least(0.999, greatest(0.0, 0.2 + 0.03 * sqrt(-2 * ln(u - floor(u))) * sin(2 * pi() * (v - floor(v))))) AS q0 FROM d),
    i AS (SELECT target_id, quantile_cont(degrees(acos(sqrt(least(1.0, greatest(0.0, (q * q - q0 * q0) / (1 - q0 * q0)))))), [0.16, 0.5, 0.84]) AS p FROM n GROUP BY 1)
    SELECT target_id, round(p[1], 5) AS p16, round(p[2], 5) AS p50, round(p[3], 5) AS p84 FROM i"""


def q_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running mass of each surface's states, the likeliest first."""
    rows = P.likelihood_weights(V.surfaces(spark, sf_dir), ("bin_id",))
    found = W.cumulative_mass(rows, ("bin_id",), (F.col("chi2"), "ia", "ib", "jf"))
    return found.select("bin_id", "ia", "ib", "jf", r6("cum", 9).alias("cum"))


CUMULATIVE = f"""WITH {GRID}, w AS (SELECT *, exp(-0.5 * (chi2 - min(chi2) OVER (PARTITION BY bin_id))) AS w FROM grid)
    SELECT bin_id, ia, ib, jf, round(sum(w) OVER (PARTITION BY bin_id ORDER BY chi2, ia, ib, jf ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY bin_id), 9) AS cum FROM w"""


def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of valid, non-positive and extreme bins and the worst of them."""
    bins = Q.sn_qc(A.achieved_sn(spec_coadd(spark, sf_dir), 4700.0, 5000.0, 0.04, min_channels=5), min_channels=5, extreme=2.0, factor=3.0)
    found = R.diagnostic_report(bins)
    return found.select("target_id", "n_bins", "n_valid", "n_nonpositive", "n_extreme", F.col("worst.bin_id").alias("worst"), r6("worst.legacy").alias("legacy"))


REPORT = f"""WITH b AS ({MIN_SLICE}) SELECT 'demo' AS target_id, count(*) AS n_bins, count(sn) AS n_valid, count(*) FILTER (nonpositive) AS n_nonpositive, count(*) FILTER (extreme) AS n_extreme,
    arg_min(bin_id, (legacy, bin_id)) AS worst, min(legacy) AS legacy FROM b"""


def q_optional_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with the correlations of their event type's days, where the type has some, and without any such product."""
    evt = V.events(spark, sf_dir)
    bins = evt.groupBy("arm", "spaxel").agg(F.count("*").alias("n"))
    lags = evt.where("arm <> 'click'").groupBy("arm", F.col("day").alias("lag")).agg(r6(F.avg("value")).alias("correlation"))
    have, none = L.optional_correlation(bins, lags, ("arm",)), L.optional_correlation(bins, None, ("arm",))
    shown = have.join(none.select("arm", "spaxel", F.col("lags").alias("nothing")), ["arm", "spaxel"])
    return shown.select("arm", "spaxel", "n", F.size("lags").alias("n_lags"), r6(F.get("lags", F.lit(0))).alias("first_lag"), r6(F.element_at("lags", -1)).alias("last_lag"), F.col("nothing").isNull().alias("without"))


OPTIONAL_CORRELATION = f"""WITH {EVT}, l AS (SELECT arm, day, round(avg(value), 6) AS c FROM evt WHERE arm <> 'click' GROUP BY 1, 2), p AS (SELECT arm, count(*) AS k, arg_min(c, day) AS a, arg_max(c, day) AS b FROM l GROUP BY 1)
    SELECT arm, spaxel, count(*) AS n, any_value(k) AS n_lags, any_value(a) AS first_lag, any_value(b) AS last_lag, true AS without FROM evt LEFT JOIN p USING (arm) GROUP BY 1, 2"""


def q_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as arcs and as maps beside them, found by name, by the start of a name, or by what their headers share."""
    p = V.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    head = {"OFNAME": F.col("p_name"), "CAMERA": F.col("p_brand"), "IFUNAM": F.when(key % 4 > 0, F.col("p_type")), "BINNING": F.col("p_size").cast("string"), "BGRATNAM": F.lit("g"), "RGRATNAM": F.lit(None).cast("string")}
    columns = [v.alias(k) for k, v in head.items()]
    folder = F.concat(F.lit("d"), F.floor(key / 5)).alias("dir")
    arcs = p.where(key % 5 == 0).select(key.cast("string").alias("arc_id"), folder, F.concat(F.lit("r"), key).alias("root"), *columns)
    kind = F.element_at(F.array(F.lit("wavemap"), F.lit("slicemap"), F.lit("posmap"), F.lit("other")), (key % 5).cast("int"))
    owner = (F.floor(key / 5) * 5).cast("string")
    root = F.when(key % 5 == 1, F.concat(F.lit("r"), owner)).when(key % 5 == 2, F.concat(F.lit("r"), owner, F.lit("_s"))).otherwise(F.concat(F.lit("x"), key))
    own = p.select(F.col("p_partkey").cast("string").alias("owner"), *[F.col(c).alias(f"o_{c}") for c in ("p_name", "p_brand", "p_type")], F.col("p_size").cast("string").alias("o_size"))
    maps = p.where(key % 5 > 0).withColumn("owner", owner).join(own, "owner")
    theirs = [F.when(key % 3 > 0, F.col("o_p_name")).otherwise(F.col("p_name")).alias("OFNAME"), F.col("o_p_brand").alias("CAMERA"), F.col("o_p_type").alias("IFUNAM"), F.col("o_size").alias("BINNING"), F.lit("g").alias("BGRATNAM"), F.lit("z").alias("RGRATNAM")]
    files = maps.select(F.concat(F.lit("p"), key).alias("path"), folder, root.alias("root"), kind.alias("kind"), *theirs)
    return G.match_sidecars(arcs, files).select("arc_id", "kind", "path", "rule", "n")


SIDECARS = """WITH m AS (SELECT a.p_partkey AS arc, b.p_partkey AS k, lower(trim(a.p_name)) = lower(trim(b.p_name)) AS alike FROM part a JOIN part b ON b.p_partkey // 5 = a.p_partkey // 5 AND a.p_partkey % 5 = 0 AND b.p_partkey % 5 BETWEEN 1 AND 3)
    SELECT arc::VARCHAR AS arc_id, CASE k % 5 WHEN 1 THEN 'wavemap' WHEN 2 THEN 'slicemap' ELSE 'posmap' END AS kind, 'p' || k AS path, CAST(k % 5 AS INT) AS rule, 1 AS n FROM m WHERE k % 5 < 3 OR k % 3 > 0 OR alike"""


def q_log_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples counted in pixels of equal width in the logarithm of their wavelength."""
    spec = V.spec(spark, sf_dir)
    ends = spec.agg(F.min("wave").alias("lo"), F.max("wave").alias("hi")).first()
    edges = log_grid_edges(ends["lo"], ends["hi"], 700.0)
    pix = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("wave"))) - 1
    inside = spec.withColumn("pix", pix).where(F.col("wave") < edges[-1])
    width = F.lit(edges[1] / edges[0])
    return inside.groupBy("pix").agg(F.count("*").alias("n"), r6(F.sum("flux"), 4).alias("flux")).select("pix", "n", "flux", r6(F.lit(edges[0]) * F.pow(width, F.col("pix"))).alias("left"), F.lit(len(edges) - 1).alias("n_pix"))


LOG_PIXELS = f"""WITH {SPEC}, e AS (SELECT min(wave) AS lo, max(wave) AS hi, 700.0 / 299792.458::DOUBLE AS s FROM spec), k AS (SELECT *, CAST(floor(ln(hi / lo) / s + 1e-9) AS INT) AS n FROM e),
    p AS (SELECT i AS pix, lo * exp(i * s) AS l, lo * exp((i + 1) * s) AS r, n FROM k, range(0, n) t(i))
    SELECT CAST(pix AS INT) AS pix, count(*) AS n, round(sum(flux), 4) AS flux, round(any_value(l), 6) AS left, any_value(p.n) AS n_pix FROM spec JOIN p ON wave >= l AND wave < r GROUP BY pix"""


def q_fir_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's months smoothed by local parabolas over five months."""
    rows = V.line(spark, sf_dir).groupBy("bin_id", "chan").agg(F.avg("flux").alias("v"))
    lo = rows.groupBy("bin_id").agg(F.min("chan").alias("lo"))
    dense = materialize(rows.join(lo, "bin_id").withColumn("filled", F.when(F.col("chan") % 7 != 3, F.col("v"))).where("filled is not null"), "months")
    numbered = dense.withColumn("chan", (F.row_number().over(W.Window.partitionBy("bin_id").orderBy("chan")) - 1).cast("int"))
    return W.fir_smooth(numbered.select("bin_id", "chan", "filled"), 5, 2, ("bin_id",)).select("bin_id", "chan", r6("smooth", 3).alias("smooth"))


FIR_SMOOTH = f"""WITH {LINE}, m AS (SELECT bin_id, chan, avg(flux) AS v FROM line GROUP BY 1, 2), n AS (SELECT bin_id, v, row_number() OVER (PARTITION BY bin_id ORDER BY chan) - 1 AS k, count(*) OVER (PARTITION BY bin_id) AS n FROM m WHERE chan % 7 <> 3),
    c AS (SELECT bin_id, k, greatest(2, least(n - 3, k)) AS mid FROM n), w AS (SELECT c.bin_id, c.k, c.k - mid AS off, n.k - mid AS d, n.v FROM c JOIN n ON n.bin_id = c.bin_id AND abs(n.k - mid) <= 2)
    SELECT bin_id, CAST(k AS INT) AS chan, round(sum(v) * 17 / 35.0 - sum(v * d * d) / 7.0 + any_value(off) * sum(v * d) / 10.0 + any_value(off) ** 2 * (sum(v * d * d) / 14.0 - sum(v) / 7.0), 3) AS smooth FROM w GROUP BY 1, 2"""

def q_master_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of bins, written with the maps and spectra and read again."""
    img = V.image(spark, sf_dir)
    members = img.select("target_id", "bin_id", "y", "x", F.col("value").alias("signal"), F.lit(900.0).alias("noise"))
    coadd = materialize(spec_coadd(spark, sf_dir), "coadd")
    sn = [A.achieved_sn(coadd, low, low + 300, 0.0, require_positive=positive).drop("arm") for low, positive in ((4850.0, True), (5100.0, False))]
    bins = T.master_bins(members, img.where("x % 3 = 0"), *sn, wcs_row(spark, 0.3, 25.0, 12.0), centre=(10.0, 24.0), scale=0.3)
    at = f"{shared_dir(spark)}/skyloom/bins-{uuid.uuid4().hex}"
    T.write_bins(bins, f"{at}/bins")
    back = spark.read.parquet(f"{at}/bins")
    moved = img.where("x % 3 = 0").select("target_id", "y", "x", "bin_id", (F.col("x") * 0.01).alias("match_distance"))
    T.write_bin_products(at, members, moved, back, coadd)
    maps = spark.read.parquet(f"{at}/maps").groupBy("bin_id").agg(F.count_if(F.col("arm") == "a").alias("n_map_a"), F.count_if(F.col("arm") == "b").alias("n_map_b"), r6(F.sum("bin_area"), 4).alias("map_area"), r6(F.sum("match_distance"), 4).alias("map_distance"))
    spectra = spark.read.parquet(f"{at}/spectra").groupBy("bin_id").agg(F.sum("n_contrib").alias("n_contrib"))
    whole = ("bin_id", "npix_a", "npix_b", "n_channels_a", "n_channels_b", "single")
    return back.join(maps, "bin_id").join(spectra, "bin_id", "left").select(*whole, *[r6(c, 5).alias(c) for c in T.BIN_COLUMNS if c not in whole], "n_map_a", "n_map_b", "map_area", "map_distance", "n_contrib")


def arm_sql(low: float, positive: bool, arm: str) -> str:
    keep = "CASE WHEN f > 0 THEN f / u END" if positive else "f / u"
    return f"""{arm}0 AS (SELECT bin_id, count(*) AS k, median(flux) AS f, median(unc) AS u, min(unc) AS m, median(flux / unc) AS l, avg(CASE WHEN flux < 0 THEN 1.0 ELSE 0 END) AS neg FROM coadd WHERE good AND unc > 0 AND wave BETWEEN {low} AND {low + 300} GROUP BY 1),
    {arm} AS (SELECT bin_id, k AS n_channels_{arm}, {keep} AS sn_{arm}, f / u AS sn_signed_{arm}, l AS sn_legacy_{arm}, f AS median_flux_{arm}, u AS median_unc_{arm}, m AS min_unc_{arm}, neg AS negative_fraction_{arm} FROM {arm}0)"""


_ROUNDED = ", ".join(f"round({c}, 5) AS {c}" for c in T.BIN_COLUMNS if c not in ("bin_id", "npix_a", "npix_b", "n_channels_a", "n_channels_b", "single"))
MASTER_BINS = f"""WITH {COADD}, {IMG}, {arm_sql(4850.0, True, "a")}, {arm_sql(5100.0, False, "b")},
    w AS (SELECT *, CASE WHEN sum(greatest(value, 0)) OVER g > 0 THEN greatest(value, 0) / sum(greatest(value, 0)) OVER g ELSE 1.0 / count(*) OVER g END AS w FROM img WINDOW g AS (PARTITION BY bin_id)),
    e AS (SELECT bin_id, count(*) AS npix_a, count(*) FILTER (x % 3 = 0) AS npix_b, count(*) * 0.09::DOUBLE AS area, count(*) FILTER (x % 3 = 0) / count(*) AS coverage, avg(x) AS xm, avg(y) AS ym, sum(w * x) / sum(w) AS xl, sum(w * y) / sum(w) AS yl,
        greatest(sum(value) / sqrt(count(*) * 810000.0), 0) AS power_sn, sum(x * 0.01::DOUBLE) FILTER (x % 3 = 0) AS md FROM w GROUP BY 1),
    t AS (SELECT *, radians(-0.3 / 3600 * (xl + 1 - 25)) AS xi, radians(0.3 / 3600 * (yl + 1 - 12)) AS eta, radians(2.0::DOUBLE) AS d0 FROM e),
    s AS (SELECT *, power_sn ** 2 AS capacity, npix_a = 1 AS single, (xm - 24) * 0.3 AS x_geom, (ym - 10) * 0.3 AS y_geom, (xl - 24) * 0.3 AS x_flux, (yl - 10) * 0.3 AS y_flux, 150.0::DOUBLE + degrees(atan2(xi, cos(d0) - eta * sin(d0))) AS ra,
        degrees(atan2(sin(d0) + eta * cos(d0), sqrt(xi * xi + (cos(d0) - eta * sin(d0)) ** 2))) AS dec FROM t), nc AS (SELECT bin_id, CAST(sum(n_contrib) AS BIGINT) AS n_contrib FROM coadd GROUP BY 1)
    SELECT s.bin_id, npix_a, npix_b, n_channels_a, n_channels_b, single, {_ROUNDED}, npix_a AS n_map_a, npix_b AS n_map_b, round(area * npix_a, 4) AS map_area, round(md, 4) AS map_distance, n_contrib
    FROM s LEFT JOIN a USING (bin_id) LEFT JOIN b USING (bin_id) LEFT JOIN nc USING (bin_id)"""

QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}
ORACLES = {
    "q_consolidate": CONSOLIDATE, "q_process_available": PROCESS_AVAILABLE, "q_width_models": WIDTH_MODELS, "q_grid_resolution": GRID_RESOLUTION, "q_contrasts": CONTRASTS, "q_inclination": INCLINATION, "q_cumulative": CUMULATIVE,
    "q_report": REPORT, "q_optional_correlation": OPTIONAL_CORRELATION, "q_sidecars": SIDECARS, "q_log_pixels": LOG_PIXELS, "q_fir_smooth": FIR_SMOOTH, "q_master_bins": MASTER_BINS,
}
