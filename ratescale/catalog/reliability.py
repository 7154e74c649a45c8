"""Rater reliability over the ratings view."""

from pyspark.sql import functions as F

from ratescale.catalog.registry import query
from ratescale.operators import reliability as rel

# the grid of variance ratios
GRID, LOW_EXP, HIGH_EXP = 200, -4.0, 4.0

LOO = """loo AS (SELECT *, CASE WHEN count(rating) OVER w > 1 THEN (sum(rating) OVER w - rating) / (count(rating) OVER w - 1) END AS leaveout_mean
 FROM {src} WINDOW w AS (PARTITION BY attribute, person_term, source))"""
CORRS = """corrs AS (SELECT submission_id, source, person_term, CASE WHEN min(rating) FILTER (WHERE leaveout_mean IS NOT NULL) < max(rating) FILTER (WHERE leaveout_mean IS NOT NULL)
 AND min(leaveout_mean) < max(leaveout_mean) THEN corr(rating, leaveout_mean) END AS c FROM loo GROUP BY 1, 2, 3)"""
CORRS_ALL = CORRS.replace(" source, person_term, CASE", " person_term, CASE").replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2")


@query("w1_leave_one_out", "ratings", f"WITH {LOO.format(src='ratings')} SELECT submission_id, attribute, person_term, rating, leaveout_mean FROM loo", num="rating leaveout_mean", ints="submission_id")
def _(t):
    return rel.leave_one_out(t.ratings).select("submission_id", "attribute", "person_term", "rating", "leaveout_mean")


@query("w2_rater_correlations", "ratings", f"WITH {LOO.format(src='ratings')}, {CORRS_ALL} SELECT submission_id, person_term, c AS leaveout_corr FROM corrs", num="leaveout_corr", ints="submission_id")
def _(t):
    return rel.rater_correlations(t.ratings)


@query("a32_loo_summary", "ratings", f"""WITH {LOO.format(src='ratings')}, {CORRS_ALL} SELECT person_term, avg(c) AS mean, stddev_samp(c) AS std, count(c) AS count FROM corrs GROUP BY 1
UNION ALL SELECT 'ALL', avg(c), stddev_samp(c), count(c) FROM corrs""", num="mean std", ints="count")
def _(t):
    return rel.loo_summary(rel.rater_correlations(t.ratings))


BY_SOURCE = f"""{LOO.format(src='ratings')}, {CORRS}, s AS (SELECT source AS dataset, avg(c) AS mean, stddev_samp(c) AS std, count(c) AS count FROM corrs GROUP BY 1)"""


@query("a33_loo_across", "ratings", f"WITH {BY_SOURCE} SELECT * FROM s UNION ALL SELECT 'all', avg(mean), sqrt(avg(std * std)), sum(count) FROM s", num="mean std", ints="count")
def _(t):
    return rel.loo_across(rel.loo_summary(rel.rater_correlations(t.ratings, by=["source"]), ["source"]))


def icc_sql(items: str, group: str, levels: int) -> str:
    """CTEs of the grid search; `items` names a table with `group`, n, m, ssw. Ends in table `best`."""
    step = (HIGH_EXP - LOW_EXP) / (GRID - 1)
    out = [f"cells AS (SELECT {group}, n, count(*) AS k, sum(m) AS s, sum(m*m) AS ss, sum(ssw) AS ssw FROM {items} GROUP BY {group}, n)"]
    for level in range(levels):
        prev = f"best{level - 1}"
        if level == 0:
            lam = f"SELECT c.*, CASE WHEN i < 0 THEN 0.0::DOUBLE ELSE pow(10.0::DOUBLE, {LOW_EXP}::DOUBLE + i * {step!r}::DOUBLE) END AS lam FROM cells c, range(-1, {GRID}) r(i)"
        else:
            fine = step / 100 ** (level - 1)
            same = " AND ".join(f"c.{g.strip()} = b.{g.strip()}" for g in group.split(","))
            lam = f"SELECT c.*, b.best * pow(10.0::DOUBLE, (i - {GRID // 2}) * {fine!r}::DOUBLE / {GRID // 2}) AS lam FROM cells c JOIN {prev} b ON {same}, range(0, {GRID + 1}) r(i)"
        out.append(f"g{level} AS ({lam})")
        out.append(f"""s{level} AS (SELECT {group}, lam, sum(k) AS items, sum(k*n) AS nn, sum(ssw) AS ssw, sum(k*n/(1+lam*n)) AS w, sum(n/(1+lam*n)*s) AS a,
 sum(n/(1+lam*n)*ss) AS b, sum(k*ln(1+lam*n)) AS l FROM g{level} GROUP BY {group}, lam)""")
        out.append(f"""c{level} AS (SELECT *, (nn-1)*ln((ssw + b - a*a/w)/(nn-1)) + l + ln(w) AS crit FROM s{level} WHERE ssw + b - a*a/w > 0)""")
        out.append(f"""best{level} AS (SELECT {group}, lam AS best, items, nn FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY crit, lam) AS rn FROM c{level}) q WHERE rn = 1)""")
    return ",\n".join(out)


ITEMS = """it AS (SELECT attribute, person_term, count(*)::DOUBLE AS n, avg(rating - 4.0::DOUBLE) AS m, var_pop(rating - 4.0::DOUBLE) * count(*) AS ssw FROM {src} GROUP BY 1, 2),
 scoped AS (SELECT person_term AS scope, n, m, ssw FROM it UNION ALL SELECT 'ALL', n, m, ssw FROM it)"""


def icc_out(best: str, key: str = "scope AS person_term", places: int = 4) -> str:
    r = lambda e: f"round({e}, {places})"
    one, k = "best/(best+1)", "best/(best + items/nn)"
    return f"""SELECT {key}, {r(one)} AS icc_1_1, {r(k)} AS icc_1_k, nn/items AS avg_k, {r(f'sqrt({one})')} AS icc_1_1_sqrt, {r(f'sqrt({k})')} AS icc_1_k_sqrt FROM {best}"""


def _round(df, places=4, skip=("avg_k",)):
    return df.select(*[F.round(c, places).alias(c) if d == "double" and c not in skip else F.col(c) for c, d in df.dtypes])


ICC_NUM = "icc_1_1 icc_1_k avg_k icc_1_1_sqrt icc_1_k_sqrt"


@query("a34_icc", "ratings", f"WITH {ITEMS.format(src='ratings')}, {icc_sql('scoped', 'scope', 3)} {icc_out('best2')}", num=ICC_NUM)
def _(t):
    return _round(rel.icc(t.ratings))


@query("a34_icc_coarse", "ratings", f"WITH {ITEMS.format(src='ratings')}, {icc_sql('scoped', 'scope', 1)} {icc_out('best0')}", num=ICC_NUM)
def _(t):
    return _round(rel.icc(t.ratings, levels=1))


@query("a35_test_ceiling", "ratings", f"""WITH kept AS (SELECT * FROM ratings WHERE k % 10 >= 7), {LOO.format(src='kept')}, {CORRS_ALL},
 sm AS (SELECT person_term, avg(c) AS loo FROM corrs GROUP BY 1 UNION ALL SELECT 'ALL', avg(c) FROM corrs), {ITEMS.format(src='kept')}, {icc_sql('scoped', 'scope', 3)}
SELECT sm.person_term, loo, round(sqrt(best/(best + items/nn)), 4) AS sqrt_icc FROM sm JOIN best2 ON sm.person_term = best2.scope""", num="loo sqrt_icc")
def _(t):
    return rel.test_ceiling(t.ratings, t.items.filter("k % 10 >= 7")).withColumn("sqrt_icc", F.round("sqrt_icc", 4))


@query("a34_ceiling_table", "ratings", f"""WITH {LOO.format(src='ratings')}, {CORRS}, sm AS (SELECT source, person_term, avg(c) AS mean, stddev_samp(c) AS std, count(c) AS count FROM corrs GROUP BY 1, 2
 UNION ALL SELECT source, 'ALL', avg(c), stddev_samp(c), count(c) FROM corrs GROUP BY 1),
 it AS (SELECT attribute, person_term, source, count(*)::DOUBLE AS n, avg(rating - 4.0::DOUBLE) AS m, var_pop(rating - 4.0::DOUBLE) * count(*) AS ssw FROM ratings GROUP BY 1, 2, 3),
 scoped AS (SELECT source, person_term AS scope, n, m, ssw FROM it UNION ALL SELECT source, 'ALL', n, m, ssw FROM it), {icc_sql('scoped', 'source, scope', 3)}
SELECT sm.source AS dataset, sm.person_term, mean, std, count, round(sqrt(best/(best+1)), 4) AS icc_1_1_sqrt, round(sqrt(best/(best + items/nn)), 4) AS icc_1_k_sqrt
FROM sm JOIN best2 b ON sm.source = b.source AND sm.person_term = b.scope""", num="mean std icc_1_1_sqrt icc_1_k_sqrt", ints="count")
def _(t):
    return _round(rel.ceiling_table(t.ratings), skip=("mean", "std"))


BOOT = 1000


@query("b4_icc_bootstrap", "ratings", f"""WITH scoped0 AS (SELECT submission_id, attribute, person_term, rating, person_term AS scope FROM ratings UNION ALL SELECT submission_id, attribute, person_term, rating, 'ALL' FROM ratings),
 nr AS (SELECT scope, count(DISTINCT submission_id) AS n FROM scoped0 GROUP BY 1),
 inc AS (SELECT scope, submission_id, rep FROM (SELECT DISTINCT scope, submission_id FROM scoped0) d JOIN nr USING (scope), range(0, {BOOT}) r(rep)
  WHERE ('0x' || substr(md5('42|' || scope || '|' || rep || '|' || submission_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 1 - pow(1 - 1.0::DOUBLE / n, n)),
 it AS (SELECT s.scope, rep, attribute, person_term, count(*)::DOUBLE AS n, avg(rating - 4.0::DOUBLE) AS m, var_pop(rating - 4.0::DOUBLE) * count(*) AS ssw
  FROM scoped0 s JOIN inc ON s.scope = inc.scope AND s.submission_id = inc.submission_id GROUP BY 1, 2, 3, 4),
 {icc_sql('it', 'scope, rep', 3)}, v AS (SELECT scope, best/(best+1) AS o, best/(best + items/nn) AS k FROM best2)
SELECT scope AS person_term, round(avg(o), 3) AS icc_1_1_mean, round(quantile_cont(o, 0.025), 3) AS icc_1_1_lo, round(quantile_cont(o, 0.975), 3) AS icc_1_1_hi,
 round(avg(k), 3) AS icc_1_k_mean, round(quantile_cont(k, 0.025), 3) AS icc_1_k_lo, round(quantile_cont(k, 0.975), 3) AS icc_1_k_hi FROM v GROUP BY 1""",
       num="icc_1_1_mean icc_1_1_lo icc_1_1_hi icc_1_k_mean icc_1_k_lo icc_1_k_hi")
def _(t):
    return _round(rel.icc_bootstrap(t.ratings, n_boot=BOOT), places=3, skip=())
