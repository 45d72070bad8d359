"""Registered queries over fitted terms and fits."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions.columns import tidy
from ..functions.special import weideman
from ..operators import fit, terms
from ..operators.terms import Parameter
from ..sources import adapters
from .images import ID
from .oracle import NUDGE, with_tables

ANY = Parameter(1.0)


def _term(term, *params):
    """Evaluate a term over all points with parameters taken from the rows."""

    def run(spark, d):
        rows = adapters.profiles(spark, d)
        y = term.calculate(F.col("q"), *[F.expr(p) for p in params])
        return rows.select(
            ID, F.col("pos").cast("long").alias("pos"), tidy(y).alias("y")
        )

    return run


def _term_sql(expression: str) -> str:
    return with_tables(
        "profiles",
        f"select measurement_id, pos, round({expression}, 6) as y from profiles",
    )


AMP = "cast(1 + measurement_id % 3 as double)"
CEN = "cast(label as double) * 0.5D + 1"
SIGMA = "0.2D + cast(label as double) * 0.05D"
GAMMA = "0.1D + cast(measurement_id % 5 as double) * 0.1D"
ALPHA = "cast(measurement_id % 7 as double) - 3"

S_AMP = "(1 + measurement_id % 3)"
S_CEN = "(label * 0.5::double + 1)"
S_SIGMA = "(0.2::double + label * 0.05::double)"
S_GAMMA = "(0.1::double + (measurement_id % 5) * 0.1::double)"
S_ALPHA = "(measurement_id % 7 - 3)"


def _voigt_sql(tail: str, extra: str = "") -> str:
    """The same series summed power by power in polar form."""
    scale, coefs = weideman()
    listed = ", ".join(f"{c!r}::double" for c in coefs)
    return with_tables(
        "profiles",
        f"""
, args as (
    select *, (q - {S_CEN}) / ({S_SIGMA} * sqrt(2)) as zx, {S_GAMMA} / ({S_SIGMA} * sqrt(2)) as zy,
           {scale!r}::double as l, [{listed}] as coefs from profiles)
, polar as (
    select *, sqrt(((l - zy) ** 2 + zx ** 2) / ((l + zy) ** 2 + zx ** 2)) as rho,
           atan2(zx, l - zy) - atan2(-zx, l + zy) as phi,
           (l + zy) ** 2 + zx ** 2 as den from args)
, sums as (
    select *, list_sum(list_transform(coefs, lambda a, i: a * rho ** (i - 1) * cos((i - 1) * phi))) as pr,
           list_sum(list_transform(coefs, lambda a, i: a * rho ** (i - 1) * sin((i - 1) * phi))) as pi_
    from polar)
, voigt as (
    select *, (2 * (pr * ((l + zy) ** 2 - zx ** 2) - pi_ * 2 * (l + zy) * zx) / den ** 2
               + (l + zy) / (den * sqrt(pi()))) / ({S_SIGMA} * sqrt(2 * pi())) as v from sums)
{extra}
{tail}""",
    )


def _skewed_sql() -> str:
    """The distribution function by its integral, on 2,000 steps of Simpson."""
    return _voigt_sql(
        f"""
select measurement_id, pos, round({S_AMP} ** 2 * 2 * v * cdf.phi, 6) as y
from voigt join cdf using (label, pos, alpha)""",
        f"""
, cells as (
    select distinct label, pos, measurement_id % 7 - 3 as alpha,
           {S_ALPHA} * (q - {S_CEN}) / {S_SIGMA} as z from profiles)
, cdf as (
    select label, pos, alpha, case when abs(z) > 9 then (z > 0)::int else
           0.5 + z / 6000 * sum((case when i = 0 or i = 2000 then 1 when i % 2 = 1 then 4 else 2 end)
                                * exp(-((z * i / 2000) ** 2) / 2)) / sqrt(2 * pi()) end as phi
    from cells, range(0, 2001) t(i) group by label, pos, alpha, z)""",
    ).replace("from voigt join", "from (select *, measurement_id % 7 - 3 as alpha from voigt) voigt join")


CURVE = terms.TermSum(
    (
        terms.InversePowerBackground(ANY, ANY, ANY),
        terms.GaussianPeak(ANY, ANY, ANY),
        terms.LorentzianPeak(ANY, ANY, ANY),
    )
)


def term_sum(spark, d):
    params = ["1.5D", AMP, "0.25D", AMP, CEN, SIGMA, "0.5D", CEN, GAMMA]
    y = CURVE.produce_function()(F.col("q"), *[F.expr(p) for p in params])
    return adapters.profiles(spark, d).select(
        ID, F.col("pos").cast("long").alias("pos"), tidy(y).alias("y")
    )


MODEL = terms.TermSum(
    (
        terms.GaussianPeak(
            Parameter(1.0, 0.0, 10.0),
            Parameter(2.5, 1.0, 6.0),
            Parameter(0.4, 0.1, 1.5),
        ),
        terms.ConstantBackground(Parameter(0.0, -5.0, 5.0)),
    )
)
GRID, ROUNDS = 9, 4


def _fit_rows(df, count):
    return df.select(
        ID,
        *[
            tidy(F.get("fit_params_all", F.lit(i)) + NUDGE).alias(f"p{i}")
            for i in range(count)
        ],
        tidy("sse").alias("sse"),
    )


def fit_grid(spark, d):
    fitted = fit.fit(
        adapters.peaked_profiles(spark, d), MODEL, grid=GRID, rounds=ROUNDS
    )
    return _fit_rows(fitted, 4)


def fit_curve(spark, d):
    rows = adapters.peaked_profiles(spark, d)
    fitted = fit.fit(rows, MODEL, grid=GRID, rounds=ROUNDS)
    return fit.fitted_curve(rows, fitted, MODEL).select(
        ID,
        F.col("pos").cast("long").alias("pos"),
        tidy("fitted_curve").alias("fitted_curve"),
    )


def _gauss_rounds() -> str:
    """The grid rounds in SQL. Within bounds, the best amplitude and constant
    are the free solution if it is allowed, else the best point of the four
    edges of the allowed rectangle."""
    sse = "yy - 2 * {a} * r1 - 2 * {k} * r2 + {a} * {a} * g11 + {k} * {k} * g22 + 2 * {a} * {k} * g12"
    edge_k = "greatest(-5, least(5, (r2 - {a} * g12) / g22))"
    edge_a = "greatest(0, least(10, (r1 - ({k}) * g12) / g11))"
    points = [("0::double", edge_k.format(a=0)), ("10::double", edge_k.format(a=10))]
    points += [(edge_a.format(k=k), f"{k}::double") for k in (-5, 5)]
    edges = ", ".join(f"{{'a': {a}, 'k': {k}}}" for a, k in points)
    solve = f"""
, s{{r}} as (
    select measurement_id, cand, c, s, sum(b * b) as g11, sum(b) as g12, count(*) as g22,
           sum(b * intensity) as r1, sum(intensity) as r2, sum(intensity ** 2) as yy
    from t{{r}} group by all)
, f{{r}} as (
    select *, (r1 * g22 - r2 * g12) / (g11 * g22 - g12 * g12) as fa,
           (r2 * g11 - r1 * g12) / (g11 * g22 - g12 * g12) as fk from s{{r}})
, p{{r}} as (
    select *, unnest(case when fa between 0 and 10 and fk between -5 and 5
                     then [{{{{'a': fa, 'k': fk}}}}]
                     else [{edges.replace("{", "{{").replace("}", "}}")}] end) as pt from f{{r}})
, a{{r}} as (
    select measurement_id, cand, any_value(c) as c, any_value(s) as s,
           arg_min(pt.a, {sse.format(a="pt.a", k="pt.k")}) as amp,
           arg_min(pt.k, {sse.format(a="pt.a", k="pt.k")}) as k,
           greatest(0, min({sse.format(a="pt.a", k="pt.k")})) as sse
    from p{{r}} group by measurement_id, cand)
, w{{r}} as (
    select * from (select *, row_number() over (partition by measurement_id
                       order by round(sse, 9), cand) as rn from a{{r}}) where rn = 1)
"""
    last = GRID - 1
    text = f"""
, o as (select i * {GRID} + j as cand, 2.0::double * i / {last} - 1 as oc, 2.0::double * j / {last} - 1 as os
        from range(0, {GRID}) a(i), range(0, {GRID}) b(j))
, t1 as (
    select p.*, cand, c, s, exp(-(((q - c) / s) ** 2) / 2) as b from peaked p, (
        select cand, greatest(1, least(6, 3.5::double + oc * 2.5)) as c,
               greatest(0.1::double, least(1.5::double, 0.8::double + os * 0.7::double)) as s from o
        union all select {GRID * GRID}, 2.5, 0.4::double) g)
""" + solve.format(r=1)
    half_c, half_s = "2.5::double", "0.7::double"
    for r in range(2, ROUNDS + 1):
        half_c, half_s = f"({half_c} * 2.0::double / {last})", f"({half_s} * 2.0::double / {last})"
        text += f"""
, h{r} as (
    select w.measurement_id, o.cand, greatest(1, least(6, w.c + oc * {half_c})) as c,
           greatest(0.1::double, least(1.5::double, w.s + os * {half_s})) as s
    from w{r - 1} w cross join o)
, t{r} as (
    select p.*, h.cand, h.c, h.s, exp(-(((q - h.c) / h.s) ** 2) / 2) as b
    from peaked p join h{r} h using (measurement_id))
""" + solve.format(r=r)
    return text


CUT = [(1.0, 1.75)]
CUT_MODEL = terms.TermSum(
    (
        terms.LorentzianPeak(
            Parameter(1.0, 0.0, 10.0), Parameter(2.0, 1.0, 6.0), Parameter(0.5, 0.1, 1.5)
        ),
    )
)


def fit_cutoff(spark, d):
    fitted = fit.fit(adapters.peaked_profiles(spark, d), CUT_MODEL, cutoff_ranges=CUT)
    return _fit_rows(fitted, 3)


def _cut_rounds() -> str:
    """The grid rounds of a Lorentzian with weights; its one linear parameter is
    the free one cut to its bounds."""
    solve = """
, f{r} as (
    select measurement_id, cand, c, s, sum(w * b * b) as bb, sum(w * b * y) as bys,
           sum(w * y * y) as yy from (
        select measurement_id, cand, c, s, intensity as y, s * s / ((q - c) ** 2 + s * s) as b,
               case when q > 1.0 and q < 1.75 then 1e-12::double else 1 end as w from t{r})
    group by all)
, e{r} as (select *, greatest(0, least(10, bys / bb)) as amp from f{r})
, a{r} as (select *, greatest(0, yy - 2 * amp * bys + amp * amp * bb) as sse from e{r})
, w{r} as (
    select * from (select *, row_number() over (partition by measurement_id
                       order by round(sse, 9), cand) as rn from a{r}) where rn = 1)
"""
    last = GRID - 1
    text = f"""
, o as (select i * {GRID} + j as cand, 2.0::double * i / {last} - 1 as oc, 2.0::double * j / {last} - 1 as os
        from range(0, {GRID}) a(i), range(0, {GRID}) b(j))
, t1 as (
    select p.*, cand, c, s from peaked p, (
        select cand, greatest(1, least(6, 3.5::double + oc * 2.5)) as c,
               greatest(0.1::double, least(1.5::double, 0.8::double + os * 0.7::double)) as s from o
        union all select {GRID * GRID}, 2.0, 0.5) g)
""" + solve.format(r=1)
    half_c, half_s = "2.5::double", "0.7::double"
    for r in range(2, ROUNDS + 1):
        half_c, half_s = f"({half_c} * 2.0::double / {last})", f"({half_s} * 2.0::double / {last})"
        text += f"""
, t{r} as (
    select p.*, o.cand, greatest(1, least(6, w.c + oc * {half_c})) as c,
           greatest(0.1::double, least(1.5::double, w.s + os * {half_s})) as s
    from peaked p join w{r - 1} w using (measurement_id) cross join o)
""" + solve.format(r=r)
    return text


FIT_CUTOFF = with_tables(
    "peaked",
    _cut_rounds()
    + f"""
select measurement_id, round(amp + {NUDGE}, 6) as p0, round(c + {NUDGE}, 6) as p1,
       round(s + {NUDGE}, 6) as p2, round(sse, 6) as sse
from w{ROUNDS}""",
)


# Two peaks that overlap, and a constant; shapes are fixed, bounds bind.
OVERLAP_BOUNDS = [(0.0, 2.5), (0.0, 3.0), (0.2, 1.2)]
OVERLAP_MODEL = terms.TermSum(
    (
        terms.GaussianPeak(Parameter(1.0, 0.0, 2.5), Parameter(2.4, 2.4, 2.4), Parameter(0.6, 0.6, 0.6)),
        terms.GaussianPeak(Parameter(1.0, 0.0, 3.0), Parameter(2.7, 2.7, 2.7), Parameter(0.6, 0.6, 0.6)),
        terms.ConstantBackground(Parameter(0.5, 0.2, 1.2)),
    )
)


def fit_overlap(spark, d):
    fitted = fit.fit(adapters.peaked_profiles(spark, d), OVERLAP_MODEL, grid=3, rounds=1, sweeps=1)
    return fitted.select(
        ID, *[tidy(F.get("fit_params_all", F.lit(i))).alias(f"p{n}") for n, i in enumerate((0, 3, 6))], tidy("sse").alias("sse")
    )


def _overlap_sql() -> str:
    """All 27 ways to put each of three parameters at its lower bound, at its
    upper bound or free; the best that keeps the bounds is the minimum."""
    names, ways = ("a", "b", "c"), []
    for way in itertools.product(("low", "high", "free"), repeat=3):
        at = {n: OVERLAP_BOUNDS[i][0 if way[i] == "low" else 1] for i, n in enumerate(names) if way[i] != "free"}
        free = [i for i in range(3) if way[i] == "free"]
        rest = {
            i: f"(r{i}" + "".join(f" - g{min(i, j)}{max(i, j)} * {at[n]}::double" for j, n in enumerate(names) if n in at) + ")"
            for i in free
        }
        g = lambda i, j: f"g{min(i, j)}{max(i, j)}"
        if len(free) == 1:
            solved = {free[0]: f"{rest[free[0]]} / {g(free[0], free[0])}"}
        elif len(free) == 2:
            i, j = free
            det = f"({g(i, i)} * {g(j, j)} - {g(i, j)} ** 2)"
            solved = {
                i: f"({rest[i]} * {g(j, j)} - {rest[j]} * {g(i, j)}) / {det}",
                j: f"({rest[j]} * {g(i, i)} - {rest[i]} * {g(i, j)}) / {det}",
            }
        else:
            minor = lambda i, j: f"({g((i + 1) % 3, (j + 1) % 3)} * {g((i + 2) % 3, (j + 2) % 3)} - {g((i + 1) % 3, (j + 2) % 3)} * {g((i + 2) % 3, (j + 1) % 3)})"
            det = "(" + " + ".join(f"{g(0, j)} * {minor(0, j)}" for j in range(3)) + ")" if free else "1"
            solved = {i: "(" + " + ".join(f"r{j} * {minor(j, i)}" for j in range(3)) + f") / {det}" for i in free}
        fields = [f"'{n}': {at[n]}::double" if n in at else f"'{n}': {solved[i]}" for i, n in enumerate(names)]
        ways.append("{" + ", ".join(fields) + "}")
    inside = " and ".join(f"w.{n} between {lo} and {hi}" for n, (lo, hi) in zip(names, OVERLAP_BOUNDS))
    squares = "yy - 2 * (w.a * r0 + w.b * r1 + w.c * r2) + w.a * w.a * g00 + w.b * w.b * g11 + w.c * w.c * g22 + 2 * (w.a * w.b * g01 + w.a * w.c * g02 + w.b * w.c * g12)"
    return with_tables(
        "peaked",
        f"""
, bases as (
    select measurement_id, intensity as y, exp(-(((q - 2.4::double) / 0.6::double) ** 2) / 2) as f0,
           exp(-(((q - 2.7::double) / 0.6::double) ** 2) / 2) as f1, 1::double as f2 from peaked)
, sums as (
    select measurement_id, sum(y * y) as yy, {", ".join(f"sum(f{i} * y) as r{i}" for i in range(3))},
           {", ".join(f"sum(f{i} * f{j}) as g{i}{j}" for i in range(3) for j in range(i, 3))}
    from bases group by 1)
, ways as (select *, unnest([{", ".join(ways)}]) as w from sums)
select measurement_id, round(arg_min(w.a, {squares}), 6) + 0.0 as p0, round(arg_min(w.b, {squares}), 6) + 0.0 as p1,
       round(arg_min(w.c, {squares}), 6) + 0.0 as p2, round(greatest(0, min({squares})), 6) as sse
from ways where {inside} group by measurement_id""",
    )


def fit_condition(spark, d):
    """Condition at known parameters of a single Gaussian."""
    peak = terms.TermSum((MODEL.functions[0],))
    known = adapters.profile_arrays(spark, d).select(
        ID,
        F.array(F.lit(2.0), F.col("label") * 0.3 + 2.0, F.lit(0.5)).alias(
            "fit_params_all"
        ),
    )
    out = fit.condition(adapters.profiles(spark, d), known, peak)
    return out.select(ID, tidy(F.log10("fit_cond"), 5).alias("log_cond"))


# Eigenvalues of a symmetric 3 x 3 matrix in closed form.
FIT_CONDITION = with_tables(
    "profiles",
    """
, j as (
    select measurement_id, exp(-(((q - c) / 0.5) ** 2) / 2) as a,
           2 * exp(-(((q - c) / 0.5) ** 2) / 2) * (q - c) / 0.25 as b,
           2 * exp(-(((q - c) / 0.5) ** 2) / 2) * (q - c) ** 2 / 0.125 as c
    from (select *, label * 0.3::double + 2.0::double as c from profiles))
, m as (
    select measurement_id, sum(a * a) as aa, sum(b * b) as bb, sum(c * c) as cc,
           sum(a * b) as ab, sum(a * c) as ac, sum(b * c) as bc from j group by 1)
, t as (
    select *, (aa + bb + cc) / 3 as mu from m)
, u as (
    select *, sqrt(((aa - mu) ** 2 + (bb - mu) ** 2 + (cc - mu) ** 2
                    + 2 * (ab ** 2 + ac ** 2 + bc ** 2)) / 6) as p from t)
, v as (
    select *, acos(greatest(-1, least(1, (
        (aa - mu) * ((bb - mu) * (cc - mu) - bc ** 2) - ab * (ab * (cc - mu) - bc * ac)
        + ac * (ab * bc - (bb - mu) * ac)) / p ** 3 / 2))) / 3 as angle from u)
select measurement_id, round(log10((mu + 2 * p * cos(angle))
       / (mu + 2 * p * cos(angle + 2 * pi() / 3))), 5) as log_cond
from v""",
)

QUERIES = {
    "term_constant": (
        _term(terms.ConstantBackground(ANY), AMP),
        _term_sql(S_AMP + "::double"),
    ),
    "term_inverse_power": (
        _term(terms.InversePowerBackground(ANY, ANY, ANY), GAMMA, AMP, SIGMA),
        _term_sql(f"{S_AMP} / (q ** {S_GAMMA}) + {S_SIGMA}"),
    ),
    "term_gaussian": (
        _term(terms.GaussianPeak(ANY, ANY, ANY), AMP, CEN, SIGMA),
        _term_sql(f"{S_AMP} * exp(-((q - {S_CEN}) ** 2) / (2 * {S_SIGMA} ** 2))"),
    ),
    "term_lorentzian": (
        _term(terms.LorentzianPeak(ANY, ANY, ANY), AMP, CEN, GAMMA),
        _term_sql(
            f"{S_AMP} * {S_GAMMA} ** 2 / ((q - {S_CEN}) ** 2 + {S_GAMMA} ** 2)"
        ),
    ),
    "term_voigt": (
        _term(terms.VoigtPeak(ANY, ANY, ANY, ANY), AMP, CEN, SIGMA, GAMMA),
        _voigt_sql(
            f"select measurement_id, pos, round({S_AMP} * v, 6) as y from voigt"
        ),
    ),
    "term_skewed_voigt": (
        _term(
            terms.SkewedVoigtPeak(ANY, ANY, ANY, ANY, ANY), AMP, CEN, SIGMA, GAMMA, ALPHA
        ),
        _skewed_sql(),
    ),
    "term_gamma": (
        _term(
            terms.GammaDistributionPeak(ANY, ANY, ANY, ANY),
            AMP,
            "0.35D",
            "1.25D + cast(label as double) * 0.5D",
            SIGMA,
        ),
        _term_sql(
            f"""{S_AMP} * greatest(q - 0.35::double, 0) ** (0.25::double + label * 0.5::double)
            * exp(-greatest(q - 0.35::double, 0) / {S_SIGMA})
            / (gamma(1.25::double + label * 0.5::double) * {S_SIGMA} ** (1.25::double + label * 0.5::double))"""
        ),
    ),
    "term_sum": (
        term_sum,
        _term_sql(
            f"""{S_AMP} / (q ** 1.5) + 0.25
            + {S_AMP} * exp(-((q - {S_CEN}) ** 2) / (2 * {S_SIGMA} ** 2))
            + 0.5 * {S_GAMMA} ** 2 / ((q - {S_CEN}) ** 2 + {S_GAMMA} ** 2)"""
        ),
    ),
    "fit_grid": (
        fit_grid,
        with_tables(
            "peaked",
            _gauss_rounds()
            + f"""select measurement_id, round(amp + {NUDGE}, 6) as p0, round(c + {NUDGE}, 6) as p1,
                        round(s + {NUDGE}, 6) as p2, round(k + {NUDGE}, 6) + 0.0 as p3,
                        round(sse, 6) as sse from w4""",
        ),
    ),
    "fit_curve": (
        fit_curve,
        with_tables(
            "peaked",
            _gauss_rounds()
            + """select measurement_id, pos, round(amp * exp(-(((q - c) / s) ** 2) / 2) + k, 6) as fitted_curve
                 from profiles join w4 using (measurement_id)""",
        ),
    ),
    "fit_cutoff": (fit_cutoff, FIT_CUTOFF),
    "fit_overlap": (fit_overlap, _overlap_sql()),
    "fit_condition": (fit_condition, FIT_CONDITION),
}
