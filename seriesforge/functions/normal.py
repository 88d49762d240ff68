"""Normal distribution as SQL expressions, the same text for any SQL engine.

``norm_ppf`` is Acklam's rational approximation (relative error 1.2e-9),
``norm_cdf`` Hart's algorithm as given by West (double precision).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients, highest power first.
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732537343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
CDF_N = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_D = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
PPF_SPLIT = 0.02425


def _poly(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]:.17e}"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c:.17e})"
    return out


def norm_ppf_sql(p: str) -> str:
    low, high = f"{PPF_SPLIT:.17e}", f"{1 - PPF_SPLIT:.17e}"
    tail = f"sqrt(-2e0 * ln({p}))"
    upper = f"sqrt(-2e0 * ln(1e0 - {p}))"
    r = f"(({p} - 5e-1) * ({p} - 5e-1))"
    return (
        f"CASE WHEN {p} < {low} THEN {_poly(PPF_C, tail)} / {_poly(PPF_D, tail)}"
        f" WHEN {p} > {high} THEN -1e0 * {_poly(PPF_C, upper)} / {_poly(PPF_D, upper)}"
        f" ELSE ({p} - 5e-1) * {_poly(PPF_A, r)} / {_poly(PPF_B, r)} END"
    )


def norm_cdf_sql(x: str) -> str:
    a = f"abs({x})"
    e = f"exp(-5e-1 * {x} * {x})"
    far = f"{e} / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 6.5e-1))))) / 2.506628274631e0"
    tail = f"(CASE WHEN {a} > 3.7e1 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {e} * {_poly(CDF_N, a)} / {_poly(CDF_D, a)} ELSE {far} END)"
    return f"CASE WHEN {x} > 0e0 THEN 1e0 - {tail} ELSE {tail} END"


def norm_ppf(column: str) -> Column:
    return F.expr(norm_ppf_sql(column))


def norm_cdf(column: str) -> Column:
    return F.expr(norm_cdf_sql(column))
