"""Stage formulas of the time integrator as column updates on a nodal table.

Columns: f and df for the fields ux, uy, uz, p, phi, temp; the old state has suffix _old."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ALPHA_F, ALPHA_M, DT, FIELDS, GAMMA

c = F.col


def alpha_stage(df: DataFrame) -> DataFrame:
    """{f}_a and d{f}_a: fields and rates at the intermediate time; p takes its rate as it is, and no value."""
    out = {}
    for f in FIELDS:
        if f == "p":
            out |= {"dp_a": c("dp"), "p_a": F.lit(0.0)}
        else:
            out[f"d{f}_a"] = F.lit(1 - ALPHA_M) * c(f"d{f}_old") + F.lit(ALPHA_M) * c(f"d{f}")
            out[f"{f}_a"] = c(f"{f}_old") + F.lit(DT * ALPHA_F * (1 - GAMMA)) * c(f"d{f}_old") + F.lit(DT * ALPHA_F * GAMMA) * c(f"d{f}")
    return df.withColumns(out)


def predictor(df: DataFrame) -> DataFrame:
    """Rates scaled by (gamma - 1) / gamma, but for p."""
    return df.withColumns({f"d{f}": F.lit((GAMMA - 1) / GAMMA) * c(f"d{f}") for f in FIELDS if f != "p"})


def corrector(df: DataFrame) -> DataFrame:
    """Fields advanced by the old and new rates, but for p; then the new rates become the old ones."""
    moved = df.withColumns({f: c(f) + F.lit(DT * (1 - GAMMA)) * c(f"d{f}_old") + F.lit(DT * GAMMA) * c(f"d{f}") for f in FIELDS if f != "p"})
    return moved.withColumns({f"d{f}_old": c(f"d{f}") for f in FIELDS})


def rate_update(rates: DataFrame, step: DataFrame, columns: list[str], key: str = "node_id") -> DataFrame:
    """rates less step, joined on key."""
    own = step.select(key, *[c(x).alias(f"__{x}") for x in columns])
    return rates.join(own, key).select(key, *[(c(x) - c(f"__{x}")).alias(x) for x in columns])
