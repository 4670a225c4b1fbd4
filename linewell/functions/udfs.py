"""Vectorised UDFs: the only places where rows leave the JVM for a numeric kernel."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewell.functions.stats import MARGIN_LO, TOTAL_LO, np_implied_mean, np_over_push


def _stack(weights: pd.Series, mask: np.ndarray) -> np.ndarray:
    return np.stack([np.asarray(w, float) for w in weights[mask]])


# explicit types: workers import this module without a session to parse type text
@F.pandas_udf(T.DoubleType())
def implied_mean(line: pd.Series, p: pd.Series, sd: pd.Series, weights: pd.Series, is_total: pd.Series) -> pd.Series:
    return pd.Series(np_implied_mean(line.to_numpy(float), p.to_numpy(float), sd.to_numpy(float),
                                     weights.to_numpy(object), is_total.to_numpy(bool)))


def over_push_arrays(mu, line, sd, weights, is_total) -> tuple[np.ndarray, np.ndarray]:
    """(P(over | no push), P(push)) for mixed margin and total rows; NaN inputs give NaN."""
    cond, push = np.full(len(mu), np.nan), np.full(len(mu), np.nan)
    for flag, lo in ((False, MARGIN_LO), (True, TOTAL_LO)):
        m = (is_total == flag) & ~np.isnan(mu) & ~np.isnan(line) & ~np.isnan(sd)
        if m.any():
            cond[m], push[m] = np_over_push(mu[m], sd[m], _stack(weights, m), line[m], lo)
    return cond, push


@F.pandas_udf(T.StructType([T.StructField("cond", T.DoubleType()), T.StructField("push", T.DoubleType())]))
def over_push(mu: pd.Series, line: pd.Series, sd: pd.Series, weights: pd.Series, is_total: pd.Series) -> pd.DataFrame:
    cond, push = over_push_arrays(mu.to_numpy(float), line.to_numpy(float), sd.to_numpy(float),
                                  weights.to_numpy(object), is_total.to_numpy(bool))
    return pd.DataFrame({"cond": cond, "push": push})
