"""Composed workflows: each is one lazy chain of library operators.

* curation chain (§3.1): :func:`ecospark.operators.dedup.curate`
* p(Endpoint) analysis (§3.3): :func:`ecospark.operators.sensitivity.summary` (the flagship)
* feature preparation (§3.2): :func:`descriptor_preparation` below
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ecospark.functions.cols import c
from ecospark.operators import features as X
from ecospark.operators import joins as J
from ecospark.operators import profile as P
from ecospark.session import cut_lineage


def descriptor_preparation(main: DataFrame, descriptors: Sequence[DataFrame], key: str, target: str,
                           prune_ratio: float = 0.7, variance: float = 0.01, spearman: float = 0.01
                           ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """§3.2: prune each descriptor table (F1, two-phase), left-join them onto the main table once
    (J3), then drop low-variance (F3), constant 0/1 (F2) and weakly rank-correlated (F5) features.

    The joined table is materialised once (reliable checkpoint) because every pruning rule is a
    pass over it. Returns ``(features, missing report G9, numeric describe G10)``."""
    pruned = [X.drop_uninformative(d, prune_ratio, keep=[key]) for d in descriptors]
    joined = cut_lineage(J.star(main, pruned, key))
    step = X.drop_low_variance(joined, variance)
    step = X.drop_constant(step)
    protected = {key, target}
    numbers = set(P.numeric(step))
    numeric_features = [x for x in step.columns if x not in protected and x in numbers]
    weak = X.weak_report(step, target, spearman, numeric_features)
    dropped = {r["feature"] for r in weak.filter("drop").select("feature").collect()}
    features = step.select(*[c(x) for x in step.columns if x not in dropped])
    return features, P.missing(features), P.describe(features)
