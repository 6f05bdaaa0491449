"""Did-you-mean: families of variants compared by what they found."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaloom.operators.search import BEST
from lexaloom.plans.policy import DEFAULT, SYNONYM_SOURCES, TIERS, Policy

REASONS = ("original_had_no_results", "better_semantic_tier", "material_result_gain")


def families(variants: Iterable) -> dict[str, str]:
    """The root of each variant's lineage: 'original', or the nearest correction; synonyms belong to their parents."""
    by = {v.fingerprint: v for v in variants}
    out = {}
    for v in by.values():
        seen, at = set(), v
        while at.source != "original" and at.source in SYNONYM_SOURCES:
            if at.fingerprint in seen:
                raise ValueError("the lineage of a variant has a cycle")
            seen.add(at.fingerprint)
            if at.parent not in by:
                raise ValueError("the parent of a variant is missing")
            at = by[at.parent]
        out[v.fingerprint] = "original" if at.source == "original" else at.fingerprint
    return out


def family_results(ranks: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, family, n, tier_at): distinct candidates and best tier of each family; members (fingerprint, family)."""
    rows = ranks.join(F.broadcast(members), "fingerprint")  # at most 20 variants a query
    best = F.min(F.struct(F.col("tier_at"), (-F.col("score")).alias("s"), (-F.col("variant_priority")).alias("p"), (-F.col("coverage")).alias("c"), (-F.col("matched")).alias("m"), "fingerprint"))
    return rows.groupBy("query_id", "family").agg(F.countDistinct("id").alias("n"), best["tier_at"].alias("tier_at"))


assert BEST[0] == "tier_at"


def suggest(variants: list, results: dict[str, tuple[int, int]], exact: bool, policy: Policy = DEFAULT) -> dict | None:
    """The strongest family that beats the original; results: family -> (candidates, best tier)."""
    if not policy.suggestions or (policy.require_exact_window and not exact):
        return None
    n0, tier0 = results.get("original", (0, None))
    first, found = variants[0], []
    for v in variants:
        if v.source == "original" or v.source in SYNONYM_SOURCES or v.query == first.query or v.fingerprint not in results:
            continue
        n, tier = results[v.fingerprint]
        if n < policy.suggestion_minimum_results:
            continue
        ratio = n * 10000 // n0 if n0 else 0
        if not n0:
            reason = 0
        elif tier < tier0 and n >= n0:
            reason = 1
        elif n - n0 >= policy.suggestion_minimum_gain and ratio >= policy.suggestion_minimum_ratio:
            reason = 2
        else:
            continue
        found.append((reason, tier, -n, n0 - n, -v.priority, v.fingerprint, v, ratio))
    if not found:
        return None
    reason, tier, n, gain, _, _, v, ratio = min(found, key=lambda x: x[:6])
    return {"query": v.query, "locale": v.locale, "source": v.source, "fingerprint": v.fingerprint, "reason": REASONS[reason], "original_results": n0, "suggested_results": -n, "gain": -gain, "ratio": ratio, "tier": TIERS[tier]}
