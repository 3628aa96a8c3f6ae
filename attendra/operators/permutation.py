"""Which inputs a model needs: quality lost when an input is shuffled among rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attendra import config
from attendra.operators.identity import with_place
from attendra.operators.quality import rank_quality, score_histogram
from attendra.operators.scoring import DERIVED, SCORE, Scorer, rederive

WHOLE = "(none)"


def with_donor(df: DataFrame, columns: Sequence[str], key: str | Sequence[str], seed: int = config.SAMPLE_SEED) -> DataFrame:
    """``df`` with ``_donor``, the ``columns`` of another row: a permutation of rows that ``seed`` fixes.

    The row in place i by ``key`` takes from the row in place i by the hash of key and
    seed. Places come from range-partitioned sorts and meet in a join on the number,
    so no row passes the driver and no group is gathered. ``key`` must tell rows apart.
    """
    keys = [key] if isinstance(key, str) else list(key)
    named = F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed)))
    receivers = with_place(df, [F.col(k) for k in keys], "_place_of")
    donors = with_place(
        df.select(*keys, F.struct(*columns).alias("_donor")), [F.md5(named), *(F.col(k) for k in keys)], "_place_of"
    )
    return receivers.join(donors.select("_place_of", "_donor"), "_place_of").drop("_place_of")


def permutation_importance(
    df: DataFrame,
    scorer: Scorer,
    features: Sequence[str],
    key: str | Sequence[str],
    label: str = config.LABEL,
    seed: int = config.SAMPLE_SEED,
) -> DataFrame:
    """Rows (factor, auc, brier, auc_loss, brier_gain), one per feature.

    ``auc`` and ``brier`` are those with the feature taken from another row, the other
    two the change against unchanged rows. Inputs derived from a feature follow it; a
    derived input itself is shuffled as it is. All features use one permutation,
    so rows meet their donors in a single join; every row is then scored once per
    feature, and only score histograms are shuffled.
    """
    followers = {source for source, _ in DERIVED.values()}
    chosen = list(features)
    paired = with_donor(df, chosen, key, seed)
    cases = F.explode(F.array(*(F.lit(f) for f in [WHOLE, *chosen]))).alias("factor")
    rows = paired.select("*", cases)

    def swapped(frame: DataFrame, names: Sequence[str]) -> DataFrame:
        return frame.withColumns(
            {f: F.when(F.col("factor") == f, F.col("_donor")[f]).otherwise(F.col(f)) for f in names}
        )

    plain = [f for f in chosen if f not in DERIVED]
    changed = swapped(rows, plain)
    if followers & set(chosen) and set(DERIVED) <= set(df.columns):
        changed = rederive(changed)
    changed = swapped(changed, [f for f in chosen if f in DERIVED]).drop("_donor")
    quality = rank_quality(score_histogram(scorer.score(changed), label, SCORE, ["factor"]), ["factor"])
    # One row per feature; the unchanged rows' one is shown to all of them.
    everything = Window.partitionBy()
    base = {c: F.max(F.when(F.col("factor") == WHOLE, F.col(c))).over(everything) for c in ("auc", "brier")}
    compared = quality.select(
        "factor",
        "auc",
        "brier",
        (base["auc"] - F.col("auc")).alias("auc_loss"),
        (F.col("brier") - base["brier"]).alias("brier_gain"),
    )
    return compared.filter(F.col("factor") != WHOLE)
