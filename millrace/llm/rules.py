"""Decision lists: ordered conjunctions of thresholds, learnt by sequential covering."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .gbdt import cut_points, is_held_out, labelled_sample
from .stats import COUNTS, RATIOS, document_stats

#: A condition: statistic, whether at least (else at most), bound.
Condition = tuple[str, bool, float]


def _mask(x: dict[str, np.ndarray], rule: list[Condition], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, up, bound in rule:
        out &= (x[name] >= bound) if up else (x[name] <= bound)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list[Condition]:
    """Add the condition of the highest information gain until no bad row of another kind is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(y), bool)
    while len(rule) < most:
        p, n = int((inside & y).sum()), int((inside & ~y).sum())
        if p == 0 or n == 0:
            break
        before, best, chosen = np.log2(p / (p + n)), 1e-9, None
        for name, edges in cuts.items():
            bins = np.searchsorted(edges, x[name][inside], "left")  # value <= edges[i] exactly where bins <= i
            pos = np.bincount(bins, y[inside], len(edges) + 1)
            tot = np.bincount(bins, minlength=len(edges) + 1)
            below_p, below = pos.cumsum()[:-1], tot.cumsum()[:-1]
            for up, cp, ct in ((False, below_p, below), (True, p - below_p, p + n - below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(cp > 0, cp * (np.log2(cp / ct) - before), 0)
                if len(gain) and gain.max() > best:
                    i = int(gain.argmax())
                    best, chosen = float(gain[i]), (name, up, float(edges[i]))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= _mask(x, [chosen], len(y))
    return rule


def _gap(values: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Halfway bounds just outside the range of the good, where the bad lie beyond it."""
    good, out = values[~bad], []
    if len(good):
        if (above := values[bad][values[bad] > good.max()]).size:
            out.append((good.max() + above.min()) / 2)
        if (below := values[bad][values[bad] < good.min()]).size:
            out.append((good.min() + below.max()) / 2)
    return np.array(out)


def _prune(x: dict[str, np.ndarray], y: np.ndarray, rule: list[Condition]) -> tuple[list[Condition], float]:
    """The prefix with the best (p - n) / (p + n) on rows that did not grow it."""
    best, worth = rule, -1.0
    for k in range(1, len(rule) + 1):
        inside = _mask(x, rule[:k], len(y))
        p, n = int((inside & y).sum()), int((inside & ~y).sum())
        v = (p - n) / (p + n) if p + n else -1.0
        if v > worth + 1e-12:
            best, worth = rule[:k], v
    return best, worth


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, *, most_rules: int = 24, most_conditions: int = 4, bins: int = 128, least_worth: float = 0.5, seed: int = 7) -> list[list[Condition]]:
    """Sequential covering of the bad rows: grow on two thirds, prune on the rest, drop what is covered, repeat."""
    rules: list[list[Condition]] = []
    rest, rng = np.arange(len(bad)), np.random.default_rng(seed)
    while len(rules) < most_rules and bad[rest].any():
        turn = rng.permutation(len(rest))
        grow, prune = rest[turn[len(rest) // 3 :]], rest[turn[: len(rest) // 3]]
        # the bad are few: their own quantiles give bounds where it matters
        cuts = {c: np.unique(np.concatenate([cut_points(v[rest], bins), cut_points(np.concatenate([v[rest][bad[rest]], v[rest][~bad[rest]][:1]]), bins), _gap(v[rest], bad[rest])])) for c, v in x.items()}
        rule = _grow({c: v[grow] for c, v in x.items()}, bad[grow], cuts, most_conditions)
        if not rule:
            break
        rule, worth = _prune({c: v[prune] for c, v in x.items()}, bad[prune], rule)
        covered = _mask({c: v[rest] for c, v in x.items()}, rule, len(rest))
        if worth < least_worth or not (covered & bad[rest]).any():
            break
        rules.append(rule)
        rest = rest[~covered]
    return rules


def condition_column(rule: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, ((F.col(f"`{c}`") >= F.lit(v)) if up else (F.col(f"`{c}`") <= F.lit(v)) for c, up, v in rule))


def list_column(rules: list[list[Condition]]) -> Column:
    """The decision list as one ordered conditional expression: true is keep."""
    out = None
    for rule in rules:
        out = F.when(condition_column(rule), F.lit(False)) if out is None else out.when(condition_column(rule), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def describe(rules: list[list[Condition]]) -> list[str]:
    return ["reject if " + " and ".join(f"{c} {'>=' if up else '<='} {v:.6g}" for c, up, v in rule) for rule in rules]


def apply_quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 40_000) -> DataFrame:
    """Base rules and a decision list learnt from ``labels``, over whole-text statistics.

    The list is learnt on at most ``train_rows`` labelled rows (``is_held_out`` rows stay apart) that pass
    the base rules. Returns the id, the counts of ``stats.COUNTS``, ``base_failed`` (under 10 words, or more
    than a fifth of the words in repeated five-word windows) and ``kept``, one row for each input row.

    Null and empty texts have no words and so fail. Labels that are null or without a document are left
    out; without bad labels the list is empty and keeps what passes the base rules.
    """
    stats = common.stored(document_stats(docs, id_col=id_col, text_col=text_col), "rule-stats").withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    train = labelled_sample(stats.where(~F.col("base_failed") & ~is_held_out(id_col)), labels, id_col=id_col, label_col=label_col, most=train_rows).select(*RATIOS, "_mr_label").toPandas()
    rules = learn_list({c: train[c].to_numpy(np.float64) for c in RATIOS}, (train["_mr_label"].to_numpy() == 0))
    return stats.select(F.col(f"`{id_col}`"), *COUNTS, "base_failed", (~F.col("base_failed") & list_column(rules)).alias("kept"))
