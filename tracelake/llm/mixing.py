"""Mixing sources to target shares of the total size, by Pareto order sampling.

A source's share of the mix says how often its documents occur on average. The whole part of that is certain: as many
copies of every document. The rest is a sample without
replacement, in which longer documents have higher inclusion odds, by a power of their size; those whose odds reach
one are certain too. Documents are ranked by their random odds divided by their inclusion odds, and the first ones
that fill the missing size are taken. Where in the order the size is reached
is found by histograms over narrower and narrower stretches of it. A gap that the next document is too large for is
filled by the ones ranked after it that fit.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.tokens import TOKENIZER, with_tokens
from tracelake.session import cut

BUCKETS = 4096
#: Documents at least that are looked at to fill a source's last gap.
FILL_DOCS = 1000
#: Inclusion odds grow by this power of a document's size in tokens (0: all documents of a source alike), taken in steps of an eighth of an octave.
SIZE_POWER, STEPS = 0.5, 8
MAX_SOURCES = 10_000


def allocate(total: float, targets: Mapping[str, tuple[float, int, float]]) -> dict[str, float]:
    """Size each source gives to a mix of size `total`. targets: source -> (share, most repeats, size there is).

    Sources that can't give their share even at most repeats give all they can; what they lack goes to the
    others in proportion to their shares, until it is placed or every source is at its limit.
    """
    limit = {s: max(0, m) * max(0.0, a) for s, (_, m, a) in targets.items()}
    share = {s: max(0.0, t[0]) for s, t in targets.items()}
    given: dict[str, float] = {}
    open_ = [s for s in targets if share[s] > 0]
    left = total
    while open_:
        whole = sum(share[s] for s in open_)
        over = [s for s in open_ if left * share[s] / whole >= limit[s]]
        if not over:
            return given | {s: left * share[s] / whole for s in open_}
        for s in over:
            given[s] = limit[s]
        left -= sum(limit[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return given


def scale(want: float, sizes: Mapping[int, float], most: int, power: float) -> float:
    """The c for which min(most, c * weight) of each step's tokens (`sizes`) come to `want` in all; infinite where `most` of all don't."""
    left, rest = want, sum(weight(k, power) * t for k, t in sizes.items())
    for k in sorted(sizes, reverse=True):  # the heaviest reach the most copies first
        if rest <= 0 or left / rest * weight(k, power) <= most:
            break
        left, rest = left - most * sizes[k], rest - weight(k, power) * sizes[k]
    else:
        return float("inf")
    return max(0.0, left / rest) if rest > 0 else 0.0


def weight(step: int, power: float) -> float:
    return 2.0 ** (step / STEPS * power)


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Take documents by rank while they fit into what is left, then the one that brings the sum nearest, if any does. `rows`: equal rows of a document."""
    pdf = pdf.sort_values(["rank", "doc_id", "n_tokens"]).reset_index(drop=True)
    left, sizes, rows = float(pdf["left"].iloc[0]), pdf["n_tokens"].to_numpy(), pdf["rows"].to_numpy()
    take = np.zeros(len(sizes), np.int64)
    for i, (n, k) in enumerate(zip(sizes, rows)):
        take[i] = k if n == 0 else min(k, int(max(left, 0.0) // n))
        left -= take[i] * n
    rest = np.flatnonzero(take < rows)
    if len(rest) and sizes[rest].min() - left < left:
        take[rest[sizes[rest].argmin()]] += 1
    return pdf[["doc_id", "source", "n_tokens", "whole", "rows"]].assign(extra=take)


def mix(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER, seed: int = 11, power: float = SIZE_POWER) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares) of documents by their size in tokens of the whole text; see `draw`. NULL and empty texts have size 0."""
    return draw(with_tokens(docs.select("doc_id", "source", "text"), path=path), targets, seed, power)


def draw(sized: DataFrame, targets: DataFrame, seed: int = 11, power: float = SIZE_POWER) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares) of `sized` (doc_id, source, n_tokens). drawn: doc_id, source, n_tokens, copies (>= 1), in_mix_tokens. shares: see below.

    The mix is as large as all documents together. Of every source of `targets` (source, target_share, max_repeats)
    it holds what `allocate` says, but for a gap that no document at the edge of the sample fits into; sources that
    `targets` doesn't name, and documents without a source, give nothing. Every document of a source has the same
    whole copies and inclusion odds for one more in proportion to n_tokens^power, at most 1; its draw depends on its
    id and the seed only. Repeated rows
    are drawn like different documents. Should a source be named twice, the row with the smaller share and repeats
    holds. `targets` is a setting, refused beyond MAX_SOURCES.

    shares: source, target_share, max_repeats, n_docs, n_tokens, mix_docs (different), mix_tokens, actual_share,
    reachable_share (the share `allocate` aims at).
    """
    spark = sized.sparkSession
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    step = F.floor(F.log2(F.greatest("n_tokens", F.lit(1)).cast("double")) * STEPS).cast("int")
    sized = cut(sized.select("doc_id", "source", "n_tokens", u.alias("u"), step.alias("step")))
    rows = targets.groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*").filter("source is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    setting = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in rows}
    named = F.broadcast(spark.createDataFrame(list(setting) or [""], "string").toDF("source"))  # bounded above

    # A row per source and step of size, of which there are some hundred.
    by_step = sized.join(named, "source", "left_semi").groupBy("source", "step").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    steps: dict[str, dict[int, tuple[int, int]]] = {s: {} for s in setting}
    for r in by_step:
        steps[r[0]][r[1]] = (int(r[2]), int(r[3]))
    have = {s: (sum(t for t, _ in d.values()), sum(n for _, n in d.values())) for s, d in steps.items()}
    aim = allocate(total, {s: (*t, have[s][0]) for s, t in setting.items()})

    plan, missing = [], {}
    for s, (_, most) in setting.items():
        want, size = aim.get(s, 0.0), have[s][0]
        base = min(most, int(want / size + 1e-12)) if size else 0
        c = scale(want - base * size, {k: t for k, (t, _) in steps[s].items()}, 1, power) if base < most else 0.0
        certain = 0
        for k, (tokens, _) in steps[s].items():
            copies = base + min(1.0, c * weight(k, power))
            whole = int(copies + 1e-9)
            plan.append((s, k, whole, max(0.0, copies - whole)))
            certain += whole * tokens
        missing[s] = max(0.0, aim.get(s, 0.0) - certain)
    plan_df = F.broadcast(spark.createDataFrame(plan or [("", 0, 0, 0.0)], "source string, step int, whole int, pi double"))
    pi = F.greatest("pi", F.lit(1e-12))
    odds = (F.col("u") / (1 - F.col("u"))) / (pi / (1 - pi))
    # The rank on a scale from 0 to 1, for histograms; 2 (never) for what has no odds.
    place = F.when(F.col("pi") > 1e-9, odds / (1 + odds)).otherwise(F.lit(2.0))
    ranked = sized.join(plan_df, ["source", "step"]).withColumns({"rank": odds, "place": place})
    edges = _edges(ranked, {s: x for s, x in missing.items() if x > 0})
    edge_df = F.broadcast(spark.createDataFrame([(s, *e) for s, e in edges.items()] or [("", 0.0, 0.0, 0.0)], "source string, low double, high double, left double"))
    placed = ranked.join(edge_df, "source", "left")
    near = F.coalesce((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")), F.lit(False))
    clear = placed.filter(~near).select("doc_id", "source", "n_tokens", (F.col("whole") + F.coalesce(F.col("place") < F.col("low"), F.lit(False)).cast("int")).alias("copies"))
    zone = placed.filter(near).groupBy("source", "doc_id", "n_tokens", "whole", "rank", "left").agg(F.count(F.lit(1)).alias("rows"))
    filled = zone.groupBy("source").applyInPandas(_fill, "doc_id long, source string, n_tokens long, whole int, rows long, extra long")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("i")
    filled = filled.select("doc_id", "source", "n_tokens", "whole", "extra", each).select("doc_id", "source", "n_tokens", (F.col("whole") + (F.col("i") <= F.col("extra")).cast("int")).alias("copies"))
    drawn = clear.unionByName(filled).filter("copies > 0").withColumn("in_mix_tokens", F.col("copies") * F.col("n_tokens"))
    rows = [(s, *setting[s], *have[s][::-1], aim.get(s, 0.0) / total if total else 0.0) for s in setting]
    known = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, n_docs long, n_tokens long, reachable_share double")
    got = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("mix_docs"), F.sum("in_mix_tokens").alias("mix_tokens"))
    every = Window.partitionBy(F.lit(0))  # a row per named source
    shares = known.join(got, "source", "left").na.fill(0, ["mix_docs", "mix_tokens"]).withColumn("all", F.sum("mix_tokens").over(every))
    actual = F.coalesce(F.try_divide(F.col("mix_tokens"), F.col("all")), F.lit(0.0))
    return drawn, shares.select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "mix_docs", "mix_tokens", actual.alias("actual_share"), "reachable_share")


def _edges(ranked: DataFrame, missing: Mapping[str, float], rounds: int = 5) -> dict[str, tuple[float, float, float]]:
    """source -> (low, high, left): documents placed below `low` are in, with `left` tokens missing, and those up to `high` are looked at to fill them.

    Each round counts the documents of the stretch where the size is reached, in BUCKETS parts, and goes on with the
    part that reaches it, until that holds no more than FILL_DOCS: a round for each factor of BUCKETS, so two for ten
    thousand million documents. A source gives at most BUCKETS rows a round. Equal ranks can't be told apart, so
    rounds end at the last digit of a rank; equal rows of a document are one row to the filling.
    """
    spark = ranked.sparkSession
    found: dict[str, tuple[float, float, float]] = {}
    open_ = {s: (0.0, 1.0, 0.0) for s in missing}
    for last in [False] * (rounds - 1) + [True]:
        if not open_:
            break
        stretch = F.broadcast(spark.createDataFrame([(s, a, z) for s, (a, z, _) in open_.items()], "source string, low double, high double"))
        inside = ranked.join(stretch, "source").filter((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
        part = F.least(F.floor((F.col("place") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        parts: dict[str, list] = {}
        for r in inside.groupBy("source", part.alias("part")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.min("place").alias("a"), F.max("place").alias("z")).collect():
            parts.setdefault(r[0], []).append(tuple(r)[1:])
        again = {}
        for s, (_, high, before) in open_.items():
            own = sorted(parts.get(s, []))
            i, taken = 0, before
            while i < len(own) - 1 and taken + own[i][1] <= missing[s]:
                taken += own[i][1]
                i += 1
            if not own:
                continue
            low, end = own[i][3], own[i][4]
            if own[i][2] > FILL_DOCS and end > low and not last:
                again[s] = (low, float(np.nextafter(end, 2.0)), taken)
                continue
            docs, j = own[i][2], i
            while docs < FILL_DOCS and j < len(own) - 1:
                j += 1
                docs += own[j][2]
            found[s] = (low, float(np.nextafter(own[j][4], 2.0)), missing[s] - taken)
        open_ = again
    return found
