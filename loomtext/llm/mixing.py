"""Mixing sources to target weights (problem 9).

The mixture is as large as the weights and the caps on repetition allow. A source that needs r times its size is
taken whole floor(r) times, and for the rest each text has the inclusion probability r - floor(r).

These probabilities are turned into 0 and 1 by the cube method: as long as three texts are undecided, their probabilities
move along the vector that changes neither the number of texts nor the number of tokens, until one of them is
decided. That runs in blocks of bounded size all over the cluster; the two texts or fewer that each block leaves
undecided go into the next round. In the landing phase the last two of a source are decided by the draw that fits the tokens best.

Defined results: null ids and texts, and texts without tokens, are not used; texts of a source without a target
(or a null source) get no place; a source with a target and no text is reported with 0; targets with null or no
weight count as 0; all weights 0 or empty tables give an empty mixture.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .tokens import VOCABULARY, token_counts

EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: all but two are 0 or 1, sum(p) and sum(p * size) are kept."""
    p = p.astype(float).copy()
    open_ = [int(i) for i in np.flatnonzero((p > EPS) & (p < 1 - EPS))]
    open_.reverse()
    window: list[int] = []
    draws = rng.random(len(open_) + 1)
    step = 0
    while True:
        while len(window) < 3 and open_:
            window.append(open_.pop())
        if len(window) < 3:
            return p
        i, j, k = window
        u = (float(size[k] - size[j]), float(size[i] - size[k]), float(size[j] - size[i]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / d if d > 0 else -p[x] / d for x, d in zip(window, u) if d)
        down = min(p[x] / d if d > 0 else (p[x] - 1) / d for x, d in zip(window, u) if d)
        move = up if draws[step] * (up + down) < down else -down
        step += 1
        for x, d in zip(window, u):
            p[x] = min(1.0, max(0.0, p[x] + move * d))
            if p[x] < EPS:
                p[x] = 0.0
            elif p[x] > 1 - EPS:
                p[x] = 1.0
        window = [x for x in window if 0.0 < p[x] < 1.0]


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides what the flight phase left: of the few outcomes the one nearest to the expected tokens."""
    p = p.copy()
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    want = float((p[left] * size[left]).sum())
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(size[x] for b, x in enumerate(left) if m >> b & 1) - want), m))
    for b, x in enumerate(left):
        p[x] = float(best >> b & 1)
    return np.round(p)


def _step(seed: int, turn: int, final: bool):
    """One block's flight, and its landing in the last round."""

    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, turn, int(key[1]), sum(str(key[0]).encode())])
        # long texts first, so that short ones are left for the landing; equal ones in random order
        pdf = pdf.iloc[rng.permutation(len(pdf))].sort_values("n_tokens", ascending=False, kind="stable").reset_index(drop=True)
        size = pdf["n_tokens"].to_numpy()
        p = flight(pdf["p"].to_numpy(), size, rng)
        pdf["p"] = landing(p, size) if final else p
        return pdf[["source", "doc_id", "n_tokens", "p"]]

    return step


def cube_sample(rows: DataFrame, block: int = 4000, seed: int = 9) -> DataFrame:
    """(source, doc_id, n_tokens, taken 0 or 1) for rows (source, doc_id, n_tokens, p).

    A source's rows are dealt to blocks by hash, so a large source is many tasks. Each round leaves at most two rows a
    block, so their number falls by a factor of ``block`` / 2 until one block a source is left for the landing.
    """
    schema = "source string, doc_id long, n_tokens long, p double"
    done = None
    todo = cut_lineage(rows.select("source", "doc_id", "n_tokens", "p"), "cube")
    for turn in range(8):
        blocks = {r[0]: max(1, math.ceil(r[1] / block)) for r in todo.groupBy("source").count().collect()}  # one row a source
        final = all(n == 1 for n in blocks.values())
        count = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])[F.col("source")] if blocks else F.lit(1)

        moved = cut_lineage(todo.withColumn("blk", F.pmod(F.xxhash64("doc_id", F.lit(turn)), count).cast("int")).groupBy("source", "blk").applyInPandas(_step(seed, turn, final), schema), "cube")
        decided = moved.where(f"p < {EPS} OR p > {1 - EPS}")
        done = decided if done is None else done.union(decided)
        if final:
            break
        todo = moved.where(f"p >= {EPS} AND p <= {1 - EPS}")
    else:
        raise RuntimeError("rows are left undecided")
    return done.select("source", "doc_id", "n_tokens", F.round("p").cast("int").alias("taken"))


def mix_plan(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """How often the tokens of each source are used, so that the shares are the weights and the mixture is largest."""
    use = {s: w for s, (w, r) in targets.items() if w and w > 0 and (r or 0) > 0 and totals.get(s, 0) > 0}
    if not use:
        return {}
    scale = sum(use.values())
    size = min(targets[s][1] * totals[s] * scale / w for s, w in use.items())
    return {s: min(float(targets[s][1]), w / scale * size / totals[s]) for s, w in use.items()}


class Mixture:
    def __init__(self, docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY, seed: int = 9) -> None:
        src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t"), F.col(source_col).alias("source"))
        sizes = token_counts(src.where("doc_id IS NOT NULL AND _t IS NOT NULL"), "doc_id", "_t", "source", vocabulary=vocabulary)
        # repeated deliveries of an id are one text
        self.sizes = cut_lineage(sizes.where("n_tokens > 0 AND source IS NOT NULL").groupBy("doc_id").agg(F.max_by(F.struct("source", "n_tokens"), F.struct("source", "n_tokens")).alias("x")).select("doc_id", "x.source", "x.n_tokens"), "sizes")
        # one row a source, of the target table's size
        self.targets = {r[0]: (r[1] or 0.0, r[2] or 0) for r in targets.select("source", "weight", "max_repeats").where("source IS NOT NULL").collect()}
        totals = {r[0]: r[1] for r in self.sizes.where(F.col("source").isin(*self.targets)).groupBy("source").agg(F.sum("n_tokens")).collect()} if self.targets else {}
        self.plan = mix_plan(totals, self.targets)
        self.seed = seed
        self._rows: DataFrame | None = None

    def rows(self) -> DataFrame:
        """(doc_id, source, n_tokens, times) of every text that is used."""
        if self._rows is None:
            if not self.plan:
                return self.sizes.where("false").withColumn("times", F.lit(0))
            whole = {s: math.floor(r + EPS) for s, r in self.plan.items()}
            part = {s: max(0.0, r - whole[s]) for s, r in self.plan.items()}
            pick = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("source")]
            used = self.sizes.where(F.col("source").isin(*self.plan))
            drawn = [s for s, p in part.items() if p > EPS]
            fixed = used.where(~F.col("source").isin(*drawn)).select("doc_id", "source", "n_tokens", pick(whole).alias("times")) if drawn else used.select("doc_id", "source", "n_tokens", pick(whole).alias("times"))
            out = fixed
            if drawn:
                sample = cube_sample(used.where(F.col("source").isin(*drawn)).withColumn("p", pick(part)), seed=self.seed)
                out = fixed.union(sample.select("doc_id", "source", "n_tokens", (pick(whole) + F.col("taken")).alias("times")))
            self._rows = cut_lineage(out.where("times > 0"), "mixture")
        return self._rows

    def shares(self) -> DataFrame:
        """Per target source: weight, share reached, tokens and texts used, and the most often a text is used."""
        spark = self.sizes.sparkSession
        want = spark.createDataFrame([(s, float(w), int(r)) for s, (w, r) in self.targets.items()], "source string, weight double, max_repeats int")
        got = self.rows().groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.count("*").alias("n_docs"), F.sum("times").alias("n_uses"), F.max("times").alias("most_uses")
        )
        total = got.agg(F.sum("tokens").alias("all_tokens"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        return (
            want.join(got, "source", "left")
            .join(F.broadcast(total))  # one row
            .select("source", "weight", "max_repeats", zero("tokens"), zero("n_docs"), zero("n_uses"), zero("most_uses"), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("share"))
        )
