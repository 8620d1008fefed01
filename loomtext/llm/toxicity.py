"""Abusive, hateful and sexual content (problem 5).

The flag of the table is unreliable, but it is raised more often on abusive passages than on harmless talk about the same subjects,
and hardly ever on the rest. Runs of one to three words get the logarithm of the odds of a raised flag, with a Dirichlet
prior in proportion to the corpus (Monroe et al. 2008). From it the break-even odds are taken off, which lie between harmless and
abusive passages; they are found from the counts as the border between the two upper parts of a mixture of binomials.

A linear scan then finds every maximal scoring segment of a text (Ruzzo and Tompa 1999). Its score is
calibrated by the extreme-value distribution of such maxima over texts that nobody flagged (Karlin and Altschul 1990). Each
segment is tested by how often one that high is expected by chance in its text, and the r best of a text together by the distribution
of the sum of their normalized scores (Karlin and Altschul 1993). A text has the score of the r that chance explains least, and is a case
when that is expected less than ``e_value`` times. As several r are tried, r of 2 and more count 2 ** (r - 1) times.

Spellings are evened out first: case, digits and signs for letters, letters apart, and masked letters, which may stand for any.

Defined results: null or empty texts score 0; rows of one id count once, with the largest score; null flags take no part in the counts; without flagged rows nothing is a case.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage, spread

#: Digits and signs that are written for letters.
LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "o", "@": "a", "$": "s", "!": "i"})
#: A word, with marks inside that hide or stretch it; or the end of a sentence.
_TOKEN = re.compile(r"[^\W_]+(?:[*#@$!.\-_'’]+[^\W_]+|[*#]+(?=\W|$))*|[.?!;]+(?=\s|$)|\n+")
_APART = re.compile(r"[^\W\d_](?:[.\-_ *][^\W\d_]){2,}")
_MASK = re.compile(r"[*#_]")
RARE, MASKED, STOP = "<r>", "<x>", "<s>"


def tokens(text: str | None) -> list[str]:
    """Words in an even spelling; ``<x>`` for a word with masked letters, ``<s>`` between sentences."""
    out: list[str] = []
    for m in _TOKEN.finditer((text or "").lower()):
        w = m[0]
        if not w[0].isalnum():
            if out and out[-1] != STOP:
                out.append(STOP)
            continue
        if not w.isalpha():
            if w.isdigit():
                w = "<d>"
            elif _MASK.search(w):
                w = MASKED
            elif _APART.fullmatch(w):
                w = re.sub(r"[\W_]", "", w)
            elif any(c.isdigit() for c in w) or "@" in w or "$" in w:
                # a digit among letters is a letter in disguise; which one, the words around tell
                letters = re.sub(r"[\W_]", "", w.translate(LETTERS))
                w = letters if letters.isalpha() and sum(c.isdigit() for c in w) * 2 <= len(w) else "<d>"
            elif "." in w and len(w) > 2 * w.count("."):
                first, *rest = w.split(".")
                out.extend(x for x in (first, *rest) if x)
                continue
        out.append(w)
    return out


def grams(words: list[str], known: set[str] | frozenset[str] | dict[str, int]) -> Iterator[tuple[int, str, str | None, str | None]]:
    """Per word: its place, itself, and the runs of two and three words that end with it; unknown words are one symbol."""
    a = b = None
    for i, w in enumerate(words):
        if w == STOP:
            a = b = None
            continue
        w = w if w in known or w[0] == "<" else RARE
        yield i, w, f"{b} {w}" if b else None, f"{a} {b} {w}" if a and b else None
        a, b = b, w


#: What is known of the three parts of runs before any count: their flag rates, and for how many runs of how many texts that stands.
BEFORE = ((0.05, 0.33, 0.75), 10, 12)


def border(counts: list[tuple[int, int]], rounds: int = 60) -> float:
    """Flag rate that parts harmless from abusive runs: the middle, in log-odds, of the two upper parts of a mixture of binomials.

    Runs of 12 texts or more count. What is known beforehand (``BEFORE``) counts as some runs of its own in each part, so it decides where there are none,
    and gives way to the counts the more there are of them.
    """
    start, runs, texts = BEFORE
    data = np.array([(y, n) for y, n in counts if n >= 12], float).reshape(-1, 2)
    y, n = data[:, :1], data[:, 1:]
    rates, shares = np.array(start), np.array([0.4, 0.3, 0.3])
    for _ in range(rounds):
        logs = np.log(shares) + y * np.log(rates) + (n - y) * np.log1p(-rates)
        p = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(logs) else np.zeros((0, 3))
        p /= p.sum(axis=1, keepdims=True)
        rates = np.clip(((p * y).sum(axis=0) + runs * texts * np.array(start)) / ((p * n).sum(axis=0) + runs * texts), 0.005, 0.98)
        shares = (p.sum(axis=0) + runs / 3) / (len(data) + runs)
    low, high = np.sort(rates)[1:]
    # where both parts are equally likely for one observation
    odds = lambda r: math.log(r / (1 - r))
    return 1 / (1 + math.exp(-(odds(low) + odds(high)) / 2))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), by Ruzzo and Tompa, in linear time."""
    found: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum up to the end
    total = 0.0
    for i, x in enumerate(scores):
        if x <= 0:
            total += x
            continue
        begin, before = i, total
        total += x
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append((begin, i + 1, before, total))
                break
            begin, before = found[j][0], found[j][2]
            del found[j:]
    return [(b, e, hi - lo) for b, e, lo, hi in found]


def sum_chance(total: float, r: int, nodes: int = 400) -> float:
    """P(the r best normalized scores, r of 2 or more, add up to more than ``total``), after Karlin and Altschul (1993).

    It is the expectation over a gamma variable y of shape r - 1 of P(a gamma variable of shape r is under exp((y - total) / r)).
    """
    top = max(total, 0.0) + 2 * r + 40
    y = (np.arange(nodes) + 0.5) * (top / nodes)
    x = np.exp(np.minimum((y - total) / r, 700.0))
    # the upper part of a Poisson law, from its r-th term on, is summed itself where it is small
    low = np.minimum(x, r / 2)
    term = np.exp(r * np.log(low) - low - math.lgamma(r + 1))
    upper, k = term.copy(), r
    while term.max() > 1e-17 and k < r + 200:
        k += 1
        term = term * low / k
        upper += term
    big, part, rest = np.minimum(x, 700.0), np.ones(nodes), np.ones(nodes)
    for k in range(1, r):
        part = part * big / k
        rest += part
    upper = np.where(x <= r / 2, upper, 1 - np.exp(np.log(rest) - big))
    weight = np.exp((r - 2) * np.log(y) - y - math.lgamma(r - 1))
    return float(min(1.0, (weight * upper).sum() * top / nodes))


@dataclass
class ToxicModel:
    table: dict[str, tuple[float, int]]  # run of words: score, support
    known: frozenset[str]
    base: float
    rare: float
    lam: float = 1.0
    k: float = 0.1
    trust: int = 8

    def scores(self, words: list[str]) -> list[float]:
        get, out = self.table.get, [self.base] * len(words)
        for i, w, two, three in grams(words, self.known):
            best = None
            for run in (three, two, w):
                s = get(run) if run else None
                if s is not None:
                    if s[1] >= self.trust:
                        best = s[0] if best is None else max(best, s[0])
                        break
                    best = s[0] if best is None else max(best, s[0])
            out[i] = best if best is not None else self.rare if w == RARE else self.base
        for i, w in enumerate(words):
            if w == STOP:
                out[i] = -0.7
        return out

    def best(self, words: list[str]) -> tuple[float, int, list[str]]:
        """Score of the best segment of a tokenised text, number of words, and that segment."""
        found = segments(self.scores(words))
        if not found:
            return 0.0, len(words), []
        b, e, s = max(found, key=lambda x: x[2])
        return s, len(words), words[b:e]

    def judge(self, text: str | None, e_value: float = 0.01, min_score: float = 1.2) -> tuple[float, float, str, bool, list[tuple[str, float, float]]]:
        """As ``judge_words``, of a text as it stands."""
        return self.judge_words(tokens(text), e_value, min_score)

    def judge_words(self, words: list[str], e_value: float = 0.01, min_score: float = 1.2) -> tuple[float, float, str, bool, list[tuple[str, float, float]]]:
        """Score, chance, best passage, whether it is a case, and its significant passages (passage, score, chance) in order of the text.

        Passages that are significant alone count, and those of the sum when the text is a case by it.
        """
        n = len(words)
        found = sorted(segments(self.scores(words)), key=lambda x: -x[2])
        if not found:
            return 0.0, self.expected(0.0, n), "", False, []
        alone = [self.expected(s, n) for *_, s in found]
        score, chance, used = found[0][2], alone[0], 1
        case = chance < e_value and score >= min_score
        total, added = -math.log(alone[0]), score
        for r in range(2, len(found) + 1):
            # a segment that chance brings once or more adds nothing
            if alone[r - 1] >= 1:
                break
            total, added = total - math.log(alone[r - 1]), added + found[r - 1][2]
            e = 2 ** (r - 1) * sum_chance(total, r)
            if e < chance or (not case and e < e_value and added >= min_score):
                score, chance, used = added, e, r
            case = case or (e < e_value and added >= min_score)
        keep = [i for i in range(len(found)) if (alone[i] < e_value and found[i][2] >= min_score) or (case and i < used)]
        keep.sort(key=lambda i: found[i][0])
        return score, chance, " ".join(words[found[0][0] : found[0][1]]), case, [(" ".join(words[found[i][0] : found[i][1]]), found[i][2], alone[i]) for i in keep]

    def expected(self, score: float, n: int) -> float:
        """How many segments of this score chance brings in n words."""
        return self.k * max(1, n) * math.exp(-self.lam * score)


def tokenised(df: DataFrame, text: str = "text") -> DataFrame:
    """``tokens`` in the place of the text, with blanks between: tokenising is the dearest step, and all others go over the same tokens."""
    names = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([" ".join(tokens(t)) for t in b.column(len(names)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), made], names=[*names, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields)
    return spread(df.select(*names, text)).mapInArrow(run, f"{schema}, tokens string" if names else "tokens string")


def _sum(df: DataFrame, fn, schema: str, key: str) -> DataFrame:
    return df.mapInArrow(fn, schema).groupBy(key).agg(*(F.sum(c).alias(c) for c in [x.split()[0] for x in schema.split(", ")] if c != key))


def fit(messages: DataFrame, min_flagged: int = 3, max_runs: int = 500_000, prior: float = 20.0, even: float = 4.0) -> ToxicModel:
    """Counts over all messages. A run is kept from ``min_flagged`` flagged texts on, and from a share of one in ``max_runs`` of all the counts on;
    so there are never more of them than that, and no order decides which.

    messages: text or tokens, toxic; one row a record.
    """
    if "tokens" not in messages.columns:
        messages = cut_lineage(tokenised(messages), "tokens")
    spark = messages.sparkSession
    flagged = messages.where("toxic")

    def frequent(counts: DataFrame) -> list:
        counts = cut_lineage(counts, "runs")
        total = counts.agg(F.sum("y")).first()[0] or 0
        return counts.where(F.col("y") * max_runs >= total).collect()

    def flagged_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = Counter(w for t in b.column(0).to_pylist() for w in set(t.split()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["run", "y"])

    words = _sum(flagged.select("tokens"), flagged_words, "run string, y long", "run").where(F.col("y") >= min_flagged)
    words = frequent(words)
    known = frozenset(r[0] for r in words)
    vocab = spark.sparkContext.broadcast(known)  # at most max_runs words

    def runs_of(words: str, known) -> set[str]:
        return {r for _, w, two, three in grams(words.split(), known) for r in (w, two, three) if r}

    def flagged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = Counter(r for t in b.column(0).to_pylist() for r in runs_of(t, vocab.value))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["run", "y"])

    found = _sum(flagged.select("tokens"), flagged_runs, "run string, y long", "run").where(F.col("y") >= min(2, min_flagged))
    found = frequent(found)
    y = {r[0]: r[1] for r in found}
    wanted = spark.sparkContext.broadcast((known, y))  # at most max_runs runs

    def all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, y = wanted.value
        c: Counter = Counter()
        for b in batches:
            c["<n>"] += b.num_rows
            for t in b.column(0).to_pylist():
                c.update(r for r in runs_of(t, known) if r in y)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["run", "n"])

    n = {r[0]: r[1] for r in _sum(spread(messages.where("toxic IS NOT NULL").select("tokens")), all_runs, "run string, n long", "run").collect()}
    docs, raised = max(1, n.pop("<n>", 0)), max(1, flagged.count())
    rate = min(0.5, max(1e-4, raised / docs))
    cut = border([(min(y[r], n[r]), n[r]) for r in y if r in n and y[r] > 0.1 * n[r]])
    shift = math.log(cut / (1 - cut))
    table = {}
    for r, yes in y.items():
        all_ = max(n.get(r, yes), yes)
        # the prior has the corpus's share of the run at the corpus's rate, and a few texts at break-even
        a = prior * all_ / docs
        score = math.log((yes + a * rate + even * cut) / (all_ - yes + a * (1 - rate) + even * (1 - cut))) - shift
        table[r] = (max(-4.0, min(3.0, score)), all_)
    base = max(-4.0, math.log(rate / (1 - rate)) - shift)
    return _calibrate(ToxicModel(table, known, base, rare=0.25 * base), messages)


def _calibrate(model: ToxicModel, messages: DataFrame, bins: int = 60) -> ToxicModel:
    """Fits lambda and K to the maxima of texts that aren't flagged, over all of them, by a histogram of the scores."""
    shared = messages.sparkSession.sparkContext.broadcast(model)

    def hist(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, c, size = shared.value, Counter(), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                s, n, _ = m.best(t.split())
                k = min(bins, int(s * 4))
                c[k] += 1
                size[k] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64()), pa.array([size[k] for k in c], pa.int64())], names=["bin", "n", "words"])

    rows = _sum(spread(messages.where("NOT toxic").select("tokens")), hist, "bin long, n long, words long", "bin").collect()
    total, words = sum(r[1] for r in rows) or 1, sum(r[2] for r in rows) or 1
    # the bulk of the unflagged texts: abusive ones among them sit above it
    below = {r[0]: r[1] for r in rows if r[0] < 4}
    tail = [(k / 4, sum(v for j, v in below.items() if j >= k) / total) for k in range(1, 4)]
    tail = [(s, p) for s, p in tail if p > 0]
    lam = 3.0
    if len(tail) >= 2 and tail[0][1] > tail[-1][1]:
        lam = min(8.0, max(2.0, math.log(tail[0][1] / tail[-1][1]) / (tail[-1][0] - tail[0][0])))
    s0, p0 = tail[0] if tail else (0.25, 0.05)
    model.lam, model.k = lam, min(1.0, max(1e-3, -math.log1p(-min(p0, 0.99)) / (words / total) * math.exp(lam * s0)))
    return model


def score(messages: DataFrame, model: ToxicModel | None = None, e_value: float = 0.01, min_score: float = 1.2) -> DataFrame:
    """(id, source, score, e_value, passage, is_toxic, passages) of every message; an id delivered again counts once.

    passage is the best one, passages has all that are significant, with the score and e_value of each.
    """
    src = messages.groupBy("id").agg(F.max_by(F.struct("text", "source", "toxic"), F.struct(F.col("text").isNotNull(), "text", "source", "toxic")).alias("m")).where("id IS NOT NULL").select("id", "m.*")
    src = cut_lineage(tokenised(src), "messages")
    model = model or fit(src.select("tokens", "toxic"))
    shared = messages.sparkSession.sparkContext.broadcast(model)  # bounded by max_runs

    passages = pa.list_(pa.struct([("passage", pa.string()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.judge_words(t.split(), e_value, min_score) for t in b.column(2).to_pylist()]
            values = [
                [round(x[0], 6) for x in found],
                [round(min(x[1], 1e6), 9) for x in found],
                [x[2] for x in found],
                [x[3] for x in found],
                [[{"passage": p, "score": round(s, 6), "e_value": round(min(e, 1e6), 9)} for p, s, e in x[4]] for x in found],
            ]
            kinds = [pa.float64(), pa.float64(), pa.string(), pa.bool_(), passages]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, values, kinds)], names=["id", "source", "score", "e_value", "passage", "is_toxic", "passages"])

    kind = src.schema["id"].dataType.simpleString()
    return src.select("id", "source", "tokens").mapInArrow(run, f"id {kind}, source string, score double, e_value double, passage string, is_toxic boolean, passages array<struct<passage: string, score: double, e_value: double>>")


def rates(scored: DataFrame) -> DataFrame:
    """(source, n_messages, n_toxic, rate) per source."""
    return scored.groupBy("source").agg(F.count("*").alias("n_messages"), F.sum(F.col("is_toxic").cast("long")).alias("n_toxic"), F.round(F.avg(F.col("is_toxic").cast("double")), 6).alias("rate"))


__all__ = ["ToxicModel", "border", "fit", "grams", "rates", "score", "segments", "tokens"]
