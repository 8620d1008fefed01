"""Scoring the words of messages by a small encoder, and their titles.

The network runs over batches of padded texts in numpy, inside an Arrow batch function; the model travels once as a broadcast.
Choosing the words is a column expression on the scores (operators.decode).
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.session import spread
from ..sources.modelfile import Model, load
from . import decode

WORDS = "array<struct<word:string,start:int,end:int,score:double,tokens:int>>"


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows with mean 0 and variance 1; what a norm does beside that is in the weights that follow it."""
    x = x - (x @ np.full(x.shape[1], 1 / x.shape[1], np.float32))[:, None]
    x *= (1 / np.sqrt(np.einsum("ij,ij->i", x, x) / np.float32(x.shape[1]) + np.float32(1e-5)))[:, None]
    return x


#: Coefficients of a polynomial in 1 / (1 + 0.3275911 x) for the error function (Abramowitz and Stegun 7.1.26).
_ERF = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)
#: Numbers that go through ``_gelu`` at once, so that its steps stay in the cache.
_PART = 16_384


def _gelu(x: np.ndarray) -> np.ndarray:
    """In place: x when positive, less |x| times half of what is left of the error function to 1."""
    flat = x.reshape(-1)
    for lo in range(0, len(flat), _PART):
        part = flat[lo : lo + _PART]
        size = np.abs(part)
        half = size * np.float32(0.5)
        t = size * np.float32(0.3275911 * math.sqrt(0.5))
        t += np.float32(1)
        np.reciprocal(t, out=t)
        y = t * np.float32(_ERF[0] / 2)
        for c in _ERF[1:]:
            y += np.float32(c / 2)
            y *= t
        y *= size
        size *= size
        size *= np.float32(-0.5)
        y *= np.exp(size, out=size)
        part *= np.float32(0.5)
        part += half
        part -= y
    return x


class Tagger:
    def __init__(self, model: Model) -> None:
        self.h, self.w = model.header, model.weights
        self.tokenizer = model.tokenizer()
        dim = len(self.w["norm.weight"])
        # queries come out divided by the root of a head's width
        root = np.repeat((1 / math.sqrt(dim // self.h["heads"]), 1.0), (dim, 2 * dim))
        plain = lambda name: (np.ascontiguousarray(self.w[f"{name}.weight"].T), self.w[f"{name}.bias"])
        self.layers = [
            (self._after_norm(f"{b}.n1", f"{b}.att.qkv", root), plain(f"{b}.att.output"), self._after_norm(f"{b}.n2", f"{b}.ff.net.0"), plain(f"{b}.ff.net.2"))
            for b in (f"blocks.{k}" for k in range(self.h["layers"]))
        ]
        self.last = self._after_norm("norm", "head")

    def _positions(self, n: int) -> np.ndarray:
        at = np.minimum(np.arange(n), self.h["max_pos"] - 1)
        if self.h["positions"] != "sinus":
            return self.w["emb_pos.weight"][at]
        d = self.h["dim"]
        angle = at[:, None] / np.power(10000.0, np.arange(0, d, 2) / d)
        return np.stack((np.sin(angle), np.cos(angle)), -1).reshape(n, d).astype(np.float32)

    def _after_norm(self, norm: str, linear: str, scale: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(matrix, bias) of a linear layer that takes up the weights of the norm before it."""
        w = self.w
        matrix = w[f"{linear}.weight"].astype(np.float64).T * np.asarray(scale)
        bias = w[f"{norm}.bias"] @ matrix + w[f"{linear}.bias"] * np.asarray(scale)
        return np.ascontiguousarray(w[f"{norm}.weight"][:, None] * matrix, np.float32), bias.astype(np.float32)

    def logits(self, batch: list[list[int]]) -> list[np.ndarray]:
        """One logit a token for every text of the batch; padding is masked out of the attention."""
        w, heads = self.w, self.h["heads"]
        longest = max(map(len, batch), default=0)
        if not longest:
            return [np.zeros(0, np.float32) for _ in batch]
        ids = np.full((len(batch), longest), self.h.get("pad", 0))
        for row, x in zip(ids, batch):
            row[: len(x)] = x
        live = np.arange(longest) < np.array([len(x) for x in batch])[:, None]
        x = w["emb_tok.weight"][ids]
        if self.h["dim_emb"]:
            x = x @ w["proj_emb.weight"].T
        x = (x + self._positions(longest)).reshape(ids.size, -1)
        width = x.shape[1] // heads
        # queries, keys and values with one number more: 1 and the mask, which the product adds up, and 1 in the values, which gives the sum
        three = np.ones((3, len(batch), heads, longest, width + 1), np.float32)
        three[1, ..., width] = np.where(live, np.float32(0), np.float32(-1e9))[:, None]
        for (qkv, qkv_b), (out, out_b), (up, up_b), (down, down_b) in self.layers:
            y = _unit(x) @ qkv
            y += qkv_b
            three[..., :width] = y.reshape(*ids.shape, 3, heads, width).transpose(2, 0, 3, 1, 4)
            s = three[0] @ three[1].swapaxes(-1, -2)
            s -= s.max(axis=-1, keepdims=True)
            mixed = np.exp(s, out=s) @ three[2]
            mixed = (mixed[..., :width] / mixed[..., width:]).transpose(0, 2, 1, 3).reshape(ids.size, -1)
            x += mixed @ out
            x += out_b
            y = _unit(x) @ up
            y += up_b
            x += _gelu(y) @ down
            x += down_b
        last, last_b = self.last
        z = (_unit(x) @ last + last_b).reshape(ids.shape)
        return [z[i, : len(b)] for i, b in enumerate(batch)]

    def words(self, texts: list[str], budget: int = 1_024) -> list[list[dict]]:
        """Scored words of each text: groups of tokens by the word rules, with the sigmoid of their mean logit. Groups without letter or digit are left out."""
        n, word, start, end, tokens, (score,) = scored_words([self], texts, budget)
        flat = [dict(zip(("word", "start", "end", "score", "tokens"), x)) for x in zip(word, start, end, score.tolist(), tokens)]
        stop = np.cumsum(n).tolist()
        return [flat[b - k : b] for k, b in zip(n, stop)]


def scored_words(taggers: list[Tagger], texts: list[str], budget: int = 1_024) -> tuple[list[int], list[str], list[int], list[int], list[int], list[np.ndarray]]:
    """(words of each text; word, start, end, tokens of all words; their scores by each tagger): the taggers have one tokenizer, and the texts go through it once."""
    encoded = [taggers[0].tokenizer.encode(t) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: len(encoded[i][0]))
    logits: list[list] = [[None] * len(texts) for _ in taggers]
    for lo, hi in length_batches([len(encoded[i][0]) for i in order], budget):
        part = order[lo:hi]
        ids = [encoded[i][0] for i in part]
        for own, tagger in zip(logits, taggers):
            for i, z in zip(part, tagger.logits(ids)):
                own[i] = z
    count, word, start, end, size, spoken = [], [], [], [], [], []
    for text, (_, spans) in zip(texts, encoded):
        before = len(word)
        for group in group_tokens(text, spans):
            a, e = spans[group[0]][0], spans[group[-1]][1]
            w = text[a:e]
            size.append(len(group))
            spoken.append(any(map(str.isalnum, w)))
            if spoken[-1]:
                word.append(w.strip().strip(T.EDGE_DASH))
                start.append(a)
                end.append(e)
        count.append(len(word) - before)
    tokens, keep = np.array(size, np.int64), np.array(spoken, bool)
    scores = []
    for own in logits:
        mean = np.add.reduceat(np.concatenate(own), np.cumsum(tokens) - tokens) / tokens if size else np.zeros(0)
        scores.append(1 / (1 + np.exp(-mean[keep])))
    return count, word, start, end, tokens[keep].tolist(), scores


def length_batches(lengths: list[int], budget: int = 16_384, multiple: int = 32) -> Iterator[tuple[int, int]]:
    """Ranges of ascending lengths whose number times their longest, rounded up to ``multiple``, is within ``budget``; one too long stands alone."""
    begin = 0
    for i, n in enumerate(lengths):
        if i > begin and (i - begin + 1) * (-(-n // multiple) * multiple) > budget:
            yield begin, i
            begin = i
    if begin < len(lengths):
        yield begin, len(lengths)


def group_tokens(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Tokens by words, by the rule of ``decode.word_starts``: a token of the same character's bytes goes by that character."""
    groups: list[list[int]] = []
    end = -1
    for n, (a, e) in enumerate(spans):
        head = text[a] if a < e else ""
        joins = head in decode.JOINERS and a == end and 0 < a < len(text) - 1 and text[a - 1].isalnum() and text[a + 1].isalnum() if head else False
        if groups and (head.isalnum() or joins):
            groups[-1].append(n)
        else:
            groups.append([n])
        end = e
    return groups


def score_words(messages: DataFrame, source, text: str = "text") -> DataFrame:
    """Adds ``words``, the scored words of the stripped text, cut to the model's limit; a null text has none."""
    model = load(source)
    shared = messages.sparkSession.sparkContext.broadcast(model)  # a file of some hundred KB
    names = messages.columns
    d = messages.withColumn("_t", F.substring(T.strip(F.coalesce(F.col(text), F.lit(""))), 1, model.header.get("max_chars", 1200)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        kind = pa.list_(pa.struct([("word", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("tokens", pa.int32())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(tagger.words(b.column(len(names)).to_pylist()), kind)], names=[*names, "words"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields)
    return spread(d.select(*names, "_t"), heavy=True).mapInArrow(run, f"{schema}, words {WORDS}")


def both_titles(messages: DataFrame, source, budget: int = 6, text: str = "text") -> DataFrame:
    """Adds ``title`` and ``title_budget``, the hybrid decoding and that of so many words, from the same scores."""
    model = load(source)
    rules = {k: v for k, v in (model.header.get("decoding") or {}).items() if k in decode.DECODING}
    join = lambda **how: decode.join_words(decode.choose(F.col("words"), **how, **rules))
    return score_words(messages, model, text).withColumn("title", join()).withColumn("title_budget", join(mode="budget", budget=budget)).drop("words")


def precision_report(messages: DataFrame, files: dict[str, bytes], reference: str, id_col: str = "id", text: str = "text") -> DataFrame:
    """(file, bytes, n, n_same, n_empty): titles of each model file against those of the ``reference``, over the same texts.

    Each different text is cut into tokens once a tokenizer and scored by all models where it stands; its titles count as often as it occurs.
    """
    models = {name: load(data) for name, data in files.items()}
    # models of one tokenizer and limit share the words, each with a column of scores
    shares: dict[tuple, list[str]] = {}
    for name, m in models.items():
        shares.setdefault((m.merges.tobytes(), tuple(m.header["byte_ids"]), m.header["merges_base"], m.header.get("max_chars", 1200)), []).append(name)
    groups = list(shares.values())
    limits = [key[-1] for key in shares]
    shared = messages.sparkSession.sparkContext.broadcast([[models[name] for name in g] for g in groups])
    kinds = [[("word", pa.string()), ("start", pa.int32()), ("end", pa.int32()), *((f"s{i}", pa.float64()) for i in range(len(g)))] for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taggers = [[Tagger(m) for m in g] for g in shared.value]
        for whole in batches:
            for b in (whole.slice(lo, 2_000) for lo in range(0, whole.num_rows, 2_000)):
                texts, cols = b.column(1).to_pylist(), [b.column(0)]
                for own, limit, kind in zip(taggers, limits, kinds):
                    n, word, start, end, _, scores = scored_words(own, [t[:limit] for t in texts])
                    flat = [pa.array(x, t) for x, (_, t) in zip((word, start, end, *scores), kind)]
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.StructArray.from_arrays(flat, [k for k, _ in kind])))
                yield pa.RecordBatch.from_arrays(cols, names=["n", *(f"w{j}" for j in range(len(groups)))])

    cut = F.substring(T.strip(F.coalesce(F.col(text), F.lit(""))), 1, max(limits)).alias("_t")
    texts = messages.where(F.col(id_col).isNotNull()).groupBy(cut).agg(F.count("*").alias("n")).select("n", "_t")
    struct = lambda g: "word:string,start:int,end:int" + "".join(f",s{i}:double" for i in range(len(g)))
    scored = spread(texts, heavy=True).mapInArrow(run, "n long" + "".join(f", w{j} array<struct<{struct(g)}>>" for j, g in enumerate(groups)))

    def title(name: str, j: int, i: int) -> Column:
        rules = {k: v for k, v in (models[name].header.get("decoding") or {}).items() if k in decode.DECODING}
        own = F.transform(f"w{j}", lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end"), w[f"s{i}"].alias("score")))
        return decode.join_words(decode.choose(own, **rules))

    at = {name: f"t{j}_{i}" for j, g in enumerate(groups) for i, name in enumerate(g)}
    said = scored.select("n", *(title(name, j, i).alias(at[name]) for j, g in enumerate(groups) for i, name in enumerate(g)))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    rows = [
        F.struct(F.lit(name).alias("file"), F.lit(len(data)).cast("long").alias("bytes"), n(F.lit(True)).alias("n"), n(F.col(at[name]) == F.col(at[reference])).alias("n_same"), n(F.col(at[name]) == "").alias("n_empty"))
        for name, data in files.items()
    ]
    return said.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def latency(texts: list[str], source, warm: int = 50, passes: int = 3) -> dict[str, float]:
    """Milliseconds a title, titles a second and microseconds a character, of one text at a time on one core; ``warm`` titles go before."""
    tagger = Tagger(load(source))
    cut = [t.strip()[: tagger.h.get("max_chars", 1200)] for t in texts]
    for t in cut[:warm]:
        tagger.words([t])
    began = time.perf_counter()
    for _ in range(passes):
        for t in cut:
            tagger.words([t])
    seconds = max(time.perf_counter() - began, 1e-9)
    n, chars = passes * len(cut), passes * sum(map(len, cut))
    return {"ms_per_title": 1e3 * seconds / max(1, n), "titles_per_second": n / seconds, "us_per_char": 1e6 * seconds / max(1, chars)}


def titles(messages: DataFrame, source, mode: str = "hybrid", budget: int | None = None, stop: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds ``title``; an empty text, or one of marks only, has an empty title. The threshold is the model's."""
    model = load(source)
    rules = {k: v for k, v in (model.header.get("decoding") or {}).items() if k in decode.DECODING}
    if mode == "threshold" and "pure_threshold" in (model.header.get("decoding") or {}):
        rules["threshold"] = model.header["decoding"]["pure_threshold"]
    scored = score_words(messages, model, text)
    return scored.withColumn("title", decode.join_words(decode.choose(F.col("words"), mode, budget, stop, **rules))).drop("words")
