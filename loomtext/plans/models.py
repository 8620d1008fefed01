"""Queries of the tokenizer and the tagger, over a model with seeded weights: no trained one exists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import bpe
from ..functions import text as T
from ..functions.session import cut_lineage
from ..operators import labels as L
from ..operators import sampling as S
from ..operators import tagger, training
from ..operators import titles as O
from ..sources import modelfile
from . import sqltext as Q
from .corpus import read


def piece_counts(messages):
    """(piece, n) over all messages: what the merges are learned from, counted in Spark."""
    return messages.where("text IS NOT NULL").select(F.explode(T.pre_split(F.substring("text", 1, 1200))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def learn(messages, n_merges: int = 512, max_pieces: int = 200_000) -> bpe.Tokenizer:
    """Merges from all pieces that are more than one in ``max_pieces`` of the text; so there are never more than that on the driver."""
    counts = cut_lineage(piece_counts(messages), "pieces")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") * max_pieces >= total).collect()
    return bpe.train(dict(map(tuple, rows)), n_merges)


def seeded_model(tok: bpe.Tokenizer, bits: int = 3, dim: int = 32, layers: int = 2, heads: int = 4, emb: int = 8, positions: str = "learned", seed: int = 1) -> bytes:
    rng = np.random.default_rng(seed)
    vocab = tok.base + len(tok.rank)
    w = {"emb_tok.weight": rng.normal(0, 0.5, (vocab, emb)), "proj_emb.weight": rng.normal(0, 0.5, (dim, emb))}
    if positions == "learned":
        w["emb_pos.weight"] = rng.normal(0, 0.1, (512, dim))
    for k in range(layers):
        shapes = {"n1": (dim,), "n2": (dim,), "att.qkv": (3 * dim, dim), "att.output": (dim, dim), "ff.net.0": (4 * dim, dim), "ff.net.2": (dim, 4 * dim)}
        for name, shape in shapes.items():
            w[f"blocks.{k}.{name}.weight"] = np.ones(shape) if len(shape) == 1 else rng.normal(0, 0.2, shape)
            w[f"blocks.{k}.{name}.bias"] = np.zeros(shape[0])
    w |= {"norm.weight": np.ones(dim), "norm.bias": np.zeros(dim), "head.weight": rng.normal(0, 0.5, (1, dim)), "head.bias": np.zeros(1)}
    header = {"dim": dim, "layers": layers, "heads": heads, "dim_emb": emb, "positions": positions, "vocab": vocab, "merges_base": tok.base, "byte_ids": tok.byte_ids, "pad": 0, "max_chars": 1200, "max_pos": 512, "scope": "synthetic", "languages": [], "decoding": {"threshold": 0.5, "min_words": 3, "max_words": 6, "keep_all_up_to": 4}}
    return modelfile.write(header, np.array(sorted(tok.rank, key=tok.rank.get)).reshape(-1, 2), w, bits)


def bpe_pieces(spark, sf):
    return piece_counts(read(spark, sf, "messages"))


def model_titles(spark, sf):
    """Hybrid titles of all messages by the seeded model."""
    m = read(spark, sf, "messages").where("id IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))
    model = seeded_model(learn(read(spark, sf, "messages")))
    return tagger.titles(m, model).select("id", "title")


def reference_titles(spark, sf):
    """Both decodings of every message, from one run of the seeded model."""
    m = read(spark, sf, "messages").where("id IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))
    return tagger.both_titles(m, seeded_model(learn(read(spark, sf, "messages")))).select("id", "title", "title_budget")


def precision_report(spark, sf):
    """How many titles stay the same when the seeded model is stored at 3, 4 or 8 bits instead of as floats."""
    m = read(spark, sf, "messages").where("id IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))
    tok = learn(read(spark, sf, "messages"))
    return tagger.precision_report(m, {f"int{b}" if b < 32 else "fp32": seeded_model(tok, b) for b in (3, 4, 8, 32)}, "fp32")


def _training(spark, sf):
    t = S.first_wins(read(spark, sf, "teacher_titles").where("error IS NULL AND run_id IS NOT NULL").select("run_id", "id", "raw"), "run_id", "id")
    t = O.cleaned(t).select("id", F.col("clean").alias("title"), "refused")
    m = read(spark, sf, "messages").where("id IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))
    return training.training_rows(t, m, learn(read(spark, sf, "messages")))


def training_rows(spark, sf):
    """Tokens with labels and word numbers of all titles that can be aligned."""
    return _training(spark, sf).where("ids IS NOT NULL").select("id", "title", F.size("ids").alias("n_tokens"), F.aggregate("labels", F.lit(0), lambda a, x: a + x).alias("n_kept"), (F.array_max("words") + 1).alias("n_words"), "truncated")


def labeling_funnel(spark, sf):
    return training.labeling_funnel(_training(spark, sf))


def alignment_check(spark, sf):
    """How many hand titles of the gold set are aligned to the spans that the hand laid down."""
    g = read(spark, sf, "gold_consensus").where("text IS NOT NULL AND title IS NOT NULL").select("k", "text", "title", L.title_spans(F.col("text"), F.col("title")).alias("spans"))
    return training.alignment_check(g).groupBy("outcome").agg(F.count("*").alias("n"))


PIECE_SQL = f"SELECT piece, count(*) AS n FROM (SELECT unnest({Q.pre_split('substr(text, 1, 1200)')}) AS piece FROM messages WHERE text IS NOT NULL) GROUP BY piece"

QUERIES = {"bpe_pieces": (bpe_pieces, PIECE_SQL), "model_titles": (model_titles, None), "reference_titles": (reference_titles, None), "precision_report": (precision_report, None), "training_rows": (training_rows, None), "labeling_funnel": (labeling_funnel, None), "alignment_check": (alignment_check, None)}
