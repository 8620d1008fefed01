"""Missing and wrong language labels (problem 7).

A bidirectional gated recurrent network over bytes gives every position of a text the probabilities of the languages.
It is trained in numpy on a bounded sample of labelled messages, cut and joined at random so that it learns that a
text may change its language midway.

A path of least cost through the positions (Viterbi) decides where the language changes; a change is cheap between sentences and dear
within one, so that names and a few foreign words don't make one; positions in program text have no say. Of each language on the path its
positions' probabilities are pooled into a confidence.

Defined results: null and blank texts, and texts without letters, have one segment of no language with confidence 0; repeated rows of one id count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage, spread
from .bytegru import ByteGRU
from .lexicon import LANGUAGES, clean_label
from .numtext import slices

_SENTENCE = re.compile(r"(?<=[.?!;])\s+|\n+")
_LETTERS = re.compile(r"[^\W\d_]")
_WORDS = re.compile(r"[^\W\d_]{2,}")

#: Batches of the two turns of training, and units of the network in each direction.
STEPS, HIDDEN = (170, 280), 24


def _training(rows: list[tuple[str, str]], steps: int, batch: int, width: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of windows: a text or two or three pieces of texts of any language, in any case."""
    rng = np.random.default_rng(seed)
    by: list[list[str]] = [[] for _ in LANGUAGES]
    for text, lang in rows:
        by[LANGUAGES.index(lang)].append(text)
    have = [i for i, x in enumerate(by) if x]
    # languages in proportion to the root of their share
    share = np.sqrt([len(by[i]) for i in have])
    share /= share.sum()
    for _ in range(steps):
        x, y, n = np.zeros((batch, width), np.uint8), np.full((batch, width), -1, np.int64), np.zeros(batch, np.int64)
        for b in range(batch):
            pieces = 1 if rng.random() < 0.5 else int(rng.integers(2, 4))
            at = 0
            for k in range(pieces):
                lang = int(rng.choice(have, p=share))
                t = by[lang][int(rng.integers(len(by[lang])))]
                if pieces > 1 or rng.random() < 0.5:
                    parts = [s for s in _SENTENCE.split(t) if s.strip()] or [t]
                    t = parts[int(rng.integers(len(parts)))]
                kind = rng.random()
                t = t.lower() if kind < 0.25 else t.upper() if kind < 0.35 else t
                if rng.random() < 0.1:  # blanks of another sort
                    t = t.replace(" ", ("\n", " \n ", "\t", "\xa0")[int(rng.integers(4))])
                glue = ("", " ", "\n", "\n\n", " -- ", ". ")[int(rng.integers(6))] if k else ""
                raw = (glue + t).encode()
                room = width - at
                if pieces == 1 and len(raw) > room:
                    begin = int(rng.integers(len(raw) - room + 1))
                    raw = raw[begin : begin + room]
                raw = raw[:room]
                x[b, at : at + len(raw)] = np.frombuffer(raw, np.uint8)
                y[b, at : at + len(raw)] = lang
                at += len(raw)
                if at >= width:
                    break
            n[b] = max(1, at)
        yield x, n, y


def fit(messages: DataFrame, sample_rows: int = 6000, steps: tuple[int, int] = STEPS, batch: int = 96, width: int = 144, hidden: int = HIDDEN, seed: int = 7) -> ByteGRU:
    """Trains on a sample of at most about ``sample_rows`` labelled messages, chosen by the hash of the id.

    Labels are wrong at times and texts mixed, so the first steps' network picks the texts that are in the language of their label
    throughout, and the other steps train on them alone.
    """
    rows = messages.select("id", "text", clean_label(F.col("language")).alias("lang")).where("lang IS NOT NULL AND length(trim(text)) > 0")
    per = max(1, sample_rows // len(LANGUAGES))
    n = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    # about as many of each language as of any other, as far as there are
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, 2.0 * per / v))])[F.col("lang")] if n else F.lit(0.0)
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample_rows).select("text", "lang").collect()
    sample = [(r[0], r[1]) for r in drawn]
    return train(sample, steps, batch, width, hidden, seed)


def train(sample: list[tuple[str, str]], steps: tuple[int, int] = STEPS, batch: int = 96, width: int = 144, hidden: int = HIDDEN, seed: int = 7) -> ByteGRU:
    """A network from (text, language) rows, some of whose labels are wrong."""
    net = ByteGRU(len(LANGUAGES), hidden, seed)
    if not sample:
        return net
    net.train(_training(sample, steps[0], batch, width, seed), rate=0.03)
    found = label_texts(net, [t for t, _ in sample], [None] * len(sample))
    clean = [x for x, f in zip(sample, found) if len(f) == 1 and f[0][0] == x[1]]
    if len({lang for _, lang in clean}) == len({lang for _, lang in sample}):
        sample = clean
    net.train(_training(sample, steps[1], batch, width, seed + 1), rate=0.02)
    return net


def path(gain: np.ndarray, lengths: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Likeliest classes [batch, steps] where a change of class before a step costs what ``cost`` has there."""
    n, steps, k = gain.shape
    score = gain[:, 0].copy()
    stay = np.zeros((n, steps, k), bool)
    lead = np.zeros((n, steps), np.int64)
    rows = np.arange(n)
    for t in range(1, steps):
        lead[:, t] = score.argmax(axis=1)
        best = score[rows, lead[:, t]] - cost[:, t]
        stay[:, t] = score >= best[:, None]
        new = np.where(stay[:, t], score, best[:, None]) + gain[:, t]
        score = np.where((t < lengths)[:, None], new, score)
    out = np.zeros((n, steps), np.int64)
    cur = score.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        out[:, t] = cur
        if t:
            move = (t < lengths) & ~stay[rows, t, cur]
            cur = np.where(move, lead[:, t], cur)
    return out


#: Where one sentence ends and another may begin, in bytes: behind it a change of language is cheap.
_BREAK = re.compile(rb"(?:[.?!;:\xa6]['\")\]]*\s+|\s*\n+\s*|\s(?:--|\||>>|\xe2\x80\x93)\s+)(?:(?:--|>>|[*>-]|\d+[.)])\s*)*")
#: The same where none of the other marks is in the text.
_STOP = re.compile(rb"[.?!;:\xa6]['\")\]]*\s+(?:(?:[*>-]|\d+[.)])\s*)*")
_OTHER_BREAKS = (b"\n", b"--", b"|", b">>", b"\xe2\x80\x93")
#: Bytes that a regular expression takes for white space.
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Marks of program text; two of them in a piece make it code.
_CODE = re.compile(rb"\w\(|\w\.\w+\(|\):|[{}\[\]<>_`]|[+=-]?=|;\s*$|\bSELECT\b|\bWHERE\b|\bdef\b|\breturn\b")
#: Marks without which, and without its words, there is no program text.
_CODE_MARKS = b"(){}[]<>_`=;"
#: Bytes that the network takes at once, and how many more on either side it sees without judging them.
PART, MARGIN = 2048, 256


def _pieces(raw: bytes) -> Iterator[tuple[int, int]]:
    """Begin and end of the sentences of a text."""
    at = 0
    for m in (_BREAK if any(x in raw for x in _OTHER_BREAKS) else _STOP).finditer(raw):
        # a line of a word or two is a broken line, not a sentence
        if m.end() > at and (m[0][:1] in b".?!;:\xa6" or len(raw[at : m.start()].split()) > 3):
            yield at, m.end()
            at = m.end()
    if at < len(raw):
        yield at, len(raw)


class _Texts:
    """Texts one behind the other as bytes, and the steps at whose beginning a change of language is possible."""

    def __init__(self, raw: list[bytes], part: int, cheap: float, dear: float) -> None:
        self.raw = raw
        size = np.array(list(map(len, raw)), np.int64)
        self.begin = np.concatenate(([0], np.cumsum(size)))
        data = np.frombuffer(b"".join(raw), np.uint8)
        cost = np.full(len(data), np.inf)
        cost[1:][_BLANK[data[:-1]]] = dear
        self.speaks = np.ones(len(data), bool)
        breaks: list[int] = []
        for t, at in zip(raw, self.begin.tolist()):
            code = len(t.translate(None, _CODE_MARKS)) < len(t) or any(w in t for w in (b"SELECT", b"WHERE", b"def", b"return"))
            silent = 0
            for b, e in _pieces(t):
                breaks.append(at + b)
                if code:
                    piece = t[b:e].replace(b">>", b"").replace(b"--", b"")
                    if b'":' not in piece and len(_CODE.findall(piece)) >= 2:
                        self.speaks[at + b : at + e] = False
                        silent += e - b
            if silent == len(t):
                self.speaks[at : at + len(t)] = True
        cost[breaks] = cheap
        cost[self.begin[:-1]] = 0
        # (text, first and last byte that are judged) of each part that goes through the network
        parts = -(-size // part)
        self.owner = np.repeat(np.arange(len(raw)), parts)
        self.lo = self.begin[self.owner] + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * part
        self.hi = np.minimum(self.lo + part, self.begin[self.owner + 1])
        step = np.isfinite(cost)
        step[self.lo] = True  # a step that began in the part before goes on
        self.at = np.flatnonzero(step)
        self.cost = cost[self.at]

    def seen(self, u: int, margin: int) -> tuple[bytes, int]:
        """The bytes of a part with those beside it, and how many of these are before it."""
        t, at = self.raw[self.owner[u]], int(self.begin[self.owner[u]])
        lo, hi = int(self.lo[u]) - at, int(self.hi[u]) - at
        return t[max(0, lo - margin) : hi + margin], min(lo, margin)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1 … for each size, one behind the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def _batches(sizes: list[int], most: int, room: int) -> Iterator[list[int]]:
    """Indexes in order of size, as many of about the same size as make up a batch of bounded size."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    at = 0
    while at < len(order):
        take = 1
        while at + take < len(order) and take < most and (take + 1) * sizes[order[at + take]] <= room:
            take += 1
        yield order[at : at + take]
        at += take


def label_texts(
    net: ByteGRU, texts: list[str | None], labels: list[str | None], cheap: float = 12.0, dear: float = 60.0, floor: float = -4.0, min_words: int = 3, min_letters: int = 12, doubt: float = 14.0, trust: float = 0.88, part: int = PART, margin: int = MARGIN
) -> list[list[tuple[str, float, int, int]]]:
    """Per text the segments (language, confidence, begin, end) in code points, in order.

    A stretch with fewer than ``min_words`` words or ``min_letters`` letters, or that is less than ``doubt`` nats likelier in its own language than
    in that of the text or has a confidence below ``trust``, is no segment of its own; and a text that is no surer than that to be in
    another language than its label's keeps the label.

    Texts longer than ``part`` bytes go through the network in parts, which see ``margin`` bytes of their neighbours on either side, more than
    it remembers. The path goes through the whole text.
    """
    which = [i for i, t in enumerate(texts) if t and _LETTERS.search(t)]
    out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
    if not which:
        return out
    have = _Texts([texts[i].encode("utf-8", "replace") for i in which], part, cheap, dear)
    first, last = np.searchsorted(have.at, have.lo), np.searchsorted(have.at, have.hi)
    gain, mass, count = np.zeros((len(have.at), len(LANGUAGES))), np.zeros((len(have.at), len(LANGUAGES))), np.zeros(len(have.at), np.int64)
    seen = [have.seen(u, margin) for u in range(len(have.lo))]
    for own in _batches([len(x) for x, _ in seen], 768, 200_000):
        lengths = np.array([len(seen[u][0]) for u in own], np.int64)
        width = int(lengths.max())
        x = np.frombuffer(b"".join(seen[u][0].ljust(width, b"\0") for u in own), np.uint8).reshape(len(own), width)
        skip, size = np.array([seen[u][1] for u in own]), have.hi[own] - have.lo[own]
        chance, full = net.probabilities(x, lengths, skip, size)
        steps = last[own] - first[own]
        to = _ranges(first[own], steps)
        cut = have.at[to] - np.repeat(have.lo[own] - (np.cumsum(size) - size), steps)
        spoken = have.speaks[_ranges(have.lo[own], size)]
        mass[to] = np.add.reduceat(chance, cut, axis=1).T
        np.maximum(full, np.float32(floor), out=full)
        full *= spoken
        gain[to] = np.add.reduceat(full, cut, axis=1).T
        count[to] = np.add.reduceat(spoken, cut, dtype=np.int64)
    # the likeliest path through each text's steps
    edge = np.searchsorted(have.at, have.begin)
    steps = np.diff(edge)
    best = np.zeros(len(have.at), np.int64)
    for own in _batches(steps.tolist(), 4096, 200_000):
        n = steps[own]
        row, column, flat = np.repeat(np.arange(len(own)), n), _ranges(np.zeros(len(own), np.int64), n), _ranges(edge[:-1][own], n)
        g, c = np.zeros((len(own), int(n.max()), len(LANGUAGES))), np.full((len(own), int(n.max())), np.inf)
        g[row, column], c[row, column] = gain[flat], have.cost[flat]
        best[flat] = path(g, n, c)[row, column]
    # stretches of one language
    change = np.concatenate(([True], best[1:] != best[:-1]))
    change[edge[:-1]] = True
    new = np.flatnonzero(change)
    langs, stop = best[new], np.append(have.at[new][1:], have.begin[-1])
    gain, mass, count = np.add.reduceat(gain, new, axis=0), np.add.reduceat(mass, new, axis=0), np.add.reduceat(count, new)
    mass /= (stop - have.at[new])[:, None]
    sure = mass[np.arange(len(new)), langs]
    of = np.searchsorted(new, edge)
    for k, (i, raw) in enumerate(zip(which, have.raw)):
        lo, hi = int(of[k]), int(of[k + 1])
        keep, main, said = [lo], int(langs[lo]), (texts[i],)
        if hi - lo > 1:
            at = have.at[new[lo:hi]] - have.begin[k]
            said = [raw[b:e].decode("utf-8", "ignore") for b, e in zip(at, [*at[1:], len(raw)])]
            words, letters = [len(_WORDS.findall(x)) for x in said], [sum(map(str.isalpha, x)) for x in said]
            main = int(langs[max(range(lo, hi), key=lambda j: (count[j], letters[j - lo]))])
            keep = [j for j in range(lo, hi) if langs[j] == main or words[j - lo] >= min_words and letters[j - lo] >= min_letters and gain[j, langs[j]] - gain[j, main] >= doubt and sure[j] >= trust]
        named, p = [int(langs[j]) for j in keep], [float(sure[j]) for j in keep]
        label = LANGUAGES.index(labels[i]) if labels[i] in LANGUAGES else None
        if label is not None and label != main and all(x == main for x in named) and (sum(gain[j, main] - gain[j, label] for j in keep) < doubt or max(p) < trust):
            named, p = [label] * len(keep), [float(mass[j, label]) for j in keep]
        starts = [0, *accumulate(map(len, said))]
        out[i] = [(LANGUAGES[x], round(y, 6), starts[j - lo], starts[j - lo + 1]) for j, x, y in zip(keep, named, p)]
    return out


def segments(messages: DataFrame, net: ByteGRU | None = None) -> DataFrame:
    """(id, label, language, confidence, seg_start, seg_end): one row a segment; label is the table's, cleaned, or null."""
    src = messages.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("text", "language"), F.struct(F.col("text").isNotNull(), "text", "language")).alias("m")).select("id", "m.text", clean_label(F.col("m.language")).alias("label"))
    src = cut_lineage(src, "texts")
    net = net or fit(messages)
    shared = messages.sparkSession.sparkContext.broadcast(net)  # some hundred KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, labels, found = b.column(1).to_pylist(), b.column(2).to_pylist(), []
            for lo, hi in slices(texts):
                found += label_texts(shared.value, texts[lo:hi], labels[lo:hi])
            found = [f or [(None, 0.0, 0, len(t or ""))] for f, t in zip(found, texts)]
            take = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            flat = [x for f in found for x in f]
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), *(pa.array([x[k] for x in flat], t) for k, t in enumerate(kinds))], names=["id", "label", "language", "confidence", "seg_start", "seg_end"])

    kind = src.schema["id"].dataType.simpleString()
    return spread(src).mapInArrow(run, f"id {kind}, label string, language string, confidence double, seg_start int, seg_end int")


def documents(found: DataFrame) -> DataFrame:
    """(id, label, language, confidence) per language that occurs in a text; the confidence is the mean over its characters. A text without one has a null."""
    n = F.col("seg_end") - F.col("seg_start")
    return found.groupBy("id", "label", "language").agg(F.coalesce(F.round(F.try_divide(F.sum(F.col("confidence") * n), F.sum(n)), 6), F.lit(0.0)).alias("confidence"))


def doubtful(found: DataFrame) -> DataFrame:
    """(id, language) of texts whose label is missing or wrong, or that have several languages."""
    each = found.where("language IS NOT NULL").groupBy("id").agg(F.first("label").alias("label"), F.array_sort(F.collect_set("language")).alias("langs"))
    wrong = each.where("label IS NULL OR size(langs) > 1 OR NOT array_contains(langs, label)")
    return wrong.select("id", F.explode("langs").alias("language"))
