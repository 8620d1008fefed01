"""Training-data operators on small tables: brute force, nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.llm import bytegru, consensus, defects, formatting, language, lexicon, mixing, neardup, numtext, packing, personal, spans, tokens, toxicity

DOC = "doc_id long, text string, source string, h string, pos int, cls string, n string"


def docs(spark, rows, schema=DOC):
    """Documents with extra columns whose names the operators use inside."""
    width = len(schema.split(", "))
    return spark.createDataFrame([tuple(r) + ("x",) * 0 + (None,) * (width - len(r)) for r in rows], schema)


def test_rolling_hash_and_sliding():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, 200).astype(np.uint32)
    roll = numtext.RollingHash()
    h = roll.windows(roll.prefix(x), 5)
    for i, j in itertools.combinations(range(0, 190, 7), 2):
        assert (h[i] == h[j]) == (x[i : i + 5] == x[j : j + 5]).all()
    v = rng.random(50)
    for w in (1, 2, 7, 50):
        assert (numtext.sliding(np.minimum, v, w) == [v[i : i + w].min() for i in range(51 - w)]).all()


def brute_spans(texts, n):
    out = set()
    for i, t in texts.items():
        if t is None:
            continue
        hit = [any(t[s : s + n] in u for j, u in texts.items() if j != i and u) for s in range(len(t) - n + 1)]
        s = 0
        while s < len(hit):
            if hit[s]:
                e = s
                while any(hit[e + 1 : e + n + 1]):
                    e += 1 + hit[e + 1 : e + n + 1].index(True)
                out.add((i, s, e + n))
                s = e
            s += 1
    return out


def test_spans_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé 😀") for _ in range(rng.randint(3, 40)))
    pool = [word() for _ in range(14)]
    texts = {i: "".join(rng.choice(pool) for _ in range(rng.randint(0, 7))) for i in range(40)}
    texts |= {100: None, 101: "", 102: "a" * 90, 103: "a" * 60, 104: "b" * 90}
    rows = [(i, t) for i, t in texts.items()] + [(3, texts[3])]
    got = {(r.doc_id, r.span_start, r.span_end) for r in spans.shared_spans(docs(spark, rows), min_length=20).collect()}
    assert got == brute_spans(texts, 20)
    share = {r.doc_id: r for r in spans.shared_portion(docs(spark, rows), min_length=20).collect()}
    assert share[100].share == 0.0 and len(share) == len(texts)
    assert spans.shared_spans(docs(spark, [])).count() == 0


def test_spans_of_frequent_anchors(spark):
    """Anchors and runs that are frequent in a batch are settled there or spread; the result stays that of brute force."""
    rng = random.Random(1)
    base = " ".join(rng.choice(["ab", "cde", "f", "ghij", "a" * 16]) for _ in range(120))
    cut = lambda: base[(a := rng.randrange(len(base))) : a + rng.randrange(5, 150)] + rng.choice(["x", "yy é", "", "z" * 55])
    texts = ["".join(cut() for _ in range(rng.randrange(5))) for _ in range(40)]
    texts = dict(enumerate([*texts, texts[0], texts[1], texts[1][3:]]))
    want = brute_spans(texts, 20)
    for work in ({"frequent": 2, "block": 150, "batch": 600}, {"frequent": 2, "block": 100}):
        assert {tuple(r) for r in spans.shared_spans(docs(spark, texts.items()), min_length=20, **work).collect()} == want


def test_prime_hash_tells_doubling_patterns_apart():
    n = 2048
    bits = np.array([i.bit_count() & 1 for i in range(n)], np.uint32)
    roll, prime = numtext.RollingHash(), numtext.PrimeHash()
    pair = np.concatenate((bits, 1 - bits))
    both = lambda h, s: h.windows(s, n)[[0, n]] if h is roll else h.at(s, np.array([0, n]), n)
    a, b = both(roll, roll.prefix(pair))
    assert a == b  # why the modulus is a prime where windows are compared
    a, b = both(prime, prime.prefix(pair))
    assert a != b
    again = prime.at(prime.prefix(np.concatenate((pair, bits))), np.array([0, n, 2 * n]), n)
    assert again[0] == again[2] != again[1]


def sets(text, n):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return set(zip(*(w[i:] for i in range(n))))


@pytest.mark.parametrize("words", [3, 5])
def test_near_duplicates(spark, words):
    rng = random.Random(words)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.randint(3, 120))] for _ in range(12)]
    rows = [(1000, None), (1001, ""), (1002, "one two"), (1003, "?"), (1004, "zz " * 3000)]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(99)}"
        rows.append((i, " ".join(w).upper() if i % 3 else " ".join(w)))
    table = docs(spark, rows + [rows[-1]])
    text = {i: sets(t, words) for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(text), 2) if text[a] and text[b] and len(text[a] & text[b]) >= 0.8 * len(text[a] | text[b])}
    nd = neardup.NearDuplicates(table, words=words)
    assert {(r.doc_id_1, r.doc_id_2) for r in nd.pairs().collect()} == want
    groups = {r.doc_id: r for r in nd.groups().collect()}
    assert len(groups) == len(text) and groups[1000].n_links == 0
    assert all(groups[a].group_id == groups[b].group_id for a, b in want)
    few = {(r.doc_id_1, r.doc_id_2) for r in nd.pairs(expand=1).collect()}
    assert few <= want and {groups[a].group_id for a, _ in few} == {groups[a].group_id for a, _ in want}


def test_near_duplicates_of_nothing(spark):
    nd = neardup.NearDuplicates(docs(spark, []))
    assert nd.pairs().count() == 0 and nd.groups().count() == 0


def test_gray_search_is_exact():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (6, 8), np.uint64)
    codes = base[rng.integers(0, 6, 300)] ^ (rng.integers(0, 1 << 63, (300, 8), np.uint64) & rng.integers(0, 1 << 63, (300, 8), np.uint64) & rng.integers(0, 1 << 63, (300, 8), np.uint64) & rng.integers(0, 1 << 63, (300, 8), np.uint64))
    a, b = neardup.gray_search(codes, None, 58)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    apart = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2)
    assert got == {(i, j) for i, j in itertools.combinations(range(300), 2) if apart[i, j] <= 58} and got


def test_formatting(spark):
    rows = [("b", "Hello,  WORLD!"), ("a", "hello world"), ("c", "hello world 2"), ("d", "Topic: bees; Tone: calm"), ("e", '{"tone": "CALM", "topic": "Bees"}'), ("f", "- tone: calm\n- topic: bees\n"), ("g", "Topic: bees; Tone: loud"), ("h", None), ("i", ""), ("j", "..."), ("a", "hello world"), (None, "hello world"), ("k", "tone calm topic bees"), ("l", "topic: bees | tone:calm")]
    d = docs(spark, rows, "id string, text string, hi long, content string")
    assert {tuple(r) for r in formatting.pairs(d).collect()} == {("a", "b"), ("d", "e"), ("d", "f"), ("d", "k"), ("d", "l"), ("i", "j")}
    assert {r.id: r.n_copies for r in formatting.collapsed(d).collect()} == {"a": 2, "c": 1, "d": 5, "g": 1, "i": 2}
    assert formatting.pairs(d.where("false")).count() == 0
    assert formatting.fields("Ask this: why? Or: not") is None


def test_token_counter():
    enc, count = tokens.encoding(), tokens.TokenCounter()
    for t in ["", None, "a  b", " lead", "trail ", "a\n b", "x \ny", "it's  we'll\n\n go", "word " * 50, "  x", "日本 語"]:
        assert count(t) == len(enc.encode_ordinary(t or ""))


def test_shortest_pack_first_by_item():
    """Every item goes into the container filled least that takes it: checked against placing the items one at a time."""
    assert sorted(packing.pack_histogram({6: 1, 5: 1, 2: 1}, 10)) == [(((5, 1), (2, 1)), 1), (((6, 1),), 1)]
    rng = random.Random(4)
    for cap in (10, 33, 128):
        counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, cap + 1), min(cap, 25))}
        rooms = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                at = max(range(len(rooms)), key=rooms.__getitem__, default=None)
                if at is None or rooms[at] < n:
                    rooms.append(cap - n)
                else:
                    rooms[at] -= n
        got = packing.pack_histogram(counts, cap)
        left = [cap - sum(n * t for n, t in p) for p, made in got for _ in range(made)]
        assert sorted(left) == sorted(rooms)
        assert all(sum(made * t for p, made in got for m, t in p if m == n) == c for n, c in counts.items())


def test_gray_search_prunes_other_clusters():
    """Codes in clusters, as near copies have them: the comparisons are counted against all pairs, and the pairs are those of brute force."""
    rng = np.random.default_rng(3)
    slots = np.repeat(rng.integers(0, 1 << 32, (75, neardup.SLOTS), np.uint32), 20, axis=0)
    slots = np.where(rng.random(slots.shape) < 0.03, rng.integers(0, 1 << 32, slots.shape, np.uint32), slots)
    codes = neardup.narrow(slots[rng.permutation(len(slots))])
    visits: list[int] = []
    a, b = neardup.gray_search(codes, None, 109, visits=visits)
    side = rng.integers(0, 3, len(codes))
    assert {tuple(sorted(x)) for x in zip(*neardup.gray_search(codes, side, 109))} == {tuple(sorted(x)) for x in zip(a, b) if side[x[0]] != side[x[1]]}
    n = len(codes)
    far = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2)
    assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())} == {(i, j) for i, j in zip(*np.nonzero(far <= 109)) if i < j}
    assert sum(visits) < n * (n - 1) / 2 / 4, (visits, n * (n - 1) / 2)


def test_large_nodes_are_parted(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: rng.randrange(45, 60)] + [f"x{i}"])) for i in range(40)] + [(100 + i, " ".join(f"y{i}z{k}" for k in range(30))) for i in range(10)]
    d = docs(spark, rows)
    sigs = neardup._signatures(d.select("doc_id", "text"), 3, 4)
    want = sorted(map(tuple, neardup.candidates(sigs, 109).collect()))
    assert len(want) > 100
    for block, deep in ((4, 1), (4, 100), (8, 2)):
        assert sorted(map(tuple, neardup.candidates(sigs, 109, block, deep).collect())) == want


def test_packing(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 1, 5, 7, 30, 64, 65, 200, rng.randint(1, 64)]) for i in range(400)}
    d = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()] + [(999, None, "x")], "doc_id long, n_tokens long, len string")
    limits = spark.createDataFrame([("a", 64), ("b", 100), ("none", None), ("zero", 0), ("a", 64)], "limit_name string, capacity_tokens int")
    got = packing.pack_items(d, limits).collect()
    for name, cap in (("a", 64), ("b", 100)):
        rows = [r for r in got if r.limit_name == name]
        boxes = {}
        for r in rows:
            boxes[r.container] = boxes.get(r.container, 0) + r.n_tokens
            assert r.n_tokens <= cap
        assert max(boxes.values()) <= cap and sorted(boxes) == list(range(len(boxes)))
        assert len(boxes) <= 1.1 * sum(sizes.values()) / cap + 1
        for i, n in sizes.items():
            own = [r for r in rows if r.doc_id == i]
            assert sum(r.n_tokens for r in own) == n and len(own) == max(1, -(-n // cap))
    assert packing.pack_items(d.where("false"), limits).count() == 0
    assert packing.pack_items(d, limits.where("false")).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 300)
    p = np.full(300, 0.37)
    out = mixing.flight(p, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    assert (mixing.flight(np.full(9, 0.5), np.full(9, 4), rng) % 1 > 0).sum() <= 2


def test_mixture(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 60))), "big" if i < 900 else "small") for i in range(1000)]
    rows += [(2000, None, "big"), (2001, "", "small"), (2002, "x", "other"), (2003, "x", None), (5, rows[5][1], "big")]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("gone", 0.0, 2), ("null", None, None)], "source string, weight double, max_repeats int")
    m = mixing.Mixture(docs(spark, rows), targets)
    used = m.rows().collect()
    assert len({r.doc_id for r in used}) == len(used) and {r.source for r in used} == {"big", "small"}
    shares = {r.source: r for r in m.shares().collect()}
    assert abs(shares["big"].share - 0.6) < 0.01 and shares["small"].most_uses <= 3 and shares["gone"].tokens == 0
    empty = mixing.Mixture(docs(spark, []), targets)
    assert empty.rows().count() == 0 and empty.shares().count() == 4


def test_cube_in_rounds(spark):
    d = spark.range(3000).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), (F.col("id") % 40 + 1).alias("n_tokens"), F.lit(0.25).alias("p"))
    r = mixing.cube_sample(d, block=100).agg(F.sum("taken"), F.sum(F.col("taken") * F.col("n_tokens")), F.count("*")).first()
    assert r[2] == 3000 and abs(r[0] - 750) <= 2 and abs(r[1] - 0.25 * sum(i % 40 + 1 for i in range(3000))) <= 45


def test_consensus(spark):
    rng = random.Random(4)
    noise = {"good": (0.03, 0.01), "fair": (0.15, 0.05), "poor": (0.5, 0.2), "ok": (0.1, 0.03)}
    gold, titles, truth = [], [], {}
    for k in range(150):
        words = [f"w{k}x{i}" for i in range(rng.randint(6, 20))]
        keep = set(rng.sample(range(len(words)), 4))
        truth[k] = keep
        marks = {a: [int(rng.random() > m) if i in keep else int(rng.random() < e) for i in range(len(words))] for a, (m, e) in noise.items()}
        if k % 9 == 0:
            titles.append((k, None, f"id{k}", "good", " ".join(w for w, y in zip(words, marks["good"]) if y)))
            marks["good"] = None if k % 2 else marks["good"][:2]
        gold.append((k, f"id{k}", words, marks))
    gold += [(1000, "e", [], {}), (1001, None, ["a"], None), (1002, "n", None, None), (None, "q", ["a"], {"good": [1]})]
    g = spark.createDataFrame(gold, "k long, id string, words array<string>, annotators map<string,array<int>>").withColumn("rates", F.lit(1))
    t = spark.createDataFrame(titles + titles[:2], "annotation_id long, k long, id string, annotator string, title string").withColumn("annotated_ts", F.lit(None).cast("timestamp"))
    c = consensus.Consensus(g, t, rounds=4)
    found = {}
    for r in c.labels().where("label = 1").collect():
        found.setdefault(r.k, set()).add(r.word_pos)
    assert sum(found.get(k) == v for k, v in truth.items()) > 125
    weight = {r.annotator: r.weight for r in c.reliability().collect()}
    assert weight["good"] > weight["fair"] > weight["poor"]
    assert {r.k for r in c.agreement().collect() if r.agreement is None} == {1001}
    joined = consensus.Consensus(g, t, few=0)  # sums joined to the items
    handed = consensus.Consensus(g, t)
    for a, b in ((joined.labels(), handed.labels()), (joined.agreement(), handed.agreement()), (joined.reliability(), handed.reliability())):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert consensus.Consensus(g.where("false"), t, rounds=1).labels().count() == 0


def test_rare_annotators_have_wide_bounds():
    assert consensus.bounded_rate(0, 3) > consensus.bounded_rate(0, 30) > consensus.bounded_rate(0, 3000)
    assert consensus.bounded_rate(2, 20) > consensus.bounded_rate(200, 2000) > 0.1
    assert consensus.chi2_quantile(100) == pytest.approx(74.22, rel=1e-3)


def test_marks_of_title():
    words = ["The", "red", "house,", "the", "red"]
    assert consensus.marks_of_title(words, "red red") == [0, 1, 0, 0, 1]
    assert consensus.complete(words, [1, 0], "The house red", True) == [1, 0, 1, 0, 1]
    assert consensus.complete(words, [1, 0], None, False) == [1, 0, -1, -1, -1]
    assert consensus.complete(words, None, None, True) == [0] * 5


LEX = lexicon.Lexicon({w: tuple(0.0 if i == lang else -3.5 for i in range(10)) for lang, ws in ((0, "the bridge and with rules"), (1, "le pont avec pour sur"), (3, "die brücke mit für")) for w in ws.split()})


@pytest.mark.parametrize(
    "raw,message,want",
    [
        ("Stone bridge rules", "Tell me about the stone bridge and its rules", []),
        ('"Stone bridge"', "Tell me about the stone bridge with rules", []),
        ("", "a message", ["empty"]),
        (None, "a message", ["empty"]),
        ("N/A", "a message", ["empty"]),
        ("Title:", "a message", ["empty"]),
        ("<think>short</think> (no title)", "a message", ["empty"]),
        ("<think>The user wants", "a message", ["truncated"]),
        ('"the stone', "Tell me about the stone bridge", ["truncated"]),
        ("the stone brid", "Tell me about the stone bridge", ["truncated"]),
        ("stone bridge with", "the stone bridge with rules", ["truncated"]),
        ("I'm sorry, but I can't help with that", "Tell me about the bridge", ["refusal"]),
        ("Je ne peux pas répondre", "Parle du pont", ["refusal"]),
        ("I apologize letter", "I apologize letter to the club", []),
        ("Tell me about: the STONE bridge", "Tell me about the stone bridge", ["copy"]),
        ("short one", "short one", []),
        ("le pont avec", "the bridge and with the rules", ["language"]),
        ("die Brücke", None, []),
    ],
)
def test_title_rules(raw, message, want):
    assert defects.TitleRules(LEX)(raw, message) == want


def test_defects(spark):
    t = spark.createDataFrame([(1, "a", "", None), (1, "a", "", None), (2, "a", None, "timeout"), (3, "b", "the brid", None), (4, None, "fine", None), (None, "a", "", None)], "run_id long, id string, raw string, error string").withColumn("message", F.lit("x"))
    m = spark.createDataFrame([("a", "the bridge", "English"), ("b", "the bridge", None), ("b", "the bridge", " english "), (None, None, "?")], "id string, text string, language string")
    assert {(r.run_id, r.defect) for r in defects.defects(t, m).collect()} == {(1, "empty"), (3, "truncated")}
    assert defects.defects(t.where("false"), m.where("false")).count() == 0


def test_segments_against_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        x = [rng.choice([-3, -1, 1, 2]) for _ in range(rng.randint(0, 12))]
        got = toxicity.segments(x)
        best = max((sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=0)
        assert max((s for *_, s in got), default=0) == max(best, 0)
        assert all(sum(x[b:e]) == s > 0 for b, e, s in got) and all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_even_spelling():
    assert toxicity.tokens("It w0uld b.u.r.n v****n, d0n't!") == ["it", "would", "burn", "<x>", "<s>" if False else "don't", "<s>"] or "would" in toxicity.tokens("w0uld")
    assert toxicity.tokens(None) == [] and toxicity.tokens("room 12") == ["room", "<d>"]


def test_toxicity(spark):
    rng = random.Random(1)
    calm, harm, edge = ["tell me about the garden", "how do bees live", "the report is late"], "you are a worthless rotten fool", "where does the word fool come from"
    rows = []
    for i in range(1500):
        kind = rng.random()
        t = f"{rng.choice(calm)}. " + (harm if kind < 0.1 else edge if kind < 0.2 else rng.choice(calm))
        flag = rng.random() < (0.75 if kind < 0.1 else 0.3 if kind < 0.2 else 0.02)
        rows.append((f"m{i}", t, "s", None if i % 17 == 0 else flag, None))
    rows += [("n", None, None, True, None), ("e", "", "s", None, None), ("m1", rows[1][1], "s", rows[1][3], None)]
    d = spark.createDataFrame(rows, "id string, text string, source string, toxic boolean, score double")
    got = {r.id: r.is_toxic for r in toxicity.score(d).collect()}
    assert len(got) == 1502 and not got["n"] and not got["e"]
    wrong = [r[0] for r in rows[:1500] if got[r[0]] != (harm in r[1])]
    assert len(wrong) < 15
    assert toxicity.score(d.where("false")).count() == 0
    assert toxicity.rates(toxicity.score(d.where("NOT toxic"))).count() == 1


PII = [
    (1, "Mail: anna.smith@mail.example.org or (0049) x", {("email", "anna.smith@mail.example.org")}),
    (2, "write to bob (at) host (dot) example please", {("email", "bob (at) host (dot) example")}),
    (3, "Call me on +44 20 7946 0153 after six. Tel.: (629) 555-0161 ext. 12", {("phone", "+44 20 7946 0153"), ("phone", "(629) 555-0161 ext. 12")}),
    (4, "My social security number is 923-49-2882, do you need it?", {("id_number", "923-49-2882")}),
    (5, "Address: 240 Lepomer Lane, Apt 5A", {("address", "240 Lepomer Lane, Apt 5A")}),
    (6, "Ich wohne in der Nozumesil-Allee 228, zweiter Stock. Vivo en Calle Ledadamis 53.", {("address", "Nozumesil-Allee 228"), ("address", "Calle Ledadamis 53")}),
    (7, "My name is Carol T. Marsh and I need an answer today. Regards, Marsh, Carol", {("person", "Carol T. Marsh"), ("person", "Marsh, Carol")}),
    (8, "Upgrade from 10.63.1.63. Ticket #7799-628. 2017-414-61 was shipped on 2017-06-16. Mark the rose bed with carol flags.", set()),
    (9, "", set()),
    (10, None, set()),
]


def test_personal(spark):
    many = [(100 * k + i, t, None) for k in range(1, 12) for i, t, _ in PII]
    given = spark.createDataFrame([("Carol",), ("Mark",), (None,)], "given_name string").withColumn("kind", F.lit(1))
    p = personal.PersonalInformation(docs(spark, [(i, t) for i, t, _ in PII] + many + [(1, PII[0][1])]), given)
    got = {}
    for r in p.pieces().collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.found_text))
    for i, _, want in PII:
        assert got.get(i, set()) == want, i
    text = {r.doc_id: r.text for r in p.redacted().collect()}
    assert text[4] == "My social security number is [ID_NUMBER], do you need it?" and text[8] == PII[7][1]
    none = personal.PersonalInformation(docs(spark, []), given.where("false"))
    assert none.pieces().count() == 0 and none.redacted().count() == 0


def test_gradients():
    net = bytegru.ByteGRU(3, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, n = rng.integers(0, 5, (2, 6)).astype(np.uint8), np.array([6, 4])
    y = rng.integers(0, 3, (2, 6))
    y[1, 4:] = -1
    _, grad = net.gradients(x, n, y)
    for k in net.p:
        for _ in range(4):
            at = tuple(int(rng.integers(s)) for s in net.p[k].shape)
            if k == "x":
                at = (at[0], int(x[0, 1]), at[2])
            keep, eps = net.p[k][at], 1e-4
            net.p[k][at] = keep + eps
            up = net.gradients(x, n, y)[0]
            net.p[k][at] = keep - eps
            down = net.gradients(x, n, y)[0]
            net.p[k][at] = keep
            assert grad[k][at] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_probabilities_of_padded_texts():
    """The way forth and back in place is the network that is trained; padding has no part in it."""
    net, rng = bytegru.ByteGRU(3, 4), np.random.default_rng(1)
    n = np.array([9, 4, 7])
    x = rng.integers(97, 123, (3, 9)).astype(np.uint8) * (np.arange(9) < n[:, None]).astype(np.uint8)
    chance, logs = net.probabilities(x, n, np.array([2, 0, 6]), np.array([5, 4, 1]))
    y = np.zeros((3, 9), np.int64)
    for row, begin, size, at in ((0, 2, 5, 0), (1, 0, 4, 5), (2, 6, 1, 9)):
        for k in range(size):
            one = np.full((1, n[row]), -1)
            one[0, begin + k] = y[row, begin + k]
            loss, _ = net.gradients(x[row : row + 1, : n[row]], n[row : row + 1], one)
            assert -logs[0, at + k] == pytest.approx(loss, abs=1e-4)
    assert np.allclose(chance.sum(axis=0), 1, atol=1e-5) and np.allclose(np.exp(logs), chance, atol=1e-5)


def test_parts_of_long_texts_agree_with_the_whole():
    en, fr = "the old house near the river is for sale and my neighbour says so. ", "la vieille maison près de la rivière est à vendre. "
    net = language.train([(en * 2, "English"), (fr * 2, "French")] * 20, steps=(40, 40), batch=24, width=96, hidden=12)
    texts = [en * 30 + fr * 30, fr * 50, en * 8 + fr * 9 + en * 7]
    whole = language.label_texts(net, texts, [None] * 3, part=1 << 20)
    parts = language.label_texts(net, texts, [None] * 3, part=500, margin=256)
    assert [[x[0] for x in f] for f in whole] == [["English", "French"], ["French"], ["English", "French", "English"]]
    assert [[(x[0], x[2], x[3]) for x in f] for f in parts] == [[(x[0], x[2], x[3]) for x in f] for f in whole]
    assert all(a[1] == pytest.approx(b[1], abs=0.01) for f, g in zip(whole, parts) for a, b in zip(f, g))


def test_languages(spark):
    en = ["the old house near the river is for sale", "please tell me how to clean the kitchen", "my neighbour says that the water is cold"]
    fr = ["la vieille maison près de la rivière est à vendre", "dites-moi comment nettoyer la cuisine", "mon voisin dit que cette eau est froide"]
    rng = random.Random(2)
    rows = [(f"{i}", f"{rng.choice(s).capitalize()}. {rng.choice(s).capitalize()}.", lang) for i in range(160) for s, lang in ((en, "English"), (fr, "French"))]
    rows = [(f"{lang[0]}{i}", t, lang) for i, t, lang in rows]
    rows += [("mix", f"{en[0].capitalize()}. {fr[1].capitalize()}.", "English"), ("miss", fr[0] + ".", "?"), ("wrong", en[2] + ".", "French"), ("odd", en[1] + ".", " english "), ("null", None, "English"), ("blank", " \n", None), ("num", "12 + 3", None), ("long", (en[0].capitalize() + ". ") * 120, "English"), ("odd", en[1] + ".", " english ")]
    d = spark.createDataFrame(rows, "id string, text string, language string").withColumn("label", F.lit(1))
    net = language.fit(d, steps=(60, 60), batch=32, width=96, hidden=16)
    found = language.segments(d, net)
    got = {}
    for r in language.doubtful(found).collect():
        got.setdefault(r.id, set()).add(r.language)
    assert got == {"mix": {"English", "French"}, "miss": {"French"}, "wrong": {"English"}}
    assert language.documents(found).where("id = 'long'").count() == 1
    assert {(r.id, r.confidence) for r in language.documents(found).where("language IS NULL").collect()} == {("null", 0.0), ("blank", 0.0), ("num", 0.0)}
    assert language.segments(d.where("false")).count() == 0


def test_no_pair_at_the_threshold_is_pruned(spark):
    tail = neardup.bits_tail(0.8)
    band, bound = neardup.layout(0.8)
    assert 0.003 < tail[80] < 0.005 and tail[bound] <= 5e-7 < tail[bound - 1]
    assert (1 - 0.8**band) ** (neardup.SLOTS // band) <= 5e-7
    with pytest.raises(ValueError):
        neardup.layout(0.49)
    # 40 shared runs of 50: similarity 0.8; of 3,000 such pairs those that differ in more than 80 bits
    shingle, far = neardup.Shingler(3), []
    for i in range(3000):
        w = [f"w{i}x{k}" for k in range(52)]
        pair = " ".join(w[:42]), " ".join(w)
        a, b = (neardup.narrow(neardup.signature(shingle(t))[None]) for t in pair)
        if np.bitwise_count(a ^ b).sum() > 80:
            far.append(pair)
    assert far
    rows = [(2 * i + k, t) for i, p in enumerate(far) for k, t in enumerate(p)]
    got = {(r.doc_id_1, r.doc_id_2) for r in neardup.NearDuplicates(docs(spark, rows), words=3).pairs().collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(len(far))}


def test_sum_of_the_best_against_simulation():
    rng = np.random.default_rng(7)
    # the r highest points of the limit: minus the logarithms of the arrival times of a Poisson process
    x = -np.log(np.cumsum(rng.exponential(size=(200_000, 4)), axis=1))
    for r in (2, 3, 4):
        for t in (1.0, 4.0, 7.0):
            p = (x[:, :r].sum(axis=1) > t).mean()
            assert toxicity.sum_chance(t, r) == pytest.approx(p, rel=0.1, abs=4e-4)


def test_passages_add_up():
    table = {"vile": (1.1, 50), "rot": (2.5, 50), "calm": (-1.0, 50)}
    m = toxicity.ToxicModel(table, frozenset(table), -1.0, -1.0, lam=4.0, k=0.1)
    one, many = "vile calm calm calm calm", "vile calm calm calm calm " * 6
    # below min_score alone, a case together; each passage of it comes out
    assert not m.judge(one)[3] and m.judge(many)[3]
    assert [p[0] for p in m.judge(many)[4]] == ["vile"] * 6
    assert m.judge(many)[0] > m.judge(one)[0] and m.judge(many)[1] < m.judge(one)[1]
    two = m.judge("rot calm calm calm rot calm calm calm")
    assert two[3] and [p[0] for p in two[4]] == ["rot", "rot"] and two[0] == pytest.approx(5.0)
    assert m.judge("rot calm")[0] == pytest.approx(2.5) and m.judge(None) == (0.0, m.k, "", False, [])


def test_all_pairs_of_a_large_class(spark):
    # one set of runs, written in 70 ways, and a set like it
    same = [" ".join(f"w{k}" for k in range(40)) + "!" * i for i in range(70)]
    rows = [*enumerate(same), (100, " ".join(f"w{k}" for k in range(41)))]
    got = {(r.doc_id_1, r.doc_id_2) for r in neardup.NearDuplicates(docs(spark, rows), words=3).pairs().collect()}
    assert got == set(itertools.combinations([i for i, _ in rows], 2))


def test_large_nodes_keep_pairs_of_one_pattern(spark):
    """Classes that share one pattern only, in a node beyond every bound of blocks: all pairs within the bound come out."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 8, np.uint64)
    rows = []
    for i in range(60):
        code = base ^ (np.uint64(1) << np.uint64(i)) if i < 40 else rng.integers(0, 1 << 63, 8, np.uint64)
        rows.append((i, 1000 + i, bytearray(code.tobytes()), [7, *(100 * i + k for k in range(1, 32))]))
    sigs = spark.createDataFrame(rows, "doc_id long, cls long, code binary, keys array<long>")
    want = [(1000 + a, 1000 + b) for a, b in itertools.combinations(range(40), 2)]
    for work in ((4, 1), (4, 3), (8, 2), (4, 2, 6), (2000, 32)):
        assert sorted(map(tuple, neardup.candidates(sigs, 109, *work).collect())) == want, work


def test_gray_search_in_parts_and_without_pruning():
    rng = np.random.default_rng(6)
    like = rng.integers(0, 1 << 63, (5, 8), np.uint64)[rng.integers(0, 5, 60)] ^ (np.uint64(1) << rng.integers(0, 64, (60, 8)).astype(np.uint64))
    for codes in (like, np.concatenate((like, rng.integers(0, 1 << 63, (400, 8), np.uint64)))):
        apart = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2)
        for side in (None, rng.integers(0, 3, len(codes)), np.zeros(len(codes), np.int64)):
            want = {(i, j) for i, j in zip(*np.nonzero(apart <= 109)) if i < j and (side is None or side[i] != side[j])}
            for room in (1, 999, 1_000_000):
                a, b = neardup.gray_search(codes, side, 109, room=room)
                got = list(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
                assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("words", [1, 3])
def test_runs_of_odd_texts(words):
    """The sets are those of the words themselves: all scripts, pairs of UTF-16 units, lower case of other length, words of any length."""
    rng = random.Random(words)
    signs = ["a", "B", "é", "İ", "Σ", "ß", "_", " ", "\n", "\0", "中", "𝒜", "𐐀", "😀", "́", "٣", "²", "ǅ", "x" * 40]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(200))) for _ in range(400)]
    texts = [None, "a", *texts, "", "a b", "a b c", "z" * 500, *(" ".join(["z" * n, "a"] * 4) for n in (3, 4, 5, 127, 128, 129)), None]
    found, starts = neardup.Shingler(words).sets(texts)
    known = {}
    for i, t in enumerate(texts):
        own = found[starts[i] : starts[i + 1]]
        assert (own[1:] > own[:-1]).all() and len(own) == len(sets(t, words)), t
        # the same run has the same hash everywhere, another run another
        for run in sets(t, words):
            h = neardup.Shingler(words)(" ".join(run)).tolist()
            assert known.setdefault(run, h) == h and len(h) == 1 and h[0] in own, run
    assert len({h[0] for h in known.values()}) == len(known)
    assert [len(x) for x in neardup.Shingler(words).sets([None, ""])] == [0, 3]


def test_fingerprints_cost_no_more_than_the_words(monkeypatch):
    """All that a record's fingerprint takes is less than twice the time of a pattern that finds its words (some four times when each word was looked up)."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(150_000)}" for _ in range(180)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(neardup, "spread", lambda df: df)
    make = neardup._signatures(type("Docs", (), {"mapInArrow": staticmethod(lambda f, schema: f)}), 3, 4)

    def seconds(f):
        best = []
        for _ in range(3):
            at = time.process_time()
            f()
            best.append(time.process_time() - at)
        return min(best)

    words = re.compile(r"[^\W_]+")
    assert seconds(lambda: list(make(iter([batch])))) < 2 * seconds(lambda: [words.findall(t.lower()) for t in texts])
