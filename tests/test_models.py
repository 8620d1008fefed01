"""Tokenizer, model file, tagger, teacher, sinks and streams."""

import json

import numpy as np
import pytest

from loomtext.functions import bpe
from loomtext.operators import decode, tagger
from loomtext.plans import models
from loomtext.sources import modelfile, sinks, tables, teacher
from loomtext.streaming import titles as streams

TEXTS = ["", "  ...  !!  ", "Le porte-monnaie d'Anna, s'il vous plaît", "naïve 😀 café", "a  b\n\nc", "x_y m² c++ log4j2.xml", "日本語のテキスト"]


@pytest.fixture(scope="module")
def tok():
    return bpe.train({p: 3 for t in TEXTS for p in bpe.pieces(t)}, 40)


def test_pieces_match_the_pattern():
    regex = pytest.importorskip("regex")
    from loomtext.functions.text import PRE_SPLIT

    for t in TEXTS + ["it's we'll", " \n x", "trail  ", "привет, мир"]:
        assert bpe.pieces(t) == regex.findall(PRE_SPLIT, t)


def test_encode_round_trip(tok):
    back = {b: i for i, b in enumerate(tok.byte_ids)}
    pairs = {tok.base + k: p for p, k in tok.rank.items()}

    def raw(t):
        return bytes([back[t]]) if t in back else raw(pairs[t][0]) + raw(pairs[t][1])

    for t in TEXTS:
        ids, spans = tok.encode(t)
        assert b"".join(map(raw, ids)).decode() == t
        assert not spans or (spans[0][0] == 0 and spans[-1][1] == len(t) and all(b[0] <= a[1] and b[0] >= a[0] for a, b in zip(spans, spans[1:])))


@pytest.mark.parametrize("bits", [3, 4, 8])
def test_bits(bits):
    top = (1 << (bits - 1)) - 1
    q = np.random.default_rng(0).integers(-top, top + 1, 1001)
    assert (modelfile.unpack(modelfile.pack(q, bits), len(q), bits) == q).all()


@pytest.mark.parametrize("bits,positions", [(3, "learned"), (4, "sinus"), (8, "learned"), (32, "sinus")])
def test_model_file(tok, bits, positions, tmp_path):
    data = models.seeded_model(tok, bits, positions=positions)
    full = modelfile.parse(models.seeded_model(tok, 32, positions=positions))
    m = modelfile.parse(data)
    step = {3: 3, 4: 7, 8: 127, 32: 1e9}[bits]
    for name, w in full.weights.items():
        assert m.weights[name].shape == w.shape
        assert np.abs(m.weights[name] - w).max() <= np.abs(w).max() / step * 0.51 + 2e-3
    path = tmp_path / modelfile.file_name("x", "int4")
    path.write_bytes(data)
    for source in (data, str(path), path, open(path, "rb")):
        assert modelfile.load(source).header["vocab"] == m.header["vocab"]
    with pytest.raises(TypeError):
        modelfile.load(3)
    with pytest.raises(ValueError):
        modelfile.parse(b"XXXX" + data)
    assert modelfile.manifest({"a": data})[0]["bytes"] == len(data)


def test_padding_does_not_matter(tok):
    t = tagger.Tagger(modelfile.parse(models.seeded_model(tok, 32)))
    ids = [t.tokenizer.encode(x)[0] for x in TEXTS if x]
    for one, many in zip((t.logits([x])[0] for x in ids), t.logits(ids)):
        assert np.allclose(one, many, atol=1e-4)


def test_words_of_a_sentence(tok):
    t = tagger.Tagger(modelfile.parse(models.seeded_model(tok, 4)))
    assert [w["word"].strip() for w in t.words([TEXTS[2]])[0]] == ["Le", "porte-monnaie", "d'Anna", "s'il", "vous", "plaît"]
    assert t.words(["", "  ...  !!  "]) == [[], []]


def test_titles(spark, tok):
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)] + [("n", None)], "id string, text string")
    model = models.seeded_model(tok, 4)
    got = {r.id: r.title for r in tagger.titles(d, model).collect()}
    assert got["0"] == got["1"] == got["n"] == ""
    assert got["4"] == "a b c"
    assert len(tagger.titles(d, model, budget=2).where("id = '2'").first().title.split()) == 2


def test_tokenizer_file():
    vocab = {"<pad>": 0, "<unk>": 1} | {bpe._stand_in(b): 2 + b for b in range(256)} | {"ab": 258}
    text = json.dumps({"added_tokens": [1, 2], "model": {"vocab": vocab, "merges": ["a b"]}})
    assert bpe.Tokenizer.from_json(text).encode("abc")[0] == [258, 2 + ord("c")]
    with pytest.raises(ValueError):
        bpe.Tokenizer.from_json(text.replace("258", "400"))


def test_teacher(spark, tmp_path):
    tries = []

    def flaky(url, body, timeout):
        tries.append(url)
        if len(tries) < 3:
            raise OSError("down")
        return {"choices": [{"message": {"content": "x"}}]}

    assert teacher.call("http://a", "m", "s", "t", transport=flaky, wait=lambda s: None) == "x" and len(tries) == 3

    def server(url, body, timeout):
        text = body["messages"][1]["content"]
        if "fail" in text:
            raise OSError("down")
        return {"choices": [{"message": {"content": f'<think>hm</think>"{text[:9]}."'}}]}

    d = spark.createDataFrame([("1", "some words here"), ("2", "fail please")], "id string, text string")
    make = lambda m: teacher.ask(m, ["a@http://a", "b@http://b"], "m", "s", transport=server, wait=lambda s: None)
    path = str(tmp_path / "titles")
    assert teacher.append_titles(spark, d, path, make) == 2
    assert teacher.append_titles(spark, d, path, make) == 0
    got = {r.id: r for r in spark.read.json(path).collect()}
    assert got["1"].title == "some word" and got["2"].error.startswith("OSError")


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("é", 1), ("b|c", None)], "a string, b int")
    path = str(tmp_path / "x")
    sinks.write_jsonl(d, path)
    with pytest.raises(Exception):
        sinks.write_jsonl(d, path)
    assert tables.jsonl(spark, path, "a string, b int").count() == 2
    table = sinks.markdown(d)
    assert "b\\|c" in table and "—" in table
    assert sinks.replace_table("x\n| h |\n|---|\n| 1 |\ny", "| h", "| n |\n|---|") == "x\n| n |\n|---|\ny"
    assert json.loads(sinks.statistics(d.groupBy().count())) == {"count": 2}


def test_questions(spark):
    d = spark.createDataFrame([("s", "what is this", []), (None, None, [("how does it work",), ("too short",)])], tables.PAGES)
    assert sorted((r.site, r.text) for r in tables.questions(d).collect()) == [("?", "how does it work"), ("s", "what is this")]


def test_stream(spark, tmp_path, tok):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.txt").write_text("one two three four five six\n\nb c\n")
    for _ in range(2):  # the second run finds nothing new
        streams.titles_stream(streams.lines(spark, str(src)), models.seeded_model(tok, 4), out, str(tmp_path / "check")).awaitTermination(60)
    rows = spark.read.schema("id string, text string, title string").json(out).collect()
    assert len(rows) == 3 and {r.title for r in rows if r.text == "b c"} == {"b c"}
    assert decode.DECODING["min_words"] == 3
