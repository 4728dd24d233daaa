import hashlib
import random
import re
import struct

import numpy as np
import pytest

from spillway.llm import passages, queries, secrets, sentencepiece, tokens
from spillway.llm.common import Vocabulary

from . import helpers

NASTY = ["", " ", "  ", "a", " a", "a  b", "   a▁b ▁", "x\ny\t\tz", "<s>hi</s> <unk> <0x41>", "日本語 のテキスト", "🙂🙂 ok", "é" * 50, "a" * 3000, " " * 40 + "x", "null\x00in", "İ secret=abcdefgh1"]


def nasty(n=400, seed=0):
    rng = random.Random(seed)
    return NASTY + ["".join(rng.choice(" ▁abcthe\n\t<s>éß日🙂\u0301") for _ in range(rng.randint(1, 40))) for _ in range(n)]


# ---- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [s for _, _, s in sorted(out)]


def test_secrets_are_those_of_brute_force(spark):
    rng = random.Random(1)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", ":", "=", '"', " ", "abcdefgh", "x1_/+", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "f", "é", "İ", "\u017f", "\u212a", "toKen", "\n", "tokentoken=", "secret=secret=secret1"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))) for k in range(1500)] + [(9000, None), (9001, ""), (None, "token=abcdefgh")]
    out = {r["doc_id"]: r for r in secrets.secrets(spark, spark.createDataFrame(rows, helpers.SCHEMA)).collect()}
    assert len(out) == len(rows)
    for key, text in rows:
        want, got = base_spans(text or ""), out[key]
        assert [s for s in got["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")] == want, text
        assert got["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (got["n_assign"], got["n_access"], got["n_hex"]) == tuple(sum(s.startswith(k) for s in want) for k in ("assign:", "access:", "hex:"))


def test_checksums():
    body = "abcdefghij" * 3
    good = "ghp_" + body + secrets.checksum62(body)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    keywords = secrets.automaton()
    assert [h[2] for h in secrets.scan(f"x {good} y {bad}", keywords)] == ["github"]
    header = "eyJhbGciOiJIUzI1NiJ9"
    assert [h[2] for h in secrets.scan(f"{header}.abc.def eyJ!!.a.b eyJxxxx.abc.def", keywords)] == ["jwt"]
    assert [h[2] for h in secrets.scan("-----BEGIN RSA PRIVATE KEY-----", keywords)] == ["pem"]


# ---- subword models

@pytest.fixture(scope="module")
def reference():
    import sentencepiece as library

    return library.SentencePieceProcessor(model_file=queries.PIECES)


def test_parity_with_the_reference_implementation(reference, spark, sf_dir):
    texts = nasty() + [r["text"] for r in queries.table(spark, sf_dir, "documents").select("text").collect()]
    codec = sentencepiece.Codec(sentencepiece.read_model(queries.PIECES))
    ids, _, same = codec.encode_block(texts)
    want = reference.encode(texts)
    assert [k.tolist() for k in ids] == want
    assert [codec.decode(k) for k in ids] == [reference.decode(w) for w in want]
    assert codec.cut and all(s or "▁" in t for s, t in zip(same, texts, strict=True))
    assert [codec.whole.encode(t, add_special_tokens=False).ids if t else [] for t in texts] == want
    codec.forget()
    again, _, _ = codec.encode_block(texts[::-1])
    assert [k.tolist() for k in again[::-1]] == want


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model():
    """A unigram model with byte fallback, put together field by field."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]
    pieces += [(p, -1.0 - k / 7, 1) for k, p in enumerate(["▁", "▁th", "e", "▁the", "h", "t", "he", "▁a", "a", "b", "ab", "▁ab", "c", "bc", "s", "<", ">"])]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    out += field(2, field(3, 1) + field(35, 1) + field(40, 0) + field(41, 1) + field(42, 2) + field(43, (1 << 64) - 1))
    return out + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))


def test_unigram_parity():
    import sentencepiece as library

    content = unigram_model()
    model = sentencepiece.parse_model(content)
    assert model.unigram and model.byte_fallback and model.strip_spaces
    other = library.SentencePieceProcessor(model_proto=content)
    rng = random.Random(4)
    texts = ["the cab", "  a  b ", "", "é the", "thebc abab"] + ["".join(rng.choice("theabc s é") for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    codec = sentencepiece.Codec(model)
    ids, _, _ = codec.encode_block(texts)
    want = other.encode(texts)
    # segmentations of equal score may differ; texts and scores may not
    score = lambda k: round(sum(model.pieces[i].score for i in k), 4)
    assert [codec.decode(k) for k in ids] == [other.decode(w) for w in want]
    assert [score(k) for k in ids] == [score(w) for w in want]


def test_encode_and_decode(spark):
    rows = [*enumerate(nasty(60)), (None, "hello"), (500, None)]
    docs = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id bigint, text string, ids string")
    out = sentencepiece.encode(spark, docs, queries.PIECES)
    back = {r["doc_id"]: r["text"] for r in sentencepiece.decode(spark, out, queries.PIECES).collect()}
    for key, text in rows:
        assert back[key] == (text or "").replace("▁", " ")
    assert sentencepiece.encode(spark, docs.limit(0), queries.PIECES).count() == 0


def brute_count(word, pieces):
    best = [(0.0, 0)] + [None] * len(word)
    for stop in range(1, len(word) + 1):
        size = len(word[stop - 1].encode())
        options = [(best[stop - 1][0] + size * pieces.byte_score, -best[stop - 1][1] - size)]
        for start in range(stop):
            if word[start:stop] in pieces.scores:
                options.append((best[start][0] + pieces.scores[word[start:stop]], -best[start][1] - 1))
        score, fewest = max(options)
        best[stop] = (score, -fewest)
    return best[-1][1]


def test_token_counts(spark):
    pieces = tokens.pieces_of(sentencepiece.read_model(queries.PIECES))
    rows = [*enumerate(nasty(200)), (None, "the end"), (700, None)]
    out = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in tokens.token_counts(spark, spark.createDataFrame(rows, helpers.SCHEMA), queries.PIECES, limit=500).collect()}
    for key, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        if len(text or "") < 1000:
            assert out[key] == (len(words), sum(brute_count("▁" + w, pieces) for w in words)), text


def test_counter_memo_changes_nothing(monkeypatch):
    pieces = tokens.pieces_of(sentencepiece.read_model(queries.PIECES))
    words = sorted({w.encode() for t in nasty(200) for w in t.split()})
    want = tokens.Counter(pieces).counts(words)
    monkeypatch.setattr(tokens, "MEMO", 10)
    small = tokens.Counter(pieces)
    assert (np.concatenate([small.counts(words[k : k + 7]) for k in range(0, len(words), 7)]) == want).all()
    assert len(small.memo) < 30


# ---- passages

def brute_passages(rows, least=10):
    spots = {}
    for key, text in rows:
        at = 0
        for par, line in enumerate((text or "").split("\n")):
            if len(line.encode().split()) >= least:
                spots[(key, par)] = (helpers.shingles(line), at, at + len(line))
            at += len(line) + 1
    near = helpers.components(spots, [(a, b) for a in spots for b in spots if a < b and 100 * len(spots[a][0] & spots[b][0]) >= 75 * len(spots[a][0] | spots[b][0])])
    size = {}
    for c in near.values():
        size[c] = size.get(c, 0) + 1
    return sorted((k, p, spots[k, p][1], spots[k, p][2], *c, size[c], (k, p) != c) for (k, p), c in near.items() if size[c] > 1)


def test_passages_are_those_of_brute_force(spark):
    rng = random.Random(8)
    common = [helpers.prose(rng, rng.randrange(12, 120)) for _ in range(8)]
    rows = []
    for k in range(60):
        lines = [helpers.prose(rng, rng.randrange(0, 50)) + rng.choice(["", " é🙂"]) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.5:
            lines.insert(rng.randrange(len(lines) + 1), helpers.edited(rng, rng.choice(common), rng.randrange(0, 3)))
        rows.append((k, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n" + common[0].upper()), (103, common[1] + "\n" + common[1])]
    docs = spark.createDataFrame(rows, helpers.SCHEMA)
    out = passages.repeated_passages(spark, docs).drop("n_words")
    assert sorted(map(tuple, out.collect())) == brute_passages(rows)
    clean = {r["doc_id"]: r["text"] for r in passages.remove_repeats(spark, docs.selectExpr("doc_id", "text", "1 as par")).collect()}
    assert clean[103] == "" or clean[103] == common[1]
    assert clean[100] is None and clean[101] == ""
    assert passages.repeated_passages(spark, docs.limit(0)).count() == 0


def test_vocabulary():
    v = Vocabulary()
    assert v.ids([b"a", b"b", b"a"]).tolist() == [0, 1, 0] and v.words == [b"a", b"b"]
