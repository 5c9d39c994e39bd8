"""Roles from texts alone, rank-order distances by brute force, texts beyond one chunk."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as tok
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, chat_format, language_id
from tidemark.llm._kernels import CHUNK, mix

CONV = "conv_id long, turn long, role string, text string"


def test_roles_of_held_out_conversations_from_texts_alone(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    held = language_id.fold(F.col("conv_id")) == 0
    model = chat_format.fit(conv.where(~held))
    blind = lambda d: sorted((r["conv_id"], r["turn"], r["role"], r["rendered"]) for r in chat_format.parse(d, model, observed=False).collect())
    got = blind(conv)
    assert got == blind(conv.withColumn("role", F.lit("system")))  # what the column says is not seen
    want = {(r["conv_id"], r["turn"]): r["role"] for r in conv.where(held).collect()}
    right = [want[c, t] == role for c, t, role, _ in got if (c, t) in want]
    assert len(right) == len(want) and sum(right) >= 0.9 * len(right)


def test_chat_fit_on_nothing_and_very_long_turns(spark):
    model = chat_format.fit(spark.createDataFrame([], CONV))
    lines = "word " * 40 + "\n"
    long = lines * 15_000 + "User: what?\n" + "Assistant: " + lines * 100
    conv = spark.createDataFrame([(1, 0, "user", long), (1, 1, None, None)], CONV)
    first, second = sorted(chat_format.parse(conv, model).collect(), key=lambda r: r["turn"])
    assert first["n_segments"] == 3 and first["roles"] == ["user", "user", "assistant"]
    assert first["rendered"].count("word") == 40 * 15_100 and second["n_segments"] == 1


def hashed(gram: str) -> int:
    """The number by which a gram is known: ties in a profile go to the smaller one. A blank is 1."""
    code = [1 if x == " " else ord(x) for x in gram]
    packed = sum(c << (21 * (len(code) - 1 - i)) for i, c in enumerate(code))
    return int(mix(np.array([packed], np.uint64))[0] >> np.uint64(20))


def ranks(text: str, top: int) -> dict[int, int]:
    plain = " " + " ".join("".join(x if x.isalpha() else " " for x in text.lower()).split()) + " "
    n = collections.Counter(x for x in plain if x != " ")
    n.update(plain[i : i + 2] for i in range(len(plain) - 1))
    n.update(plain[i : i + 3] for i in range(len(plain) - 2) if plain[i + 1] != " ")
    known = sorted(((-c, hashed(g)) for g, c in n.items()))
    return {g: i for i, (_, g) in enumerate(known[:top])}


def test_language_distance_equals_brute_force():
    rng = random.Random(4)
    letters = {"de": "enistraüß", "en": "etaoinsh", "fr": "esaitnéèu"}
    write = lambda x, n: " ".join("".join(rng.choice(x) for _ in range(rng.randrange(1, 8))) for _ in range(n))
    top = 120
    known = {lang: ranks(write(x, 400), top) for lang, x in letters.items()}
    profiles = {lang: np.array(sorted(r, key=r.get), np.uint64) for lang, r in known.items()}
    texts = [write(x, n) for x in letters.values() for n in (1, 5, 60, 400)] + ["  A1b-c  d ", "été, Été!\nx", "日本 nihon"]
    langs, scores = language_id.Profiles(profiles, top).predict(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        own = ranks(text, top)
        far = {x: sum(abs(r[g] - i) if g in r else top for g, i in own.items()) for x, r in known.items()}
        best = min(sorted(far), key=far.get)
        assert (lang, round(float(score), 12)) == (best, round(1 - far[best] / (top * len(own)), 12)), text


def test_bpe_text_beyond_one_chunk(spark):
    rng = random.Random(9)
    text = " ".join(rng.choice(["the", "naïve", "12345", "don't", "日本", "x" * 30, "\n\n"]) for _ in range(260_000))
    assert len(text.encode()) > 2 * CHUNK
    library = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    ids = library.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = bpe.round_trip(docs, tok.path("byte_bpe_50k.json"), tok.PATTERN).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(text))
    assert zlib.crc32(text.encode()) == zlib.crc32(library.decode(ids, skip_special_tokens=False).encode())
