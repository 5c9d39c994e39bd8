"""The ten operators on small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing
columns, against brute force; and the registered queries on the smallest tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as tok
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, chat_format, decontaminate, jaccard_join, language_id, quality, suffix_dedup, token_files, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, head string"


def rows_of(texts, first=0):
    return [(first + i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]


def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["tion", "ther", "and", "in", "out", "ble"]) + rng.choice(["", "er", "ing", "s"]) + str(rng.randrange(900)) for _ in range(n))


EDGE = [None, "", " \n ", "a b", "A  B", "one two three four five", "x", "é ñ 日本 🙂", "%%% ***", "a\x00b"]


def test_url_filter_edges(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.NET/en/x?q#f", "h"), (2, None, "h"), (3, "no scheme", "h"), (4, "https://x.net", "h"), (5, "https://spam-farm.io/", "h"), (6, "https://q.org/fr/a/../b", "h"), (None, "ftp://a.com/x.exe", "h"), (8, "http://a.com/q.net/z", "h")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("x.net", "", None, "allow") and got[5][3] == "block" and got[6][2:] == ("org/fr/", "allow")
    assert got[None][3] == "block" and got[8][2:] == (None, "allow")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_automaton_against_regular_expressions():
    import re

    globs = ["a*b", "**x?y", "*.net/**", "?", "ab**", "*" * 2 + "q" * 70 + "*"]
    patterns = [re.compile(url_filter._sql_glob(g), re.S) for g in globs]
    rng = random.Random(3)
    texts = ["".join(rng.choice("abxy/.netq") for _ in range(rng.randrange(12))) for _ in range(500)] + ["z" + "q" * 71]
    got = url_filter.GlobAutomaton(globs).match([t.encode() for t in texts])
    assert [[bool(p.fullmatch(t)) for p in patterns] for t in texts] == got.tolist()


def sets_of(texts):
    import re

    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute_components(texts):
    s, n = sets_of(texts), len(texts)
    root, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            k = len(s[i] & s[j])
            if s[i] and 100 * k >= 80 * len(s[i] | s[j]) and k:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return [(i, len(s[i]), root[i], links[i]) for i in range(n)]


def test_sketch_never_counts_less(spark):
    texts = [prose(i % 7, 40) + " " + prose(100 + i, 20) for i in range(40)] + [prose(3, 40)] * 3 + EDGE
    counts = jaccard_join.sketch(docs(spark, texts).repartition(3))
    true: collections.Counter = collections.Counter()
    for chunk in jaccard_join.chunks([t.encode() for t in {x or "" for x in texts}]):
        g, _ = jaccard_join.shingles(chunk)
        true.update(g.tolist())
    g = np.array(list(true), np.uint64)
    assert (jaccard_join.counted(counts, g) >= np.minimum(list(true.values()), jaccard_join.MOST)).all()
    slots = np.sort(np.random.default_rng(1).integers(0, 1 << 16, 3000))
    assert jaccard_join.unpack_slots(jaccard_join.pack_slots(slots)).tolist() == slots.tolist()


@pytest.mark.parametrize("most", [15, 2])
def test_jaccard_join_is_exact(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "MOST", most)  # 2: all shared shingles count as equally frequent
    monkeypatch.setattr(jaccard_join, "SMALL_SIDE", 0 if most == 2 else 500_000)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
    rng, texts = random.Random(1), list(EDGE)
    for seed in range(6):
        base = prose(seed, 60).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
            texts.append(" ".join(w))
    texts += [prose(50, 30)] * 5 + ["shared line of seven words goes here " + prose(100 + i, 3) for i in range(20)]
    got = sorted(tuple(r) for r in jaccard_join.join(docs(spark, texts)).collect())
    assert got == brute_components(texts)


def test_jaccard_join_empty_table_and_null_ids(spark):
    assert jaccard_join.join(docs(spark, []).limit(0) if False else spark.createDataFrame([], DOCS)).count() == 0
    d = spark.createDataFrame([(None, "a b c", "", "", 0, "", ""), (5, "A B C", "", "", 0, "", ""), (5, "z", "", "", 0, "", "")], DOCS)
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in jaccard_join.join(d).collect())
    assert got == [(-1, 5), (5, 5), (5, 5)]


def brute_spans(texts, n):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for k, r in enumerate(raws):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((k, len(r), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("often", [32, 1])
def test_suffix_dedup_is_exact(spark, monkeypatch, often):
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)  # 1: every repeated inner rank takes the path of frequent ones
    monkeypatch.setattr(suffix_dedup, "HELD", 50)
    passage, edge400, edge399 = prose(7, 70), prose(8, 90)[:400], prose(9, 90)[:399]
    texts = [*EDGE, prose(1, 40) + passage + prose(2, 30), prose(3, 50) + passage, prose(4, 90), prose(4, 90), "x" + edge400 + "y", "z" + edge400 + "w", "x" + edge399 + "y", "z" + edge399 + "w"]
    texts += ["For " * 400, passage[10:], "é" * 300, "b" + "é" * 300]
    near = prose(11, 150).split()
    for i in range(8):
        w = list(near)
        w[i * 15 + 5] = "edit" + str(i)
        texts.append(" ".join(w))
    got = sorted(tuple(r) for r in suffix_dedup.spans(docs(spark, texts)).collect())
    assert got == brute_spans(texts, 400)


def morse_texts():
    """Two texts that share no string of 400 bytes, but whose polynomial hashes modulo 2**64 are equal for any base."""
    rng = random.Random(12)
    context = ["".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(3)) for _ in range(1024)]
    odd = [bin(i).count("1") % 2 for i in range(1024)]
    return ["".join(c + letters[o] for c, o in zip(context, odd, strict=True)) for letters in ("xy", "yx")]


def test_equal_polynomial_hashes_are_told_apart(spark, tmp_path):
    texts = morse_texts()
    d = docs(spark, texts + [" \n".join(texts)])
    d = d.where("doc_id < 2")
    assert [tuple(r)[2:4] for r in suffix_dedup.spans(d).collect()] == [(0, 0)] * 2
    assert sorted(r["component_id"] for r in jaccard_join.join(d).collect()) == [0, 1]
    bytes_library, words_library = (Tokenizer.from_file(tok.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe.round_trip(d, tok.path("byte_bpe_50k.json"), tok.PATTERN).collect()}
    token_files.write(d, str(tmp_path / "f"), tok.path("word_bpe_49k.json"), 2)
    crc = {r["doc_id"]: r["ids_crc32"] for r in token_files.summary(spark, str(tmp_path / "f")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == hashlib.sha256(",".join(map(str, bytes_library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()
        assert crc[i] == zlib.crc32(np.array([*words_library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    lines = docs(spark, ["\n".join(texts) + "\n" + texts[0]])
    assert [r["n_dup_lines"] for r in quality.judge(lines, quality.fit(lines, spark.createDataFrame([], "doc_id long, quality int"))).collect()] == [1]


def test_exact_numbers_of_strings_that_share_a_hash(monkeypatch):
    from tidemark.llm import _kernels

    rng = random.Random(3)
    parts = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 7, 8, 9, 17, 300]))) for _ in range(400)]
    end = np.cumsum([len(x) for x in parts])
    start = end - [len(x) for x in parts]
    strings = _kernels.Strings(np.frombuffer("".join(parts).encode(), np.uint8))
    for hashed in (strings.hash, lambda a, b: (b - a).astype(np.uint64) % np.uint64(3)):
        monkeypatch.setattr(strings, "hash", hashed)
        number, first = strings.ids(start, end)
        assert len({(n, x) for n, x in zip(number.tolist(), parts, strict=True)}) == len(set(parts)) == len(set(number.tolist()))
        assert all(number[k] == i for i, k in enumerate(first.tolist()))


def test_suffix_dedup_keeps_columns(spark):
    passage = prose(7, 70)
    d = docs(spark, [passage + " left one", passage + " left two", passage, "clean"])
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicated(d).collect()}
    assert set(got) == {0, 1, 3} and got[3]["text"] == "clean" and got[0].asDict().keys() == set(d.columns)
    assert suffix_dedup.deduplicated(spark.createDataFrame([], DOCS)).count() == 0


def test_bpe_round_trip_equals_the_library(spark):
    texts = [*EDGE, "it's DON'T we'll  \t\n x", "<|endoftext|> a <|endoftext|>b", "aaaaaaaaaaa bbb", prose(3, 3000), "word" * 3000, "12345 6 ½ \r\n\r\nb "]
    library = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip(docs(spark, texts), tok.path("byte_bpe_50k.json"), tok.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_white_space_of_all_kinds_equals_the_library():
    rng = random.Random(6)
    blanks = [" ", "  ", "\t", "\n", "\r\n", *map(chr, [0x0B, 0x0C, 0x1C, 0x1F, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x180E, 0xFEFF])]
    texts = ["a \xa0 \xa0 b", "\xa0 x", " \xa0", "\u3000 \n\u3000 y", "\x0b b", "", "é à x"]
    texts += ["".join(rng.choice(blanks[: 5 + 17 * (k % 2)] + ["\xa0", " ", "a", "été", "9", "!", "日本", "à"]) for _ in range(40)) for k in range(400)]
    library = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    encoder = bpe.Remembering(bpe.ByteBpe(tok.path("byte_bpe_50k.json"), tok.PATTERN).encode)
    got = []
    for chunk in bpe.chunks([t.encode() for t in texts], 3000):
        ids, n = encoder.ids(chunk)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_equal_the_library(spark, tmp_path):
    texts = [*EDGE, "Don't STOP, été; naïve İstanbul o'clock 's <|endoftext|>x", prose(3, 2000), "é combined", "ΣΑΣ"]
    library = Tokenizer.from_file(tok.path("word_bpe_49k.json"))
    token_files.write(docs(spark, texts), str(tmp_path / "f"), tok.path("word_bpe_49k.json"), 2)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.summary(spark, str(tmp_path / "f")).collect()}
    before = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)


def test_variable_length_codes():
    x = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], np.uint64)
    raw = token_files.code(x)
    back, at = token_files.decode(raw, 0)
    assert back.tolist() == x.tolist() and at == len(raw)
    with pytest.raises(ValueError):
        token_files.unpack(b"none")


def test_language_id(spark):
    words = {"en": ["the", "and", "with", "this", "that"], "fr": ["les", "des", "avec", "être", "quel"]}
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(words[lang], k=20)), lang, "s", 0, "", "") for i in range(80) for lang in [("en", "fr")[i % 2]]]
    train = spark.createDataFrame(rows, DOCS)
    profiles = language_id.train(train)
    got = {r["doc_id"]: (r["lang_pred"], r["held_out"]) for r in language_id.predict(train, profiles).collect()}
    assert all(got[i][0] == ("en", "fr")[i % 2] and got[i][1] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(80))
    edge = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs(spark, EDGE), profiles).collect()}
    assert edge[0] == edge[1] == edge[8] == ("und", 0.0) and all(0 <= s <= 1 for _, s in edge.values())
    nothing = language_id.train(spark.createDataFrame([], DOCS))
    assert {r["lang_pred"] for r in language_id.predict(train, nothing).collect()} == {"und"}


def test_long_text_profile_counts_every_piece(monkeypatch):
    text = prose(5, 400)
    (_, _, _, gram, n), *_ = language_id.gram_counts([text])
    monkeypatch.setattr(language_id, "LETTERS", 100)
    (_, _, _, gram2, n2), *_ = language_id.gram_counts([text])
    whole, cut = dict(zip(gram.tolist(), n.tolist(), strict=True)), dict(zip(gram2.tolist(), n2.tolist(), strict=True))
    assert whole == cut


def test_quality_base_counts(spark):
    texts = [*EDGE, "a b c d e f g h " * 6, "line one\nline one\n\n\nline  one\nline one", " ".join(f"w{i}" for i in range(40)), "#*$ %&|<>"]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(12, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(d, quality.fit(d, labels)).collect()}
    import re

    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, texts[i]
        assert r["base_failed"] == (len(w) < 20 or 100 * len(rep) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_toxicity_learns_and_survives_edges(spark):
    rng, texts, labels = random.Random(2), [], []
    for i in range(400):
        w = prose(i, 60).split()
        if i % 4 == 0:
            for _ in range(6):
                w[rng.randrange(60)] = rng.choice(["idiot", "moron", "scum"])
        texts.append(" ".join(w))
        labels.append((i, 1, int(i % 4 == 0)))
    d = docs(spark, [*texts, *EDGE])
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(d, toxicity.fit(d, known)).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 410
    none = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(d, none).count() == 410


def test_toxicity_model_equals_brute_force(spark):
    rng, texts = random.Random(8), []
    common, bad = [f"w{i}" for i in range(40)], ["scum", "vile"]
    for i in range(300):
        w = rng.choices(common, k=25)
        if i % 3 == 0:
            w[4:6] = ["w1", "w2"]  # a pair that only one class has often
            w[rng.randrange(6, 25)] = rng.choice(bad)
        texts.append(" ".join(w))
    toxic = [int(i % 3 == 0) for i in range(300)]
    model = toxicity.fit(docs(spark, texts), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))

    train = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 > 1]
    seqs = {i: ["<s>", *texts[i].split()] for i in train}
    word = [collections.Counter(w for i in train if toxic[i] == c for w in set(seqs[i][1:])) for c in (0, 1)]
    pair = [collections.Counter(p for i in train if toxic[i] == c for p in set(zip(seqs[i], seqs[i][1:], strict=False))) for c in (0, 1)]
    share = sum(len(texts[i]) for i in train if toxic[i]) / sum(len(texts[i]) for i in train)

    def evidence(n0, n1):
        n = n0 + n1
        return (n1 * np.log(n1 / (n * share)) if n1 else 0) + (n0 * np.log(n0 / (n * (1 - share))) if n0 else 0)

    def weight(g):
        return 1 / (1 + np.exp(toxicity.PRIOR - g))

    def d(counts):
        one, two = (sum(v == k for v in counts) for k in (1, 2))
        return one / (one + 2 * two) if one else 0.5

    before = [collections.Counter(w for _, w in pair[c]) for c in (0, 1)]
    kinds = [sum(b.values()) for b in before]

    def low(c, w):
        s = (before[0][w] + before[1][w]) / sum(kinds)
        p = max(before[c][w] - d(before[c].values()), 0) / kinds[c] + d(before[c].values()) * len(before[c]) / kinds[c] * s
        t = weight(evidence(word[0][w], word[1][w]))
        return t * p + (1 - t) * s

    def log(c, u, w):
        after = {p: n for p, n in pair[c].items() if p[0] == u}
        if not after:
            return np.log(low(c, w))
        n, rate = sum(after.values()), d(pair[c].values())
        t = weight(evidence(pair[0][u, w], pair[1][u, w]))
        return np.log(t * (max(pair[c][u, w] - rate, 0) / n + min(rate * len(after) / n, 1) * low(c, w)) + (1 - t) * low(c, w))

    seen = set()
    for i in train[:60]:
        h, u, doc = toxicity.pairs(next(toxicity.chunks([texts[i].encode()])))
        total = 0.0
        for (a, b), x in zip(zip(seqs[i], seqs[i][1:], strict=False), model.difference(h, u).tolist(), strict=True):
            on = evidence(pair[0][a, b], pair[1][a, b]) >= toxicity.PRIOR
            want = log(1, a, b) - log(0, a, b) if on else np.log(low(1, b) / low(0, b)) if evidence(word[0][b], word[1][b]) >= toxicity.LEAST else 0
            seen.add((on, want != 0))
            total += want
            assert abs(x - want) < 1e-9
        assert abs(model.mean(next(toxicity.chunks([texts[i].encode()])))[0] - total / len(doc)) < 1e-9
    assert seen == {(True, True), (False, True), (False, False)}


def test_toxicity_scores_differ_and_models_have_a_limit(spark):
    rng, texts = random.Random(4), []
    for i in range(400):
        w = rng.choices([f"w{k}" for k in range(80)], k=30)
        if i % 4 == 0:
            w[rng.randrange(30)] = "scum"
        texts.append(" ".join(w))
    d, known = docs(spark, texts), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    plain = [r["score"] for r in toxicity.score(d, toxicity.fit(d, known)).collect() if r["held_out"] and r["doc_id"] % 4]
    assert len(set(plain)) > 0.5 * len(plain)
    with pytest.raises(ValueError, match="too large to broadcast"):
        toxicity.fit(d, known, limit=3)


def test_toxicity_keeps_words_apart_that_share_17_bits(spark):
    many = [f"w{i}" for i in range(1_300_000)]
    h, _, _ = toxicity.pairs(next(toxicity.chunks([" ".join(many).encode()])))
    bad, *common = np.array(many)[np.flatnonzero((h & np.uint64(0x1FFFF)) == (h[0] & np.uint64(0x1FFFF)))][:7].tolist()
    rng, texts = random.Random(3), []
    for i in range(400):
        w = prose(i, 60).split()
        for k, at in enumerate(rng.sample(range(60), 6)):
            w[at] = common[k]
        if i % 4 == 0:
            w.insert(rng.randrange(60), bad)
        texts.append(" ".join(w))
    d = docs(spark, texts)
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = [r for r in toxicity.score(d, toxicity.fit(d, known)).collect() if r["held_out"]]
    score = {c: [r["score"] for r in got if (r["doc_id"] % 4 == 0) == c] for c in (True, False)}
    assert np.mean([x > y for x in score[True] for y in score[False]]) > 0.9


def test_decontamination_recall_and_exactness(spark):
    rng = random.Random(5)
    items = [(i, prose(1000 + i, 30)) for i in range(30)] + [(30, None), (31, "short")]
    texts, planted = [], []
    for i in range(150):
        k = rng.randrange(30)
        x = list(items[k][1])
        for _ in range(rng.randint(0, int(0.06 * len(x)))):
            x[rng.randrange(len(x))] = rng.choice("etaoin")
        texts.append(prose(i, 40) + " " + "".join(x).upper() + "  " + prose(i + 500, 40))
        planted.append((i, k))
    clean = [prose(5000 + i, 80) for i in range(50)]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.matches(docs(spark, texts + clean + EDGE), b).collect()}
    assert np.mean([p in got for p in planted]) >= 0.9
    assert all(d < 150 for d, _ in got)

    def distance(item, text):  # least edits between item and any part of text
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, c in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != c)))
            row = new
        return min(row)

    for (d, k), edits in list(got.items())[:8]:
        assert edits == distance(items[k][1].lower(), " ".join(texts[d].lower().split()))
    assert decontaminate.matches(docs(spark, texts[:3]), b.limit(0)).count() == 0


def edited(rng, text, how):
    """text after edits up to the full limit, of one kind or place."""
    k = min(int(decontaminate.MAX_EDITS * len(text)), (len(text) - decontaminate.Q) // decontaminate.Q)
    x = list(text)
    if how == "run":
        return text[:10] + "#" * k + text[10:]
    if how == "head":
        return text[:3] + text[3 + k :]
    for _ in range(k):
        at = rng.randrange(min(len(x), 100) if how == "near" else len(x))
        kind = rng.choice(["insert", "delete", "replace"])
        x[at : at + (kind != "insert")] = [] if kind == "delete" else [rng.choice("#@%&")]
    return "".join(x)


def test_decontamination_finds_every_edit_up_to_the_limit():
    rng = random.Random(9)
    items = [prose(2000 + i, 400)[:n].strip() for i, n in enumerate([15, 40, 81, 130, 250, 394, 1100] * 6)]
    texts, want = [], set()
    for how in ("even", "near", "run", "head"):
        for k, item in enumerate(items):
            want.add((len(texts), k))
            texts.append(prose(len(texts), 20) + " " + edited(rng, item, how) + " " + prose(len(texts) + 900, 20))
    matcher = decontaminate.Matcher(list(enumerate(items)) + [(99, items[0])])
    got = {(d, matcher.ids[i]): edits for d, i, edits, _ in matcher.find([t.encode() for t in texts])}
    assert want <= set(got)
    assert all((d, 99) in got for d, k in got if k == 0)


@pytest.mark.parametrize("shared", [50, 0])
def test_decontamination_equals_brute_force(monkeypatch, shared):
    monkeypatch.setattr(decontaminate, "SHARED", shared, raising=False)  # 0: items leave out as many grams as they may
    monkeypatch.setattr(decontaminate, "HITS", 100, raising=False)
    rng = random.Random(4)
    items = ["the same start of many items " + prose(3000 + i, 6) for i in range(12)]
    texts = [prose(i, 5) + edited(rng, rng.choice(items), rng.choice(["even", "near"])) + prose(i + 50, 5) + edited(rng, rng.choice(items), "even") for i in range(60)]

    def distance(item, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, c in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != c)))
            row = new
        return min(row)

    limit = [min(int(0.08 * len(x)), (len(x) - 10) // 10) for x in items]
    want = {(d, i, e) for d, t in enumerate(texts) for i, x in enumerate(items) if (e := distance(x, t)) <= limit[i]}
    matcher = decontaminate.Matcher(list(enumerate(items)))
    assert {x[:3] for x in matcher.find([t.encode() for t in texts])} == want


def test_decontamination_recall_in_running_text_and_on_long_items():
    """At the edit limit: items of a script without blanks in running text, and long items with edits near their start or even."""
    rng = random.Random(21)
    signs = [chr(c) for c in range(0x4E00, 0x4F00)]
    running = lambda n: "".join(rng.choice(signs) for _ in range(n))
    items = [running(rng.randrange(30, 200)) for _ in range(20)] + [prose(4000 + i, 120)[:670].strip() for i in range(20)] + [prose(4100 + i, 900)[:5000].strip() for i in range(4)]
    texts, want = [], set()
    for k, item in enumerate(items):
        for how in ("none", "near", "even"):
            size = min(int(0.08 * len(item.encode())), (len(item.encode()) - 10) // 10)
            x = list(item)
            for _ in range(0 if how == "none" else size // (3 if k < 20 else 1)):
                at = rng.randrange(min(len(x), 40 if k < 20 else 120) if how == "near" else len(x))
                x[at] = rng.choice(signs if k < 20 else list("#@%&"))
            want.add((len(texts), k))
            texts.append(running(99) + "".join(x) + running(99) if k < 20 else prose(k, 50) + "".join(x) + prose(k + 1, 50))
    matcher = decontaminate.Matcher(list(enumerate(items)))
    got = {(d, matcher.ids[i]) for d, i, _, _ in matcher.find([t.encode() for t in texts])}
    for of in (range(60), range(60, 120), range(120, 132)):
        mine = {p for p in want if p[0] in of}
        assert len(mine & got) >= 0.9 * len(mine)
    assert got <= want


def test_latin_folding_equals_unicode():
    import unicodedata

    for c in range(0x100):
        for text in (chr(c), "a" + chr(c) + "é"):
            want = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).casefold()).encode()
            raw = np.frombuffer(decontaminate.folded(text.encode()), np.uint8)
            assert decontaminate.normalised(decontaminate.latin(raw))[0].tobytes() == bytes(want.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")))


def test_decontamination_ignores_unicode_case():
    import unicodedata

    item = "L'été à Orléans, où l'élève étudiait déjà la géométrie, a été très gênant; après ça, l'évêque hésita: ÉÈÊ çà et là, ПРИВЕТ."
    texts = ["so: " + item.upper() + " end", "so: " + unicodedata.normalize("NFD", item) + " end", "Straße " + item.title() + " \N{GRINNING FACE}", "ascii only"]
    raws = [t.encode() for t in texts] + [b"\xff\xfe " + item.encode() + b" \xed\xa0\x80"]
    matcher = decontaminate.Matcher([(7, item)])
    assert [x[:3] for x in matcher.find(raws)] == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (4, 0, 0)]


def test_decontamination_of_short_items_and_unspaced_runs():
    items = [(1, "日本"), (2, "Tiny"), (3, "東京都は日本の首都であり世界最大級の都市の一つである"), (4, " ")]
    texts = ["それで、" * 9 + items[2][1] + "。" * 5, "a TINY one", "x" * 99 + "tiny", "tin y", ""]
    for chosen, want in ((items, {(0, 1), (0, 3), (1, 2), (2, 2)}), (items[:2], {(0, 1), (1, 2), (2, 2)})):
        matcher = decontaminate.Matcher(chosen)
        assert {(d, matcher.ids[i]) for d, i, _, _ in matcher.find([t.encode() for t in texts])} == want


def test_chat_roles_and_blocks(spark, monkeypatch):
    rows = [(c, t, ("user", "assistant")[t % 2] if (c + t) % 5 else None, f"turn {t} of {c}" + ("?" if t % 2 == 0 else " is a longer answer\nwith lines")) for c in range(20) for t in range(9)]
    rows += [(None, None, None, None), (99, 0, "robot", "User: hello\nAssistant: hi\nthere"), (99, 0, "robot", "User: hello\nAssistant: hi\nthere")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash"))
    model = chat_format.fit(conv)
    got = chat_format.parse(conv, model).collect()
    assert len(got) == len(rows)
    assert all(r["role"] == ("user", "assistant")[r["turn"] % 2] for r in got if r["conv_id"] is not None and r["conv_id"] < 99)
    odd = [r for r in got if r["conv_id"] == 99]
    assert odd[0]["rendered"] == "<|user|>\nhello\n<|end|>\n<|assistant|>\nhi\nthere\n<|end|>\n"
    monkeypatch.setattr(chat_format, "BLOCK", 2)
    again = chat_format.parse(conv, model).collect()
    key = lambda r: (r["conv_id"] or -1, r["turn"] or -1, r["rendered"])
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert chat_format.parse(conv.limit(0), model).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf).persist()
        assert out.columns == d.columns and 0 < out.count() <= d.count()
        d = out
    assert corpus_pipeline.STAGES[-1][1](spark, d, sf).count() == d.count()
