"""Cases that every operator must handle: empty tables, very long texts, repeated rows, ties, clashing columns; and the SQL of the queries."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as tok
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe, chat_format, decontaminate, jaccard_join, language_id, quality, queries, suffix_dedup, token_files, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, head string, digest string, node string"
LABELS = "doc_id long, quality int, toxic int"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["tion", "ther", "and", "in", "out", "ble"]) + rng.choice(["", "er", "ing", "s"]) + str(rng.randrange(900)) for _ in range(n))


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash", "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], LABELS)
    token_files.write(none, str(tmp_path / "f"), tok.path("word_bpe_49k.json"), 2)
    assert token_files.summary(spark, str(tmp_path / "f")).count() == 0
    assert bpe.round_trip(none, tok.path("byte_bpe_50k.json"), tok.PATTERN).count() == 0
    assert quality.judge(none, quality.fit(none, labels)).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    items = spark.createDataFrame([(1, prose(1, 40))], "item_id long, text string")
    assert decontaminate.matches(none, items).count() == 0
    assert language_id.predict(none, language_id.train(none)).count() == 0
    assert suffix_dedup.spans(none).count() == 0


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(1, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts_and_repeated_rows(spark, tmp_path):
    """A text of some 3 MB beside short ones, each row twice under one id."""
    passage = prose(7, 90)
    long = prose(1, 150_000) + " " + passage + " " + prose(2, 150_000)
    texts = [long, passage + " and an end of its own", "short one", long, passage + " and an end of its own", "short one"]
    d = docs(spark, texts, [0, 1, 2, 0, 1, 2])
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.spans(d).collect())
    assert [x for x in got if x[0] != 2] == [(0, len(long), len(long))] * 2 + [(1, len(texts[1]), len(texts[1]))] * 2
    alone = suffix_dedup.spans(docs(spark, [long, texts[1]])).collect()
    assert [r["n_removed"] for r in sorted(alone, key=lambda r: r["doc_id"])] == [len(passage) + 1, len(passage) + 1]  # a blank follows in both
    link = sorted(tuple(r) for r in jaccard_join.join(d).collect())
    assert [(r[0], r[2], r[3]) for r in link] == [(0, 0, 1), (0, 0, 1), (1, 1, 1), (1, 1, 1), (2, 2, 1), (2, 2, 1)]
    items = spark.createDataFrame([(5, passage), (5, passage)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(d, items).collect()) == [(0, 5)] * 4 + [(1, 5)] * 4
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (1, 0, 1)], LABELS)
    kept = quality.judge(d, quality.fit(d, labels)).collect()
    assert sorted((r["doc_id"], r["n_words"]) for r in kept) == sorted((i, len(t.split())) for i, t in zip([0, 1, 2] * 2, texts, strict=True))
    assert len({(r["doc_id"], r["score"], r["kept"]) for r in kept}) == 3
    assert len({(r["doc_id"], r["score"]) for r in toxicity.score(d, toxicity.fit(d, labels)).collect()}) == 3
    assert len({(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(d, language_id.train(d)).collect()}) == 3
    token_files.write(d, str(tmp_path / "f"), tok.path("word_bpe_49k.json"), 2)
    library = Tokenizer.from_file(tok.path("word_bpe_49k.json"))
    crc = {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(texts[:3])}
    rows = token_files.summary(spark, str(tmp_path / "f")).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in rows) == sorted([*crc.items()] * 2)
    assert sorted(r["start"] for r in rows) == [0, *np.cumsum([r["n_tokens"] for r in sorted(rows, key=lambda r: r["start"])])[:-1].tolist()]


def test_long_urls(spark):
    url = "http://A.example.net/en/" + "x/" * 300_000
    pages = spark.createDataFrame([(1, url, "h", "h"), (1, url, "h", "h")], "page_id long, url string, html string, verdict string")
    assert {(r["rule"], r["verdict"], len(r["path"])) for r in url_filter.judge(pages).collect()} == {("example.net/en/", "allow", 4 + 600_000)}


def test_language_ties_and_clashing_columns(spark):
    same = "one two three four five"
    d = spark.createDataFrame([(i, same, lang, "s", 1, "h", "d", "n") for i, lang in enumerate(["de", "fr"] * 20)], DOCS)
    profiles = language_id.train(d)
    assert {r["lang_pred"] for r in language_id.predict(d, profiles).collect()} == {"de"}  # the first in the alphabet
    kept = language_id.accepted(d, profiles, 0.2)
    assert kept.columns == d.columns and kept.count() == 40
    for _, stage in corpus_pipeline.STAGES[:1]:
        assert stage(spark, d, "").columns == d.columns


def test_pipeline_stages_keep_clashing_columns(spark, sf):
    d = docs(spark, [prose(i % 9, 80) for i in range(12)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf).persist()
        assert out.columns == d.columns
        assert {(r["head"], r["digest"], r["node"]) for r in out.collect()} <= {("clash", "clash", "clash")}
        d = out


def test_viterbi_equals_enumeration(spark, monkeypatch):
    """The best path of a conversation against all paths, also where it is cut into blocks."""
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "robot"]), rng.choice(["why?", "a line\nand one more", "ok", "a longer answer " * 6])) for c in range(40) for t in range(rng.randint(1, 6))]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat_format.fit(conv)
    want = {}
    for c, turns in itertools.groupby(rows, key=lambda r: r[0]):
        turns = list(turns)
        scores, _ = model.scores([(text, role, t == 0) for _, t, role, text in turns])
        paths = itertools.product(range(3), repeat=len(turns))
        best = max(paths, key=lambda p: round(model.start[p[0]] + sum(model.move[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(scores[i, x] for i, x in enumerate(p)), 9))
        want.update({(c, t): chat_format.ROLES[x] for (_, t, _, _), x in zip(turns, best, strict=True)})
    for block, split in ((512, 2048), (2, 2048), (512, 2)):
        monkeypatch.setattr(chat_format, "BLOCK", block)
        monkeypatch.setattr(chat_format, "SPLIT", split)
        assert {(r["conv_id"], r["turn"]): r["role"] for r in chat_format.parse(conv, model).collect()} == want


def test_turns_without_numbers_are_split(spark, monkeypatch):
    rows = [(None, None, ["user", "assistant", None][i % 3], f"text {i % 37}" + "?" * (i % 2)) for i in range(300)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat_format.fit(conv)
    whole = sorted((r["role"], r["rendered"]) for r in chat_format.parse(conv, model).collect())
    monkeypatch.setattr(chat_format, "SPLIT", 20)
    blocks = chat_format._blocks(conv).groupBy("block").count().collect()
    assert len(blocks) > 8 and max(r["count"] for r in blocks) < 100
    assert sorted((r["role"], r["rendered"]) for r in chat_format.parse(conv, model).collect()) == whole


def test_quality_score_equals_brute_force(spark):
    texts = [prose(i, 40 + i) for i in range(30)] + ["", "a b"]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(30)], LABELS)
    ratio = quality.fit(d, labels)

    def buckets(text):
        parts = quality.Text(next(quality.chunks([text.encode()])))
        h = parts.hash
        one = quality.mix(h) & np.uint64(quality.BUCKETS - 1)
        two = [int(quality.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)) % quality.BUCKETS for a, b in zip(h, h[1:], strict=False)]
        return [*one.tolist(), *two]

    with np.errstate(over="ignore"):
        found = [buckets(t) for t in texts]
    raw, target = (collections.Counter(b for i, x in enumerate(found) if i in of for b in x) for of in (range(32), range(0, 30, 3)))
    n, m = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    got = {r["doc_id"]: r for r in quality.judge(d, ratio).collect()}
    for i, x in enumerate(found):
        score = sum(np.log((target[b] + 1) / m) - np.log((raw[b] + 1) / n) for b in x) / max(len(x), 1)
        assert abs(got[i]["score"] - score) < 1e-9
        assert got[i]["kept"] == (not got[i]["base_failed"] and score >= quality.THRESHOLD)


@pytest.mark.parametrize("name", ["op8_url_filter", "op9_jaccard_join"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r[c] for c in columns) for r in queries.queries()[name](spark, sf).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_digest_of_a_cut_character(spark):
    """Where a removed passage ends within a character, its broken bytes go from the text that the pipeline keeps."""
    passage = prose(5, 70)
    d = docs(spark, [passage + "é one", passage + "è two"])
    kept = {r["doc_id"]: r["text"] for r in suffix_dedup.deduplicated(d).collect()}
    assert kept == {0: " one", 1: " two"}
    raw = {r["doc_id"]: r["kept_sha256"] for r in suffix_dedup.spans(d).collect()}
    assert raw[0] == hashlib.sha256("é one".encode()[1:]).hexdigest()


def test_candidates_with_many_diagonals_are_verified(spark, monkeypatch):
    """Items in texts of which they are a rotation many times over, an edited copy among them; also with all windows left out."""
    rng = random.Random(9)
    unit = prose(3, 4)
    item = " ".join([unit] * 6) + " end"
    changed = list(item)
    for at in rng.sample(range(20, len(item) - 20), max(1, int(len(item) * decontaminate.MAX_EDITS) - 2)):
        changed[at] = "#"
    texts = [" ".join([unit] * 40) + " " + "".join(changed) + " " + " ".join([unit] * 40), " ".join([unit] * 80), prose(8, 300), "x " + item]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = lambda: sorted((r["doc_id"], r["edits"]) for r in decontaminate.matches(docs(spark, texts), items).collect())
    want = found()
    assert {d for d, _ in want} >= {0, 3} and (3, 0) in want and 2 not in {d for d, _ in want}
    monkeypatch.setattr(decontaminate, "STARTS", 0)
    assert found() == want
