"""SentencePiece, fill-in-the-middle and the filter audit against the library, brute force and SQL."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import public_tokenizers as tok
import pytest
import sentencepiece

from tidemark.llm import fill_middle, filter_audit, queries, sentencepiece_bpe

DOCS = "doc_id long, text string, lang string, ids array<int>, digest string, part string, rows long"
MODEL = tok.path("piece_bpe_32k.model")
EDGE = [None, "", " ", "   ", "\n", "a", "  a  b ", "▁x ▁ ▁", "q▁▁ ▁z", ");\r\n\t x", "é ñ 日本 🙂", "a\x00b", "<s></s><unk><0x41>", "<P>x<S>", "a<M>b", "ABC DEF", "#1 $2"]


def docs(spark, texts, ids=None, langs=None):
    rows = [(i, t, lang, [7], "clash", "clash", 3) for i, t, lang in zip(ids or range(len(texts)), texts, langs or ["en"] * len(texts), strict=True)]
    return spark.createDataFrame(rows, DOCS)


def mixed(seed, n):
    rng = random.Random(seed)
    parts = ["ab", "a", "b", "the", "ing", " ", "  ", "\n", "==", "-", "7", "é", "日", "🙂", ");\r", "▁", "\t", "lll", "X"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_sentencepiece_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = EDGE + [mixed(i, i % 60) for i in range(400)] + ["a" * n for n in range(1, 40)] + [" " * n for n in range(1, 40)] + ["word " * 200_000, mixed(5, 30_000), "ab" * 3000]
    texts += [mixed(3, 20)] * 3
    ids = [None, *range(1, len(texts))]
    d = docs(spark, texts, ids)
    got = {r["doc_id"]: r for r in sentencepiece_bpe.encode(d, MODEL, decoded=True).collect()}
    for i, t in zip(ids, texts, strict=True):
        want = library.encode(t or "")
        assert got[i]["ids"] == want, t
        assert got[i]["decoded"] == library.decode(want)
    rows = sentencepiece_bpe.digests(sentencepiece_bpe.encode(d, MODEL, decoded=True)).collect()
    want = {i: (len(x := library.encode(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest()) for i, t in zip(ids, texts, strict=True)}
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want
    assert sentencepiece_bpe.encode(d.limit(0), MODEL).count() == 0


def test_sentencepiece_decodes_any_ids(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    lists = [[], [1], [1, 2, 264], [0, 264], [28705, 264], [264, 1, 264], [13, 264]] + [[rng.choice([0, 1, 2, rng.randrange(259, 32000)]) for _ in range(rng.randrange(9))] for _ in range(300)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(None, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in sentencepiece_bpe.decode(rows, MODEL).collect()}
    assert got.pop(None) == ""
    assert got == {i: library.decode(x) for i, x in enumerate(lists)}


def test_merge_rounds_equal_the_heap():
    """Rounds and the library's order of pairs, also where a merge makes a pair of a lower or the same rank."""
    model = sentencepiece_bpe.PieceBpe(MODEL)
    rng = random.Random(7)
    words = [[int(model.symbol[ord(c)]) for c in "".join(rng.choice("▁abeinrst=-") for _ in range(rng.randrange(1, 30)))] for _ in range(3000)]
    ids, n = model.merge(np.array(sum(words, []), np.int64), np.array([len(w) for w in words]))
    end = np.cumsum(n)
    assert [ids[a:b].tolist() for a, b in zip(end - n, end, strict=True)] == [model.by_heap(list(w)) for w in words]


def fim(doc_id, text, seed="1"):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S)
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t, t
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t


@pytest.mark.parametrize("hot", [1000, 3])
def test_fill_middle_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(fill_middle, "HOT", hot)  # 3: no text is dealt out
    monkeypatch.setattr(fill_middle, "MEMBERS", 4)
    texts = EDGE + [mixed(i % 90, i % 70) for i in range(200)] + ["same text, many times"] * 150 + ["word é " * 100_000] * 3 + ["日" * 50_000]
    ids = [None, *range(1, len(texts) - 1), len(texts) - 2]  # the last two share a doc_id
    rows = fill_middle.digests(fill_middle.transform(docs(spark, texts, ids).repartition(5))).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in zip(ids, texts, strict=True):
        *head, out, back = fim(i, t)
        want.append((i, *head, sha(out), sha(back)))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs(spark, [])).count() == 0


def test_elias_fano_selects_every_number():
    rng = random.Random(3)
    lists = [[0], [0, 1], list(range(50)), [0, 10**9], sorted(rng.sample(range(10**6), 500)), [0] + [5] * 3] + [sorted(rng.choices(range(1, 4000), k=rng.randrange(1, 300))) for _ in range(50)]
    for values in lists:
        kept = fill_middle.Boundaries(fill_middle.elias_fano(np.array(values)))
        assert [kept[k] for k in range(len(values))] == values


def test_two_contents_of_one_key_stop_the_job(spark, monkeypatch):
    whole = fill_middle.index
    monkeypatch.setattr(fill_middle, "index", lambda d, shared: whole(d, shared).unionByName(whole(d, shared)))
    with pytest.raises(ValueError, match="one SHA-256"):
        fill_middle.transform(docs(spark, ["a b", "a b"]))


LABELS = "doc_id long, quality int, toxic int"


def audited(rows, labels):
    """Every document through every order."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    masks = []
    for i, t, lang in rows:
        x = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", x)) > 3 * len(x), "D": bool(re.search(r"[#$%&*|]", x)), "E": i is not None and i > first[x]}
        masks.append((lang or "", {k for k, v in fails.items() if v}, (i, "q") in labels, (i, "t") in labels))
    out = []
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        by_filter = dict.fromkeys("ABCDE", 0)
        for o in itertools.permutations("ABCDE"):
            for _, fails, _, _ in mine:
                if fails:
                    by_filter[next(f for f in o if f in fails)] += 1
        for o in itertools.permutations("ABCDE"):
            for k, f in enumerate(o):
                gone = [m for m in mine if f in m[1] and not m[1] & set(o[:k])]
                kept = sum(not m[1] & set(o[: k + 1]) for m in mine)
                redundant = sum(f in m[1] and bool(m[1] & set(o[:k])) for m in mine)
                out.append((part, "".join(o), k + 1, kept, len(gone), redundant, sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone), by_filter[f]))
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["w", "W", "v#", ""]) + str(rng.randrange(rng.choice([3, 900]))) for _ in range(rng.choice([0, 5, 199, 200, 260]))) for _ in range(60)]
    texts = [rng.choice(texts) for _ in range(150)] + [None, "", "a\x0bb\x0cc", "\n\n x", "É" * 30 + "A", "A" + "b" * 32, "A" + "b" * 33]
    ids = [None if i % 31 == 7 else i if i % 10 else i - 1 for i in range(len(texts))]
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in zip(ids, texts, strict=True)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 150, 3)] + [(9, 1, 1), (9, None, None), (None, 1, 1)]
    flags = {(i, "q") for i, q, _ in labels if q == 1 and i is not None} | {(i, "t") for i, _, t in labels if t == 1 and i is not None}
    got = filter_audit.audit(docs(spark, texts, ids, [r[2] for r in rows]), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, got)) == sorted(audited(rows, flags))
    assert filter_audit.audit(docs(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_audit_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()["op13_filter_audit"])
    columns = [c[0] for c in want.description]
    assert sorted(want.fetchall()) == sorted(tuple(r[c] for c in columns) for r in queries.queries()["op13_filter_audit"](spark, sf).collect())


def test_walsh_sums_invert_to_cells(spark):
    rng = random.Random(5)
    rows = [("p", rng.randrange(32), rng.randrange(1, 4), rng.random() < 0.4, rng.random() < 0.2) for _ in range(300)]
    found = filter_audit.cells(filter_audit.parity_sums(spark.createDataFrame(rows, "part string, mask int, rows long, good boolean, toxic boolean"))).collect()[0]
    for name, use in (("n", lambda r: True), ("good", lambda r: r[3]), ("toxic", lambda r: r[4])):
        assert found[name] == [sum(r[2] for r in rows if r[1] == m and use(r)) for m in range(32)]
