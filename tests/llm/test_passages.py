"""Passages of over 50 words against brute force, in the stage of the pipeline."""

import collections
import random
import re

import corpus_pipeline
import numpy as np
from test_llm_operators import EDGE, docs, prose

from tidemark.llm import queries, suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_kept(texts, n_bytes, n_words):
    """What is left of each text: no byte of a string of n_bytes, nor of one of n_words, that starts elsewhere too."""
    raws = [(t or "").encode() for t in texts]
    units = [([(i, i + 1) for i in range(len(r))], [m.span() for m in WORD.finditer(r)]) for r in raws]
    gone = [np.zeros(len(r), bool) for r in raws]
    for kind, n in ((0, n_bytes), (1, n_words)):
        strings = lambda k: [(at, tuple(raws[k][a:b] for a, b in units[k][kind][at : at + n])) for at in range(len(units[k][kind]) - n + 1)]  # noqa: E731, B023
        seen = collections.Counter(x for k in range(len(raws)) for _, x in strings(k))
        for k in range(len(raws)):
            for at, x in strings(k):
                if seen[x] > 1:
                    gone[k][units[k][kind][at][0] : units[k][kind][at + n - 1][1]] = True
    return [bytes(np.frombuffer(r, np.uint8)[~g]).decode("utf8", "ignore") for r, g in zip(raws, gone, strict=True)]


def planted(rng, passage, seed):
    return f"{prose(seed, rng.randrange(5, 90))} {passage} {prose(seed + 1, rng.randrange(5, 90))}"


def words_of(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_pipeline_removes_passages_of_over_50_words(spark):
    """The shortest passage, 51 words in under 400 bytes, goes from all its copies; one of 50 words stays."""
    over, fifty = words_of(1, 51), words_of(2, 50)
    assert len(over.encode()) < 400 and len(fifty.encode()) < 400
    d = docs(spark, [f"one {over} two", f"three {over} four", f"five {fifty} six", f"seven {fifty} eight", over])
    kept = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, d, "").collect()}
    assert {k: r["text"] for k, r in kept.items()} == {0: "one  two", 1: "three  four", 2: f"five {fifty} six", 3: f"seven {fifty} eight"}
    assert kept[0]["n_chars"] == 8


def test_passages_equal_brute_force(spark):
    """Nested, overlapping and blank-changed passages, copies, edits, one word many times, strings without blanks."""
    rng, texts = random.Random(6), list(EDGE)
    for seed in range(4):
        passage = words_of(seed, 49 + 2 * seed)
        texts += [planted(rng, passage, 10 * seed + i) for i in range(3)] + [planted(rng, passage.replace(" ", "\n", 9), 70 + seed)]
    long = words_of(50, 160).split()
    texts += [" ".join(long[a : a + 80]) for a in (0, 20, 40, 60)] + [prose(90, 30), prose(90, 30), prose(91, 90), prose(91, 90)]
    for i in range(8):
        w = list(long)
        w[i * 15 + 5] = "edit" + str(i)
        texts.append(" ".join(w))
    texts += ["for " * 120, "x " * 60, " ".join("x" * 50), "é" * 300, "b" + "é" * 300, "word" * 90]
    texts += ["common " + words_of(99, 60)] * 40
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.deduplicated(docs(spark, texts)).collect()}
    want = {k: x for k, x in enumerate(brute_kept(texts, suffix_dedup.LENGTH, 51)) if x.split()}
    assert got == want


def test_op2_counts_passages_of_over_50_words_beside_the_contract(spark, tmp_path):
    """A passage of 51 words in under 400 bytes shows in n_repeated alone, one of 400 bytes in both; 50 words in neither."""
    over, fifty, long = words_of(1, 51), words_of(2, 50), prose(7, 90)
    assert len(over.encode()) < 400 < len(long.encode())
    texts = [*EDGE, f"one {over} two", f"three {over} four", f"five {fifty} six", f"seven {fifty} eight", f"nine. {long}, ten", f"zero; {long}: no {over} all", over, "a lone text"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op2_suffix_dedup(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"]
    got = sorted(tuple(r) for r in out.collect())
    assert [x[:5] for x in got] == sorted(tuple(r) for r in suffix_dedup.spans(docs(spark, texts)).collect())
    size = [len((t or "").encode()) for t in texts]
    left = [len(x.encode()) for x in brute_kept(texts, suffix_dedup.LENGTH, 51)]
    assert [x[5] for x in got] == [a - b for a, b in zip(size, left, strict=True)]
    first = len(EDGE)
    assert [got[first + i][5] for i in range(4)] == [len(over)] * 2 + [0, 0] and [got[first + i][2] for i in range(4)] == [0] * 4
    assert got[first + 4][2] > 0 and got[first + 5][5] > got[first + 5][2] > 0
