"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And automaton: state bit i of a rule says that its
first i symbols fit the bytes read so far. A step for one byte is a shift with carry between words, an
AND with the byte's mask, and an OR with the states that a wildcard keeps alive. numpy runs the step for
thousands of canonical URLs at once, so every URL is judged against all rules in one pass over its bytes.

Glob syntax over `host + path`: `**` any bytes, `*` any bytes but `/`, `?` one byte but `/`, else literal.

Defined results: a null URL or one without `://` has an empty host and path, no rule, and the verdict that
the globs give the empty string (allow). Repeated rows stay repeated; null ids are kept; an empty table
gives an empty result; only the two named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: (rule, verdict): a host with its subdomains and a path prefix. The longest that fits decides.
DOMAIN_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Globs that block a URL on which no domain rule decides.
BLOCK_GLOBS = ("spam-farm.**", "*.spam-farm.**", "*casino*/**", "*/ads/**", "**/popup/**", "**.exe", "**.apk", "*doubleclick.**")
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
BLOCK = 4096


class GlobAutomaton:
    def __init__(self, globs: list[str]):
        self.count, bits = len(globs), 0
        symbols: list[tuple[int, str]] = []  # of each state but a rule's first: the symbol that leads to it
        loops: list[tuple[int, bool]] = []  # states that a wildcard keeps, and whether over a slash too
        self.first, self.last = [], []
        for glob in globs:
            self.first.append(bits)
            for token in re.findall(r"\*\*|\*|\?|[^*?]", glob):
                if token in ("*", "**"):
                    loops.append((bits, token == "**"))
                    continue
                for part in token.encode() if token != "?" else [-1]:
                    bits += 1
                    symbols.append((bits, part))
            self.last.append(bits)
            bits += 1
        self.words = w = (bits + 63) // 64 or 1
        self.step = np.zeros((256, w), np.uint64)
        self.keep = np.zeros((256, w), np.uint64)
        for at, byte in symbols:
            for c in range(256) if byte == -1 else [byte]:
                if byte != -1 or c != 47:
                    self.step[c, at // 64] |= np.uint64(1 << at % 64)
        for at, over_slash in loops:
            for c in range(256):
                if over_slash or c != 47:
                    self.keep[c, at // 64] |= np.uint64(1 << at % 64)
        self.start = np.zeros(w, np.uint64)
        for at in self.first:
            self.start[at // 64] |= np.uint64(1 << at % 64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """For each text and glob: does the whole text fit."""
        size = np.array([len(x) for x in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        buf = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        offset = np.cumsum(size) - size
        state = np.repeat(self.start[None], len(texts), 0)
        live, sizes = offset[order], size[order]
        for k in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -k, "left"))  # texts longer than k
            c, now = buf[live[:n] + k], state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[c]) | (now & self.keep[c])
        out = np.zeros((len(texts), self.count), bool)
        for i, at in enumerate(self.last):
            out[order, i] = (state[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1)
        return out


def canonical(url: str | None) -> tuple[str, str]:
    """Host, A-Z in lower case, and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), slash + path


def judge(pages: DataFrame, rules: tuple = DOMAIN_RULES, block_globs: tuple = BLOCK_GLOBS) -> DataFrame:
    """page_id, host, path, the deciding rule or null, and the verdict for every row of pages(page_id, url)."""
    globs = [g for rule, _ in rules for g in (rule + "**", "*." + rule + "**")] + list(block_globs)
    ranked = sorted(range(len(rules)), key=lambda i: len(rules[i][0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(globs)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                parts = [canonical(x) for x in part.column(1).to_pylist()]
                fits = automaton.match([(h + p).encode() for h, p in parts])
                best = np.full(len(parts), -1)
                for i in ranked:
                    best[fits[:, 2 * i] | fits[:, 2 * i + 1]] = i
                blocked = fits[:, 2 * len(rules) :].any(1)
                yield pa.record_batch(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array([h for h, _ in parts], pa.string()),
                        pa.array([p for _, p in parts], pa.string()),
                        pa.array([rules[i][0] if i >= 0 else None for i in best], pa.string()),
                        pa.array([rules[i][1] if i >= 0 else ("block" if b else "allow") for i, b in zip(best, blocked, strict=True)], pa.string()),
                    ],
                    names=["page_id", "host", "path", "rule", "verdict"],
                )

    return pages.select("page_id", "url").mapInArrow(run, SCHEMA)


def _sql_glob(glob: str) -> str:
    out = {"**": "[\\s\\S]*", "*": "[^/]*", "?": "[^/]"}
    return "".join(out.get(t) or re.escape(t) for t in re.findall(r"\*\*|\*|\?|[^*?]", glob))


def oracle() -> str:
    fits = lambda rule: f"((host = '{rule.split('/')[0]}' or ends_with(host, '.{rule.split('/')[0]}')) and starts_with(path, '/{rule.split('/', 1)[1]}'))"
    longest = sorted(DOMAIN_RULES, key=lambda r: -len(r[0]))
    rule = " ".join(f"when {fits(r)} then '{r}'" for r, _ in longest)
    given = " ".join(f"when rule = '{r}' then '{v}'" for r, v in longest)
    method = " or ".join(f"regexp_full_match(host || path, '{_sql_glob(g)}')" for g in BLOCK_GLOBS)
    return f"""
with cut as (
  select page_id, case when contains(url, '://') then regexp_replace(substr(url, instr(url, '://') + 3), '[?#][\\s\\S]*$', '') else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) as path from cut),
ruled as (select *, case {rule} end as rule from parts)
select page_id, host, path, rule, case {given} when {method} then 'block' else 'allow' end as verdict from ruled"""
