"""Fingerprints, classifier scores and perplexity bands against plain loops over the rows, with the parameters the queries use."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_quality_rules import plain_perplexity

from lattiq.llm import fingerprint, quality_model, quality_rules
from lattiq.llm import textscan as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = 2**64 - 1
GOLD = 0x9E3779B97F4A7C15
SYLLABLES = ["tha", "re", "in", "wo", "sel", "qu", "ma", "éo", "ß", "ti"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def mixed(h):
    for _ in range(2):
        h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 & MASK
    return h ^ (h >> 32)


def word_hash(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(T.range_hash(data, np.array([0]), np.array([len(data)]))[0])


def plain_fingerprint(text):
    """One term and one coordinate at a time."""
    words = [word_hash(w) for w in WORD.findall(text or "")]
    weights = Counter()
    for w in words:
        weights[w] += fingerprint.WORD_WEIGHT
    width = min(fingerprint.WIDTH, len(words))
    for at in range(len(words) - width + 1 if words else 0):
        h = words[at]
        for w in words[at + 1 : at + width]:
            h = (h * GOLD + w) & MASK
        weights[mixed((mixed(h) + 77) & MASK)] += 1
    r_all, c_all, b_all = fingerprint.variates()
    cell = fingerprint.CELLS - 1
    out = []
    for k in range(fingerprint.SAMPLES):
        best = None
        for term, weight in sorted(weights.items()):
            r, c, b = r_all[term & cell, k], c_all[(term >> 30) & cell, k], b_all[(term >> 15) & cell, k]
            t = np.floor(np.float32(math.log(weight)) / r + b)
            rank = c - r * (t - b + np.float32(1))
            if best is None or rank < best[0]:
                best = rank, mixed(term ^ mixed((int(t) + k * GOLD) & MASK))
        out.append(0 if best is None else max(best[1] >> 48, 1))
    return out


def test_fingerprints_are_those_of_a_plain_loop(spark):
    rng = random.Random(3)
    body = prose(rng, 90)
    texts = [body, body.replace("ma", "mo", 3), None, "", "one", "Two words", prose(rng, 40), "a " * 130, " \n ", "😀 é" * 30, body]
    ids = rng.sample(range(-50, 1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in fingerprint.fingerprint_table(docs).collect()}
    line = [(k, t or "") for k, t in sorted(zip(ids, texts, strict=True))]
    plain = [plain_fingerprint(t) for _, t in line]
    alike = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    hexed = lambda a: "".join(f"{x:04x}" for x in a)
    for at, (doc_id, text) in enumerate(line):
        after = (at + 1) % len(line)
        half = len(text) // 2
        edited = plain_fingerprint(text[: len(text) - half] + line[after][1][:half])
        r = got[doc_id]
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(plain[at]), hexed(edited))
        assert (r.near_edited, r.near_next) == (alike(plain[at], edited), alike(plain[at], plain[after]))


def plain_statistics(text):
    """The statistics of one text, in the order of their names."""
    text = text or ""
    data, words = text.encode(), WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    sizes = [len(w.encode()) for w in words]
    n, w, per_line = max(len(data), 1), max(len(words), 1), max(len(lines), 1)
    bytes_in = lambda listed: sum(x in listed for x in data) / n
    marks = b"#*$%&|<>"
    letter = lambda x: 65 <= x <= 90 or 97 <= x <= 122 or x > 127
    return [
        math.log1p(len(words)), math.log1p(len(data)), sum(map(len, words)) / w, bytes_in(marks), bytes_in(b"0123456789"), sum(65 <= x <= 90 for x in data) / n,
        bytes_in(b".,;:!?"), sum(x > 127 for x in data) / n, bytes_in(b" \t\n\v\f\r"), (len(lines) - len(set(lines))) / per_line, len(covered) / w,
        len(set(words)) / w, len(words) / per_line, sum(any(x in marks for x in v.encode()) for v in words) / w, sum(not any(letter(x) for x in v.encode()) for v in words) / w,
        sum(s <= 3 for s in sizes) / w, float(np.std(sizes)) if sizes else 0.0, -sum(c / n * math.log2(c / n) for c in Counter(data).values()),
    ]


def plain_scores(rows, labels):
    """One ridge regression over all rows at once, and the isotonic levels by their max-min formula."""
    x = np.array([plain_statistics(t) for _, t in rows]).astype(np.float32).astype(float)
    learn = [k for k, (doc_id, _) in enumerate(rows) if doc_id in labels and zlib.crc32(str(doc_id).encode()) % 5]
    y = np.array([labels[rows[k][0]] for k in learn], float)
    spread = x[learn].std(0)
    z = np.clip((x - x[learn].mean(0)) / np.where(spread > 1e-9, spread, 1), -8, 8)
    rng = np.random.default_rng(11)
    turn, phase = rng.normal(0, 1 / 3.0, (x.shape[1], 192)), rng.uniform(0, 2 * np.pi, 192)
    f = np.hstack([np.ones((len(z), 1)), z, np.cos(z @ turn + phase) * math.sqrt(2 / 192)])
    g = f[learn]
    raw = f @ np.linalg.solve(g.T @ g / len(y) + 1e-3 * np.eye(f.shape[1]), g.T @ y / len(y))
    cells = {}
    for s, v in zip(raw[learn], y, strict=True):
        cells.setdefault(min(2000, max(0, math.floor((s + 0.5) * 1000))), []).append((s, v))
    bins = [cells[c] for c in sorted(cells)]
    mean = lambda j, k, at: sum(v[at] for b in bins[j : k + 1] for v in b) / sum(map(len, bins[j : k + 1]))
    level = [max(min(mean(j, k, 1) for k in range(i, len(bins))) for j in range(i + 1)) for i in range(len(bins))]
    centres, levels, at = [], [], 0
    while at < len(bins):
        end = at
        while end + 1 < len(bins) and abs(level[end + 1] - level[at]) < 1e-9:
            end += 1
        centres.append(mean(at, end, 0))
        levels.append(level[at])
        at = end + 1
    return np.interp(raw, centres, levels)


def test_scores_are_those_of_a_plain_fit(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randint(3, 60))) for k in range(150)]
    bad = {k for k in range(150) if rng.random() < 0.3}
    rows = [(k, t.replace(" ", " $$ ", rng.randint(1, 6)) + "\n1 2 3" if k in bad and k % 7 else t) for k, t in rows] + [(900, None), (901, ""), (902, " \n ")]
    labels = {k: int(k not in bad) for k in range(150) if k % 3}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_model.quality_scores(docs, marked).collect()}
    for (doc_id, _), want in zip(rows, plain_scores(rows, labels), strict=True):
        assert got[doc_id].score == pytest.approx(want, abs=1e-5), doc_id
        assert got[doc_id].predicted == int(got[doc_id].score >= 0.3)


def plain_band(values):
    """Quartiles and tail by rank over the distinct values, in steps of the module."""
    line = sorted(values)
    at = lambda share: math.floor(next(v for k, v in enumerate(line, 1) if k >= len(line) * share) / quality_rules.STEP) * quality_rules.STEP
    low, high = at(0.25), at(0.75)
    return at(0.005), high + 2 * max(high - low, 0.5)


@pytest.mark.parametrize("few", [quality_rules.FEW_LANGUAGES, 0])
def test_bands_and_verdicts_are_those_of_plain_ranks(spark, monkeypatch, few):
    """Languages of their own, one too small for a band, copies, and texts that the base rules reject; bands sent to all tasks or dealt by salt."""
    monkeypatch.setattr(quality_rules, "FEW_LANGUAGES", few)
    rng = random.Random(12)
    rows = []
    for lang, many in (("en", 150), ("de", 70), (None, 20)):
        words = [f"{lang}{k}" for k in range(500)]
        rows += [(" ".join(rng.choices(words, [1 / (k + 1) for k in range(500)], k=rng.randint(45, 120))), lang) for _ in range(many)]
        rows += [(" ".join("".join(rng.choices("bcdfgh$&", k=12)) for _ in range(60)), lang) for _ in range(2)]
    rows += rows[:30] + [("again and again " * 30, "en"), ("", "de"), (None, "en")]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    langs = [r[1] or "" for r in rows]
    worded = [k for k, (t, _) in enumerate(rows) if t]
    value = dict(zip(worded, plain_perplexity([rows[k][0] for k in worded], [langs[k] for k in worded]), strict=True))
    passed = [k for k in worded if not got[k].base_failed]
    bands = {x: plain_band({got[k].log_perplexity for k in passed if langs[k] == x}) for x in ("en", "de")}
    bands[""] = plain_band({got[k].log_perplexity for k in passed})
    verdicts = Counter()
    for k in range(len(rows)):
        if k in value:
            assert got[k].log_perplexity == pytest.approx(value[k], rel=1e-9)
            assert (got[k].band_low, got[k].band_high) == pytest.approx(bands[langs[k]], abs=1e-9)
        kept = k in passed and bands[langs[k]][0] <= value[k] <= bands[langs[k]][1]
        assert got[k].kept == kept
        verdicts[got[k].base_failed, kept] += 1
    assert len(verdicts) == 3
