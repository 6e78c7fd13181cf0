"""Quality rules: the model holds every word and pair of the corpus, however it is dealt into blocks and passes."""

import random
from collections import Counter

import numpy as np
import pytest

from lattiq.llm import quality_rules


def plain_perplexity(texts, langs=None):
    langs = langs or [""] * len(texts)
    tokens = [[(x, w) for w in ["^", *t.split()]] for t, x in zip(texts, langs, strict=True)]
    pairs = Counter(p for t in tokens for p in zip(t, t[1:], strict=False))
    before, context, own = Counter(b for _, b in pairs), Counter(), Counter()
    d = quality_rules.discounts(np.array([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)]))
    e = quality_rules.discounts(np.array([sum(n == k for n in before.values()) for k in (1, 2, 3, 4)]))
    cut = {w: min(n, e[min(n, 3)]) for w, n in before.items()}
    for (a, _), n in pairs.items():
        context[a] += n
        own[a] += n - d[min(n, 3)] if n >= 2 else 0
    kinds, spared = sum(before.values()), sum(cut.values())
    out = []
    for t in tokens:
        logs = 0.0
        for a, b in zip(t, t[1:], strict=False):
            n = pairs[(a, b)]
            lower = (before[b] - cut[b]) / kinds + spared / kinds / (len(before) + 2 * (len(set(langs)) + 1))
            logs += np.log(((n - d[min(n, 3)]) / context[a] if n >= 2 else 0) + (1 - own[a] / context[a]) * lower)
        out.append(-logs / (len(t) - 1))
    return out


@pytest.mark.parametrize("block, part", [(1 << 24, 1 << 26), (3000, 20_000)])
def test_rare_words_and_pairs_are_in_the_model(spark, monkeypatch, block, part):
    """Most words here occur once or twice among 30 thousand."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(12_000)]
    texts = [" ".join(words[min(int(rng.paretovariate(0.35)), len(words)) - 1] for _ in range(300)) for _ in range(100)]
    monkeypatch.setattr(quality_rules, "BLOCK_BYTES", block, raising=False)
    monkeypatch.setattr(quality_rules, "PASS_BYTES", part, raising=False)
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r.log_perplexity for r in quality_rules.judged(docs).collect()}
    assert got == pytest.approx(dict(enumerate(plain_perplexity(texts))), rel=1e-9)


def test_each_band_rejects_what_is_planted_and_leaves_clean_texts(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    clean = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(400)], k=120)) for _ in range(600)]
    gibberish = [" ".join("".join(rng.choices("abcdefgh$&", k=9)) for _ in range(120)) for _ in range(8)]
    regular = [" ".join(f"x{(j * j * 7 + j) % 60 + (j + k) % 2}" for j in range(120)) for k in range(2)]
    texts = clean + gibberish + regular + [clean[0]] * 300
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judged(docs, most_repeated=100).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(got[k].log_perplexity > got[k].band_high for k in range(600, 608))
    assert any(got[k].log_perplexity < got[k].band_low for k in (608, 609)) and not got[608].kept
    assert sum(got[k].kept for k in range(600)) >= 595
