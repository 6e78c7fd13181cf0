"""Each training-data operator on small tables: odd rows, and results found by plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattiq.llm import chat, fingerprint, licenses, lyndon, minhash, mixing, packing, quality_model, quality_rules, repeats, tokens
from lattiq.llm.tokenize import encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, gram string, comp long"
SYLLABLES = ["tha", "re", "in", "wo", "sel", "qu", "ma", "éo", "ß", "ti"]


def prose(rng, n):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words).replace(" tha ", " tha.\n")


@pytest.fixture(scope="module")
def rows():
    """Nulls everywhere, blank and long texts, copies, near copies, shared passages, repeated rows, repeated ids, hot source."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(60, 160)) for _ in range(12)]
    passage = prose(rng, 70)
    texts = [None, "", " \n\t ", "one", "Two words", *base, base[0], base[0], base[1].upper(), prose(rng, 3000)]
    for k in range(6):
        words = base[2].split(" ")
        words[10 + 7 * k] = "changed"
        texts.append(" ".join(words))
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 30) for _ in range(4)]
    texts += ["MIT License, the mit\nlicense. CC BY", "Licensed under the Apache License, Version 2.0 (GNU General Public License)", "a " * 130, "x" * 450, "😀 é" * 120, "a <|endoftext|> b", "\u212a MIT LICENSE \u0130 CC BY"]
    out = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), None if t is None else len(t), 7, "g", 1) for k, t in enumerate(texts)]
    out.append((3, "another text with the id three", "en", "a", 1, 7, None, None))
    out.append(out[8])
    out.append((None, base[3], None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, width):
    words = WORD.findall(fold(text))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, rows, width):
    sets = [shingle_set(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[find(k)].append(r[0])
    smallest = {k: min((i for i in ids if i is not None), default=None) for k, ids in least.items()}
    want = Counter((r[0], len(sets[k]), smallest[find(k)], None if None in (r[0], smallest[find(k)]) else r[0] == smallest[find(k)]) for k, r in enumerate(rows))
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs, width=width).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == want


@pytest.mark.parametrize("block_bytes, block_rows", [(1 << 23, 4096), (8000, 4096), (1 << 23, 5), (20_000, 9)])
def test_parts_of_a_group_agree_with_all_pairs(spark, monkeypatch, block_bytes, block_rows):
    rng = random.Random(9)
    base = prose(rng, 120).split(" ")
    rows = []
    for k in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    sets = [shingle_set(t, 4) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert 3 < len(set(root)) < 60
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block_rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))


def bytes_left(rows, span):
    seen = Counter(b[i : i + span] for r in rows if (b := (r[1] or "").encode()) for i in range(len(b) - span + 1))
    out = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[(r[0], len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [20_000, 1, 3])
def test_repeats(docs, rows, hot):
    before, repeats.HOT = repeats.HOT, hot
    try:
        got = Counter(tuple(r) for r in repeats.remove_repeats(docs, span=200).collect())
    finally:
        repeats.HOT = before
    assert got == bytes_left(rows, 200)


def test_repeats_come_from_the_suffix_order():
    """In a wrong order only neighbours by chance are found: one suffix in eleven here is its neighbour's equal."""
    rng = random.Random(2)
    passage = prose(rng, 60).encode()
    cuts = [prose(rng, 30).encode()[-90 - k :] + passage[:260] + prose(rng, 30).encode()[:80] for k in range(6)]
    keys, leads, once = np.zeros(6, np.int64), np.array([90 + k for k in range(6)]), np.zeros(6, bool)
    found = repeats.repeated_starts(keys, leads, cuts, once, 200)
    assert all(set(range(90 + k, 90 + k + 61)) <= set(x.tolist()) for k, x in enumerate(found))
    shuffled = lambda s: sorted(range(len(s)), key=lambda i: hash((i * 2654435761) % 2**32))
    lost = repeats.repeated_starts(keys, leads, cuts, once, 200, order_of=shuffled)
    assert sum(map(len, lost)) < 0.4 * sum(map(len, found))
    assert sum(map(len, repeats.repeated_starts(keys, leads, cuts, ~once, 200, order_of=shuffled))) == sum(len(c) - 199 for c in cuts)


def test_suffix_order():
    rng = random.Random(1)
    for n in [*range(12), 200]:
        for _ in range(30):
            s = [rng.randint(0, rng.choice([0, 1, 3])) for _ in range(n)]
            assert lyndon.suffix_array(s) == sorted(range(n), key=lambda i, s=s: s[i:])


@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_encode_like_whole_texts(name, special_as_text):
    rng = random.Random(3)
    bits = ["<|EndOfText|>", "\u3000", "\u2028", "\u2019", "\u212a", "\x00", "10 ", "-", "\n\n", "word", "a", "The", " ", "  ", "\n", " \n", "\t", "'s", "'S ", "0", "12", "é", "é", "Σ", "中", "😀", ".", ",", "#", "<|endoftext|>", "\xa0", "\x1c", "\x85", "İ", "x,", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["", " ", "   "]
    own, whole = encoder(open(public_tokenizers.path(name)).read(), special_as_text), Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = special_as_text
    assert own.kind != "whole"
    assert [np.frombuffer(x, own.width).tolist() for x in own.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def plain_ids(rows, name, end):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    return [(r[0], whole.encode(r[1] or "", add_special_tokens=False).ids + [end]) for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(docs, rows):
    got = sorted((tuple(r) for r in tokens.token_index(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()), key=lambda r: r[1])
    want = plain_ids(rows, "byte_bpe_50k.json", 0)
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((k, len(i), crc(i)) for k, i in want)
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    keys = [-1 if r[0] is None else r[0] for r in got]
    assert keys == sorted(keys)


def test_boundaries_select():
    rng = np.random.default_rng(2)
    for top, n in ((0, 1), (5, 40), (10**6, 300), (10**9, 3)):
        values = np.sort(rng.integers(0, top + 1, n))
        index = tokens.EliasFano.of(values)
        assert index.all().tolist() == values.tolist() == [index.select(i) for i in range(n)]
    with pytest.raises(IndexError):
        index.select(3)
    assert len(index.high) + len(index.low) < 8 * 3
    with pytest.raises(ValueError):
        tokens.open_shard(b"nope" + bytes(40))


def test_packing(docs, rows):
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=256, with_ids=True).persist()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in pieces.collect():
        assert r.ids_crc32 == crc(r.ids) and r.length == len(r.ids)
        by_sequence[r.sequence_id].append((r.offset, r.ids))
        by_doc[r.doc_id].append(r)
    stream = []
    for k in range(len(by_sequence)):
        for at, ids in sorted(by_sequence[k]):
            assert at == len(stream) - k * 256
            stream += ids
    want = plain_ids(rows, "word_bpe_49k.json", 2)
    assert len(stream) == sum(len(i) for _, i in want) and len(by_sequence) == -(-len(stream) // 256)
    for k, i in want:
        if sum(r[0] == k for r in rows) == 1:
            assert [x for r in sorted(by_doc[k], key=lambda r: r.start) for x in r.ids] == i
    padded = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    last = len(stream) % 256 or 256
    assert all(len(r.ids) == 256 for k, r in padded.items() if k < len(padded) - 1)
    assert len(padded[len(padded) - 1].ids) == (last if last & (last - 1) == 0 else 256)


def test_mixing(docs, rows):
    got = [tuple(r) for r in mixing.mix_plan(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()]
    assert sorted(got, key=repr) == sorted((tuple(r) for r in mixing.mix_plan(docs.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=repr)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((r[0], r[3], len(WORD.findall(r[1] or ""))) for r in rows)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(target[s] for s in order if s not in open_)
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    taken = Counter()
    for r in got:
        taken[r[1]] += r[5]
        assert r[3] == sizes[r[1]] and r[4] == pytest.approx(target[r[1]]) and 0 <= r[5] <= 2 * r[2]
    assert all(taken[s] == int(target[s] + 1e-6) for s in order)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert words == taken


def test_fingerprints(docs, rows):
    got = fingerprint.fingerprint_table(docs).collect()
    assert len(got) == len(rows)
    one = [r for r in rows if sum(x[0] == r[0] for x in rows) == 1 and r[0] is not None]
    line = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    by_id = {r.doc_id: r for r in got}
    known = defaultdict(set)
    for r in one:
        known[r[1] or ""].add(by_id[r[0]].fingerprint)
        here = line.index(r)
        if here + 1 < len(line) and line[here + 1] in one:
            text, after = r[1] or "", line[here + 1][1] or ""
            half = len(text) // 2
            changed = text[: len(text) - half] + after[:half]
            assert by_id[r[0]].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and by_id[r[0]].n_chars == len(text)
        assert 0 <= by_id[r[0]].near_edited <= 1 and 0 <= by_id[r[0]].near_next <= 1
    assert all(len(x) == 1 for x in known.values())


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(0)
    terms = rng.integers(1, 2**63, 800).astype(np.uint64)
    one = rng.integers(0, 6, 800) * 0.5
    two = np.where(rng.random(800) < 0.6, one, rng.integers(0, 6, 800) * 0.5)
    drawn = lambda w, k: fingerprint.draw(terms[w > 0] * np.uint64(2 * k + 1), w[w > 0], np.array([0, (w > 0).sum()]))[0]
    found = np.mean([(drawn(one, k) == drawn(two, k)).mean() for k in range(30)])
    assert found == pytest.approx(np.minimum(one, two).sum() / np.maximum(one, two).sum(), abs=0.03)


def test_licenses(docs, rows):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for r in rows:
        words = pattern.findall(fold(r[1]))
        places = [(i, label) for label, p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        want[(r[0], len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places})))] += 1
    got = licenses.scan_licenses(docs)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == want
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and (r.score == 1 or r.n_base == 0)


def test_chats(spark):
    turn = lambda c, n, role, text: (c, n, role, text, "x")
    rows = [turn(1, 0, "user", "hi"), turn(2, 0, "user", "hi"), turn(2, 1, "assistant", "yes"), turn(3, 0, "user", "hi"), turn(3, 1, "assistant", "yes"), turn(4, 0, "user", "hi"), turn(4, 1, "assistant", None), turn(5, 0, None, "hi"), turn(5, 1, "user", "hi"), turn(6, 5, "user", "a\nb"), turn(None, 0, "user", "alone"), turn(None, 0, "user", "hi"), turn(None, None, None, None), turn(7, 0, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h1 string")
    got = {(r.conv_id, r.n_turns): r.chat for r in chat.format_chats(table).filter("conv_id is not null").collect()}
    assert set(got) == {(2, 2), (4, 2), (5, 2), (6, 1), (7, 1)}
    assert got[(2, 2)] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    alone = [r.chat for r in chat.format_chats(table).filter("conv_id is null").collect()]
    assert sorted(alone) == ["<|im_start|>unknown\n<|im_end|>\n", "<|im_start|>user\nalone<|im_end|>\n"]
    assert chat.format_chats(table.limit(0)).count() == 0


def test_native_operators_have_no_python_in_their_plans(spark, docs):
    talk = spark.createDataFrame([(1, 0, "u", "t")], "conv_id long, turn long, role string, text string")
    for frame in (licenses.scan_licenses(docs), chat.format_chats(talk)):
        assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())


def base_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules(docs, rows):
    want = Counter()
    for r in rows:
        n = base_counts(r[1])
        want[(r[0], *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    got = quality_rules.judged(docs)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()) == want
    assert not got.filter("base_failed and kept").count()


def test_perplexity_agrees_with_a_plain_model(spark):
    """Modified Kneser-Ney over two words, with every word and pair in the model."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(80)) for _ in range(30)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.log_perplexity for r in quality_rules.judged(docs, word_share=0.0, pair_share=0.0).collect()}
    words = Counter(w for t in texts for w in t.split())
    tokens_ = [["^"] + [w if words[w] >= 2 else "?" for w in t.split()] for t in texts]
    pairs = Counter(p for t in tokens_ for p in zip(t, t[1:], strict=False))
    d = quality_rules.discounts(np.array([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)]))
    before = Counter(b for _, b in pairs)
    e = quality_rules.discounts(np.array([sum(n == k for n in before.values()) for k in (1, 2, 3, 4)]))
    size = sum(n >= 2 for n in words.values()) + 2 * 2
    every = sum(before.values())
    cut = {w: min(n, e[min(n, 3)]) for w, n in before.items()}
    lower = lambda w: (before[w] - cut.get(w, 0)) / every + sum(cut.values()) / every / size
    context, own = Counter(), Counter()
    for (a, _), n in pairs.items():
        context[a] += n
        own[a] += n - d[min(n, 3)] if n >= 2 else 0
    odd = max(1, sum(n < 2 for n in words.values()))
    for k, t in enumerate(tokens_):
        logs = 0.0
        for a, b in zip(t, t[1:], strict=False):
            n = pairs[(a, b)]
            p = ((n - d[min(n, 3)]) / context[a] if n >= 2 else 0) + (1 - own[a] / context[a]) * lower(b)
            logs += np.log(p) - (np.log(odd) if b == "?" else 0)
        assert got[k] == pytest.approx(-logs / (len(t) - 1), rel=1e-9)


def test_model_is_a_distribution():
    d = quality_rules.discounts(np.array([100, 40, 20, 10]))
    assert 0 < d[1] < 1 and d[1] < d[2] < d[3] < 3
    assert quality_rules.discounts(np.zeros(4)).tolist() == [0.0, 0.5, 1.0, 1.5]


def test_quality_model_learns_and_stands_odd_labels(spark, docs):
    rng = random.Random(8)
    rows = [(k, " ".join(w + "$$$" * (k % 4 == 0) for w in prose(rng, 60).split()), int(k % 4 != 0)) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (10**9, 0), (5, None)], "doc_id long, quality int"))
    got = quality_model.quality_scores(table.select("doc_id", "text"), labels).collect()
    assert {r.doc_id: r.held_out for r in got} == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in range(400)}
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert quality_model.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()[0].score == 0.5
    assert quality_model.quality_scores(docs, labels).count() == docs.count()


def test_isotonic_levels_rise():
    at, level = quality_model.isotonic(np.arange(6.0), np.array([0, 3, 1, 4, 4, 10.0]), np.full(6, 10.0))
    assert (np.diff(level) > 0).all() and level[-1] == 1.0 and len(at) == len(level)


def test_empty_tables(spark, none):
    word, byte = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for frame in (minhash.near_duplicates(none), repeats.remove_repeats(none), tokens.token_index(none, byte), packing.pack(none, word), mixing.mix_plan(none), mixing.mix(none), fingerprint.fingerprint_table(none), licenses.scan_licenses(none), quality_rules.judged(none), quality_model.quality_scores(none, labels)):
        assert frame.count() == 0
