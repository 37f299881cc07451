"""Secrets, hard negatives and spelling variants against brute force, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from careflow.llm import negatives, secretscan, variants

DOCS = "doc_id long, text string, word string, n int, spans int, start int, root int"


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "w", 1, 2, 3, 4) for r in rows], DOCS).repartition(3)


# ---------------------------------------------------------------- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)


def entropy(window):
    return -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())


def brute_secrets(text):
    """All spans by the definitions, every window's entropy computed afresh."""
    text = text or ""
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    allow, more = re.compile("|".join(secretscan.ALLOW), re.IGNORECASE), []
    for c in secretscan.CLASSES:
        letters = set(c.alphabet.decode())
        good = []
        for i in range(len(text) - c.window + 1):
            w = text[i:i + c.window]
            if set(w) <= letters and entropy(w) >= c.bits and all(set(w) & set(g.decode()) for g in c.mix):
                if good and good[-1][1] >= i:
                    good[-1][1] = i + c.window
                else:
                    good.append([i, i + c.window])
        more += [(c.name, a, b) for a, b in good if not allow.search(text[a:b])]
    order = [*secretscan.BASE, *[c.name for c in secretscan.CLASSES]]
    return sorted(base + more, key=lambda s: (s[1], order.index(s[0]))), base


@pytest.fixture(scope="module")
def secret_texts():
    rnd = random.Random(5)
    some = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHabcdefgh0123456789XYZxyzPQRpqr"
    out = [None, "", " ", "ñ token: 'abcdef' é", "secret=token: abcdefgh", "PassWd = \"ab.c\" Api_Key:zz/99=-+",
           "tokenſ=abcdefgh toKen=abcdefgh", "AKIA" + "Z" * 15, "AKIA" + "Z" * 16, "xAKIAAKIA" + some("AB12", 14),
           "0123456789abcdef" * 3, "a" * 300, "1" * 90, "é" * 50 + some(hexes, 64) + "ü", some(hexes, 23), some(hexes, 24),
           some(hexes, 40).upper(), some(mixed, 24), some(mixed, 60), some(mixed + "+/_-", 200) + "==",
           "example" + some(mixed, 30), "https://a.b/c?token=" + some(mixed, 40) + "&x=" + some(hexes, 40),
           some(mixed, 30) + "a" * 60 + some(mixed, 30), "550e8400-E29b-41d4-a716-446655440000", "x\x00token\x20=\x20qwerty.1"]
    out += ["".join(rnd.choice([some(hexes, rnd.randrange(1, 50)), some(mixed, rnd.randrange(1, 50)), " ", "ß", "=", "token",
                                "日本"]) for _ in range(40)) for _ in range(20)]
    return out + [" ".join(some("abcdefghij", rnd.randrange(1, 9)) for _ in range(30_000)) + " " + some(mixed, 3_000)]


def test_secrets(spark, secret_texts):
    rows = list(enumerate(secret_texts)) + [(None, "token=abcdefgh"), (3, secret_texts[3])]
    found = secretscan.scan(docs(spark, rows))
    got = secretscan.digest(found)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    got = Counter(tuple(r) for r in got.collect())
    text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = Counter()
    for i, t in rows:
        spans, base = brute_secrets(t)
        base = [s for s in spans if s in base]
        n = Counter(k for k, _, _ in base)
        want[(i, n["assign"], n["access"], n["hex"], hashlib.sha256(text(base).encode()).hexdigest(), text(spans))] += 1
    assert got == want
    assert sum("base64_bits" in r[5] for r in got) and sum("alnum_bits" in r[5] for r in got)


def test_allow_list_takes_back_only_spans_of_classes():
    text = "token: EXAMPLE" + "aB3dE6gH9jK2mN5pQ8sT1vW4"
    kinds = lambda allow: [k for k, _, _ in secretscan.Scanner(allow=allow).spans(text)]
    assert kinds(secretscan.ALLOW) == ["assign"]
    assert kinds(()) == ["assign", "alnum_bits"]


def test_no_documents_no_secrets(spark):
    assert secretscan.digest(secretscan.scan(docs(spark, []))).collect() == []


# ---------------------------------------------------------------- hard negatives

def brute_negatives(rows):
    """``rows``: {id: (label, whole components)}."""
    out = set()
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1]))
    for a in rows:
        if a % 100:
            continue
        ranked = sorted((x for x in rows if x != a), key=lambda x: (-score(a, x), x))
        same = [x for x in ranked if rows[x][0] == rows[a][0]][:5]
        other = [x for x in ranked if rows[x][0] != rows[a][0]]
        for p in same:
            fit = [x for x in other if 80 * score(a, p) <= 100 * score(a, x) <= 100 * score(a, p)][:5]
            out |= {(a, p, n + 1, x, score(a, p), score(a, x)) for n, x in enumerate(fit)}
    return out


EMB = "vec_id long, embedding array<float>, label int, id int, block int, w string, score int"


@pytest.mark.parametrize("small_blocks", [False, True])
def test_hard_negatives(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(negatives, "BLOCK_ROWS", 60)
        monkeypatch.setattr(negatives, "TURN_ANCHORS", 2)
    rnd = np.random.default_rng(2)
    base = rnd.standard_normal((420, 12)) * 0.3
    base[40:60] = base[0]                 # copies of an anchor: ties
    base[100] = 0                         # scores of zero only
    base[200] *= 20
    labels = rnd.integers(0, 3, 420)
    labels[300:310] = 8
    rows = [(int(i), base[i].tolist(), int(labels[i])) for i in range(420)]
    rows[300] = (300, rows[300][1], 9)    # an anchor alone with its label, but for one that flips to it
    rows += [(500, None, 1), (600, rows[5][1], None), (700, [None] * 12, 1), (800, [float("nan")] * 12, 1),
             (900, [float("inf")] * 12, 0), (1000, [1.0], 0), (1100, [], 0), (None, rows[5][1], 1), rows[7], rows[7]]
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], EMB).repartition(4)
    got = [tuple(r) for r in negatives.mined(frame).collect()]
    known = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and len(v) == 12 and all(
                x is not None and math.isfinite(x) for x in v):
            known[i] = ((label + 1) % 10 if i % 7 == 0 else label,
                        [math.floor(256 * float(np.float32(x))) for x in v])
    assert set(got) == brute_negatives(known) and len(got) == len(set(got))


def test_index_finds_all_above(spark):
    rnd = np.random.default_rng(4)
    rows = np.floor(rnd.standard_normal((500, 24)) * np.geomspace(200, 2, 24))
    for anchor in rows[:8]:
        scores = rows @ anchor
        norm = np.sqrt(anchor @ anchor)
        for least in (scores.max(), np.quantile(scores, 0.95), 1.0, 0.0, -math.inf):
            index = negatives.Postings(rows, max(least, 0) / norm)
            at, found = index.above(anchor, least)
            assert sorted(at) == np.flatnonzero(scores >= least).tolist()
            assert (found == scores[at]).all()
    # high thresholds leave dimensions out
    assert negatives.Postings(rows, 300.0).held.sum() < rows.size / 2


def test_no_embeddings_no_negatives(spark):
    none = spark.createDataFrame([], EMB)
    assert negatives.mined(none).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 1, 2, "x", 3), (1, [1.0, 0.0], 1, 1, 2, "x", 3)], EMB)
    assert negatives.mined(few).collect() == []


# ---------------------------------------------------------------- spelling variants

def brute_variants(rows):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    close = {w: [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)] for w in n}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(close[w]), n[form[w]] if w in form else None))
    return out


@pytest.fixture(scope="module")
def word_rows():
    rnd = random.Random(8)
    letters = "abcdeéÿßÀ×"
    stems = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(6, 12))) for _ in range(60)]

    def edited(w):
        i, c = rnd.randrange(len(w) + 1), rnd.choice(letters)
        return rnd.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:]])

    words = stems + [edited(w) for w in stems for _ in range(4)]
    words += [edited(w) for w in words[60:180]]
    long = "".join(rnd.choice(letters) for _ in range(700))
    chain = ["zzzzzzza"] + ["zzzzzzzab"] * 12 + ["zzzzzzzabc"] * 130 + ["zzzzzzzabcd"] * 1400
    rows = [(None, "lettersss " * 3), (1, None), (2, ""), (3, "Éÿ-12 İstanbul 日本 straße" * 3), (3, "Éÿ-12 repeated repeated")]
    rows += [(10 + i, " ".join(rnd.choice(words[:1 + rnd.randrange(len(words))]) for _ in range(200))) for i in range(60)]
    rows += [(100 + i, f"{long} {long}x {long[:-1]} {long[:300]}à{long[300:]} " + "s" * 5000) for i in range(3)]
    return rows + [(200, " ".join(chain)), (201, "ZZZZZZZA " + "HOTWORDS " * 3000 + "HOTWORD hotwordsé " * 20)]


@pytest.mark.parametrize("tight", [False, True])
def test_variants(spark, monkeypatch, word_rows, tight):
    if tight:  # several slices, passes, chunks and tasks
        monkeypatch.setattr(variants, "SLICE_BLOCKS", 7)
        monkeypatch.setattr(variants, "PROBES", 64)
        monkeypatch.setattr(variants, "TASK_WORDS", 100)
        small = variants.passes
        monkeypatch.setattr(variants, "passes", lambda sizes: small(sizes, 500))
    got = variants.group_variants(docs(spark, word_rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(word_rows)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert any(form and root != form for _, form, root, *_ in want) and any(len(w[0]) > 600 and w[4] for w in want)


def test_hashes_of_edits_are_those_of_the_words():
    words = ["abcdefgh", "ÿbcdefgé", "aaaaaaab"]
    every = {e for w in words for i in range(8) for e in
             [w[:i] + w[i + 1:], *[w[:i] + c + w[i + 1:] for c in variants.LETTERS if c > w[i]]]}
    sizes = {7: 500, 8: 50_000}
    held = {}
    for shard, blocks in sizes.items():
        bits = np.zeros(blocks, np.uint64)
        block, mask = variants.places(variants.raw_hashes(variants.codes(sorted(e for e in every if len(e) == shard))), blocks)
        np.bitwise_or.at(bits, block, mask)
        held[shard] = (0, bits)
    found = list(variants.probe(words, variants.Filters(sizes, held)))
    assert {e for _, e in found} == every and len(found) == len(set(found))


def test_checksums_are_crc32():
    rnd = random.Random(1)
    parts = [bytes(rnd.randrange(256) for _ in range(rnd.choice([1, 2, 7, 63, 64, 65, 300]))) for _ in range(50)]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    stop = np.cumsum([len(p) for p in parts])
    seeds = np.array([zlib.crc32(str(i).encode()) for i in range(50)], np.uint32)
    got = variants.checksums(raw, stop - [len(p) for p in parts], stop, seeds)
    assert got.tolist() == [zlib.crc32(p, int(s)) for p, s in zip(parts, seeds)]


def test_no_documents_no_words(spark):
    assert variants.group_variants(docs(spark, [])).collect() == []
    assert variants.group_variants(docs(spark, [(1, None), (2, "short words only")])).collect() == []
