"""The corpus pipeline against its stages' meaning, on the smallest tables."""

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from careflow.llm import packing, pii
from careflow.llm.common import tokenizer, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = docs.withColumns({"rank": docs.doc_id, "component_id": docs.doc_id})
    counts = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, SF)
        if n + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == corpus_pipeline.COLUMNS, name
        out.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        counts.append((name, rows.count()))
        if name == "near_dedup":
            kept = {r["doc_id"]: r["text"] for r in rows.collect()}
            assert all(before[i] == t for i, t in kept.items())
        if name == "repeated_passages":
            shorter = rows.collect()
            assert {r["doc_id"] for r in shorter} == set(kept)
            assert all(r["n_chars"] == len(r["text"]) <= len(kept[r["doc_id"]]) for r in shorter)
    n = dict(counts)
    assert n["language_id"] == sum(any(c.isalpha() for c in t or "") for t in before.values())
    assert n["near_dedup"] < n["language_id"] and n["personal_data"] == n["repeated_passages"] == n["near_dedup"]
    ids = {r["doc_id"] for r in rows.collect()}
    assert ids == set(kept) and "sequence_id" in rows.columns


def test_empty_documents(spark, tmp_path):
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_documents_stay_without_labels(spark):
    texts = ["a clean text", "日本", None, "", "12 !"]
    for langs in ([None] * 5, [None, "en", "en", None, None]):  # doc_id 2 is in fold 1, the null text tells nothing
        rows = [(i + 1, t, x, "s", len(t or "")) for i, (t, x) in enumerate(zip(texts, langs))]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        got = corpus_pipeline.language_id(spark, docs, SF)
        assert got.columns == corpus_pipeline.COLUMNS
        assert sorted(tuple(r) for r in got.collect()) == rows[:2]


def test_passages_below_400_bytes_go(spark):
    rnd = random.Random(4)
    say = lambda n: " ".join(rnd.choice("abcde") + rnd.choice("fghij") + rnd.choice("klmno") for _ in range(n))
    passage = say(55)
    parts = [(say(40), say(40)) for _ in range(3)]
    rows = [(i, f"{a} {passage} {b}", "en", "s", 0) for i, (a, b) in enumerate(parts)] + [(3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert got == {**{i: f"{a}  {b}" for i, (a, b) in enumerate(parts)}, 3: None}


def planted():
    """(doc_id, text, lang) with near copies, a shared passage, personal data and junk, and the mentions planted."""
    rnd = random.Random(8)
    stems = {"en": "the ing tion and ough ly".split(), "de": "sch der ung und ein keit".split()}
    say = lambda x, n: " ".join(rnd.choice(stems[x]) + rnd.choice(stems[x]) for _ in range(n))
    docs = {i: (say(x, 60), x) for i in range(30) for x in [("en", "de")[i % 2]]}
    for i in range(30, 34):
        words = docs[4][0].split()
        words[7 * (i - 29)] = "tionough"
        docs[i] = (" ".join(words), "en")
    shared = say("en", 100)
    for i in range(40, 43):
        docs[i] = (f"{say('en', 150)} {shared} {say('en', 150)}", "en")
    mentions = [("email", "ann.lee@mail.example.com"), ("email", "ANN.LEE@MAIL.EXAMPLE.COM"), ("card", "4111 1111 1111 1111"),
                ("card", "4111-1111-1111-1111"), ("secret", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"),
                ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), ("phone", "+1 (017) 555-7713"),
                ("phone", "(017) 555-7713"), ("ip", "10.20.30.40"), ("name", "Anna Keller"), ("name", "ANNA KELLER")]
    for n, (_, v) in enumerate(mentions):
        docs[50 + n] = (f"{say('en', 30)} {v}, {say('en', 30)}", "en")
    docs |= {70: (None, "en"), 71: ("", "de"), 72: ("12 !", None), 73: (say("en", 3000), None)}
    return docs, mentions


def plain(docs, mentions):
    """The texts after the first four stages, one after the other."""
    texts = {i: t for i, (t, _) in docs.items() if any(c.isalpha() for c in t or "")}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, t in texts.items() for w in [t.split()]}
    at = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                lo, hi = sorted((at[i], at[j]))
                at = {k: lo if c == hi else c for k, c in at.items()}
    texts = {i: t for i, t in texts.items() if at[i] == i}
    seen = Counter(t[k:k + 400] for t in texts.values() for k in range(len(t) - 399))
    for i, t in texts.items():
        gone = set()
        for k in range(len(t) - 399):
            if seen[t[k:k + 400]] > 1:
                gone.update(range(k, k + 400))
        texts[i] = "".join(c for k, c in enumerate(t) if k not in gone)
    for kind, v in mentions:
        given = pii.render(kind, v, pii.surrogate(kind, pii.canonical(kind, v)))
        texts = {i: t.replace(v, given) for i, t in texts.items()}
    return texts


def test_run_against_plain_python(spark, tmp_path):
    docs, mentions = planted()
    rows = [(i, t, x, "s", len(t or "")) for i, (t, x) in docs.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.language_id(spark, frame, str(tmp_path)).collect()
    assert {r["doc_id"]: r["lang"] for r in found} == {i: x or "en" for i, (_, x) in docs.items() if i not in (70, 71, 72)}
    want = plain(docs, mentions)
    assert not {30, 31, 32, 33} & want.keys() and all(len(want[i]) < len(docs[i][0]) - 400 for i in (40, 41, 42))
    assert not any(v in t for t in want.values() for _, v in mentions)
    got, full = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    tok = tokenizer(tokenizer_path(packing.FILE))
    assert got.keys() == want.keys()
    for i, t in want.items():
        ids, end = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for n, (piece, start, length, crc) in enumerate(sorted(got[i])):
            assert (piece, start) == (n, end) and zlib.crc32(ids[start:start + length].tobytes()) == crc, i
            end = start + length
        assert end == len(ids), i
    for parts in full.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
