"""Corpus operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from careflow.llm import (extraction, fingerprint, language, minhash, neighbours, packing, pii, repeats, sampling,
                          tokencount)
from careflow.llm.common import tokenizer, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash int, rank int, component_id int"


def frame(spark, texts, langs=None):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, langs[i] if langs else "en", "s", 0, 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = prose(150)
    out = [None, "", "one", "One", "a b c", prose(3000), base, base, base.upper()]
    for k in range(12):
        w = base.split()
        for _ in range(k):
            w[rnd.randrange(len(w))] = prose(1)
        out.append(" ".join(w))
    shared = prose(120)
    return out + [prose(30) + " " + shared + " " + prose(20) for _ in range(8)] + ["...", "x" * 900, "日本 語 ▁ \x00 ", "12 34"]


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    at = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 75 * len(a | sets[j]):
                lo, hi = sorted((at[i], at[j]))
                at = [lo if x == hi else x for x in at]
    return [len(s) for s in sets], at


@pytest.mark.parametrize("share", [1, 8, 1000])  # no set, some sets, all sets are joined by broadcast
def test_near_duplicates(spark, texts, monkeypatch, share):
    monkeypatch.setattr(minhash, "SHARE", share)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    sizes, at = brute_components(texts)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == at
    assert [got[i]["kept"] for i in range(len(texts))] == [i == c for i, c in enumerate(at)]


def test_near_duplicates_repeated_and_null_keys(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "u v w x y z"), (9, "u v w x y z")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got) == [
        (-1, None, None), (4, 4, True), (4, 4, True), (9, 4, False)]


@pytest.mark.parametrize("share", [1, 1000])
def test_near_duplicates_of_mostly_empty_texts_beside_clashing_names(spark, monkeypatch, share):
    monkeypatch.setattr(minhash, "SHARE", share)
    rows = [(i, None if i % 2 else "", "x", i) for i in range(30)] + [(i, "one two three", "y", i) for i in range(30, 45)]
    names = "doc_id long, text string, component_id string, copies long"
    got = minhash.near_duplicates(spark.createDataFrame(rows, names)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [
        (i, int(i >= 30), min(i, 30), i <= 30) for i in range(45)]


def test_circulant_coordinates_are_shifts():
    scatter, shifted = minhash.permutations(250)
    s = np.array([5 << 44, 9 << 44], np.uint64)
    ranks, n = shifted[:, 0], len(scatter)
    for k, v in enumerate(minhash.signature(s, 250)):
        assert v == min(ranks[(scatter[5] + k) % n], ranks[(scatter[9] + k) % n])


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    for t in data:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


@pytest.mark.parametrize("length,window", [(400, 128), (60, 20)])
def test_repeats(spark, texts, length, window):
    got = repeats.without_repeats(frame(spark, texts), length=length, window=window, keep_text=True).collect()
    got = {r["doc_id"]: tuple(r)[1:5] for r in got}
    assert [got[i] for i in range(len(texts))] == list(brute_repeats(texts, length))


def test_repeats_across_blocks_and_rows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_BLOCK", 700)  # tasks of a local session are forked after this
    rnd = random.Random(1)
    part = "".join(rnd.choice("abcd") for _ in range(1500))
    rows = [(7, part), (7, part[300:]), (None, "e" + part[:420])]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = list(brute_repeats([t for _, t in rows], 400))
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)


def brute_passages(texts, length, words):
    """The texts without strings of ``length`` bytes or ``words`` words that start anywhere else."""
    data = [(t or "").encode() for t in texts]
    found = [[(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^ \t-\r]+", t)] for t in data]
    strings = Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    passages = Counter(tuple(x[2] for x in w[i:i + words]) for w in found for i in range(len(w) - words + 1))
    for t, w in zip(data, found):
        gone = {k for i in range(len(t) - length + 1) if strings[t[i:i + length]] > 1 for k in range(i, i + length)}
        gone |= {k for i in range(len(w) - words + 1) if passages[tuple(x[2] for x in w[i:i + words])] > 1
                 for k in range(w[i][0], w[i + words - 1][1])}
        yield bytes(b for k, b in enumerate(t) if k not in gone).decode(errors="ignore")


@pytest.mark.parametrize("block", [None, 700])
def test_repeated_passages_of_words(spark, texts, monkeypatch, block):
    if block:
        monkeypatch.setattr(repeats, "_BLOCK", block)
    rnd = random.Random(5)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    short, lone = say(51), say(50)  # 254 and 249 bytes
    docs = [*texts, f"{say(30)} {short} {say(9)}", short.replace(" ", "\n\n"), f"\t{say(80)}  {short}", lone + " x", "y " + lone]
    want = list(brute_passages(docs, 400, 51))
    assert all(short not in t for t in want) and want[-2:] == docs[-2:] and want[len(texts) + 1] == ""
    got = repeats.without_repeats(frame(spark, docs), keep_text=True, words=51).collect()
    got = {r["doc_id"]: r["kept"] for r in got}
    assert [got[i] or "" for i in range(len(docs))] == want


def test_language(spark):
    rnd = random.Random(5)
    stems = {"en": "the ing tion and ough", "de": "sch der ung und ein", "fr": "eau que les oux ment"}
    say = lambda x, n: " ".join("".join(rnd.choice(stems[x].split()) for _ in range(2)) for _ in range(n))
    langs = [rnd.choice(list(stems)) for _ in range(300)]
    texts = [say(x, 12) for x in langs] + [None, "", "123 !", say("en", 30) + " " + say("de", 20)]
    langs += [None, "en", "de", None]
    got = {r["doc_id"]: r for r in language.predict(frame(spark, texts, langs)).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in range(300) if got[i]["held_out"]]) > 0.97
    assert [got[i]["lang_pred"] for i in (300, 301, 302)] == ["und"] * 3 and got[302]["score"] == 0
    mixed = got[303]
    assert mixed["lang_pred"] == "en" and set(mixed["languages"]) == {"en", "de"}
    assert 0.4 < mixed["score"] < 0.8


def test_packing(spark, texts):
    got = packing.pack_documents(frame(spark, texts)).collect()
    tok = tokenizer(tokenizer_path(packing.FILE))
    pieces = defaultdict(dict)
    for r in got:
        pieces[r["doc_id"]][r["piece"]] = r
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = [pieces[i][p] for p in range(len(pieces[i]))]
        assert [r["start"] for r in mine] == np.cumsum([0, *[r["length"] for r in mine]])[:-1].tolist()
        assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == 2048 for r in mine[1:])
        assert all(zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in mine)
    full = defaultdict(list)
    for r in got:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in full.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(full) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_ranks_file_gives_the_tokenizers_ids():
    fast = packing.Encoder(tokenizer_path(packing.FILE), tokenizer_path(packing.RANKS))
    words = [f" {w.lstrip('Ġ')}" for w in fast.tok.get_vocab() if w.lstrip("Ġ").isascii()]
    words = [w for w in dict.fromkeys(words) if len(w) > 1 and not w[1].isspace() and w[1:] not in fast.special]
    plain = packing.Encoder(tokenizer_path(packing.FILE))
    assert fast.merge(words) == plain.merge(words)


def test_sweep_matches_each_gap_to_the_longest_that_fits():
    docs = [[0, 0] for _ in range(11)]
    docs[3], docs[5] = [0, 1], [0, 2]
    runs = packing.sweep(docs, {4: 2, 6: 1, 9: 1})
    assert runs == [(4, 0, 1, 3, 0), (4, 1, 1, 0, 0), (6, 0, 1, 5, 0), (9, 0, 1, 5, 1)]


PAGE = ("<html><head><title>t</title></head><body><div class='menu'><a>Home</a></div><div><h2>A %d</h2>"
        "<p>Same words here</p><p>text  %d &amp;\nmore</p><div id='comments'><p>c</p></div></div><footer>f</footer>")


def test_extraction(spark):
    art = "<nav>n</nav><article><h1>T</h1><p>One <b>two</b>&nbsp;x<p>Three<aside>no</aside></article><form>f</form>"
    rows = [(i, "https://a.org/x", PAGE % (i, i)) for i in range(5)]
    rows += [(5, "https://b.org/", art), (6, None, None), (7, "nonsense", "<p>only"), (7, "nonsense", "<p>only")]
    got = extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 9 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [text[i] for i in range(5)] == [f"A {i}\ntext {i} & more" for i in range(5)]
    assert text[5] == "T\nOne two x\nThree" and text[6] == "" and text[7] == "only"


def test_template_of_several_page_types(spark):
    body = "<body><div>%s</div><ul><li>Home %s</li></ul><div><p>text %d of it</p></div><p>About %s</p></body>"
    rows = [(i, "https://a.org/x", body % (k, k, i, k)) for i in range(30) for k in ["abc"[i % 3]]]
    rows += [(30 + i, "https://a.org/e", f"<p>error {i}") for i in range(3)]
    rows += [(40 + i, "https://b.org/", "<p>same</p><p>page</p>") for i in range(4)]  # copies tell nothing
    got = extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {i: f"text {i} of it" for i in range(30)} | {30 + i: f"error {i}" for i in range(3)}
    assert {r["page_id"]: r["text"] for r in got} == want | {40 + i: "same\npage" for i in range(4)}


def test_template_inside_articles(spark):
    words = ["one two three four five six %d" % i for i in range(9)]
    page = "<nav>n%d</nav><article><h1>T %d</h1><div>Read more <b>on our site</b></div><p>%s</p><p>%s</p></article>"
    # a line of three pages of nine is text, and so is all of a page that is mostly shared
    rows = [(i, "https://a.org/x", page % (i, i, words[i], "A license" if i < 3 else f"end {i}")) for i in range(9)]
    rows += [(20 + i, "https://b.org/x", f"<article><p>{words[0]} and {words[1]}</p><p>{i}</p></article>") for i in range(5)]
    got = extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {i: f"T {i}\n{words[i]}\n" + ("A license" if i < 3 else f"end {i}") for i in range(9)}
    assert {r["page_id"]: r["text"] for r in got} == want | {
        20 + i: f"{words[0]} and {words[1]}\n{i}" for i in range(5)}


def test_alignment_settles_slots_of_articles(spark):
    # what stands out of the template's place is quoted, and is the page's own text
    page = "<article><h1>T %d</h1>%s<p>text %d of this page, which is long enough</p><p>Read more</p></article>"
    rows = [(i, "https://a.org/x", page % (i, "<p>Read more</p>" if i == 4 else "", i)) for i in range(9)]
    got = extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {i: f"T {i}\n" + "Read more\n" * (i == 4) + f"text {i} of this page, which is long enough" for i in range(9)}
    assert {r["page_id"]: r["text"] for r in got} == want


def test_largest_mapping_by_brute_force():
    rng = random.Random(1)

    def html(depth):
        return "".join(f"<{t}>{rng.choice('xyz') if not depth or rng.random() < .5 else html(depth - 1)}</{t}>"
                       for t in rng.choices(["div", "b", "section"], k=rng.randint(0, 4)))

    def best(a, b):
        """(size, nodes in equal subtrees) of the best mapping, by trying all."""
        def tail(i, j):
            if i == len(a.kids) or j == len(b.kids):
                return 0, 0
            found = [tail(i + 1, j), tail(i, j + 1)]
            if a.kids[i].tag == b.kids[j].tag:
                found.append(tuple(map(sum, zip(best(a.kids[i], b.kids[j]), tail(i + 1, j + 1)))))
            return max(found)
        return (a.size, a.size) if a.hash == b.hash else tuple(map(sum, zip((1, 0), tail(0, 0))))

    for _ in range(200):
        a, b = extraction.parse(html(2)), extraction.parse(html(2))
        found = extraction._weight(a, b, {})
        assert (found >> extraction._EQUAL_BITS, found & extraction._ONE - 1) == best(a, b)


def test_names_hide_no_article():
    text = lambda html: extraction.extract(html, [])
    for page in ("<body class='has-sidebar'><article><p>x</p></article>", "<body class='sidebar'><article><p>x</p></article>",
                 "<div id='page' class='search-results'><article><p>x</p></article></div>",
                 "<div class='search'><div><article><p>x</p></article></div></div>",
                 "<article class='post comments-open'><p>x</p></article>", "<main class='search'><p>x</p></main>",
                 "<article class='social'><p>x</p></article>", "<div class='search'><p>x</p></div>",
                 "<article>x<div class='comments'>no</div><div class='cookie-banner site-footer'>no</div></article>",
                 "<article>x</article><div id='comments'><article class='comment'>c</article></div>",
                 "<article><p>x</p></article><div hidden><article>no</article></div>"):
        assert text(page) == "x", page
    assert text("<article><div class='article-header'>a</div><p class='social-policy'>b</p></article>") == "a\nb"


def test_tree_matching_keeps_order():
    a, b = (extraction.parse(f"<ul>{x}</ul>") for x in ("<li>1</li><p>2</p><li>3</li>", "<p>2</p><li>1</li><li>4</li>"))
    assert extraction.align(a, b, {}) == 6  # root, ul, p with its text, li with another


def test_pii(spark):
    mail = "ann.lee@mail.example.com"
    texts = [f"write {mail} or +1 (017) 555-7713", f"again {mail}.", "4111 1111 1111 1111 at 10.1.2.3", None, "",
             "no 12 data 2024", "Anna Keller and Иван Петренко"]
    got = {r["doc_id"]: r for r in pii.replace(frame(spark, texts), carry=["lang"]).collect()}
    assert [got[i]["n_entities"] for i in range(7)] == [2, 1, 2, 0, 0, 0, 2]
    assert got[3]["text"] is None and got[5]["text"] == texts[5]
    a, b = got[0]["text"].split()[1], got[1]["text"].split()[1].rstrip(".")
    assert a == b != mail and re.fullmatch(r"[a-z]{3}\.[a-z]{3}@[a-z]{4}\.example\.com", a)
    assert re.fullmatch(r"write \S+ or \+1 \(\d{3}\) \d{3}-\d{4}", got[0]["text"])
    card = [int(c) for c in got[2]["text"][:19] if c.isdigit()]
    assert pii._luhn(card) == 0 and "4111 1111" not in got[2]["text"]
    woman, man = re.fullmatch(r"(\w+) \w+ and (\w+) \w+", got[6]["text"]).groups()
    assert woman in pii.NAMES["latin", "f"] and man in pii.NAMES["cyrillic", "m"]


def test_pii_formats(spark):
    found = {"9233A8ECF7C5B09FE5949719B6B82BC439E9329B": r"[0-9A-F]{40}", "04dbebab91ab85687d33eeaaf9ac699e": r"[0-9a-f]{32}",
             "Linda Smith": r"[A-Z][a-z]+ [A-Z][a-z]+", "Anna McDonald": r"[A-Z][a-z]+ [A-Z][a-z]+",
             "ANNA BAUER": r"[A-Z]+ [A-Z]+", "Екатерина Шевченко": r"[А-Я][а-я]+ [А-Я][а-я]+",
             "0049 171 2345678": r"0049 \d{3} \d{7}", "(030) 1234-5678": r"\(0\d\d\) \d{4}-\d{4}",
             "0171/2345678": r"0\d{3}/\d{7}", "1-800-555-0199": r"1-\d{3}-\d{3}-\d{4}",
             "2001:db8::8a2e:370:7334": r"[0-9a-f:]+::[0-9a-f:]+", "fe80:0:0:0:1:2:3:4": r"([0-9a-f]+:){7}[0-9a-f]+"}
    texts = [f"see {v}, then" for v in found] + ["tel: 5551234567.", "Dr. Kwame Nkrumah-Jones", "my name is Zoe O'Neil.",
             "12:30:45 std::vector a::b 1.2.3 on 2024-01-02", "tel 10.20.30.40", "card 0054994038693466"]
    got = {r["doc_id"]: (r["text"], r["n_entities"], r["kinds"]) for r in pii.replace(frame(spark, texts)).collect()}
    for i, (v, form) in enumerate(found.items()):
        assert got[i][1] == 1 and v not in got[i][0] and re.fullmatch(f"see {form}, then", got[i][0]), got[i]
    n = len(found)
    assert re.fullmatch(r"tel: \d{10}\.", got[n][0]) and "5551234567" not in got[n][0]
    assert got[n + 1][0].startswith("Dr. ") and "Nkrumah" not in got[n + 1][0] and "Zoe" not in got[n + 2][0]
    assert got[n + 3][:2] == (texts[n + 3], 0)
    assert got[n + 4][2] == {"ip": 1} and got[n + 5][2] == {"card": 1}


def test_pii_coreference(spark):
    texts = ["Ann.Lee@mail.example.com, ann.lee@mail.example.com", "ANN.LEE@MAIL.EXAMPLE.COM",
             "4111 1111 1111 1111, 4111111111111111", "+1 (017) 555-7713, (017) 555-7713, +10175557713",
             "ANNA BAUER", "Anna Bauer came. Later Anna met Ms Bauer and Bauer's dog in Annapolis.",
             "DE89 3704 0044 0532 0130 00, DE89370400440532013000", "Anna alone"]
    docs = pii.replace(frame(spark, texts)).collect()
    got, n = {r["doc_id"]: r["text"] for r in docs}, {r["doc_id"]: r["n_entities"] for r in docs}
    a, b = got[0].split(", ")
    assert a.lower() == b == got[1].lower() and got[1].isupper() and a[0].isupper() and "lee" not in b
    a, b = got[2].split(", ")
    assert a.replace(" ", "") == b != "4111111111111111"
    a, b, c = ("".join(x for x in p if x.isdigit()) for p in got[3].split(", "))
    assert a == "1" + b == c != "10175557713"
    given, family = got[4].split()
    g, f = given.capitalize(), family.capitalize()
    assert got[4].isupper() and got[5] == f"{g} {f} came. Later {g} met Ms {f} and {f}'s dog in Annapolis."
    assert n[5] == 4 and n[3] == 3
    a, b = got[6].split(", ")
    assert a.replace(" ", "") == b and got[7] == "Anna alone"


def test_surrogates_stay_distinct(spark):
    values = spark.createDataFrame([("name", f"{g} {f}") for (s, _), gs in pii.NAMES.items() for g in gs
                                    for f in pii.FAMILY[s]], "kind string, value string")
    got = pii.assigned(values, b"k").collect()
    given = [r["surrogate"] for r in got]
    assert len(set(given)) == len(given) == values.count()
    assert not set(given) & {r["value"] for r in got}


def test_sampling_is_lossless_and_reproducible(spark, texts):
    docs = frame(spark, texts)
    ids = sampling.sample_pieces(docs)
    first = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert first == {r["doc_id"]: r["ids"] for r in sampling.sample_pieces(docs.repartition(5)).collect()}
    assert {r["doc_id"]: r["text"] for r in sampling.decode_pieces(ids).collect()} == {
        i: t or "" for i, t in enumerate(texts)}
    again = {r["doc_id"]: r["ids"] for r in sampling.sample_pieces(docs, seed=1).collect()}
    assert again[5] != first[5]


def test_spelled_characters_by_place():
    tok = sampling.lattice(sampling.tokenizer_path(sampling.FILE), 0.5)
    spelled = [sampling._SPELLED + ord(c) for c in "\n" + sampling._SIGN + "\U0001F9FF"]
    code = np.array([7, spelled[0], spelled[2], 9, spelled[1], spelled[0]])
    space = [tok.byte_id[b] for b in sampling.SPACE.encode()]
    want = [[7, *tok.spell(spelled[0])], [*tok.spell(spelled[2]), 9], [], space + tok.spell(spelled[0])]
    out, ends = tok._spelled(code, np.array([0, 2, 4, 4, 6]))
    assert [out[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want


def test_sampling_follows_path_weights():
    tok = sampling.lattice(sampling.tokenizer_path(sampling.FILE), 0.5)
    n = 20_000
    got = Counter(tuple(x.tolist()) for x in tok.sample(["the"] * n, np.arange(n).astype(np.uint64)))
    weight = {p: w for p, (i, w) in ((tok.pieces[i], (i, w)) for i, w in tok.ends if i >= 0)}
    name, unit = {i: p for i, p in enumerate(tok.pieces)}, "▁the"

    def paths(at):
        if at == len(unit):
            return [((), 0.0)]
        return [((unit[at:e], *rest), weight[unit[at:e]] + w) for e in range(at + 1, len(unit) + 1)
                if unit[at:e] in weight for rest, w in paths(e)]

    every = {p: np.exp(w) for p, w in paths(0)}
    total = sum(every.values())
    for ids, c in got.items():
        share = every[tuple(name[i] for i in ids)] / total
        assert abs(c / n - share) < 5 * (share / n) ** 0.5 + 1e-3


def test_fingerprints(spark, texts):
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        k = len(t) // 2
        edited = t[:len(t) - k] + after[:k]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.fingerprint(t)
        assert r["edited_fingerprint"] == fingerprint.fingerprint(edited)
        assert 0 <= r["near_next"] <= 1 and (t != after or r["near_next"] == 1)


def test_longest_common_extension():
    rnd = random.Random(2)
    t = "".join(rnd.choice("ab") for _ in range(200))
    p = fingerprint.Prefixes(fingerprint.codes_of(t))
    for _ in range(200):
        a, b = rnd.randrange(200), rnd.randrange(200)
        n = 0
        while max(a, b) + n < 200 and t[a + n] == t[b + n]:
            n += 1
        assert p.extension(a, b) == n


def test_token_counts(spark, texts):
    texts = [*texts, "a\x1cb  c", "<|endoftext|> hi<|startoftext|>x", "It's 12 naïve é İ ΣΑΣ's", "​ a͸b"]
    got = {r["doc_id"]: r for r in tokencount.count_tokens(frame(spark, texts), limit=100).collect()}
    tok = tokenizer(tokenizer_path(tokencount.FILE))
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len((t or "").encode()), n, n > 100)


def test_neighbours(spark):
    rnd = np.random.default_rng(0)
    x = rnd.standard_normal((1500, 16)) * rnd.uniform(0.5, 2, (1500, 1))
    x[100:500] = x[7]  # many equal vectors
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (40, x[40].tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found = defaultdict(dict)
    for r in got:
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(found) == list(range(0, 1500, 20))
    hits = 0
    for q, mine in found.items():
        assert sorted(mine) == list(range(1, 21))
        ids = [mine[k][0] for k in range(1, 21)]
        scores = x @ x[q]
        assert np.allclose([mine[k][1] for k in range(1, 21)], scores[ids])
        assert ids == sorted(ids, key=lambda i: (-round(scores[i], 9), i)) and q not in ids
        true = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(scores[i], 9), i))[:20]
        hits += len(set(true) & set(ids))
    assert hits / (20 * len(found)) >= 0.9
    few = neighbours.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]


def test_chi_square_quantile():
    assert neighbours.chi_square_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)


@pytest.mark.parametrize("apply", [minhash.near_duplicates, repeats.without_repeats, language.predict,
                                   packing.pack_documents, pii.replace, sampling.sample_pieces,
                                   fingerprint.edited_fingerprints, tokencount.count_tokens])
def test_empty_documents(spark, apply):
    assert apply(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_empty_tables(spark):
    assert extraction.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_deep_and_wide_pages_align():
    import time
    deep = "<div>" * 5000 + "%s" + "</div>" * 5000
    a, b = (extraction.parse(deep % x) for x in ("<p>one</p>", "<p>two</p>"))
    t0 = time.time()
    assert extraction.constant(a, b) == set()
    table = "<table>" + "".join(f"<tr><td>{{0}} {i}</td><td>x</td></tr>" for i in range(10_000)) + "</table>"
    a, b = (extraction.parse(table.format(x) + "<div>same <b>here</b></div>") for x in "pq")
    same = extraction.constant(a, b)
    assert time.time() - t0 < 5
    assert extraction.blocks([a], same) == [f"p {i}" for i in range(10_000)]


def test_long_sibling_lists_are_cut_at_equal_subtrees():
    rnd = random.Random(6)
    items = [f"<li><i>{i}</i><b>{rnd.random()}</b></li>" for i in range(300)]
    left = [x if rnd.random() < 0.8 else "<li><i>a</i><u>%d</u></li>" % i for i, x in enumerate(items)]
    right = ["<li><i>new</i><b>%d</b></li>" % i if rnd.random() < 0.3 else x for i, x in enumerate(items)]
    a, b = (extraction.parse("<ul>" + "".join(x) + "</ul>") for x in (left, right))
    same = extraction.constant(a, b)
    kept = [x for x, k in zip(left, a.kids[0].kids) if id(k) in same]
    assert kept == [x for x, y in zip(left, right) if x == y]


@pytest.mark.parametrize("partitions", [3, 4000])
def test_fingerprints_at_any_number_of_shuffle_partitions(spark, texts, monkeypatch, partitions):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 500)
    rows = frame(spark, texts)
    want = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(rows).collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fingerprint.edited_fingerprints(rows)
        assert {r["doc_id"]: r for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for i, t in enumerate(texts):
        a, b = t or "", texts[i - 1] or ""
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert want[i]["common_prefix"] == n


def test_fingerprints_with_null_and_repeated_keys(spark):
    rows = spark.createDataFrame([(1, "one two"), (1, "one"), (None, "lost"), (None, None), (3, "three")], "doc_id long, text string")
    got = fingerprint.edited_fingerprints(rows).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (0, 4), (1, 3), (1, 7), (3, 5)]
