"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sylva.llm import bpe, exact_dedup, langid, lm, minhash, ogg, packing, quality, suffix, toxicity
from sylva.llm.library_ids import LibraryIds

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = "the of and tion ing er on an re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as".split()
COLUMNS = "doc_id long, text string, lang string, run0 string, digest string, node string, component string, h long"


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    for i in range(25):  # copies with a few words changed, some copies of copies
        words = rng.choice(texts).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    passage = prose(rng, 40)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 10) for _ in range(4)]
    texts += [texts[3], texts[3], texts[4] + "!", None, None, "", " \n\t", "ab" * 200, "x" * 99, "é" * 120, "À Ü <|endoftext|> 日本 \x1c x", prose(rng, 3000)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "x", "y", "z", "c", 1) for i, t in rows], COLUMNS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact(docs, rows, spark):
    got = by_id(exact_dedup.exact_dedup(docs))
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for i, t in rows:
        ids = groups[t or ""]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256((t or "").encode()).hexdigest())
    least = by_id(exact_dedup.exact_dedup(docs, keep="smallest"))
    assert all(least[i].keep_id == min(groups[t or ""]) for i, t in rows)
    odd = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    out = sorted(map(str, exact_dedup.exact_dedup(odd).select("doc_id", "keep_id", "group_size").collect()))
    assert out == sorted(["Row(doc_id=None, keep_id=1, group_size=3)", "Row(doc_id=1, keep_id=1, group_size=3)", "Row(doc_id=1, keep_id=1, group_size=3)", "Row(doc_id=None, keep_id=None, group_size=1)"])
    assert sorted(r.doc_id for r in exact_dedup.kept_documents(docs).collect()) == sorted(max(g) for g in groups.values())


def test_bpe(docs, rows):
    t, v = Tokenizer.from_file(PATH), bpe.vocabulary(PATH)
    got = by_id(bpe.token_digests(docs, PATH))
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert v.encode(text) == ids
        shown = t.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
    rng = random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choice("aaabeinorst hlTE'’\n\t12.,!éßΣÉİ́ 日🙂<|endoftext|>ﬁ\x85 \x1d") for _ in range(rng.randint(0, 40)))
        assert v.encode(s) == t.encode(s, add_special_tokens=False).ids, s


def test_packing(docs, rows):
    t = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH).collect()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in rows}
    pieces, sequences = {}, {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[i])
    assert set(pieces) == set(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    sizes = [random.Random(2).randint(1, 256) for _ in range(2000)]
    found = packing.windows(sizes, 2048)
    assert sorted(i for w in found for i in w) == list(range(2000)) and max(sum(sizes[i] for i in w) for w in found) <= 2048
    assert len(found) <= math.ceil(sum(sizes) / 2048) + 2
    with pytest.raises(ValueError):
        packing.windows([3000], 2048)


def test_ogg(docs, rows):
    got = by_id(ogg.media_features(docs))
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    big = random.Random(1).randbytes(200_000)
    data = ogg.mux({7: [(b"h", 0), (big, 5), (b"", 6), (b"q" * 255, 7)], 9: [(b"k", 0)]})
    back = ogg.demux(data)
    assert back[7].packets == [b"h", big, b"", b"q" * 255] and back[9].packets == [b"k"] and back[7].ended
    assert back[7].seconds(1)[-1] == 7
    for cut in (data[:-1], data[:50] + bytes([data[50] ^ 1]) + data[51:], data + b"x", data[40:]):
        with pytest.raises(ogg.OggError):
            ogg.demux(cut)
    crc = 0
    for byte in b"check":  # the definition, bit by bit
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    assert ogg.checksum(b"check") == crc


def spans_of(rows, width=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for at in range(len(b) - width + 1):
            s = b[at : at + width]
            if s in seen:
                gone[at : at + width] = b"\1" * width
            seen.add(s)
        out[i] = gone
    return out


def test_suffix(docs, rows):
    rng = random.Random(3)
    for _ in range(300):
        text = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 30))]
        assert suffix.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    got, expected = by_id(suffix.remove_repeats(docs)), spans_of(rows)
    for i, t in rows:
        b, gone = (t or "").encode(), expected[i]
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()), i
    assert sum(map(sum, expected.values())) > 500
    few = by_id(suffix.remove_repeats(docs, piece=150, texts=400, at_once=3))  # pieces, blocks and groups of the smallest sizes
    assert {i: (r.n_removed, r.n_spans, r.kept_sha256) for i, r in few.items()} == {i: (r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()}
    left = by_id(suffix.without_repeats(docs))
    assert len(left) == len(rows) and left[0].lang == "fr" and all(left[i].text == t for i, t in rows if not sum(expected[i]))


def test_suffix_odd_rows(spark):
    rng = random.Random(12)
    line, passage = prose(rng, 14)[:88], prose(rng, 60)
    rows = [(i, prose(rng, 8) + line + prose(rng, 8)) for i in range(40)]  # one common line, too short to go, in different surroundings
    rows += [(100 + i, prose(rng, 6) + " " + passage[i:] + prose(rng, 6)) for i in range(25)]
    rows += [(200, "ab" * 300), (201, "ab" * 300), (202, "ba" * 70), (203, "\u00e9" * 300), (204, line * 3), (205, "\x00" * 250)]
    thue = "0"
    for _ in range(11):
        thue += thue.translate(str.maketrans("01", "10"))
    rows += [(300, thue[:1024]), (301, thue[1024:])]  # polynomial hashes modulo 2^64 take such texts for each other
    same = rows[45]
    df = spark.createDataFrame([*rows, same, (None, passage), (None, passage)], "doc_id long, text string")
    for how in ({}, {"at_once": 4, "texts": 500, "piece": 130}):
        got = suffix.remove_repeats(df, **how).collect()
        expected = spans_of(rows)
        for r in got:
            if r.doc_id is not None:
                b = dict(rows)[r.doc_id].encode()
                kept = bytes(x for x, g in zip(b, expected[r.doc_id], strict=True) if not g)
                assert (r.n_removed, r.kept_sha256) == (sum(expected[r.doc_id]), hashlib.sha256(kept).hexdigest()), (r.doc_id, how)
            else:
                assert r.n_removed > 0
        assert len(got) == len(rows) + 3
    wide = df.selectExpr("*", "text as spans", "1 as did", "'x' as __did")
    left = suffix.without_repeats(wide)
    assert left.columns == wide.columns and left.count() == len(rows) + 3


def test_minhash(docs, rows):
    got = by_id(minhash.near_duplicates(docs))
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and least[j] < least[i]:
                    least[i], changed = least[j], True
    expected = {i: (len(sets[i]), least[i], least[i] == i) for i in sets}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == expected
    parts = by_id(minhash.near_duplicates(docs, members=2, at_once=60))  # every group in many parts
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in parts.items()} == expected
    assert sorted(r.doc_id for r in minhash.one_of_each(docs).collect()) == sorted(i for i in least if least[i] == i)


def test_minhash_finds_pairs_at_the_threshold(spark):
    rng, rows, linked = random.Random(11), [], []
    for k in range(150):  # of n words the last d differ: n - d - 4 shingles in common, d in each alone
        n = rng.randint(30, 200)
        d = min(d for d in range(n) if 100 * (n - 4 - d - 1) < 75 * (n - 4 + d + 1)) + k % 2  # just enough in common, or not quite
        words = [f"w{k}x{i}" for i in range(n)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: n - d] + [f"{w}y" for w in words[n - d :]]))]
        linked.append(100 * (n - 4 - d) >= 75 * (n - 4 + d))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[2 * k + 1].component_id == 2 * k for k in range(150)] == linked and 50 < sum(linked) < 100


def test_minhash_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, text), (4, text), (4, text), (9, text.upper()), (2, "x"), (3, "X"), (5, None)]
    got = sorted(map(str, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()))
    expected = [(None, None, True), (None, None, True), (4, 4, True), (4, 4, True), (9, 4, False), (2, 2, True), (3, 2, False), (5, 5, True)]
    assert got == sorted(f"Row(doc_id={a}, component_id={b}, kept={c})" for a, b, c in expected)


def test_language(spark):
    rng = random.Random(4)
    words = {"aa": ["kala", "mina", "tuo", "on", "ja"], "bb": ["wer", "sch", "und", "zeit", "pf"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 !?", None), (503, "ZEIT und wer pf", None), (504, "sch " * 3000, None)]
    got = by_id(langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i].lang_pred == lang for i, t, lang in rows[:120]) and got[503].lang_pred == got[504].lang_pred == "bb"
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (500, 501, 502))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())

    def phrases(text, known):
        n = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in known:
                size += 1
            n, at = n + 1, at + size
        return n

    p = langid.Parser(("aa", "bb"), ("kala mina tuo", "wer sch und"))
    text = "kalamin und tuosch"
    assert p.phrases([p.symbols(text)]).tolist() == [[phrases(text, "kala mina tuo"), phrases(text, "wer sch und")]]
    # whatever the blocks, counts are those of one parse of the whole text; letters outside the alphabet are spelled
    known = ("".join(rng.choice("abcde 日本語中文字") for _ in range(300)), "".join(rng.choice("abéèæ 国語") for _ in range(300)))
    squeezed = [re.sub(r"[^\w]+", " ", k) for k in known]
    some = ["".join(rng.choice("abcde 日本国語中é") for _ in range(rng.choice([0, 1, 30, 400]))) for _ in range(20)] + [known[0][20:280], "zz" + known[1][:100]]
    for letters, block in ((200, 2048), (200, 7), (200, 1), (3, 2048), (3, 5)):
        p = langid.Parser(("aa", "bb"), known, letters, block)
        got = p.phrases([p.symbols(t) for t in some]).tolist()
        if letters == 200:
            assert got == [[phrases(re.sub(r"[^\w]+", " ", t), k) for k in squeezed] for t in some]
        else:
            names = [c for c in "".join(sorted(set("".join(known)))) if c.isalpha()]
            count = Counter(c for k in known for c in k if c.isalpha())
            own = set(sorted(names, key=lambda c: (-count[c], c))[:3])
            spell = lambda t: "".join(c if c in own or not c.isalpha() else c.encode().decode("latin-1") for c in re.sub(r"[^\w]+", " ", t))
            assert got == [[phrases(spell(t), spell(k)) for k in squeezed] for t in some]
    whole = langid.Parser(("aa",), ("".join(rng.choice("abcdefgh") for _ in range(9000)),))
    assert whole.phrases([whole.symbols("")]).tolist() == [[0]]


def test_language_learned_from_long_texts_only(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 20_000 if i % 2 else 30), "long" if i % 2 else "brief") for i in range(12)]
    rows = [(i, t if i % 2 else t.replace("e", "ö"), lang) for i, t, lang in rows]
    languages, texts = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=5000)
    assert languages == ("brief", "long") and all(0 < len(t) <= 5000 for t in texts)
    tie = langid.Parser(("aa", "bb"), ("same text", "same text"))
    assert tie.predict(["same"])[0][0] == "aa"


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        words = prose(rng, 30).split()
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["scoundrel", "blockhead"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, "you are a scoundrl indeed"), (1001, 'they said the word "scoundrel" is old'), (1002, None), (1003, ""), (1004, "you scoundrel blockhead")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert all(got[i].predicted == y for i, y in labels)
    assert got[1000].predicted == 1 and got[1004].predicted == 1 and got[1001].score < got[1000].score
    assert got[1002].predicted == got[1003].predicted == 0
    clean = toxicity.clean_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, r in got.items() if r.score < 0.7)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    terms = ["ab", "abcd", "bcda", "abcdabcd"]
    machine = toxicity.Machine(sorted(terms))
    for _ in range(2000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 10)))
        near = [(d, i) for i, t in enumerate(sorted(terms)) if (d := distance(w, t)) <= toxicity.edits_for(t)]
        assert machine.nearest(w) == min(near, default=None), w
    machine.most_moves = 5  # forgets what it knows at nearly every word
    for _ in range(300):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 10)))
        near = [(d, i) for i, t in enumerate(sorted(terms)) if (d := distance(w, t)) <= toxicity.edits_for(t)]
        assert machine.nearest(w) == min(near, default=None), w


def test_quality(spark, docs, nothing):
    rng = random.Random(7)
    rows = [(i, prose(rng, 40) if i % 4 else " ".join(["$$$"] * 40)) for i in range(200)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(100)], "doc_id long, quality int")
    got = by_id(quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), labels))
    assert sum(r.kept for r in got.values()) == math.ceil(0.75 * len(rows))
    assert all(not got[i].kept for i in range(0, 200, 4)) and got[900].log_weight == 0 and got[901].n_grams == 0
    keys = spark.createDataFrame([(i, float(i % 50)) for i in range(1000)], "doc_id long, key double")
    ordered = sorted(((i % 50, -i) for i in range(1000)), reverse=True)
    for k in (1, 7, 500, 1000):
        assert quality.threshold(keys, k, enough=10) == (float(ordered[k - 1][0]), -ordered[k - 1][1])


def test_lm(docs, rows):
    got = by_id(lm.scores(docs, hot=50))
    counts, ends, words = Counter(), 0, {}
    for i, t in rows:
        words[i] = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words[i])
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for i, ws in words.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws) + 1, sum(w in counts for w in ws) + 1, n)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score < 0
    for n in (1, 5, 50):
        model = lm.Model(np.full(n, 1 / n), 4, 2)
        context, target = np.array([[0] * 400, [n - 1] * 400]), np.arange(400) % n
        model.train(context, target, np.random.default_rng(1), 0.1, batch=64)
        logs = model.log_probabilities(context[:, :n], np.arange(n))
        assert np.exp(logs).sum() == pytest.approx(1, rel=1e-5)
        before = model.rows(np.arange(n + model.clusters))
        model.put(np.arange(len(before)), before)
        assert (model.rows(np.arange(len(before))) == before).all()


def test_lm_beats_counts_on_held_out_texts(spark):
    got = [r for r in lm.scores(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect() if r.held_out]
    assert len(got) > 20 and sum(r.score > r.base_score for r in got) >= 0.9 * len(got)


def test_frequent_words(spark):
    counts = Counter({f"w{i}".encode(): 1 + 1000 // (i + 1) for i in range(500)})
    df = spark.createDataFrame(list(counts.items()), "word binary, c long")
    for most in (0, 3, 50, 500):
        found = lm.frequent(df, most)
        assert len(found) <= most and found.items() <= counts.items()
        assert not found or min(found.values()) >= max((c for w, c in counts.items() if w not in found), default=0)
    assert lm.frequent(df, 500) == counts and len(lm.frequent(df, 50)) > 40


def test_empty_tables(nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for out in (exact_dedup.exact_dedup(nothing), bpe.token_digests(nothing, PATH), packing.pack(nothing, PATH), ogg.media_features(nothing), langid.identify(nothing), toxicity.toxicity(nothing, labels), quality.quality(nothing, labels)):
        assert out.count() == 0


def test_empty_tables_of_stored_operators(nothing):
    for out in (suffix.remove_repeats(nothing), minhash.near_duplicates(nothing), lm.scores(nothing)):
        assert out.count() == 0


def test_library_ids_of_pieces():
    whole = Tokenizer.from_file(PATH)
    whole.no_truncation()
    whole.no_padding()
    texts = ["", None, " ", "it's I'll we've", "a\x1cb\x85c\xa0d e", "<|endoftext|>x <|startoftext|>", "ΣΑΣ İstanbul ß é", "x\u0301 \u0301a", "1234 ２３ ½", "日本語テキスト", "\x00\x01 \u200b", "👍🏽", "</w> <w/>", "word " * 3000]
    ids = LibraryIds(PATH, at_once=3, limit=4)  # small tables, many calls
    for _ in range(4):
        offsets, found = bpe.batch_ids(pa.array(texts, pa.string()), ids.of)
        for i, t in enumerate(texts):
            assert found[offsets[i] : offsets[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_scored_blanks_and_rare_words():
    classes = lm.Classes([b"a", b"b"], 4)
    totals = [5.0 - i / 10 for i in range(classes.size)][::-1]
    totals = np.array(totals)[classes.ranked(np.array(totals))].tolist()
    model = lm.Model(np.array(totals) / sum(totals), 4, 3)
    scorer = lm.Scorer(classes, {b"a": 3, b"b": 2}, np.array(totals), np.array(totals), model).ready()
    texts = ["", " ", None, "a", "  a b ", "x a X\ty", "\n", "zz zz a q", "ＡÉ é "]
    n, known, _, score, rare, times = (c.to_pylist() if isinstance(c, pa.Array) else c.tolist() for c in scorer.batch(pa.array(texts)))
    for i, t in enumerate(texts):
        words = Counter(lm.words(t))
        assert (n[i], known[i]) == (sum(words.values()) + 1, words[b"a"] + words[b"b"])
        assert dict(zip(rare[i], times[i], strict=True)) == {w: c for w, c in words.items() if w not in (b"a", b"b")}
        assert score[i] == pytest.approx(scorer.batch(pa.array([t], pa.string()))[3][0], abs=1e-4)


def test_toxicity_misspelled_beginnings(spark):
    rng = random.Random(8)
    terms = ["scoundrel", "blockhead", "nincompoop"]
    rows, labels = [], []
    for i in range(300):
        words = prose(rng, 30).split()
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(terms)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    odd = ["skoundrel", "csoundrel", "bolckhead", "lockhead", "plokhead", "mincompoop", "nnicompoop", "ninkompop"]  # one or two edits, in the first five letters but for the last
    rows += [(1000 + i, f"you are a {w} indeed") for i, w in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, table)
    assert set(terms) <= set(model.weights)
    few = toxicity.learn(docs, table, terms=3)  # stems take no places from words
    assert set(terms) <= set(few.weights) and any(t.endswith("*") for t in few.weights)
    got = by_id(toxicity.score(docs, model))
    assert [got[1000 + i].predicted for i in range(len(odd))] == [1] * len(odd)


def test_lm_trains_on_all_training_documents(docs, rows, monkeypatch):
    given, averaged = [], lm.averaged
    monkeypatch.setattr(lm, "averaged", lambda some, *how: given.append(Counter(r.text for r in some.collect())) or averaged(some, *how))
    assert lm.scores(docs, hot=50).count() == len(rows)
    assert given and all(g == Counter(t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2) for g in given)


def test_lm_scores_in_a_small_space():
    rng = np.random.default_rng(5)
    n, order, tokens = 3000, 3, 40_000
    model = lm.Model(np.sort(rng.random(n) + 1e-3)[::-1] / n, 8, order)
    context, target = rng.integers(0, n, (order, tokens)), rng.integers(0, n, tokens)
    tracemalloc.start()
    got = model.log_probabilities(context, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # numbers of a core's cache, and some for each token; whole blocks of scores took 11 MB

    def plain(c, w):
        q = sum(model.before[i, c[i]].astype(float) for i in range(order))
        low = w // model.width * model.width
        tops, own = model.tops @ q + model.top_bias, model.vectors[low : low + model.width] @ q + model.bias[low : low + model.width]
        return tops[w // model.width] - np.logaddexp.reduce(tops) + own[w - low] - np.logaddexp.reduce(own)

    some = range(0, tokens, 400)
    assert [got[i] for i in some] == pytest.approx([plain(context[:, i], target[i]) for i in some], abs=1e-4)
    for far in (300, -300):  # scores whose exponentials are no floats of 32 bits
        model.top_bias += np.float32(far)
        model.bias -= np.float32(far)
        got = model.log_probabilities(context[:, :50], target[:50])
        assert got == pytest.approx([plain(context[:, i], target[i]) for i in range(50)], abs=1e-2)
        model.top_bias -= np.float32(far)
        model.bias += np.float32(far)
    model.tops[0] *= 3000  # sums of very different sizes, side by side
    model.vectors[:200] *= 3000
    got = model.log_probabilities(context[:, :500], target[:500])
    assert np.isfinite(got).all() and got == pytest.approx([plain(context[:, i], target[i]) for i in range(500)], abs=1e-2, rel=1e-4)


def test_lm_sums_and_places():
    rng = np.random.default_rng(6)
    for shape in ((900, 6), (900, 5), (900,), (1, 4), (1,)):
        rows, grads = rng.integers(0, 40, shape[0]) ** 2, rng.standard_normal(shape).astype(np.float32)
        whole = np.zeros((1600, *shape[1:]), np.float32)
        np.add.at(whole, rows, grads)
        found, sums = lm.sums_by(rows, grads, 1600)
        assert found.tolist() == sorted(set(rows.tolist())) and sums.dtype == np.float32
        assert sums == pytest.approx(whole[found], abs=1e-4)
    for n in (1, 5, 300):
        cut = np.append(0, np.cumsum(rng.random(n) ** 4))
        x = np.concatenate([rng.random(3000) * cut[-1], cut])
        assert (lm.Places(cut).of(x) == np.searchsorted(cut, x, "right") - 1).all()
    classes = lm.Classes([b"a", b"bcd"], 3)
    some = [b"a", b"xbcd", b"bcd", b"", b"q", b"yxbcd"]
    assert classes.of_all(some).tolist() == [classes.of(w) for w in some] and len(classes.of_all([])) == 0


def test_lm_counts(spark):
    texts = ["a A  b\n", " ", None, "", "b\ta", "É é", "ab" * 50 + " b"]
    for most in (1, 1000):
        got = {bytes(r.word): r.c for r in lm.counts_of(spark.createDataFrame([(t,) for t in texts], "text string"), most).collect()}
        assert got == Counter(w for t in texts for w in lm.words(t))
