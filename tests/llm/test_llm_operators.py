"""The corpus operators against brute force on small tables: nulls, blanks, ties, repeats, empty tables and foreign columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from carepath.llm import digest_index, html_text, language, license_scan, line_dedup, mixing, near_dup, packing, prefix_counts, quality
from carepath.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, component_id string, size string"
SYLLABLES = "an be co da en fi go ha in ka lo me no or pa re so ta un vi".split()


def prose(r, n, vocabulary=400):
    words = ["".join(random.Random(k).choices(SYLLABLES, k=1 + k % 3)) for k in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = [prose(r, r.randint(1, 120)) for _ in range(60)]
    base = prose(r, 200)
    for k in range(40):  # near copies that form chains
        words = base.split()
        for _ in range(k % 9):
            words[r.randrange(len(words))] = "changed" + str(r.randrange(50))
        texts.append(" ".join(words))
    texts += [texts[0]] * 5 + [texts[1].upper(), " " + texts[2] + "\n", None, "", " \t\n", "a", "A b", "123 ###", "é" * 30, "x " * 3000]
    texts += ["Released under the MIT License.\nApache License, Version 2.0", "cc by nc cc-by-nc", "under the mit license " * 3]
    langs = ["en", "fr", None]
    out = [(i, t, langs[i % 3], f"s{i % 4}" if i % 7 else None, None, 1.0, False, "x", "y") for i, t in enumerate(texts)]
    return out + [out[3], (None, "no id", "en", "s1", 3, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    prepare(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, text string")


# ---- 1


def test_language(spark, empty):
    r = random.Random(1)
    words = {"xx": ["alpha", "beta", "gamma"], "yy": ["uno", "dos", "tres"]}
    data = [(i, " ".join(r.choices(words[k], k=30)), k) for i in range(200) for k in (("xx", "yy")[i % 2],)] + [(900, None, "xx"), (901, "12 34", "yy"), (902, "", None), (903, "uno dos " * 9000, None), (904, "你好世界", None)]
    got = {x["doc_id"]: x for x in language.language_id(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(data)
    assert all(got[i]["lang_pred"] == k for i, _, k in data[:200])
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "yy" and got[904]["rejected"]
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert language.language_id(empty).count() == 0
    none = language.language_id(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).first()
    assert none["lang_pred"] == "und" and none["score"] == 0


def test_language_left_out_of_training_is_rejected(spark):
    r = random.Random(8)
    kinds = {"xx": "ba de ki lo nu pra ste".split(), "yy": "ort ung ein sch af il".split(), None: "ba de ki lo nu zon wex".split()}
    text = lambda k: " ".join("".join(r.choices(kinds[k], k=r.randint(1, 4))) for _ in range(60))
    data = [(i, text(k), k) for i in range(600) for k in (["xx", "yy", None][i % 3],)]
    got = language.language_id(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    lang = {i: k for i, _, k in data}
    assert all(x["rejected"] == (lang[x["doc_id"]] is None) for x in got)


def test_language_against_naive_vectors(spark):
    """Every prediction again, from grams counted one by one; repeated rows, many languages and clashing columns."""
    r = random.Random(3)
    kinds = [r.sample(SYLLABLES, 8) for _ in range(5)]
    data = [(i if i % 17 else None, "".join(" " * (r.random() < 0.3) + r.choice(kinds[i % 5]) for _ in range(r.randint(0, 60))), f"l{i % 5}" if i % 4 else None, "x", 0.5) for i in range(300)]
    data += [data[1], data[1], (900, "É" * 40, None, "x", 1.0)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, __lang string, share double")
    model = language.fit(df, ~language.held_out())

    def naive(t):
        if not any(c.isalpha() for c in t):
            return "und", 0.0
        b, n = b" " + t.lower().encode() + b" ", Counter()
        for k in range(len(b) - 1):
            n[((int.from_bytes(b[k : k + 2], "big") + 0x01000000) * 2654435761 % 2**32) >> 19] += 1
        for k in range(len(b) - 2):
            n[(int.from_bytes(b[k : k + 3], "big") * 2654435761 % 2**32) >> 19] += 1
        v = {c: math.log1p(x) * float(model.idf[c]) for c, x in n.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(center[c]) for c, x in v.items()) / norm for center in model.centroids]
        k = max(range(len(cosines)), key=cosines.__getitem__)
        return model.langs[k], cosines[k]

    got = sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["lang_pred"], round(x["score"], 4)) for x in language.language_id(df).collect()))
    want = sorted((i is None, i or 0, *(lambda a: (a[0], a[1]))(naive(t))) for i, t, *_ in data)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) >= len(want) - 1  # two centroids may tie in the last bit
    assert all(abs(g[3] - w[3]) < 2e-3 for g, w in zip(got, want, strict=True) if g[2] == w[2] and not g[0])


def test_more_languages_than_rows_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "ROWS", 20)
    data = [(i, f"{'abcdefghij'[i % 10] * 5} {i} word", f"l{i % 40:02}") for i in range(400)]
    got = language.language_id(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    assert len(got) == 400 and all(x["lang_pred"] in {f"l{k:02}" for k in range(40)} for x in got)


# ---- 2


def shingles(text, width):
    ws = (text or "").encode().lower().split()
    return frozenset(tuple(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))) if ws else frozenset()


def brute(rows, width, percent):
    sets = [(r[0], shingles(r[1], width)) for r in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        least[find(k)].append(i)
    return [(i, len(s), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, s) in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent", "small"), [(3, 85, 32), (5, 80, 4)])
def test_near_duplicates(docs, rows, empty, width, percent, small, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", small)  # a small bound sends the copies through the blocks
    monkeypatch.setattr(near_dup, "BLOCK", 8 if small == 4 else 128)
    monkeypatch.setattr(near_dup, "OUTSIDERS", 2 if small == 4 else 1024)  # and through second bands
    got = near_dup.near_duplicates(docs, width=width, percent=percent).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=key) == sorted(brute(rows, width, percent), key=key)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


def test_near_duplicates_empty(empty):
    assert near_dup.near_duplicates(empty).count() == 0


def test_bucket_of_unlike_classes_stays_linear(spark):
    """Thousands of classes that one passage brought into a bucket: only those that share a second band are compared."""
    import numpy as np

    draw = np.random.default_rng(3)
    n = 4000
    sig = draw.integers(0, 2**32, (n, near_dup.HASHES), dtype=np.uint32).astype("<u4")
    sig[:, : near_dup.ROWS] = 7  # all agree in band 0
    for k in range(0, 40, 2):  # twenty pairs are alike
        sig[k + 1] = sig[k]
        sig[k + 1, draw.integers(near_dup.ROWS, near_dup.HASHES, 6)] += 1
    keys = [bytearray(f"{k:016}".encode()) for k in range(n)]
    classes = spark.createDataFrame(list(zip(keys, (bytearray(s.tobytes()) for s in sig), strict=True)), "key binary, sig binary").cache()
    large = classes.selectExpr("5L AS bucket", "0 AS band", "key", f"{n}L AS n", "sig")
    labels = spark.createDataFrame([(keys[k], keys[0]) for k in range(100, 2500)], "node binary, root binary")
    live = near_dup._outsiders(large, labels)
    assert live.count() == n and live.where("out").count() == n - 2401
    again = near_dup._meeting_again(live)
    assert again.count() < 40 * near_dup.BANDS
    got = near_dup._few_pairs(again, classes, 80).collect()
    assert sorted((int(x["a"]), int(x["b"])) for x in got) == [(k, k + 1) for k in range(0, 40, 2)]


def test_bayes_table_keeps_what_is_likely():
    for percent in (80, 85):
        least = near_dup.least_matches(percent)
        n = near_dup.HASHES
        lost = sum(math.comb(n, k) * (percent / 100) ** k * (1 - percent / 100) ** (n - k) for k in range(least[-1]))
        assert lost < 1e-3 and list(least) == sorted(least)


def test_deduplicated_keeps_one_of_each_group(docs, rows):
    kept = near_dup.deduplicated(docs, width=3, percent=85)
    assert kept.columns == docs.columns
    ids = [x["doc_id"] for x in kept.collect()]
    want = {c for i, _, c in brute(rows, 3, 85)} | {i for i, n, c in brute(rows, 3, 85) if n == 0}
    assert sorted(ids, key=lambda x: (x is None, x)) == sorted(want, key=lambda x: (x is None, x))


def test_deduplicated_tells_rows_apart_by_id_and_text(spark):
    r = random.Random(9)
    a, b, c, d, e = (prose(r, 60) for _ in range(5))
    data = [(1, a), (None, a + " end"), (None, b), (None, c), (None, c), (None, c + " end"), (7, a), (7, d), (7, e), (8, d), (None, ""), (None, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    kept = Counter((x["doc_id"], x["text"]) for x in near_dup.deduplicated(df).collect())
    of_c = {(None, c), (None, c + " end")} & set(kept)
    assert len(of_c) == 1 and kept == Counter([(1, a), (None, b), *of_c, (7, d), (7, e), (None, ""), (None, "")])


# ---- 3


def test_license_scan(docs, rows, empty):
    import re

    got = defaultdict(list)
    for x in license_scan.license_scan(docs).collect():
        got[x["doc_id"]].append(x)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))
    for i, t, *_ in rows:
        ws, x = cut(t or ""), got[i][0]
        places = sorted((k, label) for p, label in license_scan.PHRASES.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split())
        assert (x["n_words"], x["n_base"]) == (len(ws), len(places))
        assert (x["first_word"], x["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = {label for _, label in places}
        blocks = [set(ws[k : k + license_scan.WINDOW]) for k in range(0, len(ws), license_scan.STRIDE)]
        found = {label for label, u, must in license_scan.TEMPLATES for b in blocks if b >= set(must.split()) and len(b & set(u.split())) >= license_scan.CONTAINED * len(set(u.split())) - 1e-9}
        assert x["base_labels"] == ",".join(sorted(base)) and x["labels"] == ",".join(sorted(base | found))
    assert license_scan.license_scan(empty).count() == 0


def test_license_blocks_cross_lines_and_labels_are_told_apart(spark):
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software\nand associated documentation files"
    filler = " ".join(f"w{k}" for k in range(200))
    data = [(1, mit), (2, f"{filler} {mit.replace(chr(10), ' ')} {filler}"), (3, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY-SA 4.0."), (5, "Released under the BSD License"), (6, "under the M\u0130T license"), (7, "wor\u212A under"), (8, "permission granted " + filler + " charge software copy")]
    got = {x["doc_id"]: x for x in license_scan.license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[k]["labels"] for k in range(1, 9)] == ["mit", "mit", "cc-by-nc", "cc-by-sa", "bsd", "", "", ""]
    assert all(len(t.split()) <= license_scan.WINDOW - license_scan.STRIDE and set(m.split()) <= set(t.split()) for _, t, m in license_scan.TEMPLATES)


def test_license_scan_has_no_python(docs):
    plan = license_scan.license_scan(docs)._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))


# ---- 4


def test_token_counts(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = {x["doc_id"]: x for x in prefix_counts.token_counts(docs).collect()}
    for i, t, *_ in rows:
        t = t or ""
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(t.encode()), n(t), n(t) > 512)
        assert n(t[: got[i]["fit_chars"]]) <= 512
    assert prefix_counts.token_counts(empty).count() == 0
    counter = prefix_counts.counter("byte_bpe_50k.json")
    r = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'ll", "'", "\r\n", "e\u0301", "é", "1", "the", " of", "!!", "\t", "<|endoftext|>", "<|", "中", "😀", "\xa0", "　"]
    for _ in range(300):
        s = "".join(r.choices(parts, k=r.randint(0, 12)))
        want = [n(s[:k]) for k in range(len(s) + 1)]
        assert counter.prefixes(s) == want and counter.count(s) == want[-1]
        assert counter.longest_prefix(s, 3) == max(k for k, m in enumerate(want) if m <= 3)


def test_prefix_tables_and_long_words(spark, docs, rows):
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(12)
    word = "".join(r.choice("abcdefgh01") for _ in range(900))
    some = spark.createDataFrame([(1, word), (2, None), (3, "a  b's " * 20)], "doc_id long, text string")
    tables = {x["doc_id"]: x for x in prefix_counts.prefix_counts(some).withColumn("fit", prefix_counts.fitting(F.col("counts"), F.lit(10))).collect()}
    for i, t in ((1, word), (2, ""), (3, "a  b's " * 20)):
        want = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert tables[i]["counts"] == want and tables[i]["fit"] == max(k for k, n in enumerate(want) if n <= 10)
    counter, start = prefix_counts.counter("byte_bpe_50k.json"), time.time()
    for t in ("".join(r.choice("abcdefgh01") for _ in range(300_000)), " " * 300_000, "word " * 60_000, "=-" * 150_000):
        k = counter.longest_prefix(t, 512)
        assert len(library.encode(t[:k], add_special_tokens=False).ids) <= 512 and len(library.encode(t[: k + 1], add_special_tokens=False).ids) > 512
    assert time.time() - start < 60


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op5", "op8", "op10"])
def test_what_is_no_utf8_is_read(spark, name):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF20' AS STRING) AS text, 'en' AS lang, 'u' AS url UNION ALL SELECT 2L, 'a b', 'en', 'u'")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    run = {"op1": language.language_id, "op2": near_dup.near_duplicates, "op4": prefix_counts.token_counts, "op5": lambda d: quality.quality_rules(d, labels), "op8": lambda d: html_text.extract(d, id_col="doc_id", html_col="text"), "op10": packing.packed}[name]
    assert run(df).count() == 2


# ---- 5


def test_quality_score_by_hand(spark):
    r = random.Random(21)
    data = [(i, prose(r, r.randint(0, 60), 40 if i % 3 else 90)) for i in range(60)] + [(None, prose(r, 30)), (7, prose(r, 30))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40)], "doc_id long, quality int")
    mask, hashed = (1 << 64) - 1, lambda w: __import__("xxhash").xxh3_64_intdigest(w.encode())

    def cells(t):
        ids = [hashed(w) for w in t.split()]
        out = [(i >> 32) % quality.CELLS for i in ids]
        for a, b in zip(ids, ids[1:], strict=False):
            h = (a * 0x9E3779B97F4A7C15 & mask) ^ b
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & mask
            out.append((h >> 32) % quality.CELLS)
        return out

    raw, good = Counter(), Counter()
    for i, t in data:
        raw.update(cells(t))
        good.update(cells(t) if i is not None and i < 40 and i % 2 else [])
    rate = lambda c, k: (c[k] + quality.SMOOTH) / (sum(c.values()) + quality.SMOOTH * quality.CELLS)
    want = sorted((i is None, i or 0, round(sum(math.log(rate(good, k) / rate(raw, k)) for k in cells(t)) / max(1, len(cells(t))), 9)) for i, t in data)
    got = quality.quality_rules(spark.createDataFrame(data, "doc_id long, text string"), labels).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, round(x["score"], 9)) for x in got) == want
    assert len({s for *_, s in want}) > 20


def test_quality_of_texts_with_names_for_ids(spark, docs, rows):
    labels = spark.createDataFrame([(f"d{k}", k % 2) for k in range(60)], "doc_id string, quality int")
    by_name = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    got = {(x["doc_id"], x["score"]) for x in quality.quality_rules(by_name, labels).collect()}
    numbers = labels.select(F.substring("doc_id", 2, 9).cast("long").alias("doc_id"), "quality")
    want = {(None if x["doc_id"] is None else f"d{x['doc_id']}", x["score"]) for x in quality.quality_rules(docs, numbers).collect()}
    assert got == want
    assert len({score for _, score in got}) > 5


def test_quality(spark, docs, rows, empty):
    import re

    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (20, 0)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.quality_rules(docs, labels).collect()}
    for i, t, *_ in rows:
        t, x = t or "", got[i]
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
        again = {k + j for k in range(len(ws) - 7) if windows[tuple(ws[k : k + 8])] > 1 for j in range(8)}
        lines = [s for s in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert x["base_failed"] == (len(ws) < 20 or 100 * len(again) > 30 * len(ws))
        assert x["kept"] == (not x["base_failed"] and x["score"] >= quality.THRESHOLD)
    assert quality.quality_rules(empty, labels).count() == 0
    assert {x["score"] for x in quality.quality_rules(docs, labels.limit(0)).collect()} == {0.0}


# ---- 6


@pytest.mark.parametrize("merged", [False, True])
def test_line_dedup(spark, empty, monkeypatch, merged):
    rule = {"merge_copies": True, "fewest_hits": 3} if merged else {}
    fewest = rule.get("fewest_hits", line_dedup.FEWEST_HITS)
    data = [(i, f"Menu of the site\nstory {i} of many words to read\n\n Menu of the site ", "h") for i in range(30)] + [(100 + i, f"Menu of the site\nfew pages {i}", "small") for i in range(3)]
    data += [(200 + i, "the very same text", "copies") for i in range(30)] + [(300, None, "h"), (301, "", None), (302, "only two\nx", "two"), (303, "only two\ny", "two"), (4, data[4][1], "h")]
    data += [(400 + i, f"first\n{'long line ' * 20000}\n{i}", "long") for i in range(4)]
    df = spark.createDataFrame([(*d, 1, "u") for d in data], "doc_id long, text string, source string, __host int, row string")
    pages, hits = defaultdict(set), defaultdict(set)
    for k, (_, t, h) in enumerate(data):
        page = (t or "") if merged else k
        pages[h].add(page)
        for line in (t or "").split("\n"):
            hits[h, line.strip()].add(page)
    gone = {(h, x) for (h, x), ts in hits.items() if x and len(ts) >= fewest and len(ts) > line_dedup.RATIO * len(pages[h])}
    stay = lambda t, h: [x for x in t.split("\n") if (h, x.strip()) not in gone]
    want = sorted(((i, None, 0, 0, h) if t is None else (i, "\n".join(stay(t, h)), t.count("\n") + 1, t.count("\n") + 1 - len(stay(t, h)), h)) for i, t, h in data)
    rows = lambda df: sorted((x["doc_id"], x["text"], x["n_lines"], x["n_dropped"], x["source"]) for x in df.collect())
    assert rows(line_dedup.line_dedup(df, **rule)) == want
    by = {x[0]: x for x in want}
    assert by[5][1] == "story 5 of many words to read\n" and by[100][1] == "few pages 0" and by[400][1] == "0"
    assert (by[201][1], by[302][1]) == (("the very same text", "only two\nx") if merged else ("", "x"))
    assert line_dedup.cleaned(df).select("row.*").columns == df.columns
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    monkeypatch.setattr(line_dedup, "SALT_PAGES", 7)
    assert rows(line_dedup.line_dedup(df, **rule)) == want
    assert line_dedup.line_dedup(empty, **rule).count() == 0


# ---- 7


def test_mix(docs, rows, empty):
    got = mixing.mixed(docs).collect()
    sizes = Counter()
    for i, t, _, s, *_ in rows:
        sizes[s] += len((t or "").encode().split())
    goal = mixing.targets(sizes)
    assert len(got) == len(rows) and abs(sum(goal.values()) - sum(sizes.values())) < 1e-6
    assert [s for s in sorted(goal, key=lambda s: (s is None, s or ""))][-1] is None
    by, source = defaultdict(lambda: [0, 0]), {r[0]: r[3] for r in rows}
    for x in got:
        assert 0 <= x["taken"] <= 3 * x["size"] and (x["size"] == 0 or x["taken"] % x["size"] == 0)
        b = by[source[x["doc_id"]]]
        assert x["target"] == pytest.approx(goal[source[x["doc_id"]]])
        b[0] += x["taken"]
        b[1] = max(b[1], x["size"])
    assert all(abs(taken - target) <= largest for target, (taken, largest) in ((goal[s], b) for s, b in by.items()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(5)).collect()))
    assert mixing.mixed(empty).count() == 0
    out = mixing.mix_rows(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(x["times"] for x in got)


@pytest.mark.parametrize("ids", ["half null", "all null", "one id", "one row"])
def test_mix_takes_rows_with_null_and_repeated_ids_one_by_one(spark, ids):
    r = random.Random(9)
    data = []
    for k in range(900):
        s, i = "ab"[k % 2], {"half null": None if k % 2 else k, "all null": None, "one id": 7, "one row": 7}[ids]
        data.append((i, "the same words " * 2 if ids == "one row" else prose(r, r.randint(1, 12)), s))
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    got, sizes = mixing.mixed(docs).collect(), Counter()
    for _, t, s in data:
        sizes[s] += len(t.split())
    goal = mixing.targets(sizes)
    by = {g: s for s, g in goal.items()}
    taken = Counter()
    for x in got:
        taken[min(by.items(), key=lambda g: abs(g[0] - x["target"]))[1]] += x["taken"]
        assert x["taken"] <= 3 * x["size"]
    assert len(got) == 900 and all(abs(taken[s] - goal[s]) <= 12 for s in goal)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(5)).collect()))
    assert mixing.mix_rows(docs).count() == sum(x["times"] for x in got)


def test_mix_of_many_sources_stays_a_table(docs, monkeypatch):
    want = sorted(map(str, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 0)
    assert sorted(map(str, mixing.mixed(docs).collect())) == want
    assert mixing.mixed(docs, weight=F.col("score")).count() == len(want)


def test_targets_share_what_is_over():
    assert mixing.targets({"a": 10, "b": 10, "c": 80}) == pytest.approx({"a": 30, "b": 30, "c": 40})
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


# ---- 8


def test_pages(spark):
    article = "<article><h1>Title &amp; more</h1><p>First  para\nof <b>te</b>xt.<br>Next <p>Short.<div class='ad'>Buy this now please</div><p>Last &lt;one&gt;&nbsp;here with a few more words.</article>"
    whole = f"<html><head><title>t</title><script>var x='<p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>{article}<div id=comments><p>I disagree with all of it</p></div><footer>(c) site</footer>"
    data = [(1, "u", whole, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "<p>" * 3000 + "deep", "t"), (5, "u", "<a href='x>broken <b", "t"), (1, "u", whole, "t")]
    got = defaultdict(list)
    for x in html_text.extract(pages(spark, data)).collect():
        got[x["page_id"]].append(x)
    assert [x["text"] for x in got[1]] == ["Title & more First para of text. Next Short. Last <one> here with a few more words."] * 2
    assert got[2][0]["text"] == "" and got[3][0]["n_chars"] == 0 and len(got) == 5
    assert all(x["n_chars"] == len(x["text"]) for xs in got.values() for x in xs)
    assert html_text.extract(pages(spark, [])).count() == 0


@pytest.mark.parametrize("source", ["<a " * 350_000, "<div>" * 80_000 + "</zz>" * 80_000, "<p a='x" * 150_000, "<!" * 500_000, "<script>" + "</script " * 120_000, "<td><table>" + "<div>" * 40_000 + "<td></td>" * 40_000, "&#" + "1" * 500_000 + ";", "<" * 500_000], ids=str.__len__)
def test_pages_of_any_markup_take_time_by_their_length(source):
    import time

    from carepath.llm.page_maker import labelled_pages

    start, p = time.time(), html_text.Pages()
    html_text.add_page(p, source)
    html_text.train(labelled_pages(5)).marginals(p)
    assert time.time() - start < 20


def test_text_in_figures_and_formulas_stays(spark):
    body = "<article><p>Some words of a text long enough to be read as such.</p><p>Here <math><mi>x</mi></math> and <svg><text>a drawn word</text></svg> stand in a sentence of it.</p><select><option>no</option></select><script>no()</script></article>"
    got = html_text.extract(pages(spark, [(1, "u", f"<html><body>{body}</body></html>", "t")])).first()["text"]
    assert "x" in got.split() and "drawn" in got and "no" not in got.split()


def test_page_model_on_layouts_it_has_not_seen():
    from carepath.llm.page_maker import labelled_pages

    model, right, n = html_text.train(labelled_pages(html_text.TRAINING_PAGES)), 0, 0
    for source, kept in labelled_pages(150, seed=77):
        p = html_text.Pages()
        html_text.add_page(p, source)
        m = model.marginals(p)
        right += sum((m[k] >= 0.5) == (t in kept) for k, t in enumerate(p.text) if t is not None)
        n += sum(t is not None for t in p.text)
    assert right / n > 0.97


def test_marginals_are_exact():
    """Against all assignments of a small tree."""
    from itertools import product

    import numpy as np

    from carepath.llm.page_maker import labelled_pages

    model = html_text.train(labelled_pages(50))
    p = html_text.Pages()
    html_text.add_page(p, "<body><nav><a>Home</a></nav><article><p>some words here</p><p>x</p></article></body>")
    n, total, on = len(p.parent), 0.0, np.zeros(len(p.parent))
    for states in product((0, 1), repeat=n):
        w = model.root[states[0]]
        for k, s in enumerate(states):
            w += model.size[p.size[k]][s] + model.links[p.links[k]][s] if p.kind[k] == html_text._TEXT else model.hint[p.hint[k]][s]
            if p.parent[k] >= 0:
                w += model.edge[p.kind[p.parent[k]], p.kind[k], states[p.parent[k]], s]
        total += math.exp(w)
        on += math.exp(w) * np.array(states)
    assert np.allclose(model.marginals(p), on / total, atol=1e-9)


# ---- 9


def test_new_texts_are_dealt_to_buckets_without_a_history(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    seen, real = {}, digest_index.look_up

    def noted(index: DataFrame, new: DataFrame, bits: int) -> DataFrame:
        seen["bits"], seen["sizes"] = bits, [r["n"] for r in digest_index._bucketed(new, bits).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()]
        return real(index, new, bits)

    monkeypatch.setattr(digest_index, "look_up", noted)
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 90_000).cast("string")).alias("text"))
    got = digest_index.exact_dedup(docs, F.lit(False)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("long")).alias("kept"), F.max("group_size").alias("most")).first()
    assert (got["n"], got["kept"], got["most"]) == (100_000, 90_000, 2)
    assert len(seen["sizes"]) == 1 << seen["bits"] >= 64
    assert max(seen["sizes"]) <= 2 * digest_index.BUCKET_KEYS


def test_exact_dedup(docs, rows, empty):
    bare = lambda t: (t or "").translate(dict.fromkeys([32, *range(9, 14)]))
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[bare(t)].append((-len(t or ""), i is not None, i))
    for seen in (F.col("doc_id") % 2 == 0, F.lit(False), F.lit(True)):
        got = digest_index.exact_dedup(docs, seen).collect()
        assert len(got) == len(rows)
        text = {i: t for i, t, *_ in rows}
        for x in got:
            g = groups[bare(text[x["doc_id"]])]
            assert (x["keep_id"], x["group_size"]) == (min(g)[2], len(g))
            assert x["text_sha256"] == hashlib.sha256(bare(text[x["doc_id"]]).encode()).hexdigest()
            assert x["kept"] == (x["doc_id"] == x["keep_id"])
    assert digest_index.exact_dedup(empty, F.lit(True)).count() == 0


def test_perfect_hash_is_minimal():
    import numpy as np

    keys = np.random.default_rng(0).integers(0, 2**63, (3000, 4)).astype(np.uint64)
    at = digest_index.slots(digest_index.perfect_hash(keys), keys)
    assert sorted(at) == list(range(3000))


# ---- 10


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.packed(docs).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = b"".join(x.to_bytes(4, "little") for x in ids[k : k + 2048])
            want[i, k // 2048, k, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == want
    sequences = defaultdict(list)
    for x in got:
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(x["length"] for x in got) / 2048) + 1
    odd = docs.selectExpr("*", "1 AS salt", "2 AS number", "3 AS length", "4 AS `before`")
    assert packing.packed(odd).count() == len(got)
    assert packing.packed(empty).count() == 0


def test_plan_is_near_its_bound():
    r = random.Random(4)
    histogram = Counter(r.randint(1, 2047) for _ in range(5000))
    chosen, bound = packing.plan(histogram)
    covered = Counter()
    for made, n in chosen:
        assert sum(length * a for length, a in made) <= 2048
        for length, a in made:
            covered[length] += a * n
    assert covered == histogram and sum(n for _, n in chosen) <= bound * 1.02 + 1


@pytest.mark.parametrize("times", [1, 7])
def test_program_places_all_but_fewer_pieces_than_lengths(times, monkeypatch):
    r, given = random.Random(6), []
    histogram = {k: times * n for k, n in Counter(min(2048, int(r.expovariate(1 / 500)) + 1) for _ in range(3000)).items()}
    fit = packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda counts, *rest: given.append(sum(counts.values())) or fit(counts, *rest))
    chosen, bound = packing.plan(histogram)
    covered = Counter()
    for made, n in chosen:
        for length, a in made:
            covered[length] += a * n
    assert covered == histogram and max(given) < len(histogram)
    assert sum(n for _, n in chosen) <= bound * 1.005 + 1
