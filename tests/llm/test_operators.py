"""Operators against brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sextile.llm import decontaminate, exact, html, langid, licences, near, packing, pii, repeats, warc
from sextile.llm.components import components
from sextile.sources.shared import Scratch

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, owner long, count string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(120)]
    out = {1: None, 2: "", 3: " \t\n ", 4: "one", 5: "ONE", 6: "two words", 7: "Two\x0bwords"}
    for i in range(10, 60):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 30])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out[i] = " ".join(copy)
    for i in range(60, 90):
        own = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(1, 80))]
        at = rng.randrange(90)
        out[i] = "  ".join(own + base[at : at + 25])
    out[95] = "long " * 30_000 + "end"
    out[96] = "x" * 20_000 + " " + "日本 語テキスト " * 50
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 5, "c") for i, t in texts.items()] + [(None, "no id", 1, "c"), (4, "one", 5, "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def scratch(spark):
    with Scratch(spark) as s:
        yield s


def empty(docs):
    return docs.limit(0)


def test_exact(docs, texts, scratch):
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(docs, scratch).collect()}
    same = {}
    for i, t in texts.items():
        same.setdefault((t or "").encode().lower(), []).append(i)
    assert got == {i: (max(g), len(g)) for g in same.values() for i in g}
    assert exact.exact_groups(empty(docs), scratch).count() == 0


def shingles(text, k):
    words = re.findall(WORD, (text or "").encode().lower().decode())
    if 0 < len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@pytest.mark.parametrize("k,percent,rows", [(3, 85, 1000), (5, 80, 7)])
def test_near(docs, texts, scratch, k, percent, rows):
    """Small blocks make clusters go through the search across blocks."""
    params = near.NearParams(shingle=k, percent=percent, block_rows=rows)
    frame = near.near_duplicates(docs, scratch, params)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}
    assert near.near_duplicates(empty(docs), scratch, params).count() == 0


def test_components(spark, scratch):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    got = components(spark.createDataFrame(links, "u long, v long"), scratch).collect()
    assert {r.node: r.root for r in got} == {
        n: (1 if n < 100 else 100) for n in [*range(1, 41), *range(100, 120)]
    }


def test_repeats(docs, texts, scratch):
    params = repeats.RepeatParams(automaton_words=60)
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, scratch, params).collect()}
    words = {i: re.findall(WORD, t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][j : j + 13]), i)
    for i, ws in words.items():
        gone = set()
        for j in range(len(ws) - 12):
            if first[tuple(ws[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        assert (got[i].n_words, got[i].n_removed) == (len(ws), len(gone))
        assert bytes(got[i].kept_text).decode() == kept
        assert {j for s in got[i].spans for j in range(s.start, s.end)} == gone
    assert repeats.remove_repeats(empty(docs), scratch).count() == 0


def test_packing(docs, texts, scratch):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = {200: "It's 5² <|endoftext|> İΣ don'T", 201: "a b c é ½x’s"}
    more = docs.sparkSession.createDataFrame([(i, t, 0, "") for i, t in odd.items()], SCHEMA)
    frame = packing.pack(docs.dropDuplicates(["doc_id"]).union(more), scratch)
    rows = frame.toPandas().sort_values(["doc_id", "start"])
    for i, t in (texts | odd).items():
        own = rows[rows.doc_id == i]
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert b"".join(own.ids) == np.array(want, "<u4").tobytes()
        assert all(zlib.crc32(x) == c for x, c in zip(own.ids, own.ids_crc32))
        assert set(own.doc_tokens) == {len(want)}
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
    whole = packing.sequences(frame).collect()
    assert all(len(r.ids) == (4 * r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 8192) for r in whole)
    assert packing.pack(empty(docs), scratch).count() == 0


def test_plan_packs_everything():
    rng = np.random.default_rng(1)
    for room in (1, 7, 32):
        for _ in range(20):
            counts = rng.integers(0, 40, room)
            used = packing.plan(counts)
            total = sum(p * n for p, n in used) if used else np.zeros(room)
            assert (total >= counts).all()
            assert all((p * np.arange(1, room + 1)).sum() <= room for p, _ in used)


def test_canonical_lines_are_what_the_rules_say(spark):
    bits = ["licence", "sub licence", "non-infring", "favour", "COLOURISED", "organise", "judgement"]
    bits += ["is", "ised", "ize", "our", "x", "é", "東京", "\u3000", ",", "©", "(c) ", "Copyright 2020"]
    bits += [" ", "  ", "\n", " \n ", "\r\n", "\t", "\n\n", "all rights reserved"]
    draw = random.Random(5)
    rows = [("".join(draw.choices(bits, k=draw.randint(0, 25))),) for _ in range(5000)] + [(None,)]
    frame = spark.createDataFrame(rows, "text string")
    ruled = F.lower(F.coalesce("text", F.lit("")))
    for pattern, instead in licences.RULES:
        ruled = F.regexp_replace(ruled, F.lit(pattern), F.lit(instead))
    assert frame.where(ruled != licences.canonical_lines(F.col("text"))).count() == 0


def test_licences(spark):
    mit = dict(licences.CATALOGUE[:1])["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sub-licence").upper())]
    rows += [(2, "prose\nReleased under the MIT Licence!\nmore"), (3, None), (4, ""), (5, mit[:-30])]
    rows += [(2, rows[1][1]), (None, mit)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS licence")
    got = {
        r.doc_id: (r.text_licence, r.n_licence_lines, r.licences)
        for r in licences.scan_licences(frame, licences.catalogue(spark)).collect()
    }
    assert got == {
        1: ("MIT", 0, "MIT"), 2: (None, 1, "MIT"), 3: (None, 0, ""), 4: (None, 0, ""), 5: (None, 0, ""),
    }


@pytest.mark.parametrize(
    "params",
    [warc.WarcParams(file_records=7), warc.WarcParams(file_bytes=900, range_captures=4, ranges=2, most_ranges=3)],
)
def test_warc(spark, scratch, params):
    odd = [(5, None, None), (2, "http://[bad", ""), (9, "http://a b\r\nc/", "WARC/1.1\r\n\r\nx")]
    odd += [(7, "http://www.A.org/Q?x", "WARC/1.1\r\n\r\nx"), (8, "http://a.org/", "é\r\n"), (None, "u", "h")]
    odd += [(i, "http://hot.org/", f"page {i % 3}") for i in range(100, 160)]
    odd += [(170, "http://hot.org/", "again")] * 20
    path = scratch.path("archives")
    pages = spark.createDataFrame(odd, "page_id long, url string, html string")
    warc.write_archives(pages, path, scratch, params)
    index = warc.capture_index(spark, path, scratch, params)
    rows = index.orderBy("range", "part", "place").collect()
    sizes = index.groupBy("archive").agg({"length": "sum", "*": "count"}).collect()
    assert all(r["sum(length)"] <= params.file_bytes and r["count(1)"] <= params.file_records for r in sizes)
    if params.range_captures == 4:
        assert index.groupBy("range", "part").count().where("count > 30").isEmpty()
    keys = [(r.url_key, r.timestamp, r.page_id) for r in rows]
    assert keys == sorted(keys) and len(keys) == len(odd) - 1
    first = {}
    for i, _, payload in sorted(x for x in odd if x[0] is not None and x[0] >= 0):
        first.setdefault(payload or "", i)
    payloads = {i: (h or "") for i, _, h in odd}
    for r in rows:
        payload, owner = payloads[r.page_id], first[payloads[r.page_id]]
        assert r.payload_digest == warc.payload_digest(payload.encode())
        assert r.payload_bytes == len(payload.encode())
        assert (r.record_type, r.refers_to) == (
            ("response", None) if owner == r.page_id else ("revisit", owner)
        )


def test_loser_tree():
    rng = random.Random(2)
    for _ in range(200):
        runs = [sorted(rng.choices(range(9), k=rng.randrange(6))) for _ in range(rng.randrange(8))]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def test_pii_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("a1@.-+ (2%é") for _ in range(rng.randrange(40)))
        want = [("email", *m.span()) for m in email.finditer(text)]
        want += [("ip", *m.span()) for m in ip.finditer(text) if max(map(int, m[0].split("."))) <= 255]
        for kind, pattern in (("card", card), ("phone", phone)):
            for m in pattern.finditer(text):
                n = re.sub("[^0-9]", "", m[0])
                ok = 12 <= len(n) <= 19 and pii.luhn(n) if kind == "card" else 9 <= len(n) <= 15
                want += [(kind, *m.span())] * ok
        assert pii.base_spans(text) == sorted(want, key=pii.span_order)


def test_pii_gradients():
    model = pii.BiLstmCrf(pii.PiiParams(hidden=3))
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii.N_CLASSES, (6, 4)), rng.integers(0, pii.N_TAGS, (6, 4))
    _, grads = model.loss(x, y)
    for name, w in model.weights.items():
        at = tuple(rng.integers(0, n) for n in w.shape)
        w[at] += 1e-5
        above = model.loss(x, y)[0]
        w[at] -= 2e-5
        below = model.loss(x, y)[0]
        w[at] += 1e-5
        assert abs((above - below) / 2e-5 - grads[name][at]) < 1e-5


def test_pii_adds(spark, docs, scratch):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.learn(given, scratch)
    text = "x" * 500 + " please call (632) 555-4827 about it, or 1.2.3.4 " + "word " * 90
    odd = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "7" * 3000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(odd, model).collect()}
    assert [(s.kind, text[s.start : s.end]) for s in got[1].base] == [("ip", "1.2.3.4")]
    assert ("phone", "(632) 555-4827") in [(s.kind, text[s.start : s.end]) for s in got[1].added]
    assert all(not got[i].base and not got[i].added for i in (2, 3, 4))


def test_html():
    weights = {"word": 1.0, "link word": 0.1, "inline": -0.1, "a": -3.0}
    weights |= {name: -0.1 if name == "p" else -2.0 for name in html.BLOCKS}
    body = "<article><h1>A  title &amp; more</h1><p>First <b>para</b>\n graph.<br>x<p>Second &lt;one&gt;</article>"
    page = (
        "<html><head><title>no</title><script>var a='</p>';</script></head><body><nav><a href=x>Menu</a></nav>"
        "<!-- no --><div class='ad box'>buy now</div>" + body
        + "<section id=comments><p>me too, a long comment of a reader</section><footer>&copy; us</footer>"
    )
    want = "A title & more\n\nFirst para graph. x\n\nSecond <one>"
    assert html.main_text(page, weights) == want
    for none in (None, "", "<p>", "<nav>a b c</nav>", "<!-- x", "<script>a b"):
        assert html.main_text(none, weights) == ""


def test_language(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    profiles = langid.learn(given.where("doc_id % 4 <> 2"))
    held = given.where("doc_id % 4 = 2").select("doc_id", "lang")
    rows = held.join(langid.identify(given, profiles), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ... 5")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, profiles).collect()} == {("und", 0.0)}
    none = langid.learn(given.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def test_trigram_scores_are_bundles():
    """The sum of the trigrams' products is the product of their bundle."""
    params = langid.LanguageParams(dimensions=64)
    codes, sizes = langid.grams(["ab cd", None, "Éa"])
    assert sizes.tolist() == [4, 0, 2]
    vectors = langid.Vectors(params).of(codes).astype(int)
    assert set(np.unique(vectors)) == {-1, 1}
    prototypes = np.random.default_rng(0).normal(size=(2, 64))
    scores = langid._Scorer(langid.Profiles(["a", "b"], prototypes, params, np.ones(2)))(codes[:4])
    assert np.allclose(scores.sum(axis=0), prototypes @ vectors[:4].sum(axis=0))


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                step = 2 if a[i] == b[j] else -1
                best[i + 1, j + 1] = max(0, best[i, j] + step, best[i, j + 1] - 1, best[i + 1, j] - 1)
        score, low, high = decontaminate.align(a, b)
        assert score == best.max() and (not score or decontaminate.align(a, b[low:high])[0] == score)


def test_leaks(spark):
    rng = random.Random(5)
    items = {i: [f"q{rng.randrange(400)}" for _ in range(30)] for i in range(6)}
    prose = [f"p{rng.randrange(300)}" for _ in range(200)]
    edited = [w if j % 6 else "other" for j, w in enumerate(items[1])]
    rows = {1: prose + items[0] + prose, 2: prose + edited, 3: prose, 4: items[2][:8] + prose, 5: []}
    docs = [(i, " ".join(ws).upper()) for i, ws in rows.items()] + [(6, None), (1, " ".join(rows[1]).upper())]
    bench = [(i, " ".join(ws)) for i, ws in items.items()] + [(8, None), (9, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for params in (decontaminate.LeakParams(), decontaminate.LeakParams(block_bytes=100)):
        got = decontaminate.leaks(d, b, params).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 0), (2, 1)}
    assert decontaminate.leaks(d, b.limit(0)).count() == decontaminate.leaks(d.limit(0), b).count() == 0


def test_digest_of_kept_text(docs, scratch):
    plain = {r.doc_id: bytes(r.kept_text) for r in repeats.remove_repeats(docs, scratch).collect()}
    for r in repeats.remove_repeats(docs, scratch, digest=True).collect():
        assert r.kept_sha256 == hashlib.sha256(plain[r.doc_id]).hexdigest()
