import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, licenses, topk, warc


def brute_top(vectors, top=5):
    q = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, a) in enumerate(q):
        if i % 50 == 0:
            scores = sorted((-int(a[: len(b)] @ b[: len(a)]), j) for n, (j, b) in enumerate(q) if n != k)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:top])]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in (rng.integers(-3, 4, 8) / 4).astype(np.float32)]) for i in range(230)]
    vectors += [(300, None), (350, [1.0, None]), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (500, []), (550, [0.5, 0.25]), (600, [0.0] * 8), (None, [1.0] * 8)]
    vectors += [vectors[3], vectors[50], vectors[50], (100, [2.0] * 8), (650, [3e6, -1e4])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("row", F.lit("x"))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block=64, queries=2)
    assert sorted(map(tuple, got.collect())) == brute_top(vectors)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_licenses_are_found_anywhere(docs):
    words = " ".join(f"w{k}" for k in range(700))
    rows, want = [], set()
    for k, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        rows.append((k, f"{words}, {text.upper()} {words}" if k % 2 else text))
        want.add((k, name))
    rows += [(100, None), (101, ""), (102, words), (103, "released under the mit"), (104, "x " * 400 + "Released under the MIT License" + " y" * 3)]
    want.add((104, "MIT-notice"))
    got = {(r["doc_id"], r["license"]) for r in licenses.license_matches(docs(rows, extra=True)).collect()}
    assert want <= got and {d for d, _ in got} == {d for d, _ in want}
    assert licenses.license_matches(docs([])).count() == 0


def test_licenses_with_some_words_changed(docs):
    text = licenses.TEMPLATES["MIT"].split()
    near, far = list(text), list(text)
    near[20] = "other"
    for k in range(0, len(far), 6):
        far[k] = "other"
    got = {r["doc_id"]: r["containment"] for r in licenses.license_matches(docs([(1, " ".join(near)), (2, " ".join(far))])).collect()}
    assert set(got) == {1} and 0.8 <= got[1] < 1
    with pytest.raises(ValueError):
        licenses.Templates({"short": "only four words here"})


def test_licenses_against_brute_force(docs, sample):
    ready = licenses.Templates(licenses.TEMPLATES)
    want = set()
    for r in sample:
        w = licenses.WORD.findall(r["text"].encode().lower())
        own = set(zip(*[w[k:] for k in range(5)], strict=False))
        want |= {(r["doc_id"], ready.names[k]) for k, s in enumerate(ready.shingles) if len(own & s) >= 0.8 * len(s)}
    got = {(r["doc_id"], r["license"]) for r in licenses.license_matches(docs([(r["doc_id"], r["text"]) for r in sample])).collect()}
    assert got == want


def test_licenses_in_a_very_long_text(docs, monkeypatch):
    filler = " ".join(f"w{k}" for k in range(150_000))
    mit, epl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["EPL-2.0"]
    # notices at the start, over the edge between pieces and at the end
    text = f"{epl} {filler}"
    text = text[: licenses.CHUNK - 100] + " " + mit + " " + text[licenses.CHUNK - 100 :] + " Released under the MIT License."
    got = {r["license"]: r for r in licenses.license_matches(docs([(1, text), (2, "x" * (3 << 20))])).collect()}
    assert set(got) == {"MIT", "EPL-2.0", "MIT-notice"} and all(r["containment"] == 1 for r in got.values())
    words = licenses.WORD.findall(text.encode().lower())
    for name, r in got.items():
        part = words[r["first_word"] : r["first_word"] + r["n_words"]]
        assert set(licenses.WORD.findall(licenses.TEMPLATES[name].encode().lower())) <= set(part)


def test_short_notices_and_families(docs):
    rows = [(1, "a b. All Rights\n reserved, c"), (2, "overall rights reserved"), (3, "x // SPDX-License-Identifier: MIT"), (4, "all rights are reserved"), (5, "all rights reserved"), (6, None)]
    got = sorted(tuple(r) for r in licenses.license_matches(docs(rows), licenses.ALL).collect())
    assert got == [(1, "All-rights-reserved-notice", 1.0, 2, 3), (3, "MIT-spdx", 1.0, 1, 4), (5, "All-rights-reserved-notice", 1.0, 0, 3)]
    texts = dict(enumerate(sorted(licenses.ALL.items())))
    got = {(r["doc_id"], r["license"]) for r in licenses.license_matches(docs([(k, f"so {t} it") for k, (_, t) in texts.items()]), licenses.ALL).collect()}
    apache = next(k for k, (n, _) in texts.items() if n == "Apache-2.0")
    assert got == {(k, n) for k, (n, _) in texts.items()} | {(apache, "Apache-2.0-notice")}
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    rows = [(1, gpl), (2, gpl.replace("version 2", "version 3")), (3, gpl.replace("General", "Lesser General").replace("version 2", "version 2.1")), (4, "This work is licensed under the GNU General Public License, version 2.")]
    got = sorted((r["doc_id"], r["license"]) for r in licenses.license_matches(docs(rows), licenses.ALL).collect())
    assert got == [(1, "GPL-2.0"), (2, "GPL-3.0"), (3, "LGPL-2.1"), (4, "GPL-2.0-notice")]


RECORDS = "record_id long, url string, captured timestamp, status int, headers map<string,string>, body string"


def records(spark, *rows):
    return spark.createDataFrame(rows, "record_id long, url string, at long, status int, headers map<string,string>, body string").withColumn("captured", F.timestamp_seconds("at")).drop("at")


def test_revisits(spark):
    page = {"ETag": '"a"', "Content-Type": "text/html", "Cache-Control": "max-age=1", "Last-Modified": "Mon"}
    r = records(
        spark,
        (1, "http://WWW.x.org:80/p/?utm_source=q&a=1#f", 10, 200, page, "one"),
        (2, "https://x.org/p?a=1", 20, 304, {"etag": 'W/"a"', "cache-control": "no-store", "content-type": "z"}, None),
        (3, "https://x.org/p?a=1", 30, 200, {"ETag": '"b"', "last-modified": "Tue"}, "two"),
        (4, "x.org/p/?a=1", 200_000, 304, {"last-modified": "Tue"}, None),
        (5, "x.org/p/?a=1", 200_000, 304, {"ETag": '"a"'}, None),
        (6, "x.org/p/?a=1", 5, 304, {"ETag": '"a"'}, None),
        (7, "x.org/p/?a=1", 40, 304, {}, None),
        (8, "x.org/p/?a=1", 30, 304, {"ETag": '"a"'}, None),
        (9, None, 30, 304, {"ETag": '"a"'}, None),
        (10, "x.org/p/?a=1", None, 304, None, None),
        (11, "x.org/p/?a=1", 35, 404, None, "no"),
    ).withColumn("verdict", F.lit("clash"))
    got = {x["record_id"]: x for x in warc.resolved(r, canonical=warc.crawl_url).collect()}
    assert {k: (x["verdict"], x["base_id"]) for k, x in got.items()} == {
        2: ("resolved", 1),
        4: ("resolved", 3),
        5: ("mismatch", None),
        6: ("no_response", None),
        7: ("no_validator", None),
        8: ("resolved", 1),
        9: ("no_response", None),
        10: ("no_response", None),
    }
    assert got[2]["headers"] == {"etag": 'W/"a"', "content-type": "text/html", "cache-control": "no-store", "last-modified": "Mon"}
    assert {x["record_id"]: x["body"] for x in warc.resolved_bodies(r, "body", canonical=warc.crawl_url).collect()} == {2: "one", 4: "two", 8: "one"}
    assert warc.resolved(r.limit(0)).count() == 0


def test_urls_by_the_standard(spark):
    cases = {
        "eXAMPLE://a/./b/../b/%63/%7bfoo%7d": "example://a/b/c/%7Bfoo%7D",
        "HTTP://User@WWW.Example.COM:80/%7euser/a%2fb?q=%41&x=%zz#top": "http://User@www.example.com/~user/a%2Fb?q=A&x=%zz",
        "https://x.org": "https://x.org/",
        "https://x.org:443?a": "https://x.org/?a",
        "https://x.org:8443/a/b/..": "https://x.org:8443/a/",
        "http://x.org:/../../a/.": "http://x.org/a/",
        " no url#f ": "no url",
        "http://m.x.org/p?ref=1&a=2": "http://m.x.org/p?ref=1&a=2",
        "": "",
        None: None,
    }
    rows = spark.createDataFrame([(u, w) for u, w in cases.items()], "u string, want string")
    got = {r["u"]: r["x"] for r in rows.select("u", warc.standard_url(F.col("u")).alias("x")).collect()}
    assert got == cases


def test_as_of_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), f"u{rng.integers(3)}.org", int(rng.integers(40)), int(rng.choice([200, 304])), {"etag": str(rng.integers(2))}, None) for k in range(120)]
    got = {x["record_id"]: (x["verdict"], x["base_id"]) for x in warc.resolved(records(spark, *rows), bucket_s=7).collect()}
    for k, url, at, status, headers, _ in rows:
        if status == 304:
            base = max(((a, i, h) for i, u, a, s, h, _ in rows if s == 200 and u == url and a < at), key=lambda x: x[:2], default=None)
            assert got[k] == (("no_response", None) if base is None else ("resolved", base[1]) if base[2] == headers else ("mismatch", None))


def brute_word(word, names, logs, other):
    """Sum over all segmentations, one by one."""
    word, total = langid.START + word, []

    def walk(at, log):
        if at == len(word):
            total.append(log)
        for end in range(at + 1, len(word) + 1):
            piece = word[at:end]
            if piece in names:
                walk(end, log + logs[names[piece]])
            elif end == at + 1:
                walk(end, log + other)

    walk(0, 0.0)
    return np.logaddexp.reduce(total)


def test_forward_sums_all_segmentations():
    known = langid.Vocabulary([langid.START, langid.START + "a", "a", "b", "ab"])
    probs = np.array([[{"a": 0.3, "ab": 0.15, "b": 0.05, langid.START: 0.1, langid.START + "a": 0.2}[n]] for n in known.names] + [[1e-7]])
    # _ a b, _ ab, _a b
    assert np.exp(langid.forward(["ab"], known, probs))[0, 0] == pytest.approx(0.1 * 0.3 * 0.05 + 0.1 * 0.15 + 0.2 * 0.05)
    long = "ab" * 300
    for word in ("ab", "zab", "ba", long, long + "é" + long):
        assert langid.long_forward(word, known, probs, stretch=7)[0] == pytest.approx(langid.forward([word], known, probs)[0, 0])


def test_forward_against_brute_force_over_the_public_vocabulary():
    vocab = langid.vocabulary()
    assert vocab.width > 12 and {"▁function", "▁because", "▁through", "▁the"} <= set(vocab.names)
    rng = np.random.default_rng(4)
    probs = rng.dirichlet(np.ones(len(vocab)), 2).T
    probs = np.vstack([probs, np.full((1, 2), langid.OTHER_LETTER)])
    words = ["because", "function", "throughout", "été", "日本語", "zzz", "a", "þórð"] + ["".join(rng.choice(list("etaoinsr"), rng.integers(1, 12))) for _ in range(30)]
    got = langid.forward(words, vocab, probs)
    names = {n: k for k, n in enumerate(vocab.names)}
    for k, word in enumerate(words):
        for lang in (0, 1):
            assert got[k, lang] == pytest.approx(brute_word(word, names, np.log(probs[:, lang]), np.log(langid.OTHER_LETTER)))


def brute_fit(counts, names, rounds):
    """Expected piece counts over all segmentations, one by one."""
    probs = [1 / len(names)] * len(names)
    for _ in range(rounds):
        expected = [langid.SMOOTHING] * len(names)
        for word, n in counts.items():
            found = []

            def walk(at, p, used, word=langid.START + word, found=found):
                if at == len(word):
                    found.append((p, used))
                for end in range(at + 1, len(word) + 1):
                    if word[at:end] in names:
                        walk(end, p * probs[names[word[at:end]]], [*used, names[word[at:end]]])
                    elif end == at + 1:
                        walk(end, p * langid.OTHER_LETTER, used)

            walk(0, 1.0, [])
            for p, used in found:
                for k in used:
                    expected[k] += n * p / sum(q for q, _ in found)
        probs = [x / sum(expected) for x in expected]
    return probs


def test_fit_against_brute_force():
    vocab = langid.Vocabulary([langid.START, langid.START + "a", "a", "b", "ab", "ba", "aba", "bab"])
    counts = {"abab": 3, "b": 2, "aazab": 1, "ba" * 6: 2}
    got = langid.fit_pieces(list(counts), np.array(list(counts.values()), float), vocab)
    assert got[:-1] == pytest.approx(brute_fit(counts, {n: k for k, n in enumerate(vocab.names)}, langid.FIT_ROUNDS))
    one = langid.fit_pieces(["ab" * 3000], np.array([1000.0]), vocab)
    assert one[vocab.beginnings["ab"]] + one[vocab.beginnings["aba"]] > got[vocab.beginnings["ab"]]  # long words count


def test_query_against_brute_force(docs):
    rng = np.random.default_rng(2)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(8))
    rows = [(k, text("ab" if k % 2 else "bc"), ("x", "y")[k % 2], "s") for k in range(40)] + [(90, None, "x", "s"), (91, "?! 7", "x", "s"), (92, text("ab"), None, "s")]
    vocab = langid.vocabulary()
    got = {r["doc_id"]: r for r in langid.identify(docs(rows)).collect()}
    names = {n: k for k, n in enumerate(vocab.names)}
    langs, probs = langid.fit(docs(rows), vocab)
    assert langs == ["x", "y"]
    for k, lang in enumerate(langs):
        import zlib

        counts = {}
        for i, t, own, _ in rows:
            if own == lang and t and zlib.crc32(str(i).encode()) % 4 != 2:
                for w in langid.words_of(t):
                    counts[w] = counts.get(w, 0) + 1
        want = langid.fit_pieces(sorted(counts), np.array([counts[w] for w in sorted(counts)], float), vocab)
        assert probs[:, k] == pytest.approx(want)
    for i, t, _, _ in rows:
        words = langid.words_of(t)
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        logs = [sum(brute_word(w, names, np.log(probs[:, k]), np.log(langid.OTHER_LETTER)) for w in words) for k in (0, 1)]
        assert got[i]["lang_pred"] == langs[int(np.argmax(logs))]
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-abs(logs[0] - logs[1]))))


def test_a_script_without_spaces_and_a_bounded_sample(docs):
    rng = np.random.default_rng(6)
    run = lambda letters: "".join(rng.choice(list(letters), 400))
    rows = [(k, run("的一是在不了有和人这" if k % 2 else "のはがをにでとしたる"), ("zh", "ja")[1 - k % 2], "s") for k in range(60)]
    rows += [(500, run("的一是在") * 800, None, "s"), (501, "のは" * 600_000, None, "s")]
    got = {r["doc_id"]: r for r in langid.identify(docs(rows)).collect()}
    assert all(got[k]["lang_pred"] == rows[k][2] for k in range(60))
    assert (got[500]["lang_pred"], got[501]["lang_pred"]) == ("zh", "ja")
    assert langid.fit(docs(rows), langid.vocabulary(), languages=1)[0] == ["ja"]
    fewer = langid.fit(docs(rows), langid.vocabulary(), fit_letters=1)[1]
    assert fewer.shape[1] == 2


def test_languages_are_told(docs):
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables aren't here")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in pq.read_table(path).to_pylist()]
    lang = {r[0]: r[2] for r in rows}
    odd = [(5000, None, "en", "s"), (5001, "", "en", "s"), (5002, "12 ½ ²!", None, "s"), (5003, rows[0][1] * 3, None, "s"), (5003, rows[0][1] * 3, None, "s"), (None, "the", "en", "s"), (5004, "é" * 5000, None, "s")]
    got = langid.identify(docs(rows + odd, extra=True), fit_docs=100).collect()
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r["held_out"] and r["doc_id"] in lang]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.99
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (5000, 5001, 5002))
    assert by_id[5003]["lang_pred"] == lang[rows[0][0]] and 0 < by_id[5004]["score"] <= 1
    kept = langid.identified_documents(docs(rows + odd, extra=True), fit_docs=100)
    assert kept.columns == docs(rows, extra=True).columns and {5000, 5001, 5002}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_nothing_to_learn_from(docs):
    got = langid.identify(docs([(1, "a", None, "s")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
    assert langid.identify(docs([])).count() == 0
