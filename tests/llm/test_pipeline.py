"""Each stage of the corpus pipeline against a plain version of what it must keep, on the smallest tables."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import langid, mixing, token_output
from tests.llm.brute import brute_components, brute_contaminated, expected_tokens

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def start(spark):
    """The documents, with rows that are null, empty, repeated and near copies, and columns that clash."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("doc_id = 3").first()
    odd = [
        (900, None, "en", "web", 0),
        (901, "", None, None, 0),
        (902, "12 34 !!", "en", "web", 8),
        (903, first["text"], "en", None, first["n_chars"]),
        (903, first["text"], "en", None, first["n_chars"]),
        (904, first["text"] + " plus two words", None, "web", 1),
        (None, first["text"].upper(), "en", "web", 1),
    ]
    more = spark.createDataFrame(odd, docs.schema)
    full = docs.unionByName(more)
    for name in ("tie", "id", "words", "place", "row", "copies"):
        full = full.withColumn(name, F.lit("clash"))
    return full


def run_to(spark, docs, last):
    for name, stage in corpus_pipeline.STAGES:
        if name == last:
            return docs
        docs = stage(spark, docs, SF)
    return docs


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_language_stage(spark, start):
    kept = STAGES["language_id"](spark, start, SF)
    assert kept.columns == start.columns
    vocab = langid.vocabulary()
    scorer = langid.Scorer(vocab, langid.fit(start, vocab)[1])
    rows = rows_of(start)
    scores = scorer.score([r["text"] for r in rows])
    sure = [r for r, x in zip(rows, scores, strict=True) if x is not None and 1 / sum(pow(2.718281828459045, y - max(x)) for y in x) >= 0.5]
    key = lambda r: (str(r["doc_id"]), r["text"])
    assert sorted(map(key, rows_of(kept))) == sorted(map(key, sure))
    assert {900, 901, 902}.isdisjoint(r["doc_id"] for r in sure)


def test_near_duplicate_stage(spark, start):
    docs = run_to(spark, start, "simhash")
    rows = rows_of(docs)
    sets = []
    for r in rows:
        w = r["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))))
    near = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    group = brute_components(list(range(len(rows))), near)
    kept = rows_of(STAGES["simhash"](spark, docs, SF))
    members = {}
    for k, g in group.items():
        members.setdefault(g, []).append(rows[k]["doc_id"])
    # of each group one row, with the smallest doc_id (null before all)
    want = Counter(min(ids, key=lambda i: -1 if i is None else i) for ids in members.values())
    assert Counter(r["doc_id"] for r in kept) == want and 904 not in want and 903 not in want


def test_decontamination_stage(spark, start):
    docs = run_to(spark, start, "decontaminate")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted((x[0] for x in brute_contaminated([(r["doc_id"], r["text"]) for r in rows_of(docs)], items) if not x[5]), key=repr)
    assert sorted((r["doc_id"] for r in rows_of(STAGES["decontaminate"](spark, docs, SF))), key=repr) == want


def test_mix_and_tokens_stages(spark, start):
    docs = run_to(spark, start, "mix")
    mixed = STAGES["mix"](spark, docs, SF)
    assert mixed.columns == start.columns
    copies = Counter()
    for r in mixing.mixed(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    rows = rows_of(mixed)
    assert Counter(r["doc_id"] for r in rows) == Counter({k: n for k, n in copies.items() if n})
    tokenizer = Tokenizer.from_file(token_output.tokenizer_path())
    ordered = sorted(((r["doc_id"], r["text"]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    want = expected_tokens(ordered, lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids)
    got = sorted((tuple(r)[:4] for r in STAGES["tokens"](spark, mixed, SF).collect()), key=lambda r: r[1])
    assert got == want
