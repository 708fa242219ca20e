import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import token_output as T
from quillspark.llm.shared import shared_path
from tests.llm.brute import expected_tokens as expected

UNASSIGNED = ["a\u0558B", "x\u088fY\u0c5cz", "\u1c89 \u208f\u209d"]
ODD = [*UNASSIGNED, "Σας ΟΔΟΣ. İstanbul don't I'LL <|endoftext|>x b, c.,d é. é, ́x '.s", "a\x1cb\x1fc\x85d e\x0bf", "", "  ", "A.,.B. c.'s ., .,'", "\x00\x01 z", "œuvre ’quoted’ — ½ ² Ⅷ café x y €5", "日本語。テスト", "a" * 300 + ".", "_x_ 12ab3"]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(T.tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(whole, sample):
    texts = ODD + [r["text"] for r in sample]
    got = [np.frombuffer(x, "<u4").tolist() for x in T.WordEncoder(T.tokenizer_path(), words=2000).encode(texts)]
    assert got == [whole(t) for t in texts]


def test_digests(docs, sample, whole):
    rows = [(None, "null id first"), *[(r["doc_id"], r["text"]) for r in sample], (1000, None), (1001, ""), *[(1002 + k, t) for k, t in enumerate(ODD)]]
    got = T.token_digests(docs(rows[::-1], extra=True), shards=3).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected(rows, whole)


def test_repeated_and_no_rows(docs, whole):
    got = T.token_digests(docs([(1, "a b"), (1, "a b"), (0, "c")])).collect()
    assert sorted(r["start"] for r in got) == [0, 2, 5]
    assert T.token_digests(docs([])).count() == 0


def test_random_access_and_dictionary(spark, docs, sample, whole):
    folder = shared_path(spark, "test-tokens")
    manifest = T.write_tokens(docs([(r["doc_id"], r["text"]) for r in sample]), folder, shards=2).collect()
    shards = [T.Shard(m["file"]) for m in sorted(manifest, key=lambda m: m["shard"])]
    ids = [d for s in shards for d in s.doc_ids.to_pylist()]
    assert ids == sorted(r["doc_id"] for r in sample)
    by_id = {r["doc_id"]: r["text"] for r in sample}
    for shard in shards:
        k = len(shard) // 2
        assert shard.ids(k).tolist() == [*whole(by_id[shard.doc_ids[k].as_py()]), 2]
    assert sum(m["n_bytes"] for m in manifest) < 4 * sum(m["n_ids"] for m in manifest)
    back = T.read_tokens(spark.createDataFrame(manifest), "bigint", with_ids=True).where("doc_id = 7").first()
    assert back["ids"] == [*whole(by_id[7]), 2]
    file = manifest[0]["file"].removeprefix("file://")
    damaged = bytearray(open(file, "rb").read())
    damaged[10] ^= 1
    (path := file + ".bad")
    open(path, "wb").write(damaged)
    with pytest.raises((ValueError, FileNotFoundError)):
        T.Shard("file://" + path)


def test_every_unassigned_character_goes_through_the_tokenizer(whole):
    import unicodedata

    chars = [chr(c) for c in range(T.PLAIN_END) if unicodedata.category(chr(c)) == "Cn"]
    texts = ["a%sB é" % "".join(chars[k : k + 40]) for k in range(0, len(chars), 40)] + [f"a{c}B" for c in chars[::7]]
    assert [np.frombuffer(x, "<u4").tolist() for x in T.WordEncoder(T.tokenizer_path()).encode(texts)] == [whole(t) for t in texts]


def test_another_tokenizer_encodes_whole_texts(sample):
    path = T.tokenizer_path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    texts = [*ODD[4:8], *[r["text"] for r in sample[:20]]]
    assert [np.frombuffer(x, "<u4").tolist() for x in T.WordEncoder(path).encode(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_addresses_of_stores():
    assert T.store_uri("s3a://b/k") == "s3://b/k" and T.store_uri("dbfs:/x/y") == "file:///dbfs/x/y"
    assert T.store_uri("wasbs://c@acc.blob.core.windows.net/p") == "abfss://c@acc.dfs.core.windows.net/p"
    assert T.store_uri("file:/tmp/x") == "file:///tmp/x" and T.store_uri("hdfs://n/x") == "hdfs://n/x"
    with pytest.raises(ValueError, match="nosuch"):
        T._open("nosuch://x/y")


def test_a_very_long_text_and_a_small_dictionary(docs, whole):
    long = "Lorem ipsum, dolor 42 " * 80_000
    rows = [(1, "a b"), (2, long), (3, None)]
    assert len(T.trained_dictionary(docs(rows), T.tokenizer_path())) > 0
    got = T.token_digests(docs(rows), shards=2).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected(rows, whole)


def test_shards_by_size_and_ranges(docs, whole, monkeypatch):
    monkeypatch.setattr(T, "SHARD_BYTES", 1000)
    rows = [(k, "word " * (k % 50)) for k in range(300)] + [(300, "same")] * 40
    assert T.shard_count(docs(rows)) > 20
    got = T.token_digests(docs(rows)).collect()
    want = expected(rows, whole)
    assert sorted((r["start"], r["n_tokens"]) for r in got) == [(w[1], w[2]) for w in want]
