import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm import token_binary as tb
from palaver.llm.queries import QUERIES, tokenizer_path
from palaver.llm.token_counts import token_counts, with_limit
from palaver.llm.tokens import TextEncoder, WordEncoder, rules_needed

SCHEMA = "doc_id long, text string, lang string, n_tokens int, start string"
ROWS = [(5, "Hello, the World! it's 42", "x", 1, "a"), (2, None, None, None, None), (2, "", "x", 1, "a"), (None, "a\x1cb \x85 c<|endoftext|> é é", "x", 1, "a"), (9, "word " * 3000, "x", 1, "a"), (5, "Hello, the World! it's 42", "x", 1, "a"), (7, "x" * 3000, None, 0, "")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aAbéÉßİ .,!?'\"\n\t\x1c\x85\xa0　123<|>_-中한", "<|endoftext|>", "\u0301", "the "]), max_size=30).map("".join), max_size=6), st.integers(3, 60))
def test_ids_are_the_librarys(library, texts, batch):
    enc = WordEncoder(tokenizer_path(), max_words=40, batch_bytes=batch)
    counts, ids = enc.encode(pa.array(texts, pa.string()))
    want = [ids_of(library, t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("text", ["İ. İ, x", "\u0958. \u0958\u0958,", "É. é! ÉÉ", "\ufb01. ﬁx"])
def test_letters_that_become_marks(library, text):
    counts, ids = WordEncoder(tokenizer_path()).encode(pa.array([text]))
    assert ids.tolist() == ids_of(library, text) and counts.tolist() == [len(ids)]


@pytest.fixture(scope="module")
def lean():
    return TextEncoder(tokenizer_path(), fewer_rules=True)


def test_fewer_rules_for_all_pairs(library, lean):
    """Texts up to U+00FF skip rules of the file and keep its ids: every pair of such characters between letters, signs, digits."""
    low, plain = json.loads(lean.tokenizers[1].to_str()), json.loads(lean.tokenizers[0].to_str())
    assert low["normalizer"]["type"] == plain["normalizer"]["type"] == "Lowercase" and low["pre_tokenizer"] == json.loads(library.to_str())["pre_tokenizer"] and plain["pre_tokenizer"]["type"] == "Split"
    latin = [chr(i) for i in range(256)]
    for around in ("Ab", ".'", "5 "):
        texts = [around + a + b + around for a in latin for b in latin]
        counts, ids = lean.encode(pa.array(texts))
        want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert [rules_needed(t) for t in ("", "a\t\n\x0b\x0c\r ~!", "a\x1f", "\x7f", "\x85\xa0\xff", "a\u0301", "\u2019", "\u212b")] == [0, 0, 1, 1, 1, 2, 2, 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.characters(codec="utf-8"), st.characters(max_codepoint=255), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "'LL ", "\u0301", "the ", "\u212b", "\x1c"])), max_size=30).map("".join), max_size=6))
def test_fewer_rules_keep_the_ids(library, lean, texts):
    counts, ids = lean.encode(pa.array(texts, pa.string()))
    want = [ids_of(library, t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_fewer_rules_only_for_files_of_their_kind(tmp_path):
    """Bytes after a split of another kind, another normaliser, or a token found in normalised text: the file as it is."""
    with open(tokenizer_path(), encoding="utf-8") as f:
        rules = json.load(f)
    rules["model"] |= {"vocab": {c: i for i, c in enumerate(["a", "b", "a</w>", "b</w>"])}, "merges": []}
    split, as_bytes = rules["pre_tokenizer"]["pretokenizers"]
    others = [{"normalizer": None}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFKC"}, {"type": "Lowercase"}]}}, {"added_tokens": [t | {"normalized": True} for t in rules["added_tokens"]]}]
    others += [{"pre_tokenizer": {"type": "Sequence", "pretokenizers": x}} for x in ([split], [as_bytes], [split, as_bytes | {"add_prefix_space": True}], [split | {"behavior": "Isolated"}, as_bytes])]
    for i, x in enumerate(({}, *others)):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(rules | x))
        assert hasattr(TextEncoder(str(path), fewer_rules=True), "tokenizers") is (not x)


def test_counts(spark, library):
    got = with_limit(token_counts(spark.createDataFrame(ROWS, SCHEMA), tokenizer_path())).collect()
    want = [(i, len((t or "").encode()), n := len(ids_of(library, t)), n > 2048) for i, t, *_ in ROWS]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_piece_model_counts(spark):
    assert token_counts(spark.createDataFrame(ROWS[:1], SCHEMA), tokenizer_path("piece_bpe_32k.model")).first().n_tokens > 5


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 20), st.integers(0, 300), st.randoms())
def test_packing_round_trip(bits, n, rnd):
    ids = np.array([rnd.randrange(1 << bits) for _ in range(n)], dtype=np.uint32)
    assert tb.unpack(tb.pack(ids, bits), n, bits).tolist() == ids.tolist()
    assert len(tb.pack(ids, bits)) == -(-n // 64) * 8 * bits


def test_shards_read_back(spark, library, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    manifest = tb.write_shards(docs, str(tmp_path / "out"), tokenizer_path(), 2, block_tokens=64, shard_tokens=500)
    got = tb.read_digests(manifest, step_tokens=100).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 2, 2, 5, 5, 7, 9]
    start = 0
    texts = {None: [ROWS[3][1]], 2: [""], 5: [ROWS[0][1]], 7: [ROWS[6][1]], 9: [ROWS[4][1]]}
    for r in got:
        ids = [*ids_of(library, texts[r.doc_id][0]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    path = manifest.orderBy("shard").first().path
    from pyarrow import fs

    with fs.FileSystem.from_uri(path)[0].open_input_file(fs.FileSystem.from_uri(path)[1]) as f:
        shard = tb.ShardReader(f)
        assert shard.document(shard.n_docs - 1)[-1] == 2 and shard.bits == 16
    assert tb.encode_to_shards(spark.createDataFrame([], SCHEMA), tokenizer_path(), 2).count() == 0


def test_shards_of_a_whole_table(spark, library):
    """Every row of the query, in more than one shard, against a plain loop with the library in order of doc_id."""
    sf, key = "/root/testdata/sf0.01", "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        rows = QUERIES["op2_token_binary"](spark, sf).orderBy("start").collect()
    finally:
        spark.conf.unset(key)
    assert len({r.shard for r in rows}) > 1
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows]
    want, start = [], 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect():
        ids = [*ids_of(library, r.text), 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == want
