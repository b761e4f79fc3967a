"""Nothing is capped, cut or switched off by size: small limits give what large ones give."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_dedup import brute_jaccard, frame, roots

from palaver.llm.common import Scratch
from palaver.llm.components import connected_components
from palaver.llm.embeddings import near_duplicate_vectors
from palaver.llm.exact_dedup import _SPILL, _scan, exact_dedup, merged_classes
from palaver.llm.ftrl import Ftrl, Grams, Hasher, Model, _features_of, _weights, train
from palaver.llm.jaccard import JaccardJoin, Sketches, overlap_of, sketch_places
from palaver.llm.prints import SPREAD, counted, spread
from palaver.llm.queries import tokenizer_path
from palaver.llm.shingles import shingle_sets, word_hashes
from palaver.llm.token_counts import token_counts
from palaver.llm.tokens import TextEncoder


def test_no_bucket_passes_its_size(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abcdefgh", k=rng.randint(1, 300)))) for i in range(400)] + [(1000 + i, "hot " * 50) for i in range(200)]
    docs = frame(spark, rows).repartition(7)
    spill = Scratch(spark, "t").write(docs.select("doc_id", "text").mapInArrow(_scan(2_000), _SPILL), "spill")
    got = merged_classes(spill, 4_000).collect()
    # a table counts 200 bytes an entry beside its content; only one content alone may be more than its bucket
    assert max(r.table_bytes for r in got) <= 4_000 + 200 * 60 and len(got) == spill.where("hash is not null").count()
    sizes = Counter(t for _, t in rows)
    by = {r.doc_id: r for r in exact_dedup(docs, bucket_bytes=4_000, table_bytes=2_000).collect()}
    assert all(by[i].group_size == sizes[t] for i, t in rows)


def test_a_long_path_is_one_component(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(5_000)], "a long, b long")
    got = connected_components(path, Scratch(spark, "t")).groupBy("component").count().collect()
    assert [(r.component, r["count"]) for r in got] == [(0, 5_001)]


@pytest.mark.parametrize("least", [1, 3])
def test_counts_of_prints(spark, least):
    rng = random.Random(3)
    values = [rng.randrange(1 << 26) if rng.random() < 0.5 else rng.choice([5, 70_000, (1 << 26) - 1]) for _ in range(5_000)]

    def run(batches):
        yield from spread((np.array(b.column(0).to_pylist(), dtype=np.uint64) for b in batches), 26, flush=700)

    rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(3).mapInArrow(run, SPREAD)
    assert {(r.number, r["count"]) for r in counted(rows, 26, least).collect()} == {x for x in Counter(values).items() if x[1] >= least}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "b", " ", "\n", "é", "\x0b", "long-word-of-many-bytes", "　"]), max_size=25).map("".join), max_size=8), st.integers(1, 40))
def test_words_are_the_same_in_any_step(texts, step):
    h, n = word_hashes(pa.array(texts, pa.string()), step)
    words = [w for t in texts for w in t.replace("\x0b", " ").replace("\n", " ").replace("B", "b").split(" ") if w]
    assert len(h) == len(words) == n.sum()
    assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))


def test_sketches_lose_nothing_that_links():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(3, 400)
        base = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        other = list(base)
        for _ in range(rng.randint(0, 6)):
            other[rng.randrange(len(other))] = "x"
        g, cut = shingle_sets(pa.array([" ".join(base), " ".join(other)]))
        a, b = (set(g[cut[i] : cut[i + 1]].tolist()) for i in range(2))
        sketches = []
        for s in (a, b):
            m = sketch_places(len(s))
            from palaver.llm.common import mix64

            place = (mix64(np.array(sorted(s), dtype=np.uint64) + np.uint64(1)) & np.uint64(m - 1)).astype(np.int64)
            sketches.append(np.packbits((np.bincount(place, minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes())
        ok = Sketches(sketches).pass_(np.array([0]), np.array([1]), np.array([len(a)]), np.array([len(b)]))[0]
        assert ok or len(a & b) < overlap_of(np.array(len(a)), np.array(len(b)))


@pytest.mark.parametrize("bits", [26, 32])
def test_links_hold_where_prints_collide_and_lists_are_long(spark, bits):
    rng = random.Random(6)
    lines = [" ".join(f"l{k}x{i}" for i in range(9)) for k in range(12)]
    rows = []
    for g in range(60):
        base = [f"b{g}x{i}" for i in range(28)]
        for _ in range(3):
            own = list(base)
            own[rng.randrange(28)] = f"e{rng.random()}"
            rows.append((len(rows), " ".join([*own, *rng.sample(lines, 2)])))
    for _ in range(120):  # texts of common lines only, and near copies of one text
        rows.append((len(rows), " ".join(rng.sample(lines, 5))))
    base = [f"n{i}" for i in range(70)]
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(70)] = f"e{rng.random()}"
        rows.append((len(rows), " ".join(own)))
    join = JaccardJoin(frame(spark, rows).repartition(5), hot_df=3, most_hot=200, short=4, block=16, print_bits=bits)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.result().collect()}
    assert len(join.hot) == 200
    assert got == brute_jaccard(rows)


def test_rows_that_share_a_vector_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, near_duplicate_vectors(df).collect())) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_features_do_not_hang_on_the_parts_of_a_text():
    rng = random.Random(5)
    text = " ".join(rng.choice(["alpha", "BETA", "x1y", "don't", "…", "七"]) for _ in range(400))
    hasher = Hasher(Grams(ngram=3, skip=2))
    whole = np.unique(np.concatenate([h for h, _ in hasher.features(pa.array([text]))]))
    for most in (7, 50, 333):
        assert np.unique(np.concatenate([h for h, _ in hasher.features(pa.array([text]), most)])).tolist() == whole.tolist()
    model = Model(whole[::7], np.linspace(-1, 1, len(whole[::7])), 0.1, Grams(ngram=3, skip=2))
    scores = [model.scores(pa.array([text, "alpha", None]), hasher, most).tolist() for most in (5, 200, 4_000_000)]
    assert scores[0] == pytest.approx(scores[2]) and scores[1] == pytest.approx(scores[2])


def test_training_is_ftrl_and_repeatable(spark):
    """One shard and one round against FTRL-proximal written plainly; ids with labels that differ teach nothing."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["good", "fine", "word", "text", "page"] if i % 2 else ["bad", "foul", "word", "text", "page"], k=8))) for i in range(120)]
    docs = frame(spark, rows).repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    p = Ftrl(alpha=0.5, l1=0.01, step=8.0, rounds=1, shards=1, min_df=2)
    model = train(docs, labels, "quality", Grams(ngram=2), p)
    again = train(docs.repartition(2), labels, "quality", Grams(ngram=2), p)
    assert model.keys.tolist() == again.keys.tolist() and model.weights.tolist() == again.weights.tolist() and model.bias == again.bias

    used = [(float(i % 2), t) for i, t in rows if i != 5]
    found = next(iter(_features_of(Grams(ngram=2))(iter([pa.RecordBatch.from_arrays([pa.array([y for y, _ in used]), pa.array([t for _, t in used])], ["y", "text"])]))))
    feats = [set(np.frombuffer(f, dtype=np.uint32).tolist()) for f in found.column(1).to_pylist()]
    df = Counter(f for x in feats for f in x)
    keys = sorted(f for f, c in df.items() if c >= 2)
    place = {k: i for i, k in enumerate(keys)}
    packed = [np.array(sorted(place[f] for f in x if f in place), dtype=np.int32).tobytes() for x in feats]
    order = spark.createDataFrame([(i, bytearray(f), y) for i, (f, (y, _)) in enumerate(zip(packed, used, strict=True))], "i int, f binary, y double").selectExpr("i", "y", "xxhash64(f, y, 29) AS o").orderBy("o", "y", "i").collect()
    z, n = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)

    def weight(i):
        l1 = 0.0 if i == len(keys) else p.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)

    for r in order:
        at = [*np.frombuffer(packed[r.i], dtype=np.int32).tolist(), len(keys)]
        w = [weight(i) for i in at]
        g = (1 / (1 + np.exp(-sum(w))) - r.y) * p.step / len(at)
        for i, wi in zip(at, w, strict=True):
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha * wi
            n[i] += g * g
    want = {keys[i]: weight(i) for i in range(len(keys)) if weight(i)}
    assert dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(want)
    assert model.bias == pytest.approx(weight(len(keys)))
    assert len(_weights(z, n, p)) == len(keys) + 1


def test_no_labels_no_rows(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    model = train(docs, spark.createDataFrame([], "doc_id long, quality int"), "quality", Grams(), Ftrl())
    assert len(model.keys) == 0 and model.scores(pa.array(["a", None]), Hasher(Grams())).tolist() == [0.5, 0.5]


PLAIN = st.lists(st.sampled_from([*"aAbéÉßİ .,!?'\"\n\t\x1c\x85\xa0　123<|>_-中한", "<|endoftext|>", "́", "the ", " word", "  "]), max_size=40).map("".join)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(name):
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(tokenizer_path(name))
        ids = lambda t: tk.encode(t, add_special_tokens=False).ids
    else:
        import sentencepiece

        ids = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name)).encode

    @settings(max_examples=60, deadline=None)
    @given(st.lists(PLAIN, max_size=6), st.integers(1, 50), st.integers(3, 60))
    def check(texts, part, batch):
        enc = TextEncoder(tokenizer_path(name), batch_bytes=batch, part_chars=part)
        want = [ids(t) for t in texts]
        counts, got = enc.encode(pa.array(texts, pa.string()))
        assert counts.tolist() == list(map(len, want)) and got.tolist() == [i for w in want for i in w]
        assert enc.encode(pa.array(texts, pa.string()), want_ids=False)[0].tolist() == counts.tolist()

    check()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_both_ways_count_alike(spark, name):
    docs = frame(spark, [(1, "Hello  World\n\nfoo Bar"), (2, None), (3, "one two " * 300)])
    a, b = (sorted((r.doc_id, r.n_tokens) for r in token_counts(docs, tokenizer_path(name), words=w).collect()) for w in (False, True))
    assert a == b


def test_roots_twin():
    assert roots([1, 2, 3], [(2, 1)]) == {1: 1, 2: 1, 3: 3}
