import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from chronoloom.llm import tokens
from chronoloom.plans.materialize import new_folder


def brute(rows):
    own = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=repr)


def test_whole_table(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(tokens.token_round_trip(docs, shard_ids=60_000)) == brute(rows)


def test_odd_rows(spark):
    texts = [None, "", " ", "  ", "a  b", " lead", "trail ", "x<|endoftext|> y", "a\n\n b \n c", "don't I'LL", "  x", "é" * 5000, "aaaa " * 20000, "日本語 テキスト", "\t\t x", "same", "same", "\x00 \x1f"]
    rows = [(i - 3, t) for i, t in enumerate(texts)] + [(2, "again"), (2, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as ids")
    assert got(tokens.token_round_trip(df)) == brute(rows)
    assert tokens.token_round_trip(df.where("false")).count() == 0


def test_ranges_without_decoding_the_rest(spark, sf0001):
    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    folder = new_folder(spark, "tokens-test")
    manifest = tokens.write_tokens(docs, folder)
    shard = tokens.Shard(folder, manifest.first().path)
    ids = shard.all_ids()
    rng = np.random.default_rng(0)
    assert shard.n_symbols < shard.n_ids
    for _ in range(300):
        a, b = sorted(rng.integers(0, shard.n_ids + 1, 2).tolist())
        assert np.array_equal(shard.ids(a, b), ids[a:b])
        assert np.array_equal(shard.ids(a, a + 3), ids[a : a + 3])


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(1000), np.tile([5, 5, 7], 400), rng.integers(0, 50257, 3000), rng.integers(0, 9, 50_000)):
        ids = ids.astype(np.uint16)
        seq, rules, lengths = tokens.compress(ids)
        assert np.array_equal(tokens.expand(seq, rules), ids)
        assert [len(tokens.expand(np.array([tokens.BASE + k], np.uint16), rules)) for k in range(0, len(rules), 50)] == lengths[::50].tolist()


def test_copies_shrink_to_a_few_symbols():
    text = np.random.default_rng(2).integers(0, 50_000, 2000).astype(np.uint16)
    seq, rules, _ = tokens.compress(np.tile(text, 500))
    assert np.array_equal(tokens.expand(seq, rules), np.tile(text, 500)) and len(seq) + 2 * len(rules) < 10_000


def test_pieces_are_compared_by_their_bytes():
    rng = np.random.default_rng(3)
    words = [rng.integers(97, 123, int(rng.integers(0, 40))).astype(np.uint8) for _ in range(200)]
    data, sizes = np.concatenate(words), np.array([len(w) for w in words])
    at = np.cumsum(sizes) - sizes
    assert tokens.same_bytes(data, at, data.copy(), at, sizes)
    for k in rng.integers(0, len(data), 50):
        other = data.copy()
        other[k] ^= 1
        assert not tokens.same_bytes(data, at, other, at, sizes)


def test_read_back_takes_several_tasks(spark, sf0001):
    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    out = tokens.token_round_trip(docs, shard_ids=10_000)
    assert out.rdd.getNumPartitions() > 1


def test_words_are_learnt_once_whatever_marks_follow_and_stay_known_if_they_return():
    """A word with a comma, a full stop or a line's end was another word, and a full store forgot all words."""
    path = public_tokenizers.path(tokens.VOCABULARY)
    own = tokens.WordEncoder(path)
    words = [f"mot{k}é" for k in range(50)] + [f"word{k}" for k in range(50)]
    own.encode(["start " + " ".join(words)])
    size = len(own.known)
    texts = ["start" + "".join(f" {w}{mark}" for w in words) for mark in (",", ".", "!", ".\n")]
    ids, counts = own.encode(texts)
    assert ids.tolist() == [i for t in texts for i in own.whole(t).tolist()]
    assert len(own.known) == size + 4  # the marks and a line's end, not 400 words
    few = tokens.WordEncoder(path, cache_words=60)
    for k in range(12):
        few.encode([" ".join(["often", "comes", "back", *(f"w{k}x{j}" for j in range(20))])])
    learnt, learn = [], few._learn
    few._learn = lambda new: learnt.extend(new) or learn(new)
    few.encode(["x comes back"])
    assert learnt == []


def test_cut_pieces_equal_the_tokenizer_on_odd_texts():
    rng = np.random.default_rng(5)
    signs = ["a", "Bc", "7", "é", "×", "÷", "ß", "Ω", "中", " ", "　", "\n", "\n", "\r", "\t", "\x0b", "\x85", " ", " ", ".", ",", "'", "'s", "'ll", "’", "$", "^", "~", "\x7f", "\x00", "_", "\U0001f600", "́", "²", "ª", "-"]
    own = tokens.WordEncoder(public_tokenizers.path(tokens.VOCABULARY), cache_words=3000)
    for _ in range(40):
        texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(50)]
        ids, counts = own.encode(texts)
        want = [own.whole(t).tolist() for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]
