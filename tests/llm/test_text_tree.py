"""The context tree over running text against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidegrid.llm import queries, text_tree
from tidegrid.llm.common import pieces
from tidegrid.llm.language_model import tokens


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def steps(text):
    data = b" " * 6 + b"".join(w + b" " for w in tokens(text))
    for k in range(6, len(data)):
        for p in range(8):
            yield data[k - 6 : k][::-1], p, data[k] >> (8 - p), data[k] >> (7 - p) & 1


def brute_force(rows):
    """log10 probability of each text by recursion over bit contexts of the whole text, with counts in dictionaries."""
    nodes = defaultdict(lambda: [0, 0])
    for i, t in rows:
        if not held(i):
            for ctx, p, prefix, bit in steps(t):
                for depth in range(7):
                    nodes[ctx[:depth], p, prefix][bit] += 1
    own = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in nodes.items()}
    below, weighted = defaultdict(float), {}
    for k in sorted(nodes, key=lambda k: -len(k[0])):
        weighted[k] = own[k] if len(k[0]) == 6 else np.logaddexp(own[k], below[k]) - math.log(2)
        if k[0]:
            below[(k[0][:-1], *k[1:])] += weighted[k]
    for _, t in rows:
        total = 0.0
        for ctx, p, prefix, bit in steps(t):
            mixed = 0.5
            for depth in range(6, -1, -1):
                k = (ctx[:depth], p, prefix)
                if k in nodes:
                    w = 1.0 if depth == 6 else 0.5 * math.exp(own[k] - weighted[k])
                    mixed = w * (nodes[k][bit] + 0.5) / (sum(nodes[k]) + 1) + (1 - w) * mixed
            total += math.log10(mixed)
        yield total


@pytest.mark.parametrize("chunk, part, hot", [(1500, 97, 1 << 20), (1 << 24, 1 << 21, 1 << 20), (1500, 97, 8), (4000, 1 << 21, 60)])
def test_scores_of_running_text_equal_brute_force(spark, monkeypatch, chunk, part, hot):
    monkeypatch.setattr(text_tree, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(text_tree, "SLICE", part)
    monkeypatch.setattr(text_tree, "HOT_PAIRS", hot)
    rng = np.random.default_rng(4)
    words = ["the", "cat", "sat", "on", "a", "mat", "ünd", "Über", "x" * 30]
    rows = [(k, "  ".join(rng.choice(words, rng.integers(0, 40)))) for k in range(60)] + [(None, None), (None, ""), (3, "the\ncat\tTHE \x00 \U0001F600"), (9, " ")]
    plain = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(plain.values()), len(plain)
    want = [
        (str(i), held(i), len(tokens(t)), sum(plain[w] > 0 for w in tokens(t)), n, sum(math.log10((plain[w] + 1) / (n + v + 1)) for w in tokens(t)), s, -s * math.log2(10) / sum(len(w) + 1 for w in tokens(t)))
        for (i, t), s in zip(rows, brute_force(rows), strict=True)
    ]
    got = sorted(tuple([str(r[0]), *r[1:]]) for r in text_tree.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(got) == len(rows)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_order_of_words_counts_in_the_query(spark, tmp_path):
    # the words after the 64th in another order: a model whose contexts end at blanks gives equal scores
    words = [f"w{k % 7} v{k % 11}" for k in range(150)]
    other = words[:64] + sorted(words[64:])
    rows = [(k, " ".join(words)) for k in range(20)] + [(100, " ".join(words)), (101, " ".join(other))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.QUERIES["op6_context_tree_weighting"](spark, str(tmp_path)).collect()}
    assert got[100] > got[101] + 1


@pytest.mark.parametrize("part", [40, 1 << 21])
def test_words_are_cut_as_one_array(monkeypatch, part):
    # no list of Python objects a token: the words are an Arrow dictionary, their order by bucket is an array
    monkeypatch.setattr(text_tree, "pieces", lambda texts: pieces(texts, part))
    texts = [None, "", "  ", "b a\tb", "\x00 ünd \U0001F600 \xa0", "x" * 100, "a b " * 30, "B", None]
    lists = [tokens(t) for t in texts]
    for own in (lists, [[b""]]):
        told = text_tree.Words([text_tree.running(w) for w in own])
        assert told.words.take(told.code).to_pylist() == [w for x in own for w in x] and told.size.tolist() == [len(x) for x in own]
        order, buckets, first = text_tree.bucketed(told.words)
        words = told.words.take(order).to_pylist()
        each = np.repeat(buckets, np.diff(first, append=len(words))).tolist()
        assert len(set(words)) == len(words) and each == [zlib.crc32(w) % text_tree.WORD_BUCKETS for w in words]
        assert list(zip(each, words)) == sorted(zip(each, words))


def test_empty_table(spark):
    assert text_tree.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_contexts_are_split_until_their_cells_are_small(spark, monkeypatch):
    # "the " stands before half of all words, so its subtree is hot at several depths
    monkeypatch.setattr(text_tree, "HOT_PAIRS", 40)
    rows = [(k, " ".join(f"the {chr(97 + k % 26)}{j % 9}{chr(97 + j % 26)}" for j in range(40))) for k in range(60)]
    stored = text_tree.stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    pairs = stored.filter(stored.kind == text_tree.PAIRS)
    hot = text_tree.hot_contexts(pairs)
    assert set(hot) >= {2, 3, 4} and any(c == int.from_bytes(b" eht") for c in hot[4])
    total: Counter = Counter()
    for r in text_tree.in_cells(pairs, hot).collect():
        key = np.cumsum(text_tree.unpacked(r.body))
        assert (text_tree.cells(key, hot)[1] == r.bucket).all()
        total[r.depth, r.bucket] += len(key)
    assert sum(total.values()) == sum(r.size for r in pairs.collect())
    bound = max(40, sum(total.values()) // 1024)
    assert all(n <= bound for (depth, _), n in total.items() if depth < text_tree.DEPTH)
