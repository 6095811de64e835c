"""The ten operators and the pipeline against brute force, with the odd rows that each must take."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import chat, common, decontamination, language_model, minhash, packing, pii, quality, quality_model, sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(3)
SYLLABLES = ["an", "the", "re", "on", "ti", "ha", "ou", "sh", "le", "mi", "ga", "do", "ez", "ü", "ñ"]


def prose(n, rng=RNG):
    return " ".join("".join(rng.choice(SYLLABLES, rng.integers(1, 5))) for _ in range(n))


def odd_documents():
    """Nulls in any column, empty and long texts, repeated rows, ties, astral characters."""
    rng = np.random.default_rng(3)
    a = prose(120, rng)
    long_text = prose(30000, rng) + "\n" + "x" * 50000 + "7" * 3000
    rows = [
        (1, a, "en", "h", 5), (2, a, None, None, None), (2, a, None, None, None), (None, a, "en", "h", 1), (None, None, None, None, None), (None, None, None, None, None),
        (3, "", "en", "h", 0), (4, " \n\t \x0b", "en", "h", 0), (5, None, "en", "h", 0), (6, long_text, "en", "g", 1), (7, "one two three", "en", "h", 1),
        (8, "mail \U0001F600 a.b@c.de or +1 (555) 123-4567 <|endoftext|> 10.0.0.1", "en", "h", 1), (9, a.replace("the", "teh", 1), "en", "g", 1),
    ]
    return rows + [(100 + k, prose(60 + k, rng), "en", f"s{k % 3}", 1) for k in range(30)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns named as the operators' own ones."""
    rows = [(*r, k, "x", [k], str(k), 1.5, "d", k) for k, r in enumerate(odd_documents()[:12])]
    return spark.createDataFrame(rows, SCHEMA + ", uid long, digest string, bands array<long>, label string, score double, _digest string, row long")


def test_all_operators_take_empty_tables_and_clashing_columns(spark, none, clashing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for f in (
        minhash.near_duplicates, minhash.deduplicated, lambda d: sharding.shard_documents(d, [1.0] * 4), lambda d: decontamination.contaminated(d, items), lambda d: decontamination.clean(d, items),
        packing.pack_documents, language_model.scored, lambda d: quality_model.scored(d, labels), pii.detected, pii.masked, quality.judged, quality.cleaned,
    ):
        assert f(none).count() == 0
        f(clashing).collect()
    for f in (minhash.deduplicated, lambda d: decontamination.clean(d, items), pii.masked, quality.cleaned):
        out = f(clashing)
        assert out.columns == clashing.columns
        own = {r.row: r.asDict() for r in clashing.collect()}
        for r in out.collect():
            assert {k: v for k, v in r.asDict().items() if k not in ("text", "n_chars")} == {k: v for k, v in own[r.row].items() if k not in ("text", "n_chars")}
    assert warc.derivatives(warc.responses(spark.createDataFrame([], "url string, html string"), "")).count() == 0
    assert chat.digests(chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# 1 near duplicates


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_signature_agreement_is_weighted_similarity():
    rng = np.random.default_rng(5)
    e = rng.integers(0, 2**62, 600).astype(np.uint64)
    x, y = rng.uniform(0.2, 9, 600), rng.uniform(0.2, 9, 600)
    x[:200] = y[:200]
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    sig = minhash.signatures(2, np.repeat([0, 1], 600), np.concatenate([e, e]), np.concatenate([x, y]), 4000)
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4000)
    # order and other documents do not matter
    again = minhash.signatures(3, np.full(600, 2), e[::-1], x[::-1], 4000)
    assert (again[2] == sig[0]).all() and (again[0] == 0).all()


def classes_by_brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                up[max(find(i), find(j))] = min(find(i), find(j))
    return Counter(frozenset(k for k in range(len(rows)) if find(k) == r) for r in {find(k) for k in range(len(rows))})


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    base = [prose(150, rng) for _ in range(6)]
    texts = []
    for t in base:
        words = t.split()
        for k in range(25):
            w = list(words)
            for at in rng.integers(0, len(w), rng.integers(0, 7)):
                w[at] = f"edit{rng.integers(0, 9)}"
            texts.append(" ".join(w))
    texts += [prose(80, rng) for _ in range(20)] + ["", None, " ", "a b", "A b", "a c", texts[0]]
    rows = list(enumerate(texts))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(set)
    for r in minhash.near_duplicates(d).collect():
        got[r.class_id].add(r.doc_id)
    want = classes_by_brute_force(rows)
    assert Counter(frozenset(v) for v in got.values()) == want
    assert all(min(v) == k for k, v in got.items())
    kept = {r.doc_id for r in minhash.deduplicated(d).collect()}
    assert kept == {min(c) for c in want}


def test_buckets_with_several_components_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    texts = [f"{c} " * 20 + " ".join(f"{c}{k}" for k in range(40)) for c in "xyz"]
    sketch = [bytes(range(216)), bytes(range(1, 217)), bytes(range(2, 218))]
    sketches = spark.createDataFrame([(k, sketch[k % 3]) for k in range(30)], "uid long, sketch binary")
    own = spark.createDataFrame([(k, texts[k % 3]) for k in range(30)], "uid long, text string")
    members = spark.createDataFrame([(7, k) for k in range(30)], "bucket long, uid long")
    labels = spark.createDataFrame([(k, k % 3) for k in range(6)], "uid long, label long")
    likely = {(r.a, r.b) for r in minhash.likely_pairs(members, labels, sketches).collect()}
    assert likely and len(likely) < 30 and all(a % 3 == b % 3 and a < b for a, b in likely)
    links = minhash.remaining_links(members, labels, sketches, own, 0.8).unionByName(spark.createDataFrame([(0, 3), (1, 4), (2, 5)], "a long, b long"))
    assert {r.uid: r.label for r in minhash.components(links).collect()} == {k: k % 3 for k in range(30)}
    # what agrees in its signature alone is no link
    other = spark.createDataFrame([(k, f"text {k} " + prose(30)) for k in range(30)], "uid long, text string")
    assert minhash.remaining_links(members, labels, sketches, other, 0.8).count() == 0


def test_the_gate_of_buckets_loses_less_than_banding():
    gate = math.ceil(minhash.AGREEMENT * minhash.BANDS * minhash.WIDTH)
    n = minhash.BANDS * minhash.WIDTH
    lost = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(gate))
    assert lost < (1 - 0.8**minhash.WIDTH) ** minhash.BANDS


def test_pairs_of_weaker_signatures_are_verified(spark):
    # the pairs (0, 1) and (0, 2) agree in 150 of 216 coordinates, (1, 2) in 84
    one, far = bytes(range(216)), [bytes((x + 1) % 256 if a <= k < a + 66 else x for k, x in enumerate(range(216))) for a in (0, 66)]
    text = " ".join(f"w{k}" for k in range(100))
    sketches = spark.createDataFrame([(0, one), (1, far[0]), (2, far[1])], "uid long, sketch binary")
    texts = spark.createDataFrame([(k, f"{text} x{k}") for k in range(3)], "uid long, text string")
    members = spark.createDataFrame([(7, k) for k in range(3)], "bucket long, uid long")
    labels = spark.createDataFrame([(5, 5)], "uid long, label long")
    assert {(r.a, r.b) for r in minhash.remaining_links(members, labels, sketches, texts, 0.8).collect()} == {(0, 1), (0, 2)}


def test_components_of_long_paths(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 90), (90, 95)]
    got = {r.uid: r.label for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 90: 90, 95: 90, 100: 90}


def test_near_duplicates_of_odd_rows(odd):
    rows = odd_documents()
    got = minhash.near_duplicates(odd)
    assert got.count() == len(rows)
    sizes = sorted(r.class_size for r in minhash.classes(odd).groupBy("label").count().withColumnRenamed("count", "class_size").collect())
    assert sizes == sorted(len(c) for c in classes_by_brute_force([(r[0], r[1]) for r in rows]))


# 2 WARC


def test_warc_records_link_to_their_response(spark, tmp_path):
    html = "<html><head><title> A &amp; B </title><style>p{}</style></head><body><!-- c --><p>One<br>two &lt;3</p><script>x<y</script></body></html>"
    pages = spark.createDataFrame([("http://a/", html), ("http://a/", html), (None, None), ("http://b/", "")], "url string, html string")
    rec = warc.responses(pages, "2024-01-01T00:00:00Z")
    rows = warc.derivatives(rec).collect()
    assert len(rows) == 8
    ids = {r.record_id for r in rec.collect()}
    assert {r.refers_to for r in rows} == ids
    one = [r for r in rows if r.target_uri == "http://a/"]
    text = next(r for r in one if r.type == "conversion")
    meta = next(r for r in one if r.type == "metadata")
    assert text.content == "One\ntwo <3" and text.concurrent_to == meta.record_id and meta.concurrent_to == text.record_id
    assert "title: A &amp; B" in meta.content and "source-header: Content-Type: text/html; charset=utf-8\r\n" in meta.content
    assert text.source_payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert text.block_digest == "sha256:" + hashlib.sha256(text.content.encode()).hexdigest() and text.content_length == len(text.content.encode())
    other = spark.createDataFrame([("<r>", None, None, "HTTP/1.1 404 No\r\nContent-Type: application/pdf\r\n\r\n%PDF"), ("<s>", "u", "d", None)], "record_id string, target_uri string, date string, block string")
    got = warc.derivatives(other).collect()
    assert [r.type for r in got] == ["metadata", "metadata"] and got[0].content.startswith("status: 404\r\nsource-header: Content-Type: application/pdf\r\n")
    warc.write(warc.derivatives(rec).coalesce(1), str(tmp_path / "w"))
    whole = b"".join(zlib.decompress(f.read_bytes(), 31) for f in (tmp_path / "w").glob("*.gz"))
    n = 0
    while whole:
        head, _, rest = whole.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
        whole, n = rest[size + 4 :], n + 1
    assert n == 8


# 3 sharding


def test_rendezvous_weights_and_growth(spark):
    d = spark.range(20000).withColumnRenamed("id", "key")
    w = [1.0, 2.0, 0.0, 1.0]
    a = {r.key: r.shard for r in sharding.assign(d, "key", w).collect()}
    n = Counter(a.values())
    assert n[2] == 0 and abs(n[1] / 20000 - 0.5) < 0.02 and abs(n[0] / 20000 - 0.25) < 0.02
    b = {r.key: r.shard for r in sharding.assign(d, "key", [*w, 4.0]).collect()}
    assert all(b[k] in (a[k], 4) for k in a) and abs(sum(s == 4 for s in b.values()) / 20000 - 0.5) < 0.02
    with pytest.raises(ValueError):
        sharding.assign(d, "key", [0.0])


def test_slots_are_gapless(spark, odd, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_BLOCK", 3)
    big = odd.unionByName(spark.range(3000).selectExpr("5L doc_id", "'same' text", "'' lang", "'' source", "1L n_chars"))
    got = sharding.shard_documents(big, [1.0] * 5).collect()
    assert len(got) == big.count()
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    texts = Counter((r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 16) for r in odd_documents()) + Counter({(5, zlib.crc32(b"same"), 20): 3000})
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in got) == texts
    assert all(len({r.shard for r in got if r.doc_id == k}) == 1 for k in (None, 2, 5))


# 4 decontamination


def edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, c in enumerate(text, 1):
            row[j] = min(last[j - 1] + (p != c), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_bit_parallel_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        p = "".join(rng.choice(list("abc"), rng.integers(1, 70)))
        t = "".join(rng.choice(list("abc"), rng.integers(0, 120)))
        assert decontamination.nearest(decontamination.pattern_masks(p), len(p), t)[0] == edit_distance_within(p, t)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = np.random.default_rng(4)
    items = [(k, prose(20, rng)) for k in range(6)] + [(6, "tiny"), (7, ""), (8, None), (9, "  ")]
    docs = []
    for k in range(40):
        t = list(items[k % 6][1])
        for _ in range(rng.integers(0, 16)):
            at = rng.integers(0, len(t))
            t[at] = rng.choice(["", "zz", "q"])
        docs.append((k, prose(30, rng) + "  " + "".join(t).upper() + "\n" + prose(30, rng)))
    docs += [(40, None), (41, ""), (None, "TINY " + items[0][1]), (42, items[1][1][:-3])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in decontamination.contaminated(d, b, 0.08, block_bytes).collect()), key=str)
    want = []
    for i, t in docs:
        for k, x in items:
            p = decontamination.normal(x)
            if p and (e := edit_distance_within(p, decontamination.normal(t))) <= int(len(p) * 0.08):
                want.append((i, k, e))
    assert got == sorted(want, key=str) and len(want) > 10
    bad = {i for i, _, _ in want}
    assert sorted((r.doc_id for r in decontamination.clean(d, b, 0.08, block_bytes).collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)


# 5 packing


def test_packing_round_trip(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizer()[0])
    rows = packing.pack_documents(odd, 64).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    last = max(by)
    assert sorted(by) == list(range(last + 1))
    for s, own in by.items():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        assert sum(r.length for r in own) == 64 or s == last
    docs = Counter((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in odd_documents())
    whole, at = Counter(), {}
    for s in range(last + 1):
        for r in by[s]:
            ids = tuple(np.frombuffer(r.ids, dtype="<u2").tolist())
            assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes()) and r.boundary == (r.length < r.doc_tokens)
            assert r.start == len(at.get(r.doc_id, ()))
            at[r.doc_id] = at.get(r.doc_id, ()) + ids
            if len(at[r.doc_id]) == r.doc_tokens:
                whole[r.doc_id, at.pop(r.doc_id)] += 1
    assert whole == docs and not at


def test_both_tokenizers_give_the_same_ids():
    from tokenizers import Tokenizer

    ids, t = packing.encoder(*packing.public_tokenizer()), Tokenizer.from_file(packing.public_tokenizer()[0])
    for s in ("", "  a\n\n b\t", "Ünïcødé 你好 \U0001F600's it'LL", "x" * 3000, "a<|endoftext|>b", " \xa0 1234 ١٢٣ !?"):
        assert list(ids(s)) == t.encode(s, add_special_tokens=False).ids


# 6 language model


def tree_by_brute_force(counts, ranks, text):
    """log10 probability by recursion over bit contexts, with counts in dictionaries."""
    nodes = defaultdict(lambda: [0, 0])

    def steps(unit):
        data = unit[:1] + b" " + unit[1:] + b" "
        for k in range(2, len(data)):
            ctx = (b" " * 9 + data[:k])[-language_model.DEPTH :][::-1]
            for p in range(8):
                yield ctx, p, data[k] >> (8 - p), data[k] >> (7 - p) & 1

    for unit, n in counts.items():
        for ctx, p, prefix, bit in steps(unit):
            for depth in range(language_model.DEPTH + 1):
                nodes[ctx[:depth], p, prefix][bit] += n
    children = defaultdict(set)
    for ctx, p, prefix in nodes:
        if ctx:
            children[ctx[:-1], p, prefix].add((ctx, p, prefix))
    own = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in nodes.items()}
    weighted = {}
    for k in sorted(nodes, key=lambda k: -len(k[0])):
        below = sum(weighted[c] for c in children[k])
        weighted[k] = own[k] if len(k[0]) == language_model.DEPTH else np.logaddexp(own[k], below) - math.log(2)
    total = 0.0
    for unit in language_model.units(language_model.tokens(text), ranks):
        for ctx, p, prefix, bit in steps(unit):
            mixed = 0.5
            for depth in range(language_model.DEPTH, -1, -1):
                k = (ctx[:depth], p, prefix)
                if k not in nodes:
                    continue
                c = nodes[k]
                estimate = (c[bit] + 0.5) / (sum(c) + 1)
                w = 1.0 if depth == language_model.DEPTH else 0.5 * math.exp(own[k] - weighted[k])
                mixed = w * estimate + (1 - w) * mixed
            total += math.log10(mixed)
    return total


def test_language_model_equals_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(language_model, "WORD_BLOCK", 50)
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 2000)
    rows = [(i, t) for i, t, *_ in odd_documents() if i != 6] + [(10, "The END of the end, THE \xc4\xe4 of it")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    ranks = language_model.opening_words(d)
    short = Counter(w for i, t in rows if not held(i) for w in language_model.tokens(t) if 0 < len(w) <= 4)
    assert list(ranks) == [w for w, _ in sorted(short.items(), key=lambda x: (-x[1], x[0]))[:64]]
    plain, units = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            plain.update(language_model.tokens(t))
            units.update(language_model.units(language_model.tokens(t), ranks))
    n, v = sum(plain.values()), len(plain)
    got = language_model.scored(d).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        k = language_model.tokens(t)
        want.append((str(i), held(i), len(k), sum(plain[w] > 0 for w in k), n, sum(math.log10((plain[w] + 1) / (n + v + 1)) for w in k), tree_by_brute_force(units, ranks, t)))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_bytes_of_a_context_add_up_to_one():
    words = [b"\x00ab", b"\x00abc", b"\x00b"]
    pair, word = language_model.contexts(words)
    pair, inv = np.unique(pair, return_inverse=True)
    n = np.bincount(inv, weights=np.array([5, 2, 9])[word]).astype(np.int64)
    ctx = int(pair[0]) >> 8
    every = np.array([ctx << 8 | b for b in range(256) if ctx << 8 | b not in set(pair.tolist())] + pair.tolist())
    counts = dict(zip(pair.tolist(), n.tolist(), strict=True))
    counts = np.array([counts.get(p, 0) for p in every.tolist()])
    shape = (256, 256)
    zeros, ones, below = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    trees = [language_model.Tree(every, counts, p) for p in range(8)]
    for t in trees:
        node, _, a, b, _, w = t.levels[-1]
        for x, y in ((zeros, a), (ones, b), (below, w)):
            np.add.at(x, (node >> 8 & 255, node & 255), y)
    top = []
    for _ in range(2):
        own = language_model.log_estimate(zeros, ones)
        w = np.logaddexp(own, below) - math.log(2)
        top.append((0.5 * np.exp(own - w), zeros, ones))
        zeros, ones, below = (x.sum(axis=0, keepdims=True) for x in (zeros, ones, w))
    score = sum(t.log_probability(tuple(top)) for t in trees)
    assert abs((10 ** score[every >> 8 == ctx]).sum() - 1) < 1e-9


# 7 chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", r"\</s>\\[\INST]\n", "", None, "<\\s> [/INST]<s>", "a\nb\U0001F600", r"<\/s>\\"]
    rows = [(k % 5, k // 5, ["user", "assistant", "system", None, "</s>"][(k * 7) % 5], nasty[k % 7]) for k in range(35)]
    rows += [(None, None, "assistant", "x"), (None, 0, None, None), (9, 1, "user", "only"), (8, 2, "assistant", "z"), (8, 2, "assistant", "z"), (8, 2, "assistant", "y")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.examples(d)).collect()}
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((n is not None, n or 0, r or "", t or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    ex = chat.examples(d).filter("conv_id = 8").orderBy("example").collect()
    assert [x.formatted[x.loss_start : x.loss_start + x.loss_length] for x in ex] == ["y", "z", "z"]
    assert all(b.formatted.startswith(a.formatted) for a, b in zip(ex, ex[1:]))


# 8 quality model


def test_quality_model_holds_out_and_separates(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(400):
        good = int(rng.random() < 0.6)
        words = prose(60, rng).split()
        rows.append((k, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((k, good, 0))
    rows += [(None, None), (900, ""), (901, rows[0][1])]
    labels += [(None, 1, 0), (1, None, 0), (0, labels[0][1], 1)]
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_model.scored(d, y).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert {k for k in range(400) if got[k].held_out} == set(held)
    assert np.mean([got[k].predicted == labels[k][1] for k in held]) > 0.95
    assert got[901].score == got[0].score
    x, t = quality_model.training_rows(quality_model.pooled(d, np.zeros((quality_model.ROWS, quality_model.DIMS), dtype=np.float32)), y)
    assert len(x) == len([k for k in range(400) if k not in held])
    # held-out labels change nothing
    other = spark.createDataFrame([(a, 1 - b if a in held else b, c) if b is not None else (a, b, c) for a, b, c in labels], "doc_id long, quality int, toxic int")
    assert {k: r.score for k, r in got.items()} == {r.doc_id: r.score for r in quality_model.scored(d, other).collect()}
    assert quality_model.scored(d, y.limit(0)).filter("score <> 0.5").count() == 0


def test_context_sums_equal_brute_force(spark):
    texts = ["aa bb, aa", "bb\naa AA1", None, ""]
    got = quality_model.context_sums(spark.createDataFrame([(t,) for t in texts], "text string"))
    place, sign = quality_model.index_vectors()
    want = np.zeros_like(got)
    for t in texts:
        rows, _ = quality_model.word_rows([(t or "").encode()])
        for i in range(len(rows)):
            for j in range(max(0, i - 2), min(len(rows), i + 3)):
                for k in range(quality_model.ENTRIES):
                    want[rows[i], place[rows[j], k]] += sign[rows[j], k]
    assert (got == want).all() and want.any()
    assert len(quality_model.word_rows([b"aa bb, aa", b"bb\naa AA1"])[0]) == 9


# 9 personal data

PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    out = []
    for kind, p in PLAIN:
        for m in re.finditer(p, text):
            x, d = m.group(), re.sub("[^0-9]", "", m.group())
            total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
            ok = {"email": True, "ip": kind == "ip" and all(int(y) <= 255 for y in x.split(".")), "card": 13 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            out += [(kind, m.start(), m.end())] * ok
    return out


def pii_texts():
    rng = np.random.default_rng(8)
    signs = list("0123456789") + list("aZ._%+-@ ()") + ["\U0001F600", "ü", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "+1 (555) 123-4567", "\n"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(400)]
    return texts + [None, "", "x@a.b_c@d.e", "1.2.3.4.5.6.7.8", "9" * 5000, "1-" * 4000, "a." * 4000 + "@b.c", "+1" + " " * 3000 + "2", 'token = "0a1b2c3d4e5f60718293"', "ip 010.000.0255.7", "4111-1111-1111-1111 4111-1111-1111-1112"]


def test_base_spans_equal_plain_rules(spark):
    texts = pii_texts()
    got = {r.doc_id: r for r in pii.detected(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        want = base_spans(t or "")
        n = Counter(x[0] for x in want)
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(n[x] for x in pii.BASE), t
        told = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert got[k].base_sha256 == hashlib.sha256(told.encode()).hexdigest(), t
        assert not set(told.split(",")) - set(got[k].spans.split(",")) - {""}


def test_added_spans_and_masks(spark):
    rows = [(k, f"word {prose(5)} token = \"{hashlib.sha1(str(k).encode()).hexdigest()}\" then card 4111 1111 1111 1111 and {k}.b@c.de.", k) for k in range(30)]
    rows += [(99, "nothing here", None), (98, None, None), (97, "plain numbers 2024 and 17", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.detected(d).collect()}
    assert all("secret:" in got[k].spans for k in range(30)) and got[99].spans == got[98].spans == got[97].spans == ""
    out = {r.doc_id: r for r in pii.masked(d).collect()}
    for k in range(30):
        assert out[k].text == re.sub(r'"[0-9a-f]{40}"', '"<secret>"', rows[k][1]).replace("4111 1111 1111 1111", "<card>").replace(f"{k}.b@c.de", "<email>")
        assert out[k].n_chars == len(out[k].text)
    assert (out[99].text, out[98].text, out[97].n_chars) == ("nothing here", None, 4)


def test_overlapping_spans_are_masked_in_whole(spark):
    texts = ["at 10.0.0.1@example.com now", "x 4111 1111 1111 1111@b.cd y", "+1 555 123 4567.1.2.3 z", "a@b.c d@e.f", "none"]
    model = pii.Model((0.0,) * len(pii.FEATURES), -10.0, {})
    got = {r.doc_id: r.text for r in pii.masked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert got[0] == "at <email> now" and got[3] == "<email> <email>" and got[4] == "none"
    for k, t in enumerate(texts):
        inside = {x for _, a, b in base_spans(t) for x in range(a, b)}
        assert re.sub("<[a-z]+>", "", got[k]) == "".join(c for x, c in enumerate(t) if x not in inside)


def test_estimation_finds_reliable_labelers():
    rng = np.random.default_rng(6)
    true = rng.random(20000) < 0.4
    right = np.array([0.95, 0.8, 0.7, 0.6])
    votes = np.where((rng.random((20000, 4)) < right) == true[:, None], 1, -1)
    patterns = [("card", tuple(int(x) for x in v), int(n)) for v, n in zip(*np.unique(votes, axis=0, return_counts=True), strict=True)]
    share, rates = pii.estimate(patterns)
    assert abs(share["card"] - 0.4) < 0.05
    assert all(abs(rate[1][0] - r) < 0.06 for rate, r in zip(rates, right, strict=True))


# 10 quality rules


def test_base_measures_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    texts = [r[1] for r in odd_documents()] + [" ".join(rng.choice(list("ab#"), n)) + "\nx\nx \nx" for n in (1, 2, 3, 4, 50, 200)] + ["a b c a b c\x0b a", "# | &\n\n \n"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.measures(d, "doc_id").collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {i + k for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    rng = np.random.default_rng(13)
    banner = "All rights reserved 2024 , do not copy"
    rows = [(k, f"{banner.replace('4', str(k % 10))}\n{prose(80, rng)}", "h") for k in range(40)]
    notices = "\n".join(prose(12, rng) for _ in range(5))
    rows += [(100 + k, f"{banner}\n{notices}\nword{k} " + prose(3, rng), "h") for k in range(40)]
    # the same line below the other hosts' limits, and many copies of one text, which count once
    rows += [(200, f"{banner}\n{prose(80, rng)}", "other"), (201, rows[0][1], None)] + [(300, prose(90, rng), "h")] * 60
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = defaultdict(list)
    for r in quality.judged(d, 0.1, 10).collect():
        got[r.doc_id].append(r)
    assert all(got[k][0].kept for k in (*range(40), 200, 201)) and len(got[300]) == 60 and all(r.kept for r in got[300])
    assert not any(got[100 + k][0].kept for k in range(40))
    # the rejection is the method's own
    assert not any(got[100 + k][0].base_failed for k in range(40))
    out = {r.doc_id: r.text for r in quality.cleaned(d, 0.1, 10).collect()}
    assert out == {k: t.split("\n")[1] if k < 40 else t for k, t, _ in rows if not 100 <= k < 140}


def test_the_limit_follows_the_host(spark):
    """A line is removed above a share of the host's distinct texts and above the floor, and not at them."""
    rng = np.random.default_rng(14)
    line = lambda n: f"line of {'abcdefghij'[n % 10]}{'abcdefghij'[n // 10]} texts"
    rows = []
    for host, size, counts in (("large", 60, (5, 12, 13)), ("small", 12, (5, 6))):
        for k in range(size):
            own = [line(n) for n in counts if k < n]
            rows.append((1000 * len(host) + k, "\n".join([*own, prose(80, rng)]), host))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = quality.measures(d.withColumn("host", F.col("source")).withColumn("digest", F.md5(F.col("text").cast("binary"))), "host", "digest")
    got = {(r.host, r.texts, r.documents) for r in quality.frequent_lines(m.union(m), 0.2, 5).collect()}
    assert got == {("large", 13, 26), ("small", 6, 12)}
    out = {r.doc_id: r.text for r in quality.cleaned(d, 0.2, 5).collect()}
    gone = {"large": line(13), "small": line(6)}
    assert out == {i: "\n".join(x for x in t.split("\n") if x != gone[h]) for i, t, h in rows}


def test_pipeline_stages_keep_columns(spark, odd, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = str(tmp_path)
    odd.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, odd_documents()[20][1][:150])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        assert docs.columns == odd.columns
    ids = {r.doc_id for r in docs.collect()}
    # one of the copies 1 and 2 stays; short, empty and contaminated ones go, and of the near copies 1 and 9 the least
    assert len(ids & {1, 2}) == 1 and odd_documents()[20][0] not in ids and not ids & {3, 4, 5, 7, 9}
    direct = {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()}
    assert {x[0] for x in direct} == ids


def test_word_hashes_tell_words_apart():
    data, starts = common.joined([b"ab ba", b"ab", b""])
    first, last = common.word_ranges(data)
    h = common.token_hashes(data, first, last)
    assert len(h) == 3 and h[0] == h[2] and h[0] != h[1]


def test_long_white_space_is_encoded(spark):
    """Runs of white space beyond what the fast library's pattern takes have the ids of the contract's library."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.public_tokenizer()[0])
    texts = ["a" + run + "b" for run in (" " * 1_100_000, "\n" * 1_100_000, " \n" * 550_000)]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for k, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(bytes(r.ids), dtype="<u2") for r in own])
        assert ids.tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1]


def plain_by_steps(t):
    """The clean-up, one plain pattern after another."""
    for pattern, by in [
        (r"(?s)<!--.*?-->", ""), *[(rf"(?is)<{n}\b[^>]*>.*?</{n}\s*>", "") for n in warc.DROPPED], (rf"(?i)</?(?:{warc.BLOCKS})\b[^>]*>", "\n"), (r"<[!/?a-zA-Z][^>]*>", ""),
    ]:
        t = re.sub(pattern, by, t, flags=re.ASCII)
    for name, sign in warc.ENTITIES:
        t = t.replace(name, sign)
    return re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f\x0B]+", " ", t)).strip(" \n")


def test_plain_text_of_broken_pages_equals_the_steps(spark):
    rng = np.random.default_rng(8)
    names = [*warc.DROPPED, "p", "BR", "h1", "header", "Li", "b", "a", "title", "pre", "scriptx"]
    signs = ["<!--", "-->", "<!-->", ">", "<", "&", "&lt;", "&amp;lt;", "&nbsp;", "&#39", "&amp;amp;", "  ", " \n", "\n ", "\t", "\r\n", "\x0b", "x", " é", "word one", "$1", "</scr", "ipt>", "<sty", "le>"]
    forms = ["<{}>", "</{}>", "<{}", "</{}", "</{} >", '<{} a="b">', "</{}\n", "<{}/>", "<{}>x</{}>"]
    piece = lambda: rng.choice(forms).replace("{}", rng.choice(names)) if rng.random() < 0.5 else rng.choice(signs)
    pages = ["".join(piece() for _ in range(n)) for n in rng.choice([1, 3, 8, 20, 60], 1500)]
    h = F.col("html")
    rows = spark.createDataFrame([(x,) for x in pages], "html string").select(h, warc.plain_text(h).alias("text"), warc.title_of(h).alias("title")).collect()
    title = re.compile(r"(?is)<title\b[^>]*>(.*?)</title\s*>", re.ASCII)
    for r in rows:
        assert r.text == plain_by_steps(r.html), r.html
        assert r.title == re.sub(r"\s+", " ", (title.search(r.html) or [""] * 2)[1], flags=re.ASCII).strip(" ")


def test_clean_up_searches_each_element_once(spark):
    """Texts are not put in lower case and not searched for a last closing tag beforehand; that took half of the time."""
    h = F.col("html")
    plan = spark.range(1).selectExpr("'' AS html").select(warc.plain_text(h).alias("a"), warc.title_of(h).alias("b"))._jdf.queryExecution().analyzed().expressions().toString()
    assert not re.search(r"\blower\(", plan) and len(re.findall(r"\bregexp_(?:replace|extract)\(", plan)) <= 14


@pytest.mark.parametrize("unit", ["<script>", "<!--", "<title>", "<p", "<head>x</head ", "<style>a</style>"])
def test_long_pages_of_unclosed_tags_take_linear_time(spark, unit):
    """A megabyte of openings that never close; a text before and behind stays."""
    html = "<b>before</b> " + unit * (1_000_000 // len(unit)) + " &amp; behind"
    d = spark.createDataFrame([(html, "u")], "html string, url string")
    began = time.perf_counter()
    row = warc.derivatives(warc.responses(d, "2024-01-01T00:00:00Z")).filter("type = 'conversion'").first()
    assert time.perf_counter() - began < 30
    assert row.content.startswith("before") and row.content.endswith("& behind")
