import math
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
from samples import prose

from pagewright.llm import ann, langid, lm, neardup, warc


# ------------------------------------------------------------------ language model


def tree_by_hand(texts, text, depth):
    """Log10 probability of a text under context-tree weighting, node by node."""
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        data = b"\n" * depth + t
        for i in range(depth, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                for d in range(depth + 1):
                    counts[data[i - d : i][::-1], node][bit] += 1
                node = node * 2 + bit
    children = defaultdict(set)
    for context, node in counts:
        if context:
            children[context[:-1], node].add(context)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    weighted = {}

    def pw(context, node):
        if (context, node) not in weighted:
            own = kt(*counts[context, node])
            if len(context) < depth:
                below = sum(pw(c, node) for c in sorted(children[context, node]))
                weighted[context, node] = np.logaddexp(own, below) - math.log(2)
            else:
                weighted[context, node] = own
        return weighted[context, node]

    total, data = 0.0, b"\n" * depth + text
    for i in range(depth, len(data)):
        node = 1
        for k in range(7, -1, -1):
            bit, done, rest, p = data[i] >> k & 1, 0.0, 1.0, 0.5
            for d in range(depth + 1):
                context = data[i - d : i][::-1]
                a, b = counts.get((context, node), (0, 0))
                if not a + b:
                    break
                own = (b + 0.5) / (a + b + 1)
                p = done + rest * own
                stop = 1.0 if d == depth else math.exp(kt(a, b) - math.log(2) - pw(context, node))
                done, rest = done + rest * stop * own, rest * (1 - stop)
            total += math.log10(p if bit else 1 - p)
            node = node * 2 + bit
    return total


def test_lm_scores(spark):
    rows = [(i, " ".join(prose(i % 7, 12))) for i in range(40)] + [(100, None), (101, "Ünseen ÉÀ text 漢"), (None, "the on")]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), depth=3).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    words = {i: (t or "").encode().translate(lm.LOWER).split() for i, t in rows}
    train = Counter(w for i, own in words.items() if not held(i) for w in (*own, b""))
    n, v = sum(train.values()), len(train)
    texts = [b" ".join(own) + b"\n" for i, own in words.items() if not held(i)]
    assert len(got) == len(rows)
    for r in got:
        own = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(r["doc_id"]), len(own) + 1, n)
        assert r["n_known"] == sum(train[w] > 0 for w in (*own, b""))
        assert abs(r["base_score"] - sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in (*own, b""))) < 1e-6
        assert abs(r["score"] - tree_by_hand(texts, b" ".join(own) + b"\n", 3)) < 1e-3


def test_lm_bytes_sum_to_one():
    """The probabilities of all bytes after a context sum to 1."""
    chunk = lm.Chunk([1, 2], [b"the cat sat on the mat", b"a cat"], 2, 10)
    chunk.held[:] = False
    keys, counts = chunk.grams()
    context = keys[len(keys) // 2] >> np.uint64(8)
    full = np.unique(np.concatenate([keys, (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)]))
    n = np.zeros(len(full), np.int64)
    n[np.searchsorted(full, keys)] = counts
    tables = [(full, n)]
    for _ in range(2):
        tables.append(lm.shorter(*tables[-1]))
    logs = lm.log_probability(full, lm.predict(lm.weigh(tables)[::-1], None)[-1])
    assert abs(np.exp(logs[full >> np.uint64(8) == context]).sum() - 1) < 1e-9


def random_block(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of depth 5 behind a few pairs of bytes, one of them with most codes, and counts, some of them 0."""
    random = np.random.default_rng(1)
    parts = [random.choice(np.array([97, 98], np.uint8), n), *random.integers(97, 123, (4, n)).astype(np.uint8), np.full(n, 101, np.uint8)]
    parts[1][: n // 10] = 102
    keys = np.unique(sum(x.astype(np.uint64) << np.uint64(8 * (5 - j)) for j, x in enumerate(reversed(parts))))
    return keys, random.integers(0, 4, len(keys))


def test_lm_pieces_equal_the_whole(monkeypatch):
    keys, counts = random_block(3000)
    tables = [(keys, counts)]
    for _ in range(5):
        tables.append(lm.shorter(*tables[-1]))
    top = lm.predict(lm.weigh(tables[-2:])[::-1], None)[-1]
    levels = lm.weigh(tables[:4])
    whole = lm.log_probability(keys, lm.predict(levels[::-1], top)[-1])
    for piece in (1 << 17, 900, 40, 2):
        monkeypatch.setattr(lm, "PIECE", piece)
        assert np.allclose(lm.log_probabilities(keys, counts, 5, top), whole, rtol=1e-5, atol=1e-7)
        for k, (ids, sums) in enumerate(lm.sums_above(keys, counts, 5, 2)):
            own, back = np.unique(lm.parents(levels[-1][k]["ids"], k), return_inverse=True)
            assert ids.tolist() == own.tolist() and np.allclose(sums, np.bincount(back, weights=levels[-1][k]["pw"]))


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_lm_memory_of_a_group():
    """Trees of a group are not built at once: 600,000 codes of one group are answered in 110 MB."""
    keys, counts = random_block(600_000)
    top = lm.top_of({})
    packed = lm.pack_counts(counts)
    block = len(packed).to_bytes(4, "little") + packed + lm.pack_sorted(keys)
    rows = lm.rows_batch([("", lm.GRAMS, 0, block), ("0.0", lm.GRAMS, 0, block)])
    assert peak_mb(lambda: list(lm.answer(SimpleNamespace(value=top), 5)([rows]))) < 110


def test_lm_memory_of_a_chunk():
    """Words of a chunk are not held at once: 8 MB of short words are counted in 130 MB."""
    text = " ".join(np.base_repr(i % 40_000, 36) for i in range(400_000)).encode()[: 1 << 20]

    def run():
        chunk = lm.Chunk(list(range(8)), [text] * 8, 5, 10)
        return chunk.grams(), chunk.vocabulary()

    assert peak_mb(run) < 130


def test_lm_odd(spark, odd_docs, no_docs):
    got = lm.score(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in got)
    assert lm.score(no_docs).count() == 0


# ------------------------------------------------------------------ language ID


def languages(n=120):
    rows = []
    for i in range(n):
        lang = ("en", "xx")[i % 2]
        words = prose(i, 30) if lang == "en" else [w[::-1].replace("a", "ö") + "keit" for w in prose(i, 30)]
        rows.append((i, " ".join(words), lang))
    return rows


def test_language_id(spark):
    rows = languages() + [(500, None, "en"), (501, "123 !", "en"), (502, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df)).collect()}
    held = [(i, lang) for i, _, lang in rows[:120] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_words_of_a_switching_text():
    rows = languages()
    model = langid.train([(t, lang) for _, t, lang in rows])
    words = langid.words_of(rows[0][1] + " " + rows[1][1])
    scores = langid.Features(words).emissions(model)
    post = langid.forward_backward(scores, model.transitions, np.array([len(words)]))
    half = len(langid.words_of(rows[0][1]))
    assert (post[:half, 0] > 0.5).mean() > 0.9 and (post[half:, 1] > 0.5).mean() > 0.9


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    scores, step = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    post, pairs = langid.forward_backward(scores, step, np.array([4]), pairs=True)
    want, both = np.zeros((4, 3)), np.zeros((3, 3))
    import itertools

    for path in itertools.product(range(3), repeat=4):
        p = math.exp(sum(scores[i, x] for i, x in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, x in enumerate(path):
            want[i, x] += p
        for a, b in zip(path, path[1:], strict=False):
            both[a, b] += p
    total = want[0].sum()
    assert np.allclose(post, want / total) and np.allclose(pairs, both / total)


def test_long_texts_and_many_labels_are_learned(spark):
    rows = [(i, " ".join(prose(f"{i % 70}", 40)).replace("the", f"zz{chr(97 + i % 26)}{chr(97 + i % 70 // 26)}"), f"l{i % 70:02}") for i in range(280)]
    rows += [(1000 + i, " ".join(w[::-1] for w in prose(i, 9000)), "long") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, max_docs=60, max_doc_chars=2000)
    assert len(model.labels) == 71


def test_language_id_odd(spark, odd_docs, no_docs):
    got = langid.identify(odd_docs, langid.fit(odd_docs), carry=("lang", "source")).collect()
    assert len(got) == odd_docs.count()
    assert langid.identify(no_docs, langid.fit(no_docs)).count() == 0
    assert all(r["lang_pred"] == "und" for r in langid.identify(odd_docs, None).collect())


# ------------------------------------------------------------------ near duplicates


def changed(words, seed, n):
    import random

    r, out = random.Random(seed), list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.randint(0, 10**6)}"
    return out


def classes_by_hand(rows):
    memo, labels = neardup.Hashes(), {}
    for i, t in rows:
        h = neardup.kmers((t or "").encode().translate(neardup.LOWER).split(), memo)
        labels[i] = neardup.labelled(h, np.zeros(len(h), np.int64))
    group = {i: i for i in labels}
    find = lambda x: x if group[x] == x else find(group[x])
    for a in labels:
        for b in labels:
            if a < b and neardup.similarity(labels[a], labels[b], 0.8):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {i: find(i) for i in labels}


def test_near_duplicates(spark, monkeypatch):
    rows = []
    for g in range(6):
        base = prose(f"g{g}", 200 + 10 * g)
        rows += [(len(rows) + k, " ".join(changed(base, f"{g}-{k}", k % 4))) for k in range(9)]
    rows += [(len(rows) + k, " ".join(prose(f"own{k}", 60))) for k in range(20)]
    rows += [(900, None), (901, ""), (902, "two words"), (903, "Two  WORDS"), (904, "two other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes_by_hand(rows)
    for most in (neardup.BLOCK, 3):  # whole buckets, and split ones
        monkeypatch.setattr(neardup, "BLOCK", most)
        got = neardup.near_duplicates(df).collect()
        assert {r["doc_id"]: r["class_id"] for r in got} == want
        sizes = Counter(want.values())
        assert all(r["class_size"] == sizes[r["class_id"]] for r in got)


def test_near_duplicates_of_short_texts(spark):
    rows = []
    for g in range(300):  # nine words against their first eight: 4 of 5 k-mers
        words = prose(f"short{g}", 9)
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:8]))]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_hand(rows) and all(got[2 * g] == got[2 * g + 1] for g in range(300))


def test_near_duplicates_behind_equal_sketches(spark, monkeypatch):
    of = lambda words: neardup.kmers(" ".join(words).encode().split(), neardup.Hashes())
    for seed in range(100):  # a text and its beginning with the same sketches
        base = prose(f"equal{seed}", 304)
        one, two = neardup.sketches([of(base), of(base[:301])])
        if (one == two).all():
            break
    rows = [(1, " ".join(base)), (2, " ".join(base[:301])), (3, " ".join(base[:242]))]
    labels = [neardup.labelled(h, np.zeros(len(h), np.int64)) for h in (of(t.split()) for _, t in rows)]
    assert (one == two).all() and not neardup.similarity(labels[0], labels[2], 0.8) and neardup.similarity(labels[1], labels[2], 0.8)
    monkeypatch.setattr(neardup, "BLOCK", 1)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_parities_bound_what_is_not_common():
    rng = np.random.default_rng(2)
    for size in (3, 60, 900):
        a = neardup.mix64(rng.integers(0, 1 << 60, size).astype(np.uint64))
        b = np.concatenate([a[: size * 2 // 3], neardup.mix64(rng.integers(0, 1 << 60, size // 5).astype(np.uint64))])
        x, y = neardup.parities(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_similarity_by_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = rng.permutation(40)[: rng.integers(20, 40)].astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), 2))
        b = np.unique(np.concatenate([b, a[:1]]), return_index=True)[0][np.argsort(rng.random(len(np.unique(np.concatenate([b, a[:1]])))))] if rng.random() < 0.3 else b
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        run = table[-1, -1]
        sim = run / (len(a) + len(b) - run)
        assert abs(neardup.similarity(a, b, 0.8) - (sim if sim >= 0.8 else 0)) < 1e-12


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (25, 26)], "a long, b long")
    got = {r["node"]: r["label"] for r in neardup.components(links).collect()}
    assert got == {n: 1 if n < 10 else 20 for n in (1, 2, 3, 9, 20, 21, 22, 23, 24, 25, 26)}


def test_near_duplicates_odd(spark, odd_docs, no_docs):
    got = neardup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r["class_id"] for r in got if r["doc_id"] in (4, 5)} == {None}  # the null document has the same words
    assert [r["class_id"] for r in got if r["doc_id"] == 0] == [0] and [r["class_id"] for r in got if r["doc_id"] == 1] == [1]
    assert neardup.near_duplicates(no_docs).count() == 0


# ------------------------------------------------------------------ vectors


def vectors(n=900, size=12):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, size)).astype(np.float32)
    x[100:160] = x[100]
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def best_by_hand(rows, query, k):
    q = np.array(query[1], np.float32).astype(float)
    scores = [(-float((q * np.array(v, np.float32).astype(float)).sum()), i) for i, v in rows if i != query[0]]
    return [(i, -s) for s, i in sorted(scores)[:k]]


def test_vector_search(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = [r for r in rows if r[0] % 50 == 0]
    q = df.filter("vec_id % 50 = 0")
    for miss, least, bucket in ((0.0, 1.0, 4096), (0.05, 0.9, 16)):
        monkeypatch.setattr(ann, "BUCKET", bucket)
        got = ann.search(df, q, k=10, centroids=8, miss=miss, max_train=400).toPandas()
        hits = 0
        for query in asked:
            own, want = got[got.query_id == query[0]].sort_values("rank"), best_by_hand(rows, query, 10)
            assert own["rank"].tolist() == list(range(1, 11))
            hits += len(set(own.vec_id) & {i for i, _ in want})
            if not miss:
                assert own.vec_id.tolist() == [i for i, _ in want] and np.allclose(own.score, [s for _, s in want], atol=1e-12)
        assert hits >= least * 10 * len(asked)


def test_traversal_is_in_order():
    rng = np.random.default_rng(2)
    a, b, counts = rng.normal(size=5), rng.normal(size=7), rng.integers(0, 3, (5, 7))
    cells = ann.traverse(a, b, counts, 10**9)
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sums == sorted(sums, reverse=True) and sorted(cells) == np.flatnonzero(counts.ravel()).tolist()


def test_recall_of_the_query(spark):
    """op1 with its own parameters against brute force in double precision."""
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.01"
    t = pq.read_table(f"{d}/embeddings.parquet").to_pydict()
    rows = [(i, v) for i, v in zip(t["vec_id"], t["embedding"], strict=True) if v and None not in v and np.isfinite(v).all() and any(v)]
    got = ann.op1_ann_search(spark, d).toPandas()
    asked = [r for r in rows if r[0] % 20 == 0]
    assert sorted(set(got.query_id)) == sorted(i for i, _ in asked)
    hits = 0
    for query in asked:
        own = got[got.query_id == query[0]].sort_values("rank")
        want = dict(best_by_hand(rows, query, 20))
        assert own["rank"].tolist() == list(range(1, 21)) and own.vec_id.is_unique
        hits += len(set(own.vec_id) & set(want))
        assert all(abs(want[i] - s) < 1e-12 for i, s in zip(own.vec_id, own.score, strict=True) if i in want)
    assert hits >= 0.9 * 20 * len(asked)


def test_vectors_in_double_precision_and_of_all_lengths(spark):
    rows = [(1, [1.0, 1e-9]), (2, [1.0, 2e-9]), (3, [1e200, 1.0]), (4, [3.0]), (5, [2.0]), (6, [-1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()
    best = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got}
    assert best[4, 1] == (5, 6.0) and best[4, 2] == (6, -3.0) and best[6, 1] == (5, -2.0)
    assert best[1, 1] == (3, 1e200) and best[1, 2] == (2, 1.0 + 2e-18) and best[2, 2] == (1, 1.0 + 2e-18)


def test_vector_search_odd(spark):
    bad = [(1, None), (2, [0.0, 0.0]), (3, [1.0, float("nan")]), (4, [1.0, None]), (5, [1.0, 2.0, 3.0]), (6, [1.0, 0.5]), (7, [0.5, 1.0]), (7, [0.5, 1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0]), (9, [])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in bad], "vec_id long, embedding array<float>, cell int, bucket int, score int")
    got = ann.search(df, df, k=3).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(6, 7), (6, 7), (7, 6), (7, 6)] or sorted({(r["query_id"], r["vec_id"]) for r in got}) == [(6, 7), (7, 6)]
    assert ann.search(df.limit(0), df).count() == 0


# ------------------------------------------------------------------ WARC


def test_warc_round_trip(spark, monkeypatch):
    big = "<p>é" + "x" * 1200
    rows = [(1, "http://a/1", big), (2, "http://a/2 b\n", big), (3, None, big), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "http://a/6", None), (7, "u", ""), (None, "n", big), (8, "u8", "y" * 1000), (9, "u9", "y" * 999), (3, None, big), (10, "u10", "y" * 1000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    monkeypatch.setattr(warc, "READ_BYTES", 300)
    folder = warc.scratch_path(spark, "warc")
    index = warc.write_archives(df, folder)
    got = warc.read_records(index, folder).collect()
    import hashlib

    assert Counter(r["page_id"] for r in got) == Counter(i for i, _, _ in rows)
    for r in got:
        html = next(h for i, _, h in rows if i == r["page_id"]) or ""
        data = html.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert r["payload"] == (data if r["record_type"] == "response" else b"")
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kinds == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), None: ("revisit", 3), 8: ("revisit", 10), 9: ("response", None), 10: ("response", None)}
    assert next(r["url"] for r in got if r["page_id"] == 2) == "http://a/2%20b%0A"
    some = index.filter("page_id = 4")
    assert [r["page_id"] for r in warc.read_records(some, folder).collect()] == [4]


def test_reads_join_neighbours(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    monkeypatch.setattr(warc, "GAP_BYTES", 10)
    got = warc.spans([(0, 40), (40, 20), (65, 30), (120, 500), (700, 5)])
    assert [(a, b, len(own)) for a, b, own in got] == [(0, 95, 3), (120, 620, 1), (700, 705, 1)]


def test_warc_empty(spark):
    folder = warc.scratch_path(spark, "warc")
    index = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert index.count() == 0 and warc.read_records(index, folder).count() == 0
