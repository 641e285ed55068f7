import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
from samples import ODD_TEXTS, prose

from pagewright.llm import decontam, line_dedup, mixing, substrings


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def lines_by_hand(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        keep = [x for x in (t or "").split("\n") if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != (-1 if i is None else i))]
        out.append((i, (t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(keep), "\n".join(keep)))
    return out


def test_line_dedup(spark):
    shared, near = "A line that several documents hold", "  a LINE that several documents hold\t"
    rows = [(1, f"{shared}\nown one\n{shared}"), (2, f"{near}\nx"), (3, f"y\n{shared}\n"), (4, "short\nshort"), (5, "short"), (6, "short"), (7, None), (8, "É" * 20), (9, "é" * 20), (10, "É" * 20), (None, shared), (3, f"another row of 3\n{shared}")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == Counter(lines_by_hand(rows))


def test_line_dedup_odd(spark, odd_docs, no_docs):
    got = line_dedup.dedup_lines(odd_docs, min_chars=3, min_docs=2, carry=("lang",)).collect()
    assert len(got) == odd_docs.count()
    assert next(r for r in got if r["doc_id"] == 0)["n_lines"] == 1
    assert line_dedup.dedup_lines(no_docs).count() == 0


def fill_by_hand(sizes, weights, share=1.0, most=3.0):
    total, done = sum(sizes.values()) * share, {}
    while True:
        free = {s: w for s, w in weights.items() if s not in done}
        if not free:
            return done
        left = max(0, total - sum(done.values()))
        want = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s: most * sizes[s] for s in free if want[s] > most * sizes[s] + 1e-9}
        if not over:
            return done | want
        done |= over


def test_mixing(spark):
    rows = [(i, " ".join(prose(i, 5 + i % 40)), [None, "a", "b", "c", "é", "Z"][i % 6] if i % 11 else "tiny") for i in range(600)]
    rows += [(10_000, None, "a"), (10_001, "", "b"), (10_002, " \t", "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill_by_hand(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert len(got) == len(rows)
    for s, part in got.groupby("source", dropna=False):
        s = None if s != s else s
        assert part.source_size.iloc[0] == sizes[s]
        assert abs(part.target.iloc[0] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(part.taken.sum() - want[s]) <= part["size"].max() / 2 + 1e-6
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    again = mixing.mix(df.repartition(7)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_mixing_odd(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs, carry=("lang",)).collect()
    assert len(got) == odd_docs.count() and all(r["target"] >= 0 for r in got)
    assert mixing.mix(no_docs).count() == 0


def passages_by_hand(rows, window):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = {k for j in range(len(w) - window + 1) if seen[tuple(w[j : j + window])] > 1 for k in range(j, j + window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substring_dedup(spark, monkeypatch):
    """Also over chunks of one document, with trees of one prefix, with crowded prefixes, and where nearly all hashes collide."""
    passage = prose("p", 60)
    rows = [(i, " ".join(prose(i, 30) + (passage[:45] if i % 3 == 0 else passage[15:] if i % 3 == 1 else []) + prose(-i - 1, 20))) for i in range(12)]
    rows += [(20, "a " * 100), (21, " ".join(passage[:34])), (22, None), (23, ""), (None, " ".join(passage)), (24, "\n".join(passage[:36])), (25, "a b " * 90), (26, " ".join(prose("long", 3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window, bits, chunk, most, crowded in ((35, 64, 1 << 20, 10**5, 10**6), (35, 2, 400, 10, 10**6), (35, 64, 400, 10, 20), (9, 64, 1 << 20, 10**5, 10**6), (1, 64, 400, 10, 5), (90, 64, 400, 10**5, 10**6)):
        for name, value in (("CHUNK", chunk), ("TREE", most), ("CROWDED", crowded)):
            monkeypatch.setattr(substrings, name, value)
        got = substrings.repeated_passages(df, window=window, hash_bits=bits).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == Counter(passages_by_hand(rows, window))
        assert all(sum(s["len"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_tree_of_suffixes():
    texts = [b"a b c d e", b"b c d x", b"a b c y"]
    owner, offset, shared, node = substrings.tree(texts, 3)
    words = [x.split(b" ") for x in texts]
    suffixes = [words[i][j : j + 3] for i, j in zip(owner, offset, strict=True)]
    common = lambda x, y: next((k for k in range(3) if x[k] != y[k]), 3)
    assert len(suffixes) == 7 and shared.tolist() == [-1, *(common(x, y) for x, y in itertools.pairwise(suffixes))]
    for i, x in enumerate(suffixes):  # each node is one window, in neighbouring places
        assert [k for k, y in enumerate(suffixes) if y == x] == np.flatnonzero(node == node[i]).tolist()


def test_substring_dedup_odd(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = substrings.repeated_passages(odd_docs, window=2).collect()
    assert Counter((r["doc_id"], r["n_removed"]) for r in got) == Counter((i, n) for i, _, n, _ in passages_by_hand(rows, 2))
    assert substrings.repeated_passages(no_docs).count() == 0


def hits_by_hand(rows, items, n):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for name, text in items:
            own = words(text)
            size = min(n, len(own))
            for j in range(len(own) - size + 1) if size else ():
                for k in range(len(w) - size + 1):
                    if w[k : k + size] == own[j : j + size]:
                        hit |= set(range(k, k + size))
                        names.add(str(name))
        out.append((i, len(w), len(hit), tuple(sorted(names))))
    return out


def test_decontamination(spark, monkeypatch):
    items = [(i, " ".join(prose(f"item{i}", 8 + 4 * i))) for i in range(6)] + [(10, "Two Words"), (11, "single"), (12, None), (13, " .,; "), (2, " ".join(prose("item2", 16))), (100, " ".join(prose("item3", 20)))]
    rows = [(i, " ".join(prose(i, 25) + items[i % 6][1].upper().split()[i % 4 : 14] + prose(-i, 9))) for i in range(20)]
    rows += [(50, "say two-words. Or SINGLE"), (51, None), (52, ""), (None, items[5][1]), (53, "é" + items[5][1].replace(" ", ", "))]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = Counter(hits_by_hand(rows, items, 10))
    for size in (decontam.BLOCK_BYTES, 600):  # in one block, and in several
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = decontam.decontaminate(df, bench, window=10).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want


def test_windows_in_small_runs(monkeypatch):
    """Documents in runs of few words, candidates in steps of few, against a search of each window."""
    monkeypatch.setattr(decontam, "CANDIDATES", 3)
    monkeypatch.setattr(decontam, "BATCH_WORDS", 4)
    items = [(str(i), " ".join(prose(f"run{i % 4}", 5 + 3 * i)).encode()) for i in range(6)] + [("7", b"the the the the"), ("8", b"the")]
    texts = [" ".join(prose(f"run{i % 4}", 4 + 9 * i)).encode() for i in range(5)] + [b"", b"the " * 30]
    block = decontam.Block(items, 6, 3)
    keys = np.unique(np.concatenate([h.ravel() for _, h in block.shingles()]))
    block.choose(keys, np.arange(1, len(keys) + 1))
    seen, got = 0, set()
    for first, docs in decontam.in_runs(texts):
        assert first == seen
        seen += len(docs.sizes)
        for w, at in zip(*block.occurrences(docs), strict=True):
            text = docs.text[at]
            got |= {(first + int(text), int(at - (docs.ends - docs.sizes)[text]), block.names[x]) for x in block.items[block.item_edges[w] : block.item_edges[w + 1]]}
    want = set()
    for i, t in enumerate(texts):
        for name, x in items:
            own, words = x.split(), t.split()
            size = min(6, len(own))
            want |= {(i, k, name) for j in range(len(own) - size + 1) for k in range(len(words) - size + 1) if words[k : k + size] == own[j : j + size]}
    assert seen == len(texts) and got == want


def test_decontamination_of_a_long_text_and_odd_items(spark):
    words = prose("long", 250_000)
    bench = spark.createDataFrame([(None, " ".join(words[200_000:200_012]), 7, 8), ("", "no such words", 7, 8)], "item_id string, text string, block int, item int")
    r = decontam.decontaminate(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), bench).first()
    assert (r["n_words"], r["n_hit"], r["items"]) == (250_000, 12, [""])


def test_decontamination_odd(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontam.decontaminate(odd_docs, bench, carry=("lang",)).collect()}
    assert got[4] == 3 and got[0] == 0 and got[None] == 3
    assert decontam.decontaminate(no_docs, bench).count() == 0
    assert decontam.decontaminate(odd_docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert len(ODD_TEXTS) + 4 == odd_docs.count()


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
