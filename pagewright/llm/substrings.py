"""Substring dedup by prefix-partitioned suffix trees: suffixes are dealt by a prefix of varying length, each group's tree is built from its
sorted suffixes and their common prefixes, and its internal nodes of `window` words or more are the repeated passages."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import chunked, grouped, materialize, mix64, pack_docs, unpack_docs

#: Text bytes of a chunk; suffixes of which a tree is built at once; suffixes that a prefix may have before it is lengthened.
CHUNK, TREE, CROWDED = 4 << 20, 100_000, 1_000_000
#: Words of the run by which a suffix is dealt, at least; suffixes of a stretch at most.
RUN, LONGEST = 12, 60

ODD = 0x9E3779B97F4A7C15


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Chunk:
    """Words of a chunk's documents, end to end."""

    def __init__(self, texts: list[bytes]):
        words = [t.split() for t in texts]  # bytes.split() splits at [\x20\x09-\x0D]+
        self.sizes = np.fromiter(map(len, words), np.int64, len(texts))
        self.words = list(itertools.chain.from_iterable(words))

    def stretches(self, window: int, hash_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First start, number and prefix of each stretch: neighbouring suffixes of `window` words or more that are dealt together.

        A suffix is dealt by the run of words with the least hash among the runs in its first `window` words, the first of them on ties;
        so its prefix up to the end of that run decides, and equal windows have equal prefixes.
        """
        run = run_length(window)
        n, memo = len(self.words), Hashes()
        none = np.zeros(0, np.int64)
        if n < window:
            return none, none, none.astype(np.uint64)
        hashes = np.fromiter(map(memo.__getitem__, self.words), np.uint64, n) & np.uint64((1 << hash_bits) - 1)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(n, ODD, np.uint64))
            back = np.cumprod(np.full(n, pow(ODD, -1, 1 << 64), np.uint64))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power)])
            runs = mix64((total[run:] - total[:-run]) * back[: n - run + 1])
        bits = np.uint64(int(n).bit_length())
        least = (runs >> bits << bits) | np.arange(len(runs), dtype=np.uint64)
        wide, width = window - run + 1, 1
        while 2 * width <= wide:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
        left = np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(n)  # words from here to the document's end
        at = np.flatnonzero(left[: len(least)] >= window)
        spot = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (spot[1:] != spot[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        return at[first], np.diff(np.append(first, len(at))), runs[spot[first]]


def run_length(window: int) -> int:
    return min(window, max(RUN, window - LONGEST + 1))


def tree(stretches: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of `window` words of the stretches (words joined by a blank) in sorted order: the stretch and offset of each, how many words
    it shares with the one before it (-1 for the first), and the number of its node: the deepest, of `window` words."""
    number: dict[bytes, int] = {}
    split = [x.split(b" ") for x in stretches]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter((number.setdefault(w, len(number)) for own in split for w in own), np.int64, int(sizes.sum())).astype(">u4")
    n = sizes - window + 1
    owner = np.repeat(np.arange(len(split)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(sizes) - sizes, n) + offset
    suffixes = np.lib.stride_tricks.sliding_window_view(ids, window)[start]
    order = np.argsort(np.ascontiguousarray(suffixes).view(f"V{4 * window}").ravel(), kind="stable")
    suffixes = suffixes[order]
    differs = suffixes[1:] != suffixes[:-1]
    shared = np.concatenate([[-1], np.where(differs.any(axis=1), differs.argmax(axis=1), window)])[: len(order)]
    return owner[order], offset[order], shared, np.cumsum(shared < window) - 1


def repeated_passages(docs: DataFrame, *, window: int = 35, hash_bits: int = 64) -> DataFrame:
    """Documents without the words of passages of at least `window` words that occur more than once in the corpus.

    docs: doc_id, text; other columns are ignored. Words: [^\\x20\\x09-\\x0D]+, unchanged; null has none. A suffix starts at each
    word that has window - 1 after it. It is dealt by a prefix of RUN to `window` words: up to the end of the run of RUN words in it with
    the least hash, which neighbouring suffixes mostly share, so they travel as one stretch of words. A prefix that the corpus has once
    is a leaf and goes. A group is a prefix with all its suffixes: they are sorted by their words, neighbours' common prefixes give
    the tree, and an internal node of `window` words or more is a passage that occurs again. A prefix with more than CROWDED suffixes is
    lengthened to `window` words, where each group is one node, counted by its words. Every word in the first `window` words of a
    suffix under such a node is removed, all copies alike. Hashes only choose what is compared; passages are equal by their words
    (equal stretches by 128 bits of hash). hash_bits: bits of a word's hash that are used; fewer only cost time.
    Returns doc_id, n_words, n_removed, text (kept words joined by one space), spans (array of start and length, in words, of the
    removed passages, which are maximal) per input row. Repeated rows are documents of their own, so they repeat each other. An empty
    table gives an empty result.
    Rows grow with words, not with chunks times groups. Equal stretches are one row for each chunk and then one in all, so a passage that
    many documents share is not a large group. Memory is bounded by a chunk (one document at least) and by CROWDED suffixes.
    """

    def pack(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, (ids, texts) in enumerate(chunked(batches, CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([pack_docs(ids, texts)], pa.binary())], names=["chunk", "payload"])

    chunks = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(pack, "chunk long, payload binary")
    chunks = materialize(chunks, "chunks")
    prefixes = materialize(chunks.mapInArrow(prefixes_of(window, hash_bits), "chunk long, prefix long, n int"), "prefixes")
    inner = prefixes.groupBy("prefix").agg(F.sum("n").alias("all")).filter("all > 1").select("prefix")
    inner = prefixes.select("chunk", "prefix").join(inner, "prefix")
    stretches = gather(chunks, inner.select("chunk", "prefix")).mapInArrow(stretches_of(window, hash_bits), "chunk long, prefix long, key binary, n int, copies int, at array<int>, payload binary")
    stretches = materialize(stretches, "stretches")
    leaves = stretches.groupBy("key").agg(F.first("prefix").alias("prefix"), F.first("n").alias("n"), F.sum("copies").alias("copies"), F.first("payload").alias("payload"))
    leaves = materialize(leaves, "leaves")
    crowded = materialize(leaves.groupBy("prefix").agg(F.sum("n").alias("all")).filter(F.col("all") > CROWDED).select("prefix"), "crowded")
    groups, found = leaves, []
    if crowded.limit(1).count():
        groups = leaves.join(crowded, "prefix", "left_anti")
        found = [lengthened(leaves.join(crowded, "prefix", "left_semi"), window)]
    groups = groups.repartition("prefix").sortWithinPartitions("prefix")
    found = [groups.select("prefix", "key", "n", "copies", "payload").mapInArrow(nodes_of(window), "key binary, bits long"), *found]
    found = stretches.select("chunk", "key", "n", "at").join(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "key")
    out = "doc_id long, n_words long, n_removed long, text string, spans array<struct<start:int,len:int>>"
    return gather(chunks, found.select("chunk", "at", "bits")).mapInArrow(without_repeats(window), out)


def gather(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """A chunk's documents and all answers for it, side by side, the documents first."""
    return chunks.unionByName(answers, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.col("payload").isNull())


def prefixes_of(window: int, hash_bits: int):
    """Each chunk's distinct prefixes, and how many stretches have them."""

    def run(batches):
        for batch in batches:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, _, prefix = Chunk(unpack_docs(payload.as_py())[1]).stretches(window, hash_bits)
                own, n = np.unique(prefix, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), name)), pa.array(own.view(np.int64)), pa.array(n.astype(np.int32))], names=["chunk", "prefix", "n"])

    return run


def stretches_of(window: int, hash_bits: int):
    """Each chunk's distinct stretches with a prefix that is not a leaf, and where they start."""

    def run(batches):
        for (name,), own in grouped(batches, ["chunk"]):
            inner = own.column("prefix").drop_null().to_numpy().view(np.uint64)
            if not len(inner):
                continue
            chunk = Chunk(unpack_docs(own.column("payload")[0].as_py())[1])
            first, n, prefix = chunk.stretches(window, hash_bits)
            keep = np.isin(prefix, inner)
            words, held = chunk.words, {}
            for at, size, p in zip(first[keep].tolist(), n[keep].tolist(), prefix[keep].view(np.int64).tolist(), strict=True):
                text = b" ".join(words[at : at + size + window - 1])
                held.setdefault(xxhash.xxh3_128_digest(text), (p, size, text, []))[3].append(at)
            if held:
                p, size, text, spots = zip(*held.values(), strict=True)
                columns = [pa.array(np.full(len(held), name)), pa.array(p, pa.int64()), pa.array(list(held), pa.binary()), pa.array(size, pa.int32()), pa.array(list(map(len, spots)), pa.int32()), pa.array(spots, pa.list_(pa.int32())), pa.array(text, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "prefix", "key", "n", "copies", "at", "payload"])

    return run


def nodes_of(window: int):
    """For stretches sorted by prefix: key, and a bit for each suffix that is under a node of `window` words with two leaves or more."""

    def nodes(keys: list[bytes], copies: list[int], texts: list[bytes]):
        owner, offset, _, node = tree(texts, window)
        leaves = np.bincount(node, weights=np.array(copies)[owner])
        again = leaves[node] > 1
        bits = np.zeros(len(keys), np.int64)
        np.bitwise_or.at(bits, owner[again], np.int64(1) << offset[again])
        hit = np.flatnonzero(bits)
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit.tolist()], pa.binary()), pa.array(bits[hit])], names=["key", "bits"])

    def run(batches):
        held, size = [], 0  # whole prefixes, as many as make a tree of TREE suffixes
        for _, own in grouped(batches, ["prefix"]):
            n = int(own.column("n").to_numpy().sum())
            if held and size + n > TREE:
                yield nodes(*(sum(x, []) for x in zip(*held, strict=True)))
                held, size = [], 0
            held.append([own.column(c).to_pylist() for c in ("key", "copies", "payload")])
            size += n
        if held:
            yield nodes(*(sum(x, []) for x in zip(*held, strict=True)))

    return run


def lengthened(leaves: DataFrame, window: int) -> DataFrame:
    """As nodes_of(), for prefixes that too many suffixes have: suffixes are dealt by all their `window` words and counted."""
    words = F.split(F.col("payload").cast("string"), " ")
    each = leaves.select("key", "copies", words.alias("words"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("offset"))
    each = each.select("key", "copies", "offset", F.array_join(F.slice("words", F.col("offset") + 1, window), " ").alias("suffix"))
    again = each.groupBy("suffix").agg(F.sum("copies").alias("leaves")).filter("leaves > 1").select("suffix")
    return each.join(again, "suffix").groupBy("key").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("offset"))).alias("bits"))


def without_repeats(window: int):
    def run(batches):
        for _, answers in grouped(batches, ["chunk"]):
            ids, texts = unpack_docs(answers.column("payload")[0].as_py())
            chunk = Chunk(texts)
            rows = answers.filter(answers.column("bits").is_valid()).combine_chunks()
            step = np.zeros(len(chunk.words) + 1, np.int64)
            if len(rows):
                spots = rows.column("at").chunk(0)
                starts = spots.flatten().to_numpy()
                bits = np.repeat(rows.column("bits").to_numpy(), np.diff(spots.offsets.to_numpy()))
                for b in range(LONGEST):
                    own = starts[(bits >> b) & 1 == 1] + b
                    np.add.at(step, own, 1)
                    np.add.at(step, own + window, -1)
            gone = np.cumsum(step[:-1]) > 0
            edges = np.concatenate([[0], np.cumsum(chunk.sizes)]).tolist()
            n_gone, kept, spans = [], [], []
            for a, b in itertools.pairwise(edges):
                own, words = gone[a:b], chunk.words[a:b]
                n_gone.append(int(own.sum()))
                change = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                spans.append([{"start": int(x), "len": int(y - x)} for x, y in change.reshape(-1, 2)])
                kept.append(b" ".join(w for w, x in zip(words, own.tolist(), strict=True) if not x) if n_gone[-1] else b" ".join(words))
            columns = [pa.array(ids, pa.int64()), pa.array(chunk.sizes), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "text", "spans"])

    return run


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)
), r AS (
  SELECT doc_id, i FROM v WHERE s IN (SELECT s FROM v GROUP BY s HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM r
), words AS (
  SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS x FROM d
), kept AS (
  SELECT w.doc_id, count(g.p) AS n_removed, string_agg(w.x, ' ' ORDER BY w.p) FILTER (WHERE g.p IS NULL) AS kept
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES = {"op5_substring_dedup": OP5_SQL}
