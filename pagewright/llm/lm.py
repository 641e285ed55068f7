"""Language-model scores by context-tree weighting over bytes, with a word unigram beside it as the base."""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import LOWER, KeyIndex, by_group, chunked, compress, decompress, distinct_counts, materialize, mix64, pack_docs, pack_sorted, unpack_docs, unpack_sorted
from pagewright.llm.substrings import Hashes

#: Text bytes of a chunk, positions worked on at once, keys of a group (about), and groups at least and at most.
CHUNK, BATCH, GROUP_KEYS, MIN_GROUPS, MAX_GROUPS = 12 << 20, 1 << 20, 1_000_000, 16, 4096
#: Keys of which trees are built at once (about 300 bytes each), and words whose hashes are kept.
PIECE, MEMO = 1 << 17, 200_000
#: End of a text: the byte that no word has, which also stands before a text.
END = 10
LN2, LN10 = math.log(2), math.log(10)

BLOCKS = "chunk string, kind int, grp int, payload binary"
GRAMS, WORDS = 0, 1


# ---------------------------------------------------------------- the tree


@functools.lru_cache(maxsize=1)
def small_gammas() -> np.ndarray:
    return np.array([math.lgamma(k / 2) if k else 0.0 for k in range(4096)])


def log_gamma_half(twice: np.ndarray) -> np.ndarray:
    """log Gamma(twice / 2) for positive integers: a table, and Stirling's series beyond it."""
    out = small_gammas()[np.minimum(twice, 4095)]
    big = twice > 4095
    if big.any():
        z = twice[big] / 2.0
        out[big] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma_half(2 * zeros + 1) + log_gamma_half(2 * ones + 1) - math.log(math.pi) - log_gamma_half(2 * (zeros + ones) + 2)


def nodes(keys: np.ndarray, counts: np.ndarray, k: int):
    """Binary nodes of level k for sorted keys (context, byte): their ids (context and the byte's first k bits), zeros, ones."""
    ids = keys >> np.uint64(8 - k)
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    start = np.flatnonzero(new)
    total = np.add.reduceat(counts, start)
    ones = np.add.reduceat(np.where((keys >> np.uint64(7 - k)) & np.uint64(1) == 1, counts, 0), start)
    return ids[start], total - ones, ones


def shorter(keys: np.ndarray, counts: np.ndarray):
    """Sorted keys with the context's farthest byte left out, and their counts."""
    own, back = np.unique(((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255)), return_inverse=True)
    return own, np.bincount(back, weights=counts, minlength=len(own)).astype(np.int64)


def parents(ids: np.ndarray, k: int) -> np.ndarray:
    return ((ids >> np.uint64(k + 8)) << np.uint64(k)) | (ids & np.uint64((1 << k) - 1))


def weigh(tables: list[tuple[np.ndarray, np.ndarray]], below: list | None = None) -> list[list[dict]]:
    """Bottom up: for tables of (keys, counts) from the longest contexts to shorter ones, the nodes of each level.

    A node has its log weighted probability pw = log(kt / 2 + product of its children / 2) and stop, the posterior share of
    stopping at it. below: for each level, (ids, sums of log pw) of the children of the first table, whose nodes else are leaves.
    """
    out: list[list[dict]] = []
    for keys, counts in tables:
        own = []
        for k in range(8):
            ids, zeros, ones = nodes(keys, counts, k)
            kt, kids = log_kt(zeros, ones), np.zeros(len(ids))
            leaf = not out and below is None
            if out:
                deeper = out[-1][k]
                kids = np.bincount(np.searchsorted(ids, parents(deeper["ids"], k)), weights=deeper["pw"], minlength=len(ids))
            elif below is not None:
                kids[np.searchsorted(ids, below[k][0])] = below[k][1]
            pw = kt if leaf else np.logaddexp(kt, kids) - LN2
            stop = np.ones(len(ids)) if leaf else np.exp(kt - LN2 - pw)
            own.append({"ids": ids, "pw": pw, "stop": stop, "p1": (ones + 0.5) / (zeros + ones + 1.0), "seen": zeros + ones > 0})
        out.append(own)
    return out


def predict(levels: list[list[dict]], top: list | None) -> list[list[tuple[np.ndarray, ...]]]:
    """Top down: for each node (ids, share of stopped contexts x their P(1), share still open, P(1) if the path ends here).

    levels: from short contexts to long. top: the same of the contexts one byte shorter than the first; None at the root. A context
    that training hasn't seen ends the path at the one before it.
    """
    out = []
    for own in levels:
        made = []
        for k in range(8):
            x = own[k]
            if top is None:
                done, rest, closed = np.zeros(len(x["ids"])), np.ones(len(x["ids"])), np.full(len(x["ids"]), 0.5)
            else:
                at = np.searchsorted(top[k][0], parents(x["ids"], k))
                done, rest, closed = top[k][1][at], top[k][2][at], top[k][3][at]
            here = np.where(x["seen"], done + rest * x["p1"], closed)
            done, rest = np.where(x["seen"], done + rest * x["stop"] * x["p1"], closed), np.where(x["seen"], rest * (1 - x["stop"]), 0.0)
            made.append((x["ids"], done, rest, here))
        out.append(made)
        top = made
    return out


def log_probability(keys: np.ndarray, made: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Natural log of the probability of each key's byte after its context: eight binary decisions."""
    out = np.zeros(len(keys))
    for k in range(8):
        p1 = made[k][3][np.searchsorted(made[k][0], keys >> np.uint64(8 - k))]
        out += np.log(np.where((keys >> np.uint64(7 - k)) & np.uint64(1) == 1, p1, 1 - p1))
    return out


def tables(keys: np.ndarray, counts: np.ndarray, depth: int, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of contexts from depth bytes down to level."""
    out = [(keys, counts)]
    for _ in range(depth - level):
        out.append(shorter(*out[-1]))
    return out


def pieces(keys: np.ndarray, depth: int, level: int):
    """Slices of sorted keys with whole contexts of level bytes: as many as PIECE keys hold, or one context that has more."""
    near = keys >> np.uint64(8 * (depth - level + 1))
    edge = np.concatenate([[0], np.flatnonzero(near[1:] != near[:-1]) + 1, [len(keys)]])
    at = 0
    while at < len(edge) - 1 and len(keys):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + PIECE, side="right")) - 1)
        yield slice(edge[at], edge[to])
        at = to


def weighed(keys: np.ndarray, counts: np.ndarray, depth: int, level: int) -> list[dict]:
    """Nodes of the contexts of level bytes of a piece; one context with more than PIECE keys is weighed from pieces of longer contexts."""
    if len(keys) <= PIECE or level == depth:
        return weigh(tables(keys, counts, depth, level))[-1]
    byte = (keys & np.uint64(255)).astype(np.int64)
    here = np.flatnonzero(np.bincount(byte, minlength=256))
    sums = np.bincount(byte, weights=counts, minlength=256)[here].astype(np.int64)
    own = (keys[0] >> np.uint64(8 * (depth - level + 1))) << np.uint64(8) | here.astype(np.uint64)
    return weigh([(own, sums)], sums_above(keys, counts, depth, level + 1))[0]


def sums_above(keys: np.ndarray, counts: np.ndarray, depth: int, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each decision: ids of the nodes one byte shorter than level, and the sums of log pw of their children of level bytes."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(8)]
    for own in pieces(keys, depth, level):
        for k, x in enumerate(weighed(keys[own], counts[own], depth, level)):
            found[k].append((parents(x["ids"], k), x["pw"]))
        if sum(len(i) for i, _ in found[7]) > PIECE:
            found = [[summed(x)] for x in found]
    return [summed(x) for x in found]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, back = np.unique(np.concatenate([i for i, _ in parts]), return_inverse=True)
    return ids, np.bincount(back, weights=np.concatenate([p for _, p in parts]), minlength=len(ids))


def log_probabilities(keys: np.ndarray, counts: np.ndarray, depth: int, top: list | None, level: int = 2) -> np.ndarray:
    """log_probability() of sorted keys with whole contexts of level bytes, piece by piece. top: predict() of contexts one byte shorter."""
    out = np.empty(len(keys), np.float32)
    for own in pieces(keys, depth, level):
        k, c = keys[own], counts[own]
        if len(k) <= PIECE or level == depth:
            out[own] = log_probability(k, predict(weigh(tables(k, c, depth, level))[::-1], top)[-1])
        else:
            out[own] = log_probabilities(k, c, depth, predict([weighed(k, c, depth, level)], top)[-1], level + 1)
    return out


def merge(keys: list[np.ndarray], counts: list[np.ndarray]):
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


class Sums:
    """Sorted distinct keys with the sums of their counts. What comes is merged when there are GROUP_KEYS, or twice the distinct ones."""

    def __init__(self):
        self.keys, self.counts, self.size, self.most = [], [], 0, GROUP_KEYS

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > self.most:
            keys, counts = self.total()
            self.keys, self.counts, self.size, self.most = [keys], [counts], len(keys), max(GROUP_KEYS, 2 * len(keys))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return merge(self.keys, self.counts) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def sorted_counts(codes: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """distinct_counts() of codes below 2^63, by one sort."""
    marked = (codes << np.uint64(1)) | counted
    marked.sort()
    keys = marked >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    sums = np.concatenate([[0], np.cumsum(marked & np.uint64(1), dtype=np.int64)])
    return keys[first], sums[np.append(first[1:], len(keys))] - sums[first] if len(first) else np.zeros(0, np.int64)


# ---------------------------------------------------------------- chunks of documents


def held_out(doc_id: int | None, folds: int) -> bool:
    """Whether crc32 of doc_id as text leaves 0; a document without doc_id is held out, too."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0


class Chunk:
    """Tokens of a chunk's documents and their byte codes. Words, and all that is made of them, are held for BATCH bytes of texts at a time."""

    def __init__(self, ids, texts, depth: int, folds: int):
        self.ids, self.texts, self.depth = ids, texts, depth
        self.held = np.array([held_out(i, folds) for i in ids], bool)

    def parts(self):
        """In batches of documents: the number of the first, and each one's lower-cased words."""
        words, first, size = [], 0, 0
        for k, text in enumerate(self.texts):
            words.append(text.translate(LOWER).split())
            size += len(text) + self.depth + 1
            if size >= BATCH or k == len(self.texts) - 1:
                yield first, words
                words, first, size = [], k + 1, 0

    def codes(self):
        """In batches of documents: document numbers and codes of all their bytes. A code has the byte at the bottom and the
        nearest byte before it on top, then the next, to depth. The text scored is the words joined by one blank, and END."""
        d = self.depth
        for first, words in self.parts():
            held = [b" ".join(own) for own in words]
            pad = bytes([END]) * d
            data = np.frombuffer(pad + (bytes([END]) + pad).join(held) + bytes([END]), np.uint8)
            lengths = np.fromiter(map(len, held), np.int64, len(held)) + 1
            # Little-endian: the byte itself lowest, then those before it, the nearest highest.
            code = np.zeros((len(data) - d, 8), np.uint8)
            code[:, 0] = data[d:]
            for j in range(1, d + 1):
                code[:, d + 1 - j] = data[d - j : len(data) - j]
            kept = np.ones(len(code), bool)
            kept[(np.cumsum(lengths + d)[:-1] - d)[:, None] + np.arange(d)] = False  # what stands between texts
            yield np.repeat(np.arange(first, first + len(held)), lengths), code.view("<u8").ravel()[kept]

    def grams(self):
        """Distinct codes, sorted, with their counts in training documents (0: only held-out ones have it)."""
        sums = Sums()
        for own, code in self.codes():
            sums.add(*(distinct_counts if self.depth == 7 else sorted_counts)(code, ~self.held[own]))
        return sums.total()

    def tokens(self):
        """In batches of documents: hash of every token (the end's is that of the empty word), and the document it is in."""
        memo = Hashes()
        for first, words in self.parts():
            if len(memo) > MEMO:
                memo.clear()
            sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
            yield np.fromiter((memo[w] for own in words for w in (*own, b"")), np.uint64, int(sizes.sum())), np.repeat(np.arange(first, first + len(words)), sizes)

    def vocabulary(self):
        sums = Sums()
        for hashes, own in self.tokens():
            keys, back = np.unique(hashes, return_inverse=True)
            sums.add(keys, np.bincount(back[~self.held[own]], minlength=len(keys)))
        return sums.total()


def gram_groups(keys: np.ndarray, depth: int, groups: int) -> np.ndarray:
    """A group has whole subtrees: it is that of the two nearest bytes."""
    return (mix64(keys >> np.uint64(8 * (depth - 1))) % np.uint64(groups)).astype(np.int64)


def word_groups(keys: np.ndarray, groups: int) -> np.ndarray:
    return (mix64(keys) % np.uint64(groups)).astype(np.int64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as byte planes: those that all counts leave empty take nothing."""
    return compress(np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(decompress(data), np.uint8).reshape(8, -1).T).reshape(-1).view(np.int64)


def rows_batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=["chunk", "kind", "grp", "payload"])


def blocks_of(name: str, kind: int, keys: np.ndarray, counts: np.ndarray, group: np.ndarray):
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.diff(np.concatenate([[-1], group[order]])))
    for own in np.split(order, edges[1:]) if len(order) else []:
        packed = pack_counts(counts[own])
        yield name, kind, int(group[own[0]]), len(packed).to_bytes(4, "little") + packed + pack_sorted(keys[own])


def open_block(payload: bytes):
    n = int.from_bytes(payload[:4], "little")
    return unpack_sorted(payload[4 + n :]), unpack_counts(payload[4 : 4 + n])


def each_chunk(batches, depth: int, folds: int):
    for (name,), rows in by_group(batches, "chunk"):
        first = next(rows)
        yield name, Chunk(*unpack_docs(first["payload"]), depth, folds), rows


# ---------------------------------------------------------------- the operator


def score(docs: DataFrame, *, depth: int = 5, folds: int = 10) -> DataFrame:
    """Log10 probability of every whole text under a context-tree weighting model of the training texts, and under a unigram.

    docs: doc_id, text; other columns are ignored. Training: documents whose crc32(doc_id as text) mod folds is not 0 (a null doc_id is
    never trained on). A-Z lower-cased; tokens: words [^\\x20\\x09-\\x0D]+, then one end. Null is the empty text.
    Model: the bytes of the words joined by one blank, and an end byte. Each byte is eight binary decisions; each decision has a
    context tree over the 0 to depth bytes before it, whose nodes hold training counts from all training texts. A node's
    probability is half its Krichevsky-Trofimov estimate and half the product of its children; from these the posterior share
    of each depth follows, and the decision's probability is the mixture over all depths. A context not seen in training ends
    the path before it. Base: sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))), words held by 64-bit hash.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (bytes scored), bits_per_byte per input row.
    An empty table gives an empty result; without training texts every decision has probability 1/2.
    Chunks send their distinct codes and words with counts; groups (all contexts that end in the same two bytes; words by
    hash; at most MAX_GROUPS) add them up, compute their subtrees and send back one number per code. Only depths 0 and 1, at most 257
    contexts, pass through the driver. Memory is bounded by a chunk, and by the distinct codes of a group: chunks' blocks are summed
    as they come, and answered one after another. All codes behind the same two bytes are in one group, 16 bytes each (about 60 while they
    are summed); trees are built for PIECE codes at a time, of longer contexts where one of two bytes has more. A chunk's words are made for BATCH bytes at a time.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth is 2 to 7")

    def pack(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, (ids, texts) in enumerate(chunked(batches, CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}.{seq}"]), pa.array([sum(map(len, texts))], pa.int64()), pa.array([pack_docs(ids, texts)], pa.binary())], names=["chunk", "n", "payload"])

    chunks = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(pack, "chunk string, n long, payload binary")
    chunks = materialize(chunks, "chunks")
    total = chunks.agg(F.sum("n")).first()[0] or 0
    groups = int(min(MAX_GROUPS, max(MIN_GROUPS, total // 20 // GROUP_KEYS + 1)))

    def emit(batches):
        for name, chunk, _ in each_chunk(batches, depth, folds):
            keys, counts = chunk.grams()
            yield rows_batch(blocks_of(name, GRAMS, keys, counts, gram_groups(keys, depth, groups)))
            keys, counts = chunk.vocabulary()
            yield rows_batch(blocks_of(name, WORDS, keys, counts, word_groups(keys, groups)))

    packed = chunks.select("chunk", F.lit(-1).alias("kind"), F.lit(-1).alias("grp"), "payload")
    blocks = materialize(packed.mapInArrow(emit, BLOCKS), "blocks", ("kind",)).select("chunk", "kind", "grp", "payload")

    own = blocks.repartition("kind", "grp").sortWithinPartitions("kind", "grp")
    merged = materialize(own.mapInArrow(merge_blocks, BLOCKS), "merged")
    known, n_train = 0, 0
    for r in merged.filter(F.col("kind") == WORDS).mapInArrow(vocabulary_size, "v long, n long").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():
        known, n_train = r["v"] or 0, r["n"] or 0
    sums = merged.filter(F.col("kind") == GRAMS).mapInArrow(functools.partial(first_sums, depth=depth), "near int, payload binary")
    sums = sums.repartition("near").sortWithinPartitions("near").mapInArrow(add_sums, "near int, payload binary")
    top = top_of({r["near"]: r["payload"] for r in sums.collect()})  # at most 256 rows of 4 KB
    sent = docs.sparkSession.sparkContext.broadcast(top)
    asked = blocks.withColumn("asked", F.lit(1)).unionByName(merged.withColumn("asked", F.lit(0)))
    asked = asked.repartition("kind", "grp").sortWithinPartitions("kind", "grp", "asked").drop("asked")
    answers = materialize(asked.mapInArrow(answer(sent, depth), BLOCKS), "answers")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    side = packed.unionByName(answers).repartition("chunk").sortWithinPartitions("chunk", "kind", "grp")
    return side.mapInArrow(finish(depth, folds, groups, known, n_train), out)


def merge_blocks(batches):
    """All keys of a group with their training counts, in one block; chunks' blocks are summed as they come."""
    for (kind, group), rows in by_group(batches, "kind", "grp"):
        sums = Sums()
        for r in rows:
            sums.add(*open_block(r["payload"]))
        keys, counts = sums.total()
        packed = pack_counts(counts)
        yield rows_batch([("", kind, group, len(packed).to_bytes(4, "little") + packed + pack_sorted(keys))])


def vocabulary_size(batches):
    """Distinct words of training texts and their tokens, for each group."""
    for _, rows in by_group(batches, "kind", "grp"):
        for r in rows:
            counts = open_block(r["payload"])[1]
            yield pa.RecordBatch.from_arrays([pa.array([int((counts > 0).sum())]), pa.array([int(counts.sum())])], names=["v", "n"])


def first_sums(batches, depth: int):
    """For each nearest byte: its counts by next byte, and for each decision the sum of log pw of the contexts of two bytes."""
    for _, rows in by_group(batches, "grp"):
        keys, counts = open_block(next(rows)["payload"])
        pair = ((keys >> np.uint64(8 * depth)) << np.uint64(8) | (keys & np.uint64(255))).astype(np.int64)
        one = np.bincount(pair, weights=counts, minlength=1 << 16).reshape(256, 256)
        out = {near: np.stack([one[near], np.zeros(256)]) for near in np.unique(pair >> 8).tolist()}
        for k, (ids, sums) in enumerate(sums_above(keys, counts, depth, 2)):
            for i, p in zip(ids.tolist(), sums.tolist(), strict=True):
                out[i >> k][1, (1 << k) | (i & ((1 << k) - 1))] += p
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([compress(x.tobytes()) for x in out.values()], pa.binary())], names=["near", "payload"])


def add_sums(batches):
    for (near,), rows in by_group(batches, "near"):
        total = functools.reduce(np.add, (np.frombuffer(decompress(r["payload"])).reshape(2, 256) for r in rows))
        yield pa.RecordBatch.from_arrays([pa.array([near], pa.int32()), pa.array([compress(total.tobytes())], pa.binary())], names=["near", "payload"])


def top_of(sums: dict[int, bytes]):
    """Depth 1 of the tree, top down, from the sums of the contexts of one byte."""
    if not sums:
        return None
    held = {b: np.frombuffer(decompress(x)).reshape(2, 256) for b, x in sorted(sums.items())}
    # All bytes of all 256 contexts: a byte that doesn't follow has count 0, and changes nothing.
    keys = np.array([(b << 8) | x for b in held for x in range(256)], np.uint64)
    counts = np.concatenate([x[0] for x in held.values()]).astype(np.int64)
    below = []
    for k in range(8):
        ids = np.array([(b << k) | p for b in held for p in range(1 << k)], np.uint64)
        below.append((ids, np.concatenate([x[1][1 << k : 2 << k] for x in held.values()])))
    one = weigh([(keys, counts), shorter(keys, counts)], below)
    return predict([one[1], one[0]], None)[1]


def answer(sent, depth: int):
    """For each chunk's block, behind the merged block of its group: log probability of its codes, or training counts of its words."""

    def run(batches):
        for (kind, group), rows in by_group(batches, "kind", "grp"):
            keys, values = open_block(next(rows)["payload"])
            if kind == GRAMS:
                values = log_probabilities(keys, values, depth, sent.value)
            for r in rows:
                own = values[np.searchsorted(keys, open_block(r["payload"])[0])]
                yield rows_batch([(r["chunk"], kind, group, pack_counts(own) if kind == WORDS else compress(np.ascontiguousarray(own.view(np.uint8).reshape(-1, 4).T).tobytes(), 1))])

    return run


def floats(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(decompress(data), np.uint8).reshape(4, -1).T).reshape(-1).view(np.float32)


def spread(parts: list[np.ndarray], group: np.ndarray, kind) -> np.ndarray:
    """Answers by group, ascending, back in the order of the sorted keys."""
    out = np.empty(len(group), kind)
    out[np.argsort(group, kind="stable")] = np.concatenate(parts) if parts else np.zeros(0, kind)
    return out


def finish(depth: int, folds: int, groups: int, known: int, n_train: int):
    def run(batches):
        for _, chunk, rows in each_chunk(batches, depth, folds):
            yield scored(chunk, rows)

    def scored(chunk: Chunk, rows) -> pa.RecordBatch:
        grams, words = [], []
        for r in rows:
            (grams if r["kind"] == GRAMS else words).append(r["payload"])
        n = len(chunk.ids)
        keys, _ = chunk.grams()
        logs = spread([floats(x) for x in grams], gram_groups(keys, depth, groups), np.float64)
        index, total, size = KeyIndex(keys), np.zeros(n), np.zeros(n, np.int64)
        for own, code in chunk.codes():
            total += np.bincount(own, weights=logs[index.find(code)], minlength=n)
            size += np.bincount(own, minlength=n)
        del grams, keys, logs, index
        vocabulary, _ = chunk.vocabulary()
        counts = spread([unpack_counts(x) for x in words], word_groups(vocabulary, groups), np.int64)
        base, n_tokens, n_known = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for hashes, own in chunk.tokens():
            c = counts[np.searchsorted(vocabulary, hashes)]
            base += np.bincount(own, weights=np.log10(c + 0.1), minlength=n)
            n_tokens += np.bincount(own, minlength=n)
            n_known += np.bincount(own[c > 0], minlength=n)
        base -= n_tokens * math.log10(n_train + 0.1 * (known + 1))
        columns = [pa.array(chunk.ids, pa.int64()), pa.array(chunk.held), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(n, n_train, np.int64)), pa.array(base), pa.array(total / LN10), pa.array(size), pa.array(-total / LN2 / size)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    return run


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLES: dict[str, str] = {}
