"""Benchmark decontamination: windows of items found in documents through their rarest shingle, verified word by word."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import materialize, mix64, text_bytes
from pagewright.llm.substrings import ODD

#: Lower-cases A-Z and turns all that isn't in a word into a blank, on UTF-8 bytes: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Text bytes of items that are held and sent to executors at once; larger benchmarks go in several blocks. A byte of text
#: takes about 20 in a block's arrays and words.
BLOCK_BYTES = 16 << 20
#: Words of documents worked on at once, and candidate windows verified at once.
BATCH_WORDS, CANDIDATES = 250_000, 200_000
#: Bits of the table that most shingles are turned away by.
SIEVE = 22


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by its start."""
    out = np.full(max(0, len(hashes) - k + 1), k, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(ODD) + hashes[i : i + len(out)])
    return out


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, ODD, np.uint64)), np.cumprod(np.full(n, pow(ODD, -1, 1 << 64), np.uint64))


class Words:
    """Words of several texts, end to end: where they are and their hashes, which come from sums over bytes and not word by word."""

    def __init__(self, texts: list[bytes]):
        self.data = b"".join([t.translate(WORD_BYTES) + b" " for t in texts])
        blank = np.concatenate([[True], np.frombuffer(self.data, np.uint8) == 32])
        self.first, self.last = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.sizes = np.diff(np.searchsorted(self.first, begins))
        power, back = powers(1 << max(16, len(self.data).bit_length()))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.frombuffer(self.data, np.uint8) * power[: len(self.data)])])
            self.hashes = mix64((total[self.last] - total[self.first]) * back[self.first])
        self.text = np.repeat(np.arange(len(texts)), self.sizes)  # of each word
        self.ends = np.cumsum(self.sizes)

    def run(self, start: int, n: int) -> list[bytes]:
        """n words from one on."""
        return self.data[self.first[start] : self.last[start + n - 1]].split()

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of runs of k words inside one text, and their hashes."""
        h = shingle_hashes(self.hashes, k)
        at = np.flatnonzero(np.arange(k, len(h) + k) <= self.ends[self.text[: len(h)]]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]


class Lookup:
    """Place of hashes in a sorted array of distinct ones."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[keys >> np.uint64(64 - SIEVE)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are keys, and where."""
        near = np.flatnonzero(self.sieve[hashes >> np.uint64(64 - SIEVE)])
        at = np.searchsorted(self.keys, hashes[near])
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == hashes[near[hit]]
        return near[hit], at[hit]


class Block:
    """Distinct windows of a block's items: where each has its words, its length, its items and its shingles."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        own = Words([t for _, t in items])
        self.names, self.words, self.hashes = [i for i, _ in items], own, own.hashes
        length = np.minimum(own.sizes, window)
        n = np.where(own.sizes > 0, own.sizes - length + 1, 0)
        owner = np.repeat(np.arange(len(items)), n)
        start = np.repeat(own.ends - own.sizes, n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        length = length[owner]
        one, two = np.zeros(len(owner), np.uint64), np.zeros(len(owner), np.uint64)
        for k in np.unique(length).tolist():
            at = length == k
            one[at] = shingle_hashes(own.hashes, k)[start[at]]
            two[at] = shingle_hashes(mix64(own.hashes + np.uint64(1)), k)[start[at]]
        order = np.lexsort((owner, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        self.start, self.length = start[order][new], length[order][new]
        self.items, self.item_edges = owner[order], np.append(np.flatnonzero(new), len(order))
        self.k = np.minimum(self.length, shingle)
        self.lengths = np.unique(self.k).tolist()

    def shingles(self):
        """For each length k: the windows with shingles of k words, and their hashes, a row for each window."""
        for size in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == size)
            k = int(self.k[at[0]])
            h = shingle_hashes(self.hashes, k)
            yield at, h[self.start[at][:, None] + np.arange(size - k + 1)]

    def choose(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Take each window's rarest shingle by its count of documents; a window with one that no document has is left out."""
        rarest, offset = np.zeros(len(self.start), np.uint64), np.full(len(self.start), -1)
        for at, h in self.shingles():
            n = counts[np.searchsorted(keys, h)]
            best = np.lexsort((h, n), axis=1)[:, 0]
            row = np.arange(len(at))
            rarest[at], offset[at] = h[row, best], np.where(n[row, best] > 0, best, -1)
        at = np.flatnonzero(offset >= 0)
        at = at[np.argsort(rarest[at], kind="stable")]
        keys, first = np.unique(rarest[at], return_index=True)
        self.lookup, self.windows, self.offset = Lookup(keys), at, offset[at]
        self.edges = np.append(first, len(at))

    def occurrences(self, docs: Words) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the places in docs where they occur. Position and length are bounds before words are compared."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in self.lengths:
            at, h = docs.shingles(k)
            near, key = self.lookup.find(h)
            at, n = at[near], np.diff(self.edges)[key]
            several = np.cumsum(n)
            for lo in range(0, int(several[-1]) if len(n) else 0, CANDIDATES):
                hi = min(lo + CANDIDATES, int(several[-1]))
                which = np.searchsorted(several, np.arange(lo, hi), side="right")
                entry = self.edges[key[which]] + np.arange(lo, hi) - (several - n)[which]
                window, start = self.windows[entry], at[which] - self.offset[entry]
                length, text = self.length[window], docs.text[at[which]]
                fits = (self.k[window] == k) & (start >= docs.ends[text] - docs.sizes[text]) & (start + length <= docs.ends[text])
                window, start = window[fits], start[fits]
                found += [x for size in np.unique(self.length[window]).tolist() if len((x := self.equal(docs, window, start, size))[0])]
        return np.concatenate([w for w, _ in found]), np.concatenate([s for _, s in found])

    def equal(self, docs: Words, window: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates of one length whose words are all equal: first by their hashes, then themselves."""
        own = self.length[window] == size
        window, start = window[own], start[own]
        run = np.arange(size)
        own = (docs.hashes[start[:, None] + run] == self.hashes[self.start[window][:, None] + run]).all(axis=1)
        window, start = window[own], start[own]
        own = np.array([docs.run(s, size) == self.words.run(w, size) for s, w in zip(start.tolist(), self.start[window].tolist(), strict=True)], bool)
        return window[own], start[own]


def item_blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """Items (item, text bytes) with the number of the block that holds them; blocks have about BLOCK_BYTES at most."""
    items = materialize(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).filter("text is not null"), "items")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    return items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), int(blocks)


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Find the windows of benchmark items in documents, by a prefix-filtered join.

    docs: doc_id, text; items: item_id, text; other columns are ignored, but for those of docs named in carry, which come back in
    the struct carried. Words: A-Z lower-cased, runs of letters, digits and bytes from 0x80 on. A window: `window` consecutive
    words of an item; an item of fewer, but not none, is one window; null and empty items have none. A document contains a
    window only if it contains each shingle (run of `shingle` words, or the whole of a shorter window) of it, so the necessary
    prefix for full containment is one shingle: the rarest by its count of documents, over all documents. Documents are
    matched on that shingle, bounded by position and length, and compared word by word.
    Returns doc_id, text, n_words, n_hit (words inside any occurrence), items (sorted array of item ids as strings, each once)
    and carried per input row. Null text has no words; no items, or no documents, is fine; repeated items count once by their id; a
    null item_id counts as the empty string.
    Items go to executors in blocks of about BLOCK_BYTES as arrays of hashes and words, each with two passes over the documents and
    no shuffle of texts; hits of several blocks add up. Memory is bounded by a block, BATCH_WORDS and one document.
    """
    spark = docs.sparkSession
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(True).alias("row"), *carry).alias("carried"))
    spans = "array<struct<start:int,len:int>>"
    marked = kept.withColumn("spans", F.array().cast(spans)).withColumn("items", F.array().cast("array<string>")).withColumn("n_words", F.lit(0).cast("long"))
    blocked, blocks = item_blocks(items)
    for number in range(blocks):
        held = [(r["item"], r["text"].encode()) for r in blocked.filter(F.col("block") == number).select("item", "text").collect()]
        block = Block(held, window, shingle)
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h.ravel() for _, h in block.shingles())]))
        block.choose(keys, document_counts(kept, keys, block.lengths) if len(keys) else np.zeros(0, np.int64))
        if number:
            marked = materialize(marked, f"block{number}")
        marked = marked.mapInArrow(matcher(spark.sparkContext.broadcast(block)), marked.schema)
    ends = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["start"] + s["len"]).alias("end")),
    )
    return marked.select("doc_id", "text", "n_words", ends["n"].cast("long").alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), "carried")


def in_runs(texts: list[bytes]):
    """Texts as Words of about BATCH_WORDS at most, with the number of the first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= 6 * BATCH_WORDS or i == len(texts) - 1:
            yield first, Words(held)
            first, held, size = i + 1, [], 0


def document_counts(docs: DataFrame, keys: np.ndarray, lengths: list[int]) -> np.ndarray:
    """In how many documents each shingle is, over all documents. Summed in each task, then by shingle."""
    sent = docs.sparkSession.sparkContext.broadcast(Lookup(keys))

    def run(batches):
        total = np.zeros(len(sent.value.keys), np.int64)
        for batch in batches:
            for _, words in in_runs(text_bytes(batch.column(0))):
                for k in lengths:
                    at, h = words.shingles(k)
                    near, key = sent.value.find(h)
                    pairs = np.unique(words.text[at[near]] * len(total) + key)
                    total += np.bincount(pairs % len(total), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["s", "n"])

    counts = np.zeros(len(keys), np.int64)
    rows = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).toArrow()  # at most the block's shingles
    counts[rows.column("s").to_numpy()] = rows.column("n").to_numpy()
    return counts


def matcher(sent):
    def run(batches):
        block = sent.value
        for batch in batches:
            spans, items, n_words = batch.column(3).to_pylist(), batch.column(4).to_pylist(), np.zeros(len(batch), np.int64)
            for first, docs in in_runs(text_bytes(batch.column(1))):
                n_words[first : first + len(docs.sizes)] = docs.sizes
                window, start = block.occurrences(docs)
                text = docs.text[start]
                base = (docs.ends - docs.sizes)[text]
                order = np.lexsort((start, text))
                for i, own in itertools.groupby(zip(text[order].tolist(), (start - base)[order].tolist(), window[order].tolist(), strict=True), key=lambda x: x[0]):
                    merged, names = [], set()
                    for _, at, w in own:
                        length = int(block.length[w])
                        if merged and at <= merged[-1]["start"] + merged[-1]["len"]:
                            merged[-1]["len"] = max(merged[-1]["len"], at + length - merged[-1]["start"])
                        else:
                            merged.append({"start": at, "len": length})
                        names.update(block.names[x] for x in block.items[block.item_edges[w] : block.item_edges[w + 1]].tolist())
                    spans[first + i], items[first + i] = [*spans[first + i], *merged], sorted({*items[first + i], *names})
            columns = [*batch.columns[:3], pa.array(spans, batch.schema.field(3).type), pa.array(items, batch.schema.field(4).type), pa.array(n_words)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    joined = F.array_join("items", ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), hits AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id
  FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)) dw
  JOIN bw ON bw.n = dw.n AND bw.s = dw.s
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES = {"op7_decontamination": OP7_SQL}
