"""Near-dedup by Order MinHash: sketches of k-mers in text order, candidates by shared sketches, links by banded alignment."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pagewright.llm.common import LOWER, chunked, grouped, materialize, mix64
from pagewright.llm.line_dedup import NO_ID
from pagewright.llm.substrings import ODD, Hashes

#: Words of a k-mer, sketches of a text, k-mers of a sketch.
K, SKETCHES, ORDERED = 5, 16, 3
#: Two texts are compared in full if they share so many sketches.
SHARED = 2
#: Members of a block of a bucket. A task holds one block and as many visitors at most, 210 bytes each.
BLOCK = 8192
#: Texts of up to so many k-mers also meet by their k-mers, so that none of their links is missed.
FEW = 25
#: Bits of a text that bound how many k-mers it doesn't have in common with another.
BITS = 512
#: Candidates that a member has in a bucket in the first round, and how many times more in each round after.
FIRST, MORE = 2, 8
CHUNK = 2 << 20
#: k-mers of texts that a task keeps while it aligns pairs, as a text is in several.
HELD_KMERS = 1_500_000
#: At most so many labels or links are sent to all executors (under 10 MB); more are shuffled.
BROADCAST_LINKS = 200_000
#: Bits of the table, of fixed size, by which documents that are not candidates are left out before texts are shuffled.
SLOTS = 1 << 24

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def kmers(words: list[bytes], memo: Hashes) -> np.ndarray:
    """Hashes of the k-mers of a text in order; a shorter text, but not an empty one, is one k-mer."""
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(K, len(h))
    if not k:
        return h
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(ODD) + h[i : len(h) - k + 1 + i])
    return out


def labelled(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """k-mer hashes with their occurrence number inside their text mixed in, so no text has one twice."""
    order = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    out = np.empty_like(h)
    out[order] = mix64(h[order] + (np.arange(len(h)) - start).astype(np.uint64) * np.uint64(ODD))
    return out


def sketches(texts: list[np.ndarray]) -> np.ndarray:
    """For texts of one k-mer at least: their sketches. Each is a hash of the ORDERED labelled k-mers that come first under its own
    hash function (all, if fewer), put in the order in which they stand in the text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(sizes) - sizes
    labels = labelled(np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes))
    out = np.empty((len(texts), SKETCHES), np.uint64)
    for j in range(SKETCHES):
        h = mix64(labels + np.uint64((j + 1) * ODD & 0xFFFFFFFFFFFFFFFF))
        h[h == TOP] = 0
        spots = []
        for _ in range(ORDERED):
            least = np.minimum.reduceat(h, start)
            at = np.flatnonzero(h == np.repeat(least, sizes))
            own = np.searchsorted(start, at, side="right") - 1
            spot = np.full(len(texts), 1 << 60)
            spot[own[::-1]] = at[::-1]  # the first, should two share a hash
            spot[least == TOP] = 1 << 60
            spots.append(spot)
            h[spot[spot < 1 << 60]] = TOP
        total = np.full(len(texts), j + 1, np.uint64)
        for spot in np.sort(np.stack(spots), axis=0):
            here = spot < 1 << 60
            total = np.where(here, mix64(total * np.uint64(ODD) + labels[np.where(here, spot, 0)]), total)
        out[:, j] = total
    return out


def parities(labels: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """BITS bits of each text as bytes: whether an odd number of its labelled k-mers falls on a bit. Two texts differ in at most as
    many bits as there are k-mers that only one of them has."""
    out, ends = np.empty((len(sizes), BITS // 8), np.uint8), np.cumsum(sizes)
    for lo in range(0, len(sizes), 4096):
        own = sizes[lo : lo + 4096]
        bit = (labels[ends[lo] - sizes[lo] : ends[lo + len(own) - 1]] % np.uint64(BITS)).astype(np.int64)
        odd = np.bincount(np.repeat(np.arange(len(own)), own) * BITS + bit, minlength=len(own) * BITS) & 1
        out[lo : lo + 4096] = np.packbits(odd.astype(np.uint8).reshape(-1, BITS), axis=1)
    return out


def starts(labels: np.ndarray, least: float) -> np.ndarray:
    """The least labelled k-mers of a text, so many that two texts of a similarity of `least` have one of them in common."""
    n = len(labels)
    return np.sort(labels)[: n - math.ceil(least * n - 1e-9) + 1]


def prepared(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers sorted, and where each stands in the text."""
    order = np.argsort(labels)
    return labels[order], order


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """aligned_share() of two texts' labelled k-mers."""
    return aligned_share(prepared(a), prepared(b), least)


def aligned_share(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float) -> float:
    """Ordered share of common k-mers: aligned / (all of both - aligned), by banded alignment of prepared texts; 0 if under least.

    A labelled k-mer occurs once in a text, so the best alignment is the longest rising run of matched positions. With a
    similarity of `least`, at most (1 - least) / (1 + least) of all k-mers are unaligned, which bounds the band.
    """
    n = len(a[0]) + len(b[0])
    band = n * (1 - least) / (1 + least) + 1e-9
    if not n or abs(len(a[0]) - len(b[0])) > band:
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0]
    if n - 2 * int(hit.sum()) > band:
        return 0.0
    i, j = a[1][hit], b[1][at[hit]]
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if n - 2 * len(i) > band:
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        run = len(j)
    else:
        ends: list[int] = []
        for x in j.tolist():
            at = bisect.bisect_left(ends, x)
            ends[at : at + 1] = [x]
        run = len(ends)
    got = run / (n - run)
    return got if got >= least - 1e-12 else 0.0


def _sketch(least: float):
    def run(batches):
        for ids, texts in chunked(batches, CHUNK):
            memo, keys, hashes, own = Hashes(), [], [], []
            for i, t in enumerate(texts):
                words = t.translate(LOWER).split()
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                if words:
                    hashes.append(kmers(words, memo))
                    own.append(i)
            sk, few = [None] * len(ids), [None] * len(ids)
            n = np.zeros(len(ids), np.int32)
            if own:
                sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
                n[own] = sizes
                labels = labelled(np.concatenate(hashes), np.repeat(np.arange(len(hashes)), sizes))
                ends = np.cumsum(sizes)
                for i, row, bits, end, size in zip(own, sketches(hashes), parities(labels, sizes), ends, sizes, strict=True):
                    sk[i] = row.tobytes() + bits.tobytes()
                    few[i] = starts(labels[end - size : end], least).tobytes() if size <= FEW else b""
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(n), pa.array(sk, pa.binary()), pa.array(few, pa.binary())], names=["did", "key", "n", "marks", "few"])

    return run


def _explode(batches):
    """A row for each sketch of a text, and for each of its starts: bucket and node. A bucket is a hash of the sketch with its number in
    bits 1 to 4 and bit 0 clear, or of the k-mer with bit 0 set."""
    number = np.arange(SKETCHES, dtype=np.uint64) << np.uint64(1)
    for batch in batches:
        s = marks_of(batch.column(1))[0]
        few = batch.column(2).to_pylist()
        node = np.concatenate([np.repeat(np.arange(len(s)), SKETCHES), np.repeat(np.arange(len(s)), [len(f) // 8 for f in few])])
        bucket = np.concatenate([(s & ~np.uint64(2 * SKETCHES - 1) | number).ravel(), np.frombuffer(b"".join(few), np.uint64) | np.uint64(1)])
        yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), batch.column(0).take(pa.array(node))], names=["bucket", "node"])


def marks_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Sketches and parities of a column of marks, as rows of 64-bit words."""
    whole = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCHES + BITS // 64)
    return whole[:, :SKETCHES], whole[:, SKETCHES:]


UNIT = ["bucket", "unit", "part"]
MEMBER = "bucket long, unit int, part int, node long, n int, marks binary, blk int, minor boolean"
PAIRS = f"kind int, a long, b long, {MEMBER}"
ROWS = 8192


def _pairs(turn: int, least: float, away: bool):
    """Candidates inside units of buckets: kind 0 rows are pairs (a, b); kind 1 rows are members of units that have more pairs.

    A unit has its home members (blk = unit) and, in rounds away, visitors from other blocks of its bucket. At home each member meets the
    members before it; away each visitor meets the home members, and of two minor members only the one of the lesser block is a visitor.
    Candidates share SHARED sketches (fewer, in the bucket of a k-mer) and can reach `least` by their lengths and parities; a pair is one
    in the bucket of the first sketch that it shares only. A member's candidates are ranked by shared sketches. A round takes those
    ranked in [lo, hi) that are still of another class; ranks don't change from round to round, so every candidate has its turn.
    """
    lo = 0 if turn == 0 else FIRST * MORE ** (turn - 1)
    hi = FIRST * MORE**turn

    def run(batches):
        for (bucket, unit, _), own in grouped(batches, UNIT):
            node, n, label, blk = (own.column(c).to_numpy() for c in ("node", "n", "label", "blk"))
            minor = own.column("minor").to_numpy(zero_copy_only=False)
            sketch, bits = marks_of(own.column("marks"))
            sketch = np.ascontiguousarray(sketch.T)
            home = np.flatnonzero(blk == unit)
            pairs, more = [], False
            for i in np.flatnonzero(blk != unit) if away else range(1, len(node)):
                pool = home[~minor[home] | (blk[i] < unit)] if away else np.arange(i)
                pool = pool[(np.minimum(n[pool], n[i]) >= least * np.maximum(n[pool], n[i])) & (node[pool] != node[i])]
                # What is in one class with all it meets has no candidates left.
                if (label[pool] == label[i]).all():
                    continue
                equal = sketch[:, pool] == sketch[:, i : i + 1]
                shared = equal.sum(axis=0)
                fits = shared < SHARED if bucket & 1 else (shared >= SHARED) & (equal.argmax(axis=0) == (bucket >> 1) % SKETCHES)
                pool, shared = pool[fits], shared[fits]
                fits = np.bitwise_count(bits[pool] ^ bits[i]).sum(axis=1) <= (n[pool] + n[i]) * (1 - least) / (1 + least) + 1e-9
                pool, shared = pool[fits], shared[fits]
                if len(pool) > lo:
                    pool = pool[np.lexsort((node[pool], -shared))]
                    other = label[pool] != label[i]
                    pairs += [(min(int(node[j]), int(node[i])), max(int(node[j]), int(node[i]))) for j in pool[lo:hi][other[lo:hi]]]
                    more |= bool(other[hi:].any())
            yield from pair_rows(pairs, own if more else None)

    return run


def pair_rows(pairs: list[tuple[int, int]], members: pa.Table | None):
    """Record batches of PAIRS: found pairs, and the members of a unit that has more."""
    kinds = {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "bucket": pa.int64(), "unit": pa.int32(), "part": pa.int32(), "node": pa.int64(), "n": pa.int32(), "marks": pa.binary(), "blk": pa.int32(), "minor": pa.bool_()}
    if pairs:
        a, b = zip(*pairs, strict=True)
        known = {"kind": [0] * len(a), "a": a, "b": b}
        yield pa.RecordBatch.from_arrays([pa.array(known[c], t) if c in known else pa.nulls(len(a), t) for c, t in kinds.items()], names=list(kinds))
    if members is not None:
        for start in range(0, len(members), ROWS):
            for own in members.slice(start, ROWS).to_batches():
                known = {"kind": pa.array([1] * len(own), pa.int32())}
                yield pa.RecordBatch.from_arrays([known[c] if c in known else own.column(c).cast(t) if c in own.schema.names else pa.nulls(len(own), t) for c, t in kinds.items()], names=list(kinds))


def _verify(least: float):
    def run(batches):
        memo: Hashes = Hashes()
        texts: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def own(text: bytes) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if (x := texts.get(text)) is None:
                if len(memo) > 500_000:
                    memo.clear()
                if held > HELD_KMERS:
                    texts.clear()
                    held = 0
                h = kmers(text.translate(LOWER).split(), memo)
                x = texts[text] = prepared(labelled(h, np.zeros(len(h), np.int64)))
                held += len(h) + len(text) // 16
            return x

        for batch in batches:
            one, two = (c.cast(pa.binary()).to_pylist() for c in batch.columns[2:4])
            got = [aligned_share(own(x), own(y), least) for x, y in zip(one, two, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], names=["a", "b", "similarity"])

    return run


def sized(df: DataFrame, rows: int, per: int = 100_000) -> DataFrame:
    """The frame in as many partitions as a counted number of rows needs, where that is fewer than a shuffle makes."""
    return df.coalesce(max(6, rows // per)) if rows < 64 * per else df


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, label: the smallest node that links (a, b) reach; only nodes with links. Rounds of least neighbour and shortcut, each a
    table in the shared folder, until nothing changes. known: labels from other links, which stay joined; then links are first
    drawn between their labels, so a round moves only what is new."""
    n = links.count()
    small = F.broadcast if n <= BROADCAST_LINKS else (lambda df: df)
    own = links.select("a", "b")
    if known is not None:
        own = own.join(known.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        own = own.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b")
    both = materialize(sized(own.select(F.col("a").alias("u"), F.col("b").alias("v")).union(own.select("b", "a")).distinct(), n), "links")
    labels = materialize(sized(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).select(F.col("u").alias("node"), "label"), n), "labels")
    while True:
        near = both.join(small(labels.select(F.col("node").alias("v"), "label")), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = near.join(small(labels), "node").select("node", "label", F.least("label", "near").alias("to"))
        # The label's own least label, twice: shortcuts.
        for _ in range(2):
            ahead = small(labels.select(F.col("node").alias("to"), F.col("label").alias("ahead")))
            step = step.join(ahead, "to", "left").select("node", "label", F.least("to", F.coalesce("ahead", "to")).alias("to"))
        new = materialize(sized(step.select("node", F.col("to").alias("label"), (F.col("to") != F.col("label")).alias("changed")), n), "labels")
        labels = new.select("node", "label")
        if not new.filter("changed").limit(1).count():
            break
    if known is None:
        return labels
    moved = small(labels.select(F.col("node").alias("label"), F.col("label").alias("to")))
    old = known.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialize(old.unionByName(labels.join(known.select("node"), "node", "left_anti")), "labels")


def near_duplicates(docs: DataFrame, *, least: float = 0.8) -> DataFrame:
    """Class of near duplicates of each document: doc_id, class_id (least doc_id of the class), class_size (documents of the class).

    docs: doc_id, text; other columns are ignored. Words: A-Z lower-cased, [^\\x20\\x09-\\x0D]+; k-mers of 5 words (a shorter
    text is one k-mer), each labelled with its occurrence number. Documents with equal words are copies, of one class. Of different
    texts, those that share SHARED of 16 sketches are candidates (missed with a chance under 0.0003 at similarity 0.8), as are all
    that reach `least` among texts of up to FEW k-mers, by an index of their k-mers (none is missed). Candidates are linked if the
    ordered share of common k-mers, by banded alignment, is `least` or more. Classes are what links reach. A pair is left unaligned
    only if other links already put both texts in one class, so classes are those of all candidates. Texts without words are alone.
    Rows with different texts are different documents, also if they share doc_id or have none; a null doc_id is below all others, and a
    class that has one has a null class_id. An empty table gives an empty result.

    Copies are summed before the shuffle and go on as one text. A bucket of more than BLOCK members is dealt into blocks. First each
    member meets those of its own block; then only members that are not of the bucket's largest class by then (minor ones) visit the
    other blocks. So a group of near copies costs links in proportion to members, and no task holds a bucket.
    """
    rows, known = text_classes(docs, least)
    sizes = known.groupBy("label").agg(F.sum("copies").alias("class_size"))
    out = rows.select("did", "key").join(known.join(sizes, "label").select("key", "class_id", "class_size"), "key", "left")
    null_id = lambda c: F.when(c != NO_ID, c)
    return out.select(null_id(F.col("did")).alias("doc_id"), null_id(F.coalesce("class_id", "did")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def one_of_each(docs: DataFrame, *, least: float = 0.8) -> DataFrame:
    """The rows of docs that stay, one for each class of near duplicates: one with the least doc_id, null first, and a text of the class.
    Rows without words all stay."""
    _, known = text_classes(docs, least)
    kept = known.filter("first").select(F.col("key").alias("_key"), F.col("least").alias("_did"))
    keyed = docs.withColumn("_did", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    keyed = keyed.mapInArrow(_keyed, StructType([*keyed.schema.fields, StructField("_key", BinaryType())]))
    return keyed.join(kept, ["_key", "_did"], "left_semi").dropDuplicates(["_key"]).unionByName(keyed.filter("_key IS NULL")).drop("_key", "_did")


def _keyed(batches):
    """A column _key more: hash of the words of text."""
    for batch in batches:
        words = [(t or b"").translate(LOWER).split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words], pa.binary())], names=[*batch.schema.names, "_key"])


def text_classes(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (did, key) of docs, and for each text (key): its copies, least did, label and class_id of its class, whether it stands for it (first)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = materialize(rows.mapInArrow(_sketch(least), "did long, key binary, n int, marks binary, few binary"), "sketches")
    texts = rows.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("did").alias("least"), F.first("n").alias("n"), F.first("marks").alias("marks"), F.first("few").alias("few"))
    # Each text is a node of its own, also where texts share a doc_id or have none.
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    members = texts.select("node", "marks", "few").mapInArrow(_explode, "bucket long, node long")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    several = members.join(sizes, "bucket").select("bucket", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("blk"))
    several = materialize(several, "members")
    marks = texts.select("node", "n", "marks")
    own = several.join(marks, "node").select("bucket", F.col("blk").alias("unit"), F.lit(0).alias("part"), "node", "n", "marks", "blk", F.lit(False).alias("minor"))
    labels = in_units(docs, own, texts, None, least, "home")
    hot = several.filter("blocks > 1")
    if labels is not None and hot.limit(1).count():
        labels = in_units(docs, visitors(hot, labels).join(marks, "node"), texts, labels, least, "away")
    alone = texts.select("key", "least", "copies", F.col("node").alias("label"))
    if labels is None:
        known = alone.withColumns({"class_id": F.col("least"), "first": F.lit(True)})
    else:
        linked = texts.join(labels, "node")
        heads = linked.groupBy("label").agg(F.min(F.struct("least", "key")).alias("head"))
        linked = linked.join(heads, "label").select("key", "least", "copies", "label", F.col("head.least").alias("class_id"), (F.col("head.key") == F.col("key")).alias("first"))
        linked = materialize(linked, "linked")
        known = alone.join(linked.select("key"), "key", "left_anti").withColumns({"class_id": F.col("least"), "first": F.lit(True)}).unionByName(linked)
    return rows, materialize(known, "classes")


def with_labels(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with the label of their class; a text without links is a class of its own."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    known = F.broadcast(labels) if labels.count() <= BROADCAST_LINKS else labels
    return members.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))


def visitors(hot: DataFrame, labels: DataFrame) -> DataFrame:
    """Units in which members of buckets of several blocks meet those of other blocks: bucket, unit, part, node, blk, minor.

    Minor members are those outside the bucket's largest class. They visit all other blocks, in parts of about BLOCK; the members of a
    block are at home in each part. A bucket of one class has no units.
    """
    own = materialize(with_labels(hot, labels), "hot")
    counts = own.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")).select("bucket", F.col("top.label").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("parts"))
    own = own.join(F.broadcast(most) if most.count() <= BROADCAST_LINKS else most, "bucket").filter("parts > 0").withColumn("minor", F.col("label") != F.col("top"))
    home = own.select("bucket", F.col("blk").alias("unit"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "blk", "minor")
    away = own.filter("minor").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("unit"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("part"), "node", "blk", "minor")
    return materialize(home.unionByName(away.filter("unit <> blk")), "visitors")


def in_units(docs: DataFrame, members: DataFrame, texts: DataFrame, labels: DataFrame | None, least: float, name: str) -> DataFrame | None:
    """labels (node, label; None: no links) with the links that the members of units have among each other."""
    turn, rows = 0, None
    while True:
        several = with_labels(members, labels).repartition(*UNIT).sortWithinPartitions(*UNIT, "node")
        several = several.select("bucket", "unit", "part", "node", "n", "marks", "blk", "minor", "label")
        found = several.mapInArrow(_pairs(turn, least, name == "away"), PAIRS)
        found = materialize(found if rows is None else sized(found, rows, 2000), f"{name}{turn}", ("kind",))
        pairs = found.filter("kind = 0").select("a", "b").distinct()
        n = found.filter("kind = 0").count()
        if n:
            links = materialize(aligned(docs, materialize(sized(pairs, n), f"{name}_pairs{turn}"), texts, least).filter("similarity > 0"), f"{name}_links{turn}")
            if links.limit(1).count():
                labels = components(links, labels)
        members = found.filter("kind = 1").select(*[f.split()[0] for f in MEMBER.split(", ")])
        rows = members.count()
        if not rows:
            return labels
        turn += 1


def aligned(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """a, b, similarity (0 if under least) for pairs of texts, nodes (node, key, least); only texts that can be theirs are moved.

    Documents are first held against a table of SLOTS bits, which lets those pass whose id may be asked for; then joined by id and key.
    """
    n = pairs.count()
    few = F.broadcast if n <= BROADCAST_LINKS else (lambda df: df)
    own = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = materialize(sized(nodes.select("node", "key", F.col("least").alias("did")).join(few(own), "node", "left_semi"), 2 * n), "nodes")
    slot = F.shiftrightunsigned(F.xxhash64("did"), 64 - (SLOTS.bit_length() - 1))
    word, bit = F.shiftright(slot, 6).cast("int"), slot.bitwiseAND(F.lit(63)).cast("int")
    bits = own.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumns({"word": word, "bit": bit}).join(F.broadcast(bits), "word").filter(F.call_function("shiftrightunsigned", F.col("bits"), F.col("bit")).bitwiseAND(F.lit(1)) == 1)
    texts = texts.select("did", "text").mapInArrow(_keyed, "did long, text string, _key binary").withColumnRenamed("_key", "key").join(few(own), ["did", "key"])
    texts = materialize(texts.select("node", "text").dropDuplicates(["node"]), "pair_texts")
    one, two = texts.select(F.col("node").alias("a"), F.col("text").alias("one")), texts.select(F.col("node").alias("b"), F.col("text").alias("two"))
    both = one.join(few(pairs), "a").join(two, "b").select("a", "b", "one", "two")
    return sized(both.mapInArrow(_verify(least), "a long, b long, similarity double"), n, 1000)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLES: dict[str, str] = {}
