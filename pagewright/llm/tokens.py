"""Token counts by prefix dynamic programming over byte-level BPE."""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import bounded

# The pre-tokeniser's pattern (a fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")

#: Distinct pieces kept with their count, for each Python worker; beyond it the table starts anew. Longer pieces are not kept, so the
#: table has a bound in bytes, too.
MEMO, KEPT_CHARS = 600_000, 64


def byte_alphabet() -> dict[str, int]:
    """Character of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + len(names) - len(shown))
    return {c: b for b, c in names.items()}


class PrefixBPE:
    """Exact token counts of every prefix of a text, for a byte-level BPE vocabulary file of the tokenizers library.

    The encoding of a prefix ends in the one token t for which the prefix before t ends in a token that may stand before t,
    that is, merging the two tokens' bytes gives the same two tokens. So last[i] and count[i] = count[i - len(t)] + 1 follow from
    shorter prefixes, and the encoding itself is never built.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = [t["content"] for t in data["added_tokens"] if t.get("special")]
        known = set(self.special)
        self.vocab = {raw(t): i for t, i in data["model"]["vocab"].items() if t not in known}
        self.ranks = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[raw(a), raw(b)] = rank
        self.longest: dict[int, int] = {}
        for t in self.vocab:
            self.longest[t[-1]] = max(self.longest.get(t[-1], 0), len(t))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.words = re.compile(ASCII_PATTERN, re.ASCII)
        self.any_words = regex.compile(PATTERN)
        self.blanks = regex.compile(r"\s+")
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        outer = self

        class Memo(dict):
            def __missing__(self, piece: str) -> int:
                n = outer.prefixes(piece.encode())[-1]
                if len(piece) <= KEPT_CHARS:
                    self[piece] = n
                return n

        self.memo = Memo()

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short byte string: the pair of lowest rank first, leftmost on ties."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: bytes, b: bytes) -> bool:
        if (ok := self.pairs.get((a, b))) is None:
            ok = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return ok

    def prefixes(self, data: bytes) -> list[int]:
        """Token count of data[:i] for i from 0 to len(data)."""
        vocab, longest, pairs = self.vocab, self.longest, self.pairs
        count, last = [0], [b""]
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - longest.get(data[i - 1], 1)), i):
                t = data[j:i]
                if t in vocab:
                    before = last[j]
                    ok = pairs.get((before, t)) if (j == 0 or before) else False
                    if ok is None:
                        ok = self.may_follow(before, t)
                    if ok:
                        count.append(count[j] + 1)
                        last.append(t)
                        break
            else:
                raise ValueError("a byte is not in the vocabulary")
        return count

    def pieces(self, text: str) -> list[str]:
        return (self.words if text.isascii() else self.any_words).findall(text)

    def tidy(self) -> None:
        if len(self.memo) > MEMO:
            self.memo.clear()
        if len(self.pairs) > 4 * MEMO:
            self.pairs.clear()

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def count(self, text: str) -> int:
        memo = self.memo
        self.tidy()
        if self.has_special(text):
            parts = self.split.split(text)
            return sum(sum(map(memo.__getitem__, self.pieces(x))) for x in parts[::2]) + len(parts) // 2
        return sum(map(memo.__getitem__, self.pieces(text)))

    def table(self, piece: str) -> list[int]:
        """Token count of piece[:i] for i from 0 to len(piece), where each of them is one piece."""
        own = self.prefixes(piece.encode())
        if piece.isascii():
            return own
        return [own[n] for n in itertools.accumulate((len(c.encode()) for c in piece), initial=0)]

    def inside(self, piece: str) -> list[int]:
        """Token count of piece[:i] for a piece of a text; the beginning of a contraction is other pieces."""
        if len(piece) <= 3 and piece[0] == "'" and piece[1:].isalpha():
            return [self.count(piece[:i]) for i in range(len(piece))] + [self.memo[piece]]
        return self.table(piece)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of text[:i] for every i from 0 to len(text), as if each prefix were encoded alone; in time linear in the text.

        A prefix has all pieces of the text before it but its last one, whose table of prefixes answers. A run of blanks is cut into
        pieces by what follows; at the end of a prefix it is one piece, so the table of the whole run answers there.
        """
        out = np.zeros(len(text) + 1, np.int64)
        if self.has_special(text):
            at, base = 0, 0
            parts = self.split.split(text)
            for part, special in itertools.zip_longest(parts[::2], parts[1::2], fillvalue=""):
                whole = part + special[:-1]  # a cut special string is ordinary text, together with what stands before it
                out[at : at + len(whole) + 1] = base + self.plain_counts(whole)
                base = int(out[at + len(part)]) if not special else base + self.count(part) + 1
                at += len(part) + len(special)
                out[at] = base
            return out
        return self.plain_counts(text)

    def plain_counts(self, text: str) -> np.ndarray:
        self.tidy()
        out, at, total, run_end = np.zeros(len(text) + 1, np.int64), 0, 0, 0
        for piece in self.pieces(text):
            if at >= run_end and self.blanks.match(piece):
                run_end = self.run_end(text, at)
                out[at + 1 : run_end + 1] = [total + n for n in self.table(text[at:run_end])[1:]]
            end = at + len(piece)
            if end > run_end:
                own = self.inside(piece)
                skip = max(1, run_end - at + 1)  # what is in the run of blanks has its answer
                out[at + skip : end + 1] = [total + n for n in own[skip:]]
                total += own[-1]
            else:
                total += self.memo[piece]
            at = end
        return out

    def cut(self, text: str, budget: int) -> int:
        """Length of the longest prefix that has at most budget tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])

    def count_and_cut(self, text: str, budget: int) -> tuple[int, int]:
        """count(), and cut() from the tables of the pieces around the budget alone."""
        if self.has_special(text):
            n = self.count(text)
            return n, len(text) if n <= budget else self.cut(text, budget)
        self.tidy()
        pieces = self.pieces(text)
        counts = [self.memo[x] for x in pieces]
        n = sum(counts)
        if n <= budget:
            return n, len(text)
        # The first piece whose end is beyond the budget; no prefix that ends after it, and the blanks it is part of, is within.
        totals = list(itertools.accumulate(counts[: budget + 1]))
        last = bisect.bisect_right(totals, budget)
        first = last  # blanks before it belong to it
        while first and self.blanks.fullmatch(pieces[first - 1]):
            first -= 1
        before = totals[first - 1] if first else 0
        at = sum(map(len, pieces[:first]))
        end = at + sum(map(len, pieces[first : last + 1]))
        if self.blanks.fullmatch(pieces[last]):
            end = self.run_end(text, end - 1)
        return n, at + int(np.flatnonzero(self.plain_counts(text[at:end]) <= budget - before)[-1])

    def run_end(self, text: str, at: int) -> int:
        """Where the run of blanks ends that text[at] is in."""
        return self.blanks.match(text, at).end()


@functools.lru_cache(maxsize=4)
def prefix_bpe(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def count_tokens(docs: DataFrame, path: str, *, limit: int = 512) -> DataFrame:
    """Token count of every whole text: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), cut_chars per input row.

    docs: doc_id, text; other columns are ignored. path: vocabulary file, present on every executor. cut_chars: characters of the
    longest prefix of the text that has at most limit tokens when it is encoded alone, answered from prefix tables. No begin or end
    tokens; special strings inside texts count one token each. Null is the empty text: 0 tokens. An empty table gives an empty result.
    One pass without a shuffle; a worker keeps a bounded table of counts of pieces. Time is linear in a text.
    """

    def run(batches):
        bpe = prefix_bpe(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts, cuts = zip(*(bpe.count_and_cut(x, limit) for x in texts), strict=True) if texts else ((), ())
            columns = [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(cuts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    bounded(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
