"""Token counts by a map-side two-tier lookup (no shuffle of pre-tokens).

Tier one is a compact hash table of the lengths of frequent pre-tokens, broadcast as four numpy arrays and looked up there: sorted
64-bit hashes, lengths, and the pre-tokens' bytes with their ends, which confirm each hit. The frequent pre-tokens are counted over
all documents: each task sums up its own in a counter of bounded size, and the tasks' summaries, one row each, are merged in a tree
of tasks that each read a few written rows, so no pre-token is a key of a shuffle. Tier two is a cache in each Python worker, bounded in
bytes, that is filled by encoding the misses with the library. Neither tier changes a result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill.llm.common import byte_slices, discard, materialize, one, worker_state
from glyphmill.llm.pretokens import pieces, segments

_SUMMARY = "words array<string>, counts array<long>"
FANIN = 32  # summaries that one task merges
ENTRY = 120  # bytes that an entry of the cache takes beside its characters


def _library(path: str):
    """The tokeniser of `path`, one per worker; its own parallelism is off as tasks are the parallelism."""
    held = worker_state()
    if ("library", path) not in held:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        held["library", path] = tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return held["library", path]


def _summary(counts: Counter, size: int) -> pa.RecordBatch:
    top = counts.most_common(size)
    return pa.RecordBatch.from_arrays([pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["words", "counts"])


def frequent_pretokens(docs: DataFrame, text: str, pattern: str, table_size: int = 65536, per_task: int = 8192, held: int = 500_000) -> list[str]:
    """The most frequent pre-tokens of all documents, at most `table_size`. A task holds at most `held` of them and hands on `per_task`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        match, counts = regex.compile(pattern), Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for s in segments(value):
                    counts.update(match.findall(s))
                if len(counts) > held:
                    counts = Counter(dict(counts.most_common(held // 4)))
        yield _summary(counts, per_task)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for words, ns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update(dict(zip(words, ns, strict=True)))
        yield _summary(counts, table_size)

    rows = materialize(one(docs, text).mapInArrow(count, _SUMMARY), "frequent")
    n = rows.count()
    while n > 1:
        last, n = rows, -(-n // FANIN)
        rows = materialize(last.coalesce(n).mapInArrow(merge, _SUMMARY), "frequent")
        discard(last)
    first = rows.first()
    discard(rows)
    return sorted(first["words"][:table_size]) if first else []


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Table:
    """A hash table in arrays: which of some words it holds, and their numbers of tokens."""

    def __init__(self, words: list[str], lengths: list[int]):
        raw = [w.encode() for w in words]
        hashes = _hashes(raw)
        order = np.argsort(hashes, kind="stable")
        raw = [raw[i] for i in order]
        self.hashes, self.lengths = hashes[order], np.array(lengths, np.int32)[order]
        self.bytes, self.ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(w) for w in raw], dtype=np.int64)

    def look_up(self, words: list[str]) -> np.ndarray:
        """The length of each word, -1 where the table does not hold it."""
        out = np.full(len(words), -1, np.int32)
        if not len(self.hashes) or not words:
            return out
        raw = [w.encode() for w in words]
        hashes = _hashes(raw)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        flat = self.bytes.tobytes()
        for i in np.flatnonzero(self.hashes[at] == hashes).tolist():
            e = int(self.ends[at[i]])
            if flat[e - len(raw[i]) : e] == raw[i] and (e == len(raw[i]) or int(self.ends[at[i] - 1]) == e - len(raw[i])):
                out[i] = self.lengths[at[i]]
        return out


def _lengths(tokenizer, items: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(items, add_special_tokens=False)]


def _unassigned(word: str) -> bool:
    """Whether a character has no category in Python's tables: there, and only there, the pattern's and the library's tables may differ."""
    return not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word)


def count_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, *, id: str = "doc_id", text: str = "text", limit: int = 512, table_size: int = 65536, cache_bytes: int = 32_000_000, slab_bytes: int = 16_000_000) -> DataFrame:
    """Columns doc_id, n_bytes, n_tokens, over_limit, for every row of `docs` (any number of rows per id; other columns are ignored).

    `pattern` cuts texts into the pre-tokens that the library encodes each by itself. Null or empty text counts 0 tokens. A null id stays
    null. Special-token strings inside a text count as the library counts them. A text of any length is counted whole; one with
    characters that Unicode's tables in Python do not know is cut at white space only. An empty table gives an empty result. The cache
    holds about `cache_bytes` bytes and is emptied when full; pre-tokens of more than 64 characters are encoded but not kept.
    """
    spark = docs.sparkSession
    tokenizer, _ = _library(tokenizer_path)
    known = frequent_pretokens(docs, text, pattern, table_size)
    table = spark.sparkContext.broadcast(Table(known, _lengths(tokenizer, known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import regex

        tokenizer, special = _library(tokenizer_path)
        match = regex.compile(pattern)
        split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        state = worker_state()

        def lengths_of(words: list[str]) -> np.ndarray:
            """Tier one, then tier two, then the library."""
            found = table.value.look_up(words)
            cache = state.setdefault(("lengths", tokenizer_path), {})
            missing = []
            for i in np.flatnonzero(found < 0).tolist():
                n = cache.get(words[i])
                if n is None:
                    missing.append(i)
                else:
                    found[i] = n
            got = _lengths(tokenizer, [words[i] for i in missing])
            found[missing] = got
            kept = {words[i]: n for i, n in zip(missing, got, strict=True) if len(words[i]) <= 64}
            size = sum(map(len, kept)) + ENTRY * len(kept)
            if state.get("lengths-bytes", 0) + size > cache_bytes:
                cache.clear()
                state["lengths-bytes"] = 0
            if size <= cache_bytes:
                cache.update(kept)
                state["lengths-bytes"] = state.get("lengths-bytes", 0) + size
            return found

        for batch in batches:
            for part in byte_slices(batch, 1, slab_bytes):
                number: defaultdict[str, int] = defaultdict()
                number.default_factory = number.__len__
                cut, extra = [], []
                for value in part.column(1).to_pylist():
                    parts = split.split(value) if value and any(s in value for s in special) else [value]
                    extra.append(len(parts) - 1)
                    cut.append(([np.array([*map(number.__getitem__, match.findall(s))], np.int32) for x in parts for s in segments(x)], parts))
                words = list(number)
                odd = np.fromiter(map(_unassigned, words), bool, len(words))
                sizes = lengths_of(words)
                counts = []
                for (runs, parts), more in zip(cut, extra, strict=True):
                    if odd.any() and any(odd[r].any() for r in runs):
                        counts.append(more + sum(_lengths(tokenizer, [p for x in parts for p in pieces(x)])))
                    else:
                        counts.append(more + sum(int(sizes[r].sum()) for r in runs))
                n_bytes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n_bytes, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = one(docs, id, text).toDF("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
