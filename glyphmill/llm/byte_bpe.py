"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of a slab of the corpus (all texts of an Arrow batch, up to a bounded number of bytes) lie one after another
in one symbol array, linked to their neighbours. An inverted index leads from token pair to the positions at which it starts; pairs
that make the same token share that token's rank and so an entry. The merges are applied in rank order, each to all words of the
slab at once; only the neighbours of merged symbols are looked up again and entered anew. Each distinct pre-token is merged once a
slab, and nothing is kept from one slab to the next.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill.llm.common import byte_slices, one, worker_state
from glyphmill.llm.pretokens import segments

_NONE = np.int32(2**31 - 1)


def _groups(values: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The items of each value, values ascending."""
    order = np.argsort(values, kind="stable")
    values, items = values[order], items[order]
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(values[a]), items[a:b]


class MergeTable:
    """The merges that a rank file implies: each way to split a token into two tokens has the token's rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        keys, values = [], []
        for token, rank in ranks.items():
            self.bytes[rank] = token
            for i in range(1, len(token)):
                a = ranks.get(token[:i])
                if a is not None:
                    b = ranks.get(token[i:])
                    if b is not None:
                        keys.append(a * self.size + b)
                        values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.values = np.array(values, np.int32)[order]
        #: Tokens that may form a pair of their own or a lower rank: their merges are applied one a word at a time.
        self.careful = np.zeros(self.size, bool)
        for part in (self.keys // self.size, self.keys % self.size):
            self.careful[part[self.values <= part]] = True
        edges = np.unique(np.geomspace(256, max(self.size, 257), 48).astype(np.int64))
        self.block = np.searchsorted(edges, np.arange(self.size), side="right").astype(np.int16)
        self.blocks = len(edges) + 1
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.names = [str(i) for i in range(self.size)]

    @classmethod
    def load(cls, path: str) -> MergeTable:
        """The table of a rank file; a worker holds the last one."""
        held = worker_state()
        if held.get("merge-path") != path:
            with open(path, "rb") as lines:
                held["merge-table"] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))})
            held["merge-path"] = path
        return held["merge-table"]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32)
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], _NONE)

    def one(self, word: bytes) -> list[int]:
        """A single word, merge by merge; what replay() must equal; for tests."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
            if best == _NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and where each word's ids end."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(words) else 0
        if not total:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        place = np.int32 if total < 2**31 else np.int64
        symbol = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word_of = np.repeat(np.arange(len(words), dtype=place), sizes)
        nxt, prv = np.arange(1, total + 1, dtype=place), np.arange(-1, total - 1, dtype=place)
        nxt[ends[sizes > 0] - 1], prv[(ends - sizes)[sizes > 0]] = -1, -1
        now = np.full(total, _NONE, np.int32)  # the rank of the pair that starts at each position
        inner = np.flatnonzero(nxt >= 0).astype(place)
        now[inner] = self.rank(symbol[inner], symbol[inner + 1])
        # the index: positions by rank for the ranks of the block that is open, by block of ranks beyond it
        later: list[list[np.ndarray]] = [[] for _ in range(self.blocks)]
        opened: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def enter(at: np.ndarray, block: int) -> None:
            soon = self.block[now[at]] <= block
            for r, part in _groups(now[at[soon]], at[soon]) if soon.any() else ():
                if r not in opened:
                    opened[r] = []
                    heapq.heappush(waiting, r)
                opened[r].append(part)
            at = at[~soon]
            for b, part in _groups(self.block[now[at]], at) if len(at) else ():
                later[b].append(part)

        enter(inner[now[inner] != _NONE], -1)
        for b in range(self.blocks):
            at = np.concatenate(later[b]) if later[b] else np.empty(0, place)
            later[b] = []
            at = at[now[at] != _NONE]
            enter(at[self.block[now[at]] == b], b)
            while waiting:
                r = heapq.heappop(waiting)
                found = opened.pop(r)
                at = np.unique(found[0] if len(found) == 1 else np.concatenate(found))
                at = at[now[at] == r]
                if not len(at):
                    continue
                if self.careful[r]:  # the leftmost of each word; what it leads to may come before the next
                    first = np.r_[True, word_of[at[1:]] != word_of[at[:-1]]]
                    if not first.all():
                        enter(at[~first], b)
                    at = at[first]
                elif len(at) > 1:  # of pairs that overlap in a chain the first, the third, and so on
                    chained = np.r_[False, nxt[at[:-1]] == at[1:]]
                    if chained.any():
                        begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                        at = at[(np.arange(len(at)) - begin) % 2 == 0]
                right = nxt[at]
                after = nxt[right]
                symbol[at], symbol[right] = r, -1
                now[at] = now[right] = _NONE
                nxt[at] = after
                linked = after >= 0
                after, left = after[linked], at[linked]
                prv[after] = left
                now[left] = self.rank(symbol[left], symbol[after])
                before = prv[at]
                before = before[before >= 0]
                now[before] = self.rank(symbol[before], symbol[nxt[before]])
                touched = np.concatenate([left, before])
                touched = touched[now[touched] != _NONE]
                if len(touched):
                    enter(touched, b)
        kept = np.flatnonzero(symbol >= 0)
        counts = np.bincount(word_of[kept], minlength=len(words))
        return symbol[kept], np.cumsum(counts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Slab:
    """Texts whose distinct pre-tokens are encoded together, once each."""

    def __init__(self, table: MergeTable, match, texts: list[str | None]):
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        self.texts = [[np.array([*map(number.__getitem__, match.findall(s))], np.int32) for s in segments(t)] for t in texts]
        self.flat, self.ends = table.replay([w.encode() for w in number])
        self.sizes = np.diff(self.ends, prepend=0)
        listed = self.flat.tolist()
        each = [listed[a:b] for a, b in zip([0, *self.ends.tolist()], self.ends.tolist(), strict=False)]
        self.names = [" ".join(map(table.names.__getitem__, ids)) for ids in each]
        self.decoded = list(map(table.decode, each))

    def digests(self, i: int) -> tuple[int, str, str]:
        """Of text i the number of ids, the SHA-256 of their decimal forms joined by spaces, and that of the bytes that they decode to."""
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for words in self.texts[i]:
            listed = words.tolist()
            of_ids.update(f"{' ' if n else ''}{' '.join(map(self.names.__getitem__, listed))}".encode())
            of_bytes.update(b"".join(map(self.decoded.__getitem__, listed)))
            n += int(self.sizes[words].sum())
        return n, of_ids.hexdigest(), of_bytes.hexdigest()

    def ids(self, i: int) -> list[np.ndarray]:
        """The ids of text i, in one array for each of its segments."""
        out = []
        for words in self.texts[i]:
            n = self.sizes[words]
            out.append(self.flat[np.repeat(self.ends[words] - np.cumsum(n), n) + np.arange(n.sum())])
        return out


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, *, id: str = "doc_id", text: str = "text", slab_bytes: int = 16_000_000, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, with `with_ids`; and the columns in `keep`), one row per input row.

    Null or empty text has no ids: n_tokens 0 and the hashes of the empty string. Null ids of rows stay null; rows that share
    an id are encoded separately; other columns are ignored. A text of any length is encoded whole: a slab holds texts of
    `slab_bytes` bytes, or one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        table, match = MergeTable.load(ranks_path), regex.compile(pattern)
        for batch in batches:
            for part in byte_slices(batch, 1, slab_bytes):
                slab = Slab(table, match, part.column(1).to_pylist())
                counts, hashes, decoded = zip(*map(slab.digests, range(part.num_rows)), strict=True)
                out = [part.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    flat = np.concatenate([np.empty(0, np.int32), *(run for i in range(part.num_rows) for run in slab.ids(i))])
                    out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat)))
                    names.append("ids")
                for i, k in enumerate(keep):
                    out.append(part.column(2 + i))
                    names.append(k)
                yield pa.RecordBatch.from_arrays(out, names)

    source = one(docs, id, text, *keep).toDF("doc_id", "text", *keep)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = f"doc_id {kinds['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + "".join(f", `{k}` {kinds[k]}" for k in keep)
    return source.mapInArrow(run, schema)
