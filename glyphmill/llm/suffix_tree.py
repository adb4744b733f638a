"""Language-model scores by a probabilistic suffix tree over words: contexts of different lengths, of which the longest in the tree predicts.

Texts are tokenised once, into slabs: tokens as places in the slab's own dictionary of 64-bit hashes. Counts of tokens, pairs and triples
over all training texts come from exchanges of distinct keys: each slab sends its own, sorted and packed, to the part of the key
space that they fall in, and gets their totals back in the same order. So an occurrence is never a row of a shuffle, a hot key is one entry a slab, and
parts are as many as the corpus needs to keep each of one size. Triples are counted below pairs that occur `min_count` times only, since rarer
contexts are not in the tree.

A context is in the tree if it occurs `min_count` times in training and its next-token distribution diverges from that of the context a word
shorter: the mean log ratio of the two over the context's own occurrences, each left out of the counts that predict it, is `divergence`
or more. With a context its suffixes are in the tree. A distribution is smoothed by `prior` occurrences dealt out as the shorter context
predicts; the empty context has add-one counts over the training vocabulary and one unknown token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glyphmill.llm import runs
from glyphmill.llm.common import byte_slices, materialize

END = np.uint64(0x9D8A6C6B5F0E21D3)
"""The hash of the token that ends each text."""
TOKEN, PAIR, TRIPLE = 1, 2, 3
_KEYS = "kind int, part long, slab long, keys binary, counts binary"
_TOTALS = "slab long, kind int, part long, totals binary, owned binary, n_keys long, n_all long"
_CONTEXTS = "kind int, part long, slab long, keys binary, counts binary, gains binary, shorter binary"
_KEPT = "slab long, kind int, part long, kept binary, keys binary"


def _pack(a: np.ndarray) -> bytes:
    """An array's bytes, those of equal place together, compressed."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return len(a).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpack(b: bytes, dtype: type) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = pa.decompress(b[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(dtype).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


def _slabs(batches: Iterator[pa.RecordBatch], modulus: int, remainder: int, slab_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row of about `slab_bytes` bytes of text, or one text: ids, which are held out, where each text's tokens end, the tokens and their hashes."""
    from pyspark import TaskContext

    first, made = TaskContext.get().partitionId() << 32, 0

    def slab(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal made
        table = pa.Table.from_batches(parts).combine_chunks()
        data, ends = runs.lowered(table.column("text").combine_chunks())
        found = runs.words(data, ends)
        last = np.cumsum(np.bincount(found.row, minlength=len(ends)) + 1)  # one past each text's end token
        hashes = np.full(int(last[-1]), END, np.uint64)
        hashes[np.arange(len(found.row)) + found.row] = found.hash64()
        known, token = np.unique(hashes, return_inverse=True)
        names = table.column("name").to_pylist()
        held = [x is not None and zlib.crc32(x.encode()) % modulus == remainder for x in names]
        row = [[first + made], [table.column("id").to_pylist()], [held], [_pack(last)], [_pack(token.astype(np.uint32))], [_pack_sorted(known)], [len(token)]]
        made += 1
        kinds = [pa.int64(), pa.list_(table.schema.field("id").type), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["slab", "ids", "held", "ends", "tokens", "known", "n"])

    waiting, size = [], 0
    for batch in batches:
        for part in byte_slices(batch, 0, slab_bytes):
            waiting.append(part)
            size += part.column(0).nbytes
            if size >= slab_bytes:
                yield slab(waiting)
                waiting, size = [], 0
    if waiting:
        yield slab(waiting)


@dataclass
class Tree:
    """The parameters that all steps share."""

    parts: int
    min_count: int
    prior: float
    n_tokens: int = 0
    n_known: int = 0

    def split(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The parts of the key space that sorted keys fall in, and which keys do."""
        part = ((keys >> np.uint64(40)) * np.uint64(self.parts)) >> np.uint64(24)
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(part[a]), slice(a, b)

    def keyed(self, slab: int, kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        """Rows of an exchange: a slab's keys and their counts, by part."""
        for part, at in self.split(keys):
            yield kind, part, slab, _pack_sorted(keys[at]), _pack(counts[at].astype(np.uint32))

    def root(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of tokens without context."""
        return (counts + 1.0) / (self.n_tokens + self.n_known + 1.0)

    def smoothed(self, counts: np.ndarray, of: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities in contexts that occur `of` times, and that a token follows `counts` times."""
        return (counts + self.prior * shorter) / (of + self.prior)


class Slab:
    """A slab's tokens and what the exchanges have told about them."""

    def __init__(self, row: dict, answers: list[dict], tree: Tree):
        self.number, self.ids, self.held, self.tree = row["slab"], row["ids"], np.array(row["held"], bool), tree
        self.ends, self.token, self.known = _unpack(row["ends"], np.int64), _unpack(row["tokens"], np.uint32), _unpack_sorted(row["known"])
        self.text = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))
        self.trained = ~self.held[self.text]
        answers = sorted(answers, key=lambda a: (a["kind"], a["part"]))
        of = lambda kind, name: [a[name] for a in answers if a["kind"] == kind and a[name] is not None]
        self.totals = {kind: np.concatenate([np.zeros(0, np.int64), *(_unpack(b, np.int64) for b in of(kind, "totals"))]) for kind in (TOKEN, PAIR, TRIPLE)}
        self.owned = {}
        for kind in (PAIR, TRIPLE):
            sizes = [int.from_bytes(b[:8], "little") for b in of(kind, "totals")]
            self.owned[kind] = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(of(kind, "owned"), sizes, strict=True))])
        self.kept = {kind: np.concatenate([np.zeros(0, np.uint8), *(_unpack(b, np.uint8) for b in of(kind, "kept"))]) > 0 for kind in (TOKEN, PAIR)} if answers and "kept" in answers[0] else {}

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and training counts."""
        return self.known, np.bincount(self.token[self.trained], minlength=len(self.known))

    def pairs(self) -> None:
        """Places whose token has a token before it; the pairs' keys, and each place's pair."""
        self.second = np.flatnonzero(self.text[1:] == self.text[:-1]) + 1
        h = self.known[self.token]
        self.pair_keys, self.first_at, self.pair = np.unique(runs.pair(h[self.second - 1], h[self.second]), return_index=True, return_inverse=True)

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        return self.pair_keys, np.bincount(self.pair[self.trained[self.second]], minlength=len(self.pair_keys))

    def triples(self) -> None:
        """Places after a pair that occurs often enough; the triples' keys, and each place's triple and pair before it."""
        often = self.totals[PAIR][self.pair] >= self.tree.min_count
        follows = np.flatnonzero((self.second[1:] == self.second[:-1] + 1) & often[:-1])  # places in self.second of the pair before
        self.third, self.before = self.second[follows + 1], self.pair[follows]
        keys = runs.pair(self.pair_keys[self.before], self.known[self.token[self.third]])
        self.triple_keys, self.triple_at, self.triple = np.unique(keys, return_index=True, return_inverse=True)

    def triple_counts(self) -> tuple[np.ndarray, np.ndarray]:
        return self.triple_keys, np.bincount(self.triple[self.trained[self.third]], minlength=len(self.triple_keys))

    def predictions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token without context; of the token in each place of `second` after one word; of those of `third` after two."""
        c, c2, c3 = self.totals[TOKEN], self.totals[PAIR], self.totals[TRIPLE]
        none = self.tree.root(c[self.token])
        one = self.tree.smoothed(c2[self.pair], c[self.token[self.second - 1]], none[self.second])
        at = np.searchsorted(self.second, self.third)
        return none, one, self.tree.smoothed(c3[self.triple], c2[self.before], one[at])

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens and which pairs of this slab are contexts that occur often enough."""
        word, two = np.zeros(len(self.known), bool), np.zeros(len(self.pair_keys), bool)
        word[self.token[self.second - 1]] = True
        two[self.before] = True
        return word & (self.totals[TOKEN] >= self.tree.min_count), two

    def contexts(self) -> Iterator[tuple]:
        """For each of its candidates what this slab adds to the divergence, of the pairs and triples that it owns; for each pair that it
        owns also the context a word shorter."""
        none, one, _ = self.predictions()
        prior, c2, c3 = self.tree.prior, self.totals[PAIR], self.totals[TRIPLE]

        def gains(counts: np.ndarray, shorter: np.ndarray, owned: np.ndarray) -> np.ndarray:
            left_out = np.log(np.maximum(counts - 1.0, 0.0) + prior * shorter) - np.log(shorter)
            return np.where(owned, counts * left_out, 0.0)

        place = self.second[self.first_at]
        g1 = np.bincount(self.token[place - 1], gains(c2, none[place], self.owned[PAIR]), minlength=len(self.known))
        g2 = np.bincount(self.before[self.triple_at], gains(c3, one[np.searchsorted(self.second, self.third[self.triple_at])], self.owned[TRIPLE]), minlength=len(self.pair_keys))
        last = np.where(self.owned[PAIR], self.known[self.token[place]], np.uint64(0))
        words, twos = self.candidates()
        for kind, keys, n, gain, shorter in ((TOKEN, self.known[words], self.totals[TOKEN][words], g1[words], np.zeros(int(words.sum()), np.uint64)), (PAIR, self.pair_keys[twos], c2[twos], g2[twos], last[twos])):
            for part, at in self.tree.split(keys):
                yield kind, part, self.number, _pack_sorted(keys[at]), _pack(n[at].astype(np.int64)), _pack(gain[at].astype(np.float64)), _pack(shorter[at])

    def scores(self) -> list[np.ndarray]:
        """Per text: tokens, known tokens, base score, score."""
        none, one, two = self.predictions()
        for kind, candidates in zip((TOKEN, PAIR), self.candidates(), strict=True):
            candidates[candidates] = self.kept[kind]
            if kind == TOKEN:
                after = candidates[self.token[self.second - 1]]
                best = none.copy()
                best[self.second[after]] = one[after]
            else:
                after = candidates[self.before]
                best[self.third[after]] = two[after]
        start = np.concatenate([[0], self.ends[:-1]])
        add = lambda x: np.add.reduceat(x, start)  # noqa: E731  each text has its end token at least
        return [np.diff(self.ends, prepend=0), add((self.totals[TOKEN] > 0)[self.token].astype(np.int64)), add(np.log10(none)), add(np.log10(best))]


def _totals(table: pa.Table) -> pa.Table:
    """All slabs' keys of one part: their totals, back to the slabs in the order of their keys; one slab owns each key. A row of slab -1 has the sums."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    keys = [_unpack_sorted(b) for b in table.column("keys").to_pylist()]
    counts = [_unpack(b, np.uint32) for b in table.column("counts").to_pylist()]
    _, first, key = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(key, np.concatenate(counts)).astype(np.int64)
    owner = np.zeros(len(key), bool)
    owner[first] = True
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    rows = [(s, kind, part, _pack(total[k]), np.packbits(o).tobytes(), None, None) for s, k, o in zip(table.column("slab").to_pylist(), np.split(key, cuts), np.split(owner, cuts), strict=True)]
    rows.append((-1, kind, part, None, None, int((total > 0).sum()), int(total.sum())))
    return _table(rows, _TOTALS)


def _kept(table: pa.Table, tree: Tree, divergence: float) -> pa.Table:
    """All slabs' candidates of one part: which of them are in the tree, back to the slabs in the order of their keys. Rows of slab -1 hold
    contexts that are in it as suffixes; of pairs in the tree such rows come out."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    rows = table.to_pylist()
    suffixes = [_unpack_sorted(r["keys"]) for r in rows if r["slab"] == -1]
    rows = [r for r in rows if r["slab"] >= 0]
    if not rows:
        return _table([], _KEPT)
    keys = [_unpack_sorted(r["keys"]) for r in rows]
    distinct, first, key = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    n = np.concatenate([_unpack(r["counts"], np.int64) for r in rows])[first]
    gain = np.bincount(key, np.concatenate([_unpack(r["gains"], np.float64) for r in rows])) - n * np.log(n - 1 + tree.prior)
    inside = gain >= divergence * n
    if suffixes:
        inside |= np.isin(distinct, np.concatenate(suffixes))
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    out = [(r["slab"], kind, part, _pack(i.astype(np.uint8)), None) for r, i in zip(rows, np.split(inside[key], cuts), strict=True)]
    if kind == PAIR:
        shorter = np.concatenate([_unpack(r["shorter"], np.uint64) for r in rows])
        shorter = np.unique(shorter[inside[key] & (shorter > 0)])
        out += [(-1, TOKEN, p, None, _pack_sorted(shorter[at])) for p, at in tree.split(shorter)]
    return _table(out, _KEPT)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def suffix_tree_scores(docs: DataFrame, *, id: str = "doc_id", text: str = "text", modulus: int = 7, remainder: int = 2, min_count: int = 64, divergence: float = 0.02, prior: float = 64.0, slab_bytes: int = 8_000_000, part_tokens: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`; scores are log10 probabilities of whole texts.

    Rows whose id as text has a crc32 of `remainder` modulo `modulus` are held out: nothing is learnt from them (a null id is not held out). Null and
    empty texts are one end token. Repeated rows count each. Texts of any length are taken whole; one of more than `slab_bytes` bytes is a slab by
    itself. Other columns are ignored. Without any training text every token is unknown. An empty table gives an empty result. Tokens are known by 64-bit
    hashes (n distinct ones and contexts: about n^2 / 2^65 collisions).
    """
    source = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{id}`").alias("id"), F.col(f"`{id}`").cast("string").alias("name"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"slab long, ids array<{kind}>, held array<boolean>, ends binary, tokens binary, known binary, n long"
    slabs = materialize(source.mapInArrow(lambda batches: _slabs(batches, modulus, remainder, slab_bytes), schema), "slabs")
    parts = max(1, -(-(slabs.agg(F.sum("n")).first()[0] or 0) // part_tokens))
    tree = Tree(parts, min_count, prior)

    def count(keys: DataFrame, name: str) -> DataFrame:
        return materialize(keys.groupBy("kind", "part").applyInArrow(_totals, _TOTALS), name)

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                slab = Slab(row, [], tree)
                slab.pairs()
                yield from _table([*tree.keyed(slab.number, TOKEN, *slab.tokens()), *tree.keyed(slab.number, PAIR, *slab.pair_counts())], _KEYS).to_batches()

    def told(answers: DataFrame) -> DataFrame:
        return answers.where("slab >= 0").drop("n_keys", "n_all")

    def with_answers(step, answers: DataFrame, schema: str) -> DataFrame:
        """step(slab) for each slab, which knows the answers."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            (row,) = left.to_pylist()  # a slab is one row, and has answers
            slab = Slab(row, right.to_pylist(), tree)
            slab.pairs()
            slab.triples()
            return step(slab)

        return slabs.drop("n").groupBy("slab").cogroup(answers.groupBy("slab")).applyInArrow(run, schema)

    known = count(slabs.drop("n").mapInArrow(first_keys, _KEYS), "tokens-and-pairs")
    sums = known.where((F.col("slab") == -1) & (F.col("kind") == TOKEN)).agg(F.sum("n_keys").alias("v"), F.sum("n_all").alias("n")).first()
    tree = Tree(parts, min_count, prior, sums["n"] or 0, sums["v"] or 0)
    triples = count(with_answers(lambda slab: _table(list(tree.keyed(slab.number, TRIPLE, *slab.triple_counts())), _KEYS), told(known), _KEYS), "triples")
    answers = told(known.union(triples))
    seen = materialize(with_answers(lambda slab: _table(list(slab.contexts()), _CONTEXTS), answers, _CONTEXTS), "contexts")
    decide = lambda df: df.groupBy("kind", "part").applyInArrow(lambda table: _kept(table, tree, divergence), _KEPT)
    pairs = materialize(decide(seen.where(F.col("kind") == PAIR)), "kept-pairs")
    words = decide(seen.where(F.col("kind") == TOKEN).unionByName(pairs.where("slab = -1").drop("kept"), allowMissingColumns=True))
    kept = pairs.where("slab >= 0").union(words).drop("keys")

    def score(slab: Slab) -> pa.Table:
        n, seen_before, base, total = slab.scores()
        return pa.table([pa.array(slab.ids, id_type), pa.array(slab.held), pa.array(n), pa.array(seen_before), pa.array(np.full(len(n), tree.n_tokens)), pa.array(base), pa.array(total)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    id_type = to_arrow_type(source.schema["id"].dataType)
    return with_answers(score, answers.unionByName(kept, allowMissingColumns=True), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
