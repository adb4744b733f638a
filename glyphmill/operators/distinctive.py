"""The most distinctive phrases of each document among all its runs of a few words, without a table of phrases.

A corpus has a phrase for nearly every word and length, tens of times its texts as strings, and nearly all of them occur in one document. Here
they are hashes, and only those that can matter are counted:

1. Documents are packed once, where they are read, into slabs of about `SLAB_BYTES` of text, written to the shared folder.
2. The shortest phrases fall in cells of a space some sixteen times as large as their number. Each slab sends its distinct cells with its number of
   documents in each, sorted and packed, to the part of the space that they fall in, and gets their totals back. A cell of one document holds phrases
   of one document, and so is every longer phrase around one of these. That is exact: a shared cell only means that more is to be asked.
3. What is left of all lengths is counted by 64-bit hashes in the same way.
4. Each slab then knows the frequency of every phrase in it. It puts out, as strings, what may be among a document's best.

A hot phrase is one entry a slab. Parts grow in number with the corpus, so that each stays of one size; where slabs have less than a key for a part,
an exchange becomes plain rows. Two phrases of one 64-bit hash would be counted as one (n that get as far: about n^2 / 2^65 such pairs).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from glyphmill.operators.storage import discard, materialize

SLAB_BYTES = 4 << 20
PART_KEYS = 1 << 22
LONG_WORD = 64
CLOSE = 2e-9
"""Scores are rounded to nine digits; what is this close to the last place is put out too."""
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\f\x0b", np.uint8))
_SLABS = "slab long, ids array<{kind}>, rooms array<long>, data binary, size long, ends binary, owners binary, n_words long"
_KEYS = "part long, slab long, keys binary, docs binary"
_TOTALS = "part long, slab long, totals binary"


def _pack(a: np.ndarray) -> bytes:
    """An array, its bytes of equal place together, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
    return len(a).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpack(b: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(b[8:], decompressed_size=n * width, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _by_documents(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and in how many of the (ascending) documents each is."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    fresh = new.copy()
    fresh[1:] |= docs[1:] != docs[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(fresh, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)


def _packed_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, room if there is one, texts) as slabs: ids, their rooms, the texts' bytes, where each ends, and which document it is of."""
    from pyspark import TaskContext

    made = TaskContext.get().partitionId() << 32
    ids, rooms, owners, texts, size = [], [], [], [], 0

    def slab() -> pa.RecordBatch:
        data, ends = b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
        found = _starts(np.frombuffer(data, np.uint8), ends)
        row = [[made], [ids], [rooms], [pa.compress(data, codec="zstd", asbytes=True)], [len(data)], [_pack(ends)], [_pack(np.array(owners, np.int64))], [len(found)]]
        kinds = [pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        names = ["slab", "ids", "rooms", "data", "size", "ends", "owners", "n_words"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for doc, room, parts in zip(batch.column("doc_id").to_pylist(), batch.column("room").to_pylist() if "room" in batch.schema.names else [0] * len(batch), batch.column("texts"), strict=True):
            parts = parts.as_py()
            owners += [len(ids)] * len(parts)
            ids.append(doc)
            rooms.append(room)
            texts += parts
            size += sum(map(len, parts))
            if size >= SLAB_BYTES:
                yield slab()
                made, ids, rooms, owners, texts, size = made + 1, [], [], [], [], 0
    if ids:
        yield slab()


def _starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words begin: at what is no space after a space or at a text's start."""
    begins = np.ones(len(data) + 1, bool)
    begins[1:-1] = _SPACE[data[:-1]] if len(data) else True
    begins[ends] = True
    return np.flatnonzero(begins[:-1] & ~_SPACE[data])


class Slab:
    """A slab's words, and the hashes of its phrases of `low` to `high` words by the place of their first one."""

    def __init__(self, row: dict, low: int, high: int):
        self.number, self.ids, self.rooms, self.low, self.high = row["slab"], row["ids"], row["rooms"], low, high
        self.data = np.frombuffer(pa.decompress(row["data"], decompressed_size=row["size"], codec="zstd", asbytes=True) if row["size"] else b"", np.uint8)
        ends, owners = _unpack(row["ends"], np.int64), _unpack(row["owners"], np.int64)
        self.start = _starts(self.data, ends)
        text = np.searchsorted(ends, self.start, side="right")
        stops = np.flatnonzero(np.append(_SPACE[self.data], True))
        self.end = np.minimum(stops[np.searchsorted(stops, self.start)], ends[text]) if len(text) else self.start
        self.doc = owners[text]
        self.left = np.searchsorted(text, text, side="right") - np.arange(len(text))
        self.plain = None
        self.word = self._word_hashes()
        self.place, self.hash = {}, {}
        g = self.word
        for n in range(2, high + 1):
            g = _mixed(g[: max(len(self.word) - n + 1, 0)] * np.uint64(0x9E3779B97F4A7C15) + self.word[n - 1 :])
            if n >= low:
                self.place[n] = np.flatnonzero(self.left[: len(g)] >= n)
                self.hash[n] = g[self.place[n]]

    def _word_hashes(self) -> np.ndarray:
        out, length = np.full(len(self.start), 0xCBF29CE484222325, np.uint64), self.end - self.start
        active, i = np.flatnonzero(length <= LONG_WORD), 0
        while len(active):
            out[active] = (out[active] ^ self.data[self.start[active] + i]) * np.uint64(0x100000001B3)
            i += 1
            active = active[length[active] > i]
        for w in np.flatnonzero(length > LONG_WORD).tolist():
            out[w] = int.from_bytes(hashlib.blake2b(self.data[self.start[w] : self.end[w]].tobytes(), digest_size=8).digest(), "little")
        return _mixed(out)

    def cells(self, bits: int) -> np.ndarray:
        return self.hash[self.low] >> np.uint64(64 - bits)

    def asked(self, bits: int, totals: np.ndarray) -> dict[int, np.ndarray]:
        """Which phrases of each length are to be counted by their hashes: those that hold no shortest phrase from a cell of one document."""
        shared = np.zeros(len(self.word) + self.high, bool)
        shared[self.place[self.low]] = totals[np.unique(self.cells(bits), return_inverse=True)[1]] > 1
        return {n: np.logical_and.reduce([shared[at + j] for j in range(n - self.low + 1)]) for n, at in self.place.items()}

    def questions(self, asked: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes to count, and their documents in ascending order."""
        keys = np.concatenate([self.hash[n][asked[n]] for n in asked])
        docs = np.concatenate([self.doc[self.place[n][asked[n]]] for n in asked])
        order = np.argsort(docs, kind="stable")
        return keys[order], docs[order]

    def best(self, k: int, n_docs: int, asked: dict[int, np.ndarray], totals: np.ndarray) -> tuple[list, list, list, list]:
        """doc_id, phrase, tf, df of all phrases that may be among their document's k best by (rounded weight, phrase), both descending."""
        repeated, heads = self._repeated(), self._word_heads()
        doc, df, tf, place, n_of = (np.concatenate(x) for x in zip(self._open(asked, totals, repeated), self._plain(asked, k, repeated, heads), strict=True))
        if not len(doc):
            return [], [], [], []
        few, pair = np.unique(tf << 40 | df, return_inverse=True)  # few different ones, whose scores are put in order
        few_tf, few_df = few >> 40, few & ((1 << 40) - 1)
        score = (1 + np.log(few_tf)) * (np.log((1 + n_docs) / (1 + few_df)) + 1)
        level = np.searchsorted(np.sort(score), score + CLOSE, side="right")
        lowest = np.searchsorted(np.sort(score), score - CLOSE)
        kept = _upto(doc, level[pair], k, lowest[pair])
        doc, pair, place, n_of = doc[kept], pair[kept], place[kept], n_of[kept]
        # of phrases of one document, tf and df the k last ones by first word are enough, and what may begin with the last of these words
        first = heads[place]
        kept = _upto(doc * len(few) + pair, first, k, first)
        tf, df = few_tf[pair], few_df[pair]
        return [self.ids[d] for d in doc[kept].tolist()], self.strings(place[kept], n_of[kept]), tf[kept].tolist(), df[kept].tolist()

    def strings(self, place: np.ndarray, n_of: np.ndarray) -> list[bytes]:
        if self.plain is None:
            self.plain = self.data.tobytes(), self.start.tolist(), self.end.tolist()
        text, start, end = self.plain
        return [b" ".join(text[start[j] : end[j]] for j in range(p, p + n)) for p, n in zip(place.tolist(), n_of.tolist(), strict=True)]

    def counted(self, asked: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, place and length of all that were asked for."""
        key, place = (np.concatenate([x[n][asked[n]] for n in asked]) for x in (self.hash, self.place))
        return key, place, np.concatenate([np.full(np.count_nonzero(asked[n]), n) for n in asked])

    def named(self, asked: dict[int, np.ndarray], totals: np.ndarray) -> tuple[list, list]:
        """phrase, df of what has more than one document, for the totals that this slab has."""
        key, place, n_of = self.counted(asked)
        at = np.unique(key, return_index=True)[1][totals > 1]
        return self.strings(place[at], n_of[at]), totals[totals > 1].tolist()

    def fitting(self, n_docs: int, most: float, asked: dict[int, np.ndarray], totals: np.ndarray) -> tuple[list, list, list, list]:
        """doc_id, phrase, tf, df of 2 to `most` documents, of each document what may be among its best by (rounded tf * idf, phrase), both descending,
        until the characters of the second and later ones reach its room."""
        key, place, n_of = self.counted(asked)
        df = totals[np.unique(key, return_inverse=True)[1]]
        key, place, n_of, df = (x[(df > 1) & (df <= most)] for x in (key, place, n_of, df))
        if not len(key):
            return [], [], [], []
        doc = self.doc[place]
        order = np.lexsort((key, doc))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(doc[order]) != 0)
        tf, one = np.diff(np.append(np.flatnonzero(new), len(order))), order[new]
        doc, place, n_of, df = doc[one], place[one], n_of[one], df[one]
        score = tf * (np.log((1 + n_docs) / (1 + df)) + 1)
        order = np.lexsort((-score, doc))
        doc, place, n_of, df, tf, score = (x[order] for x in (doc, place, n_of, df, tf, score))
        begun = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        chars = np.concatenate([[0], np.cumsum(begun[self.end] - begun[self.start])])
        length = chars[place + n_of] - chars[place] + n_of - 1
        own = np.diff(doc, prepend=-1) != 0
        run = own | (np.diff(score, prepend=score[0]) < -CLOSE)  # scores of a run may be equal when rounded
        total = np.concatenate([[0], np.cumsum(length)])[:-1]
        runs, owns = np.flatnonzero(run), np.flatnonzero(own)
        longest = np.repeat(np.maximum.reduceat(length, owns), np.diff(np.append(owns, len(own))))  # what the first of a document may spare
        before = total - np.repeat(total[owns], np.diff(np.append(owns, len(own)))) - longest
        room = np.array(self.rooms, np.int64)[doc]
        kept = []
        for a, b in zip(runs.tolist(), np.append(runs[1:], len(run)).tolist(), strict=True):
            if not own[a] and before[a] >= room[a]:
                continue
            if before[b - 1] < room[a] or len(set(zip(tf[a:b].tolist(), df[a:b].tolist(), strict=True))) > 1:
                kept += range(a, b)
                continue
            spent, names = before[a], self.strings(place[a:b], n_of[a:b])  # equal scores: by phrase
            for i in sorted(range(b - a), key=names.__getitem__, reverse=True):
                kept.append(a + i)
                spent += length[a + i]
                if spent >= room[a]:
                    break
        kept = np.array(kept, np.int64)
        return [self.ids[d] for d in doc[kept].tolist()], self.strings(place[kept], n_of[kept]), tf[kept].tolist(), df[kept].tolist()

    def _repeated(self) -> np.ndarray:
        """Of each word, whether a shortest phrase that begins there is in its document again: only there may a phrase have a tf above 1."""
        out, at = np.zeros(len(self.word), bool), self.place[self.low]
        both = _mixed(self.hash[self.low] + self.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(both)
        same = both[order[1:]] == both[order[:-1]]
        out[at[order[1:][same]]] = out[at[order[:-1][same]]] = True
        return out

    def _open(self, asked: dict[int, np.ndarray], totals: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, ...]:
        """doc, df, tf, place and length of phrases that were asked for, or may have a tf above 1; each once for a document."""
        mine = {n: asked[n] | repeated[at] for n, at in self.place.items()}
        n_of = np.concatenate([np.full(np.count_nonzero(m), n) for n, m in mine.items()])
        place, key, open_ = (np.concatenate([x[n][m] for n, m in mine.items()]) for x in (self.place, self.hash, asked))
        df = np.ones(len(key), np.int64)
        df[open_] = totals[np.unique(key[open_], return_inverse=True)[1]]
        doc = self.doc[place]
        both = _mixed(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(both)
        new = np.ones(len(key), bool)
        new[1:] = np.diff(both[order]) != 0
        tf = np.diff(np.append(np.flatnonzero(new), len(key)))
        one = order[new]
        return doc[one], df[one], tf, place[one], n_of[one]

    def _plain(self, asked: dict[int, np.ndarray], k: int, repeated: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same of the others, all with tf and df 1: of each document those of the k last first words, and what ties with the last of these."""
        plain = {n: at[~(asked[n] | repeated[at])] for n, at in self.place.items()}
        begins = np.zeros(len(self.word), bool)
        for at in plain.values():
            begins[at] = True
        at = np.flatnonzero(begins)
        edges = np.flatnonzero(np.diff(self.doc[at], prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > k:
                begins[at[a:b]] = heads[at[a:b]] >= np.partition(heads[at[a:b]], b - a - k)[b - a - k]
        place = np.concatenate([x[begins[x]] for x in plain.values()])
        n_of = np.concatenate([np.full(np.count_nonzero(begins[x]), n) for n, x in plain.items()])
        ones = np.ones(len(place), np.int64)
        return self.doc[place], ones, ones, place, n_of

    def _word_heads(self) -> np.ndarray:
        """The first eight bytes of each word and a space, as a number: in the order of phrases that begin with the word, but for ties."""
        padded, out = np.append(self.data, np.zeros(8, np.uint8)), np.zeros(len(self.start), np.uint64)
        for j in range(8):
            at = self.start + j
            out = out << np.uint64(8) | np.where(at < self.end, padded[at], np.where(at == self.end, 32, 0)).astype(np.uint64)
        return out


def _upto(group: np.ndarray, value: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
    """Places of what reaches, by its value, the `least` of the k-th largest value of its group (of the smallest one, if there are fewer)."""
    order = np.lexsort((value, group))
    ends = np.append(np.flatnonzero(np.diff(group[order])), len(order) - 1) + 1
    sizes = np.diff(ends, prepend=0)
    cut = least[order][ends - np.minimum(sizes, k)]
    return order[value[order] >= np.repeat(cut, sizes)]


def _keyed(slab: int, keys: np.ndarray, docs: np.ndarray, bits: int, parts: int) -> pa.Table:
    """Rows of an exchange: a slab's distinct keys, by part of the key space."""
    part = ((keys >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)
    edges = np.append(np.flatnonzero(np.diff(part, prepend=np.uint64(parts))), len(keys)).tolist()
    rows = [(int(part[a]), slab, _pack(np.diff(keys[a:b], prepend=np.uint64(0))), _pack(docs[a:b].astype(np.uint32))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "slab", "keys", "docs"])


def _totalled(table: pa.Table, once: bool = False) -> pa.Table:
    """A part's rows with the totals of their keys in place of them. once: one row has the total of a key, others 0."""
    keys = [np.cumsum(_unpack(b, np.uint64), dtype=np.uint64) for b in table.column("keys").to_pylist()]
    docs = [_unpack(b, np.uint32) for b in table.column("docs").to_pylist()]
    _, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    totals = np.bincount(which, np.concatenate(docs)).astype(np.int64)[which]
    if once:
        totals[np.setdiff1d(np.arange(len(totals)), first, assume_unique=True)] = 0
    ends = np.cumsum([len(x) for x in keys])[:-1]
    return pa.table([table.column("part"), table.column("slab"), pa.array([_pack(x) for x in np.split(totals, ends)], pa.binary())], ["part", "slab", "totals"])


def _answers(table: pa.Table, turn: int) -> np.ndarray:
    rows = sorted((r["part"], r["totals"]) for r in table.to_pylist() if r["turn"] == turn)
    return np.concatenate([np.zeros(0, np.int64), *(_unpack(b, np.int64) for _, b in rows)])


def _exchanged(docs: DataFrame, text: Column, low: int, high: int, finish, out, *, room: Column | None = None, once: bool = False) -> DataFrame:
    """The rows (schema `out`) that `finish`, of a slab, what it asked for and the totals, makes of each slab."""
    rows = docs.select("doc_id", (F.lit(0) if room is None else room).cast("long").alias("room"), text.cast("binary").alias("text")).where("text is not null")
    often = materialize(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "repeated-ids")
    alone = rows.select("doc_id", "room", F.array("text").alias("texts"))
    if not often.isEmpty():
        match = F.col("doc_id").eqNullSafe(F.col("again"))
        alone = alone.join(often, match, "left_anti").union(rows.join(often, match, "left_semi").groupBy("doc_id").agg(F.max("room"), F.collect_list("text").alias("texts")))
    slabs = materialize(alone.mapInArrow(_packed_slabs, _SLABS.format(kind=docs.schema["doc_id"].dataType.simpleString())), "slabs")
    words = slabs.agg(F.sum("n_words")).first()[0] or 0
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(64, max(32, int(words).bit_length() + 4))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = max(least, words // PART_KEYS)
        for batch in batches:
            for i in range(batch.num_rows):
                slab = Slab(batch.slice(i, 1).to_pylist()[0], low, low)
                yield from _keyed(slab.number, *_by_documents(slab.cells(bits), slab.doc[slab.place[low]]), bits, parts).to_batches()

    def second(own: pa.Table, answers: pa.Table) -> pa.Table:
        slab = Slab(own.to_pylist()[0], low, high)
        asked = slab.asked(bits, _answers(answers, 0))
        return _keyed(slab.number, *_by_documents(*slab.questions(asked)), 64, max(least, words * (high - low + 1) // PART_KEYS))

    def third(own: pa.Table, answers: pa.Table) -> pa.Table:
        slab = Slab(own.to_pylist()[0], low, high)
        found = finish(slab, slab.asked(bits, _answers(answers, 0)), _answers(answers, 1))
        kinds = [own.schema.field("ids").type.value_type if f.name == "doc_id" else pa.binary() if f.name == "phrase" else pa.int64() for f in out]
        columns = [pa.array(c, t) for c, t in zip(found, kinds, strict=True)]
        return pa.table([c.cast(pa.string()) if f.name == "phrase" else c for c, f in zip(columns, out, strict=True)], list(out.names))

    def counted(keyed: DataFrame, turn: int) -> DataFrame:
        last = once and turn == 1
        return materialize(keyed.groupBy("part").applyInArrow(lambda table: _totalled(table, last), _TOTALS).withColumn("turn", F.lit(turn)), "phrase-totals")

    def with_answers(answers: DataFrame, function, out) -> DataFrame:
        return slabs.groupBy("slab").cogroup(answers.groupBy("slab")).applyInArrow(function, out)

    cells = counted(slabs.mapInArrow(first, _KEYS), 0)
    totals = counted(with_answers(cells, second, _KEYS), 1)
    found = materialize(with_answers(cells.union(totals), third, out), "candidate-phrases")
    discard(often, slabs, cells, totals)
    return found


def _of_documents(docs: DataFrame) -> StructType:
    return StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("phrase", StringType()), StructField("tf", LongType()), StructField("df", LongType())])


def candidates(docs: DataFrame, text: Column, n_docs: int, *, k: int = 10, low: int = 3, high: int = 5) -> DataFrame:
    """doc_id, phrase, tf, df: of each document's runs of `low` to `high` words between ASCII spaces, at least the k of largest (1 + ln tf) *
    (ln((1 + n_docs) / (1 + df)) + 1), rounded to nine digits, equal ones by phrase, descending; df counts documents of `docs` exactly.

    Rows of one doc_id (null is one too) are one document, but no phrase leads from one text into another. Null texts have no phrases, nor have
    texts of fewer than `low` words; other columns are not looked at. A document is worked on whole, so it must fit in a task.
    """
    return _exchanged(docs, text, low, high, lambda slab, asked, totals: slab.best(k, n_docs, asked, totals), _of_documents(docs))


def shared(docs: DataFrame, text: Column, *, low: int = 3, high: int = 5) -> DataFrame:
    """phrase, df: the phrases of candidates() that more than one document has. Of the slabs that have it one names it, so no phrase is shuffled."""
    out = StructType([StructField("phrase", StringType()), StructField("df", LongType())])
    return _exchanged(docs, text, low, high, lambda slab, asked, totals: slab.named(asked, totals), out, once=True)


def filling(docs: DataFrame, text: Column, n_docs: int, room: Column, *, low: int = 2, high: int = 3, max_share: float = 0.8) -> DataFrame:
    """doc_id, phrase, tf, df: of each document's phrases with at least two documents and at most `max_share` of them, at least the best by tf *
    (ln((1 + n_docs) / (1 + df)) + 1), as candidates(), until the characters of the second and later ones reach its `room`."""
    return _exchanged(docs, text, low, high, lambda slab, asked, totals: slab.fitting(n_docs, max_share * n_docs, asked, totals), _of_documents(docs), room=room)
