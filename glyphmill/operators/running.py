"""Frequencies of phrases of one length up to each document's position, without a table of phrases.

As in `distinctive`, documents are packed into slabs and phrases are counted by 64-bit hashes in exchanges between slabs and parts of the key space; only
what falls in a cell of several documents is asked for. Slabs are packed in the order of the documents here, so a hash's entry of a slab
stands for a run of positions: a part adds up the entries of earlier slabs (or of batches up to one), and a slab adds the documents of its own before each.
A hot phrase is one entry a slab, and a phrase becomes a string only where it is put out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from glyphmill.operators.distinctive import _SLABS, PART_KEYS, Slab, _by_documents, _keyed, _pack, _packed_slabs, _unpack, _upto
from glyphmill.operators.storage import discard, materialize

CLOSE = 2e-6
"""Scores are rounded to six digits; what is this close to the last place is put out too."""
MODES = ("normal", "stream", "batch")
_KEYS = "part long, slab long, keys binary, docs binary, at long, turn int"
_SUMS = "part long, slab long, at long, turn int, sums binary"


@dataclass
class Packed:
    """Documents in slabs, in order, and in how many documents each cell of the shortest phrases is."""

    slabs: DataFrame
    cells: DataFrame
    words: int
    n_docs: int
    low: int

    @property
    def bits(self) -> int:
        return min(64, max(32, self.words.bit_length() + 4))

    def discard(self) -> None:
        discard(self.slabs, self.cells)


def _parts(docs: DataFrame, words: int) -> int:
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), words // PART_KEYS)


def _with(table: pa.Table, at: int, turn: int) -> pa.Table:
    n = table.num_rows
    return table.append_column("at", pa.array([at] * n, pa.int64())).append_column("turn", pa.array([turn] * n, pa.int32()))


def _summed(table: pa.Table) -> pa.Table:
    """A part's rows with the documents that its keys' entries of the same or smaller `at` have, in place of the keys."""
    keys = [np.cumsum(_unpack(b, np.uint64), dtype=np.uint64) for b in table.column("keys").to_pylist()]
    sizes = np.array([len(x) for x in keys])
    key, docs = np.concatenate(keys), np.concatenate([_unpack(b, np.uint32) for b in table.column("docs").to_pylist()]).astype(np.int64)
    at = np.repeat(table.column("at").to_numpy(), sizes)
    order = np.lexsort((at, key))
    key, at, total = key[order], at[order], np.cumsum(docs[order])
    begins = np.ones(len(key), bool)
    begins[1:] = key[1:] != key[:-1]
    ends = np.ones(len(key), bool)
    ends[:-1] = begins[1:] | (at[1:] != at[:-1])
    last = np.flatnonzero(ends)
    upto = total[last][np.cumsum(ends) - ends]
    before = (total - docs[order])[np.flatnonzero(begins)][np.cumsum(begins) - 1]
    sums = np.empty(len(key), np.int64)
    sums[order] = upto - before
    packed = pa.array([_pack(x) for x in np.split(sums, np.cumsum(sizes)[:-1])], pa.binary())
    return pa.table([table.column(c) for c in ("part", "slab", "at", "turn")] + [packed], ["part", "slab", "at", "turn", "sums"])


def _sums(table: pa.Table, turn: int, at: int) -> np.ndarray:
    rows = sorted((r["part"], r["sums"]) for r in table.to_pylist() if r["turn"] == turn and r["at"] == at)
    return np.concatenate([np.zeros(0, np.int64), *(_unpack(b, np.int64) for _, b in rows)])


def packed(docs: DataFrame, words: Column, length: int) -> Packed:
    """The words (an array of strings without ASCII spaces) of the rows of `docs` in the order of doc_id; each row is a document."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.array(F.array_join(words, " ").cast("binary")).alias("texts"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    made = materialize(ordered.mapInArrow(_packed_slabs, _SLABS.format(kind=docs.schema["doc_id"].dataType.simpleString())), "ordered-slabs")
    sizes = made.select("slab", F.size("ids").cast("long").alias("n"))  # a row a slab
    first = F.sum("n").over(Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    total = made.agg(F.sum("n_words").alias("words"), F.sum(F.size("ids")).alias("docs")).first()
    slabs = materialize(made.join(F.broadcast(sizes.select("slab", first.alias("first"))), "slab"), "slabs")
    discard(made)
    out = Packed(slabs, slabs, total["words"] or 0, total["docs"] or 0, length)
    bits, parts = out.bits, _parts(docs, out.words)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                slab = Slab(batch.slice(i, 1).to_pylist()[0], length, length)
                yield from _with(_keyed(slab.number, *_by_documents(slab.cells(bits), slab.doc[slab.place[length]]), bits, parts), 0, 0).to_batches()

    out.cells = materialize(slabs.mapInArrow(cells, _KEYS).groupBy("part").applyInArrow(_summed, _SUMS), "cell-sums")
    return out


def frequencies(of: Packed, mode: str, k: int | None = None, batch: Callable[[np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """doc_id, seq, phrase, tf, df of each document's phrases. df counts documents: all (normal), those up to this one (stream), or those of
    batches up to this one's (batch; `batch` gives the number of each position, ascending).

    k: of each document at least those that take the k first places by (tf * ln((seq + 1) / df) rounded to six digits, phrase), both descending.
    Without k: those of df above 1."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    length, bits, n_docs, parts = of.low, of.bits, of.n_docs, _parts(of.slabs, of.words)

    def opened(own: pa.Table, answers: pa.Table) -> tuple[Slab, np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
        """The slab, its places to ask for with keys and documents, its first position, and the `at` of each of its documents."""
        row = own.to_pylist()[0]
        slab = Slab(row, length, length)
        asked = slab.asked(bits, _sums(answers, 0, 0))[length]
        seq = row["first"] + np.arange(len(slab.ids))
        at = {"normal": np.zeros(len(seq), np.int64), "stream": np.full(len(seq), slab.number)}.get(mode)
        return slab, asked, slab.hash[length], slab.doc[slab.place[length]], row["first"], batch(seq, n_docs) if at is None else at

    def ask(own: pa.Table, answers: pa.Table) -> pa.Table:
        slab, asked, keys, docs, _, at = opened(own, answers)
        keys, docs = keys[asked], docs[asked]
        tables = [_with(_keyed(slab.number, *_by_documents(keys[at[docs] == a], docs[at[docs] == a]), 64, parts), int(a), 1) for a in np.unique(at)]
        return pa.concat_tables(tables)

    def answered(own: pa.Table, answers: pa.Table) -> pa.Table:
        slab, asked, keys, docs, first, at = opened(own, answers)
        # one row for each document and phrase
        order = np.lexsort((docs, keys))
        key, doc, place, open_ = keys[order], docs[order], slab.place[length][order], asked[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        tf = np.diff(np.append(np.flatnonzero(new), len(key)))
        key, doc, place, open_ = key[new], doc[new], place[new], open_[new]
        df = np.ones(len(key), np.int64)
        for a in np.unique(at):
            mine = open_ & (at[doc] == a)
            if mine.any():
                distinct, which = np.unique(key[mine], return_inverse=True)
                df[mine] = _sums(answers, 1, int(a))[which]
                if mode == "stream":  # the sum has the whole slab: those of its documents that come later go
                    held = np.bincount(which)
                    df[mine] -= (held - 1)[which] - (np.arange(len(which)) - (np.cumsum(held) - held)[which])
        if k is None:
            kept = np.flatnonzero(df > 1)
        else:
            seq = first + doc
            score = tf * np.log((seq + 1) / df)
            kept = _upto(doc, score, k, score - CLOSE) if len(doc) else np.zeros(0, np.int64)
            # of phrases of one document, tf and df the k last ones by first word are enough, and what may begin with the last of these words
            few, pair = np.unique(tf[kept] << 40 | df[kept], return_inverse=True)
            heads = slab._word_heads()[place[kept]]
            kept = kept[_upto(doc[kept] * len(few) + pair, heads, k, heads)] if len(kept) else kept
        text = slab.data.tobytes()
        phrases = [b" ".join(text[slab.start[j] : slab.end[j]] for j in range(p, p + length)) for p in place[kept].tolist()]
        columns = [pa.array([slab.ids[d] for d in doc[kept].tolist()], own.schema.field("ids").type.value_type), pa.array(first + doc[kept], pa.int64())]
        columns += [pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(tf[kept], pa.int64()), pa.array(df[kept], pa.int64())]
        return pa.table(columns, ["doc_id", "seq", "phrase", "tf", "df"])

    def with_answers(answers: DataFrame, function, out) -> DataFrame:
        return of.slabs.groupBy("slab").cogroup(answers.groupBy("slab")).applyInArrow(function, out)

    sums = materialize(with_answers(of.cells, ask, _KEYS).groupBy("part").applyInArrow(_summed, _SUMS), "phrase-sums")
    kind = of.slabs.schema["ids"].dataType.elementType
    out = StructType([StructField("doc_id", kind), StructField("seq", LongType()), StructField("phrase", StringType()), StructField("tf", LongType()), StructField("df", LongType())])
    found = materialize(with_answers(of.cells.union(sums), answered, out), "running-phrases")
    discard(sums)
    return found


def batches(seq: np.ndarray, n: int) -> np.ndarray:
    """As tfidf.batch_number."""
    t = max(1, -(-n // 10))
    return np.where(seq < 3 * t, 0, 1 + (seq - 3 * t) // t)
