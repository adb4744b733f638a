"""Spelling variants: a self-join of the vocabulary at one edit by tries with active nodes.

Words are counted over all documents. Two words at one edit, the shorter of length m, either share the first half of m (the edit comes after
it) or the rest of it as their end. So for each length m the words of m and m + 1 letters are dealt into tries by the half that they share, and
the trie over what is left, the middles, holds the pair. A trie that is too large for one task is dealt again by halves of its middles, until
middles are a letter long, which bounds it by the alphabet; no word is left out.

In a trie, the nodes within one edit of a node (its active nodes) are those of its parent carried on along equal letters, its siblings
and its children. They are kept as pairs of nodes, a level of many tries at a time in numpy, and pairs of terminal nodes are the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import runs
from glyphmill.llm.common import byte_slices, discard, materialize, one

TRIE = ("level", "prefix", "suffix")
_LETTER = 0x110001  # beyond any letter's number
_PAIRS = "word string, n long, n_near long, best_n long, best string"


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of a-z (texts are lowered) and of U+00C0 to U+00FF, which are C3 and a byte that follows it."""
    inside = ((data >= 97) & (data <= 122)) | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    return inside


def word_counts(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2, divisor: int = 31, slab_bytes: int = 8_000_000) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lowered, with a letter deleted from those whose crc32 with the id `divisor` divides."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            for part in byte_slices(batch, 1, slab_bytes):
                data, ends = runs.lowered(part.column(1))
                found = runs.find(data, ends, _letters(data))
                leads = np.concatenate([[0], np.cumsum(data == 0xC3)])
                letters = found.end - found.start - (leads[found.end] - leads[found.start])
                found, letters = found.take(letters >= min_length), letters[letters >= min_length]
                ids = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in part.column(0).to_pylist()], np.uint32)
                crc = found.crc32(ids[found.row])
                deleted = crc % divisor == 0
                shorter = []
                for i in np.flatnonzero(deleted & (letters > min_length)).tolist():
                    word, k = found.bytes_of(i).decode(), int(crc[i]) % int(letters[i])
                    shorter.append(word[:k] + word[k + 1 :])
                counted = pc.value_counts(pa.concat_arrays([found.take(~deleted).strings(), pa.array(shorter, pa.large_string())]))
                yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.string()), counted.field("counts")], ["word", "n"])

    source = docs.select(F.col(f"`{id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _halves(level: Column, m: Column) -> list[Column]:
    """The two tries that a middle goes to, `m` letters being the shorter middle's length: by its first half, and by what follows in it."""
    h = F.floor(m / 2).cast("int")
    size = F.length("middle")
    after = F.struct(level.alias("level"), F.concat(F.col("prefix"), F.substring("middle", F.lit(1), h)).alias("prefix"), F.col("suffix").alias("suffix"), F.substring("middle", h + 1, size).alias("middle"))
    before = F.struct(level.alias("level"), F.col("prefix").alias("prefix"), F.concat(F.substring("middle", size - m + h + 1, size), F.col("suffix")).alias("suffix"), F.substring("middle", F.lit(1), size - m + h).alias("middle"))
    return [after, before]


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row (level, prefix, suffix, middle, n) as its two rows of smaller middles."""
    m = F.col("level") - F.length("prefix") - F.length("suffix")
    return rows.select(F.explode(F.array(*_halves(F.col("level"), m))).alias("x"), "n").select("x.*", "n")


def tries(words: DataFrame, *, min_length: int, cells: int) -> DataFrame:
    """Rows (level, prefix, suffix, middle, n): the words of each trie. A trie has at most about `cells` letters, or middles of a letter or two."""
    levels = F.explode(F.filter(F.array(F.length("word"), F.length("word") - 1), lambda x: x >= min_length))
    rows = words.select(levels.alias("level"), F.lit("").alias("prefix"), F.lit("").alias("suffix"), F.col("word").alias("middle"), "n")
    waiting, done = _dealt(rows), []
    m = F.col("level") - F.length("prefix") - F.length("suffix")
    while True:
        large = materialize(waiting.groupBy(*TRIE).agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") * m > cells) & (m > 1)).select(*TRIE), "large-tries")
        if large.isEmpty():
            break
        done.append(waiting.join(large, list(TRIE), "left_anti"))
        waiting = materialize(_dealt(waiting.join(large, list(TRIE), "left_semi")), "smaller-tries")
    for rows in done:
        waiting = waiting.unionByName(rows)
    return waiting


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers first[i] to first[i] + count[i] - 1: (i repeated, the numbers)."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Level:
    """The nodes of one depth of many tries: sorted by parent and letter, with their children's places, and the row that ends at each."""

    def __init__(self, keys: np.ndarray, terminal: np.ndarray):
        self.keys, self.terminal = keys, terminal
        self.parent, self.letter = keys // _LETTER, keys % _LETTER
        self.first = self.count = np.zeros(len(terminal), np.int64)

    def child(self, parent: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node of this depth below `parent` by `letter`, -1 if there is none."""
        if not len(self.keys):
            return np.full(len(parent), -1)
        key = parent * _LETTER + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


def _levels(group: np.ndarray, middles: list[str]) -> list[Level]:
    """Levels of the tries of sorted rows (group, middle)."""
    length = np.fromiter(map(len, middles), np.int64, len(middles))
    flat = np.frombuffer("".join(middles).encode("utf-32-le"), np.uint32).astype(np.int64)
    start = np.cumsum(length) - length
    node = group.copy()
    out = [Level(np.zeros(0, np.int64), np.full(int(group[-1]) + 1, -1))]
    empty = np.flatnonzero(length == 0)
    out[0].terminal[group[empty]] = empty
    for d in range(1, int(length.max(initial=0)) + 1):
        rows = np.flatnonzero(length >= d)
        keys = node[rows] * _LETTER + flat[start[rows] + d - 1]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        node[rows] = np.cumsum(new) - 1
        level = Level(keys[new], np.full(int(new.sum()), -1))
        ending = rows[length[rows] == d]
        level.terminal[node[ending]] = ending
        above = out[-1]
        above.count = np.bincount(level.parent, minlength=len(above.terminal))
        above.first = np.cumsum(above.count) - above.count
        out.append(level)
    return out


def near_pairs(group: np.ndarray, middles: list[str], shorter: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of one group whose middles differ by one edit, each once. Rows are sorted by group, then middle.

    `shorter` is each row's length of a shorter middle: pairs have one such middle at least. Where `ended` (the group's words share an end),
    a pair whose longer middle is the shorter one and a letter more is left to the trie of words that share that start.
    """
    levels = _levels(group, middles)
    nothing = np.zeros(0, np.int64)
    none = Level(nothing, nothing)
    same, more = (nothing, nothing), (nothing, nothing)
    left, right = [], []

    def carried(u: np.ndarray, v: np.ndarray, below_u: Level, below_v: Level, at: Level) -> tuple[np.ndarray, np.ndarray]:
        """Active pairs of children by equal letters."""
        of, child = _spread(at.first[u], at.count[u])
        other = below_v.child(v[of], below_u.letter[child])
        return child[other >= 0], other[other >= 0]

    for d, level in enumerate(levels):
        below, beyond = (levels[d + 1] if d + 1 < len(levels) else none), (levels[d + 2] if d + 2 < len(levels) else none)
        if d:
            above = levels[d - 1]
            u, v = carried(*same, level, level, above)
            of, sibling = _spread(above.first[level.parent], np.arange(len(level.keys)) - above.first[level.parent])  # those before it
            same = np.concatenate([u, sibling]), np.concatenate([v, of])
            u, v = carried(*more, level, below, above)
            kept = below.parent[v] != u  # these come as children
            more = np.concatenate([u[kept], below.parent]), np.concatenate([v[kept], np.arange(len(below.keys))])
        else:
            more = below.parent, np.arange(len(below.keys))
        for (u, v), at, is_more in ((same, level, False), (more, below, True)):
            a, b = level.terminal[u], at.terminal[v]
            ok = (a >= 0) & (b >= 0)
            ok[ok] &= shorter[a[ok]] == d
            if is_more:
                ok[ok] &= ~(ended[a[ok]] & (below.parent[v[ok]] == u[ok]))
            left.append(a[ok])
            right.append(b[ok])
    return np.concatenate(left), np.concatenate(right)


def _joined(table: pa.Table) -> pa.RecordBatch:
    """For the words of whole tries that have near words: how many, and the best of them."""
    import pyarrow.compute as pc

    def differs(name: str) -> np.ndarray:
        c = table.column(name)
        return pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)

    change = differs("level") | differs("prefix") | differs("suffix")
    group = np.concatenate([[0], np.cumsum(change)]).astype(np.int64)
    size = lambda name: pc.utf8_length(table.column(name)).to_numpy()
    shorter = table.column("level").to_numpy() - size("prefix") - size("suffix")
    a, b = near_pairs(group, table.column("middle").to_pylist(), shorter, size("suffix") > 0)
    word, near = np.concatenate([a, b]), np.concatenate([b, a])
    words = pc.binary_join_element_wise(*(table.column(c) for c in ("prefix", "middle", "suffix")), "")
    n = table.column("n").to_numpy()
    place = np.empty(len(n), np.int64)
    place[pc.sort_indices(words).to_numpy()] = np.arange(len(n))
    order = np.lexsort((place[near], -n[near], word))
    word, near = word[order], near[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else word
    counts = np.diff(np.append(first, len(word)))
    take = lambda i: words.take(pa.array(i)).combine_chunks().cast(pa.string())
    return pa.RecordBatch.from_arrays([take(word[first]), pa.array(n[word[first]]), pa.array(counts, pa.int64()), pa.array(n[near[first]]), take(near[first])], ["word", "n", "n_near", "best_n", "best"])


def _join_tries(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Tries come whole and one after another; some `rows` rows of them are joined at a time."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            last = [table.column(c)[-1] for c in TRIE]
            cut = size
            while cut and all(table.column(c)[cut - 1] == x for c, x in zip(TRIE, last, strict=True)):
                cut -= 1
            if cut:
                yield _joined(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), size - cut
    if size:
        yield _joined(pa.Table.from_batches(held))


def near_words(words: DataFrame, *, min_length: int = 7, cells: int = 300_000) -> DataFrame:
    """words (word, n), distinct, of `min_length` letters at least: word, n, n_near, and best and best_n, the near word of largest n.

    Words are near if one inserted, deleted or replaced letter makes one of the other; of equal n the first in code-point order is best;
    without near words these are 0 and null.
    """
    dealt = tries(words, min_length=min_length, cells=cells)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(parts, *TRIE).sortWithinPartitions(*TRIE, "middle").mapInArrow(_join_tries, _PAIRS)
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), "best"))).alias("best")
    total = found.union(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return total.select("word", "n", "n_near", F.col("best.best").alias("best"), (-F.col("best.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form), acyclic, one row a word: (word, root), the end of the chain of forms. Pointers jump to what they point to in each round,
    so a chain of k links takes about log2 k rounds, each written to the shared folder."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        jumped = materialize(at.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        discard(at)
        at = jumped.select("word", "root")
        at._written = jumped._written
        if jumped.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2, ratio: int = 10, divisor: int = 31, cells: int = 300_000) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of at least `min_length` letters that occurs `min_count` times.

    A word's form is its near word of largest n, if that is `ratio` times the word's own or more; root is the end of the chain of forms, the word
    itself without a form. Null and empty texts have no words; a null id counts as empty text in the hash that deletes letters. Repeated rows count
    each. Runs and texts of any length are taken whole. Other columns are ignored. An empty table has no words.
    """
    if min_length < 1 or ratio < 2:
        raise ValueError("min_length must be 1 at least and ratio 2 at least")
    words = materialize(word_counts(one(docs, id, text), id=id, text=text, min_length=min_length, min_count=min_count, divisor=divisor), "words")
    found = near_words(words, min_length=min_length, cells=cells)
    has = F.col("best_n") >= ratio * F.col("n")
    formed = materialize(found.select("word", F.when(has, F.col("best")).alias("form"), "n", "n_near", F.when(has, F.col("best_n")).alias("form_n")), "forms")
    discard(words)
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 by its table, which the first two lines make; then words, their deletions and the chain of forms.
ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || run)) AS bytes FROM found WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(bytes) // 2), lambda i: ('0x' || bytes[2 * i + 1 : 2 * i + 2])::BIGINT)),
                                       lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM each, crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM gaps),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
         UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS top FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN other END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n
           FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at, form AS next FROM formed
          UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
