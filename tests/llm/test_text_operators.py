import base64
import hashlib
import random
import re
from collections import Counter

import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphmill.llm import byte_bpe, langid, line_dedup, media, mixing, pii, token_counts

ODD = [None, "", " ", "\n\n\n", "a", "Ünï cödé 日本 🙂", "x" * 5000, "don't  stop\n\n now<|endoftext|>ok", "tab\tand nbsp line \x1c end", "aaaa" * 300, "1234 5,678.90"]


def docs(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, v in more.items():
        df = df.withColumn(k, v)
    return df


def clash(df):
    """Extra columns with the names that operators use inside."""
    for name in ("row_key", "size", "n", "key", "digest", "pos", "target", "ids", "score", "root", "h", "r", "shard", "quota", "unit", "rep"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def encoding():
    table = byte_bpe.MergeTable.load(P.path("byte_bpe_50k.tiktoken"))
    return table, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table.ranks, special_tokens={})


def test_merge_replay_equals_library_and_single_words():
    table, library = encoding()
    rng = random.Random(5)
    texts = [t for t in ODD if t] + ["".join(rng.choice("ab c'stlré1 \n.") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    slab = byte_bpe.Slab(table, regex.compile(P.PATTERN), texts)
    assert [[i for run in slab.ids(k) for i in run.tolist()] for k in range(len(texts))] == [library.encode_ordinary(t) for t in texts]
    assert table.one("hello".encode()) == library.encode_ordinary("hello")


@pytest.mark.parametrize("seed", range(60))
def test_replay_with_tables_out_of_merge_order(seed):
    rng = random.Random(seed)
    made = [b"a", b"b", b"c"]
    while len(made) < 28:
        token = rng.choice(made) + rng.choice(made)
        if len(token) < 8 and token not in made:
            made.append(token)
    ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(rng.sample(made[3:], 25))}
    table = byte_bpe.MergeTable(ranks)
    words = [bytes(rng.choices(b"abc", k=rng.randint(0, 25))) for _ in range(40)]
    flat, ends = table.replay(words)
    assert [flat[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == [table.one(w) for w in words]


def test_slab_keeps_nothing_and_takes_long_texts_in_segments(monkeypatch):
    import gc

    from glyphmill.llm import common, pretokens

    table, library = encoding()
    long = "word and  more\n" * 5000 + "x" * 3000
    assert "".join(pretokens.segments(long, 1000)) == long and len(list(pretokens.segments(long, 1000))) > 50
    monkeypatch.setattr(byte_bpe, "segments", lambda t: pretokens.segments(t, 1000))
    slab = byte_bpe.Slab(table, regex.compile(P.PATTERN), [long, None])
    assert slab.digests(0)[0] == len(library.encode_ordinary(long)) and slab.digests(0)[2] == hashlib.sha256(long.encode()).hexdigest()
    assert slab.digests(1) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
    assert gc.isenabled() and set(common.worker_state()) <= {"merge-path", "merge-table", "letters"} | {k for k in common.worker_state() if k[0] in ("library", "lengths")}


def test_encode_decode_edges(spark):
    _, library = encoding()
    rows = byte_bpe.encode_decode(clash(docs(spark, ODD)), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        t = ODD[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert byte_bpe.encode_decode(docs(spark, ["x"]).limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


@pytest.mark.parametrize("size", [0, 10, 65536])
def test_token_counts_equal_library(spark, size):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*ODD, *["the same words again and again"] * 5]
    texts += ["new letter \u0558 beside a\u0558 1", "word " * 40]
    rows = token_counts.count_tokens(clash(docs(spark, texts)), P.path("byte_bpe_50k.json"), P.PATTERN, table_size=size or 1, cache_bytes=500, slab_bytes=200).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(t.encode()), n > 512)
    assert token_counts.count_tokens(docs(spark, ["x"]).limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).collect() == []


def test_frequent_pretokens_without_a_shuffle_of_them(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "FANIN", 2)
    table = docs(spark, ["a b b c c c"] * 50).repartition(7)
    assert token_counts.frequent_pretokens(table, "text", P.PATTERN, table_size=2) == [" b", " c"]
    table = token_counts.Table([" b", " c", "longer"], [1, 2, 3])
    assert table.look_up([" c", "x", " b", "long", "", "longer"]).tolist() == [2, -1, 1, -1, -1, 3]


def test_pattern_and_library_cut_all_known_characters_alike():
    """Every character that Python's tables know, between letters, digits, marks and spaces."""
    cut = regex.compile(P.PATTERN).findall
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json")).pre_tokenizer.pre_tokenize_str
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if not token_counts._unassigned(c):
            s = f"a{c}1{c}.{c} {c}  {c}"
            assert [len(w) for w in cut(s)] == [b - a for _, (a, b) in library(s)], hex(ord(c))


def test_media_round_trip(spark):
    rows = media.media_columns(clash(docs(spark, ODD)), with_bytes=True).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        raw = (ODD[r.doc_id] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert media.from_wav(bytes(r.media)) == payload and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert r.feature.startswith("audio/wav")


def test_sniffing_needs_structure():
    import gzip
    import io
    import wave
    import zipfile

    sound = io.BytesIO()
    with wave.open(sound, "wb") as w:
        w.setparams((1, 1, 8000, 0, "NONE", ""))
        w.writeframes(b"abc")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "hello")
    gif = base64.b64decode("R0lGODlhAQABAIAAAAAAAP///yH5BAEAAAAALAAAAAABAAEAAAIBRAA7")
    assert media.sniff(sound.getvalue(), "image/png")[0] == "audio/wav"
    assert media.sniff(gif)[0] == "image/gif"
    assert media.sniff(b"RIFF but no sound", "image/png") == ("application/octet-stream", [])
    assert media.sniff(b"text", "text/plain") == ("text/plain", [])
    assert media.sniff(b"") == ("application/octet-stream", [])
    inner = b"junk PK\x03\x04 junk" + packed.getvalue() + b"GIF89a nothing" + gif + gzip.compress(b"x" * 99, mtime=0) + b"tail"
    kind, found = media.sniff(media.to_wav(inner))
    assert kind == "audio/wav" and [k for k, _, _ in found] == ["application/zip", "image/gif", "application/gzip"]
    assert [inner[a - 44 : a - 44 + n] for _, a, n in found] == [packed.getvalue(), gif, gzip.compress(b"x" * 99, mtime=0)]


def test_validators_accept_the_formats_and_reject_broken_ones():
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    jpeg = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0" + b"\xff\xc0\0\x0b\x08\0\1\0\1\1\1\x11\0" + b"\xff\xda\0\x08\1\1\0\0\x3f\0" + b"\x12\xff\0\x34\xff\xd0\x56" + b"\xff\xd9"
    pdf = b"%PDF-1.4\n1 0 obj <<>> endobj\nstartxref\n9\n%%EOF"
    flac = b"fLaC" + b"\x80\0\0\x22" + b"\0" * 34 + b"frames"
    ogg = b"OggS\0\2" + b"\0" * 20 + b"\1\3abc" + b"OggS\0\4" + b"\0" * 20 + b"\1\2de"
    riff = lambda form, *chunks: b"RIFF" + struct.pack("<I", 4 + sum(map(len, chunks))) + form + b"".join(chunks)
    webp, avi = riff(b"WEBP", b"VP8 \4\0\0\0abcd"), riff(b"AVI ", b"LIST\4\0\0\0hdrl")
    for kind, whole in {"image/png": png, "image/jpeg": jpeg, "application/pdf": pdf, "audio/flac": flac, "audio/ogg": ogg, "image/webp": webp, "video/avi": avi}.items():
        assert media.sniff(whole, "text/plain") == (kind, []), kind
        more = b"" if kind == "audio/flac" else b" and more"
        assert media.sniff(b"some text " + whole + more)[1] == [(kind, 10, len(whole))], kind
        for broken in (whole[:-1] if kind not in ("audio/flac", "audio/ogg") else whole[:20], whole[: len(whole) // 3]):
            assert media.sniff(broken, "text/plain") == ("text/plain", []), kind
    assert media.sniff(png[:40] + b"?" + png[41:])[0] == "application/octet-stream"


def test_false_magic_in_media_takes_linear_time():
    import time

    began = time.time()
    block = b"GIF89a\1\0\1\0\0\0\0!\xfe\x01"
    for junk in (b"%PDF-1.4 ", b"PK\x03\x04", b"PK\x03\x04PK\x05\x06" + b"\0" * 18, b"GIF89a", block, b"RIFF\xff\0\0\0WAVE", b"OggS", b"fLaC"):
        assert media.sniff(junk * 100_000)[0] in ("application/octet-stream", "audio/flac")
    assert time.time() - began < 30


def test_walks_over_shared_chunks_take_linear_time():
    """Each start leads over all later chunks."""
    import struct
    import time

    began = time.time()
    unit = lambda n: b"RIFF" + struct.pack("<I", n // 2) + b"WAVEabcd" + struct.pack("<I", 12)
    assert media.sniff(unit(1_000_000) * (1_000_000 // 20), "x/y") == ("x/y", [])
    flac = b"fLaC\0\0\0\x22" + b"." * 34 + b"\1\0\0\x08" + b""
    assert media.sniff(flac * (1_000_000 // len(flac)), "x/y") == ("x/y", [])
    assert time.time() - began < 30


def plain_riff(data, at):
    import struct

    if at + 12 > len(data):
        return None
    size, form = struct.unpack_from("<I4s", data, at + 4)
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(form)
    end = at + 8 + size
    if kind is None or end > len(data):
        return None
    pos, names = at + 12, set()
    while pos + 8 <= end:
        name, length = struct.unpack_from("<4sI", data, pos)
        if not all(0x20 <= c < 0x7F for c in name):
            return None
        names.add(name)
        pos += 8 + length + length % 2
    if pos not in (end, end + 1) or kind == "audio/wav" and not {b"fmt ", b"data"} <= names:
        return None
    return kind, size + 8


def plain_flac(data, at):
    pos, first = at + 4, True
    while pos + 4 <= len(data):
        head, size = data[pos], int.from_bytes(data[pos + 1 : pos + 4], "big")
        if first != (head & 0x7F == 0) or first and size != 34:
            return None
        pos, first = pos + 4 + size, False
        if head & 0x80:
            return ("audio/flac", len(data) - at) if pos <= len(data) else None
    return None


def test_validators_equal_plain_walks_on_nested_and_broken_structures():
    import struct

    rng, found = random.Random(11), Counter()
    for _ in range(3000):
        parts = []
        for _ in range(rng.randint(1, 25)):
            size = rng.choice((0, 1, 2, 4, 8, 12, 20, 37, 60, 100))
            parts.append(rng.choice((b"RIFF" + struct.pack("<I", size) + rng.choice((b"WAVE", b"WEBP", b"AVI ", b"none")), rng.choice((b"fmt ", b"data", b"abcd", b"\1bad")) + struct.pack("<I", size // 3), b"." * rng.randint(0, 3), b"fLaC\0\0\0\x22" + b"." * 34, bytes([rng.choice((0, 1, 4, 0x81)), 0, 0, size // 2]))))
        data = b"".join(parts)
        places = media.Places(data)
        for name, plain, walk in ((b"RIFF", plain_riff, media._riff), (b"fLaC", plain_flac, media._flac)):
            for m in re.finditer(name, data):
                want = plain(data, m.start())
                assert walk(data, m.start(), places) == want
                found[name, want is not None] += 1
    assert min(found.values()) > 100 and len(found) == 4


def test_personal_data_in_long_texts_takes_linear_time():
    import time

    field, began = pii.train(), time.time()
    many = "mail bob(at)example.com now and 10.0.0.1 too . " * 50_000
    (base, every), = pii.find_spans(field, [many])
    assert len(base) == 50_000 and len(every) == 100_000 and every == sorted(every)
    (base, every), = pii.find_spans(field, ["7 " * 300_000])
    assert base == every == []
    assert pii.collapsed("ab" * 100 + "12-3") == "xd-d" and time.time() - began < 120


def test_scores_do_not_depend_on_the_step():
    field = pii.train()
    words = "call (602) 555-0142 now or +1 828 555 9635 and a@b.org".split()
    assert (pii._scores(field, words, 3) == pii._scores(field, words)).all()


def test_language_accuracy_and_edges(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(table.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(table, model, keep=("doc_id", "lang")).where(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found) > 100
    rows = {r.doc_id: r for r in langid.predict(clash(docs(spark, [None, "", "123 .", "und 日本", "z" * 1_200_000])), model).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[4].lang_pred in model.languages
    none = langid.train(table.limit(0))
    assert langid.predict(docs(spark, ["word"]), none).first().lang_pred == "und"


def test_language_scores_equal_brute_force(spark):
    table = docs(spark, ["der hund", "die katze", "the dog", "the cat"], lang=F.when(F.col("doc_id") < 2, "de").otherwise("en"))
    model = langid.train(table, buckets=256)
    text = "the hund"
    total = dict(zip(model.languages, model.prior, strict=True))
    import numpy as np

    for n in model.orders:
        for i in range(len(text) - n + 1):
            b = langid._buckets(np.array([ord(c) for c in text[i : i + n]], np.uint32), n, 256)[0]
            for k, name in enumerate(model.languages):
                total[name] += model.log_probability[b, k]
    names, scores = langid.score_texts(model, [text])
    assert names[0] == max(total, key=total.get)
    assert scores[0] == pytest.approx(1 / sum(np.exp(v - max(total.values())) for v in total.values()), rel=1e-5)


def brute_lines(rows):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = [] if t is None else t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = "\n".join(lines[p : p + 3])
            if w.strip(" \t\n\r\x0b\x0c") and seen.setdefault(w, (i, p)) != (i, p):
                gone |= {p, p + 1, p + 2}
        out.append((i, t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "a\nb", "a\nb\nc", "a\nb\nc", "\n\n\n\n", "\n\n\n\n", "x\na\nb\nc\nd", "a\nb\nc\nd\na\nb\nc", *("\n".join(rng.choice("pqr") for _ in range(rng.randint(0, 9))) for _ in range(60))]
    rows = list(enumerate(texts))
    got = line_dedup.line_dedup(clash(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_lines(rows)))


def test_line_dedup_repeated_rows_and_null_ids(spark):
    same = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "q\nr\ns")]
    got = line_dedup.line_dedup(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == [(False, 1, "a\nb\nc"), (False, 1, "a\nb\nc"), (False, 2, "q\nr\ns"), (True, 0, "")]
    assert line_dedup.line_dedup(docs(spark, ["x"]).limit(0)).collect() == []


def sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_highest_quotients_equal_brute_force(spark):
    rng = random.Random(3)
    for seats in (0, 1, 7, 100, 1009):
        votes = [rng.choice([0, 1, 5, 5, 90, 1000, 12345]) for _ in range(23)]
        items = spark.createDataFrame([(1, i, v, seats) for i, v in enumerate(votes)], "g int, o int, v long, s long")
        got = {r.o: r.quota for r in mixing.highest_quotients(items, "g", "o", "v", "s").collect()}
        assert [got[i] for i in range(23)] == sainte_lague(votes, seats)


def test_mixing_bounds_targets_and_edges(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["s0", "s0", "s0", "s1", "s2", "é", None]), rng.choice([None, "", "one", "two words", "w " * 300])) for i in range(700)]
    rows += [(7, "s0", "again three words")] * 3 + [(None, "s1", "no id")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(clash(df)).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(5)).collect()))
    total, taken, target, source = sum(r.size for r in got), {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        key = (r.source_size, r.target)
        taken[key] = taken.get(key, 0) + r.taken
        target[key] = r.target
    assert sum(target.values()) == pytest.approx(total)
    for k, t in target.items():
        assert t <= 3 * k[0] + 1e-6 and abs(taken[k] - t) <= max(16, 0.01 * t)
    assert mixing.mix(df.limit(0)).collect() == []


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(t):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if name == "ip" else 0, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[name]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_patterns():
    rng = random.Random(4)
    for _ in range(5000):
        t = "".join(rng.choice("a.@-+1 20 ()b%5é4") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_field_adds_and_keeps(spark):
    texts = [*ODD, "call (602) 555-0142 now", "mail bob(at)example.com please", "é +1 (602) 555-9039 and a.b@c.org", "on 2024-01-31 we sold 1,200 of 99.95", "4111 1111 1111 1111 and 10.0.0.1 or 300.1.1.1"]
    rows = {r.doc_id: r for r in pii.find_pii(clash(docs(spark, texts))).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = pii.written(brute_pii(t or ""))
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(rows[i].spans.split(","))
    n = len(ODD)
    assert rows[n].spans == "phone:5:19" and rows[n + 1].spans == "email:5:23" and rows[n + 3].spans == ""
    assert (rows[n + 2].n_phone, rows[n + 2].n_email, rows[n + 4].n_card, rows[n + 4].n_ip) == (1, 1, 1, 1)


def test_field_learns_its_table_and_viterbi_is_best():
    import itertools

    field = pii.train()
    right = sum(list(pii.viterbi(field, [w])[0]) == g for w, g in map(pii.parse, pii.LABELLED))
    assert right >= 0.9 * len(pii.LABELLED)
    words = ["call", "602-555-0187", "now"]
    value = __import__("numpy").array(pii.features(words, field.shapes)) + field.offsets
    score = field.emit[value].sum(axis=1)
    best = max(itertools.product(range(len(pii.LABELS)), repeat=3), key=lambda y: field.start[y[0]] + sum(score[i, y[i]] for i in range(3)) + sum(field.step[y[i - 1], y[i]] for i in (1, 2)))
    assert tuple(pii.viterbi(field, [words])[0]) == best
