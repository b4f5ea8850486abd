"""Text operators against the libraries, plain versions and held-out rows."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradelake.llm import decontaminate, language_id, line_dedup, piece_codec, quality, suffix_dedup, token_count

from .conftest import LINE, ODD, SHARED

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def noise(n, seed=1):
    rnd = random.Random(seed)
    pick = [lambda: rnd.randrange(32, 127), lambda: rnd.randrange(32), lambda: rnd.randrange(0x3000), lambda: rnd.choice([32, 32, 0x2581, 10, 0x1F600, 0x4E2D, 0x85, 0x1C, 0xA0])]
    return ["".join(chr(rnd.choice(pick)()) for _ in range(rnd.randrange(60))) for _ in range(n)] + ["", "▁▁▁▁▁x", " " * 37, "x" * 5000, "'s'Ve we'll", "a<|endoftext|>b"]


def test_token_counts_are_the_library_s():
    texts, lib, own = noise(1500), Tokenizer.from_file(BPE), token_count.counter(BPE)
    assert [own.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_token_count_rows(spark, odd, nothing):
    lib = Tokenizer.from_file(BPE)
    want = sorted((str(r[0]), len((r[1] or "").encode()), n := len(lib.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(odd, BPE).collect()) == want
    assert token_count.count_tokens(nothing, BPE).count() == 0


def test_pieces_are_the_library_s():
    texts, lib, own = noise(1500, 2), sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.model(PIECES)
    ids = [np.frombuffer(r, np.int32).tolist() for r in own.encode(texts)]
    assert ids == lib.encode(texts)
    assert [own.decode(i) for i in ids] == [lib.decode(i) for i in ids] == [t.replace("▁", " ") for t in texts]


def test_suffix_array_sorts_suffixes():
    rnd = np.random.default_rng(3)
    text = rnd.integers(0, 4, 300)
    order = piece_codec.suffix_array(text, 400)
    assert order.tolist() == sorted(range(300), key=lambda i: text[i:].tolist())


def test_piece_rows(spark, odd, nothing):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = piece_codec.encode_pieces(odd, PIECES, verify=True)
    assert got.columns == [*odd.columns, "piece_ids", "n_pieces", "decodes_back"]
    key = lambda r: (str(r[0]), r[1] is None, r[2])
    assert sorted([(str(r.doc_id), r.piece_ids, r.n_pieces) for r in got.collect()], key=key) == sorted([(str(r[0]), None if r[1] is None else lib.encode(r[1]), len(lib.encode(r[1] or ""))) for r in ODD], key=key)
    back = piece_codec.decode_pieces(got, PIECES)
    assert back.where("not decodes_back or decoded <> translate(text, '▁', ' ')").count() == 0
    assert piece_codec.encode_pieces(nothing, PIECES, verify=True).count() == 0


def plain_lines(rows):
    keys = [[(i, x.strip(" \t\n\x0b\x0c\r").translate(line_dedup._UPPER)) for i, x in enumerate((r[1] or "").split("\n"))] for r in rows]
    held = {}
    low = -(2**63)
    for r, ks in zip(rows, keys, strict=True):
        for _, k in ks:
            if len(k) >= 40:
                held.setdefault(k, set()).add(low if r[0] is None else r[0])
    out = []
    for r, ks in zip(rows, keys, strict=True):
        gone = {i for i, k in ks if len(k) >= 40 and len(held[k]) >= 5 and max(held[k]) != (low if r[0] is None else r[0])}
        lines = (r[1] or "").split("\n")
        out.append((str(r[0]), len(lines), len(gone), hashlib.sha256("\n".join(x for i, x in enumerate(lines) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def line_rows(docs):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digest(docs).collect())


def test_line_dedup(spark, odd, nothing):
    assert line_rows(odd) == plain_lines(ODD)
    assert line_dedup.digest(nothing).count() == 0


def test_line_dedup_of_a_line_in_most_documents(spark):
    rnd = random.Random(5)
    pool = [f"{i} {LINE}" for i in range(30)]
    rows = [(i, "\n".join([LINE] * (i % 3) + rnd.choices(pool, k=4) + [f"unique {i} {LINE}"])) for i in range(300)]
    assert line_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == plain_lines(rows)


def test_dropping_lines_keeps_columns(spark, odd):
    out = line_dedup.drop_shared_lines(odd)
    assert out.schema == odd.schema and out.count() == odd.count()
    assert {r.doc_id: r.text for r in out.collect()}[6] == LINE
    assert {r.doc_id: r.text for r in out.collect()}[5] == SHARED[10:]


def plain_repeats(rows):
    low, first, out = -(2**63), {}, []
    for r in sorted(rows, key=lambda r: low if r[0] is None else r[0]):
        b = (r[1] or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], low if r[0] is None else r[0])
    for r in rows:
        b = (r[1] or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (low if r[0] is None else r[0]):
                mark[i : i + 50] = b"\x01" * 50
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out.append((str(r[0]), len(b), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return sorted(out)


def repeat_rows(docs):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())


def test_suffix_dedup(spark, odd, nothing):
    assert repeat_rows(odd) == plain_repeats(ODD)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_dedup_of_mixed_copies(spark):
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "ab", "ba", "a", "b"]
    base = [" ".join(rnd.choices(words, k=60)) for _ in range(6)]
    rows = []
    for i in range(80):
        t = " ".join(rnd.sample(base, 2) + rnd.choices(words, k=rnd.randrange(20)))
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(t))
            t = t[:at] + rnd.choice("abxyz") + t[at + 1 :]
        rows.append((rnd.randrange(1000) * 100 + i, t))
    rows += [(999_999, "a" * 300), (999_998, "ab" * 200), (999_997, "a" * 49), (999_996, "a" * 50)]
    assert repeat_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == plain_repeats(rows)


def test_long_texts_are_anchored_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, long), (2, "z" + long[300:2100] + "q"), (3, long[1000:1049])]
    assert repeat_rows(spark.createDataFrame(rows, "doc_id long, text string")) == plain_repeats(rows)


def edit_distance(item, text):
    """Plain dynamic programme: the least distance of item to a substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        prev, row[0] = row[:], i
        for j, d in enumerate(text, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (c != d))
    return min(row)


def test_myers_distance_is_the_dynamic_programme_s():
    rnd = random.Random(2)
    for _ in range(200):
        item, text = ("".join(rnd.choices("abc", k=rnd.randrange(1, n))) for n in (70, 90))
        assert decontaminate.Pattern(item).best(text)[0] == edit_distance(item, text)


def test_leaks_with_edits(spark, nothing):
    rnd = random.Random(8)
    items = [(i, "".join(rnd.choices("abcdefghij  ", k=120)).strip()) for i in range(8)] + [(90, "Too  short"), (91, None), (92, " ")]
    docs = []
    for d in range(120):
        t = " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(40))
        if d % 3 == 0:
            leak = list(items[d % 8][1])
            for _ in range(d % 10):
                leak[rnd.randrange(len(leak))] = rnd.choice(["", "z", "zz"])
            t = t[:50] + "\n " + "".join(leak).upper() + t[50:]
        docs.append((d, t))
    docs += [(500, None), (501, ""), (502, "far too short, it is"), (503, "not too shorter"), (504, "TOO\nSHORT"), (505, "x" * 3_000_000 + " " + items[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda s: " ".join((s or "").lower().split())
    want = {(d, i) for d, t in docs[:-1] for i, x in items if x and len(norm(x)) >= 20 and edit_distance(norm(x), norm(t)) <= decontaminate.edit_budget(len(norm(x)))}
    want |= {(502, 90), (504, 90), (505, 3)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, bench).collect()}
    assert got == want and len(want) > 15
    assert {r.doc_id for r in decontaminate.drop_leaks(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.find_leaks(nothing, bench).count() == 0
    assert decontaminate.find_leaks(frame, bench.where("false")).count() == 0


def test_leaks_do_not_change_with_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, SHARED), (2, LINE), (3, SHARED + LINE)], ["doc_id", "text"])
    bench = spark.createDataFrame([(1, SHARED), (2, LINE), (3, SHARED)], ["item_id", "text"])
    want = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == want and len(want) == 6
    more = docs.union(spark.createDataFrame([(4, "clean"), (5, None)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(more, bench).collect()) == [4, 5]


def plain_ppm(texts, least):
    """Code length in bits of a byte after a context, by escape method C with exclusion, from plain counts."""
    counts = {}
    for t in texts:
        raw = bytes(language_id.ORDER) + t.lower().encode()
        for i in range(language_id.ORDER, len(raw)):
            for k in range(language_id.ORDER + 1):
                own = counts.setdefault(raw[i - k : i], {})
                own[raw[i]] = own.get(raw[i], 0) + 1
    counts = {c: own for c, own in counts.items() if sum(own.values()) >= least}

    def chances(context):
        if context not in counts:
            return chances(context[1:]) if context else [1 / 256] * 256
        own = counts[context]
        n, d = sum(own.values()), len(own)
        shorter = chances(context[1:]) if context else [1 / 256] * 256
        rest = sum(p for b, p in enumerate(shorter) if b not in own)
        return [own[b] / (n + d) if b in own else d / (n + d) * shorter[b] / rest for b in range(256)]

    return lambda context, byte: -math.log2(chances(context)[byte])


@pytest.mark.parametrize("least", [1, 4])
def test_code_lengths_are_those_of_a_plain_model(spark, odd, monkeypatch, least):
    monkeypatch.setattr(language_id, "MIN_COUNT", least)
    trees = language_id.train(odd.select("text", "lang"))
    langs = [x for t in trees for x in t.languages]
    assert langs == ["de", "en", "fr"]
    text = "the quick lazy fox \u00e9 LINE vorher zz".lower().encode()
    data = np.concatenate([np.zeros(language_id.ORDER, np.uint8), np.frombuffer(text, np.uint8)])
    got = np.concatenate([language_id.code_lengths(t, data, np.array([len(data)]))[0] for t in trees])
    raw = data.tobytes()
    for lang, bits in zip(langs, got, strict=True):
        code = plain_ppm([r[1] for r in ODD if r[1] and r[2] == lang], least)
        assert bits == pytest.approx(sum(code(raw[i - language_id.ORDER : i], raw[i]) for i in range(language_id.ORDER, len(raw))), rel=1e-9)


def test_languages_in_several_trees(spark, odd, monkeypatch):
    one = sorted(map(str, language_id.predict(odd, language_id.train(odd.select("text", "lang"))).collect()))
    monkeypatch.setattr(language_id, "ENTRIES", 10)
    trees = language_id.train(odd.select("text", "lang"))
    assert len(trees) == 3 and sorted(map(str, language_id.predict(odd, trees).collect())) == one


def test_languages(spark, odd, nothing):
    words = {"en": "the and of with from house water", "de": "der und von mit aus haus wasser", "fr": "le et de avec depuis maison eau"}
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choices(words[x].split(), k=30)), x) for i, x in enumerate(["en", "de", "fr"] * 30)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang"])
    trees = language_id.train(docs.where("doc_id < 45"))
    got = {r.doc_id: r for r in language_id.predict(docs, trees).collect()}
    assert all(got[i].lang_pred == x and 0.9 < got[i].score <= 1 for i, _, x in rows if i >= 45)
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, trees).collect()}
    assert out[7] == out[8] == out[9] == ("und", 0.0) and len(out) == len({r[0] for r in ODD})
    assert language_id.train(nothing.select("text", "lang")) == []
    assert {r.lang_pred for r in language_id.predict(odd, []).collect()} == {"und"}
    assert language_id.predict(nothing, trees).count() == 0


def test_a_long_text_is_scored_whole(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abc abd " * 400), (2, "xyz")], ["doc_id", "text"])
    trees = language_id.train(docs.select("text", F.lit("q").alias("lang")))
    column = docs.select("text").toArrow()["text"].combine_chunks()
    whole = [language_id.code_lengths(trees[0], d, e) for _, d, e in language_id._pieces(column)]
    monkeypatch.setattr(language_id, "PIECE", 100)
    parts = [language_id.code_lengths(trees[0], d, e) for _, d, e in language_id._pieces(column)]
    assert sum(x.sum() for x in parts) == pytest.approx(sum(x.sum() for x in whole), rel=1e-6) and len(parts) > 20


def test_quality(spark, odd, nothing):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice("alpha beta gamma delta house water stone river".split()) + rnd.choice("abcdefgh") for _ in range(40)]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[3] = "nasty" + rnd.choice("abcdefgh")
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 200))
        if i < 300:
            labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (10**9, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    heads = quality.train(docs, marks)
    got = {r.doc_id: r.kept for r in quality.score(docs, heads).collect()}
    assert np.mean([got[i] == (i % 5 != 0 and i % 7 != 0) for i in range(300, 600)]) > 0.97
    assert {r.doc_id: r.kept for r in quality.classify(docs, marks).collect()} == got
    kept = quality.keep_good(docs, marks)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    assert quality.score(odd, heads).count() == len(ODD) and quality.score(nothing, heads).count() == 0
    empty = quality.train(docs, marks.where("false"))
    assert empty == {"low": None, "toxic": None} and {r.kept for r in quality.score(odd, empty).collect()} == {True}
    assert quality.score(docs.select("doc_id", "text"), heads).count() == 600
