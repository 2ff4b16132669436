"""Tokens, quality, toxicity, personal data and licences against libraries, plain versions and held-out labels."""

import datetime
import hashlib
import random
import re
import struct
import time
import unicodedata

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ragmill.llm import bpe_trie, licences, pii, quality, token_counts, toxicity

from . import brute
from .conftest import make, odd_rows, sentence

FOLDER = "/root/testdata/sf0.001"
ODD = [
    "<|endoftext|> hi <|endoftext|>x <|startoftext|>", "it's I'LL we'RE", "ΣΑΣ ΑΣ", "İstanbul", "ﬁ 12 ٣ ...!!!", "\x1c\x1d a\x85b​c", "é é",
    "👍🏽 日本語テキスト", "  lead", "trail  ", "a　b", "a" * 3000, "\n\n\n \t x", "aaaa aaa aa a", "-- -- ----", "  x", "1234567890 3.14",
]


def texts(spark):
    return [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()] + ODD


def library(name, rows):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t, [e.ids for e in t.encode_batch(rows, add_special_tokens=False)]


def test_token_counts_equal_the_library(spark):
    rows = texts(spark)
    _, wanted = library("byte_bpe_50k.json", rows)
    found = token_counts.count_tokens(make(spark, list(enumerate(rows))), public_tokenizers.path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in found] == [(len(t.encode()), len(w), len(w) > 512) for t, w in zip(rows, wanted, strict=True)]


def test_bpe_equals_the_library_and_round_trips(spark):
    rows = texts(spark)
    t, wanted = library("word_bpe_49k.json", rows)
    path = public_tokenizers.path("word_bpe_49k.json")
    found = bpe_trie.encode_decode(make(spark, list(enumerate(rows))), path, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).orderBy("doc_id").collect()
    codec = bpe_trie.Codec(path)
    for text, ids, row in zip(rows, wanted, found, strict=True):
        decoded = t.decode(ids, skip_special_tokens=False)
        data = struct.pack(f"<{len(ids)}I", *ids)
        assert (row.n_tokens, bytes(row.ids), row.decoded) == (len(ids), data, decoded), text[:50]
        assert (row.ids_sha256, row.decoded_sha256) == (hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert codec.decode(data) == decoded


def test_every_character_splits_as_in_the_library():
    """Each code point but those of empty planes and private use, between letters and after a digit, for both vocabularies."""
    chars = [chr(c) for c in [*range(0xD800), *range(0xF900, 0x34000), *range(0xE0000, 0xE0200)]]
    texts = [" ".join(f"a{c}b 1{c}" for c in chars[k : k + 400]) for k in range(0, len(chars), 400)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    wanted = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert token_counts.Counter(path).count(texts) == [len(x.ids) for x in wanted]
    path = public_tokenizers.path("word_bpe_49k.json")
    wanted = Tokenizer.from_file(path)
    wanted.no_truncation()
    wanted.no_padding()
    for text, x, (ids, _) in zip(texts, wanted.encode_batch(texts, add_special_tokens=False), bpe_trie.Codec(path).encode(texts), strict=True):
        assert ids == struct.pack(f"<{len(x.ids)}I", *x.ids), [hex(ord(c)) for c in text if ord(c) > 127][:8]


def test_every_pair_of_marks_is_ordered_as_in_the_library():
    """All pairs of combining marks after a letter, and all compositions from their parts, with a later mark between them too."""
    marks = [c for c in map(chr, range(0x110000)) if unicodedata.combining(c)]
    normalizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).normalizer
    for a in marks:
        text = " ".join(f"a{a}{b}" for b in marks)
        assert bpe_trie.composed(text).lower() == normalizer.normalize_str(text), hex(ord(a))
    parts = [d for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if (d := unicodedata.normalize("NFD", c)) != c and not c.isspace()]
    text = " ".join([*parts, *("\u1abf".join(d) for d in parts), *(d[::-1] for d in parts)])
    assert bpe_trie.composed(text).replace("Σ", "σ").lower() == normalizer.normalize_str(text)


def test_odd_strings_of_marks_equal_the_library():
    alphabet = [*"ae1 Σ", *"\u0301\u0323\u1abf\u1dfa\u0dca\u1ac5\u08d3\u05b7\u0345\u0338\u1100\u1161\u11a8\u0897", "\U00011935", "\U00011930", "\U00011938"]
    draw = random.Random(5)
    rows = ["".join(draw.choices(alphabet, k=draw.randint(1, 9))) for _ in range(9000)]
    _, wanted = library("word_bpe_49k.json", rows)
    found = bpe_trie.Codec(public_tokenizers.path("word_bpe_49k.json")).encode(rows)
    assert [ids for ids, _ in found] == [struct.pack(f"<{len(w)}I", *w) for w in wanted]


def test_trie_states_equal_plain_bpe():
    codec = bpe_trie.Codec(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(8)
    words = {"".join(rng.choice("abcdethion") for _ in range(rng.randint(1, 14))) for _ in range(3000)}
    for word, tokens in codec.encoder.encode(words).items():
        assert tokens == codec.encoder.merged([*word[:-1], word[-1] + bpe_trie.END])


def test_cases_without_text(spark, documents, no_documents):
    path, words = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    none = {r.doc_id: r for r in token_counts.count_tokens(documents, path).where("doc_id < 3").collect()}
    assert (none[0].n_bytes, none[0].n_tokens, none[1].n_tokens) == (0, 0, 0)
    empty = bpe_trie.encode_decode(documents, words).where("doc_id = 0").first()
    assert (empty.n_tokens, bytes(empty.ids), empty.decoded) == (0, b"", "")
    for df in (token_counts.count_tokens(no_documents, path), bpe_trie.encode_decode(no_documents, words), quality.judge(no_documents), quality.keep_good(no_documents), pii.pseudonymise(no_documents, b"key"), licences.scan(no_documents)):
        assert df.count() == 0


def junk_rows():
    rng = random.Random(3)
    rows = odd_rows(rng)
    for k in range(100, 160):
        rows.append((k, "\n".join(sentence(rng, 15).capitalize() + "." for _ in range(4))))
    for k in range(160, 175):
        rows.append((k, "\n".join(" ".join(w + "***" for w in sentence(rng, 15).split()) for _ in range(4))))
    for k in range(175, 190):
        rows.append((k, "\n".join(" ".join(w.upper() + "!!" for w in sentence(rng, 15).split()) for _ in range(4))))
    return rows


def test_quality_measures(spark):
    rows = [*junk_rows(), (200, "a b a b a b a b a b a b"), (201, "x\nx\n \n\nx #*$%&|<>")]
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = sorted(((r.doc_id, *(r[c] for c in columns), r.base_failed) for r in quality.judge(make(spark, rows)).collect()), key=str)
    wanted = []
    for doc, text in rows:
        m = brute.measures(text)
        wanted.append((doc, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert found == sorted(wanted, key=str)


def test_quality_verdicts(spark):
    docs = make(spark, junk_rows())
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert all(kept[k] for k in range(100, 160)) and not any(kept[k] for k in range(160, 190))
    assert not kept[0] and not kept[1]
    stay = quality.keep_good(docs)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect() if r.doc_id is not None) == sorted(k for k, v in kept.items() if v and k is not None)


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality.judge(spark.read.parquet(f"{folder}/documents.parquet")).where("NOT base_failed").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in found if r.quality == 1], [r.kept for r in found if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_expectation_maximisation_finds_accuracies():
    """Votes drawn from known accuracies: the estimates come near them, whatever order the counts come in."""
    rng = random.Random(1)
    right = [0.95, 0.9, 0.8, 0.9, 0.85] + [0.7] * (len(quality.RULES) - 5)
    counts = {}
    for _ in range(4000):
        good = rng.random() < 0.8
        code = 0
        for p in right:
            code = code * 3 + (quality.ABSTAIN if rng.random() < 0.2 else quality.GOOD if (rng.random() < p) == good else quality.BAD)
        counts[code] = counts.get(code, 0) + 1
    model = quality.fit(counts)
    assert abs(model.good - 0.8) < 0.05 and all(abs(model.accuracy(r) - p) < 0.06 for r, p in enumerate(right))
    assert quality.fit(dict(reversed(list(counts.items())))) == model


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = toxicity.score(docs, labels).where("held_out").join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    right = {y: [r.predicted == r.toxic for r in found if r.toxic == y] for y in (0, 1)}
    # Measured: 719 of 728 clean and 87 of 97 toxic; with 8000 labelled rows of the larger tables no error is left.
    assert sum(right[0]) >= 0.98 * len(right[0]) and sum(right[1]) >= 0.85 * len(right[1])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_toxicity_cases(spark, documents):
    words = [(100 + k, f"fine text number {'bad' if k % 2 else 'good'} here") for k in range(80)]
    docs = documents.unionByName(make(spark, words))
    labels = spark.createDataFrame([(100 + k, k % 2, "e") for k in range(80)] + [(999, 1, "e"), (None, 1, "e"), (100, None, "e")], "doc_id long, toxic int, text string")
    found = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(toxicity.score(docs, labels).collect()) == docs.count()
    assert found[0].score == found[1].score == found[2].score and found[3].score == found[4].score
    assert all(found[100 + k].predicted == k % 2 for k in range(80))
    import zlib

    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in found if i is not None) and found[None].held_out is None
    none = toxicity.score(docs, labels.where("toxic = 0")).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in none)


def test_language_does_not_come_from_columns(spark):
    rows = [(1, "the cat and the dog"), (2, "the cat and the dog")]
    docs = make(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 1, "fr").otherwise("en"))
    words = [(100 + k, f"text {'bad' if k % 2 else 'good'}") for k in range(40)]
    labels = spark.createDataFrame([(100 + k, k % 2) for k in range(40)], "doc_id long, toxic int")
    found = {r.doc_id: r.score for r in toxicity.score(docs.unionByName(make(spark, words)), labels).collect()}
    assert found[1] == found[2]


PII = "mail bob.20@mail4.example.com or 4111 1111 1111 1111, DE89 3704 0044 0532 0130 00, 123-45-6789, 2020-02-29, 31.12.1999, +1 (811) 555-0199, 10.0.0.1; key ff60d8d5b1b4efef3e225a79bff96594"
LEFT = "4111111111111112 30.02.2001 2023-02-29 666-12-1234 300.1.1.1 DE88370400440532013000 version 3.0. 2.0 a@b 12 1234567890123"


@pytest.mark.parametrize("size", [2, 3, 7, 10, 97, 1000])
def test_permutations_have_no_fixed_point(size):
    p = pii.Permutation(b"key", "x", size)
    image = [p(i) for i in range(size)]
    assert sorted(image) == list(range(size)) and all(a != i for i, a in enumerate(image)) and [p.inverse(a) for a in image] == list(range(size))


def test_permutations_depend_on_the_key():
    a, b = pii.Permutation(b"1", "x", 10**6), pii.Permutation(b"2", "x", 10**6)
    assert [a(i) for i in range(20)] != [b(i) for i in range(20)]


def test_pseudonyms_keep_formats(spark):
    make_text = pii.Pseudonyms(b"key").replace
    fresh, n = make_text(PII)
    assert n == 9 and make_text(LEFT) == (LEFT, 0)
    shape = lambda t: re.sub("[0-9]", "9", re.sub("[a-f](?=[0-9a-f]{3,})|(?<=[0-9a-f]{3})[a-f]", "9", t))
    values = [m for m in re.findall(r"\S*\d\S*", PII)]
    assert not any(v in fresh.split() for v in values if len(v) > 6 and not v.startswith("(8"))
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", fresh)[0].replace(" ", "")
    assert pii.luhn_digit(card[:-1]) == int(card[-1])
    iban = re.search(r"DE\d\d(?: \d{4}){4} \d\d", fresh)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    datetime.date.fromisoformat(re.search(r"\d{4}-\d\d-\d\d(?=, \d\d\.)", fresh)[0])
    datetime.datetime.strptime(re.search(r"\d\d\.\d\d\.\d{4}", fresh)[0], "%d.%m.%Y")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", re.search(r"\+1 [()\d -]+\d{4}", fresh)[0]) and "@mail4.example.com" in fresh
    assert shape(PII)[:5] == shape(fresh)[:5]


def test_equal_values_stay_linked(spark):
    rows = [(1, "card 4111111111111111 x"), (2, "y 4111111111111111"), (3, "4111 1111 1111 1111"), (4, None), (5, ""), (5, "")]
    found = {r.doc_id: (r.text, r.n_values) for r in pii.pseudonymise(make(spark, rows), b"key").collect()}
    digits = [re.sub(r"\D", "", found[k][0]) for k in (1, 2, 3)]
    assert len(set(digits)) == 1 and digits[0] != "4" + "1" * 15 and found[4] == (None, 0) and found[5] == ("", 0)


def plain_scan(text, threshold=licences.THRESHOLD):
    """Every template's best stretch of lines, by trying all stretches."""
    scanner = licences.Scanner(licences.TEMPLATES, threshold)
    lines = [licences.normalised(x) for x in licences._COPYRIGHT.sub("", text).split("\n")]
    best = {}
    for a in range(len(lines)):
        for b in range(a, len(lines)):
            held = licences.bigrams([w for line in lines[a : b + 1] for w in line])
            for name, template in scanner.templates.items():
                score = licences.dice(held, template)
                if score >= threshold:
                    best[name] = max(best.get(name, 0), score)
    return best


def test_licence_scan():
    rng = random.Random(2)
    scan = licences.Scanner(licences.TEMPLATES).scan
    for name, text in licences.TEMPLATES.items():
        for wrapped in (text, sentence(rng, 30) + "\n" + text + "\n" + sentence(rng, 10), "Copyright 2020 X\n" + text.upper().replace(",", ";")):
            found = scan(wrapped)
            assert found and found[0][0] == name and found[0][1] == 1.0, name
            assert all(best <= plain_scan(wrapped)[n] + 1e-9 for n, best, _, _ in found)
    assert scan("") == [] and scan(sentence(rng, 500)) == []
    words = licences.TEMPLATES["MIT"].split()
    changed = " ".join(w if i % 20 else "zzz" for i, w in enumerate(words))
    assert scan(changed)[0][0] == "MIT" and abs(scan(changed)[0][1] - plain_scan(changed)["MIT"]) < 1e-9
    assert scan(" ".join(words[: len(words) // 3])) == []


def test_licence_scan_of_mixed_lines():
    """Of texts whose lines repeat, mix and break off, each template found has a stretch as like as the likest of all tried."""
    rng = random.Random(6)
    scan = licences.Scanner(licences.TEMPLATES).scan
    pool = [x for name in ("MIT", "GPL-2.0", "MPL-2.0") for x in licences.TEMPLATES[name].split("\n")]
    for _ in range(60):
        name = rng.choice(["MIT", "GPL-2.0", "MPL-2.0"])
        lines = [x for x in licences.TEMPLATES[name].split("\n") for _ in range(rng.choice([1, 1, 2, 3]))]
        for _ in range(rng.randrange(6)):
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", rng.choice(pool), sentence(rng, 4)]))
        if rng.random() < 0.4:
            del lines[rng.randrange(len(lines))]
        text = "\n".join(lines)
        wanted, found = plain_scan(text), scan(text)
        assert bool(found) >= bool(wanted) and all(wanted.get(x[0], 0) <= x[1] + 1e-9 for x in found), text


def test_licence_scan_of_many_equal_lines():
    """Time goes with the text, also where its lines say the same over and over."""
    began = time.process_time()
    for text in ("\n".join(["Licensed under CC BY 4.0."] * 20_000), "\n".join(licences.TEMPLATES["MIT"].split("\n") * 1000), "\n" * 50_000 + licences.TEMPLATES["MIT"] + "\n" * 50_000):
        assert max(x[1] for x in licences.Scanner(licences.TEMPLATES).scan(text)) == 1.0
    assert time.process_time() - began < 60



@pytest.mark.parametrize("name", ["MIT", "GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0"])
def test_licences_inside_lines(name):
    """A licence comes out as itself and not as a liker of its kin, also where it shares its lines with prose."""
    rng = random.Random(3)
    words = licences.TEMPLATES[name].split()
    scan = licences.Scanner(licences.TEMPLATES).scan
    for before, after in ((sentence(rng, 400), sentence(rng, 400)), (sentence(rng, 90), ""), ("Copyright 2020 X", ""), ("Copyright 2020 X " + sentence(rng, 200), "")):
        flat = f"{before} {' '.join(words)} {after}"
        found = scan("first\n" + flat)
        assert [(n, a, b) for n, _, a, b in found] == [(name, 1, 1)], (name, found)
        half = len(before) + len(words)
        split = flat[:half] + flat[half:].replace(" ", "\n", 1)
        assert [n for n, *_ in scan(split)] == [name], (name, scan(split))


def test_runs_miss_nothing():
    """The best run of words is that of all runs."""
    rng = random.Random(8)
    scanner = licences.Scanner({"t": "a b c d e f a c e b"}, 0.6)
    for _ in range(300):
        words = [rng.choice("abcdefxyz") for _ in range(rng.randint(2, 30))]
        grams = [(x, k, k + 1) for k, x in enumerate(zip(words, words[1:], strict=False))]
        scores = [licences.dice(licences.bigrams(words[i:j]), scanner.templates["t"]) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
        found = scanner.best_run(grams, "t")
        assert (found[0] if found else 0) == pytest.approx(max(scores) if max(scores) >= 0.6 else 0)


def test_licence_rows(spark):
    rows = [(1, None), (2, ""), (3, "a\nLicensed under the Apache License, Version 2.0.\nb"), (3, "a\nLicensed under the Apache License, Version 2.0.\nb"), (4, "no licence")]
    found = [tuple(r) for r in licences.scan(make(spark, rows)).collect()]
    assert found == [(3, "Apache-2.0 notice", 1.0, 1, 1)] * 2
