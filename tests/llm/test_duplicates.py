"""Near duplicates, lines, passages and contamination against their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from ragmill.llm import common, contamination, graph, jaccard, lines, passages

from . import brute
from .conftest import make, odd_rows, sentence


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_components(spark, documents):
    found = listed(jaccard.near_duplicates(documents), "doc_id", "n_shingles", "component_id")
    assert found == brute.components(odd_rows())


def crowd(seed=11):
    """A large group of near copies, some too far off, and short texts made of a few common lines."""
    rng = random.Random(seed)
    words = sentence(rng, 60).split()
    pool = [sentence(rng, 9) for _ in range(6)]
    rows = []
    for k in range(150):
        changed = list(words)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 6])):
            changed[rng.randrange(len(changed))] = sentence(rng, 1)
        rows.append((k, " ".join(changed)))
    rows += [(k, "\n".join(rng.sample(pool, rng.choice([1, 2, 3])))) for k in range(150, 260)]
    return rows + [(k, pool[0] + "\n" + sentence(rng, 60)) for k in range(260, 330)]


def test_components_of_a_crowd(spark):
    """More documents share tokens than the rare class allows, so combinations of frequent ones must find the links."""
    rows = crowd()
    found = listed(jaccard.near_duplicates(make(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert found == brute.components(rows)


@pytest.mark.parametrize("length", [24, 28])
def test_components_of_short_near_copies(spark, length):
    """More near copies than a single token may have documents: the rule changes when pairs are made, and heads grow too short for it."""
    rng = random.Random(length)
    words = sentence(rng, length - 1).split()
    rows = [(k, " ".join([*words, f"end{k}"])) for k in range(80)]
    found = listed(jaccard.near_duplicates(make(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert found == brute.components(rows)


def test_combinations_miss_no_pair():
    """Sets of frequent tokens alone: every pair that links shares a combination."""
    import numpy as np

    rng = np.random.default_rng(1)
    tokens = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    rule = jaccard.Rule(75, tokens)
    for n in (1, 2, 3, 5, 8, 20, 60, 150):
        for _ in range(30):
            x = rng.choice(tokens, n, replace=False)
            y = np.union1d(rng.choice(x, max(1, n - rng.integers(0, n // 7 + 1)), replace=False), rng.choice(tokens, rng.integers(0, n // 7 + 1)))
            x = np.sort(x)
            both = len(np.intersect1d(x, y))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                assert len(np.intersect1d(rule.combinations(x, len(x)), rule.combinations(y, len(y)))), (n, len(y), both)


def test_one_document_of_each_group_stays(spark, documents):
    kept = jaccard.keep_one(documents)
    assert kept.columns == documents.columns
    wanted = {c for _, _, c in brute.components(odd_rows()) if c is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(wanted) and ids.count(None) == 2


def test_passages(spark, documents):
    found = listed(passages.remove_repeats(documents), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == brute.passages(odd_rows())


@pytest.mark.parametrize("batches", [1, 5])
def test_passages_by_batches(spark, batches):
    """Any number of batches, and so of compactions, gives the same."""
    rng = random.Random(2)
    text = sentence(rng, 400).split()
    rows = [(k, " ".join(text[a : a + rng.randint(30, 90)])) for k, a in enumerate(rng.randrange(300) for _ in range(60))]
    found = listed(passages.remove_repeats(make(spark, rows), batches=batches), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == brute.passages(rows)


def test_one_id_with_several_texts(spark):
    """Each row has the result of its own text."""
    rng = random.Random(8)
    a, b = sentence(rng, 60), sentence(rng, 50)
    rows = [(1, a), (1, b), (1, a + " " + sentence(rng, 40)), (2, sentence(rng, 40) + " " + b), (None, sentence(rng, 38) + " " + a)]
    found = listed(passages.remove_repeats(make(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == brute.passages(rows)


def test_components_with_ids_spread(spark):
    """Ids over all 64 bits, also negative ones."""
    rows = [(None if i is None else (i * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63, t) for i, t in odd_rows()]
    found = listed(jaccard.near_duplicates(make(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert found == brute.components(rows)


@pytest.mark.parametrize("most", [1 << 12, 1 << 28])
def test_filters_let_all_members_through(spark, monkeypatch, most):
    import numpy as np

    monkeypatch.setattr(graph, "MOST_BITS", most)
    values = np.random.default_rng(0).integers(-(2**63), 2**63, 3000)
    found = graph.bitmap(spark.createDataFrame([(int(x),) for x in values], "x long"), "x")
    assert found.has(values).all() and found.full == (most == 1 << 12)
    assert found.full or found.has(values + 1).mean() < 0.05


def line_rows():
    rng = random.Random(4)
    pool = [sentence(rng, 12) for _ in range(12)] + ["short line", "x", ""]
    rows = [(0, None), (1, ""), (2, "\n\n"), (None, pool[0] + "\nlast of all")]
    for k in range(3, 60):
        some = []
        for line in rng.choices(pool, k=4):
            chars = list(line)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                if chars:
                    chars[rng.randrange(len(chars))] = rng.choice(["", "z", "zz", "é"])
            some.append("".join(chars))
        rows.append((k, "\n".join(some)))
    return [*rows, rows[-1]]


def test_line_dedup(spark):
    rows = line_rows()
    assert listed(lines.judge(make(spark, rows)), "doc_id", "n_removed", "text") == brute.line_dedup(rows)


def test_line_dedup_keeps_columns(spark):
    docs = make(spark, line_rows())
    found = common.recounted(lines.dedup(docs))
    assert found.columns == docs.columns
    assert listed(found, "doc_id", "text") == [(d, t) for d, _, t in brute.line_dedup(line_rows())]
    assert found.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_edit_distance_and_segments(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(400):
        a = [rng.choice("ab😀é") for _ in range(rng.randint(2 * edits + 2, 30))]
        b = list(a)
        for _ in range(rng.randint(0, edits + 2)):
            i = rng.randrange(len(b))
            b[i : i + rng.choice([0, 1, 1])] = rng.choice([[], ["a"], ["b"], ["é", "a"]])
            b = b or ["a"]
        pairs.append(("".join(a), "".join(b)))
    pairs = [sorted(p, key=len) for p in pairs if abs(len(p[0]) - len(p[1])) <= edits]
    df = spark.createDataFrame(pairs, "a string, b string")
    of_letters, apart = [lines.letter_counts(F.col(x)) for x in "ab"], F.abs(F.length("a") - F.length("b"))
    found = df.select("a", "b", lines.edit_distance_within(F.col("a"), F.col("b"), edits), *[lines.signatures(F.col(x), F.length(x), edits) for x in "ab"], lines.blocks_agree(F.col("a"), F.col("b"), edits) & lines.letters_agree(*of_letters, apart, edits), *[lines.letter_keys(x, edits) for x in of_letters]).collect()
    for a, b, near, of_a, of_b, agree, keys_a, keys_b in found:
        assert near == (brute.edit_distance(a, b) <= edits), (a, b)
        if near and len(a) > 2 * edits + 1:
            assert {of_a[k] for k in lines.indexed(edits)} & {x for x in of_b if x is not None}, (a, b)
        assert agree or not near, (a, b)
        assert not near or set(keys_a[abs(len(a) - len(b))]) & set(keys_b[abs(len(a) - len(b))]), (a, b)


@pytest.mark.parametrize(("crowd", "large"), [(16, lines.LARGE), (1, lines.LARGE), (1, 1), (8, 8)])
def test_line_dedup_of_a_crowd(spark, crowd, large):
    """Near copies of one line by degrees, and lines that a number of some or of any length sets apart: crowded signatures lose no pair."""
    rng = random.Random(3)
    words = sentence(rng, 14).split()
    rows = []
    for k in range(130):
        changed = list(words)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            i = rng.randrange(len(changed))
            changed[i] = rng.choice([sentence(rng, 1), changed[i] + rng.choice("xyz"), changed[i][1:]])
        rows.append((k, " ".join(changed)))
    rows += [(1000 + k, f"entry number {k * 7 % 90:05d} of the list that goes on and on") for k in range(90)]
    rows += [(2000 + k, f"your order {rng.randrange(10 ** rng.randint(3, 6))} é has been sent to you today, thanks") for k in range(120)]
    rng.shuffle(rows)
    found = lines.removed(make(spark, rows), common.work_folder(spark), crowd=crowd, large=large)
    wanted = [d for d, n, _ in brute.line_dedup(rows) if n]
    assert sorted(r.d for r in found.collect()) == sorted(wanted)


def test_lines_that_differ_in_a_number(spark):
    """Of 10000 lines that differ in eight digits few pairs are verified, and all that are within reach are found."""
    rng = random.Random(8)
    numbers = [f"{x:08d}" for x in rng.sample(range(10**8), 10_000)]
    rows = [(k, f"Your order number {x} has been shipped and will arrive within three days.") for k, x in enumerate(numbers)]
    folder = common.work_folder(spark)
    found = sorted(r.d for r in lines.removed(make(spark, rows), folder).collect())
    # Of one length, within two edits: all but two places agree, or one digit is left out of each.
    seen, wanted = set(), []
    for k, x in enumerate(numbers):
        ways = {(i, j, x[:i] + x[i + 1 : j] + x[j + 1 :]) for j in range(8) for i in range(j)} | {x[:i] + x[i + 1 :] for i in range(8)}
        if ways & seen:
            wanted.append(k)
        seen |= ways
    assert found == wanted and len(wanted) > 500
    assert sum(spark.read.parquet(f"{folder}/{name}").count() for name in ("near-likely", "near-again-likely")) < 10 * len(rows)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_remainders_and_beginnings(spark, edits):
    rng = random.Random(edits)
    texts = [["".join(rng.choices("ab1é😀", k=rng.randint(0, 6))) for _ in "ab"] for _ in range(500)]
    df = spark.createDataFrame(texts, "a string, b string")
    for a, b, left_a, left_b, same in df.select("a", "b", *[lines.remainders(F.col(x), edits) for x in "ab"], lines.begin_alike(F.col("a"), F.col("b"))).collect():
        assert brute.edit_distance(a, b) > edits or set(left_a) & set(left_b), (a, b)
        assert a[:same] == b[:same] and (same == min(len(a), len(b)) or a[same] != b[same]), (a, b)


def test_line_dedup_of_one_long_text(spark):
    """A text of very many lines, most of which go."""
    rows = [(0, "\n".join(f"line {k % 700} of one long text" for k in range(60_000)))]
    found = lines.judge(make(spark, rows)).first()
    assert found.n_removed == 59_300 and found.text == "\n".join(f"line {k} of one long text" for k in range(700))


ITEMS = [(0, None), (1, ""), (2, "one two"), (3, "two one"), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]


def leaks():
    rng = random.Random(6)
    rows = odd_rows(rng)
    passage = ITEMS[4][1].split()
    rows.append((50, sentence(rng, 500) + " " + " ".join(passage).upper() + " " + sentence(rng, 500)))
    rows.append((51, " ".join(passage[:9])))
    rows.append((52, " ".join(passage[:7])))
    rows.append((53, " ".join(passage[:6] + ["x"] + passage[6:])))
    items = [*ITEMS, (5, rows[35][1][:600]), (6, sentence(rng, 40))]
    return rows, items


def test_contamination(spark):
    rows, items = leaks()
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, extra string")
    found = listed(contamination.find(make(spark, rows), bench), "doc_id", "item_id", "n_shared", "n_item_shingles")
    assert found == brute.contained(rows, [x for i, x in enumerate(items) if x not in items[:i]])
    kept = contamination.drop_contaminated(make(spark, rows), bench)
    bad = {d for d, *_ in found}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in rows if d not in bad), key=str)


def test_contamination_in_blocks(spark, monkeypatch):
    rows, items = leaks()
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 300)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = listed(contamination.find(make(spark, rows), bench), "doc_id", "item_id", "n_shared", "n_item_shingles")
    assert found == brute.contained(rows, [x for i, x in enumerate(items) if x not in items[:i]])


def test_empty_tables(spark, no_documents):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = bench.where("item_id > 99")
    for found in (
        jaccard.near_duplicates(no_documents),
        jaccard.keep_one(no_documents),
        passages.remove_repeats(no_documents),
        lines.judge(no_documents),
        lines.dedup(no_documents),
        contamination.find(no_documents, bench),
        contamination.find(no_documents, none),
        contamination.drop_contaminated(no_documents, none),
    ):
        assert found.count() == 0


def test_window_hashes_tell_windows_apart():
    import numpy as np

    words = np.random.default_rng(0).integers(0, 50, 3000).astype(np.uint64)
    for size in (1, 2, 3, 5, 8, 35):
        for lane in (0, 1):
            found = common.window_hashes(words, size, lane)
            by = {}
            for i, h in enumerate(found.tolist()):
                by.setdefault(h, set()).add(tuple(words[i : i + size].tolist()))
            assert all(len(x) == 1 for x in by.values()) and len(by) == len({tuple(words[i : i + size].tolist()) for i in range(len(found))})


def test_word_hashes_agree_however_words_come():
    texts = ["a bb  ccc\n", "", None, "  x", "ccc\x0ba\x0cbb", "é é é", "y" * 2_000_000 + " a"]
    hashes, bounds = common.hashed([common.encoded(t) for t in texts])
    for k, t in enumerate(texts):
        own = hashes[bounds[k] : bounds[k + 1]].tolist()
        assert own == [int(common.word_hashes([w.encode()])[0]) for w in brute.words(t)]
