"""Lines, captions, figures and packing against plain versions over random pages."""

import random
import re
import time

import pytest

from ragmill.functions import labels
from ragmill.operators import chunking, layout

WIDTH, HEIGHT = 600.0, 800.0
WORDS = "document_id long, page_number int, text string, x0 double, top double, x1 double, bottom double"
SHAPES = "document_id long, page_number int, kind string, x0 double, top double, x1 double, bottom double"


def lines_of(words):
    """(text, x0, top, x1, bottom) of lines from words (text, x0, top, x1, bottom)."""
    lines, least = [], 0.0
    for w in sorted((w for w in words if w[0].strip()), key=lambda w: (round(w[2], 1), w[1], w[2], w[0])):
        if not lines or w[2] - least > 2.5 or least - w[2] > 2.5:
            lines.append([])
            least = w[2]
        least = min(least, w[2])
        lines[-1].append(w)
    side = lambda line, i: (min if i in (1, 2) else max)(w[i] for w in line)
    return [(" ".join(w[0] for w in sorted(line, key=lambda w: w[1])).strip(), *(side(line, i) for i in range(1, 5))) for line in lines]


def label_in(text, pattern):
    m = re.search(pattern, text)
    return m and "FIGURE " + re.sub(r"(?i)^fig(?:ure)?\.?\s*", "", m[1]).upper()


def captions_of(lines):
    groups, before = [], None
    for line in lines:
        label = label_in(line[0], labels.CAPTION)
        if label or before is None or line[2] - before[4] > 8:
            groups.append((label, []))
        groups[-1][1].append(line)
        before = line
    out = []
    for label, own in groups:
        if label:
            out.append((label, " ".join(x[0] for x in own), min(x[2] for x in own), max(x[4] for x in own)))
    return out


def within(words, x0, top, x1, bottom):
    return " ".join(x[0] for x in lines_of([w for w in words if w[1] >= x0 and w[2] >= top and w[3] <= x1 and w[4] <= bottom]))


def below_a_table_label(words, x0, top, x1):
    return top > 0 and bool(re.search(labels.TABLE, within(words, max(0, x0 - 10), max(0, top - 42), min(WIDTH, x1 + 10), max(0.1, top - 10.5))))


def box_above(c_top, bound, shapes):
    low = max(min(HEIGHT - 1, c_top - 2), bound + 1)
    high = max(bound, low - min(HEIGHT * 0.55, 360))
    inside = [s for s in shapes if s[4] > high and s[2] < low]
    if low <= high or not inside:
        return None
    x0, top = max(0, min(s[1] for s in inside) - 6), max(high, min(s[2] for s in inside) - 6)
    x1, bottom = min(WIDTH, max(s[3] for s in inside) + 6), min(low, max(s[4] for s in inside) + 6)
    top = max(high, bottom - 40) if bottom - top < 40 else top
    return (x0, top, x1, bottom) if bottom - top >= 40 and x1 - x0 >= 20 else None


def figures_of(pages):
    """pages: [(number, words, shapes)] of one document in order."""
    taken, out = set(), []
    for number, words, shapes in pages:
        bound, found = 0.0, 0
        for label, text, top, bottom in captions_of(lines_of(words)):
            if label in taken:
                continue
            box = box_above(top, bound, shapes)
            bound = max(bound, bottom + 2)
            if box and not below_a_table_label(words, *box[:3]):
                taken.add(label)
                out.append((number, label, text, *box))
                found += 1
        if not found:
            for s in sorted({s for s in shapes if s[0] == "image"}, key=lambda s: (s[2], s[1])):
                text = within(words, s[1], min(HEIGHT, s[4]), s[3], min(HEIGHT, s[4] + 90))
                label = label_in(text, labels.CAPTION_ANYWHERE)
                if label and label not in taken and not below_a_table_label(words, *s[1:4]):
                    taken.add(label)
                    out.append((number, label, text, *s[1:]))
    return out


def random_page(rng):
    words, shapes = [], []
    put = lambda text, x, top: words.append((text, float(x), float(top), x + 7.0 * len(text), top + 10.0))
    for top in range(40, 780, rng.choice([60, 90, 140])):
        kind = rng.random()
        if kind < 0.45:
            put(rng.choice(["Figure", "Fig.", "FIG"]), 60, top + rng.choice([0, 0.5, 1.5]))
            put(f"{rng.randint(1, 5)}{rng.choice(['—', ' —', '—A', ''])}", 120, top)
            put("caption", 190, top + 0.5)
            if rng.random() < 0.5:
                put("goes on", 60, top + 14)
        elif kind < 0.6:
            put("Table", 90, top)
            put(f"{rng.randint(1, 9)}—Rates", 140, top)
        else:
            put("text", 60, top + rng.choice([0, 2.0, 2.5, 3.0]))
            put("more", 200, top)
            put(" ", 300, top)
    for _ in range(rng.randint(0, 5)):
        x, y = rng.randrange(0, 400, 20), rng.randrange(0, 700, 20)
        shapes.append((rng.choice(["rect", "image", "line"]), float(x), float(y), float(x + rng.choice([10, 100, 300])), float(y + rng.choice([5, 60, 120]))))
    return words, shapes


def test_figures_equal_a_plain_version(spark):
    rng = random.Random(12)
    book = {d: [(p, *random_page(rng)) for p in range(1, 5)] for d in range(60)}
    words = spark.createDataFrame([(d, p, *w) for d, pages in book.items() for p, ws, _ in pages for w in ws], WORDS)
    shapes = spark.createDataFrame([(d, p, *s) for d, pages in book.items() for p, _, ss in pages for s in ss], SHAPES)
    pages = spark.createDataFrame([(d, p, WIDTH, HEIGHT) for d in book for p in range(1, 5)], "document_id long, page_number int, width double, height double")
    found = sorted(map(tuple, layout.extract_figures(pages, words, shapes).collect()))
    wanted = sorted((d, *f) for d, own in book.items() for f in figures_of(own))
    assert found == wanted and len(wanted) > 60
    # The cases that make the fold necessary occur: a repeated label that is passed over, an image's label, a table.
    passed = sum(len(captions_of(lines_of(ws))) for own in book.values() for _, ws, _ in own) - len(wanted)
    assert passed > 20
    lines = sorted(map(tuple, layout.word_lines(words).collect()))
    assert lines == sorted((d, p, k, *x) for d, own in book.items() for p, ws, _ in own for k, x in enumerate(lines_of(ws)))


def test_lines_and_figures_run_in_the_jvm(spark):
    words = spark.createDataFrame([(1, 1, "a", 1.0, 1.0, 2.0, 2.0)], WORDS)
    shapes = spark.createDataFrame([(1, 1, "image", 1.0, 1.0, 2.0, 2.0)], SHAPES)
    pages = spark.createDataFrame([(1, 1, WIDTH, HEIGHT)], "document_id long, page_number int, width double, height double")
    for made in (layout.word_lines(words), layout.extract_figures(pages, words, shapes)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def packed(paragraphs, most):
    """(start page, end page, text) of chunks of paragraphs (page, text)."""
    out, size, page = [], None, None
    for page, text in paragraphs:
        if size is not None and size + 1 + len(text) <= most:
            out[-1][1] = page
            out[-1][2].append(text)
            size += 1 + len(text)
        else:
            if out:
                out[-1][1] = page
            out.append([page, page, [text]])
            size = len(text)
    return [(k, a, b, " ".join(ts)) for k, (a, b, ts) in enumerate(out)]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_packing_equals_a_loop_whatever_the_batches(spark, batch):
    rng = random.Random(6)
    book = {d: [(p, "".join(rng.choice("aé😀 b") for _ in range(rng.choice([0, 1, 5, 20, 120])))) for p in sorted(rng.choices(range(1, 9), k=rng.randint(1, 40)))] for d in [*range(40), None]}
    rows = [(d, p, k, t, "x") for d, ps in book.items() for k, (p, t) in enumerate(ps)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        made = chunking.pack(spark.createDataFrame([*rows, (1, 1, 0, None, "x")], "document_id long, page_number int, seq int, text string, content string"), 60)
        found = sorted(map(tuple, made.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == sorted(((d, *c) for d, ps in book.items() for c in packed(ps, 60)), key=str)
    assert chunking.pack(spark.createDataFrame([], "document_id long, page_number int, seq int, text string")).count() == 0


def test_packing_of_a_million_paragraphs(spark):
    rows = spark.range(1_000_000).selectExpr("1L AS document_id", "cast(id / 50 AS int) AS page_number", "cast(id % 50 AS int) AS seq", "repeat('x', cast(id % 97 AS int)) AS text")
    began = time.perf_counter()
    assert chunking.pack(rows).count() > 20_000
    assert time.perf_counter() - began < 120
