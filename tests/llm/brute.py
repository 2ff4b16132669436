"""Plain versions of the operators' results, from their definitions."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = "".join(map(chr, range(65, 91)))


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(str.maketrans(UPPER, UPPER.lower())) if lower else text)


def shingles(text):
    w = words(text, True)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    """doc_id: (number of shingles, smallest doc_id that links lead to)."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least[find(i)] if doc is not None else None) for i, (doc, _) in enumerate(rows)), key=str)


def passages(rows, window=35):
    lists = [words(t) for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, lists, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_dedup(rows, edits=2, least=40):
    order = lambda doc: (doc is None, doc or 0)
    first = {}
    for doc, text in sorted(rows, key=lambda r: order(r[0])):
        for p, line in enumerate((text or "").split("\n")):
            if WORD.search(line):
                first.setdefault(line, (order(doc), p))
    near = set()
    lines = sorted((x for x in first if len(x) >= least), key=len)
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if len(b) - len(a) > edits:
                break
            if edit_distance(a, b) <= edits:
                near.add(max((first[a], a), (first[b], b))[1])
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, 0, None))
            continue
        lines = text.split("\n")
        kept = [x for p, x in enumerate(lines) if not WORD.search(x) or x not in near and first[x] == (order(doc), p)]
        out.append((doc, len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def measures(text):
    w = words(text)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def contained(rows, items, percent=75):
    out = []
    for doc, text in rows:
        w, held = words(text, True), shingles(text)
        for item, passage in items:
            wanted = shingles(passage)
            short = len(words(passage)) < 5
            joined = " " + " ".join(w) + " "
            n = int(" " + " ".join(words(passage, True)) + " " in joined) if short else len(held & wanted)
            if wanted and 100 * n >= percent * len(wanted):
                out.append((doc, item, n, len(wanted)))
    return sorted(out, key=str)
