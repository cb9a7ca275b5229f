"""Results that SQL can't express, against plain Python versions made from the definitions."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex

from corvane.llm import decontaminate as D
from corvane.llm import langid, media

# decontamination: templates, alignments and slots, pair by pair


def tokens_by_hand(text):
    """(mark, value) of each token: marks n, u, a, o for numbers, units, names and opening words, w for words."""
    out, last = [], 0

    def words(part):
        for w in part.lower().split():
            w = regex.sub(r"[^\p{L}\p{N}]+", "", w)
            if w:
                out.append(("w", w))

    for m in regex.finditer(D._SLOT, text):
        words(text[last : m.start()])
        last = m.end()
        for mark, group in (("n", 1), ("u", 3), ("a", 4), ("o", 5)):
            if m.group(group):
                out.append((mark, regex.sub(r"[^\p{L}\p{N}]+", "", m.group(group).lower())))
    words(text[last:])
    return out


def shape(token, opened):
    mark, value = token
    return {"n": "<n>", "u": "<u>", "a": "<a>"}.get(mark) or ("<a>" if mark == "o" and opened else value)


def judged_by_hand(doc, item, size=8, literals=4, share=0.6, drift=4):
    """(kind, matched, n_windows) of a document and an item, or None."""
    ours, theirs = tokens_by_hand(item), tokens_by_hand(doc)
    if not ours:
        return None
    size = min(size, len(ours))
    places = range(len(ours) - size + 1)
    plain, named = ([shape(t, o) for t in ours] for o in (False, True))
    rich = [p for p in places if sum(s not in ("<n>", "<u>", "<a>") for s in plain[p : p + size]) >= min(literals, size)]
    n_windows = len(rich) or len(places)
    hits = defaultdict(lambda: defaultdict(set))
    starts = range(len(theirs) - size + 1)
    their_plain, their_named = ([shape(t, o) for t in theirs] for o in (False, True))
    for at in starts:
        for p in rich or places:
            if rich:
                a, b = plain[p : p + size], named[p : p + size]
                x, y = their_plain[at : at + size], their_named[at : at + size]
                if a == x:
                    hits[False][at - p].add(p)
                if a == x or b == y or a == y or b == x:
                    hits[True][at - p].add(p)
            elif [t[1] for t in ours[p : p + size]] == [t[1] for t in theirs[at : at + size]] and [("w" if t[0] == "o" else t[0]) for t in ours[p : p + size]] == [
                ("w" if t[0] == "o" else t[0]) for t in theirs[at : at + size]
            ]:
                hits[False][at - p].add(p)
                hits[True][at - p].add(p)
    best = None
    for names, by_shift in hits.items():
        for centre in by_shift:
            near = {s: ps for s, ps in by_shift.items() if abs(s - centre) <= drift}
            matched = len(set().union(*near.values()))
            if matched < share * n_windows:
                continue
            slots = set()
            for p, own in enumerate(ours):
                gap = {s: min(max(q - p, p - (q + size - 1), 0) for q in ps) for s, ps in near.items()}
                shift = min(near, key=lambda s: (gap[s], abs(s - centre), s))
                if not 0 <= p + shift < len(theirs):
                    continue
                other = theirs[p + shift]
                a, b = shape(own, names), shape(other, names)
                if a == b and a in ("<n>", "<u>", "<a>"):
                    slots.add((own[1], own[0].replace("o", "a"), other[1], other[0].replace("o", "a")))
            one_to_one = len({s[:2] for s in slots}) == len(slots) == len({s[2:] for s in slots})
            kind = 2 if all(s[:2] == s[2:] for s in slots) else 1 if one_to_one else 0
            found = (kind, not names, matched, -centre)
            best = found if best is None or found > best else best
    return None if best is None else (D.KINDS[best[0]], best[2], n_windows)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(31)
    words = ["apples", "buys", "gives", "then", "how", "many", "are", "left", "shop", "in", "the", "to", "costs", "and", "runs"]
    people, units = ["Anna", "Bob", "Clara", "Dan"], ["km", "cm", "dollars", "kg"]

    def question():
        parts = []
        for at in range(rng.randint(4, 26)):
            roll = rng.random()
            parts.append(rng.choice(people) if roll < 0.2 or (at == 0 and roll < 0.5) else f"{rng.randint(2, 60)} {rng.choice(units)}" if roll < 0.35 else str(rng.randint(2, 60)) if roll < 0.45 else rng.choice(words))
            if rng.random() < 0.1:
                parts[-1] += "."
        return " ".join(parts)

    items = [question() for _ in range(14)] + ["12 + 35 - 7 = 40"]

    def changed(text):
        out = text
        for a in people:
            if rng.random() < 0.3:
                out = out.replace(a, rng.choice(people))
        if rng.random() < 0.5:
            out = regex.sub(r"\b(\d+)\b", lambda m: str(int(m[1]) + rng.choice([0, 0, 7])), out)
        parts = out.split()
        if rng.random() < 0.4:
            del parts[rng.randrange(len(parts))]
        if rng.random() < 0.4:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(words))
        return " ".join(parts)

    texts = []
    for _ in range(90):
        body = [rng.choice(words) for _ in range(rng.randint(0, 15))]
        for _ in range(rng.randint(1, 2)):
            body.append(changed(rng.choice(items)) + rng.choice(["", ".", " So"]))
        texts.append(" ".join(body))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r["id"], r["item_id"]): (r["kind"], r["matched"], r["n_windows"]) for r in D.find_leaks(docs, bench).collect()}
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            found = judged_by_hand(text, item)
            if found is not None:
                want[d, i] = found
    assert len({v[0] for v in want.values()}) == 3
    assert got == want


# media


def unfilter_by_hand(kinds, lines):
    out = [[0] * lines.shape[1] for _ in kinds]
    for y, kind in enumerate(kinds):
        for x, value in enumerate(lines[y].tolist()):
            left = out[y][x - 1] if x else 0
            up = out[y - 1][x] if y else 0
            corner = out[y - 1][x - 1] if x and y else 0
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(p - v))
            out[y][x] = (value + (0, left, up, (left + up) // 2, paeth)[kind]) % 256
    return out


def test_unfilter_against_every_byte():
    rng = np.random.default_rng(4)
    for rows, width in ((1, 1), (7, 13), (40, 29)):
        for kinds in (rng.integers(0, 5, rows), np.full(rows, 4), np.full(rows, 3), np.arange(rows) % 2 * 4):
            lines = rng.integers(0, 256, (rows, width)).astype(np.uint8)
            assert media.unfilter(kinds, lines).tolist() == unfilter_by_hand(kinds.tolist(), lines)
    with pytest.raises(ValueError):
        media.unfilter(np.array([5]), np.zeros((1, 3), np.uint8))


@pytest.mark.parametrize("rows", [1, 3, 31, 32, 50])
def test_feature_against_direct_sums(rows):
    samples = np.random.default_rng(rows).integers(0, 256, (rows, 192)).astype(np.uint8)
    edges = [int(y * rows / 32) for y in range(33)] if rows >= 32 else None
    grid = np.empty((32, 32))
    for y in range(32):
        for x in range(32):
            part = samples[edges[y] : edges[y + 1], 6 * x : 6 * x + 6] if edges else samples[y * rows // 32, 6 * x : 6 * x + 6]
            grid[y, x] = part.mean()
    cosine = [[np.cos(np.pi * (2 * i + 1) * k / 64) / 4 for i in range(32)] for k in range(8)]
    terms = [sum(cosine[u][y] * cosine[v][x] * grid[y, x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)][1:]
    middle = round(float(np.median(terms)), 6)
    bits = "".join("1" if round(t, 6) > middle else "0" for t in terms)
    assert media.cosine_hash(samples) == format(int(bits, 2), "016x")


# language: the rule of the regularised leader, and the probabilities, coordinate by coordinate


def grams_by_hand(text):
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    clean = " " + " ".join(clean.split()) + " "
    out = defaultdict(int)
    for n in (1, 2, 3):
        for i in range(len(clean) - n + 1):
            value = 0
            for c in clean[i : i + n]:
                value = (value << 21) | ord(c)
            out[((value + n - 1) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 50] += 1
    return out


def test_language_against_plain_sums(spark):
    rng = random.Random(5)
    stock = {"xx": ["zak", "zor", "kiz"], "yy": ["lamo", "möla", "almo"]}
    rows = [(i, " ".join(rng.choice(stock[lang]) for _ in range(6)), lang) for i, lang in enumerate(["xx", "yy"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    from zlib import crc32

    taught = [(t, lang) for i, t, lang in rows if crc32(str(i).encode()) % 4 != 2]
    df = defaultdict(int)
    for text, _ in taught:
        for b in grams_by_hand(text):
            df[b] += 1
    idf = {b: np.log((1 + len(taught)) / (1 + df[b])) + 1 for b in range(langid.BUCKETS)}
    assert np.allclose(model.idf, [idf[b] for b in range(langid.BUCKETS)])

    def features(text):
        x = {b: (1 + np.log(n)) * idf[b] for b, n in grams_by_hand(text).items()}
        size = np.sqrt(sum(v * v for v in x.values()))
        return {b: v / size for b, v in x.items()}

    # training again from the same sample and order, with a dict for each coordinate
    sample = [(np.array(sorted(grams_by_hand(t))), np.array([n for _, n in sorted(grams_by_hand(t).items())]), lang) for t, lang in taught]
    trained = langid.train(sample, np.array([df[b] for b in range(langid.BUCKETS)]), len(taught))
    langs = ["xx", "yy"]
    z, n = defaultdict(float), defaultdict(float)
    parts = [(features(t), langs.index(lang)) for t, lang in taught][: len(taught) * 4 // 5]

    def weight(key):
        l1 = 0 if key[0] == "bias" else langid.L1
        if abs(z[key]) <= l1:
            return 0.0
        return (np.sign(z[key]) * l1 - z[key]) / ((langid.BETA + np.sqrt(n[key])) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for start in range(0, len(parts), langid.BATCH):
            grad, w = defaultdict(float), {}
            batch = parts[start : start + langid.BATCH]
            for x, label in batch:
                keys = {(b, c): v for b, v in [*x.items(), ("bias", 1.0)] for c in (0, 1)}
                for key in keys:
                    w.setdefault(key, weight(key))
                margins = [sum(v * w[b, c] for b, v in [*x.items(), ("bias", 1.0)]) for c in (0, 1)]
                p = np.exp(np.array(margins) - max(margins))
                p /= p.sum()
                for (b, c), v in keys.items():
                    grad[b, c] += v * (p[c] - (c == label))
            for key, g in grad.items():
                sigma = (np.sqrt(n[key] + g * g) - np.sqrt(n[key])) / langid.ALPHA
                z[key] += g - sigma * w[key]
                n[key] += g * g
    assert all(abs(trained.weights[b, c] - weight((b, c))) < 1e-9 for b in df for c in (0, 1))
    assert all(abs(trained.bias[c] - weight(("bias", c))) < 1e-9 for c in (0, 1))
    # predictions of the fitted model
    for r in langid.identify(docs, model).collect():
        x = features(rows[r["doc_id"]][1])
        margins = np.array([sum(v * model.weights[b, c] for b, v in x.items()) + model.bias[c] for c in (0, 1)]) / model.temperature
        p = np.exp(margins - margins.max())
        p /= p.sum()
        assert r["lang_pred"] == langs[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-9


def test_bucket_counts_are_those_of_the_definition():
    for text in ("Zak möla, zak 12!", "ß½x", "a"):
        counts = langid.gram_counts(text)
        assert {int(b): int(counts[b]) for b in np.flatnonzero(counts)} == dict(grams_by_hand(text))
    batch = pa.RecordBatch.from_arrays([pa.array(["zak", "12"])], ["t"])
    found = next(langid._bucket_counts([batch], []))
    assert found.column(0).to_pylist()[1] is None


def test_edges_of_items_are_no_part_of_a_plan(spark, monkeypatch):
    """However many items there are, the plan that reads the documents stays as small."""
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}" for i in range(1000)]
    texts = [" ".join(words[(7 * i + k * k) % 1000] for k in range(16)) for i in range(150)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"so {texts[3]} it is"), (2, "nothing of that")], "doc_id bigint, text string")
    plans, windows = [], D._document_windows

    def seen(*args):
        found = windows(*args)
        plans.append(found._jdf.queryExecution().toString())
        return found

    monkeypatch.setattr(D, "_document_windows", seen)
    assert [tuple(r) for r in D.contaminated(docs, items).select("doc_id", "item_id", "kind").collect()] == [(1, 3, "exact")]
    assert len(plans) == 1 and len(plans[0]) < 30_000


def test_decontamination_with_and_without_edges(spark, monkeypatch):
    """Leaving windows with other edges out beforehand changes nothing."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    with_edges = sorted(map(str, D.contaminated(docs, items).collect()))
    monkeypatch.setattr(D, "EDGES", 0)
    assert with_edges == sorted(map(str, D.contaminated(docs, items).collect())) and with_edges
