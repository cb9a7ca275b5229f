"""What the operators promise beyond their results on plain tables: held-out rows, odd keys, clashing names, hot groups."""

import random
from zlib import crc32

from pyspark.sql import functions as F

from corvane.llm import langid, quality

DOCS = "doc_id bigint, text string, lang string"


def language_docs(spark):
    rng = random.Random(3)
    stock = {"xx": ["zak", "zor", "kiz"], "yy": ["lamo", "mola", "almo"], "rare": ["qux"]}
    langs = ["xx", "yy"] * 150 + ["rare"] * 3
    return spark.createDataFrame([(i, " ".join(rng.choice(stock[lang]) for _ in range(20)), lang) for i, lang in enumerate(langs)], DOCS)


def test_language_learns_from_taught_rows_only(spark):
    docs = language_docs(spark)
    changed = docs.withColumn("text", F.when(langid.held_out(F.col("doc_id")), "½ other wordz").otherwise(F.col("text")))
    a, b = langid.fit(docs), langid.fit(changed)
    assert a.langs == b.langs and (a.idf == b.idf).all() and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_language_rare_and_repeated_rows(spark):
    docs = language_docs(spark)
    many = docs.unionByName(docs.filter("lang = 'xx'")).unionByName(docs.filter("lang = 'xx'"))
    model = langid.fit(many, sample_rows=30)
    assert model.langs == ("rare", "xx", "yy")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(many, model).collect()}
    assert all(found[i] == lang for i, lang in enumerate(["xx", "yy"] * 150))


def test_language_needs_letters(spark):
    assert langid.gram_counts("½ ² ① 12 _") is None and langid.gram_counts("½ é") is not None
    assert (langid.gram_counts("a½b") == langid.gram_counts("a b")).all()
    words = spark.createDataFrame([("k1", "zak", "xx"), (None, "²", None)], "doc_id string, text string, lang string")
    assert sorted((r["doc_id"] or "", r["lang_pred"]) for r in langid.identify_languages(words).collect()) == [("", "und"), ("k1", "xx")]


def test_quality_learns_from_taught_labels_only(spark):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)) if i % 2 else "#$% " * rng.randint(5, 90) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id"), 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = labels.unionByName(labels).unionByName(spark.createDataFrame([(0, 1), (None, 1)], "doc_id bigint, quality int"))
    one, two, three = (sorted(map(tuple, quality.classify_quality(docs, x).collect())) for x in (labels, turned, again))
    assert one == two
    # document 0 has two labels now: it isn't learned from, others count once
    assert {r[0] for r in three} == set(range(200)) and all(a[3] == b[3] for a, b in zip(one, three, strict=True))
    held = [r for r in one if crc32(str(r[0]).encode()) % 3 == 1]
    assert all(r[1] for r in held) and sum(r[3] == r[0] % 2 for r in held) >= 0.95 * len(held)


def test_quality_score_against_dense_formula(spark):
    """The score of every row from the formula of the discriminant, with plain determinants and inverses."""
    import numpy as np

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Alpha", "beta,", "gamma.", "12", "$$"]) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(len(t) % 3 > 0)) for i, t in enumerate(texts)], "doc_id bigint, quality int")
    stats = quality.document_statistics(docs).join(labels, "doc_id")
    model = quality.fit(stats, pooled=[0.3], identity=[0.05])
    got = {r["doc_id"]: r["score"] for r in quality.score(quality.document_statistics(docs), model).collect()}
    x = np.array([quality.statistics(t.encode()) for t in texts])
    y = np.array([int(len(t) % 3 > 0) for t in texts])
    parts = [x[y == c] for c in (0, 1)]
    shared = sum(np.cov(p.T, bias=True) * len(p) for p in parts) / len(x)
    log = []
    for p in parts:
        s = 0.95 * (0.7 * np.cov(p.T, bias=True) + 0.3 * shared) + 0.05 * np.diag(np.maximum(np.diag(shared), 1e-6))
        gap = x - p.mean(axis=0)
        log.append(np.log(len(p) / len(x)) - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap) - 0.5 * np.linalg.slogdet(s)[1])
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))
    assert all(abs(got[i] - w) < 1e-6 for i, w in enumerate(want))


def test_clashing_names_are_given_back(spark):
    docs = spark.createDataFrame([(1, "some text", 5, 6), (2, None, 7, 8)], "doc_id bigint, text string, _rejected int, _key int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert sorted(map(tuple, quality.keep_quality(docs, labels).collect())) == [(1, "some text", 5, 6), (2, None, 7, 8)]


def test_decontamination_items_with_repeated_or_null_ids(spark):
    from corvane.llm import decontaminate

    a = "the quick onyx goblin jumps over every lazy dwarf while seven wizards hum along the river bank"
    b = "a completely different question about rivers and mountains that nobody has ever asked in any exam before"
    sums = "12 + 35 - 7 + 99 = 139 cm and 4 km"
    bench = spark.createDataFrame([(1, a), (1, b), (1, a), (None, sums), (None, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x " + a), (2, b + " y"), (3, "so " + sums + " then"), (None, a), (5, "clean")], "doc_id bigint, text string")
    found = sorted((r["doc_id"] or 0, r["item_id"], r["kind"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert found == [(0, 1, "exact"), (1, 1, "exact"), (2, 1, "exact"), (3, None, "exact")]
    odd = docs.withColumn("_leak", F.lit(3)).withColumn("_version", F.lit(4)).withColumn("entry", F.lit(5))
    assert [tuple(r) for r in decontaminate.clean(odd, bench).collect()] == [(5, "clean", 3, 4, 5)]


def test_decontamination_shuffled_items(spark, monkeypatch):
    from corvane.llm import decontaminate

    text = "every window of this question stands in many documents and must meet them all in several tasks at once"
    bench = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"n{i} " + text) for i in range(40)], "doc_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert decontaminate.contaminated(docs, bench).count() == 40


def test_line_dedup_blank_lines_and_clashing_names(spark):
    import time

    from corvane.llm import line_dedup

    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "\n" * 100_000 + words, 1, 2, 3), (2, words, 4, 5, 6)], "doc_id bigint, text string, _id int, _version int, _deleted int")
    start = time.monotonic()
    rows = {r["doc_id"]: tuple(r) for r in line_dedup.clean(docs).collect()}
    assert time.monotonic() - start < 60
    assert rows[2] == (2, "", 4, 5, 6) and rows[1][2:] == (1, 2, 3) and rows[1][1] == "\n" * 100_000 + words


def test_line_dedup_selects_window_minima():
    """Fingerprints against the definition of winnowing, window by window."""
    import numpy as np

    from corvane.llm import line_dedup

    rng = np.random.default_rng(5)
    counts = np.array([7, 1, 0, 30, 12])
    n, least = int(counts.sum()), 6
    hashes, words = rng.integers(0, 9, n).astype(np.uint64) << np.uint64(1), rng.integers(0, 4, n)
    first, end = line_dedup._of_batch(counts)
    low, high, selected = line_dedup.windows(hashes, words, first, end, least)
    want = set()
    for a in range(n):
        for b in range(a + 1, int(end[a]) + 1):
            inside, total = words[a:b], int(words[a:b].sum())
            if total >= least and (total - inside[-1] < least or total - inside[0] < least):
                want.add((a, b))
    assert set(zip(low.tolist(), high.tolist(), strict=True)) == want
    for a, b, at in zip(low.tolist(), high.tolist(), selected.tolist(), strict=True):
        assert at == min((int(hashes[i]) if words[i] else 1 << 63, -i) for i in range(a, b))[1] * -1


def test_mix_word_by_word(spark):
    """Each document's ``taken``, by laying out the words of every shard one after another."""
    from collections import Counter, defaultdict

    from corvane.llm import mixing

    rng = random.Random(12)
    rows = [(i, " ".join("w" * rng.randint(0, 90)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(900, "one two three four five", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(docs, shard_words=1500).collect()}
    sized = docs.select("doc_id", "source", F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("bigint").alias("size"))
    order = F.xxhash64(F.lit(mixing.SEED), F.col("doc_id"), F.col("size"))
    dealt = sized.withColumn("order", order).withColumn("deal", F.xxhash64(F.lit(mixing.SEED + 1), F.col("order"))).collect()
    by_source = defaultdict(list)
    for r in dealt:
        by_source[r["source"]].append(r)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    shards = {}
    for at, name in enumerate(names):
        own = by_source[name]
        n = max(1, -(-sum(r["size"] for r in own) // 1500))
        for r in sorted(own, key=lambda r: (r["order"], r["doc_id"])):
            shards.setdefault((at, r["deal"] % n), []).extend([r["doc_id"]] * r["size"])
    shards = {k: w for k, w in shards.items() if w}
    blocks = {k: max(int(len(w) / 32 + 0.5), min(len(w), 16)) for k, w in shards.items()}

    def deal(votes, seats, most):
        """Seat by seat."""
        out = [0] * len(votes)
        for _ in range(seats):
            _, i = max((v / (2 * o + 1), -i) for i, (v, o, m) in enumerate(zip(votes, out, most, strict=True)) if o < m)
            out[-i] += 1
        return out

    at_all = sorted({k[0] for k in shards})
    target = {at: got[by_source[names[at]][0]["doc_id"]]["target"] for at in at_all}
    wanted = [target[at] * sum(blocks[k] for k in shards if k[0] == at) / sum(len(shards[k]) for k in shards if k[0] == at) for at in at_all]
    seats = deal(wanted, int(sum(wanted) + 0.5), [3 * sum(blocks[k] for k in shards if k[0] == at) for at in at_all])
    taken = Counter()
    for at, n_seats in zip(at_all, seats, strict=True):
        keys = sorted(k for k in shards if k[0] == at)
        for key, quota in zip(keys, deal([len(shards[k]) for k in keys], n_seats, [3 * blocks[k] for k in keys]), strict=True):
            words, n = shards[key], blocks[key]
            hashes = spark.range(n).select(F.xxhash64(F.lit(mixing.SEED + 2), F.lit(key[0] + 1), F.lit(key[1]).cast("bigint"), F.col("id")).alias("h"), "id").collect()
            extra = {r["id"] for r in sorted(hashes, key=lambda r: (r["h"], r["id"]))[: quota % n]}
            for place, doc in enumerate(words):
                taken[doc] += quota // n + (((place + 1) * n - 1) // len(words) in extra)
    assert {i: r["taken"] for i, r in got.items()} == {i: taken[i] for i in got}
    assert abs(got[900]["taken"] - got[900]["target"]) <= 1


def test_language_of_one_row_repeated_very_often(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(10)) + f" x{i}", "en") for i in range(199)]
    taught = next(k for k in range(1000, 1010) if crc32(str(k).encode()) % 4 != 2)
    table = spark.createDataFrame(docs, DOCS).unionByName(spark.range(4000).selectExpr(f"{taught}L as doc_id", "'zwei drei vier' as text", "'de' as lang"))
    assert langid.fit(table, sample_rows=30).langs == ("de", "en")


def test_mixing_source_of_empty_rows_is_split(spark, monkeypatch):
    from corvane.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_ROWS", 50)
    docs = spark.range(1000).selectExpr("id as doc_id", "CASE WHEN id % 10 = 0 THEN 'one two three' WHEN id % 10 = 1 THEN NULL ELSE '' END as text", "CASE WHEN id < 900 THEN 'a' END as source")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 1000 and sum(r["taken"] for r in rows) > 250 and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)


def test_secrets_of_a_blob_with_very_many_paths(spark, monkeypatch):
    from corvane.llm import common, secrets

    monkeypatch.setattr(common, "SALTS", 8)
    docs = spark.range(500).selectExpr("id as doc_id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'token = abcdef123456' ELSE concat('text ', id) END as text")
    rows = {r["doc_id"]: r["n_assign"] for r in secrets.find_secrets(docs).collect()}
    assert rows == {i: int(i % 3 == 1) for i in range(500)}
