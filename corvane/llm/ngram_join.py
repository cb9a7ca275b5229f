"""N-gram Jaccard join by an R-tree over count vectors.

Each text is a set of distinct 5-word shingles (64-bit hashes). Hash ranges are groups; the numbers
of a set's shingles in the groups are its count vector, a point. For two sets, the sum of the smaller
coordinates bounds their overlap from above. Points are packed into pages with bounding boxes (the
leaves of the tree); pairs of pages, then pairs of points, are dropped where the bound is under the
overlap that a Jaccard similarity of 4/5 needs; what survives is verified on the shingles themselves.

Counts alone don't cut a tree over all texts: the allowed distance (2/9 of a size) is wider than the spread of any
single count. So points are first brought together by groups with equal contents: if two sets are linked, their
symmetric difference is at most (a + b) / 9 shingles, and so at most as many of their groups differ; of the first filled groups
of both, in the groups' order, all but (a + b) / 9 are the same in both. ``routing_keys`` takes some more than that number, so that linked sets
share at least ``spare`` keys. (A set whose shingles fill fewer groups than may differ has none to spare; if there is such a set in the table, all sets are
routed by single shingles too, of which linked sets always share one.) Keys of at most ``BUCKET`` sets are leaves at once: all pairs in them go through the
bound. A set with fewer than ``spare`` keys in larger buckets shares a small one with each partner. Only the others ("hot" sets: members of large
groups of near copies, or made of widespread passages) also meet by large buckets, over their smallest members (of each batch, hot or not, and of all).
Meetings that the bound leaves, and those of hot sets, are chained to blocks, and each block has its own tree: points in pages, pages in bands of sizes, each
with the box over what is below it; pairs are bounded level by level. All this is exact, without samples or caps.

Only chains of links that join documents are emitted, never all pairs of a block: the result is the component of each
document. Sets that are equal (copies) are one point. The tree first drops, on counts, the points without a partner: those that have one in their own page
or their block's lead page need no more, so that only the rest is held against all pages. Then rounds verify. In a star round each page is held against itself and its block's lead page, so that its cost is linear; in blocks that stay wide, up to ``STARS`` rounds, each with
a lead page of points not yet joined. In the last round the tree gives the pairs of pages that may hold links between unlike components: large
components fill pages of their own, and a pair of pages of one component is skipped.

Edge cases: null texts and texts without words have no shingles and are their own component; texts with fewer than five words are one
shingle, the whole sequence. Rows that repeat a document id are one node: its links are those of all its texts, and each row has its
own ``n_shingles``. Rows with a null id are linked with nothing, their component is null. Texts are taken whole, however long. Ids are whole numbers. Other
columns, whatever their names, aren't read, and ``first_of_components`` gives them back. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import join_salted, mix64, small_batches, written
from corvane.llm.graph import components

SHINGLE = 5
#: Bytes of text that are hashed at once.
BLOCK_BYTES = 1 << 20
#: Points in a page of the tree.
PAGE = 256
#: Sets in a bucket whose pairs are all held against the bound.
BUCKET = 16
#: A band of the tree has sizes within this ratio; linked sets (a ratio of 5 / 4 at most) lie at most REACH bands apart.
BAND, REACH = 1.1, 3
#: Blocks of more pages than this, in several components, get another star round, up to so many in all.
NARROW, STARS = 8, 3
#: Pairs of pages that one copy of a page's rows serves.
PAIRS_PER_PART = 64
#: A name that no caller's column has.
LATER = "_later_5be02a"
#: Sizes up to SINGLE route by single shingles; above, levels of sizes grow by LEVEL_RATIO.
SINGLE, LEVEL_RATIO = 32, 1.5

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLACE = mix64(np.arange(1000, 1000 + SHINGLE)) | _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def _word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words in a buffer of bytes; A-Z are lower-cased."""
    solid = ~_BLANK[text]
    edges = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return starts, np.zeros(0, _U)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[_LOWER[text]] * _powers(_BASE, len(text)), dtype=_U)])
        hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(text) + 1)[starts]
    return starts, mix64(hashes + (ends - starts).astype(_U))


def _parts(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of BLOCK_BYTES together (a longer text alone), with the number of the first."""
    run, first, size = [], 0, 0
    for at, text in enumerate(texts):
        if run and size + len(text) > BLOCK_BYTES:
            yield first, run
            run, first, size = [], at, 0
        run.append(text)
        size += len(text) + 1
    if run:
        yield first, run


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (UTF-8)."""
    out = []
    for _, run in _parts(texts):
        buffer = np.frombuffer(b"\n".join(run), np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in run])])
        starts, words = _word_hashes(buffer)
        at = np.searchsorted(starts, begins)
        grams = np.zeros(max(len(words) - SHINGLE + 1, 0), _U)
        with np.errstate(over="ignore"):
            for k in range(SHINGLE):
                grams += words[k : k + len(grams)] * _PLACE[k]
            grams = mix64(grams)
            for i in range(len(run)):
                low, high = at[i], at[i + 1]
                n = high - low
                if n >= SHINGLE:
                    out.append(np.unique(grams[low : high - SHINGLE + 1]))
                elif n:
                    out.append(mix64(np.array([(words[low:high] * _PLACE[:n]).sum(dtype=_U) + _U(n)])))
                else:
                    out.append(np.zeros(0, _U))
    return out


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Numbers of shingles by hash range; vectors of different lengths fold into each other by sums of neighbours.

    64 coordinates, or 4, 16, ... times as many for large sets, so that unlike sets stay apart and a count fits a byte.
    """
    groups = 64
    while groups * 8 < len(shingles):
        groups *= 4
    while True:
        counts = np.bincount((shingles >> _U(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        groups *= 4


def fold(vector: np.ndarray, groups: int) -> np.ndarray:
    return vector.astype(np.int32) if len(vector) == groups else vector.reshape(groups, -1).sum(axis=1, dtype=np.int32)


def _levels() -> list[int]:
    out = [SINGLE]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] * LEVEL_RATIO))
    return out


_LEVELS = np.array(_levels())


def routing_keys(shingles: np.ndarray, single: bool = False) -> tuple[np.ndarray, int]:
    """(keys, spare): linked sets share ``spare`` keys at least, if that is one or more.

    Sets of n and m <= 5 n / 4 meet at the level of m. With about 3 n / 8 groups, n / 4 + 1 filled ones are there but for
    odds that fall exponentially with n (under one in a billion sets at the smallest level that groups): then ``spare`` is 0 or less. With
    ``single``, all levels take single shingles, and ``spare`` is always one at least.
    """
    n = len(shingles)
    if not n:
        return shingles, 1
    most, spare, out = n * 5 // 4, n, []
    for level in range(int(np.searchsorted(_LEVELS, n)), int(np.searchsorted(_LEVELS, most)) + 1):
        top = int(_LEVELS[level])
        differ = (n + min(most, top)) // 9
        wanted = differ + 1 + max(2, n // 20)
        salt = mix64(np.array([level + 1000 * single]))[0]
        with np.errstate(over="ignore"):
            if level == 0 or single:
                keys = mix64(shingles[:wanted] ^ salt)
            else:
                groups = _U(top * 36 // 100 + 10)
                group = ((shingles >> _U(32)) * groups) >> _U(32)
                starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])[: wanted + 1]
                end = starts[wanted] if len(starts) > wanted else n
                starts = starts[:wanted]
                content = np.add.reduceat(mix64(shingles[:end] ^ salt), starts)
                keys = mix64(content + mix64(group[starts] + salt))
        out.append(keys)
        spare = min(spare, len(keys) - differ)
    return np.concatenate(out), spare


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _content(shingles: np.ndarray) -> int | None:
    return int(mix64(np.array([mix64(shingles ^ _U(7)).sum(dtype=_U)]))[0].view(np.int64)) if len(shingles) else None


def _points(texts: DataFrame) -> DataFrame:
    """(id, n, content, spare, counts): size, hash of the whole set (null if empty), shared keys of linked sets and count vector."""

    def measure(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist())
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_content(s) for s in sets], pa.int64()),
                pa.array([routing_keys(s)[1] for s in sets], pa.int64()),
                pa.array([count_vector(s).tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n", "content", "spare", "counts"])

    return texts.mapInArrow(measure, "id bigint, n bigint, content bigint, spare bigint, counts binary")


def _routes(texts: DataFrame, single: bool = False) -> DataFrame:
    """(route, key, id, near, weight) for each document and key of its own.

    A key of over BUCKET documents of one Arrow batch goes on once, with their number as ``weight``; the others get a row of their own
    with the least of them as ``near``, under a route that is theirs only, and with the ``key`` (null where it is the route).
    """

    def route(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist())
            kept = {(i, _content(s)): s for i, s in zip(ids.tolist(), sets, strict=True)}
            found = [routing_keys(s, single)[0] for s in kept.values()]
            who = np.repeat(np.array([i for i, _ in kept], np.int64), [len(k) for k in found])
            keys = np.concatenate(found) if found else np.zeros(0, _U)
            order = np.lexsort((who, keys))
            keys, who = keys[order], who[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(keys)))
            size, leader = np.repeat(sizes, sizes), np.repeat(who[starts], sizes)
            first = np.zeros(len(keys), bool)
            first[starts] = True
            alone = (size <= BUCKET) | first
            weight = np.where(size > BUCKET, size, 1)
            near = ~alone & (leader != who)
            route = np.concatenate([keys[alone], mix64(who[near].astype(_U))]).view(np.int64)
            first_rows = np.arange(len(route)) < alone.sum()
            own_keys = pa.array(np.concatenate([keys[alone], keys[near]]).view(np.int64), mask=first_rows)
            leaders = pa.array(np.concatenate([np.zeros(alone.sum(), np.int64), leader[near]]), mask=first_rows)
            columns = [pa.array(route), own_keys, pa.array(np.concatenate([who[alone], who[near]])), leaders, pa.array(np.concatenate([weight[alone], size[near]]))]
            yield pa.RecordBatch.from_arrays(columns, ["route", "key", "id", "near", "weight"])

    return texts.filter("id is not null").mapInArrow(route, "route bigint, key bigint, id bigint, near bigint, weight bigint")


def _close(rows: DataFrame) -> DataFrame:
    """(a, b): pairs in the small buckets of (route, id, n, counts) rows that the bound leaves open."""

    def compare(batches):
        rest = None
        for batch in _and_end(batches):
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if rest is not None:
                table = rest if table is None else pa.concat_tables([rest, table])
            if table is None or not table.num_rows:
                continue
            route = table.column("route").to_numpy()
            # the last bucket may go on in the next batch
            cut = len(route) if batch is None else int(np.searchsorted(route, route[-1]))
            rest = table.slice(cut)
            yield from _open_pairs(table.slice(0, cut))

    rows = rows.select("route", "id", "n", "counts").repartition("route").sortWithinPartitions("route")
    return rows.mapInArrow(compare, "a bigint, b bigint").distinct()


def _and_end(batches):
    yield from batches
    yield None


def _open_pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if table.num_rows < 2:
        return
    route, ids, n = (table.column(c).to_numpy() for c in ("route", "id", "n"))
    counts = table.column("counts").to_pylist()
    points = np.stack([fold(np.frombuffer(c, np.uint8), 64) for c in counts])
    found = set()
    for step in range(1, len(route)):
        i = np.flatnonzero(route[step:] == route[:-step])
        if not len(i):
            break
        j = i + step
        near = i[9 * np.minimum(points[i], points[j]).sum(axis=1) >= 4 * (n[i] + n[j])]
        for x in near.tolist():
            a, b = sorted((x, x + step), key=lambda k: ids[k])
            pair = (int(ids[a]), int(ids[b]))
            if pair[0] != pair[1] and pair not in found and _bound(counts[a], counts[b]) * 9 >= 4 * (n[a] + n[b]):
                found.add(pair)
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _bound(a: bytes, b: bytes) -> int:
    groups = min(len(a), len(b))
    return int(np.minimum(fold(np.frombuffer(a, np.uint8), groups), fold(np.frombuffer(b, np.uint8), groups)).sum())


def _meetings(texts: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b): chains of documents over all that may be linked."""
    bucket = Window.partitionBy("route")
    routes = _routes(texts)
    short = not points.filter("spare < 1").isEmpty()
    if short:
        routes = routes.unionByName(_routes(texts, single=True))
    rows = routes.withColumn("size", F.sum("weight").over(bucket)).withColumn("least", F.min("id").over(bucket)).filter("size > 1")
    leads = F.col("near").isNull() & (F.col("weight") > BUCKET)
    # a row in a small bucket has its key as route
    route = F.coalesce("key", "route").alias("route")
    rows = written(rows.select(route, "id", F.coalesce("near", "least").alias("least"), (F.col("size") > BUCKET).alias("large"), leads.alias("leads")), "join-buckets")
    met = points.filter("n > 0").select("id", "n", "content", "spare", "counts")
    # of copies, the first is enough: it has the same keys
    firsts = points.groupBy("content").agg(F.min("id").alias("id"))
    small = _close(rows.filter("not large").join(met.join(firsts, ["content", "id"], "left_semi"), "id"))
    hot = rows.filter("large").groupBy("id").agg(F.count("*").alias("_keys")).join(met.groupBy("id").agg(F.min(F.lit(1) if short else F.col("spare")).alias("spare")), "id")
    hot = hot.filter("_keys >= spare").select("id")
    large = rows.filter("large").join(hot, "id")
    # a batch's leader stands for its batch in the keys of hot sets, hot itself or not
    leaders = rows.filter("leads and id <> least").join(large.select("route").distinct(), "route", "left_semi")
    large = large.filter("id <> least").unionByName(leaders).select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    return small.unionByName(large)


def _needed(n: Column, m: Column) -> Column:
    """Least overlap of linked sets: 9 overlap >= 4 (n + m)."""
    return F.ceil((n + m) * 4 / 9)


def _pages(points: DataFrame, pure: bool) -> DataFrame:
    """``points`` (block, id, n, component, ...) with ``page``: at most about PAGE points of one block and similar size.

    Pages are dealt by counting, not by sorting a block: bands of sizes, then as many hash parts as a band has pages. With ``pure``, components with
    half a page or more in a band get pages of their own.
    """
    band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int")
    rows = points.withColumn("band", band)
    if pure:
        large = rows.groupBy("block", "band", "component").agg(F.count("*").alias("_own")).filter(F.col("_own") * 2 >= PAGE)
        rows = rows.join(large, ["block", "band", "component"], "left").withColumn("own", F.when(F.col("_own").isNotNull(), F.col("component")).otherwise(-1)).drop("_own")
    else:
        rows = rows.withColumn("own", F.lit(-1).cast("bigint"))
    counts = rows.groupBy("block", "band", "own").agg(F.count("*").alias("_n"))
    rows = rows.join(counts, ["block", "band", "own"])
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / PAGE))
    return rows.withColumn("page", F.xxhash64("block", "band", "own", part)).drop("own", "_n")


def _tops(column: str) -> Column:
    """Largest counts of a group's vectors, coordinate by coordinate."""
    return F.array(*[F.max(F.col(column)[i]) for i in range(64)])


def _boxes(rows: DataFrame) -> DataFrame:
    """(block, band, page, low, high, first, last, top): sizes, components and largest counts (64 coordinates) of each page."""

    def box(batches):
        for batch in batches:
            vectors = [fold(np.frombuffer(v, np.uint8), 64).tolist() for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.list_(pa.int32())), *batch.columns[1:]], ["v", "block", "band", "page", "n", "component"])

    schema = "v array<int>, block bigint, band int, page bigint, n bigint, component bigint"
    flat = rows.select("counts", "block", "band", "page", "n", "component").mapInArrow(box, schema)
    return flat.groupBy("block", "band", "page").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("first"), F.max("component").alias("last"), _tops("v").alias("top")
    )


def _may_link(a: str, b: str) -> Column:
    """Whether boxes may hold linked points: sizes near enough, and room for the overlap."""
    bound = F.aggregate(F.zip_with(f"{a}.top", f"{b}.top", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    sizes = (F.col(f"{b}.high") * 5 >= F.col(f"{a}.low") * 4) & (F.col(f"{a}.high") * 5 >= F.col(f"{b}.low") * 4)
    return sizes & (bound >= _needed(F.col(f"{a}.low"), F.col(f"{b}.low")))


def _page_pairs(boxes: DataFrame, what: str) -> DataFrame:
    """(pair, page): pairs of a block's pages whose boxes may hold linked points, as two rows (a page with itself: one).

    ``what``: "star" (a page with itself and with its block's lead page, one of several components if there is one) or "open" (all), without pairs within one
    component.
    """
    fits = _may_link("a", "b")
    fits &= ~((F.col("a.first") == F.col("a.last")) & (F.col("a.last") == F.col("b.first")) & (F.col("b.first") == F.col("b.last")))
    if what == "star":
        box = F.struct(*boxes.columns)
        leads = written(boxes.groupBy("block").agg(F.min_by(box, F.struct(F.col("first") == F.col("last"), "page")).alias("b"), F.count("*").alias("n")), "join-leads")
        rows = join_salted(boxes.select("block", F.struct(*boxes.columns[1:]).alias("a")), leads, ["block"])
        own = rows.filter((F.col("a.page") != F.col("b.page")) & ~(F.col("a.first") == F.col("a.last"))).select(F.col("a.page").alias("page"), F.col("a.page").alias("other"))
        rows = rows.filter(fits).select(F.col("a.page").alias("page"), F.col("b.page").alias("other")).unionByName(own)
    else:
        a, b = boxes.alias("a"), boxes.alias("b")
        # the level above: boxes over the pages of a band
        bands = boxes.groupBy("block", "band").agg(F.min("low").alias("low"), F.max("high").alias("high"), _tops("top").alias("top"))
        x, y = bands.alias("x"), bands.withColumn("other", F.explode(F.sequence(F.col("band") - REACH, F.col("band")))).alias("y")
        near = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.band") == F.col("y.other"))).filter(_may_link("x", "y"))
        near = near.select(F.col("x.block").alias("_block"), F.col("x.band").alias("_low"), F.col("y.band").alias("_high"))
        rows = a.join(near, (F.col("a.block") == F.col("_block")) & (F.col("a.band") == F.col("_low")))
        rows = rows.join(b, (F.col("b.block") == F.col("_block")) & (F.col("b.band") == F.col("_high")))
        rows = rows.filter((F.col("a.band") < F.col("b.band")) | (F.col("a.page") <= F.col("b.page"))).filter(fits)
        rows = rows.select(F.col("a.page").alias("page"), F.col("b.page").alias("other"))
    pages = F.array_distinct(F.array("page", "other"))
    return rows.select(F.xxhash64(F.least("page", "other"), F.greatest("page", "other")).alias("pair"), F.explode(pages).alias("page"))


def _in_pairs(paged: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``paged`` for each pair that their page is in; a page of very many pairs is dealt in parts, so that no task gets all of them."""
    pairs = written(pairs, "join-page-pairs")
    parts = pairs.groupBy("page").agg(F.ceil(F.count("*") / PAIRS_PER_PART).cast("int").alias("parts"))
    pairs = pairs.join(parts, "page").select("page", "pair", F.pmod(F.xxhash64("pair"), F.col("parts")).cast("int").alias("part"))
    copies = paged.join(parts, "page").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return copies.join(pairs, ["page", "part"])


def _near(counts: list[bytes], n: np.ndarray) -> np.ndarray:
    """Whether the bound on the overlap leaves each pair of points open (upper triangle)."""
    groups = min(len(c) for c in counts)
    points = np.stack([fold(np.frombuffer(c, np.uint8), groups) for c in counts])
    out = np.zeros((len(n), len(n)), bool)
    step = max(1, (1 << 22) // (len(n) * groups))
    for at in range(0, len(n), step):
        bound = np.minimum(points[at : at + step, None, :], points[None, :, :]).sum(axis=2)
        out[at : at + step] = 9 * bound >= 4 * (n[at : at + step, None] + n[None, :])
    return np.triu(out, 1)


def _survivors(rows: DataFrame) -> DataFrame:
    """(id,): points that the bound leaves at least one partner, of (pair, id, n, counts, component) rows."""

    def survive(table: pd.DataFrame) -> pd.DataFrame:
        near = _near(table["counts"].tolist(), table["n"].to_numpy())
        return table.loc[near.any(axis=0) | near.any(axis=1), ["id"]]

    return rows.select("pair", "id", "n", "counts").groupBy("pair").applyInPandas(survive, "id bigint").distinct()


def _verified(rows: DataFrame) -> DataFrame:
    """(a, b): links that join the points of each pair of pages, of (pair, id, n, counts, component, shingles) rows."""

    def verify(table: pd.DataFrame) -> pd.DataFrame:
        ids, sets = table["id"].tolist(), [np.frombuffer(s, np.uint64) for s in table["shingles"]]
        n = table["n"].to_numpy()
        place: dict[int, int] = {}
        root = [place.setdefault(c, i) for i, c in enumerate(table["component"].tolist())]

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = []
        for i, j in np.argwhere(_near(table["counts"].tolist(), n)):
            a, b = find(i), find(j)
            if a == b:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[b] = a
                links.append((ids[i], ids[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.groupBy("pair").applyInPandas(verify, "a bigint, b bigint")


def _sets(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(id, content, shingles) of the named documents."""
    texts = _texts(docs, key, text).join(ids, "id", "left_semi")

    def collect(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist())
            columns = [pa.array([_content(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "content", "shingles"])

    return texts.select("id", "text").mapInArrow(collect, "id bigint, content bigint, shingles binary").dropDuplicates(["id", "content"])


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    texts = _texts(docs, key, text)
    points = written(_points(texts), "join-points")
    meetings = _meetings(texts, points)

    # copies are one point, the one with the smallest id
    classes = points.filter("n > 0 and id is not null").groupBy("content").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    known = points.filter("n > 0 and id is not null").drop("spare").dropDuplicates(["id", "content"])
    copies = known.join(classes.filter("least < most"), "content").filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    blocks = components(meetings).withColumnRenamed("component", "block")
    members = known.join(blocks, "id").join(classes.select("content", F.col("least").alias("id")), ["content", "id"], "left_semi")
    crowded = members.groupBy("block").agg(F.count("*").alias("_n")).filter("_n > 1").select("block")
    members = written(members.join(crowded, "block").withColumn("component", F.col("id")), "join-members")

    def left(members: DataFrame, pages: int) -> DataFrame:
        """Members of blocks with over ``pages`` pages' points, or several bands of them, in more than one component."""
        band = F.floor(F.log("n") / F.log(F.lit(BAND)))
        rows = members.groupBy("block").agg(
            F.count("*").alias("_n"), F.min("component").alias("_a"), F.max("component").alias("_b"), F.min(band).alias("_c"), F.max(band).alias("_d")
        )
        rows = rows.filter(F.col("_a") < F.col("_b")).filter((F.col("_n") > pages * PAGE) | (F.lit(pages == 1) & (F.col("_c") < F.col("_d"))))
        return members.join(rows.select("block"), "block", "left_semi")

    def partnered(members: DataFrame, what: str, pure: bool) -> DataFrame:
        """Points to which the tree, on counts only, leaves a partner."""
        paged = written(_pages(members, pure), "join-pages")
        return written(_survivors(_in_pairs(paged, _page_pairs(written(_boxes(paged), "join-boxes"), what))), "join-open")

    # those with a partner in their own page or the lead page; then only the others are held against all pages
    first = partnered(members, "star", pure=False)
    marked = members.join(first.withColumn("_first", F.lit(True)), "id", "left").withColumn("component", F.when(F.col("_first"), -2).otherwise(F.col("id"))).drop("_first")
    second = partnered(left(written(marked, "join-marked"), 1), "open", pure=True)
    open_ids = written(first.unionByName(second).distinct(), "join-open")
    sets = written(_sets(docs, open_ids, key, text), "join-sets")
    members = written(members.join(open_ids, "id", "left_semi"), "join-open-members")

    def round_(members: DataFrame, what: str, pure: bool) -> DataFrame:
        paged = written(_pages(members, pure), "join-pages")
        pairs = _page_pairs(written(_boxes(paged), "join-boxes"), what)
        rows = _in_pairs(paged.select("id", "content", "n", "counts", "component", "page").join(sets, ["id", "content"]), pairs)
        return written(_verified(rows.select("pair", "id", "n", "counts", "component", "shingles")), "join-links")

    links = round_(members, "star", pure=False)
    for at in range(STARS):
        joined = components(links)
        members = members.drop("component").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
        members = written(left(members, 1), "join-open-members")
        wide = left(members, NARROW)
        if at + 1 == STARS or wide.isEmpty():
            break
        links = links.unionByName(round_(wide, "star", pure=True))
    more = round_(members, "open", pure=True)

    found = components(links.unionByName(more).unionByName(copies))
    rows = points.select("id", "n").join(found, "id", "left")
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def first_of_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; all columns as they are."""
    found = jaccard_components(docs, key, text).filter(F.col("component_id") < F.col(key)).select(F.struct(F.col(key).cast("bigint").alias("id")).alias(LATER))
    return docs.join(found.distinct(), F.struct(docs[key].cast("bigint").alias("id")) == F.col(LATER), "left_anti")


#: DuckDB SQL of the result, by joining shingles; for tables of a few thousand documents.
COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.y, root FROM r JOIN u ON node = u.x),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d JOIN c ON d.doc_id = c.node LEFT JOIN n ON n.doc_id = d.doc_id"""
