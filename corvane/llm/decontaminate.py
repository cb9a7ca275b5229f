"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

``template`` turns a text into tokens: numbers, names (capitalised words within a sentence) and units
behind a number become typed placeholders, other words are lower-cased and lose punctuation. Windows of
``window`` tokens of documents and items are joined by hash; so an item whose numbers or names were exchanged still meets.
A window needs ``literals`` tokens that aren't placeholders. Of items that have no such window, all windows are compared with their values.

Capitalised words that open a sentence may be names or not, so templates are compared both ways: opening words as words, and as names. An alignment
that only holds with names is judged with the opening words among its slots.

A pair of document and item is a leak if at one alignment ``share`` of the item's windows are there. Windows up to ``DRIFT`` tokens
aside count too, each once, so that inserted or deleted words don't split a question. The slots of every such alignment are then compared, each at the
shift of the window over it, and the best kind is the pair's: an alignment is
``exact`` if all slots have the item's values, ``reparameterised`` if the values differ but one value of the item
always became the same value in the document and no two values became one, and ``inconsistent`` otherwise; the last
is no leak, as a text that happens to have the template isn't the question.

Edge cases: null and empty texts have no tokens and leak nothing; texts are taken whole, however long. Items with fewer tokens than a window are compared
by one window of their own length, and leak if it is found. An item is its id and text: texts that share an id, null or not, are items of their own, each
with a row of its own under that id; rows that repeat both are one. Repeated documents are judged alike, by id and text. Empty tables give an
empty result; ``clean`` with an empty benchmark keeps all rows, and all columns, whatever their names. Documents with a null id are judged as others.

Items are broadcast only if their windows number ``BROADCAST_WINDOWS`` at most; else both sides are shuffled by hash, with
the documents' windows dealt over ``SALTS`` parts, for each of which the items' (fewer) windows are repeated: a widespread window doesn't meet in one task.
What follows the join is grouped by document version, item and alignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SALTS, written

WINDOW = 8
LITERALS = 4
SHARE = 0.6
#: An alignment holds the windows whose shift differs from its own by so many tokens at most.
DRIFT = 4
#: At most this many windows (some 100 bytes each) are sent to every executor.
BROADCAST_WINDOWS = 200_000

#: Up to so many different edges (first and last token) of items' windows, documents' windows with other edges aren't hashed, but for a few in a hundred.
EDGES = 20_000
#: Places that edges are marked at, for each edge at least.
PLACES_PER_EDGE = 16

#: A name that no caller's column has.
LEAK = "_leak_7c41e0"

#: From the worst to the best.
KINDS = ("inconsistent", "reparameterised", "exact")

#: Placeholders and units (fixed values).
NUMBER, NAME, UNIT = "<n>", "<a>", "<u>"
UNITS = (
    "%", "mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "sec", "min", "h", "hr", "hours?", "minutes?", "seconds?", "days?", "weeks?",
    "months?", "years?", "meters?", "metres?", "kilometers?", "kilometres?", "miles?", "feet", "foot", "inch(?:es)?", "pounds?", "dollars?",
    "cents?", "euros?", "grams?", "liters?", "litres?",
)
_NUMBER = r"[0-9](?:[0-9.,:/]*[0-9])?"
#: A number with its unit, if any; or a capitalised word behind a letter, digit, comma or semicolon and a blank.
_SLOT = rf"(?<![\p{{L}}0-9])({_NUMBER})(?:(\s?)((?i:{'|'.join(UNITS)})(?![\p{{L}}0-9]))|(?![\p{{L}}0-9]))|(?<=[\p{{L}}0-9,;]\x20)(\p{{Lu}}\p{{Ll}}[\p{{L}}'-]*)"
#: Another capitalised word that stands by itself: it opens a sentence, or follows other punctuation.
_SLOT += r"|(?<=^|\s|^[\"'(\u201c]|\s[\"'(\u201c])(\p{Lu}\p{Ll}[\p{L}'-]*)(?=[^\p{L}\p{N}\s]*(?:\s|$))"
#: No slot begins with another character, which is quickly seen.
_SLOT = rf"(?=[0-9\p{{Lu}}])(?:{_SLOT})"
#: Marks of slots in the text; a slot's value follows its placeholder's mark.
_N, _U, _A, _O = "\ue001", "\ue002", "\ue003", "\ue004"


def raw_tokens(text: Column) -> Column:
    """array<string>: tokens with values; slots begin with a private mark and end with the value."""
    marks = F.translate(text, _N + _U + _A + _O, "")
    has_slot = marks.rlike(r"[0-9]|\p{Lu}\p{Ll}")
    slots = F.regexp_replace(marks, _SLOT, rf" {_N}$1 {_U}$3 {_A}$4 {_O}$5 ")
    words = F.lower(F.when(has_slot, slots).otherwise(marks))
    # alternatives that didn't match leave bare marks
    words = F.regexp_replace(words, rf"[^a-z\s\p{{L}}\p{{N}}{_N}{_U}{_A}{_O}]+|[{_N}{_U}{_A}{_O}](?=\s|$)", "")
    return F.filter(F.split(words, r"\s+"), lambda t: t != "")


def _shape(token: Column, opened: Column | bool = False) -> Column:
    """A raw token's place in a template: its placeholder, or the word itself; with ``opened``, opening words are names."""
    shape = F.when(token.startswith(_N), NUMBER).when(token.startswith(_U), UNIT).when(token.startswith(_A), NAME)
    name = opened if isinstance(opened, Column) else F.lit(opened)
    return shape.when(token.startswith(_O), F.when(name, NAME).otherwise(F.substring(token, 2, 1 << 30))).otherwise(token)


def template(text: Column, opened: bool = False) -> Column:
    """array<string>: the canonical tokens of a text."""
    return F.transform(raw_tokens(text), lambda t: _shape(t, opened))


def _is_slot(token: Column) -> Column:
    return token.isin(NUMBER, NAME, UNIT)


def _codes(tokens: Column, opened: bool) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(_shape(t, opened)))


def _values(tokens: Column) -> Column:
    """Codes of the tokens with their values; they never equal those of a template."""
    return F.transform(tokens, lambda t: F.xxhash64(F.lit("value"), F.when(t.startswith(_O), F.substring(t, 2, 1 << 30)).otherwise(t)))


def _edge(codes: Column, start: Column | int, size: Column | int) -> Column:
    """A mix of the first and the last code of a window. Windows that are equal have equal edges."""
    return F.get(codes, start).bitwiseXOR(F.get(codes, start + size - 1))


def _place(edge: Column, n: int) -> Column:
    """Of ``n`` places, a power of two, the one that an edge is marked at."""
    return edge.bitwiseAND(F.lit(n - 1)).cast("int")


def _marked(edges: DataFrame, n: int) -> DataFrame:
    """One row, (marked): for each of ``n`` places whether one of the (edge,) rows is marked there. As a row, no edge is part of a plan or passes through the driver."""
    rows = edges.agg(F.array_sort(F.collect_set(_place(F.col("edge"), n))).alias("at"))
    runs = F.transform("at", lambda p, i: F.concat(F.array_repeat(F.lit(False), p - F.coalesce(F.get("at", i - 1), F.lit(-1)) - 1), F.array(F.lit(True))))
    rest = F.array_repeat(F.lit(False), F.lit(n - 1) - F.coalesce(F.array_max("at"), F.lit(-1)))
    return rows.select(F.concat(F.flatten(runs), rest).alias("marked"))


def entries(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(entry, item, text): the distinct items, numbered by a hash of id and text, so that a null id is as good as another."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    return rows.select(F.xxhash64(F.col("item").isNull(), "item", "text").alias("entry"), "item", "text")


def item_windows(items: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(entry, at, size, hash, opened, valued, n_windows, edges) of the windows of (entry, text) that have enough literals, or of all of an item that has none.

    ``opened``: the hash with opening words as names, where it is another; ``valued``: the hash of the values;
    ``edges``: those of the window both ways.
    """
    rows = items.select("entry", raw_tokens(F.col("text")).alias("tokens"))
    rows = rows.filter(F.size("tokens") > 0).withColumn("size", F.least(F.lit(window), F.size("tokens")))
    starts = F.sequence(F.lit(0), F.size("tokens") - F.col("size"))
    rows = rows.select("entry", "size", F.posexplode(F.transform(starts, lambda i: F.slice("tokens", i + 1, F.col("size")))).alias("at", "w"))
    rows = rows.withColumn("rich", F.size(F.filter("w", lambda t: ~_is_slot(_shape(t)))) >= F.least(F.lit(literals), F.col("size")))
    some = rows.groupBy("entry").agg(F.max("rich").alias("some"), F.count_if("rich").alias("n_rich"), F.count("*").alias("n_all"))
    rows = rows.join(some, "entry").filter(F.col("rich") | ~F.col("some"))
    plain, names, values = (F.xxhash64("size", c) for c in (_codes(F.col("w"), False), _codes(F.col("w"), True), _values(F.col("w"))))
    hashes = F.when(F.col("some") & (plain == names), F.array(F.struct(plain.alias("hash"), F.lit(False).alias("opened"))))
    hashes = hashes.when(F.col("some"), F.array(F.struct(plain.alias("hash"), F.lit(False).alias("opened")), F.struct(names.alias("hash"), F.lit(True).alias("opened"))))
    hashes = hashes.otherwise(F.array(F.struct(values.alias("hash"), F.lit(False).alias("opened"))))
    n_windows = F.when(F.col("some"), F.col("n_rich")).otherwise(F.col("n_all"))
    edges = F.array(*[_edge(_codes(F.col("w"), opened), 0, F.col("size")) for opened in (False, True)])
    return rows.select("entry", "at", "size", F.explode(hashes).alias("h"), (~F.col("some")).alias("valued"), n_windows.alias("n_windows"), edges.alias("edges")).select(
        "entry", "at", "size", "h.hash", "h.opened", "valued", "n_windows", "edges"
    )


def _document_windows(docs: DataFrame, sizes: list[int], valued: list[int], places: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(id, version, at, hash, named): hashes of all windows of the given sizes, with opening words as words and as names; and of values.

    With ``places``, a row of ``_marked`` and their number, windows whose edge isn't marked either way are left out before they are hashed: they meet no item.
    """
    if places is not None:
        docs = docs.crossJoin(F.broadcast(places[0]))

    # the inner transforms see the tokens as a bound variable: they are made once a row
    def hashes(codes: Column, size: int, n_places: int = 0) -> Column:
        n = F.size(codes["plain"])
        starts = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
        if n_places:
            marked = [lambda i, c=c: F.get("marked", _place(_edge(codes[c], i, size), n_places)) for c in ("plain", "names")]
            starts = F.filter(starts, lambda i: marked[0](i) | marked[1](i))

        def both(i: Column) -> Column:
            plain, names = (F.xxhash64(F.lit(size), F.slice(codes[c], i + 1, size)) for c in ("plain", "names"))
            return F.struct(i.alias("at"), plain.alias("plain"), names.alias("names"))

        return F.transform(starts, both)

    def coded(tokens: Column) -> Column:
        return F.struct(_codes(tokens, False).alias("plain"), _codes(tokens, True).alias("names"))

    def with_values(tokens: Column) -> Column:
        return F.struct(_values(tokens).alias("plain"), _values(tokens).alias("names"))

    def windows(tokens: Column) -> Column:
        parts = [F.flatten(F.transform(F.array(coded(tokens)), lambda c: F.concat(*[hashes(c, s, places[1] if places else 0) for s in sizes])))] if sizes else []
        parts += [F.flatten(F.transform(F.array(with_values(tokens)), lambda c: F.concat(*[hashes(c, s) for s in valued])))] if valued else []
        return F.concat(*parts)

    rows = docs.select("id", "version", F.explode(F.flatten(F.transform(F.array(raw_tokens(F.col("text"))), windows))).alias("w"))
    plain, names = (F.struct(F.col(c).alias("hash"), F.lit(c == "w.names").alias("named")) for c in ("w.plain", "w.names"))
    ways = F.when(F.col("w.plain") == F.col("w.names"), F.array(plain)).otherwise(F.array(plain, names))
    rows = rows.select("id", "version", F.col("w.at").alias("at"), F.explode(ways).alias("way"))
    return rows.select("id", "version", "at", "way.hash", "way.named")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    literals: int = LITERALS,
    share: float = SHARE,
) -> DataFrame:
    """(id, version, item_id, matched, n_windows, slots, kind) of the pairs whose windows meet; ``kind`` as above."""
    asked = written(entries(benchmark, item, item_text), "decontaminate-entries")
    items = written(item_windows(asked, window, literals), "decontaminate-items")
    found = [tuple(r) for r in items.select("valued", "size").distinct().orderBy("size").collect()]  # at most ``window`` numbers each
    sizes, valued = ([size for v, size in found if v == which] for which in (False, True))
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    places = items.select("hash", "entry", F.col("at").alias("item_at"), "size", "opened", "n_windows")
    edges = items.filter("NOT valued").select(F.explode("edges").alias("edge")).distinct()
    n_edges = edges.limit(EDGES + 1).count()
    n_places = 1 << (PLACES_PER_EDGE * n_edges).bit_length()
    marked = (_marked(edges, n_places), n_places) if n_edges <= EDGES else None
    windows = _document_windows(texts.filter(F.col("text").isNotNull()), sizes if found else [window], valued, marked)
    if items.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        hits = windows.join(F.broadcast(places), "hash")
    else:
        windows = windows.withColumn("salt", F.pmod(F.xxhash64("version", "at"), F.lit(SALTS)).cast("int"))
        hits = windows.join(places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["hash", "salt"]).drop("salt")
    # a window that is there without names is there with them too
    with_names = F.col("opened") | F.col("named")
    hits = hits.withColumn("names", F.explode(F.when(with_names, F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))))
    # rows that repeat id and text give each window again: distinct places are kept
    aligned = hits.groupBy("id", "version", "entry", "names", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set("item_at").alias("places"), F.first("size").alias("size"), F.first("n_windows").alias("n_windows")
    )
    # each shift, with the windows of the shifts near it
    near = F.explode(F.sequence(F.lit(-DRIFT), F.lit(DRIFT)))
    aligned = aligned.withColumn("aside", near).withColumn("centre", F.col("shift") + F.col("aside"))
    aligned = aligned.groupBy("id", "version", "entry", "names", "centre").agg(
        F.max(F.col("aside") == 0).alias("own"),
        F.array_sort(F.collect_list(F.struct("shift", "places"))).alias("parts"),
        F.first("size").alias("size"),
        F.first("n_windows").alias("n_windows"),
    )
    aligned = aligned.filter("own").withColumn("matched", F.size(F.array_distinct(F.flatten("parts.places"))))
    aligned = aligned.filter(F.col("matched") >= share * F.col("n_windows"))
    pairs = aligned.groupBy("id", "version", "entry").agg(
        F.collect_list(F.struct("names", "centre", "matched", "parts")).alias("alignments"), F.first("size").alias("size"), F.first("n_windows").alias("n_windows")
    )
    pairs = written(pairs, "decontaminate-pairs")
    return _with_slots(pairs, texts, asked)


def _shift_at(place: Column, alignment: Column, size: Column) -> Column:
    """The shift of the alignment's window that is nearest to a place of the item; of equals, the one nearest to the centre."""

    def nearest(part: Column) -> Column:
        gaps = F.transform(part["places"], lambda at: F.greatest(at - place, place - (at + size - 1), F.lit(0)))
        return F.struct(F.array_min(gaps).alias("gap"), F.abs(part["shift"] - alignment["centre"]).alias("aside"), part["shift"].alias("shift"))

    return F.array_min(F.transform(alignment["parts"], nearest))["shift"]


def _with_slots(pairs: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """Compare the slots of each pair at its alignments, and keep the best of them."""
    wanted = pairs.select("id", "version").distinct()
    found = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"]) & (texts["version"] == wanted["version"]), "left_semi")
    found = found.dropDuplicates(["id", "version"]).select(F.col("id").alias("_id"), F.col("version").alias("_version"), raw_tokens(F.col("text")).alias("theirs"))
    asked = items.select(F.col("entry").alias("_entry"), F.col("item").alias("_item"), raw_tokens(F.col("text")).alias("ours"))
    asked = asked.select("_entry", "_item", F.filter(F.transform("ours", lambda o, i: F.struct(i.alias("at"), o.alias("o"))), lambda p: _is_slot(_shape(p["o"], True))).alias("ours"))
    rows = pairs.join(found, pairs["id"].eqNullSafe(F.col("_id")) & (pairs["version"] == F.col("_version"))).join(asked, F.col("entry") == F.col("_entry"))

    # slots that stand at the same place of the template
    def compared(alignment: Column) -> Column:
        both = F.transform("ours", lambda p: F.struct(p["o"].alias("o"), F.get("theirs", p["at"] + _shift_at(p["at"], alignment, F.col("size"))).alias("t")))
        names = alignment["names"]
        slots = F.filter(both, lambda p: p["t"].isNotNull() & _is_slot(_shape(p["o"], names)) & (_shape(p["o"], names) == _shape(p["t"], names)))
        # the same name, opening a sentence or within one
        slots = F.transform(slots, lambda p: F.struct(F.translate(p["o"], _O, _A).alias("o"), F.translate(p["t"], _O, _A).alias("t")))
        slots = F.array_distinct(slots)
        return F.struct(names.alias("names"), alignment["matched"].alias("matched"), alignment["centre"].alias("centre"), slots.alias("slots"))

    def judged(row: Column) -> Column:
        slots = row["slots"]
        n_slots = F.size(slots)
        one_to_one = (n_slots == F.size(F.array_distinct(slots["o"]))) & (n_slots == F.size(F.array_distinct(slots["t"])))
        kind = F.when(~F.exists(slots, lambda p: p["o"] != p["t"]), 2).when(one_to_one, 1).otherwise(0)
        return F.struct(kind.alias("kind"), (~row["names"]).alias("plain"), row["matched"].alias("matched"), (-row["centre"]).alias("before"), n_slots.alias("slots"))

    rows = rows.withColumn("compared", F.transform("alignments", compared)).withColumn("best", F.array_max(F.transform("compared", judged)))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("best.kind") + 1)
    return rows.select("id", "version", F.col("_item").alias("item_id"), "best.matched", "n_windows", "best.slots", kind.alias("kind"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, item_id, matched, n_windows, slots, kind) of all leaks, one row a document version and item text."""
    leaks = find_leaks(docs, benchmark, key, text, **options).filter("kind <> 'inconsistent'")
    return leaks.select(F.col("id").alias(key), "item_id", "matched", "n_windows", "slots", "kind")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a leak; all columns as they are."""
    leaks = find_leaks(docs, benchmark, key, text, **options).filter("kind <> 'inconsistent'")
    leaks = leaks.select(F.struct("id", "version").alias(LEAK)).distinct()
    return docs.join(leaks, F.struct(docs[key].alias("id"), F.xxhash64(docs[text]).alias("version")) == F.col(LEAK), "left_anti")
