"""Queries of chunkers, outlines and code structure, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import block_chunks as S
from corvane.operators import chunking as C
from corvane.plans.graph_queries import _PARTNERS, _partners
from corvane.sources import ranges as R
from corvane.sources import shared
from corvane.sources import tables as T

#: What a message of each role becomes in a source file; {w} is the message's first word and {t} its turn.
LISTING = {
    "user": "    def {w}_{t}(self, role: User):\n        if config.{w}:\n            self.a{t} = top({w})\n        elif self.size:\n            pass\n        else:\n            return None\n\n",
    "assistant": "    @later\n    async def answer_{t}(self):\n        try:\n            for r in self.rows:\n                yield r\n        except OSError:\n            return {w}()\n\n",
    "system": "    with open(config.{w}) as f:\n        x = f.read()\n",
}
HEAD, TAIL = "import os\nfrom roles import {w}\n\nclass Conv{c}:\n", "\n# end of {c}\ndef {w}():\n    return Conv{c}()\n"


def _code(s, d):
    """(id, content): conversations as source files, a class each with a method or block for every message. Its first word is that of the first message with a text."""
    # the one letter that Spark lowers to an "i" and a dot, where the SQL has an "i"
    lower = F.lower(F.translate("content", "İ", "i"))
    rows = T.messages(s, d).withColumn("w", F.regexp_extract(lower, "([a-z]{3,})", 1))

    def filled(text):
        for name, column in (("{w}", F.col("w")), ("{t}", F.col("turn").cast("string")), ("{c}", F.col("conv_id").cast("string"))):
            text = F.replace(text, F.lit(name), column)
        return text

    listing = F.lit("")
    for role, text in LISTING.items():
        listing = F.when(F.col("role") == role, filled(F.lit(text))).otherwise(listing)
    rows = rows.groupBy("conv_id").agg(F.min_by("w", F.when(F.col("w").isNotNull(), F.col("turn"))).alias("w"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", listing.alias("l")))), lambda x: x["l"]), "").alias("body")).withColumn("turn", F.lit(0))
    return rows.select(F.col("conv_id").alias("id"), F.concat(filled(F.lit(HEAD)), "body", filled(F.lit(TAIL))).alias("content"))


def _sections(s, d):
    """(section, content): each nation refers to its main partners."""
    return _partners(s, d).groupBy(F.col("source").alias("section")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("target")), lambda t: F.concat(F.lit("see section "), t)), "; ").alias("content"))


def _pages(s, d):
    return T.table(s, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content"))


def _kinds(s, d):
    kind = F.when(F.col("id") % 3 == 0, "markdown").when(F.col("id") % 3 == 1, "text").otherwise("other")
    return T.corpus(s, d).select("id", "content", kind.alias("kind")).unionByName(_code(s, d).select((-F.col("id")).alias("id"), "content", F.lit("python").alias("kind")))


def _text_files(s, d):
    """Path of the corpus as text files."""
    path = shared.shared_path(s, "texts")
    T.corpus(s, d).select("content").filter("content IS NOT NULL").write.text(path)
    return path


def _digest(rows):
    """Chunks by their place, lines, size and digest."""
    return rows.select(*[c for c in rows.columns if c != "content"], F.length("content").cast("bigint").alias("chars"), F.md5(F.col("content").cast("binary")).alias("digest"))


QUERIES = {
    "packed_chunks": lambda s, d: _digest(C.chunks(T.corpus(s, d), "lines", size=400, overlap=50)),
    "recursive_chunks": lambda s, d: _digest(C.chunks(T.corpus(s, d), "recursive", size=400)),
    "code_chunks": lambda s, d: C.chunks(_code(s, d), "code"),
    "chunks_by_kind": lambda s, d: _digest(C.by_kind(_kinds(s, d), 600)),
    "atomic_chunks": lambda s, d: _digest(S.structured_chunks(_pages(s, d), "html", 800, 2000)),
    "semantic_chunks": lambda s, d: _digest(S.structured_chunks(T.corpus(s, d), "lines", 600, 4000)),
    "code_unit_chunks": lambda s, d: _digest(S.structured_chunks(_code(s, d), "code_units", 300, 600)),
    "markdown_chunks": lambda s, d: _digest(S.markdown_chunks(T.corpus(s, d), 1500)),
    "lines_by_ranges": lambda s, d: R.read_lines(s, _text_files(s, d), 1 << 18).groupBy("encoding", F.md5(F.col("line").cast("binary")).alias("digest")).agg(F.count("*").alias("n"), F.max(F.length("line")).cast("bigint").alias("chars")),
    "line_strides": lambda s, d: _digest(C.strides(T.corpus(s, d), 300, 60)),
    "markdown_sections": lambda s, d: _digest(C.sections(T.corpus(s, d), r"^(# |@)")),
    "text_outline": lambda s, d: C.outline(T.corpus(s, d).select("id", "content").unionByName(_code(s, d).select((-F.col("id")).alias("id"), "content"))),
    "size_check": lambda s, d: T.corpus(s, d).select("id", C.summary(F.col("content"), 300).alias("x"), F.array_join(C.key_elements(F.col("content")), "|").alias("elements")).select(
        "id", "x.large", F.md5(F.col("x.head").cast("binary")).alias("digest"), "elements"
    ),
    "code_blocks": lambda s, d: C.blocks(_code(s, d)),
    "block_summaries": lambda s, d: C.block_texts(_code(s, d), C.blocks(_code(s, d))).select("id", "start_line", C.block_summary(F.col("kind"), F.col("content")).alias("summary")),
    "code_references": lambda s, d: C.code_references(_code(s, d)),
    "block_contexts": lambda s, d: C.with_context(C.blocks(_code(s, d)), C.code_references(_code(s, d))).select("id", "start_line", "kind", "context"),
    "followed_references": lambda s, d: C.followed_references(_sections(s, d), s.createDataFrame([("NATION_5",)], "section string")),
}


def _text(value):
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _filled_sql(text):
    return f"replace(replace(replace({_text(text)}, '{{w}}', w), '{{t}}', turn::VARCHAR), '{{c}}', conv_id::VARCHAR)"


_CODE = f"""cw AS (SELECT conv_id, turn, role, regexp_extract(lower(text), '([a-z]{{3,}})', 1) AS w FROM conversations),
cl AS (SELECT conv_id, turn, w, CASE role {' '.join(f"WHEN '{r}' THEN {_filled_sql(t)}" for r, t in LISTING.items())} ELSE '' END AS l FROM cw),
cg AS (SELECT conv_id, 0 AS turn, arg_min(w, turn) AS w, string_agg(l, '' ORDER BY turn) AS body FROM cl GROUP BY conv_id),
code(id, content) AS (SELECT conv_id, {_filled_sql(HEAD)} || body || {_filled_sql(TAIL)} FROM cg)"""
_DIGEST = "length(content) AS chars, md5(content) AS digest"
_LINES = "l AS (SELECT id, generate_subscripts(ls, 1) AS line, unnest(ls) AS text FROM (SELECT id, string_split(content, chr(10)) AS ls FROM {}))"
#: From the definition: a block ends before the next line that isn't deeper and doesn't carry it on.
_BLOCKS = f"""{_CODE}, {_LINES.format('code')}, t AS (SELECT id, line, trim(text) AS body, length(text) - length(ltrim(text)) AS indent FROM l WHERE trim(text) <> ''),
o AS (SELECT *, CASE WHEN regexp_matches(body, '^class\\s') THEN 'class' WHEN regexp_matches(body, '^(async\\s+)?def\\s') THEN 'function' WHEN regexp_matches(body, '^if\\b') THEN 'if' WHEN regexp_matches(body, '^try\\s*:') THEN 'try'
  WHEN regexp_matches(body, '^(async\\s+)?(for|while)\\b') THEN 'loop' WHEN regexp_matches(body, '^(async\\s+)?with\\b') THEN 'with' END AS kind FROM t),
e AS (SELECT o.id, o.kind, o.line, o.indent, o.body, min(CASE WHEN t.indent < o.indent OR (t.indent = o.indent AND NOT regexp_matches(t.body, '^(elif|else|except|finally)\\b')) THEN t.line END) AS stop
  FROM o LEFT JOIN t ON t.id = o.id AND t.line > o.line WHERE kind IS NOT NULL GROUP BY ALL),
b AS (SELECT e.id, kind, regexp_extract(e.body, '^(?:class|(?:async\\s+)?def)\\s+(\\w+)', 1) AS name, e.line AS start_line, max(t.line) AS end_line FROM e JOIN t ON t.id = e.id AND t.line >= e.line AND t.line < coalesce(stop, 1000000) GROUP BY ALL)"""
_REFS = f"""{_CODE}, {_LINES.format('code')}, r AS (SELECT id, 'import' AS kind, unnest(regexp_extract_all(text, '^(?:from|import)\\s+([\\w.]+)', 1)) AS name, line FROM l
  UNION SELECT id, 'attribute', unnest(regexp_extract_all(text, 'self\\.(\\w+)', 1)), line FROM l UNION SELECT id, 'config', unnest(regexp_extract_all(text, 'config\\.(\\w+)', 1)), line FROM l
  UNION SELECT id, 'type', unnest(regexp_extract_all(text, ':\\s*([A-Z]\\w+)', 1)), line FROM l)"""

SQL = {
    "lines_by_ranges": "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT 'utf-8' AS encoding, md5(line) AS digest, count(*) AS n, max(length(line)) AS chars FROM l GROUP BY 2",
    "line_strides": f"""WITH s AS (SELECT doc_id AS id, unnest(range(0, greatest(length(text) - 60 - 1, 0) + 1, 240)) AS p, text FROM documents WHERE length(text) > 0), c AS (SELECT id, p // 240 AS idx, substr(text, p + 1, 300) AS content FROM s)
      SELECT id, idx, {_DIGEST} FROM c""",
    "markdown_sections": f"""WITH {_LINES.format('(SELECT doc_id AS id, text AS content FROM documents)')}, i AS (SELECT *, sum(regexp_matches(text, '^(# |@)')::INT) OVER (PARTITION BY id ORDER BY line) AS idx FROM l),
      c AS (SELECT id, idx::BIGINT AS idx, min(line) AS start_line, max(line) AS end_line, string_agg(text, chr(10) ORDER BY line) AS content FROM i GROUP BY ALL) SELECT id, idx, start_line, end_line, {_DIGEST} FROM c""",
    "text_outline": f"""WITH {_CODE}, d AS (SELECT doc_id AS id, text AS content FROM documents UNION ALL SELECT -id, content FROM code), {_LINES.format('d')}, t AS (SELECT id, line, trim(text, ' ') AS text FROM l),
      k AS (SELECT id, line, CASE WHEN regexp_matches(text, '^(async\\s+)?(def|function)\\s') THEN 'function' WHEN regexp_matches(text, '^class\\s') THEN 'class' WHEN regexp_matches(text, '^#{{1,6}} ') THEN 'heading'
        WHEN starts_with(text, '#') OR starts_with(text, '//') THEN 'comment' END AS kind, text FROM t) SELECT * FROM k WHERE kind IS NOT NULL""",
    "size_check": """SELECT doc_id AS id, length(text) // 4 > 300 AS large, md5(CASE WHEN length(text) // 4 > 300 THEN left(text, 1200) ELSE text END) AS digest,
      array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '^((async\\s+)?def|function|class)\\s|^#{1,6} '))[1:10], '|') AS elements FROM documents""",
    "code_blocks": f"WITH {_BLOCKS} SELECT id, kind, name, start_line, end_line, (SELECT count(*) FROM b x WHERE x.id = b.id AND x.start_line < b.start_line AND b.end_line <= x.end_line) AS depth FROM b",
    "block_summaries": f"""WITH {_BLOCKS}, c AS (SELECT b.*, array_to_string(string_split(content, chr(10))[start_line:end_line], chr(10)) AS text FROM b JOIN code USING (id))
      SELECT id, start_line, trim(string_split(text, chr(10))[1]) || ' | lines ' || len(string_split(text, chr(10))) || ' | if ' || (len(string_split(text, 'if ')) - 1) || ' | try ' || (len(string_split(text, 'try:')) - 1)
        || CASE WHEN kind = 'class' THEN ' | methods ' || array_to_string(regexp_extract_all(text, 'def\\s+(\\w+)', 1)[1:5], ', ') ELSE '' END AS summary FROM c""",
    "code_references": f"WITH {_REFS} SELECT * FROM r",
    "block_contexts": f"""WITH {_BLOCKS}, m AS (SELECT id, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(text, '^(?:from|import)\\s+([\\w.]+)', 1))))), ', ') AS imports FROM l GROUP BY 1),
      w AS (SELECT b.id, b.start_line, b.kind, (SELECT arg_max(x.name, x.start_line) FROM b x WHERE x.id = b.id AND x.kind = 'class' AND x.start_line < b.start_line AND b.end_line <= x.end_line) AS owner FROM b)
      SELECT id, start_line, kind, concat_ws(' / ', CASE WHEN imports <> '' THEN 'imports ' || imports END, 'class ' || owner) AS context FROM w JOIN m USING (id)""",
    "followed_references": f"WITH RECURSIVE {_PARTNERS}, w(section, depth) AS (SELECT 'NATION_5', 0 UNION SELECT e.target, depth + 1 FROM w JOIN e ON section = e.source WHERE depth < 3) SELECT section, min(depth) AS depth FROM w GROUP BY 1",
}
