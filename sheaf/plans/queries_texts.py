"""Queries over texts: cleaning, chunking, references, retrieval."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf import schemas
from sheaf.functions import sql
from sheaf.functions import text as X
from sheaf.functions.session import checkpoint_dir, materialise
from sheaf.operators import cells, chunking, refs, retrieval
from sheaf.plans import index
from sheaf.plans.inputs import Inputs
from sheaf.plans.registry import EXPECTED, QUERIES, query
from sheaf.sources import tables

TAIL = r"[.!?]$"
RATIO = 0.04
# white space of the given texts
_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8239) || chr(12288))"
_NUMBER = r"^-?\s*\d+\s*-?$|^第\s*\d+\s*頁$|^\d+\s*/\s*\d+$"
_HEADS = "^第[一二三四五六七八九十百]+條|^[一二三四五六七八九十]+、|^[（(][一二三四五六七八九十]+[）)]|^[0-9]+[.、]"

EXPECTED.update(
    lines_x="""
        SELECT doc_id, page_no, i - 1 AS line_no, line FROM
          (SELECT source AS doc_id, doc_id AS page_no, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)""",
    unnumbered_x=f"SELECT *, {_STRIP.format('line')} AS s FROM lines_x WHERE NOT regexp_matches({_STRIP.format('line')}, '{_NUMBER}')",
    boiler_x=f"""
        SELECT l.doc_id, l.s AS line, count(DISTINCT l.page_no) AS n FROM unnumbered_x l
        JOIN (SELECT source AS doc_id, count(*) AS n_pages FROM documents GROUP BY source) d USING (doc_id)
        WHERE l.s <> '' AND n_pages >= 3 GROUP BY l.doc_id, l.s HAVING count(DISTINCT l.page_no) / any_value(n_pages) >= {RATIO}""",
    kept_x="SELECT u.* FROM unnumbered_x u LEFT JOIN boiler_x b ON b.doc_id = u.doc_id AND b.line = u.s WHERE b.doc_id IS NULL AND u.s <> ''",
    wrapped_x=f"""
        SELECT doc_id, page_no, min(line_no) AS line_no, string_agg(s, '' ORDER BY line_no) AS line FROM (
          SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS g FROM (
            SELECT *, coalesce(regexp_matches(lag(s) OVER w, '[.!?]$'), true) OR regexp_matches(s, '{_HEADS}') AS opens FROM kept_x WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no)))
        GROUP BY doc_id, page_no, g""",
)


@query("page_line_source", "SRC-04", r"""
    SELECT doc_id, count(*) AS n_lines, max(page_no) + 1 AS n_pages, sum(length(line))::BIGINT AS n_chars FROM (
      SELECT doc_id, page_no, unnest(string_split(page, chr(10))) AS line FROM (
        SELECT doc_id, unnest(generate_series(0, len(ps) - 1)) AS page_no, unnest(ps) AS page FROM (
          SELECT doc_id, string_split(replace(text, '.' || chr(10), '.' || chr(12)), chr(12)) AS ps FROM documents)))
    GROUP BY doc_id""")
def page_line_source(x: Inputs) -> DataFrame:
    """Whole texts, a page ending where a line ends with a full stop."""
    docs = x.table("documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\f")).alias("text"))
    lines = tables.page_lines(docs)
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), (F.max("page_no") + 1).alias("n_pages"), F.sum(F.length("line")).alias("n_chars")
    )


@query("page_line_files", "SRC-04", r"""
    SELECT source AS doc_id, count(*) AS n_lines, max(page_no) + 1 AS n_pages, sum(length(line))::BIGINT AS n_chars,
           sum((page_no + 1) * (length(line) + 1))::BIGINT AS by_page, sum((line_no + 1) * (length(line) + 1))::BIGINT AS by_line FROM (
      SELECT source, page_no, unnest(generate_series(0, len(ls) - 1)) AS line_no, unnest(ls) AS line FROM (
        SELECT source, page_no, string_split(replace(replace(page, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM (
          SELECT source, unnest(generate_series(0, len(ps) - 1)) AS page_no, unnest(ps) AS page FROM (
            SELECT source, string_split(string_agg(coalesce(text, '') || chr(12), '' ORDER BY doc_id, coalesce(text, '')), chr(12)) AS ps FROM documents GROUP BY source))))
    GROUP BY source""")
def page_line_files(x: Inputs) -> DataFrame:
    """A text file per source, each document a page, read back in splits of a few hundred kilobytes."""
    path = f"{checkpoint_dir(x.spark).rstrip('/')}/pages-{uuid.uuid4()}"
    texts = x.table("documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    texts.repartition("source").sortWithinPartitions("source", "doc_id", "value").drop("doc_id").write.partitionBy("source").option("lineSep", "\f").text(path)
    lines = tables.read_page_lines(x.spark, path, split_bytes=1 << 18, name=F.col("source"))
    size = F.length("line").cast("bigint")
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), (F.max("page_no") + 1).alias("n_pages"), F.sum(size).alias("n_chars"),
        F.sum((F.col("page_no") + 1) * (size + 1)).alias("by_page"), F.sum((F.col("line_no") + 1) * (size + 1)).alias("by_line"),
    )


@query("page_number_lines", "TXT-01", "SELECT doc_id, count(*) AS n, sum(length(line))::BIGINT AS chars FROM unnumbered_x GROUP BY doc_id")
def page_number_lines(x: Inputs) -> DataFrame:
    kept = chunking.drop_page_numbers(x.page_lines())
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


@query("boilerplate_lines", "TXT-02", "SELECT doc_id, line, n FROM boiler_x")
def boilerplate_lines(x: Inputs) -> DataFrame:
    return chunking.boilerplate_lines(chunking.drop_page_numbers(x.page_lines()), x.page_docs(), RATIO)


def _kept(x: Inputs) -> DataFrame:
    return chunking.drop_boilerplate(chunking.drop_page_numbers(x.page_lines()), x.page_docs(), RATIO)


@query("join_wrapped_lines", "TXT-03", "SELECT * FROM wrapped_x")
def join_wrapped_lines(x: Inputs) -> DataFrame:
    return chunking.join_wrapped(_kept(x), TAIL)


@query("flat_line_stream", "TXT-04", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, line_no) - 1 AS line_no, line FROM wrapped_x")
def flat_line_stream(x: Inputs) -> DataFrame:
    return chunking.flatten_lines(chunking.join_wrapped(_kept(x), TAIL))


# ---- chunking --------------------------------------------------------------

_CN = "substr('一二三四五六七八九十', {0} + 1, 1)"
EXPECTED["outline_lines_x"] = f"""
    SELECT doc_id, page_no * 100000 + line_no AS line_no, {_STRIP.format('t')} AS line FROM (
      SELECT *, CASE WHEN line_no = 0 THEN {_CN.format('page_no % 10')} || '、' || line
                     WHEN line_no % 9 = 4 THEN '（' || {_CN.format('line_no % 7')} || '）' || line
                     WHEN line_no % 4 = 2 THEN line_no || '. ' || line ELSE line END AS t FROM lines_x) WHERE {_STRIP.format('t')} <> ''"""
EXPECTED["article_lines_x"] = f"""
    SELECT doc_id, page_no * 100000 + line_no AS line_no, {_STRIP.format('t')} AS line FROM (
      SELECT *, CASE WHEN line_no = 1 THEN '第' || {_CN.format('page_no % 10')} || '條 ' || line ELSE line END AS t FROM lines_x) WHERE {_STRIP.format('t')} <> ''"""


def _docs(x: Inputs) -> DataFrame:
    return x.page_docs().select("doc_id", F.upper("doc_id").alias("reg_code"), F.lit("title").alias("reg_title"), "n_pages")


def _article_lines(x: Inputs) -> DataFrame:
    one = F.substr(F.lit("一二三四五六七八九十"), (F.col("page_no") % 10 + 1).cast("int"), F.lit(1))
    line = F.when(F.col("line_no") == 1, F.concat(F.lit("第"), one, F.lit("條 "), F.col("line"))).otherwise(F.col("line"))
    return x.page_lines().select("doc_id", (F.col("page_no") * 100000 + F.col("line_no")).alias("line_no"), line.alias("line"))


@query(
    "article_chunks", "TXT-05 TXT-11 TXT-12",
    r"""SELECT upper(doc_id) || ':' || path || ':0' AS chunk_id, path AS section_path, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS "order",
           '【' || upper(doc_id) || ' title|' || path || '】' || chr(10) || coalesce(body, '') AS text FROM (
        SELECT doc_id, g, max(CASE WHEN is_head THEN regexp_extract(line, '^(第[一二三四五六七八九十百]+條)', 1) END) AS path,
               string_agg(CASE WHEN is_head THEN nullif(regexp_extract(line, '^第[一二三四五六七八九十百]+條[\s　]*(.*)$', 1), '') ELSE line END, chr(10) ORDER BY line_no) AS body FROM (
          SELECT *, max(CASE WHEN is_head THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM (
            SELECT *, regexp_matches(line, '^第[一二三四五六七八九十百]+條') AS is_head FROM article_lines_x)) WHERE g IS NOT NULL GROUP BY doc_id, g)""",
)
def article_chunks(x: Inputs) -> DataFrame:
    return chunking.chunk_articles(_article_lines(x), _docs(x)).select("chunk_id", "section_path", "order", "text")


EXPECTED["tagged_x"] = """
    SELECT doc_id, line_no, line, l1, l2, CASE WHEN l2 IS NOT NULL AND r3 > l2 THEN r3 END AS l3 FROM (
      SELECT *, CASE WHEN r2 > l1 THEN r2 END AS l2 FROM (
        SELECT *, max(CASE WHEN a THEN line_no END) OVER w AS l1, max(CASE WHEN b AND NOT a THEN line_no END) OVER w AS r2,
               max(CASE WHEN c AND NOT a AND NOT b THEN line_no END) OVER w AS r3 FROM (
          SELECT *, regexp_matches(line, '^[一二三四五六七八九十]+、') AS a, regexp_matches(line, '^[（(][一二三四五六七八九十]+[）)]') AS b, regexp_matches(line, '^[0-9]+[.、]') AS c FROM outline_lines_x)
        WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))) WHERE l1 IS NOT NULL"""


@query("outline_tags", "TXT-06", "SELECT doc_id, line_no, l1, l2, l3 FROM tagged_x")
def outline_tags(x: Inputs) -> DataFrame:
    return chunking.tag_outline(x.outline_lines()).select("doc_id", "line_no", "l1", "l2", "l3")


# bodies of the outline before sentence packing
EXPECTED["nodes_x"] = r"""
    SELECT doc_id, l1, l2, regexp_extract(max(CASE WHEN line_no = l1 THEN line END), '^([一二三四五六七八九十]+)、', 1) AS n1,
           max(CASE WHEN line_no = l2 THEN line END) AS raw2,
           string_agg(CASE WHEN l3 IS NULL AND line_no <> l1 AND line_no IS DISTINCT FROM l2 THEN line END, chr(10) ORDER BY line_no) AS intro,
           coalesce(string_agg(CASE WHEN line_no <> l1 AND line_no IS DISTINCT FROM l2 THEN line END, chr(10) ORDER BY line_no), '') AS inline,
           count(DISTINCT l3) AS n3
    FROM tagged_x GROUP BY doc_id, l1, l2"""
EXPECTED["tops_x"] = "SELECT doc_id, l1, max(n1) AS n1 FROM nodes_x WHERE l2 IS NULL GROUP BY doc_id, l1"
EXPECTED["bare_x"] = "SELECT doc_id, l1, l2, raw2 FROM nodes_x WHERE l2 IS NOT NULL AND length(raw2) < 30 AND intro IS NULL AND n3 = 0"
EXPECTED["bodies_x"] = r"""
    SELECT n.doc_id, n.l1 AS first_line, -1 AS rank, t.n1 AS path, n.intro || coalesce(chr(10) || b.titles, '') AS body, false AS may_split
    FROM nodes_x n JOIN tops_x t USING (doc_id, l1) LEFT JOIN (SELECT doc_id, l1, string_agg(raw2, chr(10) ORDER BY l2) AS titles FROM bare_x GROUP BY doc_id, l1) b USING (doc_id, l1)
    WHERE n.l2 IS NULL AND n.intro IS NOT NULL
    UNION ALL
    SELECT n.doc_id, n.l2, -1, t.n1 || '/(' || regexp_extract(n.raw2, '^[（(]([一二三四五六七八九十]+)[）)]', 1) || ')',
           CASE WHEN length(n.inline) > 800 AND n.n3 > 0 THEN n.intro ELSE n.inline END, true
    FROM nodes_x n JOIN tops_x t USING (doc_id, l1)
    WHERE n.l2 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bare_x b WHERE b.doc_id = n.doc_id AND b.l2 = n.l2) AND NOT (length(n.inline) > 800 AND n.n3 > 0 AND n.intro IS NULL)
    UNION ALL
    SELECT n.doc_id, n.l2, s.l3, t.n1 || '/(' || regexp_extract(n.raw2, '^[（(]([一二三四五六七八九十]+)[）)]', 1) || ')/' || s.num, s.body, true
    FROM nodes_x n JOIN tops_x t USING (doc_id, l1)
    JOIN (SELECT doc_id, l2, l3, max(CASE WHEN line_no = l3 THEN regexp_extract(line, '^([0-9]+)[.、]', 1) END) AS num,
                 string_agg(CASE WHEN line_no = l3 THEN regexp_extract(line, '^[0-9]+[.、][\s　]*(.*)$', 1) ELSE line END, chr(10) ORDER BY line_no) AS body
          FROM tagged_x WHERE l3 IS NOT NULL GROUP BY doc_id, l2, l3) s ON s.doc_id = n.doc_id AND s.l2 = n.l2
    WHERE length(n.inline) > 800"""
# greedy packing by a recursion over sentences; splitting by full stops
_PACK = """
    WITH RECURSIVE sent AS (
      SELECT {keys}, unnest(generate_series(1, n)) AS i, unnest(list_transform(generate_series(1, n), lambda j: CASE WHEN j < n0 THEN parts[j] || '.' ELSE parts[j] END)) AS s FROM (
        SELECT {keys}, string_split(body, '.') AS parts, len(string_split(body, '.')) AS n0,
               len(string_split(body, '.')) - CASE WHEN body LIKE '%.' OR body = '' THEN 1 ELSE 0 END AS n FROM ({source}))),
    pack AS (
      SELECT {keys}, i, length(s) AS open, 0 AS piece FROM sent WHERE i = 1
      UNION ALL
      SELECT {sent_keys}, t.i, CASE WHEN p.open > 0 AND p.open + length(t.s) > 800 THEN length(t.s) ELSE p.open + length(t.s) END,
             p.piece + CASE WHEN p.open > 0 AND p.open + length(t.s) > 800 THEN 1 ELSE 0 END
      FROM pack p JOIN sent t ON {on} AND t.i = p.i + 1)"""


@query(
    "outline_chunks", "TXT-06 TXT-07 TXT-08 TXT-09 TXT-10 TXT-11 TXT-12",
    _PACK.format(
        keys="doc_id, first_line, rank, path", sent_keys="t.doc_id, t.first_line, t.rank, t.path",
        on="t.doc_id = p.doc_id AND t.first_line = p.first_line AND t.rank = p.rank",
        source="SELECT * FROM bodies_x WHERE may_split AND length(body) > 800",
    )
    + """
    SELECT upper(doc_id) AS reg_code, path AS section_path, chunk_seq, row_number() OVER (PARTITION BY doc_id ORDER BY first_line, rank, chunk_seq) - 1 AS "order", body FROM (
      SELECT doc_id, first_line, rank, path, CAST(piece AS BIGINT) AS chunk_seq, string_agg(s, '' ORDER BY i) AS body
      FROM pack JOIN sent USING (doc_id, first_line, rank, path, i) GROUP BY doc_id, first_line, rank, path, piece
      UNION ALL
      SELECT doc_id, first_line, rank, path, 0, body FROM bodies_x WHERE NOT (may_split AND length(body) > 800))""",
)
def outline_chunks(x: Inputs) -> DataFrame:
    chunks = chunking.chunk_outline(x.outline_lines(), _docs(x), sep=".")
    body = F.substr(F.col("text"), F.locate("\n", F.col("text")) + 1)
    return chunks.select("reg_code", "section_path", "chunk_seq", "order", body.alias("body"))


@query(
    "pure_titles", "TXT-07",
    """SELECT n.doc_id, n.l1, n.intro || coalesce(chr(10) || titles, '') AS intro FROM nodes_x n
       LEFT JOIN (SELECT doc_id, l1, string_agg(raw2, chr(10) ORDER BY l2) AS titles FROM bare_x GROUP BY doc_id, l1) b USING (doc_id, l1)
       WHERE n.l2 IS NULL AND n.intro IS NOT NULL""",
)
def pure_titles(x: Inputs) -> DataFrame:
    folded = chunking.fold_pure_titles(chunking.outline_nodes(chunking.tag_outline(x.outline_lines())))
    return folded.filter(F.col("l2").isNull() & F.col("intro").isNotNull()).select("doc_id", "l1", "intro")


@query(
    "sentence_pack", "TXT-09 TXT-10",
    _PACK.format(keys="doc_id", sent_keys="t.doc_id", on="t.doc_id = p.doc_id", source="SELECT doc_id, text AS body FROM documents")
    + " SELECT doc_id, CAST(piece AS BIGINT) AS piece_no, string_agg(s, '' ORDER BY i) AS piece FROM pack JOIN sent USING (doc_id, i) GROUP BY doc_id, piece",
)
def sentence_pack(x: Inputs) -> DataFrame:
    pieces = chunking.pack_sentences(F.col("text"), sep=".")
    return x.table("documents").select("doc_id", F.posexplode(pieces).alias("piece_no", "piece"))


@query(
    "chunk_stats_rollup", "TXT-13",
    """SELECT lang AS reg_code, count(*) AS n_chunks, sum(length(text) - length(string_split(text, chr(10))[1]))::BIGINT AS body_chars,
              max(length(text) - length(string_split(text, chr(10))[1])) AS longest_body FROM documents GROUP BY ROLLUP (lang)""",
)
def chunk_stats_rollup(x: Inputs) -> DataFrame:
    return chunking.chunk_stats(x.table("documents").select(F.col("lang").alias("reg_code"), "text"))


EXPECTED["reg_raw_x"] = f"""
    SELECT doc_id, page_no, line_no, {_STRIP.format('t')} AS s FROM (
      SELECT *, CASE WHEN line_no = 0 THEN {_CN.format('page_no % 10')} || '、' || line WHEN line_no = 1 THEN '第一條 ' || line
                     WHEN line_no % 9 = 4 THEN '（' || {_CN.format('line_no % 7')} || '）' || line
                     WHEN line_no % 4 = 2 THEN line_no || '. ' || line ELSE line END AS t FROM lines_x WHERE doc_id NOT IN ('src18', 'src19'))"""
EXPECTED["reg_kept_x"] = f"""
    SELECT * FROM (SELECT * FROM reg_raw_x WHERE s <> '' AND NOT regexp_matches(s, '{_NUMBER}')) u WHERE NOT EXISTS (
      SELECT 1 FROM (SELECT doc_id, s FROM (SELECT doc_id, s, count(DISTINCT page_no) AS n FROM reg_raw_x WHERE s <> '' AND NOT regexp_matches(s, '{_NUMBER}') GROUP BY doc_id, s)
        JOIN (SELECT source AS doc_id, count(*) AS n_pages FROM documents GROUP BY source) USING (doc_id) WHERE n_pages >= 3 AND n / n_pages >= 0.6) b WHERE b.doc_id = u.doc_id AND b.s = u.s)"""
EXPECTED["reg_lines_x"] = f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, line_no) AS line_no, line FROM (
      SELECT doc_id, page_no, min(line_no) AS line_no, string_agg(s, '' ORDER BY line_no) AS line FROM (
        SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS g FROM (
          SELECT *, coalesce(regexp_matches(lag(s) OVER w, '[。：；！？]$'), true) OR regexp_matches(s, '{_HEADS}') AS opens FROM reg_kept_x WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no)))
      GROUP BY doc_id, page_no, g)"""
for _a in ("tagged", "nodes", "tops", "bare", "bodies"):
    _text = EXPECTED[f"{_a}_x"]
    for _name in ("outline_lines", "tagged", "nodes", "tops", "bare"):
        _text = _text.replace(f"{_name}_x", "reg_lines_x" if _name == "outline_lines" else f"reg_{_name}_x")
    EXPECTED[f"reg_{_a}_x"] = _text


@query(
    "registered_documents", "TXT-14 SRC-05",
    r"""SELECT upper(doc_id) AS reg_code, count(*) AS n_chunks, sum(length(body) + 1)::BIGINT AS body_chars, max(length(body) + 1) AS longest_body FROM (
          SELECT doc_id, body FROM reg_bodies_x WHERE CAST(substr(doc_id, 4) AS INT) % 3 <> 0
          UNION ALL
          SELECT doc_id, coalesce(string_agg(CASE WHEN is_head THEN nullif(regexp_extract(line, '^第[一二三四五六七八九十百]+條[\s　]*(.*)$', 1), '') ELSE line END, chr(10) ORDER BY line_no), '') FROM (
            SELECT *, max(CASE WHEN is_head THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM (
              SELECT *, regexp_matches(line, '^第[一二三四五六七八九十百]+條') AS is_head FROM reg_lines_x WHERE CAST(substr(doc_id, 4) AS INT) % 3 = 0)) WHERE g IS NOT NULL GROUP BY doc_id, g)
        GROUP BY ROLLUP (upper(doc_id))""",
)
def registered_documents(x: Inputs) -> DataFrame:
    """Chunks per document of a registry of both styles; unknown codes drop out."""
    registry = {f"SRC{i}": "article" if i % 3 == 0 else "chapter" for i in range(0, 18)}
    lines = x.headed_lines()
    article = F.when(F.col("line_no") == 1, F.concat(F.lit("第一條 "), F.col("line"))).otherwise(F.col("line"))
    chunks = chunking.chunk_documents(lines.withColumn("line", article), _docs(x), registry)
    return chunking.chunk_stats(chunks)


# ---- references ------------------------------------------------------------

EXPECTED["entries_x"] = r"""
    SELECT item_id, k, e, regexp_extract(e, '^(R[0-9]{2}([&、]R[0-9]{2})*)', 1) AS head FROM (
      SELECT item_id, k, array_to_string(list_filter(list_transform(string_split(translate(s, 'Ｒ０１２３４５６７８９／（）', 'R0123456789/()'), '/'), lambda v: trim(v)), lambda v: v <> ''), '/') AS e FROM (
        SELECT item_id, unnest(generate_series(0, len(string_split(raw, ';')) - 1)) AS k, unnest(string_split(raw, ';')) AS s FROM ref_texts WHERE raw IS NOT NULL)) WHERE e <> ''"""
EXPECTED["refs_x"] = r"""
    SELECT item_id, k * 2147483648 + j AS ref_idx, code AS reg_code, CASE WHEN substr(e, length(head) + 1, 1) = '/' THEN substr(e, length(head) + 2) ELSE '' END AS section_path_prefix FROM (
      SELECT *, unnest(generate_series(0, len(cs) - 1)) AS j, unnest(cs) AS code FROM (SELECT *, regexp_extract_all(head, 'R[0-9]{2}') AS cs FROM entries_x WHERE head <> ''))"""


@query("parse_refs", "REF-01 REF-02 REF-03", "SELECT * FROM refs_x")
def parse_refs(x: Inputs) -> DataFrame:
    return refs.parse_refs(x.get("ref_texts"), ["item_id"], "raw")


@query("dropped_refs", "REF-04", "SELECT r.item_id, count(e.e) FILTER (e.head = '') AS dropped FROM ref_texts r LEFT JOIN entries_x e USING (item_id) GROUP BY r.item_id")
def dropped_refs(x: Inputs) -> DataFrame:
    return refs.dropped_refs(x.get("ref_texts"), ["item_id"], "raw")


_BELOW = "(r.section_path_prefix = '' OR c.section_path = r.section_path_prefix OR starts_with(c.section_path, r.section_path_prefix || '/'))"


@query(
    "path_lookup", "SRC-13",
    f"""SELECT item_id, ref_idx, chunk_id, pos, n_chunks FROM (
          SELECT r.item_id, r.ref_idx, c.chunk_id, row_number() OVER (PARTITION BY r.item_id, r.ref_idx ORDER BY c."order") AS pos, count(*) OVER (PARTITION BY r.item_id, r.ref_idx) AS n_chunks
          FROM refs_x r JOIN reg_chunks c ON c.reg_code = r.reg_code AND {_BELOW}) WHERE pos <= 3""",
)
def path_lookup(x: Inputs) -> DataFrame:
    parsed = refs.parse_refs(x.get("ref_texts"), ["item_id"], "raw")
    return tables.lookup(x.get("reg_chunks"), parsed).select("item_id", "ref_idx", "chunk_id", "pos", "n_chunks")


@query(
    "prefix_match", "REF-05",
    f"""SELECT r.item_id, r.ref_idx, count(*) AS n_chunks FROM refs_x r JOIN reg_chunks c ON c.reg_code = r.reg_code
          AND ({_BELOW} OR starts_with(r.section_path_prefix, c.section_path || '/')) GROUP BY r.item_id, r.ref_idx""",
)
def prefix_match(x: Inputs) -> DataFrame:
    parsed = refs.parse_refs(x.get("ref_texts"), ["item_id"], "raw")
    return refs.match_counts(parsed, x.get("reg_chunks"), ["item_id", "ref_idx"])


@query(
    "sql_references", "REF-01 REF-02 REF-03 REF-07",
    """SELECT item_id, ref_idx, reg_code, section_path_prefix, len(l) AS depth,
         CASE len(l) WHEN 0 THEN reg_code WHEN 1 THEN reg_code || ' ' || l[1]
           ELSE reg_code || ' ' || l[1] || '、' || l[2] || coalesce(array_to_string(list_transform(l[3:], lambda v: CASE WHEN starts_with(v, '(') THEN v ELSE ' ' || v END), ''), '') END AS shown
       FROM (SELECT *, list_filter(string_split(section_path_prefix, '/'), lambda v: v <> '') AS l FROM refs_x)""",
)
def sql_references(x: Inputs) -> DataFrame:
    """References read and shown in SQL alone."""
    sql.register_functions(x.spark)
    tables.register_views({"ref_texts": x.get("ref_texts")}, "sheaf_")
    return x.spark.sql("""
        SELECT item_id, ref_idx, reg_code, section_path_prefix, size(ancestors(section_path_prefix)) AS depth,
               display_ref(reg_code, section_path_prefix) AS shown
        FROM (SELECT item_id, parse_refs(raw) AS found FROM sheaf_ref_texts)
             LATERAL VIEW inline(found) AS ref_idx, reg_code, section_path_prefix""")


@query(
    "sql_sentences", "TXT-09 JDG-06",
    """SELECT lang, count(*) AS n_sentences, max(length(s)) AS longest, sum(length(w) + (length(s) - length(w)) // 4)::BIGINT AS tokens FROM (
         SELECT lang, s, regexp_replace(s, '[^一-鿿　-ヿ]', '', 'g') AS w FROM (
           SELECT lang, CASE WHEN i < len(ps) THEN ps[i] || '.' ELSE ps[i] END AS s FROM (
             SELECT lang, ps, unnest(generate_series(1, len(ps))) AS i FROM (SELECT lang, string_split(text, '.') AS ps FROM documents WHERE text IS NOT NULL))) WHERE s <> '')
       GROUP BY lang""",
)
def sql_sentences(x: Inputs) -> DataFrame:
    """Sentences per language, counted in SQL alone."""
    sql.register_functions(x.spark)
    tables.register_views({"documents": x.table("documents")}, "sheaf_")
    return x.spark.sql("""
        SELECT lang, count(*) AS n_sentences, max(length(sentence)) AS longest, sum(estimate_tokens(sentence)) AS tokens
        FROM (SELECT lang, split_sentences(text, '.') AS sentences FROM sheaf_documents) LATERAL VIEW explode(sentences) AS sentence
        GROUP BY lang""")


EXPECTED["curated_x"] = f"""
    SELECT item_id AS key, row_number() OVER (PARTITION BY item_id ORDER BY ref_idx, pos) AS pos, reg_code, section_path, title, text AS excerpt FROM (
      SELECT r.item_id, r.ref_idx, c.*, row_number() OVER (PARTITION BY r.item_id, r.ref_idx ORDER BY c."order") AS pos
      FROM refs_x r JOIN reg_chunks c ON c.reg_code = r.reg_code AND {_BELOW}) WHERE pos <= 3"""


@query("per_ref_cap", "REF-06", f"""
    SELECT item_id, ref_idx, chunk_id, pos FROM (SELECT r.item_id, r.ref_idx, c.chunk_id, row_number() OVER (PARTITION BY r.item_id, r.ref_idx ORDER BY c."order") AS pos
    FROM refs_x r JOIN reg_chunks c ON c.reg_code = r.reg_code AND ({_BELOW} OR starts_with(r.section_path_prefix, c.section_path || '/'))) WHERE pos <= 3""")
def per_ref_cap(x: Inputs) -> DataFrame:
    parsed = refs.parse_refs(x.get("ref_texts"), ["item_id"], "raw")
    capped = refs.first_matches(parsed, x.get("reg_chunks"), ["item_id", "ref_idx"])
    return capped.select("item_id", "ref_idx", "chunk_id", "pos")


@query(
    "display_refs", "REF-07",
    r"""SELECT chunk_id, reg_code || ' ' || CASE WHEN section_path NOT LIKE '%/%' THEN section_path
          ELSE string_split(section_path, '/')[1] || '、' || string_split(section_path, '/')[2] || coalesce(' ' || string_split(section_path, '/')[3], '') END AS shown FROM reg_chunks""",
)
def display_refs(x: Inputs) -> DataFrame:
    return x.get("reg_chunks").select("chunk_id", X.display_ref(F.col("reg_code"), F.col("section_path")).alias("shown"))


# ---- retrieval -------------------------------------------------------------

K = 4
# the queries are topics: the mean vector of each label
EXPECTED["hits_x"] = f"""
    SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
      SELECT q.query_id, v.vec_id AS id, round(list_cosine_similarity(q.mean, v.embedding::DOUBLE[]), 9) AS score FROM embeddings v CROSS JOIN (
        SELECT query_id, list(m ORDER BY i) AS mean FROM (SELECT label AS query_id, i, avg(e::DOUBLE) AS m FROM (
          SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY query_id) q)) WHERE rank <= {K}"""


def _topics(x: Inputs) -> DataFrame:
    parts = x.table("embeddings").select(F.col("label").alias("query_id"), F.posexplode("embedding").alias("i", "e"))
    means = parts.groupBy("query_id", "i").agg(F.avg(F.col("e").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return means.groupBy("query_id").agg(ordered.alias("embedding"))


def _vectors(x: Inputs) -> DataFrame:
    return x.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _hits(x: Inputs, k: int = K) -> DataFrame:
    return retrieval.cosine_topk(_topics(x), _vectors(x), k)


@query("cosine_topk", "RET-02", "SELECT query_id, id, round(score, 6) AS score, rank FROM hits_x")
def cosine_topk(x: Inputs) -> DataFrame:
    return _hits(x).withColumn("score", F.round("score", 6))


# exact hits of every id divisible by 50
EXPECTED["near_x"] = f"""
    SELECT query_id, id, round(score, 6) AS score, rank FROM (
      SELECT a.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(a.e, v.e), 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, v.e), 9) DESC, v.vec_id) AS rank
      FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0) a, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v) WHERE rank <= {K}"""


@query(
    "near_topk", "RET-02 SRC-10 SRC-12",
    "SELECT query_id, id, score, rank, 0.9 AS recall_at_least, 0.1 AS share_at_most, rank = 1 OR NULL AS first_found FROM near_x",
)
def near_topk(x: Inputs) -> DataFrame:
    """Exact hits, with what the search by cells found of them and how much it compared, in tenths.

    The inverted file is stored and opened; visiting all of its cells gives the
    exact hits.
    """
    path = f"{checkpoint_dir(x.spark)}/cells-{uuid.uuid4()}"
    vectors = _vectors(x)
    asked = vectors.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    cells.save(cells.build(vectors), path)
    index = cells.load(x.spark, path)
    share = max(0.1, cells.share_for(index, asked, vectors, K, 0.92, "query_id", "id", "embedding"))
    found = materialise(cells.search(index, asked, K, share))
    exact = cells.search(index, asked, K, float(cells.SPILL))
    hits = materialise(exact.drop("candidates").join(found.select("query_id", "id", F.lit(True).alias("found")), ["query_id", "id"], "left"))
    n_found, n_exact = hits.agg(F.count("found"), F.count(F.lit(1))).first()
    most = found.agg(F.max("candidates")).first()[0] or 0
    return hits.select(
        "query_id", "id", F.round("score", 6).alias("score"), "rank", F.lit(min(0.9, math.floor(10 * n_found / max(1, n_exact)) / 10)).alias("recall_at_least"),
        F.lit(max(0.1, math.ceil(10 * most / max(1, index.n)) / 10)).alias("share_at_most"), F.when(F.col("rank") == 1, F.coalesce("found", F.lit(False))).alias("first_found"),
    )


@query("score_threshold", "RET-03", "SELECT query_id, count(*) AS n FROM hits_x WHERE score >= 0.4 GROUP BY query_id")
def score_threshold(x: Inputs) -> DataFrame:
    return retrieval.above_threshold(_hits(x), 0.4).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


def _items(x: Inputs) -> DataFrame:
    return x.get("ref_texts").withColumnRenamed("raw", "canonical_ref_raw")


@query("curated_sections", "RET-04", "SELECT * FROM curated_x")
def curated_sections(x: Inputs) -> DataFrame:
    return retrieval.curated_sections(_items(x), x.get("reg_chunks")).drop("score", "origin")


# an item asks for the topic of its number modulo 12; two of these have no vector
EXPECTED["semantic_x"] = """
    SELECT page_id AS key, h.rank AS pos, c.reg_code, c.section_path, c.title, c.text AS excerpt, h.score FROM pages JOIN hits_x h ON h.query_id = page_id % 12 JOIN reg_chunks c ON c.chunk_id = h.id
    WHERE h.score >= 0.08"""
EXPECTED["unrelated_x"] = """
    SELECT s.* FROM semantic_x s WHERE NOT EXISTS (SELECT 1 FROM curated_x c WHERE c.key = s.key AND c.reg_code = s.reg_code
      AND (c.section_path = s.section_path OR starts_with(s.section_path, c.section_path || '/') OR starts_with(c.section_path, s.section_path || '/')))"""
EXPECTED["merged_x"] = """
    SELECT key, pos, reg_code, section_path, title, excerpt, score, origin FROM (
      SELECT key, row_number() OVER (PARTITION BY key ORDER BY o, pos) AS pos, reg_code, section_path, title, excerpt, score, CASE o WHEN 0 THEN 'curated' ELSE 'semantic' END AS origin FROM (
        SELECT 0 AS o, key, pos, reg_code, section_path, title, excerpt, NULL::DOUBLE AS score FROM curated_x
        UNION ALL SELECT 1, key, pos, reg_code, section_path, title, excerpt, score FROM unrelated_x)) WHERE pos <= 3"""


def _item_hits(x: Inputs) -> DataFrame:
    """The hits of each item's topic: linear in items, as a topic has few hits."""
    asked = x.table("pages").select("page_id", (F.col("page_id") % 12).alias("topic"))
    hits = _hits(x).withColumnRenamed("query_id", "topic")
    return asked.join(hits, "topic").select(F.col("page_id").alias("query_id"), "id", "score", "rank")


def _semantic(x: Inputs) -> DataFrame:
    return retrieval.semantic_sections(_item_hits(x), x.get("reg_chunks"))


@query("drop_related", "RET-05", "SELECT key, pos, reg_code, section_path FROM unrelated_x")
def drop_related(x: Inputs) -> DataFrame:
    left = retrieval.drop_related(_semantic(x), retrieval.curated_sections(_items(x), x.get("reg_chunks")))
    return left.select("key", "pos", "reg_code", "section_path")


def _merged(x: Inputs) -> DataFrame:
    curated = retrieval.curated_sections(_items(x), x.get("reg_chunks"))
    return retrieval.merge_sections(curated, retrieval.drop_related(_semantic(x), curated))


@query("merge_dedup_cap", "RET-04 RET-05 RET-06 RET-08", "SELECT key, pos, reg_code, section_path, title, excerpt, round(score, 6) AS score, origin FROM merged_x")
def merge_dedup_cap(x: Inputs) -> DataFrame:
    return _merged(x).withColumn("score", F.round("score", 6))


@query(
    "question_sections", "RET-07",
    "SELECT query_id AS key, rank AS pos, c.section_path, round(score, 6) AS score FROM hits_x JOIN reg_chunks c ON c.chunk_id = id WHERE score >= 0.08 AND rank <= 3",
)
def question_sections(x: Inputs) -> DataFrame:
    # hits are ranked by score, so the threshold keeps a head of the ranks
    found = retrieval.question_sections(_hits(x), x.get("reg_chunks"))
    return found.select("key", "pos", "section_path", F.round("score", 6).alias("score"))


@query("excerpts", "RET-08", "SELECT doc_id, substr(text, 1, 300) AS excerpt FROM documents")
def excerpts(x: Inputs) -> DataFrame:
    return x.table("documents").select("doc_id", retrieval.excerpt(F.col("text")).alias("excerpt"))


@query(
    "nested_map", "RET-09",
    """SELECT i.item_id, coalesce(r.n, 0) AS n_refs, coalesce(m.n, 0) AS n_sections, coalesce(r.refs, '') AS refs, coalesce(m.paths, '') AS paths FROM ref_texts i
       LEFT JOIN (SELECT item_id, count(*) AS n, string_agg(reg_code || '/' || section_path_prefix, ' ' ORDER BY ref_idx) AS refs FROM refs_x GROUP BY item_id) r USING (item_id)
       LEFT JOIN (SELECT key, count(*) AS n, string_agg(origin || ':' || section_path, ' ' ORDER BY pos) AS paths FROM merged_x GROUP BY key) m ON m.key = i.item_id""",
)
def nested_map(x: Inputs) -> DataFrame:
    items = _items(x).withColumn("topic", F.lit("t")).withColumn("description", F.lit("d"))
    none = x.spark.createDataFrame([], "qid string, question_text string")
    parsed = refs.parse_refs(items, ["item_id"], "canonical_ref_raw")
    merged = _merged(x)
    by_item, _ = retrieval.nest_sections(items, parsed, merged, none, merged.limit(0))
    v = F.col("value")
    return by_item.select(
        F.col("key").alias("item_id"), F.size(v["refs"]).alias("n_refs"), F.size(v["sections"]).alias("n_sections"),
        F.array_join(F.transform(v["refs"], lambda r: F.concat(r["reg_code"], F.lit("/"), r["section_path_prefix"])), " ").alias("refs"),
        F.array_join(F.transform(v["sections"], lambda s: F.concat(s["origin"], F.lit(":"), s["section_path"])), " ").alias("paths"),
    )


@query(
    "retrieval_map_file", "SRC-08 SRC-09",
    "SELECT CAST(key AS STRING) AS item_id, pos - 1 AS pos, reg_code, section_path, excerpt, origin FROM merged_x",
)
def retrieval_map_file(x: Inputs) -> DataFrame:
    """The nested map of all items written as a document and read back checked."""
    items = _items(x).select(F.col("item_id").cast("string"), "canonical_ref_raw", F.lit("t").alias("topic"), F.lit("d").alias("description"))
    merged = _merged(x).withColumn("key", F.col("key").cast("string"))
    none = x.spark.createDataFrame([], "qid string, question_text string")
    parsed = refs.parse_refs(items, ["item_id"], "canonical_ref_raw")
    by_item, by_question = retrieval.nest_sections(items, parsed, merged, none, merged.limit(0))
    path = f"{checkpoint_dir(x.spark)}/map-{uuid.uuid4()}"
    tables.write_retrieval_map(by_item, by_question, path, "given")
    loaded, _ = tables.load_retrieval_map(x.spark, path)
    return tables.flat_sections(loaded, "item_id").select("item_id", "pos", "reg_code", "section_path", "excerpt", "origin")


EXPECTED["matched_x"] = """
    SELECT r.item_id, r.ref_idx, coalesce(bool_or(m), false) AS matched, arg_min(h.score, CASE WHEN m THEN h.rank END) AS score, any_value(l.lowest) AS lowest FROM (
      SELECT * FROM refs_x WHERE item_id % 12 IN (SELECT label FROM embeddings)) r
    LEFT JOIN (SELECT h.*, c.reg_code AS code, c.section_path AS path FROM hits_x h JOIN reg_chunks c ON c.chunk_id = h.id) h ON h.query_id = r.item_id % 12
    LEFT JOIN (SELECT query_id, min(score) AS lowest FROM hits_x GROUP BY query_id) l ON l.query_id = r.item_id % 12
    CROSS JOIN LATERAL (SELECT h.code = r.reg_code AND (r.section_path_prefix = '' OR h.path = r.section_path_prefix OR starts_with(h.path, r.section_path_prefix || '/') OR starts_with(r.section_path_prefix, h.path || '/')) AS m)
    GROUP BY r.item_id, r.ref_idx"""


def _matched(x: Inputs) -> DataFrame:
    truth = refs.parse_refs(x.get("ref_texts"), ["item_id"], "raw").withColumnRenamed("item_id", "key")
    topics = x.table("embeddings").select(F.col("label").cast("bigint").alias("topic")).distinct()
    failed = x.table("pages").select(F.col("page_id").alias("key"), (F.col("page_id") % 12).alias("topic")).join(topics, "topic", "left_anti")
    truth = retrieval.searched(truth, failed.withColumn("error", F.lit("no vector")))
    hits = _item_hits(x)
    chunks = x.get("reg_chunks").select(F.col("chunk_id").alias("id"), "reg_code", "section_path")
    return retrieval.match_hits(truth, hits.join(chunks, "id").withColumnRenamed("query_id", "key"))


@query("recall_at_k", "RET-10", "SELECT count(*) AS refs, count(*) FILTER (matched) AS recalled, round(count(*) FILTER (matched) / count(*), 9) AS recall FROM matched_x")
def recall_at_k(x: Inputs) -> DataFrame:
    return retrieval.recall_at_k(_matched(x)).withColumn("recall", F.round("recall", 9))


@query(
    "score_distribution", "RET-11",
    """SELECT round(min(score) FILTER (matched), 6) AS hit_min, round(max(score) FILTER (matched), 6) AS hit_max, round(avg(score) FILTER (matched), 6) AS hit_mean,
              round(max(lowest) FILTER (NOT matched), 6) AS miss_max FROM matched_x""",
)
def score_distribution(x: Inputs) -> DataFrame:
    out = retrieval.score_distribution(_matched(x))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "embed_texts", "RET-01 RET-12",
    "SELECT doc_id, CAST(length(text) AS DOUBLE) AS n_chars, CAST(doc_id AS DOUBLE) AS own, CAST(NULL AS VARCHAR) AS error FROM documents",
)
def embed_texts(x: Inputs) -> DataFrame:
    """Whole texts through a model, 32 a call; each vector shows its own text."""

    def model(texts):
        if len(texts) > P.EMBED_BATCH:
            raise ValueError("too many texts")
        return [[float(len(t.split("|", 1)[1])), float(t.split("|", 1)[0])] for t in texts]

    docs = x.table("documents").select("doc_id", F.concat_ws("|", F.col("doc_id").cast("string"), "text").alias("text"))
    out = retrieval.embed(docs, "text", model, isolate=True)
    return out.select("doc_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("n_chars", "own"))], "error")


@query(
    "index_table", "SRC-10 SRC-11 SRC-12",
    """SELECT reg_code, count(*) AS n_rows, min("order") AS first_order, max(m.n) AS described FROM reg_chunks JOIN (SELECT reg_code, count(*) AS n FROM reg_chunks GROUP BY reg_code) m USING (reg_code) GROUP BY reg_code""",
)
def index_table(x: Inputs) -> DataFrame:
    """Index written with its description, and opened against it."""
    path = f"{checkpoint_dir(x.spark)}/index-{uuid.uuid4()}"
    vectors = x.table("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    chunks = x.get("reg_chunks").join(vectors, "chunk_id")
    dim = 64
    tables.write_index(chunks, path)
    sources = x.table("documents").select(F.col("source").alias("filename"), F.encode("source", "utf-8").alias("content")).distinct()
    tables.write_index_meta(tables.index_meta(chunks.select("reg_code"), sources, "given", dim), path)
    opened = tables.open_index(x.spark, path, "given", dim)
    meta = x.spark.read.schema(schemas.INDEX_META).json(f"{path}/meta")
    described = meta.filter("kind = 'chunks'").select(F.col("name").alias("reg_code"), F.col("chunks").alias("n"))
    return (
        opened.filter(F.size("embedding") > 0)
        .join(described, "reg_code")
        .groupBy("reg_code")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("order").alias("first_order"), F.max("n").alias("described"))
    )


@query(
    "source_hashes", "SRC-11",
    "SELECT CAST(doc_id AS VARCHAR) AS filename, sha256(text) AS hash FROM documents",
)
def source_hashes(x: Inputs) -> DataFrame:
    """Documents as source files in the description of an index."""
    files = x.table("documents").select(F.col("doc_id").cast("string").alias("filename"), F.encode("text", "utf-8").alias("content"))
    meta = tables.index_meta(x.get("reg_chunks"), files, "given", 64)
    return meta.filter("kind = 'source'").select(F.col("name").alias("filename"), F.col("sha256").alias("hash"))


def _stamp(build: int):
    """A model whose vectors show the build that asked it."""
    return lambda texts: [[float(build), float(len(t))] for t in texts]


_REG_SQL = QUERIES["registered_documents"].oracle.replace("GROUP BY ROLLUP (upper(doc_id))", "GROUP BY upper(doc_id)")


@query(
    "index_update", "SRC-10 SRC-11 RET-01",
    f"SELECT *, CASE WHEN reg_code IN ('SRC5', 'SRC7', 'SRC9') THEN 2 ELSE 1 END AS first_build, CASE WHEN reg_code IN ('SRC5', 'SRC7', 'SRC9') THEN 2 ELSE 1 END AS last_build, n_chunks AS described FROM ({_REG_SQL})",
)
def index_update(x: Inputs) -> DataFrame:
    """An index built over yesterday's sources and brought up to date.

    Since then one source has got other lines, one is new, one has another
    title and one is gone; only the first three are embedded again.
    """
    registry = {f"SRC{i}": "article" if i % 3 == 0 else "chapter" for i in range(0, 19)}
    now = x.headed_lines().withColumn("line", F.when(F.col("line_no") == 1, F.concat(F.lit("第一條 "), F.col("line"))).otherwise(F.col("line")))
    docs, doc = _docs(x).filter("doc_id <> 'src18'"), F.col("doc_id")
    old_lines = now.filter(doc != "src7").withColumn("line", F.when(doc == "src5", F.concat("line", F.lit("。"))).otherwise(F.col("line")))
    old_docs = _docs(x).filter(doc != "src7").withColumn("reg_title", F.when(doc == "src9", F.lit("old")).otherwise(F.col("reg_title")))
    sources = x.table("documents").select(F.col("source").alias("filename"), F.encode("source", "utf-8").alias("content")).distinct()
    path = f"{checkpoint_dir(x.spark)}/index-{uuid.uuid4()}"
    index.build_index(old_lines, old_docs, sources, _stamp(1), path, "given", 2, registry)
    table = index.update_index(now, docs, sources, _stamp(2), path, "given", 2, registry)
    meta = x.spark.read.schema(schemas.INDEX_META).json(f"{path}/meta").filter("kind = 'chunks'")
    build = F.col("embedding")[0].cast("bigint")
    stats = chunking.chunk_stats(table).filter("reg_code IS NOT NULL")
    builds = table.groupBy("reg_code").agg(F.min(build).alias("first_build"), F.max(build).alias("last_build"))
    described = meta.select(F.col("name").alias("reg_code"), F.col("chunks").alias("described"))
    return stats.join(builds, "reg_code", "left").join(described, "reg_code", "full")
