"""Page lines -> clean lines -> regulation chunks (TXT).

Lines carry their place (document, page, line), so cleaning is filters and
aggregations, and outline chunking is one running maximum: for each line, the
latest heading of every level.  Long documents are cut into blocks by line
number; see ``scan``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf.functions import text as X
from sheaf.functions.session import materialise
from sheaf.operators import scan

# ---- cleaning --------------------------------------------------------------


def drop_page_numbers(page_lines: DataFrame, patterns: Sequence[str] = tuple(P.PAGE_NUMBER_PATTERNS)) -> DataFrame:
    any_of = X.pattern("|".join(f"(?:{p})" for p in patterns))
    return page_lines.filter(~X.strip(F.col("line")).rlike(any_of))


def boilerplate_lines(
    page_lines: DataFrame, docs: DataFrame, ratio: float = P.BOILERPLATE_RATIO, min_pages: int = P.BOILERPLATE_MIN_PAGES
) -> DataFrame:
    """Lines that stand on at least ``ratio`` of a document's pages.

    ``docs(doc_id, n_pages)`` counts all pages, also ones without lines left.
    A line counts once per page; the distinct step is keyed by the line too,
    so a repeated header is combined on the map side.
    """
    lines = page_lines.select("doc_id", "page_no", X.strip(F.col("line")).alias("line")).filter(F.col("line") != "")
    long_docs = docs.filter(F.col("n_pages") >= min_pages).select("doc_id", "n_pages")

    def often(rows: DataFrame, key: str) -> DataFrame:
        seen = rows.select("doc_id", "page_no", key).distinct().groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("n"))
        return seen.join(long_docs, "doc_id").filter(F.col("n") / F.col("n_pages") >= ratio).select("doc_id", key, "n")

    # hashes say which lines may be frequent: a hash stands on at least the pages of its lines, and
    # a document has few frequent ones; only their texts are shuffled and counted
    hashed = lines.withColumn("__h", F.xxhash64("line"))
    likely = materialise(often(hashed, "__h").select("doc_id", "__h"))
    return often(hashed.join(likely, ["doc_id", "__h"], "left_semi"), "line")


def drop_boilerplate(page_lines: DataFrame, docs: DataFrame, ratio: float = P.BOILERPLATE_RATIO, min_pages: int = P.BOILERPLATE_MIN_PAGES) -> DataFrame:
    # written, so that its size is known: it goes to all tasks and the lines stay where they are
    noise = materialise(boilerplate_lines(page_lines, docs, ratio, min_pages).select("doc_id", F.col("line").alias("__s")))
    return (
        page_lines.withColumn("__s", X.strip(F.col("line"))).join(noise, ["doc_id", "__s"], "left_anti").drop("__s")
    )


def join_wrapped(
    page_lines: DataFrame,
    tail: str = P.SENTENCE_TAIL,
    headings: Sequence[str] = tuple(P.HEADING_TOKENS),
    sep: str = "",
) -> DataFrame:
    """Joins a line to the one before unless a sentence ended or a heading starts.

    Only within a page.  Output: (doc_id, page_no, line_no of the first piece,
    line).
    """
    own = page_lines.select("doc_id", "page_no", "line_no", X.strip(F.col("line")).alias("line")).filter(F.col("line") != "")
    any_heading = X.pattern("|".join(f"(?:{h})" for h in headings))
    # a page is one record of its source, so its lines fit one task
    page = Window.partitionBy("doc_id", "page_no").orderBy("line_no")
    before = F.lag("line").over(page)
    starts = before.isNull() | before.rlike(X.pattern(tail)) | F.col("line").rlike(any_heading)
    first = own.withColumn("__start", F.when(starts, F.col("line_no"))).withColumn("__first", F.max("__start").over(page))
    pieces = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return first.groupBy("doc_id", "page_no", F.col("__first").alias("line_no")).agg(
        F.array_join(F.transform(pieces, lambda p: p["line"]), sep).alias("line")
    )


def flatten_lines(page_lines: DataFrame, block: int = 64) -> DataFrame:
    """One ordered line stream per document: (doc_id, line_no from 0, line).

    Blocks are runs of pages, so a long document is spread by its pages.
    """
    numbered = scan.number_rows(
        page_lines.withColumnRenamed("line_no", "__line"),
        ["doc_id"], ["page_no", "__line"], scan.blocks("page_no", block), "line_no", start=0,
    )
    return numbered.select("doc_id", "line_no", "line")


def clean_pages(page_lines: DataFrame, docs: DataFrame, **wrap) -> DataFrame:
    """Page numbers, then boilerplate, then wrapped lines, then one stream."""
    kept = drop_boilerplate(drop_page_numbers(page_lines), docs)
    return flatten_lines(join_wrapped(kept, **wrap))


# ---- article style ---------------------------------------------------------


def _ordered(rows: Sequence[Column], sep: str = "\n") -> Column:
    """Lines of a group in order, joined; null lines are left out."""
    line_no, line = rows
    pieces = F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct(line_no.alias("n"), line.alias("l")))))
    return F.array_join(F.transform(pieces, lambda p: p["l"]), sep)


def chunk_articles(lines: DataFrame, docs: DataFrame, head: str = P.ARTICLE_HEAD, block: int = P.SCAN_BLOCK) -> DataFrame:
    """One chunk per article; lines before the first article are dropped.

    ``lines(doc_id, line_no, line)``, ``docs(doc_id, reg_code, reg_title)``.
    """
    own = lines.withColumn("line", X.strip(F.col("line"))).filter(F.col("line") != "")
    rule = X.pattern(head)
    is_head = F.col("line").rlike(rule)
    opened = scan.running(own, ["doc_id"], ["line_no"], scan.blocks("line_no", block), __art=("max", F.when(is_head, F.col("line_no"))))
    body = F.when(is_head, F.nullif(F.regexp_extract("line", rule, 2), F.lit(""))).otherwise(F.col("line"))
    bodies = (
        opened.filter(F.col("__art").isNotNull())
        .groupBy("doc_id", "__art")
        .agg(
            F.max(F.when(is_head, F.regexp_extract("line", rule, 1))).alias("section_path"),
            _ordered((F.col("line_no"), body)).alias("body"),
        )
    )
    named = bodies.join(docs.select("doc_id", "reg_code", "reg_title"), "doc_id").select(
        "doc_id", "reg_code", "reg_title", "section_path",
        F.col("section_path").alias("title"),
        F.col("section_path").alias("breadcrumb"),
        "body", F.lit(0).alias("chunk_seq"),
        F.col("__art").alias("first_line"), F.lit(0).alias("rank"),
    )
    return with_chunk_ids(with_doc_order(named, block))


# ---- outline style ---------------------------------------------------------


def tag_outline(lines: DataFrame, heads: Sequence[str] = tuple(P.OUTLINE_HEADS), block: int = P.SCAN_BLOCK) -> DataFrame:
    """For each line the heading lines it stands under: ``l1``, ``l2``, ``l3``,
    and the text of its level-1 heading.

    The latest heading line of each level is a running maximum of the line
    number.  A level counts only below an open upper level: its heading must
    come after the latest heading above it.  Lines before the first level-1
    heading are dropped.
    """
    own = lines.withColumn("line", X.strip(F.col("line"))).filter(F.col("line") != "")
    one, two, three = (F.col("line").rlike(X.pattern(h)) for h in heads)
    at = F.col("line_no")
    latest = scan.running(
        own, ["doc_id"], ["line_no"], scan.blocks("line_no", block),
        l1=("max", F.when(one, at)),
        l1_line=("last", F.when(one, F.col("line"))),
        __l2=("max", F.when(two & ~one, at)),
        __l3=("max", F.when(three & ~one & ~two, at)),
    ).filter(F.col("l1").isNotNull())
    l2 = F.when(F.col("__l2") > F.col("l1"), F.col("__l2"))
    l3 = F.when(F.col("l2").isNotNull() & (F.col("__l3") > F.col("l2")), F.col("__l3"))
    tagged = latest.withColumn("l2", l2).withColumn("l3", l3).drop("__l2", "__l3")
    level = (
        F.when(at == F.col("l1"), 1).when(at == F.col("l2"), 2).when(at == F.col("l3"), 3).otherwise(0)
    )
    return tagged.withColumn("level", level)


def outline_nodes(tagged: DataFrame, heads: Sequence[str] = tuple(P.OUTLINE_HEADS)) -> DataFrame:
    """Level-2 nodes with their texts; level-1 intros are nodes without ``l2``.

    ``intro``: lines before the first level-3 heading; ``inline``: intro and
    all level-3 lines with their markers; ``items``: one entry per level-3
    node, marker stripped.  The first aggregation is per level-3 node.
    """
    line, at = F.col("line"), F.col("line_no")
    rules = [X.pattern(h) for h in heads]
    content = F.when(F.col("level") == 3, F.regexp_extract(line, rules[2], 2)).otherwise(line)
    not_heading = F.when(F.col("level").isin(0, 3), line)
    # lines go to the task of their level-2 node at once, where both aggregations run
    small = tagged.repartition("doc_id", "l1", "l2").groupBy("doc_id", "l1", "l2", "l3").agg(
        F.max("l1_line").alias("l1_line"),
        F.max(F.when(F.col("level") == 2, line)).alias("l2_line"),
        F.max(F.when(F.col("level") == 3, F.regexp_extract(line, rules[2], 1))).alias("num"),
        F.count_if(not_heading.isNotNull()).alias("n_lines"),
        _ordered((at, not_heading)).alias("raw"),
        _ordered((at, F.when(F.col("level").isin(0, 3), content))).alias("content"),
    )
    with_rows = F.col("n_lines") > 0
    items = F.filter(
        F.sort_array(F.collect_list(F.struct("l3", "num", "content"))), lambda x: x["l3"].isNotNull()
    )
    pieces = F.sort_array(F.collect_list(F.when(with_rows, F.struct(F.coalesce("l3", F.lit(-1)).alias("l3"), F.col("raw").alias("raw")))))
    nodes = small.groupBy("doc_id", "l1", "l2").agg(
        F.max("l1_line").alias("l1_line"),
        F.max("l2_line").alias("l2_line"),
        F.max(F.when(F.col("l3").isNull() & with_rows, F.col("raw"))).alias("intro"),
        F.array_join(F.transform(pieces, lambda p: p["raw"]), "\n").alias("inline"),
        items.alias("items"),
    )
    return nodes


def fold_pure_titles(nodes: DataFrame, min_chars: int = P.PURE_TITLE_CHARS) -> DataFrame:
    """Short level-2 headings without any text join their level-1 intro.

    Where the level-1 node has no intro they are dropped.  Bare headings are
    grouped with their level-1 node, all other nodes stay by themselves: one
    aggregation, no join.
    """
    bare = F.col("l2").isNotNull() & (F.length("l2_line") < min_chars) & F.col("intro").isNull() & (F.size("items") == 0)
    marked = nodes.withColumn("__bare", bare).withColumn("__own", F.when(~F.col("__bare"), F.col("l2")))
    kept = F.when(~F.col("__bare"), F.struct("l2_line", "intro", "inline", "items"))
    folded = marked.groupBy("doc_id", "l1", F.col("__own").alias("l2")).agg(
        F.max("l1_line").alias("l1_line"),
        F.first(kept, ignorenulls=True).alias("k"),
        _ordered((F.col("l2"), F.when(F.col("__bare"), F.col("l2_line")))).alias("titles"),
    )
    top = F.col("l2").isNull()
    intro = F.when(top & F.col("k.intro").isNotNull() & (F.col("titles") != ""), F.concat_ws("\n", "k.intro", "titles"))
    return folded.select("doc_id", "l1", "l2", "l1_line", "k.l2_line", F.coalesce(intro, F.col("k.intro")).alias("intro"), "k.inline", "k.items")


def chunk_outline(
    lines: DataFrame,
    docs: DataFrame,
    heads: Sequence[str] = tuple(P.OUTLINE_HEADS),
    max_chars: int = P.MAX_BODY_CHARS,
    min_chars: int = P.PURE_TITLE_CHARS,
    sep: str = P.SENTENCE_END,
    block: int = P.SCAN_BLOCK,
) -> DataFrame:
    """Chunks of a three-level outline; long bodies go down a level or split."""
    rules = [X.pattern(h) for h in heads]
    tagged = tag_outline(lines, heads, block)
    nodes = fold_pure_titles(outline_nodes(tagged, heads), min_chars)
    node = (
        nodes.withColumn("n1", F.regexp_extract("l1_line", rules[0], 1))
        .withColumn("t1", X.strip(F.regexp_extract("l1_line", rules[0], 2)))
        .withColumn("bc1", X.fill("{n}、{t}", n=F.col("n1"), t=F.col("t1")))
    )
    n2 = F.regexp_extract("l2_line", rules[1], 1)
    t2 = X.strip(F.regexp_extract("l2_line", rules[1], 2))
    path2 = X.fill("{a}/({b})", a=F.col("n1"), b=n2)
    bc2 = X.fill("{a}>({b}){t}", a=F.col("bc1"), b=n2, t=t2)
    text = "string"

    def piece(rank, path, title, crumb, body, split) -> Column:
        return F.struct(
            rank.cast("bigint").alias("rank"), path.cast(text).alias("section_path"), title.cast(text).alias("title"),
            crumb.cast(text).alias("breadcrumb"), body.cast(text).alias("body"), F.lit(split).alias("split"),
        )

    top = F.col("l2").isNull()
    deep = (F.length("inline") > max_chars) & (F.size("items") > 0)
    intro = piece(F.lit(-1), path2, t2, bc2, F.col("intro"), True)
    whole = piece(F.lit(-1), path2, t2, bc2, F.col("inline"), True)
    per_item = F.transform(
        "items",
        lambda x: piece(
            x["l3"], F.concat(path2, F.lit("/"), x["num"]), t2, F.concat(bc2, F.lit(">"), x["num"], F.lit(".")), x["content"], True
        ),
    )
    none = F.slice(F.array(whole), 1, 0)
    pieces = (
        F.when(
            top,
            F.when(F.col("intro").isNotNull(), F.array(piece(F.lit(-1), F.col("n1"), F.col("t1"), F.col("bc1"), F.col("intro"), False))).otherwise(none),
        )
        .when(deep, F.concat(F.when(F.col("intro").isNotNull(), F.array(intro)).otherwise(none), per_item))
        .otherwise(F.array(whole))
    )
    flat = node.select("doc_id", F.coalesce("l2", "l1").alias("first_line"), F.inline(pieces))
    parts = F.when(
        F.col("split") & (F.length("body") > max_chars), pack_sentences(F.col("body"), max_chars, sep)
    ).otherwise(F.array("body"))
    split = flat.select(
        "doc_id", "first_line", "rank", "section_path", "title", "breadcrumb", F.posexplode(parts).alias("chunk_seq", "body")
    )
    named = split.join(docs.select("doc_id", "reg_code", "reg_title"), "doc_id")
    # numbering reads the chunks twice; they are made once
    return with_chunk_ids(with_doc_order(materialise(named), block))


# ---- sentences -------------------------------------------------------------


def split_sentences(body: Column, sep: str = P.SENTENCE_END) -> Column:
    """Sentences with their end mark; joined they give the text back."""

    def marked(parts: Column) -> Column:
        whole = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(sep))).otherwise(p))
        return F.filter(whole, lambda p: p != "")

    # bound by a lambda, so that a text is split once and not again for each of its parts
    return F.get(F.transform(F.array(F.split(body, "\\Q" + sep + "\\E")), marked), F.lit(0))


def pack_sentences(body: Column, max_chars: int = P.MAX_BODY_CHARS, sep: str = P.SENTENCE_END) -> Column:
    """Greedy packing: a piece is closed when the next sentence would overflow it.

    A sentence is never cut.  From any sentence start the next piece is the
    first of: the whole rest if it fits; the longest fitting text that ends a
    sentence; one overlong sentence; the overlong rest.  One regular
    expression says this and cuts a text in linear time.
    """
    end = "\\Q" + sep + "\\E"
    piece = f"(?s).{{1,{max_chars}}}\\z|.{{0,{max_chars - len(sep)}}}{end}|.*?{end}|.+"
    return F.regexp_extract_all(body, F.lit(piece), 0)


# ---- ids, order, statistics ------------------------------------------------


def with_doc_order(chunks: DataFrame, block: int = P.SCAN_BLOCK) -> DataFrame:
    """0-based order of the chunks of a document."""
    return scan.number_rows(
        chunks, ["doc_id"], ["first_line", "rank", "chunk_seq"], scan.blocks("first_line", block), "order", start=0
    )


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Breadcrumb line on top of the body, and the id ``code:path:seq``."""
    return chunks.select(
        "doc_id", "reg_code", "reg_title", "section_path", "title",
        X.fill("【{c} {t}|{b}】\n{body}", c=F.col("reg_code"), t=F.col("reg_title"), b=F.col("breadcrumb"), body=F.col("body")).alias("text"),
        F.col("chunk_seq").cast("int").alias("chunk_seq"),
        F.col("order").cast("int").alias("order"),
        X.fill("{c}:{p}:{s}", c=F.col("reg_code"), p=F.col("section_path"), s=F.col("chunk_seq")).alias("chunk_id"),
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunk count and body characters per document, with a grand total row."""
    body = F.length("text") - F.length(F.substring_index("text", "\n", 1))
    return chunks.rollup("reg_code").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(body).alias("body_chars"), F.max(body).alias("longest_body")
    )


def known_documents(docs: DataFrame, registry: dict[str, str] | None = None) -> DataFrame:
    """Documents of registered codes with their ``style``."""
    styles = X.lookup_map(P.REGULATIONS if registry is None else registry)
    return docs.withColumn("style", styles[F.col("reg_code")]).filter(F.col("style").isNotNull())


def chunk_documents(page_lines: DataFrame, docs: DataFrame, registry: dict[str, str] | None = None) -> DataFrame:
    """All registered documents: clean once, then chunk by style.

    ``docs(doc_id, n_pages, reg_code, reg_title)``; documents of a code the
    registry does not know are left out.
    """
    known = known_documents(docs, registry)
    wanted = page_lines.join(known.select("doc_id"), "doc_id", "left_semi")
    # both styles read the clean lines; cleaning runs once
    lines = materialise(clean_pages(wanted, known))
    article, chapter = (known.filter(F.col("style") == s) for s in ("article", "chapter"))
    return chunk_articles(
        lines.join(article.select("doc_id"), "doc_id", "left_semi"), article
    ).unionByName(chunk_outline(lines.join(chapter.select("doc_id"), "doc_id", "left_semi"), chapter))


def missing_documents(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered codes without a document."""
    return registry.join(docs.select("reg_code").distinct(), "reg_code", "left_anti")
