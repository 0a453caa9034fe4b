"""Lines, headings, paragraphs and tables of documents.

Tables: ``fragments(document_id, page_number, seq, text, y, size)`` ->
``lines(document_id, page_number, line_no, text, font_size)`` ->
``elements(document_id, page_number, position, type, level, text)``.
Work is split by (document, page); nothing larger than a page is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_lake import fixed_values as V
from evidence_lake.functions import text as T

_PAGE = ("document_id", "page_number")


def assemble_lines(fragments: DataFrame) -> DataFrame:
    """Join text fragments into lines: a line takes all fragments within the y tolerance of its first."""
    usable = fragments.filter(T.strip(F.col("text")) != "")
    pages = usable.groupBy(*_PAGE).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("seq"),
                    F.col("text"),
                    F.bround(F.coalesce("y", F.lit(0.0)), 1).alias("y"),
                    F.coalesce("size", F.lit(0.0)).cast("double").alias("size"),
                )
            )
        ).alias("parts")
    )
    none_yet = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(0.0).alias("anchor"), F.lit(0).alias("at")
    )

    def place(state, part):
        opens = (state["at"] == 0) | (F.abs(part["y"] - state["anchor"]) > V.LINE_Y_TOLERANCE)
        return F.struct(
            F.when(opens, F.array_append(state["starts"], state["at"])).otherwise(state["starts"]).alias("starts"),
            F.when(opens, part["y"]).otherwise(state["anchor"]).alias("anchor"),
            (state["at"] + 1).alias("at"),
        )

    starts = pages.withColumn("starts", F.aggregate("parts", none_yet, place)["starts"])
    # the outer form, as the optimizer would repeat the fold in a filter before the plain one
    spans = starts.select(*_PAGE, "parts", "starts", F.posexplode_outer("starts").alias("line_no", "start"))
    end = F.coalesce(F.get("starts", F.col("line_no") + 1), F.size("parts"))
    members = F.slice("parts", F.col("start") + 1, end - F.col("start"))
    return spans.select(*_PAGE, "line_no", members.alias("parts")).select(
        *_PAGE,
        "line_no",
        T.strip(F.array_join(F.transform("parts", lambda p: p["text"]), "")).alias("text"),
        F.array_max(F.transform("parts", lambda p: p["size"])).alias("font_size"),
    )


def text_lines(documents: DataFrame, id_col: str = "doc_id", body_size: float = 12.0) -> DataFrame:
    """Non-blank lines of plain-text documents as one page each (a row-wise operation)."""
    split = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    return (
        documents.select(F.col(id_col).cast("string").alias("document_id"), split)
        .select(
            "document_id",
            F.lit(1).alias("page_number"),
            "line_no",
            T.strip(F.col("line")).alias("text"),
            F.lit(body_size).alias("font_size"),
        )
        .filter(F.col("text") != "")
    )


def detect_elements(lines: DataFrame) -> DataFrame:
    """Group lines into headings, paragraphs and tables.

    Heading: font at least 1.15 times the page's median and a short line; its level is
    the rank of its size among the page's heading sizes.  Table: consecutive rows of at
    least three pieces.  Paragraph: consecutive other lines.
    """
    page = Window.partitionBy(*_PAGE)
    in_order = page.orderBy("line_no")
    size = F.col("font_size")
    big = (F.col("body") > 0) & (size >= F.col("body") * V.HEADING_FONT_RATIO)
    kind = (
        F.when(F.col("big") & (F.length("text") <= V.HEADING_MAX_CHARS), "heading")
        .when(F.size(F.split("text", V.TABLE_GAP_PATTERN)) >= 3, "table")
        .otherwise("paragraph")
    )
    typed = (
        lines.withColumn("body", F.median(F.when(size > 0, size)).over(page))
        .withColumn("big", F.coalesce(big, F.lit(False)))
        # all large lines take part in the ranking, also those too long to be headings
        .withColumn("rank", F.dense_rank().over(page.orderBy(F.when(F.col("big"), size).desc_nulls_last())))
        .withColumn("type", kind)
    )
    opens = (F.col("type") == "heading") | F.coalesce(F.lag("type").over(in_order) != F.col("type"), F.lit(True))
    runs = typed.withColumn("run", F.sum(opens.cast("int")).over(in_order))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    elements = (
        runs.groupBy(*_PAGE, "run", "type")
        .agg(texts.alias("texts"), F.first("rank").alias("rank"))
        .select(
            *_PAGE,
            "run",
            "type",
            F.when(F.col("type") == "heading", F.col("rank")).alias("level"),
            F.when(F.col("type") == "table", F.array_join("texts", "\n"))
            .otherwise(F.array_join("texts", " ")).alias("text"),
        )
    )
    running = Window.partitionBy("document_id").orderBy("page_number", "run")
    return elements.withColumn("position", F.row_number().over(running) - 1).select(
        *_PAGE, "position", "type", "level", "text"
    )


def page_totals(pages: DataFrame) -> DataFrame:
    """Page count and character count per document."""
    return pages.groupBy("document_id").agg(
        F.count("*").alias("total_pages"), F.sum(F.length("text")).alias("total_chars")
    )


_HIDDEN = "|".join([r"<!--.*?-->", *[rf"<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in V.HTML_HIDDEN]])
_TAG = r"</?[A-Za-z!][^>]*(?:>|$)"


def _decoded(text: Column) -> Column:
    """Character references, by number or by name, as the characters they stand for."""

    def numbered(part: Column) -> Column:
        digits = F.regexp_extract(part, "^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        hexadecimal = F.lower(F.substring(digits, 1, 1)) == "x"
        code = F.when(hexadecimal, F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).cast("int")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.regexp_replace(part, "^[^;]*;", "")
        return F.when((digits != "") & valid, F.concat(character, rest)).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(text, "&#")
    by_number = F.concat(
        F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), numbered), "")
    )
    text = F.when(F.contains(text, F.lit("&#")), by_number).otherwise(text)
    for name, character in V.HTML_ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(character))
    return text


def html_elements(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """All shown text of web pages as heading, paragraph and table elements, in order.

    An element reaches to the next tag that begins or ends a block, so unclosed paragraphs, list items
    and text outside any block stand on their own; a table with all it holds is one element.  Comments,
    scripts, styles and the title are not shown.  Row-wise, without any shuffle.
    """
    shown = F.regexp_replace("html", rf"(?is){_HIDDEN}", " ")
    parts = F.split(shown, r"(?i)(?=<table\b)|(?<=</table>)")
    is_table = lambda part: F.lower(F.substring(part, 1, 6)) == "<table"
    blocks = rf"(?i)(?=</?(?:{'|'.join(V.HTML_BLOCKS)})\b)"
    cut = F.flatten(
        F.transform(parts, lambda part: F.when(is_table(part), F.array(part)).otherwise(F.split(part, blocks)))
    )

    def read(block: Column) -> Column:
        inline = F.regexp_replace(block, rf"(?i)</?(?:{'|'.join(V.HTML_INLINE)})\b[^>]*>", "")
        text = _decoded(F.regexp_replace(inline, _TAG, " "))
        return F.struct(
            F.lower(F.regexp_extract(block, r"^<([A-Za-z0-9]+)", 1)).alias("tag"),
            T.collapse_whitespace(text).alias("text"),
        )

    filled = F.filter(F.transform(cut, read), lambda b: b["text"] != "")
    found = pages.select(
        F.col(id_col).cast("string").alias("document_id"), F.posexplode_outer(filled).alias("position", "b")
    ).filter(F.col("position").isNotNull())
    tag = F.col("b.tag")
    heading = tag.rlike("^h[1-6]$")
    return found.select(
        "document_id",
        F.lit(1).alias("page_number"),
        "position",
        F.when(heading, "heading").when(tag == "table", "table").otherwise("paragraph").alias("type"),
        F.when(heading, F.substring(tag, 2, 1).cast("int")).alias("level"),
        F.col("b.text").alias("text"),
    )
