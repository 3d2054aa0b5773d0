"""Documents as lines, their sections, and what stands around a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: All line ends that text files use.
_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def _in_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def _so_far() -> WindowSpec:
    return _in_doc().rowsBetween(Window.unboundedPreceding, 0)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, ext, line_no, line) of docs(doc_id, ext, text); an end at the end begins no line. A null text has no lines.

    A narrow step: the windows of later steps share one exchange on doc_id.
    """
    parts = F.split("text", _END, -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return docs.select("doc_id", "ext", F.posexplode(parts).alias("pos", "line")).select("doc_id", "ext", (F.col("pos") + 1).alias("line_no"), "line")


def without_comment(line: Column, ext: Column) -> Column:
    """LaTeX from an unescaped percent sign on, Markdown within a comment; other kinds have no comments."""
    tex = F.when(line.contains("%"), F.regexp_replace(line, r"(?<!\\)%.*$", "")).otherwise(line)
    md = F.when(line.contains("<!--"), F.regexp_replace(line, r"^((?:(?!-->).)*?<!--)(?:(?!-->).)*", "$1")).otherwise(line)
    return F.when(ext == ".tex", tex).when(ext == ".md", md).otherwise(line)


def _marker(rules: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(test, name) for test, name in rules])


def with_section(lines: DataFrame) -> DataFrame:
    """Adds section: abstract, body, table, caption or title. The last line with a mark decides, within it the first rule."""
    has = lambda s: F.col("line").contains(s)
    low = F.lower(F.trim("line"))
    tex = _marker(
        [
            (has("\\begin{abstract}"), "abstract"),
            (has("\\end{abstract}"), "body"),
            (has("\\begin{table"), "table"),
            (has("\\end{table"), "body"),
            (has("\\caption") | has("\\begin{figure"), "caption"),
            (has("\\end{figure"), "body"),
            (F.col("line").rlike(r"\\(section|subsection|subsubsection|chapter)\b"), "body"),
            (has("\\title"), "title"),
        ]
    )
    heading = low.startswith("# ") | low.startswith("## ")
    md = F.when(heading, F.when(low.contains("abstract"), "abstract").otherwise("body"))
    mark = F.when(F.col("ext") == ".tex", F.when(has("\\"), tex)).when(F.col("ext") == ".md", md)
    return lines.withColumn("section", F.coalesce(F.last(mark, ignorenulls=True).over(_so_far()), F.lit("body")))


def in_abstract(lines: DataFrame) -> DataFrame:
    """The lines inside an abstract, without those that begin or end it."""
    return with_abstract(lines).filter("in_abstract").drop("in_abstract")


def with_abstract(lines: DataFrame) -> DataFrame:
    """Adds in_abstract: whether a line is inside an abstract; those that begin or end it are not."""
    has = lambda s: F.col("line").contains(s)
    text = F.trim("line")
    starts = F.lower(text).startswith("## abstract") | F.lower(text).startswith("# abstract")
    tex = F.when(has("\\begin{abstract}"), 1).when(has("\\end{abstract}"), 0)
    md = F.when(starts, 1).when(text.startswith("#"), 0)
    mark = F.when(F.col("ext") == ".tex", tex).when(F.col("ext") == ".md", md)
    marked = lines.withColumn("mark", mark).withColumn("inside", F.last("mark", ignorenulls=True).over(_so_far()))
    return marked.withColumn("in_abstract", F.expr("coalesce(inside = 1, false) and mark is null")).drop("mark", "inside")


#: Fixed value: how LaTeX names a section.
_HEADING = r"\\(?:section|subsection)\*?\{([^}]+)\}"


def with_heading(lines: DataFrame) -> DataFrame:
    """Adds heading: the lower-cased title of the section a line is in.

    LaTeX: `body` everywhere if there is no heading, null before the first one.
    Markdown: the last line that begins with #; null on such lines.
    """
    title = F.when(F.col("line").contains("section") & F.col("line").rlike(_HEADING), F.lower(F.trim(F.regexp_extract("line", _HEADING, 1))))
    none = F.count(title).over(Window.partitionBy("doc_id")) == 0
    tex = F.when(none, "body").otherwise(F.last(title, ignorenulls=True).over(_so_far()))
    text = F.lower(F.trim("line"))
    is_head = text.startswith("#")
    md = F.when(~is_head, F.coalesce(F.last(F.when(is_head, F.trim(F.regexp_replace(text, "^#+", ""))), ignorenulls=True).over(_so_far()), F.lit("body")))
    return lines.withColumn("heading", F.when(F.col("ext") == ".tex", tex).when(F.col("ext") == ".md", md))


def section_ranges(lines: DataFrame) -> DataFrame:
    """(doc_id, heading, start_line, end_line) of LaTeX sections; the end is exclusive."""
    heads = lines.filter(F.col("line").rlike(_HEADING)).select("doc_id", F.lower(F.trim(F.regexp_extract("line", _HEADING, 1))).alias("heading"), F.col("line_no").alias("start_line"))
    ends = lines.groupBy("doc_id").agg((F.max("line_no") + 1).alias("doc_end"))
    after = F.lead("start_line").over(Window.partitionBy("doc_id").orderBy("start_line"))
    return heads.withColumn("next", after).join(ends, "doc_id").select("doc_id", "heading", "start_line", F.coalesce("next", "doc_end").alias("end_line"))


def with_context(lines: DataFrame, where: Column, reach: int = 5) -> DataFrame:
    """Adds context to the lines for which `where` holds: the lines within reach, joined by spaces. No other line's context is put together; it is null."""
    around = [F.lag("line", k) if k > 0 else F.lead("line", -k) for k in range(reach, -reach - 1, -1)]
    near = lines.withColumn("_around", F.struct(*[c.over(_in_doc()).alias(f"l{k}") for k, c in enumerate(around)]))
    return near.withColumn("context", F.when(where, F.concat_ws(" ", *[F.col(f"_around.l{k}") for k in range(2 * reach + 1)]))).drop("_around")
