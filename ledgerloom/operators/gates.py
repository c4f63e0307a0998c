"""Gates over finished pages: literals, anchors, images, geometry, ink; findings and verdicts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import anchors, literal_fragments, search_text


def absent(wanted: DataFrame, pages: DataFrame, together: int = 20_000) -> DataFrame:
    """The rows of ``wanted`` (``page, key`` and others) whose key the text of their page (``page, text_key``) lacks.

    All keys of a page are one automaton, which reads the text once, so the work grows with the text
    and the keys and not with their product.  A page of more than about ``together`` keys is dealt into groups, each
    with a copy of the text: what meets in a task is one text and that many keys.
    A page without text lacks everything; an empty key is in every text; of several texts of a page each is looked through.
    """
    slots = wanted.groupBy("page").agg(F.ceil(F.count("*") / together).cast("int").alias("_slots"))
    names, page, none = wanted.columns, wanted.schema["page"].dataType, F.lit(None).cast("string")
    own = wanted.join(slots, "page").select(*names, F.pmod(F.xxhash64("key"), F.col("_slots")).cast("int").alias("_slot"), F.lit(0).alias("_is_text"), none.alias("_text"))
    each = F.explode(F.sequence(F.lit(0), F.col("_slots") - 1))
    texts = pages.select(F.col("page").cast(page).alias("page"), "text_key").join(slots, "page").select("page", F.col("text_key").alias("_text"), F.lit(1).alias("_is_text"), each.alias("_slot"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of many pages in a batch, those of a page together: its keys, then its texts."""
        group, rows, seen = None, [], False
        for batch in batches:
            column = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            kinds = list(zip(column("page").to_pylist(), column("_slot").to_pylist(), column("_is_text").to_pylist(), strict=True))
            at = 0
            for kind, run in itertools.groupby(kinds):
                n = sum(1 for _ in run)
                if kind[:2] != group:
                    if not seen:
                        yield from rows
                    group, rows, seen = kind[:2], [], False
                if kind[2]:
                    for text in column("_text").slice(at, n).to_pylist():
                        yield from _lacking(rows, text)
                    seen = True
                else:
                    rows.append(batch.slice(at, n).select(names))
                at += n
        if not seen:
            yield from rows

    dealt = own.unionByName(texts, allowMissingColumns=True).repartition("page", "_slot").sortWithinPartitions("page", "_slot", "_is_text")
    return dealt.mapInArrow(find, wanted.schema).unionByName(wanted.where("page IS NULL"))


def _lacking(rows: list[pa.RecordBatch], text: str | None, few: int = 16) -> Iterator[pa.RecordBatch]:
    """The rows whose ``key`` a text lacks; more than a ``few`` keys are one automaton."""
    keys = [b.column(b.schema.get_field_index("key")).to_pylist() for b in rows]
    distinct = {k for own in keys for k in own} - {"", None}
    there = {""} if text is not None else set()
    if text and len(distinct) <= few:
        there.update(k for k in distinct if k in text)
    elif text:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k in distinct:
            automaton.add_word(k, k)
        automaton.make_automaton()
        there.update(k for _, k in automaton.iter(text))
    for b, own in zip(rows, keys, strict=True):
        gone = [k not in there for k in own]
        if any(gone):
            yield b.filter(pa.array(gone, pa.bool_()))


def missing_literals(units: DataFrame, pages: DataFrame, show: int = 3, cut: int = 120) -> DataFrame:
    """Units whose text fragments their page lacks, compared without white space.

    ``units``: ``unit, page, text``; ``pages``: ``page, page_text``.  The first ``show`` missing
    fragments in the order of the text, repeated ones too, are given as evidence.
    """
    want = units.select("unit", "page", F.posexplode(literal_fragments(F.col("text"))).alias("at", "fragment"))
    want = want.select("unit", "page", "at", F.left("fragment", F.lit(cut)).alias("shown"), search_text(F.col("fragment")).alias("key"))
    gone = absent(want, pages.select("page", search_text(F.col("page_text")).alias("text_key")))
    place = F.row_number().over(Window.partitionBy("unit").orderBy("at"))
    ranked = gone.withColumn("place", place)
    first = F.array_sort(F.collect_list(F.when(F.col("place") <= show, F.struct("at", F.col("shown").alias("t")))))
    return ranked.groupBy("unit").agg(F.count("*").alias("n_missing"), F.transform(first, lambda x: x["t"]).alias("evidence"))


def missing_anchors(source: DataFrame, target: DataFrame, show: int = 5) -> DataFrame:
    """Per page the anchors of the source text that the target lacks.  ``page, text`` each."""
    want = source.select("page", F.explode(anchors(F.col("text"))).alias("anchor")).withColumn("key", search_text(F.col("anchor")))
    gone = absent(want, target.select("page", search_text(F.col("text")).alias("text_key")))
    return gone.groupBy("page").agg(F.slice(F.array_sort(F.collect_set("anchor")), 1, show).alias("missing"), F.count("*").alias("n"))


def image_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("page", "digest").agg(F.count("*").alias("n"))


def missing_images(source: DataFrame, target: DataFrame) -> DataFrame:
    """Bag difference of image digests per page, as counts."""
    s, t = image_counts(source), image_counts(target).withColumnRenamed("n", "m")
    return s.join(t, ["page", "digest"], "left").withColumn("missing", F.col("n") - F.coalesce("m", F.lit(0))).where("missing > 0").select("page", "digest", "missing")


def line_boxes(pages: DataFrame) -> DataFrame:
    """Flattens ``page, blocks: array<array<struct<x0,y0,x1,y1>>>`` to lines of positive area."""
    b = pages.select("page", F.posexplode("blocks").alias("block", "lines"))
    l = b.select("page", "block", F.posexplode("lines").alias("line", "box"))
    return l.select("page", "block", "line", "box.*").where("x1 > x0 AND y1 > y0")


def overlapping_lines(lines: DataFrame, threshold: float = 0.55, cell: float = 64.0) -> DataFrame:
    """Per page the number of line pairs of different blocks that overlap by more than ``threshold`` of the smaller.

    Lines of one place in a block are one box with their number: a pair of boxes stands for the product
    of theirs, so copies add no pairs to look at.  Boxes are put into grid cells and only meet within a cell; a pair counts in the cell that
    holds the upper left corner of its intersection, so it counts once.  Cells are dealt by key, since the planner knows
    nothing of how many there are and might hand all of them to every task.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("int"), F.floor(F.col(b) / cell).cast("int"))
    boxes = lines.groupBy("page", "block", "x0", "y0", "x1", "y1").agg(F.count("*").alias("n"))
    cells = boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    other = cells.select("page", "cx", "cy", *(F.col(c).alias(c + "_b") for c in ("block", "x0", "y0", "x1", "y1", "n")))
    j = cells.hint("merge").join(other, ["page", "cx", "cy"]).where("block < block_b")
    w = F.least("x1", "x1_b") - F.greatest("x0", "x0_b")
    h = F.least("y1", "y1_b") - F.greatest("y0", "y0_b")
    small = F.least((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), (F.col("x1_b") - F.col("x0_b")) * (F.col("y1_b") - F.col("y0_b")))
    here = (F.floor(F.greatest("x0", "x0_b") / cell) == F.col("cx")) & (F.floor(F.greatest("y0", "y0_b") / cell) == F.col("cy"))
    return j.where((w > 0) & (h > 0) & here & (w * h > threshold * small)).groupBy("page").agg(F.sum(F.col("n") * F.col("n_b")).alias("overlaps"))


def page_findings(p: DataFrame, tolerance: float = 1.0, least_ink: float = 0.0001, least_relative: float = 0.15) -> DataFrame:
    """Findings of a page pair as rows ``page, category, severity``.

    ``p``: ``page, sw, sh, tw, th, s_text, t_text, s_images, t_images, missing_images, fonts, notdef,
    outside, overlaps, s_ink, t_ink, raster_ok``.
    """
    c = F.col
    seen = lambda text, images: (F.trim(F.coalesce(c(text), F.lit(""))) != "") | (c(images) > 0)
    ink = lambda x: F.when(c("raster_ok"), c(x)).otherwise(0.0)
    rules = [
        (F.greatest(F.abs(c("sw") - c("tw")), F.abs(c("sh") - c("th"))) > tolerance, "PAGE_GEOMETRY", "BLOCKING"),
        (c("missing_images") > 0, "IMAGE_COVERAGE", "BLOCKING"),
        (seen("s_text", "s_images") & ~seen("t_text", "t_images"), "BLANK_PAGE", "BLOCKING"),
        (c("t_text").contains("�"), "CORRUPT_GLYPH", "BLOCKING"),
        ((F.trim("t_text") != "") & (c("fonts") == 0), "FONT", "BLOCKING"),
        (c("notdef"), "FONT", "ERROR"),
        (c("outside") > 0, "OUT_OF_BOUNDS", "BLOCKING"),
        (c("overlaps") > 0, "OVERLAP", "ERROR"),
        (~c("raster_ok"), "FILE_INTEGRITY", "BLOCKING"),
        ((ink("s_ink") >= least_ink) & (ink("t_ink") < least_ink), "CONTENT_DENSITY", "BLOCKING"),
        ((ink("s_ink") > 0) & (ink("t_ink") / ink("s_ink") < least_relative), "CONTENT_DENSITY", "ERROR"),
    ]
    found = F.filter(F.array(*(F.when(k, F.struct(F.lit(cat).alias("category"), F.lit(sev).alias("severity"))) for k, cat, sev in rules)), lambda x: x.isNotNull())
    return p.select("page", F.inline(found))


def page_count_findings(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """``key, source_pages, target_pages`` and the finding that blocks where the numbers of pages differ; pages are compared only after this gate."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = count(source, "source_pages").join(count(target, "target_pages"), key, "full_outer").fillna(0, ["source_pages", "target_pages"])
    return both.where("source_pages <> target_pages").withColumns({"category": F.lit("PAGE_COUNT"), "severity": F.lit("BLOCKING")})


def verdict(severities: Column) -> Column:
    """BLOCK if any severity is ERROR or BLOCKING."""
    return F.when(F.exists(severities, lambda s: s.isin("ERROR", "BLOCKING")), "BLOCK").otherwise("PASS")


def report(findings: DataFrame, key: str) -> DataFrame:
    """Verdict and ordered findings per report key."""
    return findings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("category", "severity"))).alias("findings")).withColumn("verdict", verdict(F.transform("findings", lambda f: f["severity"])))


def binding_problems(*keys: str) -> Column:
    """Names of the keys that a report states (``said_<key>``) otherwise than they are."""
    return F.filter(F.array(*(F.when(~F.col(k).eqNullSafe(F.col(f"said_{k}")), F.lit(k)) for k in keys)), lambda x: x.isNotNull())
