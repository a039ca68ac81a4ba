"""Landed JSON documents: listing pages, item details and employers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import schemas, wording
from tagweave.functions.documents import first_industry, parse_tags
from tagweave.session import stage
from tagweave.sources.small import sized
from tagweave.sources.tables import to_table


def request_grid(keywords: DataFrame, cities: dict[str, int] = wording.CITIES) -> DataFrame:
    """One row per (keyword, city) to crawl."""
    places = F.create_map(*[F.lit(part) for city in cities.items() for part in city])
    return keywords.select("keyword", F.explode(places).alias("city", "city_id"))


def default_keywords(spark: SparkSession) -> DataFrame:
    return to_table(spark, list(enumerate(wording.KEYWORDS)), "ordinal int, keyword string")


#: What could not be read of a document, and the schema and the required fields by kind.
REFUSED = "_refused"
KINDS = {
    "page": (schemas.LISTING_PAGE, ("keyword", "page")),
    "detail": (schemas.ITEM_DETAIL, ("id",)),
    "employer": (schemas.EMPLOYER, ("id",)),
}


def _scan(
    spark: SparkSession, path: str, schema: str, required: tuple[str, ...], multi_line: bool
) -> tuple[DataFrame, DataFrame]:
    """The documents at ``path``, and those that are not JSON or lack a required field.

    Without ``multi_line`` every line is a document, with it every file is one.
    """
    found = (
        spark.read.schema(f"{schema}, {REFUSED} string")
        .option("columnNameOfCorruptRecord", REFUSED)
        .option("multiLine", multi_line)
        .json(path)
    )
    good = reduce(Column.__and__, [F.col(name).isNotNull() for name in required], F.col(REFUSED).isNull())
    return found.filter(good).drop(REFUSED), found.filter(~good)


def scan_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Listing pages; keyword and page come from the document or from partition folders.

    A document that cannot be read is a page that was never fetched to the crawl; :func:`refused` has
    them.
    """
    return _scan(spark, path, *KINDS["page"], multi_line)[0]


def refused(spark: SparkSession, path: str, kind: str, multi_line: bool = False) -> DataFrame:
    """``(kind, keyword, refused)``: the documents that the scan of this kind leaves out.

    ``kind`` is page, detail or employer. A page's keyword is known where folders name it. ``refused``
    is the text, null where it is JSON without what names it.
    """
    schema, required = KINDS[kind]
    keyword = F.col("keyword") if "keyword" in required else F.lit(None).cast("string")
    return _scan(spark, path, schema, required, multi_line)[1].select(
        F.lit(kind).alias("kind"), keyword.alias("keyword"), F.col(REFUSED).alias("refused")
    )


def readable(kind: str) -> Column:
    """Whether a document that was read with the column of refused text has all that its kind needs."""
    return reduce(Column.__and__, [F.col(name).isNotNull() for name in KINDS[kind][1]], F.col(REFUSED).isNull())


def stream_landed(
    spark: SparkSession, path: str, files_per_batch: int = 1000, multi_line: bool = False
) -> DataFrame:
    """Listing pages as they land, the unreadable ones too, with the text of these."""
    return (
        spark.readStream.schema(f"{schemas.LISTING_PAGE}, {REFUSED} string")
        .option("columnNameOfCorruptRecord", REFUSED)
        .option("multiLine", multi_line)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def stream_pages(
    spark: SparkSession, path: str, files_per_batch: int = 1000, multi_line: bool = False
) -> DataFrame:
    """The readable pages of :func:`stream_landed`, whose other documents are for a sink of their own."""
    return stream_landed(spark, path, files_per_batch, multi_line).filter(readable("page")).drop(REFUSED)


def crawled_pages(pages: DataFrame) -> DataFrame:
    """The pages a page-by-page crawl would have kept.

    A crawl of a keyword starts at page 0 and ends before the first empty page, before the first
    missing page, or after the first page whose number has reached its own page count. The end is
    found by two aggregations over page numbers, which are combined before they are shuffled.
    """
    filled = F.coalesce(F.size("items"), F.lit(0)) > 0
    final = F.coalesce(F.col("page") >= F.col("pages"), F.lit(False))
    yes, no = F.lit(True), F.lit(False)

    def mark(at: Column, stop: Column, last: Column, goes_on: Column) -> Column:
        """At page ``at`` the crawl may stand, must end, or finds a filled page behind it."""
        return F.struct(
            at.cast("int").alias("at"),
            stop.alias("stop"),
            last.alias("last"),
            goes_on.alias("goes_on"),
        )

    marks = F.array(
        mark(F.lit(-1), yes, no, no),
        mark(F.col("page"), yes, final, no),
        mark(F.col("page") - 1, no, no, filled),
    )
    ends = (
        pages.select("keyword", marks.alias("marks"))
        .select("keyword", F.inline("marks"))
        .groupBy("keyword", "at")
        .agg(*[F.max(c).alias(c) for c in ("stop", "last", "goes_on")])
        .filter(F.col("stop") & (F.col("last") | ~F.col("goes_on")))
        .groupBy("keyword")
        .agg(F.min("at").alias("last_page"))
    )
    return (
        pages.join(sized(ends, "ends"), "keyword")
        .filter(F.col("page") <= F.col("last_page"))
        .drop("last_page")
    )


def land_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Listing pages parsed once, as a table; the end of a crawl is found in its columns."""
    return stage(scan_pages(spark, path, multi_line), "pages")


def page_items(pages: DataFrame) -> DataFrame:
    """One row per listed item, with its place in the listing."""
    return pages.select("keyword", "page", F.posexplode("items").alias("position", "item"))


def scan_details(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(id, skills) of the item detail documents."""
    raw = _scan(spark, path, *KINDS["detail"], multi_line)[0]
    return raw.select("id", parse_tags(F.col("key_skills")).alias("skills"))


def scan_employers(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(id, industry) of the employer documents."""
    raw = _scan(spark, path, *KINDS["employer"], multi_line)[0]
    return raw.select("id", first_industry(F.col("industries")).alias("industry"))
