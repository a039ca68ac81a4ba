"""Main text of pages by a site style tree.

Pages of a host are merged into one tree: a branch is the labels (element and classes) from the root
to an element. What a branch shows on the pages that have it is compared by entropies over the
logarithm of their number m. Its content is a set of features, windows of three words and the targets of
links; one that is on n of the m pages has the entropy ``log n / log m`` of being spread over them.
Its presentation is the sequence of its children, which has the entropy of its distribution. A branch
is as important as its content is unlike from page to page and its presentation varies, as a mean over
all features of all pages; so one link that changes does not make a menu a text. Branches below a
threshold belong to the site, not to a page, and go. Elements that never hold text, or that declare to
be menus, notices and so on by element, role or class, go in any case, and where a page has an article
only that is read. Pages with the same article count once, so copies do not make a text look like a
part of the site.

Every page is parsed once, into a table of its pieces. A host is never gathered in one place: the tree
is a table of branches, made of counts that are combined before they are dealt out. The low branches
meet the boxes of the pages by host, branch and a salt, so a box on all pages of a large host is many
keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.batches import slices
from tagweave.llm.dom import Page, text_of
from tagweave.session import stage

#: A branch goes if its importance is below this, and it is on at least this many different pages of its host.
IMPORTANCE, LEAST_PAGES = 0.3, 8
#: Parts in which a branch of a host meets its pages.
SALTS = 16
#: What is counted of a branch: contents, sequences of children, and pages where it has no children.
CONTENT, LAYOUT, LEAF = range(3)

_PIECES = [("text", "string"), ("box", "int"), ("block", "int"), ("article", "boolean"), ("main", "boolean")]
_FEATURES = [("branch", "long"), ("kind", "int"), ("feature", "long")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def _list_of(fields: list[tuple[str, str]]) -> tuple[str, pa.DataType]:
    sql = "array<struct<" + ", ".join(f"{n}: {t}" for n, t in fields) + ">>"
    return sql, pa.list_(pa.struct([(n, _ARROW[t]) for n, t in fields]))


def host_of(url: Column) -> Column:
    """The host in lower case; null if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][^:/?#]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.when(found != "", found))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _features(page: Page) -> list[tuple[int, int, int]]:
    out = []
    for box in page.boxes:
        branch = _signed(box.branch)
        out.append((branch, LAYOUT, box.layout) if box.inner else (branch, LEAF, 0))
        out += [(branch, CONTENT, _signed(x)) for x in box.content]
    return out


def parsed(pages: DataFrame) -> DataFrame:
    """Every row read once: ``row, page_id, url, host, page, text, branches, pieces, features``.

    ``page`` is the same for the same article, ``text`` what is left if no box goes. Of a page that has no
    box that could go, boxes, pieces and features are null.
    """
    pieces_sql, pieces_type = _list_of(_PIECES)
    features_sql, features_type = _list_of(_FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = [Page(html) for html in batch.column("html").to_pylist()]
            boxed = [any(piece[1] >= 0 for piece in page.pieces) for page in found]
            every = list(zip(found, boxed))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("row", "page_id", "url", "host")),
                    pa.array([_signed(page.identity()) for page in found], pa.int64()),
                    pa.array([text_of(page.pieces) for page in found], pa.string()),
                    pa.array([[_signed(x.branch) for x in p.boxes] if b else None for p, b in every], pa.list_(pa.int64())),
                    pa.array([_structs(p.pieces, _PIECES) if b else None for p, b in every], pieces_type),
                    pa.array([_structs(_features(p), _FEATURES) if b else None for p, b in every], features_type),
                ],
                names=["row", "page_id", "url", "host", "page", "text", "branches", "pieces", "features"],
            )

    schema = "row long, page_id long, url string, host string, page long, text string, branches array<long>, "
    narrow = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        host_of(F.col("url").cast("string")).alias("host"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    return narrow.mapInArrow(run, f"{schema}pieces {pieces_sql}, features {features_sql}")


def _structs(rows: list[tuple], fields: list[tuple[str, str]]) -> list[dict]:
    names = [name for name, _ in fields]
    return [dict(zip(names, row)) for row in rows]


def importance(read: DataFrame) -> DataFrame:
    """``(host, branch, n_pages, importance)`` over the different pages of a host."""
    pages = read.where("host IS NOT NULL AND features IS NOT NULL")
    # pages with one article may differ around it: the greatest list stands for them
    features = F.array_sort("features")
    different = pages.groupBy("host", "page").agg(F.max(features).alias("features"))
    each = different.select("host", F.explode("features").alias("x")).select("host", "x.*")
    n = F.count("*")
    counts = each.groupBy("host", "branch", "kind", "feature").agg(n.cast("double").alias("n"))

    def total(value: Column, *kinds: int) -> Column:
        return F.sum(F.when(F.col("kind").isin(*kinds), value).otherwise(0.0))

    spread = F.col("n") * F.log("n")
    tree = counts.groupBy("host", "branch").agg(
        total(F.col("n"), LAYOUT, LEAF).alias("m"),
        total(F.col("n"), CONTENT).alias("contents"),
        total(spread, CONTENT).alias("content_spread"),
        total(F.col("n"), LAYOUT).alias("layouts"),
        total(spread, LAYOUT).alias("layout_spread"),
    )
    # sums over contents of n (1 - log n / log m), and m times the entropy of the layouts over log m
    most = F.log("m")
    varied = F.col("contents") - F.col("content_spread") / most
    varied += F.when(F.col("layouts") > 0, F.col("layouts") * (F.log("layouts") / most) - F.col("layout_spread") / most).otherwise(0.0)
    weight = F.col("contents") + F.col("layouts")
    value = F.when((F.col("m") > 1) & (weight > 0), varied / weight).otherwise(F.lit(1.0))
    return tree.select("host", "branch", F.col("m").cast("long").alias("n_pages"), value.alias("importance"))


def low_branches(read: DataFrame) -> DataFrame:
    """``(host, branch)``: the branches of a host that belong to the site."""
    tree = importance(read).where((F.col("importance") < IMPORTANCE) & (F.col("n_pages") >= LEAST_PAGES))
    return stage(tree.select("host", "branch"), "style-tree")


def _low_boxes(read: DataFrame) -> DataFrame:
    """``(row, low)``: numbers of the boxes of a page that go, for pages that have such."""
    low = low_branches(read).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    boxes = read.where("host IS NOT NULL AND branches IS NOT NULL").select(
        "row", "host", (F.col("row") % SALTS).cast("int").alias("salt"), F.posexplode("branches").alias("box", "branch")
    )
    met = boxes.join(low, ["host", "branch", "salt"])
    return stage(met.groupBy("row").agg(F.collect_set("box").alias("low")), "low-boxes")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Character references are decoded, white space inside a block is one space, blocks are joined by
    line feeds. Null and empty pages have an empty text. Pages without a host are read without a style
    tree. Null ids and repeated rows are kept; extra columns are not read. Writes the pages as read,
    the low branches and the boxes that go to the folder of ``spark.checkpoint.dir``.
    """
    read = stage(parsed(pages), "pages-read")
    low = _low_boxes(read)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = zip(batch.column("pieces").to_pylist(), batch.column("low").to_pylist())
            texts = [text_of([tuple(piece.values()) for piece in pieces], set(gone)) for pieces, gone in rows]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text"])

    whole = read.select("row", "page_id", "url", "text").join(low, "row", "left_anti").drop("row")
    changed = read.select("row", "page_id", "url", "pieces").join(low, "row")
    changed = changed.mapInArrow(cut, "page_id long, url string, text string")
    found = whole.unionByName(changed)
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
