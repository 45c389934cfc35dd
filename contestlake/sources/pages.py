"""Rows from stored raw pages, with native pattern extraction over the whole page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LINK = '<a href="([^"]*)">([^<]*)</a>'


def _one(pattern: str, text: str = "html") -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def fields(pages: DataFrame) -> DataFrame:
    """Title, heading, language and link count of each page."""
    return pages.select("page_id", _one("<title>([^<]*)</title>").alias("title"), _one("<h1>([^<]*)</h1>").alias("h1"),
                        F.regexp_count("html", F.lit('<a href="([^"]*)"')).alias("n_links"),
                        _one('<html lang="([^"]*)"').alias("lang"))


def labelled(pages: DataFrame, labels: list[str]) -> DataFrame:
    """Value that follows each label ('Label: value' or label and value in adjoining tags)."""
    return pages.select("page_id", *[
        F.trim(_one(rf"(?is){label}\s*:?\s*(?:</[^>]+>\s*<[^>]+>)?\s*([^<]+)")).alias(label.lower().replace(" ", "_"))
        for label in labels])


def record(pages: DataFrame) -> DataFrame:
    """Career record W-L-D as numbers, wherever it first appears in the page."""
    pattern = r"\b(\d{1,3})-(\d{1,3})-(\d{1,3})\b"
    return pages.select("page_id", *[F.regexp_extract("html", pattern, i).try_cast("int").alias(n)
                                     for i, n in ((1, "wins"), (2, "losses"), (3, "draws"))])


def event_date(pages: DataFrame) -> DataFrame:
    """Start date of the embedded linked-data block, else the first date written out in a title, heading or meta text."""
    linked = F.try_to_date(_one(r'"startDate"\s*:\s*"(\d{4}-\d{2}-\d{2})'), "yyyy-MM-dd")
    texts = F.regexp_extract_all("html", F.lit(r'(?is)<(?:title|h1|h2)\b[^>]*>.*?</(?:title|h1|h2)>|<meta\b[^>]*>'), 0)
    written = F.transform(texts, lambda x: F.try_to_date(F.regexp_replace(F.regexp_extract(x, r"\b[A-Z][a-z]+\s+\d{1,2},\s+\d{4}\b", 0), r"\s+", " "), "MMMM d, yyyy"))
    return pages.select("page_id", F.coalesce(linked, F.get(F.filter(written, lambda d: d.isNotNull()), F.lit(0))).alias("event_date"))


def link_rows(pages: DataFrame) -> DataFrame:
    """One row per link of a page, in page order."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), 1).alias("target"),
                        F.regexp_extract_all("html", F.lit(LINK), 2).alias("label"))
    return pages.select("page_id", F.posexplode(both).alias("pos", "x")).select("page_id", "pos", "x.target", "x.label")


def price_cells(pages: DataFrame) -> DataFrame:
    """Price cells of stored event pages: each cell carries [book, side, matchup] and a price."""
    pattern = r'data-li="\[(\d+),(\d+),(\d+)\]"[^>]*>(?:<[^>]+>)*([+\-−]\d+)'
    parts = [F.regexp_extract_all("html", F.lit(pattern), i).alias(n)
             for i, n in ((1, "book"), (2, "side"), (3, "matchup"), (4, "price"))]
    return (pages.select("page_id", F.posexplode(F.arrays_zip(*parts)).alias("pos", "x"))
            .select("page_id", "pos", "x.*"))


def side_rows(pages: DataFrame) -> DataFrame:
    """Rows of a page's second table body that name an entity: its id, its matchup and side, the median price and number of books.

    Rows with a class hold other markets.  A row's first priced cell gives its matchup and side; rows without
    one, and pages with fewer than two table bodies, give nothing.
    """
    body = F.regexp_extract("html", r"(?is)<tbody\b[^>]*>.*?</tbody>.*?<tbody\b[^>]*>(.*?)</tbody>", 1)
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(body, F.lit(r"(?is)<tr(?![^>]*\bclass=)[^>]*>(.*?)</tr>"), 1)).alias("pos", "tr"))
    cell = (r'(?is)<td(?=[^>]*\bclass="[^"]*\bbut-sg\b)[^>]*\bdata-li="\[(\d+),\s*(\d+),\s*(\d+)\]"[^>]*>'
            r'(?:(?!</td>|<span[^>]*\bid="oID).)*<span[^>]*\bid="oID[^>]*>\s*([+\-−]?\d+)\s*</span>')
    part = {n: F.regexp_extract_all("tr", F.lit(cell), i) for i, n in ((2, "side"), (3, "matchup"), (4, "price"))}
    link = r'(?is)<a\b[^>]*href="(/fighters/[^"]*)"[^>]*>([^<]*)</a>'
    rows = rows.select("page_id", "pos", F.regexp_extract("tr", link, 1).alias("href"), F.trim(F.regexp_extract("tr", link, 2)).alias("name"),
                       *[F.get(part[n], F.lit(0)).cast("bigint").alias(n) for n in ("side", "matchup")],
                       F.array_sort(F.transform(part["price"], lambda x: F.translate(x, "−", "-").cast("int"))).alias("prices"))
    n = F.size("prices")
    middle = (F.get("prices", F.floor((n - 1) / 2).cast("int")) + F.get("prices", F.floor(n / 2).cast("int"))) / 2.0
    return rows.filter("href <> '' AND matchup IS NOT NULL").select(
        "page_id", "pos", "matchup", "side", "name", F.nullif(F.regexp_extract("href", r"-(\d+)/?$", 1), F.lit("")).alias("source_id"), middle.alias("price"), n.alias("n_books"))


def matchups(pages: DataFrame) -> DataFrame:
    """Both sides of every matchup that has exactly two rows on its page, the lower side number first."""
    rows = side_rows(pages)
    fields, place = F.struct("name", "source_id", "price", "n_books"), F.struct("side", "pos")
    both = rows.groupBy("page_id", "matchup").agg(F.count("*").alias("n"), F.min_by(fields, place).alias("a"), F.max_by(fields, place).alias("b")).filter("n = 2")
    return both.select("page_id", "matchup", *[F.col(f"{s}.{c}").alias(f"{c}{i}") for i, s in ((1, "a"), (2, "b")) for c in ("name", "source_id", "price", "n_books")])


def pairs(rows: DataFrame, group: str) -> DataFrame:
    """Groups of a page that hold exactly two entries; anything else is not a matchup."""
    return (rows.groupBy("page_id", group).agg(F.count("*").alias("n"), F.min("target").alias("first_target"),
                                               F.max("target").alias("last_target")).filter("n = 2"))
