"""Products to pages of a catalogue. Sections of one catalogue compete for the same pages, so this is a sequence; it runs group by
group, for each catalogue, whose size is that of a printed book."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import normalize_section

ASSIGNMENTS = "catalogue string, product long, page long, place int, how string"


def sections_fit(page_key: str, section_key: str) -> bool:
    """Equal keys, or half of the tokens (3 letters or more; a page's repeated tokens count again) of the shorter one in common."""
    if not page_key or not section_key:
        return False
    if page_key == section_key:
        return True
    a, b = ([t for t in key.split(" ") if len(t) >= 3] for key in (page_key, section_key))
    common = sum(t in b for t in a)
    return bool(common) and common / min(len(a), len(b)) >= 0.5


def place_products(sections: dict[str, list[int]], pages: dict[int, tuple[str, int]], overflow: bool = False, richness: dict[int, float] | None = None) -> list[tuple[int, int | None, int, str]]:
    """(product, page or None, place on the page, how) for sections of products and pages of (section key, blocks).

    Large sections choose first. A section takes as few pages as its products need, in parts whose sizes differ by one, each on the
    smallest page that holds the part (else the largest), or with richness on the richest page, those that hold the part first. What is left fills pages with room, of any section; then, with
    overflow, the first page of its section or of all; else it stays unplaced.
    """
    free, filled, left = dict(pages), {}, []
    owner: dict[int, str] = {}
    for key, products in sorted(sections.items(), key=lambda x: -len(x[1])):
        fitting = [p for p in free if sections_fit(free[p][0], key)] or list(free)
        if not fitting:
            left += [(key, x) for x in products]
            continue
        n = min(len(fitting), max(1, math.ceil(len(products) / max(free[p][1] for p in fitting))))
        sizes = [len(products) // n + (i < len(products) % n) for i in range(n)]
        rest = list(products)
        for size in sizes:
            pool = [p for p in fitting if p in free]
            if not pool:
                break
            fit = lambda p: free[p][1] if free[p][1] >= size else -free[p][1]
            page = min(pool, key=lambda p: (free[p][1] < size, -richness[p] if richness else fit(p)))
            take = min(free[page][1], size, len(rest))
            filled[page], owner[page], rest = rest[:take], key, rest[take:]
            del free[page]
        left += [(key, x) for x in rest]
    out = [(x, page, i, "section") for page, own in filled.items() for i, x in enumerate(own)]
    for key, x in left:
        room = next((p for p in filled if len(filled[p]) < pages[p][1]), None)
        how = "room"
        if room is None and overflow and filled:
            room, how = next((p for p in filled if owner[p] == key), next(iter(filled))), "overflow"
        if room is None:
            out.append((x, None, 0, "unplaced"))
        else:
            filled[room].append(x)
            out.append((x, room, len(filled[room]) - 1, how))
    return out


def page_richness(blocks: DataFrame) -> DataFrame:
    """catalogue, page, richness (0 to 1) of pages by their blocks (catalogue, page, n_specs, has_image, has_ref): blocks up to three and specs up to
    five a block weigh 0.3 each, the shares of blocks with an image and with a reference 0.2 each."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    n, specs = F.least(F.lit(1.0), F.count(F.lit(1)) / 3), F.least(F.lit(1.0), F.avg("n_specs") / 5)
    return blocks.groupBy("catalogue", "page").agg((n * 0.3 + specs * 0.3 + share("has_image") * 0.2 + share("has_ref") * 0.2).alias("richness"))


def allocate(products: DataFrame, pages: DataFrame, *, overflow: bool = False, by_richness: bool = False) -> DataFrame:
    """catalogue, product, page, place, how for products (catalogue, product, section, ord) and pages (catalogue, page, section,
    blocks, and richness with by_richness). Every product comes back once; a catalogue without pages has all its products unplaced."""
    p = products.select("catalogue", F.col("product").cast("long").alias("product"), normalize_section(F.coalesce("section", F.lit(""))).alias("key"), F.col("ord").cast("long").alias("ord"))
    q = pages.select("catalogue", F.col("page").cast("long").alias("page"), normalize_section(F.coalesce("section", F.lit(""))).alias("key"), F.col("blocks").cast("int").alias("blocks"), (F.col("richness") if by_richness else F.lit(0.0)).cast("double").alias("richness")).filter("blocks > 0")

    def run(key, own: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        own, there = own.sort_values("ord"), there.sort_values("page")
        sections: dict[str, list[int]] = {}
        for r in own.itertuples(index=False):
            sections.setdefault(r.key, []).append(int(r.product))
        rows = place_products(sections, {int(r.page): (r.key, int(r.blocks)) for r in there.itertuples(index=False)}, overflow, {int(r.page): float(r.richness) for r in there.itertuples(index=False)} if by_richness else None)
        out = pd.DataFrame(rows, columns=["product", "page", "place", "how"])
        out.insert(0, "catalogue", key[0])
        return out.astype({"page": "Int64", "place": "int32"})

    return p.groupBy("catalogue").cogroup(q.groupBy("catalogue")).applyInPandas(run, ASSIGNMENTS)


def dropped_pages(pages: DataFrame, assignments: DataFrame, products: DataFrame) -> DataFrame:
    """Pages without products, and why: none of the sections fits, or its section needed fewer pages."""
    used = assignments.filter("page IS NOT NULL").select("catalogue", "page").distinct()
    keys = products.select("catalogue", normalize_section(F.coalesce("section", F.lit(""))).alias("key")).distinct().withColumn("known", F.lit(True))
    rest = pages.join(used, ["catalogue", "page"], "left_anti").withColumn("key", normalize_section(F.coalesce("section", F.lit(""))))
    return rest.join(keys, ["catalogue", "key"], "left").select("catalogue", "page", F.when(F.col("known"), "section_overprovided").otherwise("no_section_match").alias("reason"))
