"""Queries that SQL can't express, against the same rules written out over rows in memory."""

import math
import re
import unicodedata
from collections import defaultdict

import pytest
from compare import DATA

from pagewright.queries.catalogue import QUERIES
from pagewright.queries.pages import HEIGHT, WIDTH, texts


def rows(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{DATA}/{name}.parquet").collect()]


def plain(s):
    s = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", s).strip()


def fits(page, section):
    if not page or not section:
        return False
    a, b = ([t for t in k.split(" ") if len(t) >= 3] for k in (page, section))
    return page == section or (bool(a) and bool(b) and 0 < sum(t in b for t in a) and sum(t in b for t in a) * 2 >= min(len(a), len(b)))


def allocated(spark, overflow=False, rich=None):
    """catalogue -> {product: (page, place, how)}"""
    part = sorted(rows(spark, "part"), key=lambda r: r["p_partkey"])
    out = {}
    for brand in sorted({r["p_brand"] for r in part}):
        own = [r for r in part if r["p_brand"] == brand]
        blocks = {r["p_partkey"]: r["p_size"] % 4 + 1 for r in own if r["p_size"] % 3 == 0}
        label = {r["p_partkey"]: plain(r["p_type"]) if r["p_size"] % 2 == 0 else "" for r in own if r["p_size"] % 3 == 0}
        groups = {}
        for r in own:
            groups.setdefault(plain(r["p_type"]), []).append(r["p_partkey"])
        free, on, of, waiting, placed = list(blocks), {}, {}, [], {}
        for key in sorted(groups, key=lambda k: (-len(groups[k]), list(groups).index(k))):
            queue = list(groups[key])
            pool = [p for p in free if fits(label[p], key)] or list(free)
            if pool:
                n = min(len(pool), max(1, math.ceil(len(queue) / max(blocks[p] for p in pool))))
                for i in range(n):
                    part_size = len(groups[key]) // n + (i < len(groups[key]) % n)
                    big = [p for p in pool if blocks[p] >= part_size]
                    if rich:
                        page = max(big or pool, key=lambda p: (rich[brand, p], -pool.index(p)))
                    else:
                        page = min(big, key=lambda p: (blocks[p], pool.index(p))) if big else max(pool, key=lambda p: (blocks[p], -pool.index(p)))
                    take = min(blocks[page], part_size)
                    on[page], of[page], queue = queue[:take], key, queue[take:]
                    pool.remove(page)
                    free.remove(page)
            waiting += [(key, x) for x in queue]
        for page, own_products in on.items():
            placed |= {x: (page, i, "section") for i, x in enumerate(own_products)}
        for key, x in waiting:
            page = next((p for p in on if len(on[p]) < blocks[p]), None)
            how = "room"
            if page is None and overflow and on:
                page, how = next((p for p in on if of[p] == key), next(iter(on))), "overflow"
            if page is None:
                placed[x] = (None, 0, "unplaced")
            else:
                placed[x] = (page, len(on[page]), how)
                on[page].append(x)
        out[brand] = placed
    return out


def flat(found):
    return {(brand, x, *v) for brand, own in found.items() for x, v in own.items()}


@pytest.mark.parametrize("name", ["q_alloc", "q_alloc_overflow", "q_alloc_rich"])
def test_allocation(spark, name):
    rich = {(r["catalogue"], r["page"]): r["richness"] for r in QUERIES["q_page_richness"](spark, DATA).collect()} if name.endswith("rich") else None
    got = {(r["catalogue"], r["product"], r["page"], r["place"], r["how"]) for r in QUERIES[name](spark, DATA).collect()}
    assert got == flat(allocated(spark, name.endswith("overflow"), rich))


def test_dropped_pages(spark):
    used = {(b, page) for b, _, page, *_ in flat(allocated(spark))}
    part = rows(spark, "part")
    known = {(r["p_brand"], plain(r["p_type"])) for r in part}
    want = {(r["p_brand"], r["p_partkey"], "section_overprovided" if r["p_size"] % 2 == 0 and (r["p_brand"], plain(r["p_type"])) in known else "no_section_match") for r in part if r["p_size"] % 3 == 0 and (r["p_brand"], r["p_partkey"]) not in used}
    assert {tuple(r) for r in QUERIES["q_dropped_pages"](spark, DATA).select("catalogue", "page", "reason").collect()} == want


def contents(spark):
    """brand -> [(kind, text, contents page)]: a header before each row where the type changes, then the name, 12 a page and no header at an end."""
    out = {}
    for brand in {r["p_brand"] for r in rows(spark, "part")}:
        items, family, shown = [], None, None
        for r in sorted((r for r in rows(spark, "part") if r["p_brand"] == brand), key=lambda r: (r["p_type"], r["p_size"], r["p_partkey"])):
            if r["p_type"].strip() != family:
                family, shown = r["p_type"].strip(), None
                items.append(("family", family))
            if r["p_name"].strip() != shown:
                shown = r["p_name"].strip()
                items.append(("subfamily", shown))
            items.append(("row", str(r["p_partkey"])))
        page, at, pages = 1, 0, []
        while at < len(items):
            end = min(at + 12, len(items))
            if end < len(items) and items[end - 1][0] != "row":
                end -= 1
            pages += [(*x, page) for x in items[at:end]]
            at, page = end, page + 1
        out[brand] = pages
    return out


def test_contents_pages_and_heights(spark):
    want = contents(spark)
    got = defaultdict(list)
    for r in QUERIES["q_toc_chunk"](spark, DATA).orderBy("p_brand", "position").collect():
        got[r["p_brand"]].append((r["kind"], r["text"], r["contents_page"]))
    assert dict(got) == want
    heights = {}
    for brand, items in want.items():
        y, page = 0.0, None
        for position, (kind, _, p) in enumerate(items, 1):
            first = p != page
            y, page = (120.0 if first else y + 18.0 + {"family": 14.4, "subfamily": 6.3, "row": 0.0}[kind]), p
            heights[brand, position] = round(y, 6)
    assert {(r["p_brand"], r["position"]): round(r["y0"], 6) for r in QUERIES["q_contents_offsets"](spark, DATA).collect()} == heights


def pages_of(spark):
    out = defaultdict(list)
    for r in texts(spark, DATA).collect():
        out[r["page"]].append(r.asDict())
    return {p: sorted(x, key=lambda r: r["ord"]) for p, x in out.items()}


def test_ribbons(spark):
    want = set()
    for page, spans in pages_of(spark).items():
        boxes = []
        for s in spans:
            b = [s["x0"], s["y0"], s["x1"], s["y1"]]
            lying = b[2] - b[0] > b[3] - b[1]
            for o in boxes:
                u = [min(b[0], o[0]), min(b[1], o[1]), max(b[2], o[2]), max(b[3], o[3])]
                same = (o[2] - o[0] > o[3] - o[1]) == lying
                if same and (abs(b[1] - o[1]) <= 4 and u[2] - u[0] <= 0.7 * WIDTH if lying else abs(b[0] - o[0]) <= 4 and u[3] - u[1] <= 0.7 * HEIGHT):
                    o[:] = u
                    break
            else:
                boxes.append(b)
        want |= {(page, *(round(x, 6) for x in b)) for b in boxes}
    got = {(r["page"], *(round(r[c], 6) for c in ("x0", "y0", "x1", "y1"))) for r in QUERIES["q_ribbons"](spark, DATA).collect()}
    assert got == want


def test_resolved_intents(spark):
    got = {r["what"]: r["n"] for r in QUERIES["q_resolved_intents"](spark, DATA).collect()}
    edits = QUERIES["q_product_intents"](spark, DATA).collect()
    zones = {(r["page"], r["target"]): r["is_text"] for r in QUERIES["q_page_schema"](spark, DATA).collect()}
    want = defaultdict(int)
    for e in edits:
        at = e["page"], e["target"]
        if e["op"] == "update_spec":
            for kind in ("key", "value"):
                assert zones[e["page"], f"{e['target']}.{kind}"]
                want["erase_rect"] += 1
                want["insert_text"] += 1
        elif at not in zones:
            want["no such target"] += 1
        elif e["op"] == "replace_text":
            want["erase_rect"] += 1
            want["insert_text"] += 1
        else:
            want["erase_rect"] += 1
            want["draw_image"] += e["op"] == "swap_image"
    assert got == {k: n for k, n in want.items() if n}


def test_states_of_users(spark):
    from test_streams import circuit_by_hand


    events = spark.read.parquet(f"{DATA}/events.parquet").toPandas()
    ms = events["ts"].astype("datetime64[us]").astype("int64") // 1000
    calls = [(int(u), int(i), int(t), {"error": "429", "view": "ok"}.get(k, "500")) for u, i, t, k in zip(events["user_id"], events["event_id"], ms, events["event_type"], strict=True)]
    want = circuit_by_hand(calls, 2, 86_400_000)
    for name in ("q_circuit_states", "q_stream_circuit"):
        assert {r["event_id"]: (r["refused"], r["failures"]) for r in QUERIES[name](spark, DATA).collect()} == want
    held, admitted = {}, {}
    for key, i, now, _ in sorted(calls, key=lambda c: (c[2], c[1])):
        admitted[i] = now - held.get(key, -(10**15)) >= 3_600_000
        held[key] = now if admitted[i] else held[key]
    assert {r["event_id"]: r["admitted"] for r in QUERIES["q_stream_admission"](spark, DATA).collect()} == admitted


def barcode(text):
    t = "".join(text.split())
    n, letters, digits = len(t), sum(bool(re.match("[a-zA-ZÀ-ÿœŒæÆ]", c)) for c in t), sum(c in "0123456789" for c in t)
    if len(text.strip()) < 3 or not n:
        return False
    if digits == n and n >= 5:
        return True
    if n <= 30 and (letters + digits) / n >= 0.8:
        return False
    return (n - letters - digits) / n > 0.3 or letters / n < 0.5


def blocks_by_hand(spans):
    """[(name, top, bottom, left, right)] of a page's product names, or None where equal places leave the order open."""
    names = [s for s in spans if 9 <= s["size"] <= 12 and s["x0"] < 400 and not barcode(s["text"])]
    if len({(s["y0"], s["x0"]) for s in names}) < len(names):
        return None
    runs = []
    for s in sorted(names, key=lambda s: (s["y0"], s["x0"])):
        last = runs[-1] if runs else None
        near = last and abs(s["size"] - last["size"]) < 1
        if near and ((abs(s["x0"] - last["x0"]) < 8 and s["y0"] - last["y1"] < 8) or (abs(s["y0"] - last["y0"]) < 8 and -2 <= s["x0"] - last["x1"] < 10)):
            last |= {"text": f"{last['text']} {s['text'].strip()}", "x1": max(last["x1"], s["x1"]), "y1": max(last["y1"], s["y1"])}
        else:
            runs.append(s | {"text": s["text"].rstrip()})
    n = len(runs)
    tolerance = max(4.0, 0.3 * sorted(r["size"] for r in runs)[n // 2]) if n else 4.0
    lines = []
    for r in runs:
        line = next((g for g in lines if abs(g[0] - r["y0"]) <= tolerance), None)
        if line:
            line[1] += 1
        else:
            lines.append([r["y0"], 1])
    most = max((c for _, c in lines), default=0)
    in_rows = n >= 2 and ((most >= 2 and most / n >= 0.4) or (most >= 3 and most / n >= 0.33))
    out = []
    for i, r in enumerate(runs):
        if in_rows:
            below = min((x["y0"] for x in runs if x["y0"] - r["y0"] > tolerance), default=None)
            right = min((x["x0"] for x in runs if abs(x["y0"] - r["y0"]) <= tolerance and x["x0"] > r["x0"]), default=1e9)
        else:
            below, right = (runs[i + 1]["y0"] if i + 1 < n else None), 1e9
        out.append((r["text"], r["y0"], 565.0 if below is None else below - 4, 0.0 if in_rows else -1e9, right))
    return out


def test_blocks_of_names(spark):
    got = defaultdict(list)
    for r in QUERIES["q_name_blocks"](spark, DATA).orderBy("page", "block").collect():
        got[r["page"]].append((r["name"], r["top"], r["bottom"], r["left"], r["right"]))
    compared = rows_of = 0
    for page, spans in pages_of(spark).items():
        want = blocks_by_hand(spans)
        if want is not None:
            assert got.get(page, []) == want
            compared += 1
            rows_of += any(b[3] == 0.0 for b in want)
    assert compared > 1000 and rows_of > 10
