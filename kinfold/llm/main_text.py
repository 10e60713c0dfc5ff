"""Main text of web pages by scoring the nodes of their trees.

Paragraphs earn points for their length and commas; the points go up to their ancestors, halved with each level, and a
container's total is discounted by the share of its text inside links. The best container and those of its siblings that belong
to it are kept, without menus, headers, footers, asides, notices, adverts, forms, scripts, styles and comments.

What an element is called tells less inside an article or of a paragraph: there a name counts only as a whole ("ad-slot", but not "share-price"), or
for a container that is short or mostly links; and unless it names adverts, comments or the like, a paragraph has to be short or mostly links, too.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^<>]*+)>", re.S
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An element that starts closes the nearest open one of these, up to one of the barriers.
CLOSES = {t: frozenset(["p"]) for t in BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}}
CLOSES |= {"li": frozenset(["li", "p"]), "dd": frozenset(["dd", "dt", "p"]), "dt": frozenset(["dd", "dt", "p"]), "option": frozenset(["option"])}
CLOSES |= {"tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"])}
BARRIER = {t: frozenset(["ul", "ol", "menu", "dl"]) for t in ("li", "dd", "dt")} | {t: frozenset(["table"]) for t in ("tr", "td", "th")}
OTHER_BARRIER = frozenset(["table", "td", "th", "button", "object", "body", "html"])

DROP_TAGS = frozenset("head script style noscript template textarea title nav aside footer form button select option input label iframe object embed svg math canvas audio video dialog menu noembed noframes xmp".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr"
    " login masthead menu modal nav navbar navigation newsletter notice notification notifications pager pagination popup promo promotion promoted recommended recommendations"
    " related respond responses share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words whose elements go even if they are a long paragraph, and words that say nothing beside another.
SURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising advertorial banner comment comments consent cookie cookies disqus gdpr newsletter popup promo promoted sponsor sponsored".split())
PLAIN_WORDS = frozenset(
    "area bar block body bottom box button buttons center column container content custom desktop element first float group head icon icons id in inline inner item items js large last left"
    " line link links list main mobile module new on outer page panel primary right row secondary section site slot small sticky text title top unit wrap wrapper zone".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ALERTS = frozenset("alert alerts announcement disclaimer header topbar".split())
NEGATE = frozenset("has with no without non".split())
GOOD_WORDS = frozenset("article body content entry main page post story text".split())
KEPT_TAGS = frozenset("html body main article".split())
SCORED = frozenset("p pre td th blockquote li dd dt div section article main body center figcaption h1 h2 h3 h4 h5 h6 address".split())


def _words(value: str) -> list[str]:
    return [w.lower() for w in WORD.findall(value)]


def main_text(page: str | None) -> str:
    """The page's blocks of main text joined by newlines; '' for None, empty pages and pages without text."""
    if not page:
        return ""
    tag, parent, attrs, items = ["html"], [-1], [""], []
    stack, places = [0], {"html": [0]}  # open elements, and the places of each tag among them
    seen = {"html"}
    at = 0
    find = TOKEN.search

    def cut(k: int) -> bool:
        """Close all elements from place k of the stack; tells whether a block was among them."""
        block = False
        while len(stack) > k:
            closed = tag[stack.pop()]
            places[closed].pop()
            block |= closed in BLOCK
        return block

    while m := find(page, at):
        if m.start() > at:
            items.append((stack[-1], page[at : m.start()]))
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            held = places.get(name)
            if held and held[-1]:
                k = held[-1]
                closed = stack[k]
                if cut(k):
                    items.append((closed, None))
            continue
        if name in ("html", "body"):
            if name in seen:
                continue
            seen.add(name)
        if closing := CLOSES.get(name):
            stop = max((held[-1] for t in BARRIER.get(name, OTHER_BARRIER) if (held := places.get(t))), default=0)
            above = [held[bisect_right(held, stop)] for t in closing if (held := places.get(t)) and held[-1] > stop]
            if above:
                cut(min(above))
        n = len(tag)
        tag.append(name)
        parent.append(stack[-1])
        attrs.append(m.group(3))
        if name in BLOCK:
            items.append((n, None))
        elif name == "br":
            items.append((stack[-1], " "))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^<>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not m.group(3).endswith("/") or name in BLOCK and name not in VOID:
            places.setdefault(name, []).append(len(stack))
            stack.append(n)
    if at < len(page):
        items.append((stack[-1], page[at:]))

    n = len(tag)
    holds = bytearray(n)  # an h1 or main is inside
    for i in range(n - 1, 0, -1):
        if tag[i] in ("h1", "main") or holds[i]:
            holds[parent[i]] = 1
    size, linked = [0] * n, [0] * n  # characters, and those in links, of each element with all below it
    in_link = bytearray(n)
    for i in range(1, n):
        in_link[i] = tag[i] == "a" or in_link[parent[i]]
    for i, raw in items:
        if raw is not None and not raw.isspace():
            size[i] += len(raw)
            linked[i] += len(raw) * in_link[i]
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
        linked[parent[i]] += linked[i]
    drop, bonus, inside = bytearray(n), [0.0] * n, bytearray(n)
    for i in range(n):
        up = parent[i]
        if up >= 0 and drop[up]:
            drop[i] = 1
            continue
        inside[i] = tag[i] in ("article", "main") or (up >= 0 and inside[up])
        if tag[i] in DROP_TAGS or tag[i] == "header" and not (up >= 0 and inside[up]):
            drop[i] = 1
            continue
        if tag[i] in ("article", "main"):
            bonus[i] = 25.0
        if not attrs[i] or "=" not in attrs[i] and "hidden" not in attrs[i].lower():
            continue
        for a in ATTRIBUTE.finditer(attrs[i]):
            key, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
            if key == "role":
                drop[i] |= value.lower() in DROP_ROLES
            elif key == "style":
                drop[i] |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif key == "hidden":
                drop[i] |= value.lower() != "until-found"
            elif key == "aria-hidden":
                drop[i] |= value.lower() == "true"
            else:
                for name in value.split():
                    words = _words(name)
                    plain = not any(w in NEGATE for w in words)
                    bad = plain and any(w in DROP_WORDS or w in ALERTS and not inside[i] for w in words)
                    if bad and (inside[i] or tag[i] in PARAGRAPHS):
                        whole = all(w in DROP_WORDS or w in PLAIN_WORDS for w in words)
                        slight = size[i] < 60 or 4 * linked[i] > size[i]
                        bad = whole and (slight or any(w in SURE_WORDS for w in words)) if tag[i] in PARAGRAPHS else whole or slight
                    if bad and tag[i] not in KEPT_TAGS and not holds[i]:
                        drop[i] = 1
                    elif bad and tag[i] == "article" and any(w in ("comment", "comments", "ad", "advert", "promo", "related", "sponsored") for w in words):
                        drop[i] = 1
                    elif plain and any(w in GOOD_WORDS for w in words):
                        bonus[i] = max(bonus[i], 10.0)

    # Text, commas and linked text of each node: its own first, then with all below it.
    own, commas, linked, total = [0] * n, [0] * n, [0] * n, [0] * n
    holder = list(range(n))  # the block that a node's text belongs to
    for i in range(1, n):
        if tag[i] not in BLOCK:
            holder[i] = holder[parent[i]]
    texts: list[str | None] = []
    for i, raw in items:
        if raw is None or drop[i]:
            texts.append(None)
            continue
        text = html.unescape(raw) if "&" in raw else raw
        texts.append(text)
        length = len(text) if not text.isspace() else 0
        if length:
            own[holder[i]] += length
            commas[holder[i]] += text.count(",") + text.count("،") + text.count("、") + text.count("，")
            total[i] += length
            if in_link[i]:
                linked[i] += length
    links = [0] * n
    for i in range(n - 1, 0, -1):
        if not drop[i]:
            total[parent[i]] += total[i]
            linked[parent[i]] += linked[i]
            links[parent[i]] += links[i] + (tag[i] == "a")
    score = [0.0] * n
    for i in range(n):
        if own[i] and not drop[i] and tag[i] in SCORED:
            points = (1.0 + commas[i] + own[i] / 100.0) * (1 - linked[i] / max(1, total[i]))
            # A container's own text is a paragraph of the container itself.
            up = parent[i] if tag[i] not in ("div", "section", "article", "main", "body", "td", "center") else i
            share = 1.0
            while up >= 0 and share > 0.01:
                score[up] += points * share
                share /= 2
                up = parent[up]
    best, top = 0, -1.0
    for i in range(n):
        if score[i] > 0 and not drop[i] and tag[i] in BLOCK:
            value = (score[i] + bonus[i]) * (1 - linked[i] / max(1, total[i]))
            if value > top:
                best, top = i, value
    # A list, table part or quotation is part of an article, not one.
    while tag[best] in ("ul", "ol", "dl", "li", "dd", "dt", "tr", "td", "tbody", "table", "blockquote", "figure", "p") and parent[best] > 0 and tag[parent[best]] not in ("body", "html"):
        best = parent[best]

    keep = bytearray(n)
    keep[best] = 1
    up = parent[best]
    if up >= 0:
        semantic = tag[best] in ("article", "main")
        for i in range(up + 1, n):
            if parent[i] != up or drop[i] or i == best:
                continue
            density = linked[i] / max(1, total[i])
            if semantic:
                keep[i] = tag[i] == tag[best] and score[i] >= 0.2 * score[best]
            elif tag[i] in ("h1", "h2", "p"):
                keep[i] = density < 0.25 and (i < best and tag[i] == "h1" or total[i] > 80 or tag[i] == "p" and not linked[i] and total[i] > 0)
            else:
                keep[i] = density < 0.33 and score[i] >= 0.2 * score[best] > 0
    for i in range(1, n):
        if keep[parent[i]]:
            keep[i] = 1
        menu = tag[i] in ("ul", "ol", "dl", "div", "table", "section") and i != best and links[i] >= 2 and 3 * linked[i] > 2 * total[i]
        if drop[i] or menu:
            keep[i] = 0
            drop[i] = 1

    blocks, now = [], []
    for (i, raw), text in zip(items, texts, strict=True):
        if raw is None:
            if now and (block := " ".join("".join(now).split())):
                blocks.append(block)
            now = []
        elif text is not None and keep[i]:
            now.append(text)
    if now and (block := " ".join("".join(now).split())):
        blocks.append(block)
    return "\n".join(blocks)


def _extract(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages; text is '' for null, empty and textless html.

    Ids, urls and repeated rows pass through as they are, nulls too; other columns are left out. A page of any
    length is read whole, in time proportional to its length.
    """
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
