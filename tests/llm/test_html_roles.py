"""Roles in inline elements and hyphenated names, one article a page, small hosts; the style tree against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from strandline.llm import html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>One <span class='ad'>BUY NOW</span>two <a class='sponsored' href=x>More</a>three</p></article>", "One two three"),
        ("<article><p>One <span class='ad'>BUY <span>x</span> NOW</span>two</p><p>three <b class=big>four</b></p></article>", "One two three four"),
        ("<article><p>One <span class='ad'>never closed</p><p>two</p></article>", "One two"),
        ("<div class='site-header'>Top</div><div class='content'>Text</div><ul class='comment-list'><li>Nice</ul><div class='entry-footer'>F</div><p class=site_footer>G", "Text"),
        ("<div class='has-sidebar tag-notice'>Text <i hidden>gone</i>stays</div>", "Text stays"),
        ("<article class='post tag-notice'><header class='entry-header'><h1>Title</h1></header><p>Body</p></article>", "Title Body"),
        ("<article><p>The long story of the page</p></article><article><p>Teaser</p></article>", "The long story of the page"),
        ("<main><article>Short</article><article>The story itself <section><article>with a part</article></section></article><h2>Heading</h2></main>", "The story itself with a part Heading"),
        ("<article><div class='share-buttons'>Share</div>A &amp; B<br>C</article>", "A & B C"),
    ],
)
def test_roles(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("pages", [1, 2, 3, 4, 6])
def test_small_hosts(spark, pages):
    """Unmarked menus go on hosts of two pages and more; text that differs stays on all."""
    rows = [(i, f"http://h{pages}.example/{i}", f"<div class=m1><span>Home</span> <span>News</span></div><div class=t1><p>Story {i} of {'x' * (i + 1)}</p></div>") for i in range(pages)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        story = f"Story {r['id']} of {'x' * (r['id'] + 1)}"
        assert r["text"] == (story if pages > 1 else f"Home News {story}")


def brute_low(pages, threshold=0.2, gamma=0.9):
    """Paths of low importance of one host, from nested lists of (style, text) for pages without roles."""
    texts, shapes = {}, {}
    for page in pages:
        seen = set()

        def walk(path, node, seen=seen):
            style, text, children = node
            path = (*path, style)
            if text:
                for k in range(1, len(path) + 1):
                    seen.add((path[:k], text))
            names = [c[0] for c in children]
            merged = tuple(n for i, n in enumerate(names) if not i or names[i - 1] != n)
            if merged:
                shapes.setdefault(path, Counter())[merged] += 1
            for c in children:
                walk(path, c)

        walk((), page)
        for path, text in seen:
            texts.setdefault(path, Counter())[text] += 1
    low = set()
    for path, counts in texts.items():
        content = 1 - sum(math.log(n) for n in counts.values()) / len(counts) / math.log(len(pages))
        own = shapes.get(path, Counter())
        total = sum(own.values())
        shown = -sum(n / total * math.log(n / total) for n in own.values()) / math.log(len(pages)) if total else 0.0
        weight = gamma ** (sum(n * len(s) for s, n in own.items()) / total if total else 0.0)
        if (1 - weight) * shown + weight * content < threshold:
            low.add(path)
    return low


def test_style_tree_against_plain_python(spark):
    rng = random.Random(3)

    def made(depth):
        style = f"div.{rng.choice('abc')}"
        if depth == 3 or rng.random() < 0.3:
            return style, rng.choice(["Same", "Other", f"t{rng.randrange(10**6)}"]), []
        return style, "", [made(depth + 1) for _ in range(rng.randint(1, 3))]

    def markup(node):
        return f"<div class={node[0][4:]}>{node[1]}{''.join(map(markup, node[2]))}</div>"

    def texts(node, low, path=(), gone=False):
        path = (*path, node[0])
        gone = gone or path in low
        return ([] if gone or not node[1] else [node[1]]) + [t for c in node[2] for t in texts(c, low, path, gone)]

    rows, expected = [], {}
    for host in range(6):
        pages = [("div.r", "", [("div.m", "", [("div.l", "Same", []), ("div.l", "Other", [])]), made(1)]) for _ in range(rng.choice([2, 3, 6, 9]))]
        low = brute_low(pages)
        for page in pages:
            rows.append((len(rows), f"http://h{host}.example/", markup(page)))
            expected[rows[-1][0]] = " ".join(texts(page, low) or texts(page, set()))
    got = {r["id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected
    assert any(re.search("Same", re.sub("<[^>]*>", " ", h)) and "Same" not in got[i] for i, _, h in rows)
