"""Comments and teasers that are article elements, and nesting that once took quadratic time."""

from __future__ import annotations

import random
import time

import pytest

from eventloom.llm import html_extract

R = random.Random(9)


def prose(n):
    return " ".join("".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(n))


SHAPES = [
    "<article class='post has-sidebar comments-open'><h1>{t}</h1><p>{b}</p></article>{c}",
    "<article><h1>{t}</h1><p>{b}</p><section>{c}</section></article>",
    "<main><article class='post'><h1>{t}</h1><p>{b}</p></article><div>{c}</div></main>",
]
NAMES = ["class='comment'", "class='comment-body' id='div-comment-7'", "id='reply-3'", "class='teaser'", "class='related-post'"]


def test_articles_that_are_comments(spark):
    """20 pages of a host for each shape and name, and hosts whose comments have no article."""
    rows, want = [], {}
    for host, (shape, name) in enumerate((s, n) for s in SHAPES for n in NAMES):
        for k in range(20):
            title, body = f"T{k} {prose(3)}", prose(60)
            said = "".join(f"<article {name}><p>reader {k} {i} says {prose(4)}</p></article>" for i in range(k % 3 + 1))
            want[len(rows)] = f"{title}\n{body}"
            rows.append((len(rows), f"https://h{host}.example/{k}", f"<html><body>{shape.format(t=title, b=body, c=said)}</body></html>"))
    for k in range(12):
        body = prose(50)
        want[len(rows)] = f"T{k}\n{body}"
        rows.append((len(rows), f"https://other.example/{k}", f"<html><body><div class='text'><h1>T{k}</h1><p>{body}</p></div><div id='discussion'><p>Hello {prose(3)}</p></div><div class='reactions'><p>{k} People {prose(1)}</p></div></body></html>"))
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


@pytest.mark.parametrize("start, one", [("<p><td>", "<b><div></div>"), ("<i><td>", "<b></i>"), ("<li><ul>", "<b><li></b>"), ("<p><table>", "<i></p>"), ("<article><a>", "<td></a>")])
def test_nesting_takes_linear_time(start, one):
    def took(n):
        page = (start + one * n).encode()
        best = 9e9
        for _ in range(3):
            began = time.process_time()
            html_extract.parse(page)
            best = min(best, time.process_time() - began)
        return best

    took(1000)
    small, large = took(5000), took(20_000)
    assert large < 1.5 and large < 10 * max(small, 0.01)
