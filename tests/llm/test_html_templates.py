"""Wrapper induction against a plain version in one process, on any partitioning, and on pages that no class name tells apart."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import pytest

from eventloom.llm import html_extract as H

R = random.Random(11)


def prose(n):
    return " ".join("".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(n))


def frame(spark, pages, parts=3):
    rows = [(k, f"http://a.example/{k}", page) if isinstance(page, str) else (k, *page) for k, page in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)


def extracted(spark, pages, parts=3):
    return {r.page_id: r.text for r in H.extract(frame(spark, pages, parts)).collect()}


def plain(pages):
    """The texts of the pages of one host, by the definition."""
    read = [H.parse(p.encode()) for p in pages]
    folded = [H.fold(p) for p in read]
    shapes = {}
    for tree, _ in folded:
        shapes.setdefault(H._hash(tree.write()), tree.write())
    groups = defaultdict(list)
    for h in sorted(shapes):
        groups[h % H.BUCKETS].append(shapes[h])
    trees = []
    for g in sorted(groups):
        tree = H.Tree.read(groups[g][0])
        for text in groups[g][1:]:
            H.absorb(tree, H.Tree.read(text))
        trees.append(H.Tree.read(tree.write()))
    whole = trees[0]
    for tree in trees[1:]:
        H.absorb(whole, tree)
    whole = H.Tree.read(whole.write())
    slots = []
    for (tree, place), page in zip(folded, read, strict=True):
        to, number = H.align(whole, H.Tree.read(tree.write())), H._preorder(tree)
        slots.append([to[number[place[k]]] for k, _, _ in page.blocks])
    once = {tuple(t for _, t, _ in p.blocks): (p, s) for p, s in zip(read, slots, strict=True) if p.blocks}
    seen, size, linked = Counter(), {}, {}
    for page, mine in once.values():
        for s, t, n in {(s, t): (s, t, n) for s, (_, t, n) in zip(mine, page.blocks, strict=True)}.values():
            seen[s, t] += 1
            size[s, t], linked[s, t] = len(t), max(linked.get((s, t), 0), min(n, len(t)))
    fixed = {k for k, n in seen.items() if n >= H.MIN_PAGES and n >= H.SHARE * len(once)}
    volume = defaultdict(lambda: (0.0, 0.0))
    for k, n in seen.items():
        if k not in fixed:
            a, b = volume[k[0]]
            volume[k[0]] = a + n * size[k], b + n * linked[k]
    content, out = set(H._judge(whole, dict(volume))), {}
    for k, (page, mine) in enumerate(zip(read, slots, strict=True)):
        chosen = [(node, t) for (node, t, _), s in zip(page.blocks, mine, strict=True) if s in content]
        kept = {(node, t) for (node, t, _), s in zip(page.blocks, mine, strict=True) if s in content and (s, t) not in fixed}

        def inside(node, page=page):
            while node > 0:
                if H.ARTICLE in page.labels[node]:
                    return True
                node = page.parents[node]
            return False

        if any(inside(node) for node, _ in chosen):
            chosen = [x for x in chosen if inside(x[0])]
        out[k] = "\n".join(t for x in chosen if x in kept for t in [x[1]])
    return out


@pytest.fixture(scope="module")
def untold():
    """Pages whose boilerplate has no telling element or name: constant lines, and link lists that vary. With the texts wanted."""
    pages, want = [], []
    lines = [prose(6) for _ in range(5)]
    for k in range(60):
        body = [prose(R.randint(5, 40)) for _ in range(R.randint(1, 6))]
        links = "".join(f"<a href='/{j}'>{prose(2)}</a> " for j in range(R.randint(2, 5)))
        extra = f"<div class=x7><ul>{''.join(f'<li>{prose(3)}</li>' for _ in range(k % 3))}</ul></div>" if k % 3 else ""
        head = f"<div class=a1><div class=b2>{lines[0]}</div><div class=b3>{links}</div></div>"
        tail = f"<div class=c3>{lines[1]}<br>{lines[2]}</div><div>{lines[3]}</div>" + (f"<p>{lines[4]}</p>" if k % 5 else "")
        pages.append(f"<html><body>{head}<div class=q9><h2>{prose(4)} {k}</h2>{''.join(f'<p>{t}</p>' for t in body)}{extra}</div>{tail}</body></html>")
        want.append("\n".join(body))
    return pages, want


def test_boilerplate_without_telling_names(spark, untold):
    pages, want = untold
    got = extracted(spark, pages)
    assert got == plain(pages)
    # what tag and name rules alone leave: everything
    naive = ["\n".join(t for _, t, _ in H.parse(p.encode()).blocks) for p in pages]
    assert all(got[k] != naive[k] for k in range(len(pages)))
    for k, text in enumerate(want):
        assert text in got[k] and len(got[k].split("\n")) == text.count("\n") + 2 + (k % 3)


def test_any_partitioning_gives_the_same(spark, untold):
    pages = untold[0] + [untold[0][3]] * 40 + ["<article><p>only one page</p></article>"] * 8
    one = extracted(spark, pages, 1)
    assert one == extracted(spark, pages, 8) == extracted(spark, pages, 211)
    assert all(one[k] == "only one page" for k in range(100, 108))
    copies = extracted(spark, ["<article><h1>Head</h1><p>Body</p></article>"] * 8, 8)
    assert set(copies.values()) == {"Head\nBody"}


def test_wrappers_too_large_to_send(spark, untold, monkeypatch):
    pages = [*untold[0], ("http://b.example/1", "<p>alone</p>"), (None, None), ("http://c.example/", "")]
    want = extracted(spark, pages)
    monkeypatch.setattr(H, "SENT_CONSTANTS", 0)
    assert extracted(spark, pages, 7) == want
    assert want[60] == "alone" and want[61] == want[62] == ""


def test_constant_among_new_siblings(spark):
    def page(k):
        new = [f"<p>text {j} of page {k}</p>" for j in range(16)]
        return f"<article>{''.join(new[:8])}{'<p>Printed on our paper</p>' if k % 10 else ''}{''.join(new[8:])}<p>in few {k % 60}</p></article>"

    got = extracted(spark, [page(k) for k in range(120)] + [page(1)] * 50)
    assert all("Printed on our paper" not in t for t in got.values())
    assert all(t.count("\n") == 16 and t.split("\n")[-1].startswith("in few") for t in got.values())


def test_constant_after_very_many_slots(spark):
    pages = ["".join(f"<div class='x{7 * k + j}'>part {k} {j}<i>.</i></div>" for j in range(700)) + "<p>All rights are ours</p>" for k in range(8)]
    got = extracted(spark, pages)
    assert all(t.count("\n") == 699 and "All rights are ours" not in t for t in got.values())


def test_names_are_hints(spark):
    told = "".join(f"<p>{prose(20)}</p>" for _ in range(3))
    pages = [
        ("http://a/1", f"<div class='page-header widget'><h2>T</h2>{told}</div>"),  # all there is
        ("http://b/1", f"<div class=post>{told}</div><div class=comments>{told}{told}</div>"),
        ("http://c/1", "<article><header class='entry-header'><h1 class=header>Title</h1></header><p>Body text</p><div class=ad>Buy</div></article><p>outside</p>"),
        ("http://d/1", "<p title=it's>one</p><p>two</p><p>isn't</p>"),
        ("http://e/1", "<div>" * 600 + "<nav>menu</nav>deep" + "</div>" * 600),
        ("http://f/1", "<main><h1>Head</h1>text one<div>two</div> three<aside>no</aside><form>no</form></main><p>outside"),
        ("http://g/1", "plain \n text &amp; more<br>x<script>var a = '</p>';</script><!-- no --> <span class=share>Share</span>end"),
        ("http://h/1", "<p>a<table><tr><td>b<td>c</table><li>d<li>e"),
    ]
    got = extracted(spark, pages)
    assert got[0].startswith("T\n") and got[0].count("\n") == 3
    assert got[1].count("\n") == 2
    assert [got[k] for k in range(2, 8)] == ["Title\nBody text", "one\ntwo\nisn't", "deep", "Head\ntext one\ntwo\nthree", "plain text & more x end", "a\nb\nc\nd\ne"]


def test_empty_table_and_clashing_columns(spark):
    assert H.extract(frame(spark, ["x"]).limit(0)).count() == 0
    some = frame(spark, ["<p>a", "<p>a", (None, None)]).selectExpr("page_id", "url", "html", "'old' text", "1 host", "2 slot", "3 tree")
    got = H.extract(some)
    assert got.columns == ["page_id", "url", "host", "slot", "tree", "text"]
    assert sorted(r.text for r in got.collect()) == ["", "a", "a"]


def test_tree_matching_is_the_best_alignment():
    def tree(text):
        return H.Tree.read(text)

    def best(a, i, b, j):
        if a.labels[i] != b.labels[j]:
            return 0
        rows = [[0] * (len(b.kids[j]) + 1)]
        for x in a.kids[i]:
            row = [0]
            for q, y in enumerate(b.kids[j]):
                row.append(max(row[q], rows[-1][q + 1], rows[-1][q] + best(a, x, b, y)))
            rows.append(row)
        return rows[-1][-1] + 1

    a, b = tree("r:-1 a:0 b:0 c:2 d:0"), tree("r:-1 b:0 c:1 x:1 d:0 e:0")
    assert H.align(a, b) == [0, 2, 3, -1, 4, -1]
    H.absorb(a, b)
    assert a.write() == "r:-1 a:0 b:0 c:2 x:2 d:0 e:0"
    worse = 0
    for _ in range(300):
        def make():
            n = R.randint(1, 9)
            return H.Tree(["r"] + [R.choice("ab") for _ in range(n - 1)], [-1] + [R.randrange(k) for k in range(1, n)])

        a, b = make(), make()
        to = H.align(a, b)
        n = sum(x >= 0 for x in to)
        worse += best(a, 0, b, 0) - n  # pairing equal ends first may cost a little
        for k in range(len(b.labels)):
            assert [to[x] for x in b.kids[k] if to[x] >= 0] == [x for x in (a.kids[to[k]] if to[k] >= 0 else []) if x in to]
        H.absorb(a, b)
        assert len(a.labels) == len(set(range(len(a.labels)))) and -1 not in H.align(a, b)
    assert 0 <= worse <= 15


def test_odd_pages_take_linear_time():
    for bad in (b'<a x="', b"<a <a ", b"<b><p></p>", b"<div>", b"<p a='\"><p b=\"'>", b'<a x="> y="> z=">', b"<li><b>", b"</p>"):
        began = time.time()
        H.fold(H.parse(bad * 20_000))
        assert time.time() - began < 5, bad
