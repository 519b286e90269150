"""Nested lists of pages against a parser with a stack."""

import random
from html.parser import HTMLParser

from taktwerk.operators import pages


class Stack(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.lists, self.out, self.taking = [], 0, [], None

    def handle_starttag(self, tag, attrs):
        self.taking = None
        attrs = dict(attrs)
        if tag in pages.LISTS:
            self.lists += 1
            self.open.append([self.lists, attrs.get("id") or None, self.open[-1][0] if self.open else None, 0])
        elif tag in pages.CHOICES and self.open and attrs.get("href" if tag == "a" else "value"):
            self.open[-1][3] += 1
            no, name, around, place = self.open[-1]
            self.taking = [no, name, around, len(self.open), place, attrs["href" if tag == "a" else "value"], ""]
            self.out.append(self.taking)

    def handle_endtag(self, tag):
        self.taking = None
        if tag in pages.LISTS and self.open:
            self.open.pop()

    def handle_comment(self, data):
        self.taking = None

    def handle_data(self, data):
        if self.taking:
            self.taking[-1] += data

    handle_entityref = handle_charref = lambda self, name: None


def parsed(html):
    p = Stack()
    p.feed(html or "")
    p.close()
    return sorted(tuple(x[:-1] + [" ".join(x[-1].split())]) for x in p.out)


def test_lists_against_a_stack(spark):
    rng = random.Random(4)
    bits = ["<ul>", "<ul id='n'>", "</ul>", "</ul>", "<OL class=x>", "</ol>", '<select name="s" id="stops">', "</select>", "<li>", "</li>", '<a class="b" href="/q">Q  r\n</a>', "<a href=/z >z</a>", '<a href="">none</a>', '<a data-href="/no">no</a>',
            "<option value='12' selected>Plärrer</option>", "<option>bare</option>", "<!-- <ul><a href='/c'>c</a> -->", "<script>var a='<ul>';</script>", "<p>text</p>", "<span>", "<article>", "<link>"]
    made = {i: "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for i in range(300)} | {1000: None, 1001: "", 1002: "no tags"}
    df = spark.createDataFrame(list(made.items()), "page_id long, html string").repartition(4)
    got = {}
    for r in pages.choices(df).collect():
        got.setdefault(r.page_id, []).append((r.list_no, r.list_id, r.parent_no, r.depth, r.place, r.target, r.label))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, h in made.items() if (v := parsed(h))}


def test_orders_there_and_back(spark):
    html = '<select id="stops"><option value="">choose</option><option value="5">A</option><option value="3">B</option><option value="9">C</option></select>'
    rows = pages.orders(pages.choices(spark.createDataFrame([(1, html)], "page_id long, html string"))).collect()
    assert sorted((r.list_no, r.direction, r.stops) for r in rows) == [(1, 1, ["5", "3", "9"]), (1, 2, ["9", "3", "5"])]
