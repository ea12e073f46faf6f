"""Nested items, page texts and like rules against plain versions."""

import difflib
import json
import math
import random

import numpy as np
import pytest

from gridstone.plans.records import like_rules, like_statements, normalised_items, page_texts


def test_items_with_missing_levels(spark):
    items = [
        {"external_id": "e", "id": "i", "title": "  A House ", "description": "90 m2", "price": 5, "url": "/x", "images": ["p", "q"], "location": {"governorate": " G "}, "metadata": {"publishedOn": "1970-01-02T00:00:00Z", "publisher": {"name": "N", "isShop": True}}},
        {"id": "i", "title": " ", "images": [], "location": None, "metadata": {"publishedOn": "soon"}},
        {"id": "j", "url": "https://a/b", "price": "dear"},
        {},
    ]
    got = normalised_items(spark.createDataFrame([(json.dumps(i), 1) for i in items] + [("no json", 1), (None, 1)], "item string, title int")).collect()
    assert len(got) == 6
    full = got[0]
    assert (full.external_id, full.title, full.price, full.city, full.area, full.image, full.images_count) == ("e", "A House", 5.0, "G", None, "p", 2)
    assert (full.published_epoch, full.surface_m2_text, full.rooms_text, full.publisher_is_shop) == (86400.0, 90.0, None, True)
    assert (full.url_direct, full.url_guess, full.url) == ("https://listings.example/x", "https://listings.example/item/a-house/e", "https://listings.example/x")
    assert full.known == ",".join(n for n in full.__fields__[:-1] if full[n] is not None) and "area" not in full.known
    assert (got[1].title, got[1].images_count, got[1].published_on, got[1].published_epoch, got[1].url) == (None, 0, "soon", None, "https://listings.example/item/-/i")
    assert got[2].url == got[2].url_direct == "https://a/b" and got[2].price is None
    assert all(r.known == "images_count" for r in got[3:])


def test_pages_are_cleaned_and_guarded(spark):
    text = "\n".join([" " * 41 + "TN", " " * 40 + "TN", "  head \t", "", " 123 ", "1234", "....... 3", "by Official Printing Office.", "a\x07b"]) + "\f \n 7 \fla la" + "\n" * 3 + "la\f"
    rows = [(1, text, "x"), (2, "", "x"), (3, None, "x"), (4, "la " * 49 + "l", "x"), (5, "la " * 30 + "DE" * 20, "x"), (6, "la\n" * 400_000, "x")]
    got = {r.id: r for r in page_texts(spark.createDataFrame(rows, "doc_id long, text string, body string"), least=3).collect()}
    assert (got[1].pages, got[1].hits, got[1].body) == (4, 3, "TN\nhead\n1234\nab\nla la\nla")
    assert [(got[i].pages, got[i].hits, got[i].in_domain, got[i].body) for i in (2, 3)] == [(1, 0, False, None), (0, 0, False, None)]
    assert got[6].hits == 400_000 and len(got[6].body) == 3 * 400_000 - 1
    strict = {r.id: (r.hits, r.in_domain, r.body is None) for r in page_texts(spark.createDataFrame(rows, "doc_id long, text string, body string")).collect()}
    assert strict[4] == (49, False, True) and strict[5] == (50, True, False)


@pytest.mark.parametrize("block", [7, 4096])
def test_like_rules_equal_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    vecs = [(base[i % 6] + 0.25 * rng.normal(size=8)).tolist() for i in range(90)]
    rows = [(i, None if i % 7 == 0 else i % 3, v) for i, v in enumerate(vecs)]
    rows += [(100 + i, i % 2, vecs[5]) for i in range(6)]  # equal vectors of two statuses
    odd = [(200, 0, None), (201, 0, [0.0] * 8), (202, 0, [math.nan] + [1.0] * 7), (203, 0, [None] + [1.0] * 7), (None, 0, vecs[0])]
    got = {(r.a, r.b): r.likeness for r in like_rules(spark.createDataFrame(rows + odd, "id long, status int, vec array<double>"), 0.85, pivots=4, block=block).collect()}
    first = {}
    for i, s, v in rows:
        first.setdefault((s, tuple(v)), i)
    want = {(first[s, tuple(v)], i): 1.0 for i, s, v in rows if first[s, tuple(v)] != i}
    lead = [(i, s, np.array(v) / np.linalg.norm(v)) for (s, v), i in first.items()]
    want |= {tuple(sorted((a, b))): round(float(x @ y), 3) for k, (b, t, y) in enumerate(lead) for a, s, x in lead[:k] if s == t and x @ y >= 0.85}
    assert got == pytest.approx(want, abs=1e-3) and len(want) > 100
    assert like_rules(spark.createDataFrame([], "id long, status int, vec array<double>")).count() == 0


@pytest.mark.parametrize("most", [4, 2000])
def test_like_statements_equal_all_pairs(spark, most):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    base = [(word(), word(), f"{word()} {word()}") for _ in range(15)]
    rows = [(rng.choice(["may", "must", None]), *(x if rng.random() < 0.7 else x.replace("a", "b", 1) for x in rng.choice(base))) for _ in range(90)]
    rows += [("may", None, None, None), ("may", "", " ", ""), ("may", None, "only", None), ("may", "x" * 50, "y", "z"), ("may", "x" * 51, "y", "z")] * 2
    got = {(r.status, r.a, r.b): r.likeness for r in like_statements(spark.createDataFrame(rows, "status string, actor string, action string, target string"), 0.85, most).collect()}
    known = sorted({(s or "", " ".join(x or "" for x in p).lower().strip(" ")) for s, *p in rows if "".join(x or "" for x in p).strip()})
    want = {(s or None, a, b): round(v, 3) for i, (t, b) in enumerate(known) for s, a in known[:i] if s == t and (v := difflib.SequenceMatcher(None, a, b).ratio()) >= 0.85}
    assert got == want and len(want) > 20
    assert like_statements(spark.createDataFrame([], "status string, actor string, action string, target string")).count() == 0
