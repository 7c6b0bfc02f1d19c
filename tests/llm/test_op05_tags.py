"""Tags by the attribute rules of HTML against a walk over single characters, and deep pages in linear time."""

import random
import time

import pytest

from quire.llm.op05_html_trees import TAG, parse


def walk(page, at):
    """End of the tag that starts at ``at``, state by state; a value that is never closed ends like a bare one."""
    i, n = at + 1, len(page)
    i += page[i] == "/"
    while i < n and page[i] not in " \n\t/>":
        i += 1
    while i < n and page[i] != ">":
        if page[i] in " \n\t/":
            i += 1
            continue
        i += 1
        while i < n and page[i] not in " \n\t/>=":
            i += 1
        j = i
        while j < n and page[j] in " \n\t":
            j += 1
        if j < n and page[j] == "=":
            i = j + 1
            while i < n and page[i] in " \n\t":
                i += 1
            if i < n and page[i] in "\"'" and page.find(page[i], i + 1) >= 0:
                i = page.find(page[i], i + 1) + 1
            else:
                while i < n and page[i] not in " \n\t>":
                    i += 1
    return min(i + 1, n)


@pytest.mark.parametrize("seed", range(5))
def test_tags_end_where_a_walk_ends_them(seed):
    r = random.Random(seed)
    for _ in range(2000):
        page = "<p" + "".join(r.choice(" \n/=\"'ab>=\"' ") for _ in range(r.randrange(25))) + r.choice(["", ">", "> text"])
        m = TAG.match(page)
        assert m and m.end() == walk(page, 0), page


def text(page):
    return " ".join(" ".join(x for x in b.parts if isinstance(x, str)).strip() for b in parse(page)).split()


@pytest.mark.parametrize("page,want", [
    ('<div class="a"">main text</div>', "main text"),
    ("<p title=it's>one</p><p title=that's>two</p>", "one two"),
    ('<p title="a>b" class=x>in</p>', "in"),
    ('<p ="x>">in</p>', '">in'),
    ('<p title="never closed>in</p>', "in"),
])
def test_stray_quotes_lose_no_text(page, want):
    assert text(page) == want.split()


def test_class_inside_another_value_is_no_class():
    b = parse('<div title="x class=sidebar">t</div><div CLASS=sidebar>t</div>')
    assert [x.bad for x in b[1:]] == [0, 1]


@pytest.mark.parametrize("page", [
    lambda n: "<div>" * n + "x" + "</b></i></section>" * n,
    lambda n: "<div>" * n + "<li>x</li>" * n,
    lambda n: "<b>" * n + "<p>x</p>" * n,
    lambda n: "<b>" * n + "<div>x" * n + "</b>" * n,
], ids=["stray ends", "items", "inline", "crossed"])
def test_ten_thousand_levels_take_linear_time(page):
    def took(n):
        start = time.process_time()
        parse(page(n))
        return time.process_time() - start
    took(1000)
    small = max(took(10_000), 0.02)
    assert took(40_000) < 9 * small
