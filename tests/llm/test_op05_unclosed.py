"""Hidden elements whose end tag is left out hide no main text."""

import pytest

from quire.llm.op05_html_trees import _semantic, main_text, parse

ARTICLE = "<article><h1>Head line</h1><p>First paragraph.<p>Second paragraph.</p></article>"
TEXT = "Head line\nFirst paragraph.\nSecond paragraph."


def read(page):
    blocks = parse(page)
    return main_text(blocks, _semantic(blocks))


def seen(page):
    blocks = parse(page)
    return main_text(blocks, [True] * len(blocks))


@pytest.mark.parametrize("head", ["<head><title>x</title><body>", "<head><title>x</title>", "<head><meta charset=utf-8><link href=a><body class=x>",
                                  "<head><head><script>var a;</script><body>", "<head><script src='a.js'/><body>", "<head><script src='a.js'/>",
                                  "<head><title>x</title></head><body>", "<title>x</title>"])
def test_head_without_end_tag(head):
    assert read("<html>" + head + ARTICLE + "</body></html>") == TEXT


def test_text_ends_a_head():
    assert seen("<html><head><title>x</title>\nHello <b>there</b><p>More") == "Hello there\nMore"


@pytest.mark.parametrize("part", ["<svg/>", "<svg width='1' />", "<svg><path d='M0'/>", "<svg><path d='M0'>", "<button>Menu", "<button>Menu<button>More</button>",
                                  "<select><option>a<option>b", "<option>a", "<object data='x'>", "<object data='x'/>", "<audio src='x'>", "<audio src='x'/>",
                                  "<video src='x'>none", "<canvas>", "<iframe src='x'/>", "<map name='x'><area>", "<math/>"])
def test_hidden_element_without_end_tag(part):
    page = f"<html><head><title>x</title></head><body>{part}{ARTICLE}</body></html>"
    assert read(page) == seen(page) == TEXT
    assert read(f"<body><article>{part}<h1>Head line</h1><p>First paragraph.</p>{part}<p>Second paragraph.</article>") == TEXT


def test_closed_ones_hide_what_they_hold():
    page = ("<head><title>x</title></head><body><button><div>Menu</div></button><select><option>a<option>b</select><svg><text>s</text></svg>"
            "<object><p>none</p></object>" + ARTICLE)
    assert seen(page) == TEXT


def test_many_unclosed_ones_are_read_in_linear_time():
    page = "<body>" + "<select><option>a<option>b" * 2000 + ARTICLE
    assert read(page) == TEXT
