"""Stray quotes and visibility in HTML pages."""

import pytest

from gesso.llm.html_layout import attributes, render


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p class="a"">Hello world</p><p>more text</p>', "Hello world\n\nmore text"),
        ("<a href=/o'brien>link text</a><p>rest", "link text\n\nrest"),
        ("<p x=a\"b>one</p>two\" three", 'one\n\ntwo" three'),
        ("<p \"quoted\">one</p 'x>two", "one\n\ntwo"),
        ("<b>one</b\"> two</b> it's", "one two it's"),
        ("<a b='x''>one</a> <a b==c\">two</a>", "one two"),
        ("<p a='>' b= \"x>y\">one", "one"),
        ('<p a="b"hidden>no</p>one', "one"),
    ],
)
def test_stray_quotes(page, text):
    assert render(page) == text


def test_attributes():
    assert attributes(""" a="1"b=2 c d='x' e= f  =  "g" h=o'b /""") == {"a": "1", "b": "2", "c": "", "d": "x", "e": "f", '"g"': "", "h": "o'b"}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> b", "a x=2 b"),
        ("<svg><title/><rect style='display:none'/><defs><text>no</text></defs><text>Jan</text><text>Feb</text></svg>", "Jan Feb"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ('<span aria-hidden="true">drawn</span>', "drawn"),
        ('<div style="visibility:hidden">no <b style="color:red; visibility:visible">yes</b> no</div>end', "yes\nend"),
        ('<ul style="visibility:hidden"><li>no<li style="visibility: visible">b</ul>', "- b"),
        ('<div style="display:none">no<b style="visibility:visible">no</b></div>end', "end"),
    ],
)
def test_visible_text(page, text):
    assert render(page) == text
